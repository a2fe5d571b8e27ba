"""The taxi-trip instance: canonical columns, dictionaries, rules, thresholds, reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from starpipe.spec import Column, DimSpec, FactSpec, GatePolicy, RunSettings

# --- Fixed values: names, orders, defaults and limits that results must agree on ---------

COLUMNS = (
    Column("vendor_id", "int", ("vendor_id", "vendorid", "VendorID"), 99),
    Column("pickup_ts", "timestamp",
           ("pickup_ts", "tpep_pickup_datetime", "pickup_datetime", "pickup_at")),
    Column("dropoff_ts", "timestamp",
           ("dropoff_ts", "tpep_dropoff_datetime", "dropoff_datetime", "dropoff_at")),
    Column("passenger_count", "int", ("passenger_count", "passenger_cnt"), 0),
    Column("trip_distance", "double", ("trip_distance", "trip_miles", "trip_distance_mi")),
    Column("ratecode_id", "int", ("ratecode_id", "ratecodeid", "RatecodeID"), 99),
    Column("store_and_fwd_flag", "string", ("store_and_fwd_flag", "store_and_fwd")),
    Column("pu_zone_id", "int",
           ("pu_zone_id", "pulocationid", "PULocationID", "pickup_location_id")),
    Column("do_zone_id", "int",
           ("do_zone_id", "dolocationid", "DOLocationID", "dropoff_location_id")),
    Column("payment_type", "int", ("payment_type", "paymenttype"), 5),
    Column("fare_amount", "double"),
    Column("extra", "double"),
    Column("mta_tax", "double"),
    Column("tip_amount", "double"),
    Column("tolls_amount", "double"),
    Column("improvement_surcharge", "double"),
    Column("total_amount", "double"),
    Column("congestion_surcharge", "double"),
    Column("pickup_date_id", "int"),
    Column("dropoff_date_id", "int"),
    Column("year", "int"),
    Column("month", "int"),
    Column("row_hash", "string", ("row_hash", "hash")),
)

SILVER_COLUMNS = (
    "vendor_id", "pickup_ts", "dropoff_ts", "passenger_count", "trip_distance",
    "ratecode_id", "store_and_fwd_flag", "pu_zone_id", "do_zone_id", "payment_type",
    "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
    "improvement_surcharge", "total_amount", "congestion_surcharge",
    "pickup_date_id", "dropoff_date_id", "year", "month", "row_hash",
    "is_zero_distance", "is_zero_duration", "is_negative_total", "is_passenger_missing",
)

EXPORT_COLUMNS = (
    "vendor_id", "pickup_ts", "dropoff_ts", "pickup_date_id", "dropoff_date_id",
    "passenger_count", "trip_distance", "ratecode_id", "store_and_fwd_flag",
    "pu_zone_id", "do_zone_id", "payment_type", "fare_amount", "extra", "mta_tax",
    "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount",
    "congestion_surcharge", "year", "month", "load_src", "row_hash",
)

HASH_INPUTS = (
    "vendor_id", "pickup_ts", "dropoff_ts", "passenger_count", "trip_distance",
    "ratecode_id", "store_and_fwd_flag", "pu_zone_id", "do_zone_id", "payment_type",
    "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
    "improvement_surcharge", "total_amount", "congestion_surcharge", "year", "month",
)

DUPLICATE_KEYS = (
    "vendor_id", "pickup_ts", "pu_zone_id", "do_zone_id", "total_amount", "row_hash",
)

DICTIONARY_SCHEMAS = {
    "vendor": "vendor_id int, vendor_name string",
    "ratecode": "ratecode_id int, description string",
    "payment_type": "payment_type_id int, description string",
    "store_flag": "store_flag string, description string",
    "dim_date": "date_id int, date string, year int, quarter int, month int, day int, "
                "iso_week int, iso_dow int, is_weekend boolean, is_month_start boolean, "
                "is_month_end boolean",
}

ZONE_HEADER = {
    "LocationID": "zone_id",
    "Borough": "borough",
    "Zone": "zone_name",
    "service_zone": "service_zone",
}

ZONES = DimSpec(
    "zones", "zone_id", "int",
    ("zone_id", "locationid", "LocationID", "Location_Id", "PULocationID", "DOLocationID"),
    {"zone_name": ("zone_name", "Zone", "zone", "service_zone", "ServiceZone"),
     "borough": ("borough", "Borough")},
)
PAYMENTS = DimSpec(
    "payment_type", "payment_type", "int",
    ("payment_type", "paymenttype", "payment_type_id", "paymenttypeid", "PaymentTypeID"),
    {"payment_desc": ("payment_desc", "payment_description", "description", "PaymentDesc")},
)
RATECODES = DimSpec(
    "ratecode", "ratecode_id", "int",
    ("ratecode_id", "ratecodeid", "RatecodeID"),
    {"ratecode_desc": ("ratecode_desc", "ratecode_description", "description", "RatecodeDesc")},
)
VENDORS = DimSpec(
    "vendor", "vendor_id", "int",
    ("vendor_id", "vendorid", "VendorID"),
    {"vendor_name": ("vendor_name", "vendor", "description", "VendorName")},
)
STORE_FLAGS = DimSpec(
    "store_flag", "store_flag", "flag",
    ("store_flag", "store_and_fwd_flag", "flag"),
    {"description": ("description", "desc", "store_flag_desc")},
)

CALENDAR_START = "2020-01-01"
CALENDAR_END = "2021-12-31"

GATE = GatePolicy(
    limits={
        "dq_silver": {
            "null_pickup_ts_pct": 2.5,
            "null_dropoff_ts_pct": 2.5,
            "null_pu_zone_id_pct": 2.5,
            "null_do_zone_id_pct": 2.5,
            "null_payment_type_pct": 2.5,
            "zero_distance_pct": 2.0,
            "zero_duration_pct": 2.0,
            "negative_total_pct": 1.5,
            "drop_lt_pickup_pct": 0.7,
            "duplicate_key_pct": 1.5,
        },
        "dq_join": {
            "unmapped_vendor_name_pct": 3.0,
            "unmapped_ratecode_desc_pct": 3.0,
            "unmapped_payment_desc_pct": 3.0,
            "unmapped_pu_zone_name_pct": 3.0,
            "unmapped_do_zone_name_pct": 3.0,
        },
        "dq_dwh": {
            "rowcount_mismatch_pct": 0.5,
            "null_zone_id_pct": 2.0,
            "null_payment_type_pct": 2.0,
            "null_ratecode_id_pct": 2.0,
            "null_vendor_id_pct": 2.0,
            "negative_total_pct": 1.5,
        },
    },
    gated=("dq_silver", "dq_join", "dq_dwh"),
)

PRESETS = {
    "baseline_soft": RunSettings(aqe=False, shuffle_partitions=32, broadcast_small=False,
                                 files_per_month=1, export_mode="single_csv"),
    "opt_soft": RunSettings(files_per_month=1, export_mode="single_csv"),
    "exp_parallel_soft": RunSettings(shuffle_partitions=96, files_per_month=8,
                                     export_mode="parallel_parts"),
}

STEP_ORDER = ("bronze", "silver_prep", "silver_join", "export", "dwh_single", "pipeline_total")
SPARK_STEPS = ("bronze", "silver_prep", "silver_join")
ALL_STEPS = ("bronze", "silver_prep", "silver_join", "export", "dwh_single")
LOAD_STEPS = ("dwh_single", "dwh_parallel")

EXPERIMENTS = {
    "v_e1": ("E1_aqe_off", "E1_aqe_on"),
    "v_e2": ("E2_broadcast_off__2021_01_t1", "E2_broadcast_on__2021_01_t1"),
    "v_e3": ("E3_sp32_mpb128", "E3_sp32_mpb256", "E3_sp128_mpb128", "E3_sp128_mpb256"),
    "v_e4": ("E4_f1", "E4_f8"),
    "v_e5": ("E5L_scsv_scopy", "E5M_pparts_merge_scopy", "E5L_pparts_pcopy"),
}

BENCH_SCHEMA = (
    "experiment_id string, run_id string, mode string, step string, year int, month int, "
    "rows_in bigint, rows_out bigint, bytes_in_mb double, bytes_out_mb double, "
    "wall_sec double, shuffle_read_mb double, shuffle_write_mb double, spark_conf string, "
    "partitions_in int, partitions_out_planned int, files_out int, files_in int, "
    "write_sec double, merge_sec double, tasks_total int, stages int, disk_spill_mb double, "
    "memory_spill_mb double, gc_time_ms bigint, executor_run_time_ms bigint, "
    "skew_factor double, wal_bytes_mb double, table_bytes_mb double, index_bytes_mb double, "
    "copy_sec_sum double, copy_sec_max double, analyze_sec double, "
    "copy_throughput_mib_s double, copy_throughput_rows_s double, details string, "
    "created_at timestamp"
)

# --- End of fixed values -----------------------------------------------------------------

TRIPS = FactSpec(
    columns=COLUMNS,
    start_ts="pickup_ts",
    end_ts="dropoff_ts",
    start_date_id="pickup_date_id",
    end_date_id="dropoff_date_id",
    distance="trip_distance",
    total="total_amount",
    passengers="passenger_count",
    flag="store_and_fwd_flag",
    flag_values=("Y", "N"),
    flag_unknown="U",
    hash_column="row_hash",
    hash_inputs=HASH_INPUTS,
    output=SILVER_COLUMNS,
    export=EXPORT_COLUMNS,
    duplicate_keys=DUPLICATE_KEYS,
)

DIMENSIONS = (ZONES, PAYMENTS, RATECODES, VENDORS, STORE_FLAGS)


def silver_rules() -> Mapping[str, SparkColumn]:
    """Row predicates whose shares the silver check reports."""
    pickup, dropoff = F.col("pickup_ts"), F.col("dropoff_ts")
    nulls = ("pickup_ts", "dropoff_ts", "pu_zone_id", "do_zone_id", "payment_type")
    return {
        **{f"null_{name}_pct": F.col(name).isNull() for name in nulls},
        "zero_distance_pct": F.col("trip_distance") <= 0,
        "zero_duration_pct": dropoff <= pickup,
        "drop_lt_pickup_pct": dropoff < pickup,
        "negative_total_pct": F.col("total_amount") < 0,
    }


def join_rules() -> Mapping[str, SparkColumn]:
    """Attributes the star join left without a value."""
    attributes = ("vendor_name", "ratecode_desc", "payment_desc", "pu_zone_name", "do_zone_name")
    return {f"unmapped_{name}_pct": F.col(name).isNull() for name in attributes}


def load_rules() -> Mapping[str, SparkColumn]:
    """Predicates checked on the loaded month of the warehouse table."""
    return {
        "null_zone_id_pct": F.col("pu_zone_id").isNull() | F.col("do_zone_id").isNull(),
        **{f"null_{name}_pct": F.col(name).isNull()
           for name in ("payment_type", "ratecode_id", "vendor_id")},
        "negative_total_pct": F.col("total_amount") < 0,
    }

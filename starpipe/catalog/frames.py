"""Operator inputs derived from the given tables, always from all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpipe import trips
from starpipe.operators.canonical import replace_columns, to_silver_rows
from starpipe.session import shared_folder
from starpipe.sinks.parquet import write_dictionary
from starpipe.sources.dictionaries import calendar_between, calendar_covering
from starpipe.sources.layers import spread_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trips(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Line items as a landing file would hold trips: text, published names, bad values.

    A line's ship date is the pickup, its quantity shifts the dropoff by minutes around it,
    and five columns of the canonical fact are missing. `spread` shares a table of few pieces out.
    """
    lines = table(spark, sf_dir, "lineitem")
    return (spread_out(lines) if spread else lines).selectExpr(
        "CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_linenumber AS STRING) END AS VendorID",
        "CASE WHEN l_linenumber = 6 AND l_linestatus = 'O' THEN 'bad' "
        "ELSE CAST(l_shipdate AS STRING) END AS tpep_pickup_datetime",
        "CAST(l_shipdate + make_dt_interval(0, 0, CAST(l_quantity AS INT) - 5) AS STRING) "
        "AS tpep_dropoff_datetime",
        "CASE WHEN l_quantity > 45 THEN '' ELSE CAST(l_quantity AS STRING) END AS passenger_count",
        "CASE WHEN l_tax > 0.07 THEN NULL ELSE CAST(l_discount AS STRING) END AS trip_distance",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE concat(CAST(l_linenumber AS STRING), '.0') END "
        "AS RatecodeID",
        "CASE l_returnflag WHEN 'A' THEN 'y' ELSE lower(l_returnflag) END AS store_and_fwd_flag",
        "CAST(l_suppkey AS STRING) AS PULocationID",
        "CASE WHEN l_tax < 0.01 THEN NULL "
        "WHEN l_linenumber = 3 THEN CAST(l_partkey + 500000000 AS STRING) "
        "ELSE CAST(l_partkey AS STRING) END AS DOLocationID",
        "CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_linenumber AS STRING) END "
        "AS Payment_Type",
        "CAST(l_extendedprice AS STRING) AS fare_amount",
        "CAST(l_tax AS STRING) AS mta_tax",
        "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - 3000 AS STRING) AS total_amount",
    )


def landing_trips(spark: SparkSession, sf_dir: str, year: int, month: int) -> DataFrame:
    """All raw trips with their pickup moved into one month, and the dropoff along with it."""
    raw = raw_trips(spark, sf_dir)
    day = F.coalesce(F.substring("tpep_dropoff_datetime", 9, 2), F.lit("01"))

    def moved(column):
        clock = F.coalesce(F.nullif(F.substring(column, 11, 9), F.lit("")), F.lit(" 00:00:00"))
        return F.concat(F.lit(f"{year}-{month:02d}-"), day, clock)

    return raw.withColumns({c: moved(c) for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})


def silver(spark: SparkSession, sf_dir: str, null_marker: str | None = None, spread: bool = False) -> DataFrame:
    return to_silver_rows(raw_trips(spark, sf_dir, spread), trips.TRIPS, null_marker)


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, so that a comparison does not depend on the reader's."""
    return replace_columns(df, {
        c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"
    })


def raw_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as zones, twice under different names."""
    once = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS LocationID", "p_brand AS Borough",
                           "p_name AS Zone", "p_type AS service_zone")
    return once.unionByName(once.withColumn("Zone", F.concat(F.lit("alias of "), "Zone")))


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS payment_type_id", "r_name AS description")


def raw_ratecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS STRING) AS RatecodeID", "n_name AS description")


def raw_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat(s_suppkey, '.0') AS vendorid", "s_name AS VendorName")


def raw_store_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "lineitem")).selectExpr(
        "concat(' ', lower(l_returnflag)) AS flag", "concat('flag ', l_returnflag) AS desc"
    ).distinct()


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_covering(table(spark, sf_dir, "orders"), "o_orderdate")


def dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "zones": raw_zones(spark, sf_dir),
        "payment_type": raw_payments(spark, sf_dir),
        "ratecode": raw_ratecodes(spark, sf_dir),
        "vendor": raw_vendors(spark, sf_dir),
        "store_flag": raw_store_flags(spark, sf_dir),
        "dim_date": raw_dates(spark, sf_dir),
    }


def known_dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Dictionaries that have every key of the trips, so that a load's foreign keys hold.

    The trips are read once for the few different codes they have, which are stored.
    """
    codes = ("payment_type", "ratecode_id", "vendor_id", "store_and_fwd_flag")
    stored = shared_folder(spark, "codes")
    write_dictionary(silver(spark, sf_dir).select(*codes).distinct(), stored)
    seen = spark.read.parquet(stored)

    def known(column, key, text):
        keys = seen.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
        return keys.withColumn(text, F.concat(F.lit(f"{key} "), key))

    zones = table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS INT) AS zone_id", "p_brand AS borough", "p_name AS zone_name")
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS INT) AS zone_id", "'' AS borough", "s_name AS zone_name")
    moved = zones.withColumn("zone_id", F.col("zone_id") + 500_000_000)  # the raw trips' unmapped keys
    return {
        "zones": zones.unionByName(moved).unionByName(suppliers),
        "payment_type": known("payment_type", "payment_type_id", "description"),
        "ratecode": known("ratecode_id", "ratecode_id", "description"),
        "vendor": known("vendor_id", "vendor_id", "vendor_name"),
        "store_flag": known("store_and_fwd_flag", "store_flag", "description"),
        "dim_date": calendar_between(spark, "2020-01-01", "2021-12-31"),
    }


def orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns({
        "year": F.year("o_orderdate"), "month": F.month("o_orderdate")})


def bench(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """Events as bench rows: the type is the step, the time of day picks the experiment."""
    names = trips.EXPERIMENTS[view]
    hours = 24 // len(names)
    events = table(spark, sf_dir, "events")
    experiment = F.element_at(F.array(*[F.lit(n) for n in names]),
                              (F.floor(F.hour("ts") / hours) + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(experiment.alias("experiment_id"), k.alias("k"), "*").selectExpr(
        "experiment_id",
        "CASE event_type WHEN 'error' THEN 'bronze' WHEN 'click' THEN 'silver_prep' "
        "WHEN 'view' THEN 'silver_join' WHEN 'signup' THEN 'export' "
        "ELSE CASE WHEN k > 50 THEN 'dwh_parallel' ELSE 'dwh_single' END END AS step",
        "year(ts) - 3 AS year", "month(ts) AS month", "value AS wall_sec",
        "k AS tasks_total", "length(event_type) AS stages",
        "value * 1.5D AS shuffle_read_mb", "value * 0.5D AS shuffle_write_mb",
        "k * 0.25D AS disk_spill_mb", "k * 0.5D AS memory_spill_mb",
        "CAST(k AS BIGINT) * 10 AS gc_time_ms",
        "CAST(round(value * 100) AS BIGINT) * 10 AS executor_run_time_ms",
        "1 + value / 100 AS skew_factor", "value / 10 AS copy_throughput_mib_s",
        "k * 100.5D AS copy_throughput_rows_s", "value * 2 AS table_bytes_mb",
        "value / 4 AS index_bytes_mb", "value * 3 AS bytes_out_mb", "k AS files_out",
        "value / 8 AS write_sec", "k / 8.0D AS merge_sec",
    )


def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metrics JSON text: known keys and two the bench table has no column for."""
    return spread_out(table(spark, sf_dir, "events")).select(F.to_json(F.struct(
        F.col("event_type").alias("step"), F.lit(2024).alias("year"), F.lit(1).alias("month"),
        F.col("event_id").alias("rows_in"), F.col("value").alias("wall_sec"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("user_id").alias("owner"),
    )).alias("record"))


def event_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as event-log lines: a task end each, a stage end per sign-up, some broken."""
    events = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long"))
    task = events.select(F.to_json(F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.struct(
            F.round(F.col("value") * 100).cast("long").alias("Executor Run Time"),
            F.col("k").alias("JVM GC Time"),
            (F.col("k") * 1000).alias("Memory Bytes Spilled"),
            (F.col("k") * 500).alias("Disk Bytes Spilled"),
            F.struct((F.col("k") * 3000).alias("Remote Bytes Read"),
                     (F.col("k") * 2000).alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
            F.struct((F.col("k") * 4000).alias("Shuffle Bytes Written"))
            .alias("Shuffle Write Metrics"),
        ).alias("Task Metrics"))).alias("value"))
    stage = events.where("event_type = 'signup'").select(F.to_json(F.struct(
        F.lit("SparkListenerStageCompleted").alias("Event"),
        F.struct(F.col("k").alias("Stage ID")).alias("Stage Info"))).alias("value"))
    broken = events.where("event_type = 'error'").select(
        F.concat(F.lit("cut off {"), F.col("event_id")).alias("value"))
    return task.unionByName(stage).unionByName(broken)


def load_log_lines(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    """Events as tasks of five stages, and the starts of two jobs: the group's has stages 1 to 3.

    A task that is an error failed; stage 1 reads nothing, so that stage 2 reads the input.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").withColumn("stage", F.pmod(k, F.lit(5)))
    task = events.select(F.to_json(F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"), F.col("stage").alias("Stage ID"),
        F.struct(F.col("event_id").alias("Task ID"), F.lit(1000).cast("long").alias("Launch Time"),
                 (F.round(F.col("value") * 100).cast("long") + 1000).alias("Finish Time"),
                 (F.col("event_type") == "error").alias("Failed")).alias("Task Info"),
        F.struct(F.struct((F.col("event_id") * 10).alias("Bytes Read"), F.when(F.col("stage") == 1, 0).otherwise(
            F.col("event_id") + 1).cast("long").alias("Records Read")).alias("Input Metrics")).alias("Task Metrics"))).alias("value"))
    mine = F.col("stage").between(1, 3)
    job = events.groupBy(mine.alias("mine")).agg(F.sort_array(F.collect_set("stage")).alias("Stage IDs")).select(F.to_json(F.struct(
        F.lit("SparkListenerJobStart").alias("Event"), "Stage IDs", F.create_map(
            F.lit("spark.jobGroup.id"), F.when(F.col("mine"), group).otherwise("another")).alias("Properties"))).alias("value"))
    return task.unionByName(job)

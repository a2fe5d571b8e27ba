"""The registered queries, by what they show."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starpipe import trips
from starpipe.catalog import frames
from starpipe.functions import casts
from starpipe.operators import canonical, compare, constraints, dims, quality
from starpipe.operators.star import Lookup, star_join
from starpipe.plans import dashboards, steps
from starpipe.session import shared_folder
from starpipe.sinks import csv as csv_sink
from starpipe.sinks import files
from starpipe.sinks import parquet as parquet_sink
from starpipe.sinks import records as record_sink
from starpipe.sinks import warehouse
from starpipe.sources import dictionaries, landing, layers
from starpipe.sources import records as record_source
from starpipe.spec import GatePolicy, Layout, RunSettings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SPEC = trips.TRIPS
MONTH = (1998, 3)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- Sources -----------------------------------------------------------------------------

@query
def csv_text_scan(spark, sf_dir):
    """Landing CSV found in the plain folder layout and read as text."""
    root = shared_folder(spark, "landing")
    year, month = MONTH
    frames.raw_trips(spark, sf_dir).write.option("header", True).csv(
        f"{root}/landing/trips/{year}/{month:02d}")
    return landing.read_landing(spark, root, "trips", year, month, f"{root}/nowhere/*.csv")


@query
def month_slice(spark, sf_dir):
    orders = frames.table(spark, sf_dir, "orders")
    return landing.month_slice(orders, "o_orderdate", *MONTH)


@query
def month_select(spark, sf_dir):
    """The first quarters of two years, listed by the calendar, of a table partitioned by month."""
    root = shared_folder(spark, "orders")
    parquet_sink.replace_months(frames.orders_by_month(spark, sf_dir), root)
    listed = landing.select_months(frames.raw_dates(spark, sf_dir), [1996, 1998], [1, 2, 3]).select("year", "month").distinct()
    picked = landing.in_listed_months(spark.read.parquet(root), listed)
    return picked.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))


@query
def new_months(spark, sf_dir):
    """Orders of months that a table landed before 2000 does not have, by its folders alone."""
    orders = frames.orders_by_month(spark, sf_dir)
    root = shared_folder(spark, "landed")
    parquet_sink.replace_months(orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")), root)
    return landing.not_landed(orders, landing.landed_months(spark, root))


@query
def new_months_by_rows(spark, sf_dir):
    """The same for a landed table that is not partitioned."""
    orders = frames.orders_by_month(spark, sf_dir)
    landed = orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return landing.new_months(orders, landed)


@query
def layer_scan(spark, sf_dir):
    """A layer written without a trial, read by a run that has one."""
    root = shared_folder(spark, "layers")
    parquet_sink.write_layer(frames.silver(spark, sf_dir, spread=True), Layout(root, "base"), "silver", *MONTH)
    rows = layers.read_layer(spark, Layout(root, "base", trial=1), "silver", *MONTH)
    return frames.zoneless(rows)


@query
def layer_without_fallback(spark, sf_dir):
    """A trial's own layer next to the shared one; a trial without one finds nothing."""
    root = shared_folder(spark, "layers")
    orders = frames.table(spark, sf_dir, "orders")
    parquet_sink.write_layer(orders, Layout(root, "base"), "silver", *MONTH)
    parquet_sink.write_layer(orders.where("o_orderstatus = 'P'"), Layout(root, "base", trial=1), "silver", *MONTH)
    own = layers.read_layer(spark, Layout(root, "base", trial=1), "silver", *MONTH, fallback=False)
    found = own.groupBy(F.lit("trial 1").alias("read")).agg(F.count(F.lit(1)).alias("rows_total"))
    try:
        other = layers.read_layer(spark, Layout(root, "base", trial=2), "silver", *MONTH, fallback=False).count()
    except FileNotFoundError:
        other = 0
    return found.unionByName(spark.createDataFrame([("trial 2", other)], "read string, rows_total long"))


@query
def dictionary_read(spark, sf_dir):
    """Four dictionaries written as CSV and read with their fixed schemas."""
    root = shared_folder(spark, "dictionaries")
    table = frames.table
    sources = {
        "vendor": table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"),
        "ratecode": table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        "payment_type": table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
        "store_flag": table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"),
    }
    out = None
    for name, df in sources.items():
        df.write.option("header", True).csv(f"{root}/{name}")
        read = dictionaries.read_dictionary(spark, name, f"{root}/{name}")
        key, text = read.columns
        part = read.select(F.lit(name).alias("dictionary"), F.col(key).cast("string").alias("key"),
                           F.col(text).alias("description"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def zones_read(spark, sf_dir):
    root = shared_folder(spark, "zones")
    frames.raw_zones(spark, sf_dir).write.option("header", True).csv(root)
    return dictionaries.read_dictionary(spark, "zones", root)


@query
def zones_with_mark(spark, sf_dir):
    """Zones whose file begins with a byte-order mark."""
    root = shared_folder(spark, "zones")
    zones = frames.raw_zones(spark, sf_dir)
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in zones.columns]
    lines = zones.select(F.lit(1).alias("at"), F.concat_ws(",", *quoted).alias("value"))
    header = "\ufeff" + ",".join(f'"{c}"' for c in zones.columns)
    whole = spark.createDataFrame([(0, header)], "at int, value string").unionByName(lines)
    whole.repartition(1).sortWithinPartitions("at").select("value").write.text(root)
    return dictionaries.read_dictionary(spark, "zones", root)


@query
def dim_date(spark, sf_dir):
    return frames.raw_dates(spark, sf_dir)


@query
def file_and_partition_stats(spark, sf_dir):
    """Orders in three partitions and three files, and the bytes of a text file of their keys."""
    root = shared_folder(spark, "files")
    orders = frames.table(spark, sf_dir, "orders")
    parquet_sink.write_parquet(orders, f"{root}/orders", files=3)
    orders.select(F.col("o_orderkey").cast("string")).write.text(f"{root}/keys")
    planned = record_source.partition_count(orders.repartition(3))
    written = record_source.file_stats(spark, f"{root}/orders", ".parquet")
    keys = record_source.file_stats(spark, f"{root}/keys", ".txt")
    return written.select("files", F.lit(planned).cast("long").alias("partitions_in"),
                          keys.select("bytes").scalar().alias("key_bytes"))


@query
def event_log_stats(spark, sf_dir):
    root = shared_folder(spark, "eventlog")
    frames.event_log_lines(spark, sf_dir).write.text(f"{root}/app-1")
    return record_source.event_log_stats(record_source.read_event_log(spark, root, "app-1"))


@query
def metrics_roundtrip(spark, sf_dir):
    """Metrics per step as JSON, read from the fallback path."""
    root = shared_folder(spark, "metrics")
    record = frames.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("wall_sec"))
    record_sink.write_metrics(record, f"{root}/fallback/steps.json")
    return record_source.read_metrics(
        spark, [f"{root}/primary/steps.json", f"{root}/fallback/steps.json"],
        "step string, rows_out bigint, wall_sec double", lines=True)


# --- Projections -------------------------------------------------------------------------

CAST_COLUMNS = ["vendor_id", "pickup_ts", "dropoff_ts", "passenger_count", "trip_distance",
                "ratecode_id", "store_and_fwd_flag", "payment_type", "pu_zone_id",
                "do_zone_id", "fare_amount", "extra", "mta_tax", "total_amount", "year"]


@query
def canonical_cast(spark, sf_dir):
    """Names matched, text cast, missing columns added; defaults not yet applied."""
    typed = canonical.canonicalize(frames.raw_trips(spark, sf_dir), SPEC)
    return frames.zoneless(typed.select(*CAST_COLUMNS, F.lit("run1").alias("load_src")))


@query
def defaults_and_flag(spark, sf_dir):
    typed = canonical.canonicalize(frames.raw_trips(spark, sf_dir), SPEC)
    return canonical.fill_defaults(typed, SPEC).select(
        "vendor_id", "ratecode_id", "payment_type", "passenger_count", "store_and_fwd_flag")


@query
def date_keys(spark, sf_dir):
    typed = canonical.canonicalize(frames.raw_trips(spark, sf_dir), SPEC)
    return canonical.add_date_keys(typed, SPEC).select(
        "pickup_date_id", "dropoff_date_id", "year", "month")


@query
def quality_flags(spark, sf_dir):
    filled = canonical.fill_defaults(
        canonical.canonicalize(frames.raw_trips(spark, sf_dir), SPEC), SPEC)
    flagged = canonical.add_quality_flags(filled, SPEC)
    return flagged.select("is_zero_distance", "is_zero_duration", "is_negative_total",
                          "is_passenger_missing")


@query
def row_hash(spark, sf_dir):
    return frames.silver(spark, sf_dir, spread=True).select("row_hash")


@query
def row_hash_marked(spark, sf_dir):
    """The form that keeps nulls in their places."""
    return frames.silver(spark, sf_dir, null_marker="\\N").select("row_hash")


@query
def silver_fact(spark, sf_dir):
    return frames.zoneless(frames.silver(spark, sf_dir, spread=True))


@query
def export_fact(spark, sf_dir):
    return canonical.to_export_rows(frames.silver(spark, sf_dir, spread=True), SPEC, "run1")


@query
def normalize_zones(spark, sf_dir):
    return dims.normalize_dim(frames.raw_zones(spark, sf_dir), trips.ZONES)


@query
def normalize_payments(spark, sf_dir):
    return dims.normalize_dim(frames.raw_payments(spark, sf_dir), trips.PAYMENTS)


@query
def normalize_ratecodes(spark, sf_dir):
    return dims.normalize_dim(frames.raw_ratecodes(spark, sf_dir), trips.RATECODES)


@query
def normalize_vendors(spark, sf_dir):
    return dims.normalize_dim(frames.raw_vendors(spark, sf_dir), trips.VENDORS)


@query
def normalize_store_flags(spark, sf_dir):
    return dims.normalize_dim(frames.raw_store_flags(spark, sf_dir), trips.STORE_FLAGS)


@query
def normalize_dates(spark, sf_dir):
    """Order days given as year, month and day only; repeated for every order of a day."""
    parts = frames.table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.dayofmonth("o_orderdate").alias("day"))
    return dims.normalize_dim_date(parts)


@query
def surrogate_key(spark, sf_dir):
    stamped = warehouse.stamp(frames.orders_by_month(spark, sf_dir))
    return stamped.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_distinct("trip_id").alias("distinct_keys"),
        F.count_if(F.col("load_dt").isNull()).alias("rows_without_load_time"))


@query
def details_json(spark, sf_dir):
    """Known metrics as columns, the rest as JSON."""
    split = record_sink.split_details(frames.metric_records(spark, sf_dir))
    return split.select("step", "rows_in", "wall_sec", "rows_out", "details")


# --- Joins and constraints ---------------------------------------------------------------

@query
def star_join_broadcast(spark, sf_dir):
    return frames.zoneless(steps.wide_rows(frames.silver(spark, sf_dir, spread=True), frames.dictionaries(spark, sf_dir)))


@query
def star_join_merge(spark, sf_dir):
    """Stored first, as the keys of the fact are read before the join; of a large fact only the wide rows stay."""
    root, wide = shared_folder(spark, "silver"), shared_folder(spark, "wide")
    silver = _stored_silver(spark, sf_dir, root, "zstd")
    rows = steps.stored_wide_rows(silver, frames.dictionaries(spark, sf_dir), "merge", wide)
    if files.folder_names(spark, wide):
        files.remove_folder(spark, root)
    return frames.zoneless(rows)


def _stored_silver(spark, sf_dir, root=None, codec="snappy"):
    layout = Layout(root or shared_folder(spark, "silver"), "base")
    parquet_sink.write_layer(frames.silver(spark, sf_dir, spread=True), layout, "silver", *MONTH, codec=codec)
    return layers.read_layer(spark, layout, "silver", *MONTH)


def _headers(spark, sf_dir, strategy):
    """Line items with their order, its customer, the part and the supplier."""
    def table(name):
        return frames.table(spark, sf_dir, name)

    nation = table("nation")
    customer = star_join(table("customer"), [
        Lookup(nation, "c_nationkey", "n_nationkey", {"n_name": "customer_nation"})], strategy)
    orders = star_join(table("orders"), [Lookup(customer, "o_custkey", "c_custkey", {
        "c_name": "c_name", "c_mktsegment": "c_mktsegment",
        "customer_nation": "customer_nation"})], strategy)
    supplier = star_join(table("supplier"), [
        Lookup(nation, "s_nationkey", "n_nationkey", {"n_name": "supplier_nation"})], strategy)
    fact = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    "l_extendedprice", "l_shipdate")
    return star_join(fact, [
        Lookup(orders, "l_orderkey", "o_orderkey", {
            "o_orderdate": "o_orderdate", "o_orderstatus": "o_orderstatus", "c_name": "c_name",
            "c_mktsegment": "c_mktsegment", "customer_nation": "customer_nation"}),
        Lookup(table("part"), "l_partkey", "p_partkey", {"p_name": "p_name", "p_brand": "p_brand"}),
        Lookup(supplier, "l_suppkey", "s_suppkey", {
            "s_name": "s_name", "supplier_nation": "supplier_nation"}),
    ], strategy)


@query
def order_lines(spark, sf_dir):
    return _headers(spark, sf_dir, "auto")


@query
def order_lines_merge(spark, sf_dir):
    return _headers(spark, sf_dir, "merge")


@query
def fk_violations(spark, sf_dir):
    raw = frames.dictionaries(spark, sf_dir)
    keys = [constraints.ForeignKey(x.on, x.dim, x.key) for x in steps.trip_lookups(raw)
            if x.on != SPEC.flag]
    return constraints.foreign_key_violations(frames.silver(spark, sf_dir, spread=True), keys)


@query
def fk_large_dimensions(spark, sf_dir):
    """A dense dimension, a sparse one beyond the bound of its bitmap, and one of texts."""
    orders = frames.table(spark, sf_dir, "orders")
    filled = orders.where("o_orderstatus <> 'P'").select(
        "o_orderkey", (F.col("o_orderkey") * 1_000_003).alias("sparse"), F.concat(F.lit("o"), "o_orderkey").alias("name"))
    lines = frames.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_orderkey") * 1_000_003).alias("sparse"), F.concat(F.lit("o"), "l_orderkey").alias("name"))
    return constraints.foreign_key_violations(lines, [
        constraints.ForeignKey("l_orderkey", filled, "o_orderkey"), constraints.ForeignKey("sparse", filled, "sparse"),
        constraints.ForeignKey("name", filled, "name")], bitmap_words=orders.count() // 16)


@query
def pk_violations(spark, sf_dir):
    def table(name):
        return frames.table(spark, sf_dir, name)

    zones = dims.conform_dim(frames.raw_zones(spark, sf_dir), trips.ZONES)
    return constraints.primary_key_violations([
        ("orders", table("orders"), "o_orderkey"),
        ("customer", table("customer"), "c_custkey"),
        ("supplier", table("supplier"), "s_suppkey"),
        ("lines by order", table("lineitem"), "l_orderkey"),
        ("zones", zones, "zone_id"),
        ("dates", frames.raw_dates(spark, sf_dir), "date_id"),
    ])


@query
def month_and_flag_guard(spark, sf_dir):
    """Rows a load of one month would be rejected for."""
    raw = canonical.canonicalize(frames.raw_trips(spark, sf_dir), SPEC)
    keyed = canonical.add_date_keys(raw, SPEC)
    upper = keyed.withColumn("flag", F.upper(SPEC.flag))
    return constraints.month_violations(upper, *MONTH, "flag", ("Y", "N", "U"))


# --- Quality -----------------------------------------------------------------------------

@query
def dq_rules(spark, sf_dir):
    return quality.rule_percentages(frames.silver(spark, sf_dir, spread=True), trips.silver_rules())


@query
def dq_silver(spark, sf_dir):
    """Of the stored layer: shares and duplicates are passes of their own."""
    return steps.silver_quality(_stored_silver(spark, sf_dir))


@query
def duplicate_pct(spark, sf_dir):
    """Line keys, which really repeat."""
    lines = frames.table(spark, sf_dir, "lineitem")
    return quality.duplicate_percentage(lines, ["l_orderkey", "l_linenumber", "not_there"])


@query
def dq_unmapped(spark, sf_dir):
    wide = steps.wide_rows(frames.silver(spark, sf_dir, spread=True), frames.dictionaries(spark, sf_dir))
    return steps.join_quality(wide)


@query
def dq_load(spark, sf_dir):
    """The fact as if rows without a pickup time had been lost on the way: the counts differ by them."""
    exported = frames.table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n")).scalar()
    fact = frames.silver(spark, sf_dir, spread=True).where(F.col("pickup_ts").isNotNull())
    return steps.load_quality(fact, exported)


@query
def rowcount_mismatch(spark, sf_dir):
    orders = frames.table(spark, sf_dir, "orders")
    return quality.rowcount_mismatch(orders, orders.where("o_orderstatus <> 'P'"))


def _evaluated(spark, sf_dir):
    metrics = steps.silver_quality(_stored_silver(spark, sf_dir))
    rules = list(trips.GATE.limits["dq_silver"])
    return quality.evaluate(quality.as_rules(metrics, rules), "dq_silver", trips.GATE)


@query
def dq_evaluate(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query
def dq_failing(spark, sf_dir):
    """The rules the gate would stop the run for."""
    return quality.failing(_evaluated(spark, sf_dir), trips.GATE).select(
        "step", "rule", "value_num", "threshold")


@query
def dq_summary(spark, sf_dir):
    """Results of each order month: one rule per status of the order."""
    orders = frames.orders_by_month(spark, sf_dir)
    results = orders.select(
        F.col("o_orderstatus").alias("experiment_id"), F.col("o_orderpriority").alias("step"),
        "year", "month", F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_totalprice") > 300000, "FAIL").when(F.col("o_totalprice") > 200000, "WARN")
        .otherwise("OK").alias("status"))
    return quality.summarize(results)


@query
def quality_append(spark, sf_dir):
    """Rule results of two checks appended to one table."""
    path = shared_folder(spark, "dq_results")
    silver = frames.silver(spark, sf_dir, spread=True)
    for step, metrics in (
        ("dq_silver", quality.rule_percentages(silver, trips.silver_rules())),
        ("dq_dwh", quality.rule_percentages(silver, trips.load_rules())),
    ):
        rules = [c for c in metrics.columns if c != "rows_total"]
        evaluated = quality.evaluate(quality.as_rules(metrics, rules), step, trips.GATE)
        record_sink.append_rows(record_sink.quality_rows(
            evaluated, "exp1", "run1", *MONTH, {"source": "table"}), path)
    return spark.read.parquet(path).drop("created_at")


# --- Sinks -------------------------------------------------------------------------------

def _csv_roundtrip(spark, sf_dir, mode):
    """Export and read back; parts follow the tasks, a single or merged file is joined of them."""
    root = shared_folder(spark, "export")
    rows = canonical.to_export_rows(frames.silver(spark, sf_dir, spread=True), SPEC, "run1")
    done = csv_sink.export_csv(rows, root, csv_sink.export_name("fact_trips", *MONTH), mode)
    return frames.zoneless(steps.read_export(spark, done.folder, SPEC))


@query
def csv_single_roundtrip(spark, sf_dir):
    return _csv_roundtrip(spark, sf_dir, "single_csv")


@query
def csv_parts_roundtrip(spark, sf_dir):
    return _csv_roundtrip(spark, sf_dir, "parallel_parts")


@query
def csv_merge_roundtrip(spark, sf_dir):
    return _csv_roundtrip(spark, sf_dir, "parallel_write_then_merge")


@query
def parquet_sorted_files(spark, sf_dir):
    """Orders written with another codec, each file sorted by date, and read back."""
    root = shared_folder(spark, "sorted")
    parquet_sink.write_parquet(frames.table(spark, sf_dir, "orders"), root, codec="zstd",
                               sort_by=("o_orderdate",))
    return spark.read.parquet(root)


@query
def fact_in_order(spark, sf_dir):
    """All trips in the order of pickup and distance, over files and within them."""
    root = shared_folder(spark, "ordered")
    silver = frames.silver(spark, sf_dir, spread=True)
    parquet_sink.write_ordered(silver, root, ("pickup_ts", "trip_distance"), files=6, group_rows=10_000)
    return parquet_sink.order_breaks(spark, root, ("pickup_ts", "trip_distance"))


def _raised(spark, sf_dir):
    """One month's orders with a higher price."""
    orders = frames.orders_by_month(spark, sf_dir)
    month = orders.where((F.col("year") == MONTH[0]) & (F.col("month") == MONTH[1]))
    return month.withColumn("o_totalprice", F.col("o_totalprice") + 1000000)


@query
def month_replace(spark, sf_dir):
    """All months written, one replaced twice, the table read back."""
    root = shared_folder(spark, "orders")
    parquet_sink.replace_months(frames.orders_by_month(spark, sf_dir), root)
    for _ in range(2):
        parquet_sink.replace_months(_raised(spark, sf_dir), root)
    return spark.read.parquet(root)


def _detached(df, *tables):
    """The rows as files of their own, after which the tables leave the catalogue."""
    path = shared_folder(df.sparkSession, "detached")
    df.write.parquet(path)
    for table in tables:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _months_of_orders(spark, sf_dir):
    """A month table with all orders."""
    root = shared_folder(spark, "fact")
    orders = warehouse.stamp(frames.orders_by_month(spark, sf_dir))
    table = warehouse.open_months(spark, "fact_" + root.rsplit("-", 1)[1], root, orders.schema)
    table.replace_months(orders)
    return table


def _loaded(spark, sf_dir):
    table = _months_of_orders(spark, sf_dir)
    customers = frames.table(spark, sf_dir, "customer")
    warehouse.load_month(
        _raised(spark, sf_dir), table, *MONTH, flag="o_orderstatus", allowed=("F", "O", "P"),
        foreign_keys=[constraints.ForeignKey("o_custkey", customers, "c_custkey")])
    return table


@query
def load_month(spark, sf_dir):
    table = _loaded(spark, sf_dir)
    return _detached(table.read().drop("trip_id", "load_dt"), table.name)


@query
def load_interrupted(spark, sf_dir):
    """All months after a load whose last write died with half of its rows written."""
    table = _loaded(spark, sf_dir)
    odd = F.col("o_orderkey") % 2 == 1
    halves = warehouse.stamp(_raised(spark, sf_dir).withColumn("o_totalprice", F.col("o_totalprice") + 5)).repartition(2, odd)
    with suppress(Exception):
        table.replace(halves.withColumn("o_orderpriority", F.when(odd, F.raise_error(F.lit("killed")))
                                        .otherwise(F.col("o_orderpriority"))), *MONTH)
    return _detached(table.read().drop("trip_id", "load_dt"), table.name)


@query
def load_month_staged(spark, sf_dir):
    table = _loaded(spark, sf_dir)
    return _detached(table.read(), table.name).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_distinct("trip_id").alias("distinct_keys"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))


def _registered(spark, root):
    name = "t_" + root.rsplit("-", 1)[1]
    warehouse.register(spark, name, root)
    return name


@query
def table_month_scan(spark, sf_dir):
    """One month of a catalogue table partitioned by month."""
    root = shared_folder(spark, "orders")
    parquet_sink.replace_months(frames.orders_by_month(spark, sf_dir), root)
    name = _registered(spark, root)
    return _detached(layers.month_of_table(spark, name, *MONTH), name)


@query
def table_statistics(spark, sf_dir):
    """What the catalogue knows after an analysis: rows of the table and of one month, and of columns."""
    root = shared_folder(spark, "orders")
    parquet_sink.replace_months(frames.orders_by_month(spark, sf_dir), root)
    name = _registered(spark, root)
    warehouse.analyze(spark, name, *MONTH)
    columns = ("o_orderstatus", "o_orderpriority", "o_totalprice")
    warehouse.analyze(spark, name, columns=columns)

    def known(scope, statement):
        return spark.sql(statement).where(
            F.col("col_name").isin("Statistics", "Partition Statistics")
        ).select(F.lit(scope).alias("scope"),
                 F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long").alias("rows_total"))

    part = f"PARTITION (year={MONTH[0]}, month={MONTH[1]})"
    rows = known("table", f"DESCRIBE EXTENDED {name}").unionByName(
        known("month", f"DESCRIBE EXTENDED {name} {part}"))
    stats = warehouse.column_statistics(spark, name, columns)
    few = F.when(F.col("column") != "o_totalprice", F.col("distinct_values"))  # many are only estimated
    return _detached(rows.select("scope", "rows_total", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("nulls", "long"), ("distinct_values", "long"), ("low", "double"), ("high", "double"), ("histogram", "boolean"))]).unionByName(
        stats.select(F.col("column").alias("scope"), F.lit(None).cast("long").alias("rows_total"), "nulls", few.alias("distinct_values"),
                     F.col("min").try_cast("double").alias("low"), F.col("max").try_cast("double").alias("high"),
                     (F.col("bins") > 1).alias("histogram"))), name)


@query
def dimension_refresh(spark, sf_dir):
    """A dimension table loaded twice; the second load replaces the first."""
    name = "dim_" + shared_folder(spark, "x").rsplit("-", 1)[1]
    zones = dims.normalize_dim(frames.raw_zones(spark, sf_dir), trips.ZONES)
    path = shared_folder(spark, name)
    parquet_sink.write_dictionary(zones, path)
    spark.catalog.createTable(name, path=path, source="parquet")
    warehouse.refresh_dimension(zones.withColumn("borough", F.upper("borough")), name, path)
    return _detached(spark.table(name), name)


@query
def bench_append(spark, sf_dir):
    """Metrics records appended to the bench table in two runs."""
    path = shared_folder(spark, "bench")
    records = frames.metric_records(spark, sf_dir)
    for run in ("run1", "run2"):
        record_sink.append_rows(record_sink.bench_rows(records, "exp1", run), path)
    return spark.read.parquet(path).select(
        "experiment_id", "run_id", "mode", "step", "year", "month", "rows_in", "wall_sec",
        "skew_factor", "details")


@query
def run_report(spark, sf_dir):
    """Step rows and rule rows of one run, as text."""
    path = shared_folder(spark, "bench")
    records = frames.metric_records(spark, sf_dir)
    record_sink.append_rows(record_sink.bench_rows(records, "exp1", "run1"), path)
    bench = record_sink.one_run(spark.read.parquet(path), "exp1", "run1", 2024, 1)
    blank = F.lit("")
    steps_part = record_sink.bench_report(bench).select(
        F.lit("steps").alias("part"), "step", blank.alias("name"), "rows_in", "rows_out", "bytes_in_mb",
        "bytes_out_mb", F.col("wall_sec").alias("value"), blank.alias("threshold"), blank.alias("status"))
    rows = record_sink.quality_rows(_evaluated(spark, sf_dir), "exp1", "run1", 2024, 1)
    rules_part = record_sink.quality_report(
        record_sink.one_run(rows, "exp1", "run1", 2024, 1)
    ).select(F.lit("rules").alias("part"), "step", F.col("rule").alias("name"), blank.alias("rows_in"),
             blank.alias("rows_out"), blank.alias("bytes_in_mb"), blank.alias("bytes_out_mb"), "value",
             "threshold", "status")
    return steps_part.unionByName(rules_part)


@query
def reports_in_order(spark, sf_dir):
    """Row order of the sorted reports: places of rules by step and rule, of steps by step."""
    path = shared_folder(spark, "bench")
    record_sink.append_rows(record_sink.bench_rows(frames.metric_records(spark, sf_dir), "exp1", "run1"), path)
    rules = record_sink.quality_report(record_sink.quality_rows(_evaluated(spark, sf_dir), "exp1", "run1", 2024, 1))
    walls = record_sink.bench_report(spark.read.parquet(path))

    def placed(report, name, *columns):
        at = shared_folder(spark, name)
        parquet_sink.write_parquet(report.select(*columns), at)
        return parquet_sink.in_places(spark, at, "place").select(
            F.lit(name).alias("report"), F.col("place").cast("int").alias("place"), F.concat_ws(".", *columns).alias("row"))

    return placed(rules, "rules", "step", "rule").unionByName(placed(walls, "steps", "step"))


@query
def load_part_times(spark, sf_dir):
    """Parts of a load by its event log: their number, their seconds in sum and at most, rows read."""
    root = shared_folder(spark, "eventlog")
    frames.load_log_lines(spark, sf_dir, "load run1").write.text(f"{root}/app-1")
    events = record_source.read_event_log(spark, root, "app-1")
    return record_source.part_totals(record_source.part_times(events, "load run1"))


@query
def load_throughput(spark, sf_dir):
    """Bytes and rows per second of each month's load, and its slowest and total part.

    The parts are the priorities; the wall time of the whole load is that of all its months' rows.
    """
    orders = frames.orders_by_month(spark, sf_dir)
    parts = orders.groupBy("year", "month", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("mib"),
        F.count_if(F.col("o_orderstatus") == "P").alias("sec"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    whole = parts.withColumn("wall", F.sum("filled").over(Window.partitionBy("year", "month")))
    return compare.load_rates(whole, ["year", "month"], rows="n", mib="mib", seconds="sec", wall="wall")


@query
def text_casts(spark, sf_dir):
    """Fractions without a leading digit, with a sign and blanks, cut off to integers."""
    lines = frames.table(spark, sf_dir, "lineitem")
    tax = F.substring(F.col("l_tax").cast("string"), 2, 9)
    text = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(" "), tax)
    return lines.select("l_orderkey", "l_linenumber", casts.text_to_int(text).alias("tax"),
                        casts.text_to_int(F.col("l_quantity").cast("string")).alias("quantity"),
                        casts.text_to_int(F.col("l_returnflag")).alias("flag"))


@query
def normalize_dates_from_date(spark, sf_dir):
    """Order days with a weekday that counts from Sunday and a week of another kind."""
    days = frames.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.dayofweek("o_orderdate").alias("day_of_week"),
        F.lit(60).alias("week_of_year"))
    return dims.normalize_dim_date(days)


@query
def fk_two_dimensions(spark, sf_dir):
    """Three keys, two of them on one column."""
    def key(column, name, dim, dim_key):
        return constraints.ForeignKey(column, frames.table(spark, sf_dir, dim), dim_key, name)

    return constraints.foreign_key_violations(frames.table(spark, sf_dir, "lineitem"), [
        key("l_partkey", "part of a line", "part", "p_partkey"),
        key("l_partkey", "part as a customer", "customer", "c_custkey"),
        key("l_suppkey", "supplier of a line", "supplier", "s_suppkey")])


@query
def load_empty_month(spark, sf_dir):
    """All months of orders, one of them loaded again without rows."""
    table = _months_of_orders(spark, sf_dir)
    orders = frames.orders_by_month(spark, sf_dir)
    warehouse.load_month(orders.where("false"), table, *MONTH, flag="o_orderstatus", allowed=("F", "O", "P"))
    return _detached(table.read().drop("trip_id", "load_dt"), table.name)


@query
def gate_rerun(spark, sf_dir):
    """A check that stops its run and the repaired one of the same run id, as stored."""
    policy = GatePolicy({"dq_orders": {"pending_pct": 0.5}}, ("dq_orders",))
    run = steps.Run(spark, Layout(shared_folder(spark, "gate"), "exp1"), *MONTH, policy=policy)
    orders = frames.table(spark, sf_dir, "orders")
    for rows in (orders, orders.where("o_orderstatus <> 'P'")):
        share = rows.agg(F.round(100.0 * F.count_if(F.col("o_orderstatus") == "P") / F.count(F.lit(1)), 6).alias("pending_pct"))
        with suppress(quality.QualityGateError):
            steps.check(run, "dq_orders", share, ["pending_pct"])
    return spark.read.parquet(run.table("dq_results")).drop("created_at")


@query
def event_log_two_applications(spark, sf_dir):
    """The log of one application next to that of another whose name begins the same."""
    root = shared_folder(spark, "eventlog")
    lines = frames.event_log_lines(spark, sf_dir)
    lines.write.text(f"{root}/app-1")
    lines.write.text(f"{root}/app-10")
    return record_source.event_log_stats(record_source.read_event_log(spark, root, "app-1"))


# --- The monthly steps ------------------------------------------------------------------

TRIP_MONTH = (2021, 1)


def _pipeline(spark, sf_dir, *names, root=None, experiment="exp1", aqe=True, after=lambda run, name: None):
    """A run over all line items as trips of one month, up to the named steps.

    `after` sees the run when a step has ended. The rows that neither it nor a later step reads then
    go: only the last step's stay.
    """
    layout = Layout(root or shared_folder(spark, "pipe"), experiment, trial=1)
    frames.landing_trips(spark, sf_dir, *TRIP_MONTH).write.mode("overwrite").option("header", True).csv(
        f"{layout.root}/landing/trips/year={TRIP_MONTH[0]}/month={TRIP_MONTH[1]}")
    # Most of a row is the hexadecimal text of its hash, which snappy leaves as it is. Where that is written
    # once, its bytes are few and the time of a stronger codec counts more.
    codec = "zstd" if len(names) > 2 else "snappy"
    run = steps.Run(spark, layout, *TRIP_MONTH, policy=GatePolicy(trips.GATE.limits, ()), settings=RunSettings(
        aqe=aqe, codec=codec, export_compression="gzip", shuffle_partitions=int(spark.conf.get("spark.sql.shuffle.partitions"))))
    actions = {
        "bronze": lambda: steps.to_bronze(run, "trips"), "silver": lambda: steps.to_silver(run),
        "wide": lambda: steps.to_wide(run), "export": lambda: steps.to_export(run)[1]}
    reads = {"bronze": "landing", "silver": "bronze", "wide": "silver", "export": "silver"}
    rows = {"landing": f"{layout.root}/landing", "bronze": run.path("bronze"), "silver": run.path("silver"),
            "wide": run.path("silver_wide")}
    if "wide" in names:
        for name, dim in frames.dictionaries(spark, sf_dir).items():
            parquet_sink.write_dictionary(dim, layout.dictionary(name))
    for n, name in enumerate(names):
        done = actions[name]()
        after(run, name)
        for old in ("landing", *names[:n + 1]):
            if old in rows and old != names[-1] and old not in [reads[x] for x in names[n + 1:]]:
                files.remove_folder(spark, rows.pop(old))
    return run, done


@query
def pipe_bronze(spark, sf_dir):
    run, _ = _pipeline(spark, sf_dir, "bronze")
    return run.layer("bronze")


@query
def pipe_silver(spark, sf_dir):
    run, _ = _pipeline(spark, sf_dir, "bronze", "silver")
    return frames.zoneless(run.layer("silver"))


@query
def pipe_wide(spark, sf_dir):
    run, _ = _pipeline(spark, sf_dir, "bronze", "silver", "wide")
    return frames.zoneless(run.layer("silver_wide"))


@query
def pipe_load(spark, sf_dir):
    """Export and load of the month with all its foreign keys: the warehouse fact, without its stamps."""
    run, export = _pipeline(spark, sf_dir, "bronze", "silver", "export")
    steps.load(run, export, frames.known_dictionaries(spark, sf_dir))
    fact = run.fact()
    rows = fact.snapshot(*TRIP_MONTH)
    fact.drop()
    return frames.zoneless(rows.drop("trip_id", "load_dt"))


@query
def pipe_load_unknown_key(spark, sf_dir):
    """A load with a zone the dimension lacks: refused, so the month loaded before is still there."""
    run, export = _pipeline(spark, sf_dir, "bronze", "silver", "export")
    dims = frames.known_dictionaries(spark, sf_dir)
    steps.load(run, export, dims)
    refused = ""
    try:
        steps.load(run, export, {**dims, "zones": dims["zones"].where("zone_id < 500000000")})
    except constraints.LoadRejected as problem:
        refused = str(problem)
    fact = run.fact()
    left = fact.read().agg(F.count(F.lit(1)).alias("rows_left"), F.lit(refused.split("=")[0]).alias("refused"),
                           F.lit(int(refused.split("=")[1])).cast("long").alias("rows_refused"))
    return _detached(left, fact.name)


@query
def pipe_quality(spark, sf_dir):
    """The checks of the silver layer, as stored."""
    run, _ = _pipeline(spark, sf_dir, "bronze", "silver")
    steps.check(run, "dq_silver", steps.silver_quality(run.layer("silver")), list(trips.GATE.limits["dq_silver"]))
    return spark.read.parquet(run.table("dq_results")).select("step", "rule", "value_num", "threshold", "status")


@query
def pipe_gates(spark, sf_dir):
    """The three checks of a run with the gates on: what each stored before the run went on or stopped.

    Each layer is checked as soon as it stands, so that only what a later step reads stays on disk.
    """
    stopped = []

    def judge(run, step, metrics):
        try:
            steps.check(replace(run, policy=trips.GATE), step, metrics, list(trips.GATE.limits[step]))
        except quality.QualityGateError:
            stopped.append(step)

    def after(run, name):
        if name == "silver":
            judge(run, "dq_silver", steps.silver_quality(run.layer("silver")))
        if name == "wide":
            judge(run, "dq_join", steps.join_quality(run.layer("silver_wide")))

    run, export = _pipeline(spark, sf_dir, "bronze", "silver", "wide", "export", after=after)
    steps.load(run, export, frames.known_dictionaries(spark, sf_dir))
    fact = run.fact()
    exported = spark.read.option("header", True).csv(export.folder).agg(F.count(F.lit(1)).alias("n")).scalar()
    judge(run, "dq_dwh", steps.load_quality(fact.read(), exported))
    results = spark.read.parquet(run.table("dq_results"))
    out = _detached(results.select("step", "rule", "value_num", "threshold", "status",
                                   F.col("step").isin(*stopped).alias("stopped")), fact.name)
    for folder in (export.folder, fact.root):
        files.remove_folder(spark, folder)
    return out


@query
def pipe_bench(spark, sf_dir):
    """What the steps of a run recorded of themselves in the bench table."""
    run, export = _pipeline(spark, sf_dir, "bronze", "silver", "export")
    steps.load(run, export)
    run.fact().drop()
    read = files.files_mib(spark, export.folder, export.files)
    rated = F.abs(F.col("copy_throughput_mib_s") * F.col("wall_sec") - read) < 0.001
    return steps.bench_results(run).select(
        "experiment_id", "run_id", "mode", F.regexp_replace("step", "^dwh_.*", "dwh_").alias("step"), "year",
        "month", "rows_in", "rows_out", (F.col("wall_sec") > 0).alias("timed"), (F.col("bytes_out_mb") > 0).alias("sized"),
        rated.alias("rate_of_files_read"))


@query
def pipe_reports(spark, sf_dir):
    """Two runs of the steps as the two experiments of a report, and the report over their bench table."""
    off, on = trips.EXPERIMENTS["v_e1"]
    root = shared_folder(spark, "pipe")
    for name, adaptive in ((off, False), (on, True)):
        run, export = _pipeline(spark, sf_dir, "bronze", "silver", "wide", "export", root=root, experiment=name, aqe=adaptive)
        steps.load(run, export, frames.known_dictionaries(spark, sf_dir))
        run.fact().drop()
        for folder in (export.folder, run.table("fact_trips")):  # the report reads the bench table alone
            files.remove_folder(spark, folder)
    bench = spark.read.parquet(run.table("bench_results"))
    rows = bench.withColumn("step", F.regexp_replace("step", "^dwh_parallel", "dwh_single"))
    report = dashboards.e1_steps(rows)
    return report.select("step", (F.col("off_sec") > 0).alias("off_timed"), (F.col("on_sec") > 0).alias("on_timed"),
                         (F.abs(F.col("on_sec") - F.col("off_sec") - F.col("delta_sec")) < 0.01).alias("difference"))


@query
def pipe_dims(spark, sf_dir):
    """Dictionaries from CSV as Parquet and as dimension tables, rows of each."""
    layout = Layout(shared_folder(spark, "dims"), "exp1")
    database = "d_" + layout.root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{layout.root}/tables'")
    try:
        named = {
            "vendor": frames.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"),
            "ratecode": frames.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
            "payment_type": frames.table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
            "store_flag": frames.table(spark, sf_dir, "orders").select("o_orderstatus", F.lower("o_orderstatus")).distinct(),
            "zones": frames.raw_zones(spark, sf_dir).where("NOT startswith(Zone, 'alias of ')"),
        }
        for name, table in named.items():
            table.write.option("header", True).csv(f"{layout.root}/csv/{name}")
        steps.init_dimensions(spark, layout, {n: f"{layout.root}/csv/{n}" for n in named}, database=database)
        counts = [spark.table(f"{database}.{n}").select(F.lit(n).alias("dimension")) for n in (*named, "dim_date")]
        out = reduce(DataFrame.unionByName, counts).groupBy("dimension").agg(F.count(F.lit(1)).alias("rows_total"))
        return spark.createDataFrame(out.collect(), out.schema)  # four rows; the tables go
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


# --- Reports -----------------------------------------------------------------------------

def _report(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    view = "v_" + name.split("_", 1)[0]

    def run(spark, sf_dir):
        return build(frames.bench(spark, sf_dir, view))

    run.__name__ = f"report_{name}"
    query(run)


for _name, _build in dashboards.REPORTS.items():
    _report(_name, _build)


@query
def report_views(spark, sf_dir):
    """Rows and experiments behind each named view."""
    out = None
    for view in trips.EXPERIMENTS:
        dashboards.create_views(frames.bench(spark, sf_dir, view))
        part = spark.table(view).agg(
            F.lit(view).alias("view"), F.count(F.lit(1)).alias("rows_total"),
            F.count_distinct("experiment_id").alias("experiments"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def report_order(spark, sf_dir):
    """Places of steps in the report order, unknown steps last, and of rates, blanks last."""
    bench = frames.bench(spark, sf_dir, "v_e5")
    walls = compare.step_table(bench, [*trips.ALL_STEPS, *trips.LOAD_STEPS])
    ordered = compare.with_position(
        walls, compare.step_order(trips.STEP_ORDER, "step", "experiment_id"))
    rate = F.nullif(F.col("wall_sec"), F.lit(0.0))
    down = Window.orderBy(rate.desc_nulls_last(), "experiment_id", "step")
    return ordered.select("experiment_id", "step", "position",
                          F.row_number().over(down).alias("position_by_wall"))

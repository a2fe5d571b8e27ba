"""The monthly steps: bronze, silver, wide, export, load, and the quality checks between.

Each step reads the layer before it, writes one month of its own layer and returns a record
of what it did. Row counts are taken from the write itself through an observation, not by
running the plan again.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field, replace
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starpipe import trips
from starpipe.functions.casts import flag_text, tolerant_cast
from starpipe.operators import quality
from starpipe.operators.canonical import replace_columns, to_export_rows, to_silver_rows
from starpipe.operators.constraints import ForeignKey, primary_key_violations
from starpipe.operators.dims import conform_dim, conform_dim_date
from starpipe.operators.star import Lookup, plan_star_join, star_join
from starpipe.session import applied
from starpipe.sinks.csv import Export, export_csv, export_name
from starpipe.sinks.files import files_mib, folder_mib, part_files
from starpipe.sinks.parquet import write_dictionary, write_in_turn, write_layer, write_layer_in_turn
from starpipe.sinks.records import append_rows, bench_rows, one_run, quality_rows
from starpipe.sinks.warehouse import (
    LoadReport, MonthTable, analyze, load_month, open_months, refresh_dimension, stamped_schema,
)
from starpipe.sources.dictionaries import calendar_between, read_dictionary
from starpipe.sources.landing import read_csv_text, read_landing
from starpipe.sources.layers import in_parts, read_dictionaries, read_layer, spread_out
from starpipe.sources.records import event_log_stats, part_times, part_totals, partition_count, read_event_log
from starpipe.spec import FactSpec, GatePolicy, Layout, RunSettings

DICTIONARIES = ("zones", "payment_type", "ratecode", "vendor", "store_flag", "dim_date")


@dataclass(frozen=True)
class StepRecord:
    """Metrics of one step, named as the columns of the bench table; others become details."""

    step: str
    year: int
    month: int
    rows_in: int | None = None
    rows_out: int | None = None
    wall_sec: float | None = None
    details: Mapping[str, object] = field(default_factory=dict)

    def as_json(self) -> str:
        return json.dumps({"step": self.step, "year": self.year, "month": self.month,
                           "rows_in": self.rows_in, "rows_out": self.rows_out,
                           "wall_sec": self.wall_sec, **self.details})


@dataclass(frozen=True)
class Run:
    """One experiment run over one month."""

    spark: SparkSession
    layout: Layout
    year: int
    month: int
    settings: RunSettings = RunSettings()
    spec: FactSpec = trips.TRIPS
    policy: GatePolicy = trips.GATE
    run_id: str = "manual"
    mode: str = "optimized"
    event_log_dir: str | None = None

    def layer(self, name: str) -> DataFrame:
        return read_layer(self.spark, self.layout, name, self.year, self.month)

    def table(self, name: str) -> str:
        return f"{self.layout.root.rstrip('/')}/warehouse/{name}"

    def fact(self, schema: StructType | None = None) -> MonthTable:
        """The warehouse fact in the catalogue; `schema` is needed when it may not exist yet."""
        root = self.table("fact_trips")
        name = f"fact_trips_{zlib.crc32(root.encode()):08x}"
        return MonthTable(self.spark, name, root) if schema is None else open_months(self.spark, name, root, schema)

    def path(self, layer: str) -> str:
        return self.layout.month(layer, self.year, self.month)


def record_step(run: Run, done: StepRecord) -> StepRecord:
    """Write a step's metrics next to its layers and append them to the bench table.

    With an event log folder the statistics of the application so far come along.
    """
    extra = {}
    if run.event_log_dir:
        events = read_event_log(run.spark, run.event_log_dir, run.spark.sparkContext.applicationId)
        extra = event_log_stats(events).first().asDict()
    whole = replace(done, details={**done.details, **extra})
    text = run.spark.createDataFrame([(whole.as_json(),)], "record string")
    text.write.mode("overwrite").text(f"{run.path('metrics')}/{done.step}.json")
    append_rows(bench_rows(text, run.layout.experiment, run.run_id, run.mode), run.table("bench_results"))
    return whole


def bench_results(run: Run) -> DataFrame:
    """The bench rows of this run."""
    return one_run(run.spark.read.parquet(run.table("bench_results")), run.layout.experiment, run.run_id,
                   run.year, run.month)


def _write_step(
    run: Run, step: str, layer: str, source: DataFrame, change: Callable[[DataFrame], DataFrame],
    parts: Sequence[DataFrame] = (), started: float | None = None,
) -> StepRecord:
    """Write `change(source)` as the step's layer; rows in and out are seen by the write itself.

    Several `parts`, which together are the source, are changed and written one after the other. They are not spread out:
    parts are for changes that exchange their rows.
    """
    seen_in, seen_out = [], []
    planned = partition_count(source)
    started = time.monotonic() if started is None else started

    rows = F.count(F.lit(1)).alias("rows")

    def changed(part: DataFrame) -> DataFrame:
        seen_in.append(Observation(f"{step} in"))
        seen_out.append(Observation(step))
        return change(part.observe(seen_in[-1], rows))

    if len(parts) > 1:
        path = write_layer_in_turn(run.spark, (changed(part).observe(seen_out[-1], rows) for part in parts),
                                   run.layout, layer, run.year, run.month, codec=run.settings.codec)
    else:
        path = write_layer(changed(spread_out(source)), run.layout, layer, run.year, run.month, codec=run.settings.codec,
                           files=run.settings.files_per_month, seen=seen_out[-1])
    wall = round(time.monotonic() - started, 3)
    rows_in, rows_out = (sum(x.get["rows"] for x in seen) for seen in (seen_in, seen_out))
    return record_step(run, StepRecord(
        step, run.year, run.month, rows_in, rows_out, wall, {
            "path": path, "partitions_in": planned, "partitions_out_planned": run.settings.files_per_month or planned,
            "files_out": len(part_files(run.spark, path, ".parquet")), "write_sec": wall,
            "bytes_out_mb": folder_mib(run.spark, path)}))


def _with_settings(step):
    """The step under its run's settings."""
    @wraps(step)
    def inside(run: Run, *args, **kwargs):
        with applied(run.spark, run.settings):
            return step(run, *args, **kwargs)

    return inside


@_with_settings
def to_bronze(run: Run, dataset: str, explicit: str | None = None) -> StepRecord:
    """Landing CSV to untyped Parquet."""
    raw = read_landing(run.spark, run.layout.root, dataset, run.year, run.month, explicit)
    return _write_step(run, "bronze", "bronze", raw, lambda df: df)


@_with_settings
def to_silver(run: Run) -> StepRecord:
    """Bronze to the canonical, typed and flagged fact."""
    return _write_step(run, "silver_prep", "silver", run.layer("bronze"), lambda df: to_silver_rows(df, run.spec))


def join_keys(fact: DataFrame) -> DataFrame:
    """Integer join keys and the flag as trimmed upper-case text."""
    ids = ("pu_zone_id", "do_zone_id", "payment_type", "ratecode_id", "vendor_id")
    return replace_columns(fact, {
        **{c: tolerant_cast(F.col(c), fact.schema[c].dataType, "int") for c in ids},
        "store_and_fwd_flag": flag_text(F.col("store_and_fwd_flag")),
    })


def trip_lookups(dims: Mapping[str, DataFrame]) -> list[Lookup]:
    """The eight lookups of a trip; zones and dates play two roles each."""
    zones = conform_dim(dims["zones"], trips.ZONES)
    payments = conform_dim(dims["payment_type"], trips.PAYMENTS)
    ratecodes = conform_dim(dims["ratecode"], trips.RATECODES)
    vendors = conform_dim(dims["vendor"], trips.VENDORS)
    flags = conform_dim(dims["store_flag"], trips.STORE_FLAGS)
    dates = conform_dim_date(dims["dim_date"])

    def zone(role):
        return {"zone_name": f"{role}_zone_name", "borough": f"{role}_borough"}

    def date(role):
        return {"iso_dow": f"{role}_iso_dow", "is_weekend": f"{role}_is_weekend"}

    return [
        Lookup(zones, "pu_zone_id", "zone_id", zone("pu")),
        Lookup(zones, "do_zone_id", "zone_id", zone("do")),
        Lookup(payments, "payment_type", "payment_type", {"payment_desc": "payment_desc"}),
        Lookup(ratecodes, "ratecode_id", "ratecode_id", {"ratecode_desc": "ratecode_desc"}),
        Lookup(vendors, "vendor_id", "vendor_id", {"vendor_name": "vendor_name"}),
        Lookup(flags, "store_and_fwd_flag", "store_flag", {"description": "store_flag_desc"}),
        Lookup(dates, "pickup_date_id", "date_id", date("pickup")),
        Lookup(dates, "dropoff_date_id", "date_id", date("dropoff")),
    ]


def wide_rows(
    silver: DataFrame, dims: Mapping[str, DataFrame], strategy: str = "auto", *, from_files: bool = True,
) -> DataFrame:
    return star_join(join_keys(silver), trip_lookups(dims), strategy, from_files=from_files)


@contextmanager
def _wide_parts(
    silver: DataFrame, dims: Mapping[str, DataFrame], strategy: str, *, whole: bool = False, from_files: bool = True,
) -> Iterator[tuple[list[DataFrame], Callable[[DataFrame], DataFrame]]]:
    """A silver layer in the parts to be joined one after the other, and what makes a part wide.

    It is one part if no lookup exchanges it, or with `whole`.
    """
    join = plan_star_join(join_keys(silver), trip_lookups(dims), strategy, from_files=from_files)
    parts = in_parts(silver) if join.moved and not whole else [silver]
    with replace(join, from_files=True).stored() if len(parts) > 1 else nullcontext(join) as kept:
        yield parts, lambda part: kept.rows(join_keys(part))


def stored_wide_rows(silver: DataFrame, dims: Mapping[str, DataFrame], strategy: str, folder: str) -> DataFrame:
    """Wide rows of a silver layer; those of a large one that is exchanged are stored in `folder`, a part after the other."""
    with _wide_parts(silver, dims, strategy) as (parts, wide):
        if len(parts) == 1:
            return wide(silver)
        write_in_turn(silver.sparkSession, map(wide, parts), folder, codec="zstd")
    return silver.sparkSession.read.parquet(folder)


@_with_settings
def to_wide(run: Run, overrides: dict[str, str] | None = None) -> StepRecord:
    """Silver decorated with all dimensions.

    Where it is exchanged, a large silver is joined a part after the other, so that exchanges of one part at a time take disk.
    """
    dims = read_dictionaries(run.spark, run.layout, DICTIONARIES, overrides)
    strategy = "auto" if run.settings.broadcast_small else "merge"
    started, silver = time.monotonic(), run.layer("silver")
    with _wide_parts(silver, dims, strategy, whole=run.settings.files_per_month is not None, from_files=False) as (parts, wide):
        return _write_step(run, "silver_join", "silver_wide", silver, wide, parts, started)


@_with_settings
def to_export(run: Run) -> tuple[StepRecord, Export]:
    """Silver to canonical CSV."""
    started = time.monotonic()
    silver = run.layer("silver")
    seen = Observation("export")
    rows = to_export_rows(spread_out(silver), run.spec, run.layout.experiment).observe(seen, F.count(F.lit(1)).alias("rows"))
    done = export_csv(rows, run.path("export"), export_name("fact_trips", run.year, run.month),
                      run.settings.export_mode, run.settings.files_per_month, run.settings.export_compression)
    wall = round(time.monotonic() - started, 3)
    # The export neither filters nor multiplies; Parquet footers give the count.
    record = StepRecord("export", run.year, run.month, silver.count(), seen.get["rows"], wall, {
        "files_out": len(done.files), "write_sec": wall, "bytes_out_mb": folder_mib(run.spark, done.folder)})
    return record_step(run, record), done


def read_export(spark: SparkSession, folder: str, spec: FactSpec) -> DataFrame:
    """Exported CSV back with its types; parts make one relation."""
    types = {c.name: c.type for c in spec.columns} | {"load_src": "string"}
    text = read_csv_text(spark, folder)
    return text.select(*[F.col(c).cast(types[c]).alias(c) for c in spec.export])


#: Columns of the fact whose statistics the optimizer gets after a load.
ANALYZED = ("vendor_id", "ratecode_id", "payment_type", "pu_zone_id", "do_zone_id", "pickup_date_id", "dropoff_date_id")


@contextmanager
def _named_jobs(spark: SparkSession, group: str) -> Iterator[None]:
    """Jobs inside the block carry the group's name, also in the event log."""
    context = spark.sparkContext
    key = "spark.jobGroup.id"
    before = context.getLocalProperty(key)
    context.setLocalProperty(key, group)
    try:
        yield
    finally:
        context.setLocalProperty(key, before)


@_with_settings
def load(run: Run, export: Export, dims: Mapping[str, DataFrame] | None = None) -> LoadReport:
    """Exported CSV into the month of the warehouse fact, with rates and fresh statistics.

    With an event log the times of the single parts, their sum and the longest, come along.
    """
    spark = run.spark
    rows = read_export(spark, export.folder, run.spec)
    keys = []
    if dims:
        keys = [ForeignKey(x.on, x.dim, x.key) for x in trip_lookups(dims)
                if x.on != run.spec.flag]
    table = run.fact(stamped_schema(rows))
    group = f"load {run.run_id} {run.year}-{run.month:02d} {time.time_ns()}"
    with _named_jobs(spark, group):
        done = load_month(rows, table, run.year, run.month, flag=run.spec.flag,
                          allowed=(*run.spec.flag_values, run.spec.flag_unknown), foreign_keys=keys,
                          mib_in=files_mib(spark, export.folder, export.files), from_files=True, codec=run.settings.codec)
    started = time.monotonic()
    analyze(spark, table.name, *((run.year, run.month) if done.rows_loaded else ()),
            columns=[c for c in ANALYZED if c in rows.columns])
    analyzed = round(time.monotonic() - started, 3)
    parts = {}
    if run.event_log_dir:
        events = read_event_log(spark, run.event_log_dir, spark.sparkContext.applicationId)
        parts = part_totals(part_times(events, group)).first().asDict()
    report = done.record()
    step = "dwh_parallel" if len(export.files) > 1 else "dwh_single"
    record_step(run, StepRecord(step, run.year, run.month, done.rows_loaded, report.pop("rows_out"), report.pop("wall_sec"), {
        **report, **parts, "files_in": len(export.files), "table_bytes_mb": done.mib, "analyze_sec": analyzed}))
    return done


def silver_quality(silver: DataFrame, spec: FactSpec = trips.TRIPS) -> DataFrame:
    """All silver percentages and the duplicate percentage as one row."""
    shares = quality.rule_percentages(silver, trips.silver_rules())
    repeats = quality.duplicate_percentage(silver, spec.duplicate_keys)
    duplicates = repeats.select("duplicate_key_pct").scalar()
    return shares.select("*", duplicates.alias("duplicate_key_pct"))


def join_quality(wide: DataFrame) -> DataFrame:
    return quality.rule_percentages(wide, trips.join_rules())


def load_quality(fact: DataFrame, exported_rows: Column) -> DataFrame:
    """Shares of a loaded month and its row count against what was exported."""
    shares = quality.rule_percentages(fact, trips.load_rules())
    both = shares.withColumn("rows_export", exported_rows).withColumnRenamed("rows_total", "rows_fact")
    return both.withColumn("rowcount_mismatch_pct", quality.mismatch_pct())


def check(run: Run, step: str, metrics: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Evaluate one row of metrics, append the results, stop the run if the step is gated."""
    evaluated = quality.evaluate(quality.as_rules(metrics, rules), step, run.policy)
    # A handful of rule rows: taken once, so that what is stored is what is judged, and an
    # earlier attempt of the same run does not block a repaired one.
    fresh = run.spark.createDataFrame(evaluated.collect(), evaluated.schema)
    append_rows(quality_rows(fresh, run.layout.experiment, run.run_id, run.year, run.month),
                run.table("dq_results"))
    quality.gate(fresh, run.policy)
    return fresh


def init_dimensions(
    spark: SparkSession, layout: Layout, csv_paths: Mapping[str, str],
    first_day: str = trips.CALENDAR_START, last_day: str = trips.CALENDAR_END,
    database: str | None = None,
) -> None:
    """Dictionary CSVs and the calendar to Parquet, after checking their keys.

    With `database` every dictionary is also reloaded as a dimension table of it.
    """
    tables = {name: read_dictionary(spark, name, path) for name, path in csv_paths.items()}
    tables["dim_date"] = calendar_between(spark, first_day, last_day)
    broken = primary_key_violations([(n, t, t.columns[0]) for n, t in tables.items()])
    bad = broken.where("repeated_keys > 0 OR null_keys > 0").collect()
    if bad:
        raise ValueError(f"dimension keys are not unique: {[r['dimension'] for r in bad]}")
    for name, table in tables.items():
        write_dictionary(table, layout.dictionary(name))
        if database is not None:
            refresh_dimension(spark.read.parquet(layout.dictionary(name)), f"{database}.{name}")

"""Step metrics as JSON, the bench and quality tables, and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starpipe.trips import BENCH_SCHEMA

# Columns that describe the run rather than come from a step's metrics.
RUN_COLUMNS = ("experiment_id", "run_id", "mode")
DERIVED_COLUMNS = ("details", "created_at")


def write_metrics(record: DataFrame, path: str) -> None:
    """Metrics rows as JSON lines; one row per step, so one file."""
    record.coalesce(1).write.mode("overwrite").json(path)


def split_details(records: DataFrame, json_column: str = "record") -> DataFrame:
    """JSON metrics to the bench columns; keys without a column go to a JSON `details`."""
    schema = T.StructType.fromDDL(BENCH_SCHEMA)
    known = [f for f in schema.fields if f.name not in (*RUN_COLUMNS, *DERIVED_COLUMNS)]
    text = F.col(json_column)
    parsed = F.from_json(text, T.StructType(known))
    pairs = F.from_json(text, "map<string,variant>")
    names = F.array(*[F.lit(f.name) for f in known])
    rest = F.map_filter(pairs, lambda k, _: ~F.array_contains(names, k))
    details = F.when(F.size(rest) > 0, F.to_json(rest))
    return records.select("*", parsed.alias("_m"), details.alias("details")).select(
        *[F.col(c) for c in records.columns if c != json_column],
        *[F.col(f"_m.{f.name}") for f in known], "details",
    )


def bench_rows(
    metrics: DataFrame, experiment: str, run_id: str, mode: str = "optimized"
) -> DataFrame:
    """Rows of the bench table from JSON text records (column `record`)."""
    split = split_details(metrics)
    named = split.withColumns({
        "experiment_id": F.lit(experiment), "run_id": F.lit(run_id), "mode": F.lit(mode),
        "created_at": F.current_timestamp(),
    })
    return named.select(*T.StructType.fromDDL(BENCH_SCHEMA).fieldNames())


def append_rows(rows: DataFrame, path: str) -> None:
    """Append result rows (bench or quality) to their table folder."""
    rows.write.mode("append").parquet(path)


def quality_rows(
    evaluated: DataFrame, experiment: str, run_id: str, year: int, month: int,
    details: dict[str, str] | None = None,
) -> DataFrame:
    """Rows of the quality table from evaluated rules."""
    source = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in details.items()])) if details \
        else F.lit(None).cast("string")
    return evaluated.select(
        F.lit(experiment).alias("experiment_id"), F.lit(run_id).alias("run_id"), "step",
        F.lit(year).alias("year"), F.lit(month).alias("month"), "rule", "value_num",
        "threshold", "status", source.alias("details"),
        F.current_timestamp().alias("created_at"),
    )


def one_run(rows: DataFrame, experiment: str, run_id: str, year: int, month: int) -> DataFrame:
    return rows.where(
        (F.col("experiment_id") == experiment) & (F.col("run_id") == run_id)
        & (F.col("year") == year) & (F.col("month") == month)
    )


def bench_report(bench: DataFrame) -> DataFrame:
    """Step rows of the report as text, blank where nothing was measured."""
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    names = ("wall_sec", "rows_in", "rows_out", "bytes_in_mb", "bytes_out_mb")
    return bench.select("step", *[text(n) for n in names]).orderBy("step")


def quality_report(results: DataFrame) -> DataFrame:
    """Rule rows of the report: value with six digits, blank threshold if there is none."""
    return results.select(
        "step", "rule", F.format_string("%.6f", F.col("value_num")).alias("value"),
        F.coalesce(F.col("threshold").cast("string"), F.lit("")).alias("threshold"), "status",
    ).orderBy("step", "rule")

"""Comparisons of benchmark runs: pivots, changes against a base, stage breakdowns.

Input is a bench table with one row per experiment and step. Each operator first reduces it
to one row per experiment and step, so what is pivoted or joined afterwards is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starpipe.functions.measures import change_pct, ratio, rounded, step_position

TOTAL = "pipeline_total"


def experiment_rows(
    bench: DataFrame, experiments: Sequence[str],
    year: int | None = None, month: int | None = None,
) -> DataFrame:
    """The rows of named experiments, of one month if given."""
    rows = bench.where(F.col("experiment_id").isin(*experiments))
    if year is not None:
        rows = rows.where((F.col("year") == year) & (F.col("month") == month))
    return rows


def wall_by_step(bench: DataFrame, steps: Sequence[str] | None = None) -> DataFrame:
    rows = bench.where(F.col("step").isin(*steps)) if steps else bench
    return rows.groupBy("experiment_id", "step").agg(F.sum("wall_sec").alias("wall_sec"))


def with_position(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Make the report order visible; meant for report rows, not for data."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def step_order(steps: Sequence[str], *then: str) -> list[Column]:
    return [step_position(F.col("step"), tuple(steps)).asc_nulls_last(),
            *[F.col(c).asc_nulls_last() for c in then]]


def _pivot(walls: DataFrame, variants: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    return walls.groupBy(*keys).agg(*[
        F.max(F.when(F.col("experiment_id") == experiment, F.col("wall_sec"))).alias(name)
        for name, experiment in variants.items()
    ])


def pivot_steps(
    bench: DataFrame, variants: Mapping[str, str], *, total: bool = True, fill: bool = True,
    steps: Sequence[str] | None = None,
) -> DataFrame:
    """One row per step, one column per variant, with a total row below them."""
    walls = wall_by_step(bench, steps)
    out = _pivot(walls, variants, ["step"])
    if total:
        sums = walls.groupBy("experiment_id").agg(F.sum("wall_sec").alias("wall_sec"))
        row = _pivot(sums.withColumn("step", F.lit(TOTAL)), variants, ["step"])
        out = out.unionByName(row)
    if fill:
        out = out.select("step", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in variants])
    return out


def round_columns(df: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def off_on_delta(bench: DataFrame, off: str, on: str) -> DataFrame:
    """Steps and total of two variants with their difference, absolute and in percent."""
    p = pivot_steps(bench, {"off_sec": off, "on_sec": on})
    return p.select(
        "step",
        rounded(F.col("off_sec"), 3).alias("off_sec"),
        rounded(F.col("on_sec"), 3).alias("on_sec"),
        rounded(F.col("on_sec") - F.col("off_sec"), 3).alias("delta_sec"),
        rounded(change_pct(F.col("on_sec"), F.col("off_sec")), 2).alias("delta_pct"),
    )


def one_step_by_experiment(
    bench: DataFrame, step: str, measures: Mapping[str, Column]
) -> DataFrame:
    """Aggregates of a single step, by experiment."""
    return bench.where(F.col("step") == step).groupBy("experiment_id").agg(*[
        c.alias(n) for n, c in measures.items()
    ])


def step_details(
    bench: DataFrame, steps: Sequence[str], measures: Mapping[str, int],
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rounded measures row by row; with labels, the variant name instead of the experiment."""
    if labels:
        experiment = F.col("experiment_id")
        name = reduce(lambda c, kv: c.when(experiment == kv[0], F.lit(kv[1])),
                      list(labels.items())[1:],
                      F.when(experiment == next(iter(labels)), F.lit(next(iter(labels.values())))))
        head = [name.alias("variant")]
    else:
        head = [F.col("step"), F.col("experiment_id")]
    return bench.where(F.col("step").isin(*steps)).select(
        *head, *[rounded(F.col(n), d).alias(n) for n, d in measures.items()]
    )


def metric_comparison(bench: DataFrame, step: str, off: str, on: str) -> DataFrame:
    """Metrics of one step as rows, two variants as columns, and the improvement."""
    sums = one_step_by_experiment(bench, step, {
        "wall_sec": F.sum("wall_sec").cast("double"),
        "executor_sec": F.sum("executor_run_time_ms") / 1000.0,
        "gc_sec": F.sum("gc_time_ms") / 1000.0,
        "tasks_total": F.sum("tasks_total").cast("double"),
        "stages": F.max("stages").cast("double"),
    })
    names = ["wall_sec", "executor_sec", "gc_sec", "tasks_total", "stages"]
    pivoted = sums.unpivot(["experiment_id"], names, "metric", "value").groupBy("metric").agg(
        F.max(F.when(F.col("experiment_id") == off, F.col("value"))).alias("off"),
        F.max(F.when(F.col("experiment_id") == on, F.col("value"))).alias("on"),
    )
    gain = ratio((F.col("off") - F.col("on")) * 100.0, F.col("off"))
    return pivoted.select("metric", rounded(F.col("off"), 3).alias("off"),
                          rounded(F.col("on"), 3).alias("on"),
                          rounded(gain, 1).alias("improvement_pct"))


def totals_vs_base(
    bench: DataFrame, base: str, steps: Sequence[str] | None = None,
    value: str = "pipeline_sec", suffix: str = "base",
) -> DataFrame:
    """Total of each experiment against a named one; no rows if the base is missing."""
    rows = bench.where(F.col("step").isin(*steps)) if steps else bench
    totals = rows.groupBy("experiment_id").agg(F.sum("wall_sec").alias("sec"))
    # A group key equal to one value: one row at most, so a scalar subquery serves.
    reference = totals.where(F.col("experiment_id") == base).select(F.struct("sec"))
    both = totals.select("*", reference.scalar().alias("base")).where(F.col("base").isNotNull())
    both = both.withColumn("base_sec", F.col("base.sec"))
    return both.select(
        "experiment_id",
        rounded(F.col("sec"), 3).alias(value),
        rounded(F.col("sec") - F.col("base_sec"), 3).alias(f"delta_vs_{suffix}_sec"),
        rounded(change_pct(F.col("sec"), F.col("base_sec")), 2).alias(f"delta_vs_{suffix}_pct"),
    )


def step_table(bench: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Long form: rounded wall time by experiment and step."""
    return round_columns(wall_by_step(bench, steps), ["wall_sec"])


def steps_vs_base(
    bench: DataFrame, variants: Mapping[str, str], base: str, compared: str,
    steps: Sequence[str],
) -> DataFrame:
    """Variants by step and one variant's change against the step's base."""
    walls = wall_by_step(bench, steps)
    reference = walls.where(F.col("experiment_id") == base).select(
        "step", F.col("wall_sec").alias("base_sec"))
    pivoted = _pivot(walls.join(reference, "step"), variants, ["step", "base_sec"])
    return pivoted.select(
        "step", *[rounded(F.col(v), 3).alias(v) for v in variants],
        rounded(change_pct(F.col(compared), F.col("base_sec")), 2).alias(f"{compared}_vs_base_pct"),
    )


def stage_breakdown(
    bench: DataFrame, groups: Mapping[str, Sequence[str]], total: str = "pipeline_sec"
) -> DataFrame:
    """Sums of groups of steps side by side, for experiments that ran every group.

    Conditional sums in one pass stand for one aggregate per group joined by experiment.
    """
    by_step = wall_by_step(bench)
    sums = by_step.groupBy("experiment_id").agg(*[
        F.sum(F.when(F.col("step").isin(*steps), F.col("wall_sec"))).alias(name)
        for name, steps in groups.items()
    ], *[F.count_if(F.col("step").isin(*steps)).alias(f"__{name}")
         for name, steps in groups.items()])
    present = reduce(lambda a, b: a & b, [F.col(f"__{n}") > 0 for n in groups])
    whole = reduce(lambda a, b: a + b, [F.col(n) for n in groups])
    return sums.where(present).select(
        "experiment_id", *[rounded(F.col(n), 3).alias(n) for n in groups],
        rounded(whole, 3).alias(total),
    )


def load_comparison(bench: DataFrame, steps: Sequence[str]) -> DataFrame:
    rows = bench.where(F.col("step").isin(*steps))
    return rows.groupBy("experiment_id", F.col("step").alias("dwh_step")).agg(
        rounded(F.sum("wall_sec"), 3).alias("dwh_wall_sec"),
        rounded(F.max("copy_throughput_mib_s"), 3).alias("copy_mib_s"),
        rounded(F.max("copy_throughput_rows_s"), 1).alias("copy_rows_s"),
        rounded(F.max("table_bytes_mb"), 3).alias("table_mb"),
        rounded(F.max("index_bytes_mb"), 3).alias("index_mb"),
    )


def export_throughput(bench: DataFrame, step: str = "export") -> DataFrame:
    sums = one_step_by_experiment(bench, step, {
        "files_out": F.coalesce(F.max("files_out"), F.lit(0)),
        "bytes_out_mb": rounded(F.sum("bytes_out_mb"), 3),
        "write_sec": rounded(F.sum("write_sec"), 3),
        "merge_sec": rounded(F.sum("merge_sec"), 3),
    })
    rate = F.when(F.col("write_sec") > 0, ratio(F.col("bytes_out_mb"), F.col("write_sec")))
    return sums.withColumn("export_throughput_mib_s", rounded(rate, 3))


def load_rates(
    parts: DataFrame, keys: Sequence[str], rows: str, mib: str, seconds: str, wall: str
) -> DataFrame:
    """Throughput of loads made of parts, null where no time passed.

    `seconds` is the time of a part, of which several run at once; `wall` is that of the whole
    load, the same in all its parts, and the rates are over it.
    """
    sums = parts.groupBy(*keys).agg(
        F.sum(rows).alias("rows_loaded"), F.sum(mib).alias("mib"),
        F.sum(seconds).alias("copy_sec_sum"), F.max(seconds).alias("copy_sec_max"),
        F.max(wall).alias("wall"))
    return sums.select(
        *keys, "rows_loaded", "copy_sec_sum", "copy_sec_max",
        rounded(ratio(F.col("mib"), F.col("wall")), 6).alias("copy_throughput_mib_s"),
        rounded(ratio(F.col("rows_loaded"), F.col("wall")), 6)
        .alias("copy_throughput_rows_s"))

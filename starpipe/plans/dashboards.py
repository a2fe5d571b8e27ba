"""The experiment reports over the bench table, one function per report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.functions.measures import rounded
from starpipe.operators import compare
from starpipe.trips import ALL_STEPS, EXPERIMENTS, LOAD_STEPS, SPARK_STEPS, STEP_ORDER

REPORT_YEAR, REPORT_MONTH = 2021, 1  # fixed values: the month the reports are about


def create_views(bench: DataFrame) -> None:
    """Named views of the rows each experiment's reports read."""
    for name, experiments in EXPERIMENTS.items():
        compare.experiment_rows(bench, experiments, REPORT_YEAR, REPORT_MONTH) \
            .createOrReplaceTempView(name)


def _view(bench: DataFrame, name: str) -> DataFrame:
    return compare.experiment_rows(bench, EXPERIMENTS[name], REPORT_YEAR, REPORT_MONTH)


def _by_step(df: DataFrame, steps=STEP_ORDER, *then: str) -> DataFrame:
    return df.orderBy(*compare.step_order(steps, *then))


def _short(experiment: str) -> str:
    return experiment.split("_", 1)[1]


def e1_steps(bench):
    off, on = EXPERIMENTS["v_e1"]
    return _by_step(compare.off_on_delta(_view(bench, "v_e1"), off, on))


def e1_steps_nullable(bench):
    off, on = EXPERIMENTS["v_e1"]
    table = compare.pivot_steps(_view(bench, "v_e1"), {"off_sec": off, "on_sec": on},
                                total=False, fill=False)
    return _by_step(compare.round_columns(table, ["off_sec", "on_sec"]))


def e1_join_tasks(bench):
    return compare.one_step_by_experiment(
        _view(bench, "v_e1"), "silver_join", {"tasks_total": F.sum("tasks_total")}
    ).orderBy("experiment_id")


def e1_join_skew(bench):
    return compare.one_step_by_experiment(
        _view(bench, "v_e1"), "silver_join",
        {"skew_factor_avg": rounded(F.avg("skew_factor"), 3)},
    ).orderBy("experiment_id")


def e1_load_throughput(bench):
    return compare.one_step_by_experiment(_view(bench, "v_e1"), "dwh_single", {
        "mib_s": rounded(F.max("copy_throughput_mib_s"), 3),
        "rows_s": rounded(F.max("copy_throughput_rows_s"), 1),
    }).orderBy("experiment_id")


def e2_steps(bench):
    off, on = EXPERIMENTS["v_e2"]
    return _by_step(compare.off_on_delta(_view(bench, "v_e2"), off, on))


def e2_steps_nullable(bench):
    off, on = EXPERIMENTS["v_e2"]
    table = compare.pivot_steps(_view(bench, "v_e2"), {"off_sec": off, "on_sec": on},
                                total=False, fill=False)
    return _by_step(compare.round_columns(table, ["off_sec", "on_sec"]))


SHUFFLE_AND_SPILL = {"shuffle_read_mb": 1, "shuffle_write_mb": 1,
                     "disk_spill_mb": 1, "memory_spill_mb": 1}


def e2_shuffle_spill(bench):
    off, on = EXPERIMENTS["v_e2"]
    return compare.step_details(_view(bench, "v_e2"), ["silver_join"], SHUFFLE_AND_SPILL,
                                {off: "off", on: "on"}).orderBy("variant")


def e2_metrics(bench):
    off, on = EXPERIMENTS["v_e2"]
    return compare.metric_comparison(_view(bench, "v_e2"), "silver_join", off, on)


def e3_totals(bench):
    return compare.totals_vs_base(_view(bench, "v_e3"), EXPERIMENTS["v_e3"][0]) \
        .orderBy("pipeline_sec")


def e3_step_table(bench):
    return _by_step(compare.step_table(_view(bench, "v_e3"), SPARK_STEPS), SPARK_STEPS,
                    "experiment_id")


def e3_spark_totals(bench):
    return compare.totals_vs_base(_view(bench, "v_e3"), EXPERIMENTS["v_e3"][0], SPARK_STEPS,
                                  "spark_sec").orderBy("spark_sec")


def e3_steps(bench):
    variants = {_short(e): e for e in EXPERIMENTS["v_e3"]}
    table = compare.pivot_steps(_view(bench, "v_e3"), variants)
    return _by_step(compare.round_columns(table, list(variants)))


def e3_steps_vs_base(bench):
    variants = {_short(e): e for e in EXPERIMENTS["v_e3"]}
    return _by_step(compare.steps_vs_base(_view(bench, "v_e3"), variants, EXPERIMENTS["v_e3"][0],
                                          "sp128_mpb128", SPARK_STEPS), SPARK_STEPS)


def e4_totals(bench):
    return compare.totals_vs_base(_view(bench, "v_e4"), EXPERIMENTS["v_e4"][0], ALL_STEPS,
                                  suffix="f1").orderBy("pipeline_sec")


def e4_spark_totals(bench):
    return compare.totals_vs_base(_view(bench, "v_e4"), EXPERIMENTS["v_e4"][0], SPARK_STEPS,
                                  "spark_sec", "f1").orderBy("spark_sec")


def e4_step_table(bench):
    return _by_step(compare.step_table(_view(bench, "v_e4"), SPARK_STEPS), SPARK_STEPS,
                    "experiment_id")


def e4_step_metrics(bench):
    return _by_step(compare.step_details(_view(bench, "v_e4"), SPARK_STEPS,
                                         {**SHUFFLE_AND_SPILL, "skew_factor": 2}),
                    SPARK_STEPS, "experiment_id")


def e5_totals(bench):
    return compare.totals_vs_base(_view(bench, "v_e5"), EXPERIMENTS["v_e5"][0]) \
        .orderBy("pipeline_sec")


def e5_stages(bench):
    groups = {"etl_sec": SPARK_STEPS, "export_sec": ("export",), "dwh_sec": LOAD_STEPS}
    return compare.stage_breakdown(_view(bench, "v_e5"), groups).orderBy("pipeline_sec")


def e5_loads(bench):
    return compare.load_comparison(_view(bench, "v_e5"), LOAD_STEPS).orderBy("dwh_wall_sec")


def e5_exports(bench):
    return compare.export_throughput(_view(bench, "v_e5")).orderBy(
        F.col("export_throughput_mib_s").desc_nulls_last())


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f for f in (
        e1_steps, e1_steps_nullable, e1_join_tasks, e1_join_skew, e1_load_throughput,
        e2_steps, e2_steps_nullable, e2_shuffle_spill, e2_metrics,
        e3_totals, e3_step_table, e3_spark_totals, e3_steps, e3_steps_vs_base,
        e4_totals, e4_spark_totals, e4_step_table, e4_step_metrics,
        e5_totals, e5_stages, e5_loads, e5_exports,
    )
}

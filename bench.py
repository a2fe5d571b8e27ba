"""Time the monthly steps and headline queries; print one JSON line.

All line items of $BENCH_SF_DIR, and of a smaller table next to it, become one month of trips: a
landing CSV, then bronze, silver, star join, export and load under three presets, with the checks
between them, each step reading what the one before it wrote. Then headline queries run over the
tables into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from starpipe.catalog import frames  # noqa: E402
from starpipe.catalog.registry import QUERIES  # noqa: E402
from starpipe.plans import steps  # noqa: E402
from starpipe.session import build_session, shared_folder  # noqa: E402
from starpipe.sinks.parquet import write_dictionary  # noqa: E402
from starpipe.sources.layers import read_dictionaries  # noqa: E402
from starpipe.spec import GatePolicy, Layout, RunSettings  # noqa: E402

YEAR, MONTH, DATASET = 2021, 1, "trips"
STEPS = ("bronze", "silver_prep", "silver_join", "export", "load")
PRESETS = ("baseline_soft", "opt_soft", "exp_parallel_soft")
HEADLINE_PRESET = "exp_parallel_soft"
HEADLINE = ("silver_fact", "dq_silver", "duplicate_pct", "star_join_broadcast", "star_join_merge",
            "order_lines", "order_lines_merge", "fk_violations", "event_log_stats",
            "month_replace", "report_e1_steps", "report_e2_metrics", "report_e3_steps_vs_base",
            "report_e5_stages")


def dimensions(spark, sf_dir: str, layout: Layout) -> None:
    """Dictionaries that know every key of the month, so that the load's keys hold."""
    for name, table in frames.known_dictionaries(spark, sf_dir).items():
        write_dictionary(table, layout.dictionary(name))


def month(spark, sf_dir: str, timed, prefix: str) -> None:
    """All steps over all line items, for each preset; the preset of the headline has no name of its own."""
    root = shared_folder(spark, "bench")
    shared = Layout(root, "bench", trial=1)
    frames.landing_trips(spark, sf_dir, YEAR, MONTH).write.option("header", True).csv(
        f"{root}/landing/{DATASET}/year={YEAR}/month={MONTH}")
    dimensions(spark, sf_dir, shared)
    rows = frames.table(spark, sf_dir, "lineitem").count()
    open_gate = GatePolicy(steps.trips.GATE.limits, ())
    rules = steps.trips.GATE.limits
    for preset in PRESETS:
        settings = steps.trips.PRESETS[preset]
        run = steps.Run(spark, Layout(root, preset), YEAR, MONTH, policy=open_gate, settings=settings)
        name = prefix + ("" if preset == HEADLINE_PRESET else f"{preset} ")
        timed(f"{name}bronze", lambda: steps.to_bronze(run, DATASET), rows)
        timed(f"{name}silver_prep", lambda: steps.to_silver(run), rows)
        timed(f"{name}silver_join", lambda: steps.to_wide(run), rows)
        dims = read_dictionaries(spark, run.layout, steps.DICTIONARIES)
        _, done = timed(f"{name}export", lambda: steps.to_export(run), rows)
        timed(f"{name}load", lambda: steps.load(run, done, dims), rows)
        if preset == HEADLINE_PRESET and not prefix:
            merged = replace(run, settings=replace(settings, broadcast_small=False))
            timed("silver_join_merge", lambda: steps.to_wide(merged), rows)
            timed("dq_silver_check", lambda: steps.check(
                run, "dq_silver", steps.silver_quality(run.layer("silver")), list(rules["dq_silver"])), rows)
            timed("dq_join_check", lambda: steps.check(
                run, "dq_join", steps.join_quality(run.layer("silver_wide")), list(rules["dq_join"])), rows)
            fact = run.fact().read().where(f"year = {YEAR} AND month = {MONTH}")
            timed("dq_dwh_check", lambda: steps.check(
                run, "dq_dwh", steps.load_quality(fact, F.lit(rows)), list(rules["dq_dwh"])), rows)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("starpipe-bench", f"local[{cpus}]", RunSettings(shuffle_partitions=int(cpus)), extra={
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name, action, rows=None):
        started = time.monotonic()
        result = action()
        took[name] = round(time.monotonic() - started, 3)
        if rows:
            rates[name] = round(rows / took[name])
        return result

    smaller = str(Path(sf_dir).parent / "sf0.01")
    scales = [sf_dir] + [smaller] * (smaller != sf_dir and Path(smaller).is_dir())
    for scale in scales:
        month(spark, scale, timed, "" if scale == sf_dir else f"{Path(scale).name} ")
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    total = sum(took[s] for s in STEPS)
    print(json.dumps({
        "metric": "wall time of bronze, silver_prep, silver_join, export and load over one month",
        "value": round(total, 3), "unit": "sec", "queries": took,
        "sf": Path(sf_dir).name.removeprefix("sf"), "rows_per_sec": rates, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

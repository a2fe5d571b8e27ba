"""Reports over bench rows with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from starpipe import trips
from starpipe.operators import compare
from starpipe.plans import dashboards

WALLS = {
    "E1_aqe_off": {"bronze": 10.0, "silver_prep": 40.0, "silver_join": 30.0, "export": 0.0},
    "E1_aqe_on": {"bronze": 8.0, "silver_prep": 44.0, "silver_join": 24.0, "export": 5.0,
                  "odd_step": 1.0},
}


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(e, s, 2021, 1, w) for e, walls in WALLS.items() for s, w in walls.items()]
    rows += [("E1_aqe_on", "bronze", 2021, 2, 999.0), ("other", "bronze", 2021, 1, 999.0)]
    return spark.createDataFrame(rows, "experiment_id string, step string, year int, month int, wall_sec double")


def test_steps_with_total_and_order(bench):
    rows = [tuple(r) for r in dashboards.e1_steps(bench).collect()]
    assert rows == [
        ("bronze", 10.0, 8.0, -2.0, -20.0),
        ("silver_prep", 40.0, 44.0, 4.0, 10.0),
        ("silver_join", 30.0, 24.0, -6.0, -20.0),
        ("export", 0.0, 5.0, 5.0, None),
        ("pipeline_total", 80.0, 82.0, 2.0, 2.5),
        ("odd_step", 0.0, 1.0, 1.0, None),
    ]


def test_steps_without_fill_keep_null(bench):
    rows = {r["step"]: r for r in dashboards.e1_steps_nullable(bench).collect()}
    assert rows["odd_step"]["off_sec"] is None and "pipeline_total" not in rows


def test_totals_against_a_base(bench):
    rows = bench.where("year = 2021 AND month = 1 AND experiment_id <> 'other'")
    out = [tuple(r) for r in compare.totals_vs_base(rows, "E1_aqe_off").orderBy("pipeline_sec").collect()]
    assert out == [("E1_aqe_off", 80.0, 0.0, 0.0), ("E1_aqe_on", 82.0, 2.0, 2.5)]
    assert compare.totals_vs_base(rows, "absent").count() == 0


def test_breakdown_needs_every_group(spark):
    rows = spark.createDataFrame([
        ("a", "bronze", 1.0), ("a", "export", 2.0), ("a", "dwh_single", 4.0),
        ("b", "bronze", 1.0), ("b", "export", 2.0)],
        "experiment_id string, step string, wall_sec double")
    groups = {"etl_sec": trips.SPARK_STEPS, "export_sec": ("export",), "dwh_sec": trips.LOAD_STEPS}
    assert [tuple(r) for r in compare.stage_breakdown(rows, groups).collect()] == [
        ("a", 1.0, 2.0, 4.0, 7.0)]


def test_rounding_is_half_away_from_zero(spark):
    from starpipe.functions.measures import rounded

    df = spark.createDataFrame([(1.0005,), (-1.0005,), (2.675,)], "x double")
    assert [r[0] for r in df.select(rounded(F.col("x"), 3)).collect()] == [1.001, -1.001, 2.675]
    assert df.select(rounded(F.col("x"), 2)).collect()[2][0] == 2.68


def test_every_view_exists(bench, spark):
    dashboards.create_views(bench)
    assert spark.table("v_e1").count() == 9
    assert spark.table("v_e5").count() == 0


def test_published_run(spark):
    """Wall times of one published pair of runs and their published totals."""
    walls = {
        "E1_aqe_off": (18.361171513000045, 44.30300164222717, 28.99062728881836,
                       25.164586305618286, 96.326),
        "E1_aqe_on": (18.932708354999704, 42.740081787109375, 24.52393078804016,
                      25.157838821411133, 93.609),
    }
    rows = [(e, s, 2021, 1, w) for e, ws in walls.items() for s, w in zip(trips.ALL_STEPS, ws)]
    bench = spark.createDataFrame(
        rows, "experiment_id string, step string, year int, month int, wall_sec double")
    total = dashboards.e1_steps(bench).where("step = 'pipeline_total'").first()
    assert tuple(total) == ("pipeline_total", 213.145, 204.964, -8.182, -3.84)
    assert [r["step"] for r in dashboards.e1_steps(bench).collect()] == list(trips.STEP_ORDER)

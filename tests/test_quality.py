"""Percentages, duplicates, limits, the gate and the load constraints."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starpipe.operators import constraints, quality, star
from starpipe.operators.constraints import ForeignKey, LoadRejected
from starpipe.spec import GatePolicy

POLICY = GatePolicy({"s": {"a": 1.0, "b": 1.0, "c": 1.0}}, ("s",))


def test_percentages(spark):
    df = spark.createDataFrame([(1,), (None,), (3,), (-1,), (5,), (7,)], "x int")
    rules = {"low": F.col("x") < 2, "missing": F.col("x").isNull()}
    row = quality.rule_percentages(df, rules).first()
    assert tuple(row) == (33.333333, 16.666667, 6)
    assert tuple(quality.rule_percentages(df.limit(0), rules).first()) == (0.0, 0.0, 0)


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"), (3, "c"), (None, "d"), (None, "d")],
        "k int, v string")
    assert tuple(quality.duplicate_percentage(df, ["k", "v", "absent"]).first()) == (4, 8, 50.0)
    assert tuple(quality.duplicate_percentage(df.limit(0), ["k"]).first()) == (0, 0, 0.0)
    assert tuple(quality.duplicate_percentage(df, ["absent"]).first())[2] == 0.0


def test_limits_are_inclusive_and_optional(spark):
    metrics = spark.createDataFrame([(1.0, 1.000001, 0.5, 90.0)], "a double, b double, c double, d double")
    out = quality.evaluate(quality.as_rules(metrics, ["a", "b", "c", "d"]), "s", POLICY)
    assert {r["rule"]: (r["threshold"], r["status"]) for r in out.collect()} == {
        "a": (1.0, "OK"), "b": (1.0, "FAIL"), "c": (1.0, "OK"), "d": (None, "OK")}
    with pytest.raises(quality.QualityGateError, match="s.b=1.000001 > 1.0"):
        quality.gate(out, POLICY)
    quality.gate(out, GatePolicy(POLICY.limits, ()))
    quality.gate(out.where("rule <> 'b'"), POLICY)
    assert quality.evaluate(quality.as_rules(metrics, ["b"]), "other", POLICY).first()["status"] == "OK"


def test_row_counts(spark):
    a, b = spark.range(200), spark.range(199)
    assert quality.rowcount_mismatch(a, b).first()["rowcount_mismatch_pct"] == 0.5
    assert quality.rowcount_mismatch(b.limit(0), a).first()["rowcount_mismatch_pct"] == 0.0


def test_summary_counts_each_status(spark):
    at = dt.datetime(2021, 1, 1)
    df = spark.createDataFrame(
        [("e", "s", 2021, 1, status, at + dt.timedelta(hours=i))
         for i, status in enumerate(["OK", "OK", "FAIL", "WARN"])],
        "experiment_id string, step string, year int, month int, status string, created_at timestamp")
    row = quality.summarize(df).first()
    assert tuple(row)[4:8] == (4, 2, 1, 1)
    assert (row["first_at"], row["last_at"]) == (at, at + dt.timedelta(hours=3))


@pytest.fixture
def load_rows(spark):
    return spark.createDataFrame(
        [(1, 2021, 1, "Y"), (1, 2021, 1, None), (None, 2021, 1, "U")],
        "d int, year int, month int, flag string")


@pytest.mark.parametrize("large", [False, True])
def test_foreign_keys(spark, load_rows, monkeypatch, large):
    if large:
        monkeypatch.setattr(star, "BROADCAST_ROWS", 0)
    dim = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    keys = [ForeignKey("d", dim, "id")]
    assert tuple(constraints.foreign_key_violations(load_rows, keys).first()) == ("d", 0, 0)
    bad = load_rows.unionByName(spark.createDataFrame(
        [(8, 2021, 1, "N")] * 3 + [(9, 2021, 1, "N")], load_rows.schema))
    assert tuple(constraints.foreign_key_violations(bad, keys).first()) == ("d", 4, 2)
    assert constraints.require_loadable(load_rows, 2021, 1, "flag", "YNU", keys) == 3
    with pytest.raises(LoadRejected, match="rows_unknown_d=4"):
        constraints.require_loadable(bad, 2021, 1, "flag", "YNU", keys)


@pytest.mark.parametrize("row, problem", [
    ((1, 2021, 2, "Y"), "rows_outside_month=1"),
    ((1, None, None, "Y"), "rows_outside_month=1"),
    ((1, 2021, 1, "Z"), "rows_bad_flag=1"),
])
def test_rejected_rows(spark, load_rows, row, problem):
    bad = load_rows.unionByName(spark.createDataFrame([row], load_rows.schema))
    with pytest.raises(LoadRejected, match=problem):
        constraints.require_loadable(bad, 2021, 1, "flag", ("Y", "N", "U"))


def test_primary_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id int")
    row = constraints.primary_key_violations([("t", df, "id")]).first()
    assert tuple(row) == ("t", 1, 2)


def test_only_suspected_rows_are_grouped(spark):
    """Rows whose key is theirs alone are not exchanged, and a bitmap of few slots changes no result."""
    df = spark.range(20_000).select(F.when(F.col("id") % 1000 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    assert quality.suspects(df, ["k", "v"]).count() == 20
    few = quality.suspects(df, ["k", "v"], bits=6)
    assert 20 <= few.count() <= 20_000 and few.groupBy("k", "v").count().where("count > 1").first()["count"] == 20
    assert tuple(quality.duplicate_percentage(df, ["k", "v"]).first()) == (19, 20_000, 0.095)


def test_key_bitmaps_hold_the_keys_themselves(spark):
    from starpipe.operators import constraints

    dim = spark.createDataFrame([(k,) for k in (0, 1, 63, 64, -1, -64, -65, 2**62, None)], "k long")
    fact = spark.createDataFrame([(k,) for k in (0, 1, 2, 63, 64, 65, -1, -2, -64, -65, -66, 2**62, 2**62 + 1, None)], "k long")
    for most in (1000, 0):  # by the bitmap, and by an exchange of the values
        found = constraints.foreign_key_violations(fact, [constraints.ForeignKey("k", dim, "k")], bitmap_words=most)
        assert tuple(found.first()) == ("k", 5, 5)
    words = {r["word"]: r["bits"] for r in constraints.key_bitmap(dim, "k").collect()}
    assert words[0] == 3 - 2**63 and words[1] == 1 and len(words) == 5

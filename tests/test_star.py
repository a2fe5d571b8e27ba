"""Left joins: uniqueness, nulls, roles, skewed keys, the choice of strategy."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starpipe.operators import star
from starpipe.operators.star import Lookup, hot_keys, star_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, a third null, the rest all different."""
    key = (F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None))
           .otherwise(F.col("id")))
    return spark.range(9000).select("id", key.cast("long").alias("k"),
                                    F.lit("same").alias("payload"))


@pytest.fixture(scope="module")
def dim(spark):
    """Every second id as a key, one of them twice."""
    rows = spark.range(0, 9000, 2).select(F.col("id").alias("key"),
                                          F.concat(F.lit("n"), "id").alias("name"))
    extra = spark.createDataFrame([(7, "seven"), (7, "also seven"), (None, "no key")],
                                  "key long, name string")
    return rows.unionByName(extra)


def expected(skewed):
    name = (F.when(F.col("k") == 7, "also seven")
            .when(F.col("k") % 2 == 0, F.concat(F.lit("n"), "k")))
    return {tuple(r) for r in skewed.select("id", "k", name).collect()}


@pytest.mark.parametrize("strategy", ["auto", "merge"])
def test_keeps_each_fact_row_once(skewed, dim, strategy):
    out = star_join(skewed, [Lookup(dim, "k", "key", {"name": "name"})], strategy)
    rows = out.select("id", "k", "name").collect()
    assert len(rows) == 9000
    assert {tuple(r) for r in rows} == expected(skewed)
    assert out.columns == ["id", "k", "payload", "name"]


def test_spreads_hot_key_and_nulls(spark, skewed, dim):
    hot = dict(hot_keys(skewed, ["k"])["k"])
    assert hot[7] == pytest.approx(1 / 3, abs=0.01)
    assert hot[None] == pytest.approx(1 / 3, abs=0.01)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = star_join(skewed, [Lookup(dim, "k", "key", {"name": "name"})], "merge")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p"))
                 .agg(F.count(F.lit(1)).alias("n")).collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 9000 / 3  # neither third lies in one task
    assert "SortMergeJoin" in plan


def test_only_nulls_hot(spark, dim):
    fact = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, F.col("id") + 100000).alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = star_join(fact, [Lookup(dim, "k", "key", {"name": "name"})], "merge")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p"))
                 .agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 1500
    assert out.where("name IS NOT NULL").count() == 0


def test_too_large_to_broadcast_is_shuffled(monkeypatch, skewed, dim):
    monkeypatch.setattr(star, "BROADCAST_ROWS", 10)
    out = star_join(skewed, [Lookup(dim, "k", "key", {"name": "name"})])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert {tuple(r) for r in out.select("id", "k", "name").collect()} == expected(skewed)


def test_small_is_broadcast_even_without_threshold(spark, skewed, dim):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = star_join(skewed, [Lookup(dim, "k", "key", {"name": "name"})])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("strategy", ["auto", "merge"])
def test_two_roles_of_one_table(spark, dim, strategy):
    fact = spark.createDataFrame([(2, 4), (4, None), (None, 7)], "a long, b long")
    out = star_join(fact, [Lookup(dim, "a", "key", {"name": "a_name"}),
                           Lookup(dim, "b", "key", {"name": "b_name"})], strategy)
    assert {tuple(r) for r in out.collect()} == {
        (2, 4, "n2", "n4"), (4, None, "n4", None), (None, 7, None, "also seven")}


def test_unknown_column_and_strategy(skewed, dim):
    with pytest.raises(ValueError):
        star_join(skewed, [Lookup(dim, "missing", "key")])
    with pytest.raises(ValueError):
        star_join(skewed, [Lookup(dim, "k", "key")], "guess")


def test_empty_sides(spark, skewed, dim):
    lookup = Lookup(dim.limit(0), "k", "key", {"name": "name"})
    for strategy in ("auto", "merge"):
        assert star_join(skewed, [lookup], strategy).where("name IS NULL").count() == 9000
        assert star_join(skewed.limit(0), [lookup], strategy).count() == 0


def test_spread_by_content_for_a_shuffled_fact(skewed, dim):
    fact = skewed.repartition(5)
    out = star_join(fact, [Lookup(dim, "k", "key", {"name": "name"})], "merge", from_files=False)
    assert {tuple(r) for r in out.select("id", "k", "name").collect()} == expected(skewed)


def test_sketches_are_merged_in_levels(spark, monkeypatch, skewed):
    """Two tasks a lane, then two lanes a lane: eight tasks give four sketches, then two."""
    monkeypatch.setattr(star, "FAN_IN", 2)
    sketches = star.key_sketches(skewed.repartition(8), ["k"], 100)
    assert sorted(r["n"] for r in sketches.select("n").collect()) != [9000]
    assert sketches.count() == 2 and sum(r["n"] for r in sketches.collect()) == 9000
    plan = sketches._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "approx_top_k_accumulate" in plan and "approx_top_k_combine" in plan
    assert dict(hot_keys(skewed, ["k"])["k"])[7] == pytest.approx(1 / 3, abs=0.01)
    assert hot_keys(skewed.where("false"), ["k"]) == {"k": []}


def test_few_keys_need_no_exchange(spark, dim):
    """All keys are known from the sketch and counted to be all: their dimension rows are broadcast."""
    fact = spark.range(4000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5 * 2).alias("k"))
    out = star_join(fact, [Lookup(dim, "k", "key", {"name": "name"})], "merge")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["k"], r["name"]) for r in out.select("k", "name").distinct().collect()} == {
        (None, None), (2, "n2"), (4, "n4"), (6, "n6"), (8, "n8")}
    assert out.count() == 4000


def test_roles_share_a_broadcast_that_counts_once(spark, monkeypatch):
    """repeated rows of a key and the second role of a table do not push it out of the broadcast."""
    monkeypatch.setattr(star, "BROADCAST_ROWS", 100)
    once = spark.range(100).selectExpr("CAST(id AS INT) AS key", "concat('n', id) AS name")
    twice = once.unionByName(once.withColumn("name", F.concat(F.lit("alias of "), "name")))
    fact = spark.range(1000).selectExpr("id", "CAST(id % 120 AS INT) AS a", "CAST(id % 7 AS INT) AS b")
    out = star_join(fact, [Lookup(twice, "a", "key", {"name": "a_name"}), Lookup(twice, "b", "key", {"name": "b_name"})])
    rows = {r["id"]: (r["a_name"], r["b_name"]) for r in out.collect()}
    assert rows[5] == ("alias of n5", "alias of n5") and rows[110] == (None, "alias of n5") and len(rows) == 1000
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "ReusedExchange" in plan


def test_exchanges_carry_no_attributes_of_other_lookups(spark):
    """broadcasts and wide lookups come after the exchanges; columns keep the order asked for."""
    far = spark.range(50_000).selectExpr("id AS key", "concat('f', id) AS f", "concat('g', id) AS g")
    other = spark.range(50_000).selectExpr("id AS key", "concat('h', id) AS h")
    fact = spark.range(50_000).selectExpr("id", "id AS a", "id + 1 AS b")
    out = star_join(fact, [Lookup(far, "a", "key", {"f": "f", "g": "g"}), Lookup(other, "b", "key", {"h": "h"})], "merge")
    assert out.columns == ["id", "a", "b", "f", "g", "h"]
    assert out.where("f = concat('f', id) AND g = concat('g', id) AND (h = concat('h', id + 1) OR id = 49999)").count() == 50_000
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 2 and "a#" in joins[0] and "b#" in joins[1]  # the outermost is the wide one


def test_few_used_keys_of_a_large_table_are_broadcast(spark, monkeypatch):
    """a role of few keys needs no exchange, however large its table; one of many keys does."""
    monkeypatch.setattr(star, "BROADCAST_ROWS", 1000)
    zones = spark.range(5000).selectExpr("CAST(id AS INT) AS key", "concat('n', id) AS name")
    zones = zones.unionByName(zones.withColumn("name", F.concat(F.lit("a"), "name")))
    fact = spark.range(6000).selectExpr(
        "id", "CAST(IF(id % 401 = 400, NULL, IF(id % 401 = 399, -1, id % 401)) AS INT) AS a", "CAST(id AS INT) AS b")
    out = star_join(fact, [Lookup(zones, "a", "key", {"name": "a_name"}), Lookup(zones, "b", "key", {"name": "b_name"})])
    assert out.columns == ["id", "a", "b", "a_name", "b_name"]
    rows = {r["id"]: (r["a_name"], r["b_name"]) for r in out.collect()}
    assert len(rows) == 6000 and rows == {
        i: (f"an{i % 401}" if i % 401 < 399 else None, f"an{i}" if i < 5000 else None) for i in range(6000)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    left = [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftOuter" in x]
    assert len(left) == 1 and "b#" in left[0]


@pytest.mark.parametrize("strategy", ["auto", "merge"])
def test_a_planned_join_takes_parts_of_the_fact(monkeypatch, skewed, dim, strategy):
    """planned over the whole fact, joined by parts with the rows of large lookups kept meanwhile."""
    monkeypatch.setattr(star, "BROADCAST_ROWS", 10)
    plan = star.plan_star_join(skewed, [Lookup(dim, "k", "key", {"name": "name"})], strategy)
    assert [x.on for x in plan.moved] == ["k"]
    rows = []
    with plan.stored() as kept:
        (folder,) = {f.rsplit("/", 1)[0] for f in kept.lookups[0].dim.inputFiles()}
        for part in range(3):
            rows += kept.rows(skewed.where(F.col("id") % 3 == part)).select("id", "k", "name").collect()
    assert len(rows) == 9000 and {tuple(r) for r in rows} == expected(skewed)
    assert not Path(folder.removeprefix("file:")).exists()

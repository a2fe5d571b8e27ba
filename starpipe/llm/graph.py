"""Connected components by alternating star contractions, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import merge_lookup, stored


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours; hubs are summed before the exchange."""
    low = edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("low"))
    return merge_lookup(edges, low, ["u"], "inner")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _least(down)
    return starred.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
        starred.select("u", F.col("low").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of (u, v); stored.

    Loops and repeated edges do no harm; no edges give no rows. Every round is a written table;
    the number of rounds grows with the logarithm of the longest path.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
        seen = now.agg(F.count("u").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state == (seen["n"], seen["x"]):
            break
        state = (seen["n"], seen["x"])
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

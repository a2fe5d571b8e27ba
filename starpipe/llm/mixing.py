"""Mixing sources to target weights with hash-threshold histograms (operator 3).

Every document has a size and a hash of its content. A source's budget is met by taking all
documents whose hash is below a threshold. The threshold is found without sorting documents:
sizes are summed by source and leading hash bits, the bucket in which the running sum passes
the budget is found, and only the documents of that bucket are summed again by their next
bits. What passes one place is a histogram of a source; per-source totals are one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starpipe.llm.common import WORD, lookup, stored

HASH_BITS = 60
KEY_BYTES = 200


@dataclass(frozen=True)
class Mixture:
    """Sources by code point, null last, weigh `weights` in turn; none exceeds `repeats` times itself."""

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    level_bits: int = 12


def content_hash() -> Column:
    """60 bits of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key() -> Column:
    """A null source has the key `-`."""
    return F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source key, size and hash of each row."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("key"),
                       size.cast("long").alias("size"), content_hash().alias("h"))


def source_targets(sizes: DataFrame, mixture: Mixture) -> DataFrame:
    """key, source_size, target of each source of (key, size): weights with capped excess reshared.

    Sharing the excess again until nobody is above the cap ends at `min(cap, level * weight)` for
    one level. In ascending order of cap by weight, the capped sources come first, so the level
    follows from running sums.
    """
    cycle = len(mixture.weights)
    by_name = Window.orderBy(F.col("key").startswith("-"), "key")
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    weighed = totals.withColumn("place", (F.row_number().over(by_name) - 1) % cycle).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in mixture.weights]), F.col("place") + 1)
    ).withColumn("cap", F.col("source_size") * mixture.repeats)
    ascending = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, whole = ascending.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("left", left).withColumn("left_weight", weight).withColumn(
        "capped", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight")
    ).withColumn("level", F.min(F.when(~F.col("capped"), F.struct(
        F.col("cap") / F.col("weight"), "key", F.col("left") / F.col("left_weight")))).over(whole)["col3"])
    return level.select("key", "source_size", F.when(
        F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, mixture: Mixture) -> DataFrame:
    """key, whole copies, last hash and whether it is taken too, for stored measured rows."""
    plan = stored(targets.withColumn("copies", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    open_ = plan.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = HASH_BITS
    while done > 0:
        step = min(mixture.level_bits, done)
        done -= step
        inside = rows.where(F.col("size") > 0).withColumn("prefix", F.shiftright("h", done + step))
        inside = lookup(inside, open_, ["key", "prefix"], "inner", KEY_BYTES)
        histogram = inside.groupBy("key", F.shiftright("h", done).alias("prefix")).agg(
            F.sum("size").alias("held"), F.first("budget").alias("budget"), F.first("below").alias("base"))
        running = Window.partitionBy("key").orderBy("prefix")
        crossed = histogram.withColumn("upto", F.col("base") + F.sum("held").over(running)).where(
            (F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("held") <= F.col("budget")))
        open_ = stored(crossed.select("key", "budget", "prefix", (F.col("upto") - F.col("held")).alias("below"),
                                      "held"), "mix-bucket")
        if done:
            open_ = open_.drop("held")
    nearer = F.col("below") + F.col("held") - F.col("budget") < F.col("budget") - F.col("below")
    last = open_.select("key", F.col("prefix").alias("last_hash"), nearer.alias("take_last"))
    return stored(plan.join(last, "key", "left").select(
        "key", "source_size", "target", "copies", "last_hash", "take_last"), "mix-thresholds")


def mix(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of `docs` (doc_id, text, source).

    Size is the number of words, 0 for a null or empty text. A source without words has target 0.
    Rows equal in id and text share a hash, so they are taken together; the words taken of a
    source miss its target by at most half of one such group. Other columns are not read. No
    documents give no rows.
    """
    rows = stored(measured(docs), "mix-sizes")
    limits = thresholds(rows, source_targets(rows.select("key", "size"), mixture), mixture)
    joined = lookup(rows, limits, ["key"], "left", KEY_BYTES)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"))).alias("taken"))


def times(h: Column) -> Column:
    """How often a document of hash `h` is taken, next to its source's thresholds."""
    extra = (h < F.col("last_hash")) | ((h == F.col("last_hash")) & F.col("take_last"))
    return F.col("copies") + F.coalesce(extra, F.lit(False)).cast("long")


def mixed_rows(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; all columns stay, texts are not exchanged."""
    rows = stored(measured(docs), "mix-sizes")
    limits = thresholds(rows, source_targets(rows.select("key", "size"), mixture), mixture).select(
        F.col("key").alias("__key"), F.struct("copies", "last_hash", "take_last").alias("__limit"))
    keyed = docs.withColumn("__key", source_key()).withColumn("__h", content_hash())
    joined = lookup(keyed, limits, ["__key"], "inner", KEY_BYTES)
    extra = (F.col("__h") < F.col("__limit.last_hash")) | (
        (F.col("__h") == F.col("__limit.last_hash")) & F.col("__limit.take_last"))
    often = F.col("__limit.copies") + F.coalesce(extra, F.lit(False)).cast("long")
    return joined.select("*", F.explode(F.array_repeat(F.lit(1), often.cast("int"))).alias("__copy")).select(*docs.columns)


#: The same by sorting: every source's documents in hash order, up to the nearest end.
SQL = r"""
WITH m AS (
  SELECT doc_id::BIGINT AS doc_id, COALESCE('+' || source, '-') AS k,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || ':' || COALESCE(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT k, SUM(size)::BIGINT AS size FROM m GROUP BY k),
w AS (SELECT k, size, 3 * size AS cap,
             (ROW_NUMBER() OVER (ORDER BY k = '-', encode(k)) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, SUM(size) OVER () - COALESCE(SUM(cap) OVER b, 0) AS lft,
             SUM(weight) OVER () - COALESCE(SUM(weight) OVER b, 0) AS lw
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * lw <= lft * weight AS capped FROM o),
t AS (SELECT k, size AS source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (
        SELECT lft::DOUBLE / lw::DOUBLE FROM c WHERE NOT capped ORDER BY cap::DOUBLE / weight, k LIMIT 1)
        END AS target FROM c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
g AS (SELECT k, h, SUM(size) AS held FROM m WHERE size > 0 GROUP BY k, h),
r AS (SELECT g.k, h, held, SUM(held) OVER (PARTITION BY g.k ORDER BY h) AS upto,
             target - copies * source_size AS budget FROM g JOIN b ON g.k = b.k),
x AS (SELECT k, h FROM r WHERE upto <= budget
      OR (upto - held <= budget AND upto - budget < budget - (upto - held)))
SELECT m.doc_id, m.size, b.source_size, b.target,
       (m.size * (b.copies + (x.h IS NOT NULL)::BIGINT))::BIGINT AS taken
FROM m JOIN b ON m.k = b.k LEFT JOIN x ON m.k = x.k AND m.h = x.h
"""

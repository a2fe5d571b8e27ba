"""What quality filters remove in every order they can be applied in (operator 11).

One pass over the texts gives each document a mask of the filters it fails. Each mask (with the
marks good and toxic) stands for one wide integer: 64-bit fields for every step of every order and
every count of a step, each 0 or 1. Tasks add up the integers of each part; the sums are added
in two levels and then cut into their fields. A field is the number of some documents, which
64 bits hold, so no field overflows into the next one.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import byte_slices, merge_lookup, python_tasks, stored

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELDS = len(ORDERS) * STEPS
GOOD, TOXIC = 1 << STEPS, 2 << STEPS
MARKS = frozenset("#$%&*|")
UPPER = bytes(range(65, 91))
#: Parts that a task adds up at once; further ones are handed on and begun anew.
HELD_PARTS = 256

MASKED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])
SUMS = pa.schema([("part", pa.string()), ("lane", pa.int32()), ("sum", pa.binary())])
REPORT_TYPES = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
REPORT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                    *((c, pa.int64()) for c in (*COUNTS, "shapley"))])


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # on the six ASCII white spaces exactly
    upper = len(raw) - len(raw.translate(None, UPPER))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 3 * len(text),
             not MARKS.isdisjoint(text))
    return sum(1 << k for k, f in enumerate(fails) if f)


def _masks(batches):
    for batch in byte_slices(batches, "text", 1 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("part"), pa.array(map(text_mask, texts), pa.int32()),
            pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts], pa.binary())], schema=MASKED)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of each row of `docs` (doc_id, text, lang); bit k is the k-th of FILTERS.

    Texts are equal if their 128-bit digests are. A null id is larger than none, so its row never
    fails E; rows that share an id and a text do not make each other fail.
    """
    python_tasks(docs.sparkSession)
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text",
                             "coalesce(CAST(lang AS STRING), '') AS part")
    found = stored(narrow.mapInArrow(_masks, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    first = stored(found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("mask").alias("n"))
                   .where("n > 1").select("digest", "first"), "audit-copies")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return merge_lookup(found, first, ["digest"], "left").select(
        "doc_id", "part", F.when(again, F.col("mask").bitwiseOR(1 << FILTERS.index("E"))).otherwise(F.col("mask")).alias("mask"))


# --- Wide integers -------------------------------------------------------------------------

@cache
def packed(code: int) -> int:
    """The integer of a document: its mask with the bits GOOD and TOXIC."""
    mask, fields = code & (GOOD - 1), np.zeros((len(COUNTS), len(ORDERS), STEPS), "<u8")
    for o, order in enumerate(ORDERS):
        before = 0
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails, gone = bool(mask & bit), bool(mask & before)
            before |= bit
            removed = fails and not gone
            fields[:, o, s] = (not mask & before, removed, fails and gone, mask == bit,
                               removed and bool(code & GOOD), removed and bool(code & TOXIC))
    return int.from_bytes(fields.tobytes(), "little")


def as_bytes(total: int) -> bytes:
    return total.to_bytes(len(COUNTS) * FIELDS * 8, "little")


def unpacked(total: int) -> np.ndarray:
    """Counts by kind, order and step."""
    return np.frombuffer(as_bytes(total), "<u8").reshape(len(COUNTS), len(ORDERS), STEPS).astype(np.int64)


def _task_sums(lanes: int):
    def rows(batches):
        lane = TaskContext.get().partitionId() % lanes
        held: dict[str, int] = {}

        def handed():
            return pa.RecordBatch.from_arrays([
                pa.array(held, pa.string()), pa.array([lane] * len(held), pa.int32()),
                pa.array(map(as_bytes, held.values()), pa.binary())], schema=SUMS)

        for batch in batches:
            found = Counter(zip(batch.column("part").to_pylist(), batch.column("code").to_pylist()))
            for (part, code), n in found.items():
                held[part] = held.get(part, 0) + n * packed(code)
                if len(held) >= HELD_PARTS:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    return rows


def _total(sums: pa.Table) -> int:
    return sum(int.from_bytes(b.as_py(), "little") for b in sums.column("sum"))


def _lane_sum(sums: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([sums.column("part")[:1], sums.column("lane")[:1],
                                 pa.array([as_bytes(_total(sums))], pa.binary())], schema=SUMS)


def _report(sums: pa.Table) -> pa.Table:
    counts = unpacked(_total(sums))
    name = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    removed = counts[COUNTS.index("removed")]
    shapley = np.array([removed[name == f].sum() for f in range(STEPS)])
    part = sums.column("part")[0].as_py()
    return pa.Table.from_arrays([
        pa.array([part] * FIELDS), pa.array(np.repeat(ORDERS, STEPS)),
        pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32()),
        *(pa.array(c.ravel()) for c in counts), pa.array(shapley[name].ravel())], schema=REPORT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts of a step, shapley: of `docs` (doc_id, text, lang).

    A null lang is the part of the empty string, a null text is empty. `labels` (doc_id, quality,
    toxic) may lack documents, repeat them (one row with a mark is enough) and hold nulls. Repeated
    rows count each; other columns are not read. No documents give no rows.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic"))
    code = F.col("mask") + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))
    coded = merge_lookup(masks(docs), marks, ["doc_id"], "left").select("part", code.cast("int").alias("code"))
    # As many lanes as the root of the tasks: no task adds up the sums of all others.
    lanes = math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    sums = coded.mapInArrow(_task_sums(lanes), "part string, lane int, sum binary")
    by_lane = sums.groupBy("part", "lane").applyInArrow(_lane_sum, "part string, lane int, sum binary")
    return by_lane.groupBy("part").applyInArrow(_report, REPORT_TYPES)


SQL = r"""
WITH w AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t,
                  regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * COALESCE(doc_id > MIN(doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, i::INTEGER AS step, bit, f,
             COALESCE(SUM(bit) OVER (PARTITION BY filter_order ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before
      FROM o, range(1, 6) r(i), f WHERE f.f = substr(filter_order, i, 1)),
x AS (SELECT part, filter_order, step, f,
        COALESCE(SUM(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
        COALESCE(SUM(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
        COALESCE(SUM(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
        COALESCE(SUM(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        COALESCE(SUM(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
        COALESCE(SUM(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       SUM(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM x
"""

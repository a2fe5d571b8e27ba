"""Removal of repeated byte strings by two-stage suffix sorting (operator 10).

A string of `length` bytes holds an anchor: the leftmost least of its grams by hash. The anchor
depends on the string alone, so equal strings meet under the same anchor. Each start of a string
belongs to one anchor, and an anchor's starts with all their strings form one region of the
text. Anchors seen once end there. Regions that agree in every byte are counted, not compared.
For the rest, one copy of each region goes to the others of its anchor, and the suffixes there
are sorted in two stages: only suffixes smaller than their successor are sorted directly, the
others follow by scanning the buckets of their first bytes. Adjacent common prefixes tell which
strings occur twice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import byte_slices, merge_lookup, python_tasks, stored
from starpipe.llm.jaccard import MIX, _powers, mixed

PLACE_BITS = 23


@dataclass(frozen=True)
class Repeats:
    """Strings of `length` bytes; `gram` is the size of an anchor.

    `unit_bytes` is the text that a task sorts at once. An anchor with more than `crowd` different
    regions is not sorted in one task: its strings are grouped by digest over all tasks. `slots`
    bounds the prefilters.
    """

    length: int = 400
    gram: int = 128
    unit_bytes: int = 1 << 20
    crowd: int = 4096
    slots: int = 1 << 20


class Hashes:
    """Polynomial hashes of all substrings of one text."""

    def __init__(self, text: bytes):
        flat = np.frombuffer(text, np.uint8)
        up, self.down = _powers(len(flat) + 1)
        self.value = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) * MIX + MIX) * up[:len(flat)], out=self.value[1:], dtype=np.uint64)

    def of(self, start, end):
        return mixed((self.value[end] - self.value[start]) * self.down[start])


def anchors(hashes: Hashes, size: int, config: Repeats):
    """Of each anchor: its gram's hash, its place, and the first and past-the-last start it has."""
    window = config.length - config.gram + 1
    value = hashes.of(np.arange(size - config.gram + 1), np.arange(config.gram, size + 1))
    starts, step, found = size - config.length + 1, 1 << (PLACE_BITS - 1), []
    for at in range(0, starts, step):
        part = value[at:at + step + window - 1]
        # The place breaks ties, so among equal grams the leftmost is the least.
        key = (part >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        n = len(part) - window + 1
        blocks = np.concatenate([key, np.full(-len(key) % window, ~np.uint64(0))]).reshape(-1, window)
        upto = np.minimum.accumulate(blocks, 1).ravel()
        onward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(onward[:n], upto[window - 1:window - 1 + n])
        place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((at + place[first], at + first, at + np.append(first[1:], n)))
    place, first, past = (np.concatenate(c) for c in zip(*found))
    return value[place], place, first, past


ANCHORS = pa.schema([("token", pa.int64()), ("region", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()),
                     ("first", pa.int32()), ("starts", pa.int32()), ("doc_id", pa.int64())])
ANCHOR_TYPES = "token long, region long, key long, n_bytes long, first int, starts int, doc_id long"


def _anchors(config: Repeats):
    def rows(batches):
        seen: set[int] = set()
        for batch in byte_slices(batches, "text", 1 << 20):
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            ids: list[int | None] = []
            for doc_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "key"))):
                raw = text.encode()
                if len(raw) < config.length or key in seen:
                    continue
                seen.add(key)
                hashes = Hashes(raw)
                token, place, first, past = anchors(hashes, len(raw), config)
                region = hashes.of(first, past + config.length - 1) ^ mixed((place - first).astype(np.uint64))
                for column, value in zip(columns, (token.view(np.int64), region.view(np.int64), np.full(len(token), key, np.int64),
                                                   np.full(len(token), len(raw), np.int64), first.astype(np.int32),
                                                   (past - first).astype(np.int32))):
                    column.append(value)
                ids += [doc_id] * len(token)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(c)) for c in columns), pa.array(ids, pa.int64())], schema=ANCHORS)

    return rows


# --- Two-stage suffix sorting ---------------------------------------------------------------

def _direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes `at` in the order of their first `depth` bytes, eight by eight.

    Only groups that are still equal and do not agree in the next word are sorted further.
    """
    order = at[np.argsort(words[at], kind="stable")]
    word = words[order]
    group = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) if len(at) else np.zeros(0, np.int64)
    where = np.arange(len(at))
    for offset in range(8, depth, 8):
        if not len(where):
            break
        alone = np.concatenate([[True], group[1:] != group[:-1]]) & np.concatenate([group[1:] != group[:-1], [True]])
        where, group = where[~alone], group[~alone]
        if not len(where):
            break
        word = words[order[where] + offset]
        differs = np.concatenate([[False], (word[1:] != word[:-1]) & (group[1:] == group[:-1])])
        if not differs.any():
            continue
        mixed_groups = np.zeros(group[-1] + 1, bool)
        mixed_groups[group[differs]] = True
        pick = np.flatnonzero(mixed_groups[group])
        by = np.lexsort((word[pick], group[pick]))
        order[where[pick]] = order[where[pick]][by]
        word[pick] = word[pick][by]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (word[1:] != word[:-1])]))
    return order


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that `wanted` marks, in order of their first `depth` symbols, and the words of `text`.

    `text` has bytes plus one, and 0 where a region ends; wanted suffixes have `depth` symbols.
    """
    n = len(text)
    padded = np.concatenate([np.minimum(text, 255).astype(np.uint8), np.zeros(depth + 8, np.uint8)])
    words = np.zeros(n + depth, np.uint64)
    for k in range(8):  # in place: these arrays are the largest here
        np.left_shift(words, np.uint64(8), out=words)
        np.bitwise_or(words, padded[k:k + n + depth], out=words)
    del padded
    # A suffix is small if its first different symbol is larger than its first.
    places = np.arange(n, dtype=np.int32)
    run_end = np.where(np.append(text[1:] != text[:-1], True), places, np.int32(n))
    run_end = np.minimum.accumulate(run_end[::-1])[::-1]
    small = (np.append(text, 0)[run_end + 1] > text) | (text == 0)
    # Larger suffixes need their successors, up to the next small one.
    needed = wanted.copy()
    next_small = np.where(small, places, np.int32(n))
    next_small = np.minimum.accumulate(next_small[::-1])[::-1]
    del places
    reach = np.zeros(n + 2, np.int32)
    tails = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    np.add.at(reach, tails, 1)
    np.add.at(reach, np.minimum(next_small[tails], n - 1) + 1, -1)
    del next_small
    needed |= np.cumsum(reach, dtype=np.int32)[:n] > 0
    del reach

    sorted_small = _direct(words, np.flatnonzero(needed & small).astype(np.int32), depth)
    rank = np.zeros(n + 1, np.int32)
    small_from = np.searchsorted(text[sorted_small], np.arange(258))
    large = np.flatnonzero(needed & ~small).astype(np.int32)
    level = run_end[large] - large
    by = np.lexsort((level, text[large]))
    large, level = large[by], level[by]
    cut = np.flatnonzero((np.diff(text[large].astype(np.int64)) != 0) | (np.diff(level) != 0)) + 1
    runs = np.split(large, cut) if len(large) else []
    by_symbol: dict[int, list[np.ndarray]] = {}
    for run in runs:
        by_symbol.setdefault(int(text[run[0]]), []).append(run)
    order, done = [], 0
    for symbol in range(257):
        # Larger suffixes come first in a bucket, shorter runs of its symbol before longer ones.
        for run in by_symbol.get(symbol, ()):
            run = run[np.argsort(rank[run + 1], kind="stable")]
            rank[run] = np.arange(done, done + len(run), dtype=np.int32)
            order.append(run)
            done += len(run)
        block = sorted_small[small_from[symbol]:small_from[symbol + 1]]
        rank[block] = np.arange(done, done + len(block), dtype=np.int32)
        order.append(block)
        done += len(block)
    return np.concatenate(order), words


def repeated_starts(regions: list[bytes], starts: list[int], length: int) -> np.ndarray:
    """Places in the joined regions (each followed by one end mark) whose string occurs twice."""
    sizes = np.array([len(r) for r in regions], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    inside = np.ones(len(text), bool)
    inside[begins + sizes] = False
    text[inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.uint16) + 1
    wanted = np.zeros(len(text) + 1, np.int32)
    np.add.at(wanted, begins, 1)
    np.add.at(wanted, begins + np.array(starts), -1)
    wanted = np.cumsum(wanted, dtype=np.int32)[:-1] > 0
    order, words = suffix_order(text, wanted, length)
    order = order[wanted[order]]
    one, two = order[:-1], order[1:]
    equal = np.arange(len(one))
    for offset in [*range(0, length - 8, 8), length - 8]:
        equal = equal[words[one[equal] + offset] == words[two[equal] + offset]]
    # Words hold 255 for the two highest bytes; those never occur in UTF-8.
    return np.unique(np.concatenate([one[equal], two[equal]])).astype(np.int64)


COVERED = pa.schema([("token", pa.int64()), ("region", pa.int64()), ("start", pa.int32()), ("past", pa.int32())])
COVERED_TYPES = "token long, region long, start int, past int"


def _stretches(places: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first place and end of the bytes that ascending string starts cover together."""
    if not len(places):
        return owner, places, places
    cut = np.concatenate([[True], (np.diff(places) > length) | (np.diff(owner) != 0)])
    last = np.append(np.flatnonzero(cut)[1:] - 1, len(places) - 1)
    return owner[cut], places[cut], places[last] + length


def _solve(config: Repeats):
    def solve(unit: pa.Table) -> pa.Table:
        held: dict[tuple[int, int], tuple[bytes, int]] = {}
        for token, region, text, starts in zip(*(unit.column(c).to_pylist() for c in ("token", "region", "bytes", "starts"))):
            held[token, region] = text, starts
        names = list(held)
        regions, starts = [held[k][0] for k in names], [held[k][1] for k in names]
        places = repeated_starts(regions, starts, config.length)
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in regions])])
        owner = np.searchsorted(begins, places, side="right") - 1
        owner, first, past = _stretches(places, owner, config.length)
        return pa.Table.from_arrays([
            pa.array([names[k][0] for k in owner], pa.int64()), pa.array([names[k][1] for k in owner], pa.int64()),
            pa.array((first - begins[owner]).astype(np.int32)), pa.array((past - begins[owner]).astype(np.int32))],
            schema=COVERED)

    return solve


def _strings(config: Repeats):
    """Digests of the strings of crowded regions."""
    schema = pa.schema([("token", pa.int64()), ("region", pa.int64()), ("start", pa.int32()), ("string", pa.int64())])

    def rows(batches):
        for batch in byte_slices(batches, "bytes", 1 << 18):
            for token, region, text, starts in zip(*(batch.column(c).to_pylist() for c in ("token", "region", "bytes", "starts"))):
                at = np.arange(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(starts, token, np.int64)), pa.array(np.full(starts, region, np.int64)),
                    pa.array(at.astype(np.int32)), pa.array(Hashes(text).of(at, at + config.length).view(np.int64))],
                    schema=schema)

    return rows


def _regions(config: Repeats):
    schema = pa.schema([("token", pa.int64()), ("region", pa.int64()), ("starts", pa.int32()), ("crowded", pa.bool_()),
                        ("bytes", pa.binary())])

    def rows(batches):
        for batch in byte_slices(batches, "text", 1 << 20):
            out = []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                raw = text.encode()
                out += [(a["token"], a["region"], a["starts"], a["crowded"],
                         raw[a["first"]:a["first"] + a["starts"] + config.length - 1]) for a in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("removed", pa.string())])


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of a union of (start, past)."""
    out: list[list[int]] = []
    for start, past in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([start, past])
    return [(a, b) for a, b in out]


def _finish(batches):
    for batch in byte_slices(batches, "text", 1 << 20):
        out = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            raw, at, digest = (text or "").encode(), 0, hashlib.sha256()
            gone = merged((s["start"], s["past"]) for s in spans or ())
            for start, past in gone:
                digest.update(raw[at:start])
                at = past
            digest.update(raw[at:])
            out.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), digest.hexdigest(),
                        ",".join(f"{a}:{b}" for a, b in gone)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), REMOVED)], schema=REMOVED)


def _in_slots(rows: DataFrame, wanted: DataFrame, slots: int) -> DataFrame:
    """Rows whose key may be among those of `wanted`: at most `slots` rows are broadcast."""
    slot = F.pmod(F.col("key"), F.lit(slots))
    return rows.withColumn("slot", slot).join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")


def covered(texts: DataFrame, found: DataFrame, config: Repeats) -> DataFrame:
    """token, region, start, past: what of a region other places repeat. `found` has all anchors."""
    several = stored(found.groupBy("token").agg(
        F.count("region").alias("n"), F.min("region").alias("low"), F.max("region").alias("high")).where("n > 1")
        .select("token", (F.col("low") != F.col("high")).alias("contested")), "repeat-anchors")
    # Copies of a text in several tasks bring the same anchors; one copy stands for all.
    # Dealt anew for that, so that the join may split a token of many places.
    again = stored(merge_lookup(found, several, ["token"], "inner").repartition("key", "first").dropDuplicates(
        ["key", "n_bytes", "token", "first"]), "repeat-occurrences")
    one = F.struct("key", "n_bytes", "first", "starts", "doc_id")
    regions = stored(again.groupBy("token", "region", "contested").agg(
        F.count("key").alias("n"), F.min(one).alias("one")), "repeat-regions")
    whole = regions.where("n > 1").select(
        "token", "region", F.lit(0).alias("start"), (F.col("one.starts") + config.length - 1).cast("int").alias("past"))

    contested = regions.where("contested")
    crowds = stored(contested.groupBy("token").agg(F.count("region").alias("m")).where(F.col("m") > config.crowd)
                    .select("token", F.lit(True).alias("crowded")), "repeat-crowds")
    marked = merge_lookup(contested, crowds, ["token"], "left")
    asked = stored(marked.groupBy("one.key", "one.n_bytes", "one.doc_id").agg(F.collect_list(F.struct(
        "token", "region", F.col("one.first").alias("first"), F.col("one.starts").alias("starts"),
        F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("asked")), "repeat-asked")
    near = _in_slots(texts, asked, config.slots)
    same = (near["key"] == asked["key"]) & (near["n_bytes"] == asked["n_bytes"]) & near["doc_id"].eqNullSafe(asked["doc_id"])
    cut = stored(near.join(asked.hint("merge"), same).select("text", "asked").mapInArrow(
        _regions(config), "token long, region long, starts int, crowded boolean, bytes binary"), "repeat-bytes")

    sort = cut.where("NOT crowded")
    held = sort.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("b")).first()["b"]
    unit = F.pmod(F.xxhash64("token"), F.lit(held // config.unit_bytes + 1))
    solved = sort.withColumn("unit", unit).groupBy("unit").applyInArrow(_solve(config), COVERED_TYPES)

    strings = cut.where("crowded").mapInArrow(_strings(config), "token long, region long, start int, string long")
    strings = stored(strings.dropDuplicates(["token", "region", "start"]), "repeat-strings")
    twice = strings.groupBy("token", "string").agg(F.count("start").alias("n")).where("n > 1").select("token", "string")
    crowd = merge_lookup(strings, twice, ["token", "string"], "inner").select(
        "token", "region", "start", (F.col("start") + config.length).cast("int").alias("past"))
    parts = whole.unionByName(solved).unionByName(crowd).groupBy("token", "region").agg(
        F.collect_list(F.struct("start", "past")).alias("parts"))
    spans = merge_lookup(again, stored(parts, "repeat-parts"), ["token", "region"], "inner")
    return spans.select("key", "n_bytes", F.explode(F.transform("parts", lambda p: F.struct(
        (F.col("first") + p["start"]).alias("start"), (F.col("first") + p["past"]).alias("past")))).alias("span"))


def remove_repeats(docs: DataFrame, config: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed of each row of `docs` (doc_id, text).

    Every byte that lies in a string of `length` bytes which also starts elsewhere, in any row or
    the same one, is removed; `removed` lists start:past of the runs in bytes. Repeated rows
    remove each other. A null text is empty; texts shorter than `length` lose nothing; other
    columns are not read. No documents give no rows.
    """
    python_tasks(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "*", F.xxhash64("text").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    long_ = texts.where(F.col("n_bytes") >= config.length)
    found = stored(long_.select("doc_id", "text", "key").mapInArrow(_anchors(config), ANCHOR_TYPES), "anchors")
    copies = long_.groupBy("key", "n_bytes").agg(F.count("key").alias("n")).where("n > 1").select(
        "key", "n_bytes", F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("past")).alias("span"))
    spans = covered(long_, found, config).unionByName(copies)
    gone = stored(spans.groupBy("key", "n_bytes").agg(F.collect_list("span").alias("spans")), "repeat-spans")
    joined = merge_lookup(texts, gone, ["key", "n_bytes"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string")

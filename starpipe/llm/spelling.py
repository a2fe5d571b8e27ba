"""Grouping of spelling variants by Bloom-guided neighbourhoods (operator 13).

Words are counted with sums per task. Two words one edit apart differ by a replaced code point or
by one that the shorter lacks, so each word generates its deletions and the replacements by a larger
code point; an insertion is the deletion seen from the other side. The edits are probed against
blocked Bloom filters of the vocabulary, one shard per word length, and only positives are
exchanged: a join with the vocabulary finds the words behind them, and the edit distance
of both words decides. Filters of one pass have a fixed size; a larger vocabulary takes more passes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import byte_slices, merge_lookup, python_tasks, stored
from starpipe.llm.jaccard import INVERSE, _powers, mixed

#: Letters as Latin-1 bytes, A to Z in lower case; all else separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
VOCABULARY = pa.schema([("word", pa.string()), ("n", pa.int64()), ("size", pa.int32()), ("hash", pa.int64())])
VOCABULARY_TYPES = "word string, n long, size int, hash long"
BITS = pa.schema([("segment", pa.int64()), ("block", pa.int64()), ("bits", pa.int64())])
SEGMENTS = pa.schema([("segment", pa.int64()), ("bytes", pa.binary())])
CANDIDATES = pa.schema([("edit", pa.int64()), ("source", pa.int64())])
SEGMENT = 4096  # blocks


@dataclass(frozen=True)
class Variants:
    """Words of `least_size` code points and `least_n` occurrences; one deletion in `typo` runs.

    A form occurs at least `factor` times as often. A shard has a 64-bit block for `block_words`
    words; the filters of one pass, which are broadcast, take `filter_bytes` at most. `held_bytes`
    bounds the words that a task counts at once, `cells` the edits it probes at once.
    """

    least_size: int = 5
    least_n: int = 3
    typo: int = 97
    factor: int = 2
    block_words: int = 4
    filter_bytes: int = 16 << 20
    held_bytes: int = 24 << 20
    cells: int = 1 << 16


def runs(doc_id: int | None, text: str | None, config: Variants) -> Counter[bytes]:
    """Words of a text as Latin-1 bytes, after the deletions; how often each occurs."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[bytes] = Counter()
    for run, n in Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % config.typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= config.least_size:
            out[run] += n
    return out


def _count(config: Variants):
    def rows(batches):
        held: dict[bytes, int] = {}
        size = 0

        def handed():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                               pa.array(held.values(), pa.int64())], schema=COUNTED)

        for batch in byte_slices(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in runs(doc_id, text, config).items():
                    if word not in held:
                        size += len(word) + 100
                    held[word] = held.get(word, 0) + n
                if size > config.held_bytes:
                    yield handed()
                    held.clear()
                    size = 0
        if held:
            yield handed()

    return rows


def _by_size(batch: pa.RecordBatch):
    """Size, code points and row numbers of the words of each size."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), size), rows


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return mixed((VALUE[codes] * _powers(codes.shape[1])[0][:codes.shape[1]]).sum(1, dtype=np.uint64))


def _hashed(batches):
    for batch in byte_slices(batches, "word", 1 << 20):
        hashes, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
        for size, codes, rows in _by_size(batch):
            hashes[rows], sizes[rows] = word_hashes(codes), size
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(sizes),
                                          pa.array(hashes.view(np.int64))], schema=VOCABULARY)


def vocabulary(docs: DataFrame, config: Variants = Variants()) -> DataFrame:
    """word, n, size, hash of the words of `docs` (doc_id, text); stored."""
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    counted = narrow.mapInArrow(_count(config), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= config.least_n).mapInArrow(_hashed, VOCABULARY_TYPES), "spelling-words")


# --- Filters ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Shard:
    """Words of one size, or one slice of them, from block `start` on in the filters of a pass."""

    size: int
    slices: int
    slice: int
    start: int
    blocks: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * VALUE[0] >> np.uint64(40)) % np.uint64(self.slices) == self.slice

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of each hash."""
        block = (hashes >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)
        bits = np.zeros(len(hashes), np.uint64)
        for k in range(4):
            bits |= np.uint64(1) << (hashes >> np.uint64(6 * k) & np.uint64(63))
        return block.astype(np.int64) + self.start, bits


def passes(counts: dict[int, int], config: Variants) -> list[list[Shard]]:
    """Shards of all word sizes, dealt to passes whose filters stay within their bound."""
    most = config.filter_bytes // 8
    out: list[list[Shard]] = []
    used = most
    for size, n in sorted(counts.items()):
        blocks = math.ceil(n / config.block_words)
        slices = math.ceil(blocks / most)
        for k in range(slices):
            part = math.ceil(blocks / slices)
            if used + part > most:
                out.append([])
                used = 0
            out[-1].append(Shard(size, slices, k, used, part))
            used += part
    return out


def _bits(shards: dict[int, list[Shard]]):
    def rows(batches):
        for batch in batches:
            size, hashes = batch.column("size").to_numpy(), batch.column("hash").to_numpy().view(np.uint64)
            for s in np.unique(size):
                for shard in shards[int(s)]:
                    own = hashes[size == s]
                    block, bits = shard.places(own[shard.holds(own)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (block // SEGMENT, block % SEGMENT, bits.view(np.int64))], schema=BITS)

    return rows


def _segment(unit: pa.Table) -> pa.Table:
    blocks = np.zeros(SEGMENT, np.uint64)
    np.bitwise_or.at(blocks, unit.column("block").to_numpy(), unit.column("bits").to_numpy().view(np.uint64))
    return pa.Table.from_arrays([unit.column("segment")[:1], pa.array([blocks.tobytes()], pa.binary())], schema=SEGMENTS)


def filters(words: DataFrame, shards: list[Shard]) -> np.ndarray:
    """The blocks of one pass; at most its fixed bytes reach the driver."""
    by_size: dict[int, list[Shard]] = {}
    for shard in shards:
        by_size.setdefault(shard.size, []).append(shard)
    of_pass = words.where(F.col("size").isin(*by_size)).select("size", "hash")
    found = of_pass.mapInArrow(_bits(by_size), "segment long, block long, bits long").groupBy("segment").applyInArrow(
        _segment, "segment long, bytes binary").toArrow()
    blocks = np.zeros(-(-(shards[-1].start + shards[-1].blocks) // SEGMENT) * SEGMENT, np.uint64)
    for k, raw in zip(found.column("segment").to_pylist(), found.column("bytes").to_pylist()):
        blocks[k * SEGMENT:(k + 1) * SEGMENT] = np.frombuffer(raw, np.uint64)
    return blocks


def edits(codes: np.ndarray, alphabet: list[int]):
    """(size, row numbers, hashes) of the deletions, then of the replacements by each larger symbol."""
    n, size = codes.shape
    up = _powers(size)[0][:size]
    value = VALUE[codes]
    terms = value * up
    before = np.cumsum(terms, 1, dtype=np.uint64) - terms
    whole = terms.sum(1, dtype=np.uint64)[:, None]
    # Of a run of one symbol the last place stands for all.
    distinct = np.ones((n, size), bool)
    distinct[:, :-1] = codes[:, 1:] != codes[:, :-1]
    gone = before + (whole - before - terms) * np.uint64(INVERSE)
    yield size - 1, np.nonzero(distinct)[0], mixed(gone[distinct])
    for symbol in alphabet:
        smaller = codes < symbol
        rows, places = np.nonzero(smaller)
        yield size, rows, mixed(whole[rows, 0] + (VALUE[symbol] - value[smaller]) * up[places])


def _probe(shared, shards: list[Shard], alphabet: list[int], config: Variants):
    by_size: dict[int, list[Shard]] = {}
    for shard in shards:
        by_size.setdefault(shard.size, []).append(shard)

    def rows(batches):
        blocks = shared.value
        for batch in byte_slices(batches, "word", 1 << 20):
            source = batch.column("hash").to_numpy()
            for size, codes, at in _by_size(batch):
                if size not in by_size and size - 1 not in by_size:
                    continue
                step = max(1, config.cells // size)
                for k in range(0, len(at), step):
                    for target, row, hashes in edits(codes[k:k + step], alphabet):
                        for shard in by_size.get(target, ()):
                            own = np.flatnonzero(shard.holds(hashes)) if shard.slices > 1 else slice(None)
                            block, bits = shard.places(hashes[own])
                            hit = blocks[block] & bits == bits
                            if hit.any():
                                yield pa.RecordBatch.from_arrays([
                                    pa.array(hashes[own][hit].view(np.int64)), pa.array(source[at[k + row[own][hit]]])], schema=CANDIDATES)

    return rows


def near_words(words: DataFrame, config: Variants = Variants()) -> DataFrame:
    """word, n, near, near_n: each word of a stored vocabulary with every word one edit away."""
    spark = words.sparkSession
    counts = {r["size"]: r["n"] for r in words.groupBy("size").agg(F.count("word").alias("n")).collect()}
    symbols = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    alphabet = sorted(ord(r["c"]) for r in symbols.collect() if r["c"])  # of 90 letters
    found = []
    for shards in passes(counts, config):
        shared = spark.sparkContext.broadcast(filters(words, shards))
        sizes = {s.size for s in shards} | {s.size + 1 for s in shards}
        found.append(stored(words.where(F.col("size").isin(*sizes)).select("word", "hash").mapInArrow(
            _probe(shared, shards, alphabet, config), "edit long, source long"), "spelling-positives"))
    if not found:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    positives = found[0]
    for other in found[1:]:
        positives = positives.unionByName(other)
    # Words that share a hash all come along; the distance of the words themselves decides.
    near = words.select(F.col("hash").alias("edit"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    own = words.select(F.col("hash").alias("source"), "word", "n")
    met = merge_lookup(merge_lookup(positives.distinct(), near, ["edit"], "inner"), own, ["source"], "inner")
    pairs = stored(met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n"), "spelling-pairs")
    return pairs.unionByName(pairs.selectExpr("near AS word", "near_n AS n", "word AS near", "n AS near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of a stored (word, form); stored.

    A form is more frequent than its word, so forms end. Each round doubles the steps taken.
    """
    now = forms.selectExpr("word", "form AS root")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(merge_lookup(now, onward, ["root"], "left").selectExpr(
            "word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, config: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of `docs` (doc_id, text).

    A null text has no words; a null doc_id counts as an empty name. Repeated rows count each.
    Among forms of equal count the smallest in code-point order is taken. Words of any length
    take part; other columns are not read. No words give no rows.
    """
    python_tasks(docs.sparkSession)
    words = vocabulary(docs, config)
    best = near_words(words, config).groupBy("word", "n").agg(
        F.count("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    often = -F.col("best.m") >= config.factor * F.col("n")
    linked = stored(best.select("word", "n_near", F.when(often, F.col("best.near")).alias("form"),
                                F.when(often, -F.col("best.m")).alias("form_n")), "spelling-forms")
    top = roots(linked.where("form IS NOT NULL").select("word", "form"))
    whole = merge_lookup(merge_lookup(words, linked, ["word"], "left"), top, ["word"], "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                        F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")

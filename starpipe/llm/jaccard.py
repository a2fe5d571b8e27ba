"""Jaccard join of word n-gram sets with several global orders (operator 9).

A document is its set of distinct shingles; equal sets are one class. Two sets that are similar
enough share a token among the first few of each set in ANY global order of the tokens. So
prefixes are taken in two orders (both put known frequent tokens last, then by different
hashes), and a pair is only compared if it shares prefix tokens in both. To find such pairs
without listing them, the sets that share a prefix token are named by one of them, their centre;
sets that meet under the same pair of centres form a unit. Parity bits of the sets, which bound their
difference from below, leave those with a possible partner, and their texts are joined locally.
A unit
gives a spanning forest of its links instead of all of them; components are found from those.
Large units are cut into blocks. Each block is solved by itself first, beside a few sets that all
blocks of the unit get; then only the sets outside the unit's largest component meet the other
blocks, so that a group of copies is not sent to every pair of its blocks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starpipe.llm.common import byte_slices, merge_lookup, python_tasks, stored
from starpipe.llm.graph import components

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
ORDER_SEEDS = (np.uint64(0), np.uint64(0xA5A5A5A5C3C3C3C3))
SETS = pa.schema([*((c, pa.int64()) for c in ("kind", "doc_id", "n", "high", "low", "mark")), ("parity", pa.binary())])
PREFIXES = pa.schema([("in_order", pa.int32()), ("token", pa.int64()), ("set", pa.int64()), ("n", pa.int32()),
                      ("band", pa.int32())])
UNIT = ["c1", "c2", "one", "two"]
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


@dataclass(frozen=True)
class Similarity:
    """Sets of `words`-word shingles link when `of * intersection >= at_least * union`.

    `frequent` bounds the list of frequent tokens (it only affects the order, never a result),
    `slots` the prefilter of candidate documents, `unit_words` and `unit_sets` the size of a block.
    About `hubs` sets of a large unit go to each of its blocks. Tokens counted more than `hot` times
    are not walked in one task. None of these changes a result.
    """

    words: int = 4
    at_least: int = 85
    of: int = 100
    frequent: int = 1 << 18
    held: int = 1 << 22
    slots: int = 1 << 20
    unit_words: int = 1 << 20
    unit_sets: int = 4096
    hubs: int = 8
    hot: int = 20_000

    def overlap(self, n):
        """Least intersection of a set of n with a similar one."""
        return (self.at_least * n + self.of - 1) // self.of

    def prefix(self, n):
        return n - self.overlap(n) + 1

    def band(self, n: int) -> int:
        """Sizes of similar sets are of one band or of two next to each other."""
        return int(math.log(n) / (math.log(self.of / self.at_least) + 1e-6))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.where(np.arange(size) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64)
                      for b in (BASE, INVERSE)]
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text, A to Z in lower case."""
    normal = [b" ".join((t or "").encode().lower().split()) for t in texts]
    flat = np.frombuffer(b"\n".join(normal) + b"\n", np.uint8)
    up, down = _powers(len(flat) + 1)
    value = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) * MIX + MIX) * up[:len(flat)], out=value[1:], dtype=np.uint64)
    ends = np.flatnonzero((flat == 32) | (flat == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, out = 0, []
    for text in normal:
        count = text.count(b" ") + 1 if text else 0
        if not count:
            out.append(np.zeros(0, np.uint64))
            first += 1  # the empty line is one empty word
            continue
        span = min(words, count)
        s = starts[first:first + count - span + 1]
        e = ends[first + span - 1:first + count]
        out.append(np.unique(mixed((value[e] - value[s]) * down[s])))
        first += count
    return out


def _key(tokens: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _sets(config: Similarity):
    """Kind 0: one row per document. Kind 1: tokens frequent in what the task held, with counts."""
    def frequent(held):
        token, n = np.unique(np.concatenate(held), return_counts=True)
        token, n = token[n > 2].view(np.int64), n[n > 2]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in (np.ones(len(n), np.int64), token, n, *np.zeros((3, len(n)), np.int64))),
             pa.nulls(len(n), pa.binary())], schema=SETS)

    def rows(batches):
        held, size, seen = [], 0, set()
        for batch in byte_slices(batches, "text", 1 << 20):
            out = []
            for doc_id, mark, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(),
                                            shingle_sets(batch.column("text").to_pylist(), config.words)):
                high, low = _key(tokens)
                out.append((0, doc_id, len(tokens), high, low, mark, signatures([tokens]).tobytes()))
                if (high, low) not in seen:
                    seen.add((high, low))
                    held.append(tokens)
                    size += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SETS)], schema=SETS)
            if size > config.held:
                yield frequent(held)
                held, size, seen = [], 0, set()
        if held:
            yield frequent(held)

    return rows


def _prefixes(config: Similarity, shared):
    def rows(batches):
        tokens_known, counts_known = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in byte_slices(batches, "text", 1 << 20):
            orders, tokens_, sets_, sizes, bands = [], [], [], [], []
            for tokens in shingle_sets(batch.column("text").to_pylist(), config.words):
                n = len(tokens)
                key = _key(tokens)
                if not n or key in seen:
                    continue
                seen.add(key)
                count = np.zeros(n, np.int64)
                if len(tokens_known):
                    at = np.minimum(np.searchsorted(tokens_known, tokens), len(tokens_known) - 1)
                    count = np.where(tokens_known[at] == tokens, counts_known[at], 0)
                keep, band = config.prefix(n), config.band(n)
                for k, seed in enumerate(ORDER_SEEDS):
                    first = np.lexsort((mixed(tokens ^ seed), count))[:keep]
                    hot = first[count[first] > config.hot]
                    rows_ = keep + len(hot)
                    orders.append(np.full(rows_, k, np.int32))
                    tokens_.append(tokens[np.concatenate([first, hot])].view(np.int64))
                    sets_.append(np.full(rows_, key[1], np.int64))
                    sizes.append(np.full(rows_, n, np.int32))
                    bands.append(np.concatenate([np.where(count[first] > config.hot, band, -1),
                                                 np.full(len(hot), band + 1)]).astype(np.int32))
            if orders:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (orders, tokens_, sets_, sizes, bands)], schema=PREFIXES)

    return rows


def centres(prefixes: DataFrame, config: Similarity) -> DataFrame:
    """in_order, set, centre, n: who meets whom by a prefix token, without pairs.

    The sets of a token are walked by size and cut where neighbours differ too much in size to be
    similar; a stretch is named by its first set and dropped if that is its only one. Hot tokens
    are not walked: their sets, each in two bands of sizes, are named by the least of a band,
    which is summed before it is exchanged.
    """
    salt = F.when(F.col("band") < 0, 0).otherwise(F.pmod(F.xxhash64("set"), F.lit(4096)))
    walk = Window.partitionBy("in_order", "token", "salt").orderBy("n", "set")
    once = prefixes.withColumn("salt", salt).withColumn("before", F.lag("n").over(walk)).withColumn(
        "same", F.lag("set").over(walk)).withColumn("after", F.lead("n").over(walk))

    def apart(small, large):
        return small.isNull() | large.isNull() | (config.of * small < config.at_least * large)

    hot = F.col("band") >= 0
    starts = apart(F.col("before"), F.col("n"))
    named = once.withColumn("starts", starts).withColumn("alone", starts & apart(F.col("n"), F.col("after"))).withColumn(
        "centre", F.last(F.when(F.col("starts"), F.col("set")), ignorenulls=True).over(walk))
    # Copies of a set from several tasks stand side by side and make no company.
    company = ~F.col("alone") & ~(F.col("same").eqNullSafe(F.col("set")))
    found = stored(named.where(hot | company).select(
        "in_order", "set", F.when(~hot, F.col("centre")).alias("centre"), "n", F.when(hot, F.col("token")).alias("token"),
        "band").distinct(), "jaccard-prefixes")
    crowd = found.where(hot)
    least = crowd.groupBy("in_order", "token", "band").agg(
        F.min(F.struct("n", "set")).alias("least"), F.min("set").alias("low"), F.max("set").alias("high"))
    shared = merge_lookup(crowd.drop("centre"), least.where("low <> high"), ["in_order", "token", "band"], "inner")
    return found.where(~hot).select("in_order", "set", "centre", "n").unionByName(
        shared.select("in_order", "set", F.col("least.set").alias("centre"), "n")).distinct()


def units(met: DataFrame, config: Similarity) -> DataFrame:
    """c1, c2, set, n, members, blocks, mine: the sets that meet in both orders, in units (c1, c2).

    Units of the same members are taken once. A unit of more text than a block holds is cut by a
    hash of the set; `mine` is the block of a set. Stored.
    """
    one = met.where("in_order = 0").select("set", "n", F.col("centre").alias("c1"))
    two = met.where("in_order = 1").select("set", F.col("centre").alias("c2"))
    both = stored(one.join(two.hint("merge"), "set"), "jaccard-meetings")
    groups = both.groupBy("c1", "c2").agg(F.count("set").alias("members"), F.sum("n").alias("held"),
                                          F.expr("bit_xor(xxhash64(set))").alias("same")).where("members > 1")
    first = groups.groupBy("members", "held", "same").agg(F.min(F.struct("c1", "c2")).alias("id"))
    chosen = first.select("id.c1", "id.c2", "members", _blocks("held", "members", config).alias("blocks"))
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    return stored(merge_lookup(both, chosen, ["c1", "c2"], "inner").withColumn("mine", mine), "jaccard-members")


def _blocks(words: str, sets: str, config: Similarity):
    return F.ceil(F.greatest(F.col(words) / config.unit_words, F.col(sets) / config.unit_sets)).cast("int")


def by_itself(member: DataFrame, config: Similarity) -> DataFrame:
    """Rows of `units` with the block (one) they are solved in: their own, but for the hubs every one."""
    hub = F.pmod(F.xxhash64("set", F.lit(7)), F.col("members")) < config.hubs
    every = F.when((F.col("blocks") > 1) & hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))
    return member.withColumn("one", F.explode(every)).withColumn("two", F.lit(-1))


def left_over(large: DataFrame, config: Similarity) -> DataFrame:
    """Pairs of blocks (one, two) in which a set may still meet one of another component.

    `large` has the rows of units of several blocks, with the label of their component. All but a
    unit's largest component are dealt to blocks of their own (two) and meet each block (one).
    """
    sizes = large.groupBy("c1", "c2", "label").agg(F.count("set").alias("m"))
    main = sizes.groupBy("c1", "c2").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    marked = merge_lookup(large, main, ["c1", "c2"], "inner").withColumn("outside", F.col("label") != F.col("main"))
    rest = marked.where("outside").groupBy("c1", "c2").agg(F.count("set").alias("m"), F.sum("n").alias("held")).select(
        "c1", "c2", _blocks("held", "m", config).alias("others"))
    dealt = merge_lookup(marked, rest, ["c1", "c2"], "inner")
    theirs = F.pmod(F.xxhash64("set", F.lit(3)), F.col("others")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda two: F.struct(F.col("mine").alias("one"), two.alias("two")))
    went = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda one: F.struct(one.alias("one"), theirs.alias("two")))
    places = F.when(F.col("outside"), F.array_union(met, went)).otherwise(met)
    return dealt.withColumn("place", F.explode(places)).withColumns({"one": F.col("place.one"), "two": F.col("place.two")})


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """1024 parity bits of each set; their distance never exceeds the symmetric difference."""
    out = np.zeros((len(sets), 1024), np.uint8)
    for k, tokens in enumerate(sets):
        out[k] = np.bincount((tokens >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def possible(size: np.ndarray, parity: np.ndarray, i: int, others: np.ndarray, config: Similarity) -> np.ndarray:
    """Those of `others` that sizes and parity bits do not rule out as similar to set `i`."""
    whole = size[others] + size[i]
    shared = (config.at_least * whole + config.at_least + config.of - 1) // (config.at_least + config.of)
    differ = np.bitwise_count(parity[others] ^ parity[i]).sum(1)
    return others[(config.of * np.minimum(size[others], size[i]) >= config.at_least * np.maximum(size[others], size[i]))
                  & (differ <= whole - 2 * shared)]


def _promising(config: Similarity):
    """The sets of a unit that have a possible partner of another label in it."""
    def promising(unit: pa.Table) -> pa.Table:
        unit = unit.take(pa.compute.sort_indices(unit.column("n")))
        size, label = unit.column("n").to_numpy().astype(np.int64), unit.column("label").to_numpy()
        parity = np.frombuffer(b"".join(unit.column("parity").to_pylist()), np.uint64).reshape(len(size), -1)
        keep = np.zeros(len(size), bool)
        for i in range(len(size)):
            # A neighbour in size is the likely partner; one found is enough for both.
            others = np.arange(max(0, i - 1), min(len(size), i + 2))
            found = possible(size, parity, i, others[label[others] != label[i]], config)
            if not len(found) and not keep[i]:
                low = np.searchsorted(size, -(-config.at_least * size[i] // config.of))
                others = np.arange(low, np.searchsorted(size, config.of * size[i] // config.at_least, side="right"))
                found = possible(size, parity, i, others[label[others] != label[i]], config)
            keep[found] = True
            keep[i] |= len(found) > 0
        return unit.select([*UNIT, "set", "rep", "label"]).filter(pa.array(keep))

    return promising


def links(sets: list[np.ndarray], config: Similarity, label=None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs among distinct sets, exactly; sets of one label are linked already."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    label, found = np.arange(len(sets)) if label is None else np.array(label)[order], []
    parity = signatures(sets)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        return possible(size, parity, i, others, config)

    def verify(i: int, j: int) -> None:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if config.of * both >= config.at_least * (size[i] + size[j] - both):
            found.append((order[i], order[j]))
            label[label == label[j]] = label[i]

    # Most sets of a group of near copies link to a neighbour in size or to the first one.
    for i in range(1, len(sets)):
        for j in near(i, np.unique([0, i - 1])):
            if label[i] != label[j]:
                verify(i, int(j))
    if len(np.unique(label)) == 1 or not len(sets):
        return found
    # The rest: sets of different components that share a prefix token, rarest in the unit first.
    token, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held, at = [], 0
    for i, s in enumerate(sets):
        own = place[at:at + len(s)]
        at += len(s)
        held.append(own[np.lexsort((own, count[own]))[:config.prefix(len(s))]])
    flat, row = np.concatenate(held), np.repeat(np.arange(len(sets)), [len(h) for h in held])
    by_token = np.argsort(flat, kind="stable")
    flat, row = flat[by_token], row[by_token]
    edges = np.flatnonzero(np.diff(flat)) + 1
    tried: set[int] = set()
    for run in np.split(row, edges):
        if len(run) < 2 or (label[run] == label[run[0]]).all():
            continue
        for k in range(1, len(run)):
            i = int(run[k])
            others = run[:k]
            for j in near(i, others[label[others] != label[i]]):
                code = i * len(sets) + int(j)
                if label[i] != label[j] and code not in tried:
                    tried.add(code)
                    verify(i, int(j))
    return found


def _solve(config: Similarity):
    def solve(unit: pa.Table) -> pa.Table:
        # Rows that share an id may bring another text along; each set counts once.
        held: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}
        rows = zip(*(unit.column(c).to_pylist() for c in ("rep", "label", "set")),
                   shingle_sets(unit.column("text").to_pylist(), config.words))
        for rep, label, wanted, tokens in rows:
            key = _key(tokens)
            if key[1] == wanted:
                held.setdefault(key, (rep, label, tokens))
        ids = [rep for rep, _, _ in held.values()]
        pairs = links([tokens for _, _, tokens in held.values()], config, [label for _, label, _ in held.values()])
        return pa.Table.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], schema=EDGES)

    return solve


def linked(docs: DataFrame, config: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of `docs` (doc_id, text; others are not read).

    A document of fewer words than a shingle has its whole sequence as one; without words, or
    with a null text, its set is empty and it is its own component. Rows without doc_id are not
    linked and have a null component. Rows sharing an id are documents of the same name. No
    documents give no rows.
    """
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text", "CAST(NULL AS BIGINT) AS mark")
    return _linked(narrow, config).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _linked(narrow: DataFrame, config: Similarity) -> DataFrame:
    """doc_id, mark, n, component_id of each row (doc_id, text, mark); the mark is carried along."""
    spark = narrow.sparkSession
    python_tasks(spark)
    named = narrow.where("doc_id IS NOT NULL")
    sets = stored(narrow.mapInArrow(
        _sets(config), "kind long, doc_id long, n long, high long, low long, mark long, parity binary"), "jaccard-sets")
    common = sets.where("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "token").limit(config.frequent).toArrow()
    token, count = (common.column(c).to_numpy() for c in ("token", "n"))
    by = np.argsort(token.view(np.uint64)) if len(token) else []
    shared = spark.sparkContext.broadcast((token[by].view(np.uint64), count[by]) if len(token) else ((), ()))
    prefixes = named.mapInArrow(_prefixes(config, shared), "in_order int, token long, set long, n int, band int")
    met = stored(centres(prefixes, config), "jaccard-centres")

    of_kind = sets.where("kind = 0")
    reps = stored(of_kind.where("n > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(
        F.min("doc_id").alias("rep"), F.first("parity").alias("parity")), "jaccard-classes")
    described = merge_lookup(units(met, config), reps.select(F.col("low").alias("set"), "rep", "parity"), ["set"], "inner")
    first = by_itself(described.withColumn("label", F.col("rep")), config)
    label = components(_solved(first, named, config)).withColumnRenamed("node", "rep")
    # Units of several blocks hold more than a block of text each, so few rows are read again.
    large = merge_lookup(described.where("blocks > 1"), label, ["rep"], "left").withColumn(
        "label", F.coalesce("component", "rep")).drop("component")
    second = _solved(left_over(stored(large, "jaccard-large"), config), named, config)
    if not second.isEmpty():
        label = components(second.unionByName(label.select(F.col("rep").alias("u"), F.col("component").alias("v"))))\
            .withColumnRenamed("node", "rep")
    named_reps = merge_lookup(reps, label, ["rep"], "left").select(
        "high", "low", F.coalesce("component", "rep").alias("component_id"))
    full = merge_lookup(of_kind.where("n > 0 AND doc_id IS NOT NULL"), named_reps, ["high", "low"], "inner")
    rest = of_kind.where("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(rest).select("doc_id", "mark", "n", "component_id")


def _solved(rows: DataFrame, named: DataFrame, config: Similarity) -> DataFrame:
    """Links (u, v) within the units of `rows`; texts are exchanged for sets with a possible partner only."""
    member = stored(rows.select(*UNIT, "set", "n", "rep", "parity", "label").groupBy(*UNIT).applyInArrow(
        _promising(config), "c1 long, c2 long, one int, two int, set long, rep long, label long"), "jaccard-units")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(config.slots))
    # At most `slots` rows are broadcast, whatever the number of candidates.
    wanted = F.broadcast(member.select(F.col("rep").alias("doc_id")).select(slot.alias("slot")).distinct())
    texts = named.withColumn("slot", slot).join(wanted, "slot", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    whole = member.join(texts.hint("merge"), "rep")
    return stored(whole.groupBy(*UNIT).applyInArrow(_solve(config), "u long, v long"), "jaccard-links")


def one_of_each(docs: DataFrame, config: Similarity = Similarity()) -> DataFrame:
    """One row of `docs` of each group of linked texts, the one of the smallest doc_id.

    Rows are judged by id and text, named by a hash of both: a text that is like no other stays,
    whatever other rows have its id, and equal rows are a group. Rows without id rank behind those
    with one, rows of one id by that hash. Texts without words are like nothing and all stay. Only
    rows that may be affected are exchanged: `slots` slots at most are broadcast, others pass as they are.
    """
    key, slot, drop, rows = _unused(docs, ("key", "slot", "drop", "rows"))
    own, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    named = docs.withColumn(key, F.xxhash64(own, text))
    found = _linked(named.select(F.col(key).alias("doc_id"), text.alias("text"), own.alias("mark")), config)
    rank = F.struct(F.col("mark").isNull(), "mark", "doc_id")
    each = stored(found.where("n > 0").groupBy("component_id", "doc_id", "mark").agg(F.count("n").alias("n")), "jaccard-judged")
    first = each.groupBy("component_id").agg(F.min(rank).alias("first"))
    judged = merge_lookup(each, first, ["component_id"], "inner").select(
        F.col("doc_id").alias(key), F.col("n").alias(rows), (~rank.eqNullSafe(F.col("first"))).alias(drop))
    affected = stored(judged.where(F.col(drop) | (F.col(rows) > 1)), "jaccard-affected")
    place = F.pmod(F.xxhash64(key), F.lit(config.slots))
    slots = F.broadcast(affected.select(place.alias(slot)).distinct())
    placed = named.withColumn(slot, place)
    sure = placed.join(slots, slot, "left_anti").select(*docs.columns)
    maybe = placed.join(slots, slot, "left_semi")
    left = maybe.join(affected.hint("merge"), key, "left").where(~F.coalesce(F.col(drop), F.lit(False)))
    single = left.where(F.coalesce(F.col(rows), F.lit(1)) == 1).select(*docs.columns)
    several = left.where(F.col(rows) > 1).dropDuplicates([key]).select(*docs.columns)
    return sure.unionByName(single).unionByName(several)


def _unused(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The names, with as many underscores in front as no column of `df` has."""
    taken, front = {c.lower() for c in df.columns}, "_"
    while any(front + n in taken for n in names):
        front += "_"
    return [front + n for n in names]

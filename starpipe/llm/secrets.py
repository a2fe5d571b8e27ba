"""Secret scans: fixed patterns and character Markov models (operator 6).

Patterns give the base spans. Two first-order character models, one of random strings and one of
ordinary identifiers, score further tokens by their log-likelihood ratio. Random strings are
labelled by the base patterns, identifiers are words that recur in documents without a base
span; both come from a bounded sample of documents. Both
models together are one array of a fixed length, written into the plan as a literal; everything
is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import bounded_sample

#: Patterns and least lengths, in the order in which kinds are listed. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{5,}"


@dataclass(frozen=True)
class Scan:
    """`sample` bounds the documents that label samples for training, taken by a hash of doc_id;
    `odds` is the log prior to overcome."""

    sample: int = 20_000
    least: int = 16
    odds: float = 12.0
    smoothing: float = 0.5
    used: int = 3


#: Reaches of the rounds of `_running`; the last is beyond the number of code points a text can have.
REACHES = [1 << k for k in range(31)]
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _running(values: Column, combine) -> Column:
    """`values` after each has met all before and all after it, in rounds of doubled reach.

    `combine(value, before, after)` gets null beyond the ends. A round is one pass and a text of n
    values takes log2(n) rounds, so nothing is appended to a growing array.
    """
    def round_(held, reach):
        return F.when(F.size(held) <= reach, held).otherwise(F.transform(held, lambda value, i: combine(
            value, F.get(held, i - reach), F.get(held, i + reach))))

    return F.aggregate(F.lit(REACHES), values, round_)


def _positions(text: Column, pattern: str) -> Column:
    """struct(end, hit) of all matches, leftmost and non-overlapping, in code points.

    The pieces between matches and the matches alternate, so their lengths add up to positions.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), lambda pair: F.struct(
        (F.length(pair["piece"]) + F.coalesce(F.length(pair["hit"]), F.lit(0))).alias("end"), pair["hit"].alias("hit")))
    ends = _running(lengths, lambda x, before, after: F.struct(
        (x["end"] + F.coalesce(before["end"], F.lit(0))).alias("end"), x["hit"].alias("hit")))
    return F.filter(ends, lambda x: x["hit"].isNotNull())


def _kind(text: Column, gate: str, pattern: str, kind: int, value=None, least: int = 0) -> Column:
    """Spans of one kind; texts without a match for `gate` skip the work."""
    spans = F.transform(_positions(text, pattern), lambda s: F.struct(
        (s["end"] - F.length(s["hit"])).alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
        (value(s["hit"]) if value else s["hit"]).alias("value")))
    held = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(gate), held).otherwise(F.array().cast(f"array<{SPAN}>"))


def _texts(docs: DataFrame, *others) -> DataFrame:
    return docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def scanned(texts: DataFrame, scan: Scan) -> DataFrame:
    """The rows with base spans and candidate tokens of their text.

    The shorter patterns with the least length built in match the same: a hex run or an access
    key always extends as far as it can, so a match that is too short holds no longer one.
    """
    text = F.col("text")
    hexes, access = f"[0-9a-f]{{{HEX_LEAST},}}", f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
    token = f"(?<!{TOKEN}){TOKEN}{{{scan.least},}}"
    return texts.select("*", F.concat(
        _kind(text, ASSIGN, ASSIGN, 0, lambda hit: F.regexp_extract(hit, ASSIGN, 1), ASSIGN_LEAST),
        _kind(text, access, access, 1), _kind(text, hexes, hexes, 2)).alias("__base"),
        _kind(text, token, token, 3).alias("__tokens"))


def _codes(value: Column) -> Column:
    """Places of the characters in ALPHABET, from 0; characters outside it are left out."""
    place = [ALPHABET.find(chr(c)) for c in range(128)]
    table = F.split(F.lit(",".join(map(str, place))), ",").cast("array<int>")
    known = F.regexp_replace(value, f"{TOKEN.replace('[', '[^')}", "")
    return F.transform(F.filter(F.split(known, ""), lambda c: c != ""), lambda c: F.get(table, F.ascii(c)))


def _pairs(codes: Column) -> Column:
    """Codes of neighbouring characters as one number each."""
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))),
                      F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))),
                      lambda a, b: a * len(ALPHABET) + b)


def train(docs: DataFrame, scan: Scan = Scan()) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary.

    Counts of at most 2 * 67^2 pairs reach the driver. Without samples of a kind its model is
    uniform.
    """
    sample = bounded_sample(_texts(docs, "doc_id"), scan.sample, "doc_id")
    rows = scanned(sample, scan)
    value = F.when(F.size("__base") > 0, F.col("__base.value")).otherwise(
        F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))
    values = rows.select((F.size("__base") == 0).cast("int").alias("kind"), F.explode(value).alias("value"))
    # Each value counts once; an identifier is ordinary if it is used again, as keys seldom are.
    labelled = values.groupBy("kind", "value").agg(F.count("value").alias("n")).where(
        (F.col("kind") == 0) | (F.col("n") >= scan.used))
    size = len(ALPHABET)
    counts = [[0] * (size * size) for _ in range(2)]
    for r in labelled.select("kind", F.explode(_pairs(_codes(F.col("value")))).alias("pair")).groupBy("kind", "pair").agg(
            F.count("pair").alias("n")).collect():
        counts[r["kind"]][r["pair"]] += r["n"]
    random, ordinary = (_model(c, size, scan.smoothing) for c in counts)
    return [math.log(a) - math.log(b) for a, b in zip(random, ordinary)]


def _model(counts: list[int], size: int, smoothing: float) -> list[float]:
    """Probability of each second character after each first; rare firsts lean on the seconds' own shares."""
    second = [sum(counts[a * size + b] for a in range(size)) + smoothing for b in range(size)]
    share = [n / sum(second) for n in second]
    first = [sum(counts[a * size:(a + 1) * size]) for a in range(size)]
    return [(counts[p] + size * smoothing * share[p % size]) / (first[p // size] + size * smoothing)
            for p in range(size * size)]


def _alone(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no base span.

    Both are put in one order by start, base spans first. A token is alone if no span before it
    reaches beyond its start and the next span after it starts no earlier than its end.
    """
    no = F.lit(None).cast("int")
    marks = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("token"), b["end"].alias("reach"),
                                             b["start"].alias("next"), F.lit(None).cast(SPAN).alias("span"))),
        F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("token"), no.alias("reach"),
                                               no.alias("next"), t.alias("span"))))
    met = _running(F.array_sort(marks), lambda x, before, after: F.struct(
        x["start"].alias("start"), x["token"].alias("token"), F.greatest(x["reach"], before["reach"]).alias("reach"),
        F.least(x["next"], after["next"]).alias("next"), x["span"].alias("span")))
    free = F.filter(met, lambda x: (x["token"] == 1) & F.coalesce(x["reach"] <= x["start"], F.lit(True))
                    & F.coalesce(x["next"] >= x["span"]["end"], F.lit(True)))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(F.transform(free, lambda x: x["span"]))


def with_spans(texts: DataFrame, model: list[float], scan: Scan = Scan()) -> DataFrame:
    """Adds __base and __spans, both ordered by start and kind, to rows with a text that is not null."""
    ratio = F.split(F.lit(",".join(f"{w:.6f}" for w in model)), ",").cast("array<double>")
    random = F.filter("__tokens", lambda t: F.aggregate(
        _pairs(_codes(t["value"])), F.lit(0.0), lambda total, p: total + F.get(ratio, p)) > scan.odds)
    rows = scanned(texts, scan).withColumns({"__base": F.array_sort("__base"), "__tokens": random})
    return rows.withColumn("__spans", F.array_sort(F.concat(
        "__base", _alone(F.col("__base"), F.col("__tokens"))))).drop("__tokens")


def scan_documents(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, value) of each row of `docs` (doc_id, text).

    `spans` holds the base spans and those of the model that overlap none of them, by start and
    kind. A null text is empty and has no spans; repeated rows are scanned each for itself; other
    columns are not read; no documents give no rows.
    """
    texts = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return with_spans(texts, train(docs, scan), scan).select(
        "doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


#: Code points of a block of text; a part of a text is cut from the blocks that it touches.
BLOCK = 4096


def _part(start: Column, end: Column) -> Column:
    """Code points `start` to `end` of the text in `blocks`."""
    first = F.floor(start / BLOCK).cast("int")
    touched = F.slice(F.col("blocks"), first + 1, F.greatest(F.ceil(end / BLOCK).cast("int") - first, F.lit(0)))

    def cut(block, i):
        begin = F.greatest(start - (first + i) * BLOCK, F.lit(0))
        return F.substr(block, begin + 1, F.least(end - (first + i) * BLOCK, F.lit(BLOCK)) - begin)

    return F.array_join(F.transform(touched, cut), "")


def redacted(docs: DataFrame, mark: str = "[secret]", scan: Scan = Scan()) -> DataFrame:
    """The rows of `docs` with every span of their text replaced by `mark`; all columns stay.

    Spans that overlap become one mark. A null text stays null and an empty one empty; repeated
    rows are redacted each for itself; columns may have any names; no documents give no rows.
    """
    rows = with_spans(_texts(docs, F.struct("*").alias("row")), train(docs, scan), scan)
    ends = _running(F.col("__spans"), lambda x, before, after: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), F.greatest(x["end"], before["end"]).alias("end"),
        x["value"].alias("value")))
    found = F.size("__spans") > 0
    rows = rows.select("row", "text", F.when(found, ends).alias("ends"), F.when(found, F.regexp_extract_all(
        "text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("blocks"))
    # A span that starts before an earlier one ends belongs to that one's mark.
    gaps = F.filter(F.transform("ends", lambda x, i: F.struct(
        F.coalesce(F.get("ends", i - 1)["end"], F.lit(0)).alias("start"), x["start"].alias("end"))),
        lambda gap: gap["start"] <= gap["end"])
    marked = F.transform(gaps, lambda gap: F.concat(_part(gap["start"], gap["end"]), F.lit(mark)))
    tail = _part(F.get("ends", F.size("ends") - 1)["end"], F.length("text"))
    clean = F.when(F.col("ends").isNotNull(), F.concat(F.array_join(marked, ""), tail)).otherwise(F.col("row")["text"])
    return rows.select(*((clean if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans."""
    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", of(0), of(1), of(2), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))

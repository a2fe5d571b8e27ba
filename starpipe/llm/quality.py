"""Quality rules as a learned decision list (operator 5).

Statistics of whole texts are taken once and stored. Sequential covering then learns ordered
conjunctions of thresholds from labelled statistics: a rule grows by the condition of highest
information gain, its last conditions are pruned on rows set apart, rows it covers are removed,
and the next rule follows. The list is emitted as one Spark conditional expression. Each step
is one aggregate over the labelled rows, so only counts reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import bounded_sample, byte_slices, python_tasks, stored

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
ARROW = pa.schema([(c, pa.int64()) for c in ["doc_id", *COUNTS]])

#: What rules may test, from the stored counts.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Learner:
    """`sample` bounds the labelled rows that rules are learnt from, taken by a hash of doc_id."""

    sample: int = 200_000
    cuts: int = 12
    rules: int = 8
    conditions: int = 3
    precision: float = 0.8
    least: int = 5


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Words of each text inside a 5-word window that occurs twice or more in it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(words)), sizes)
    starts = len(flat) - WINDOW + 1
    if starts < 1:
        return out
    # Pairs of dense codes are renumbered, so that equal codes always mean equal windows.
    code = row.astype(np.int64)
    for k in range(WINDOW):
        wide = code[:starts] * np.int64(len(codes) + 1) + flat[k:k + starts]
        code = np.unique(wide, return_inverse=True)[1].astype(np.int64)
    inside = row[:starts] == row[WINDOW - 1:]
    seen = np.bincount(code[inside], minlength=starts)
    repeated = np.flatnonzero(inside & (seen[code] > 1))
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    np.add.at(out, row[np.cumsum(edge[:-1]) > 0], 1)
    return out


def text_counts(texts: list[str | None]) -> list[list[int]]:
    """The columns of COUNTS of each text."""
    columns: list[list[int]] = [[] for _ in COUNTS]
    words = []
    for text in texts:
        text = text or ""
        raw = text.encode()
        split = raw.split()  # on the six ASCII white spaces exactly
        words.append(split)
        of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        seen, lines, dups = set(), 0, 0
        for line in text.split("\n"):
            if line.strip(BLANKS):
                lines += 1
                dups += line in seen
                seen.add(line)
        upper = int(of[65:91].sum())
        symbols = int(sum(of[ord(c)] for c in SYMBOLS))
        marks = int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum())
        blanks = int(of[9:14].sum() + of[32])
        for column, value in zip(columns, (len(split), len(text) - blanks, symbols, dups, 0, lines, marks, upper)):
            column.append(value)
    columns[COUNTS.index("n_repeat_words")] = repeated_words(words).tolist()
    return columns


def _count(batches):
    for batch in byte_slices(batches, "text", 1 << 20):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in text_counts(batch.column("text").to_pylist()))],
            schema=ARROW)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each row of `docs` (doc_id, text); a null text counts as empty."""
    python_tasks(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_count, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# --- Learning -----------------------------------------------------------------------------

Condition = tuple[str, str, float]


def condition(c: Condition) -> Column:
    feature, side, cut = c
    return F.col(feature) <= F.lit(cut) if side == "<=" else F.col(feature) > F.lit(cut)


def conjunction(conditions: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [condition(c) for c in conditions], F.lit(True))


def learn(stats: DataFrame, labels: DataFrame, learner: Learner = Learner()) -> list[list[Condition]]:
    """Ordered rules that find bad documents; empty when nothing is labelled bad.

    `stats` is stored and has COUNTS; `labels` has doc_id and quality. Null labels and rows
    failed by the base rules teach nothing.
    """
    good = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("quality") > 0).alias("good"))
    narrow = stats.where(~base_failed()).selectExpr("doc_id", *(f"{e} AS {n}" for n, e in FEATURES.items()))
    joined = narrow.join(good, "doc_id").withColumn("apart", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0)
    rows = stored(bounded_sample(stored(joined, "quality-labelled"), learner.sample, "doc_id"), "quality-sample")
    cuts = _cuts(rows, learner)
    binned = stored(rows.select("good", "apart", *FEATURES, *(
        _bin(f, cuts[f]).alias(f"bin_{f}") for f in FEATURES)), "quality-binned")
    rules: list[list[Condition]] = []
    while len(rules) < learner.rules:
        rest = binned.where(~reduce(lambda a, b: a | b, [conjunction(r) for r in rules], F.lit(False)))
        rule = _prune(rest, _grow(rest.where(~F.col("apart")), cuts, learner), learner)
        if not rule:
            break
        rules.append(rule)
    return rules


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the ascending cuts lie below the feature."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(feature) > c)) if cuts else F.lit(0)


def _cuts(rows: DataFrame, learner: Learner) -> dict[str, list[float]]:
    """Middles between neighbouring quantiles of the bad and the good rows, by feature."""
    points: dict[str, set[float]] = {f: set() for f in FEATURES}
    steps = [k / learner.cuts for k in range(learner.cuts + 1)]
    for side in (F.col("good"), ~F.col("good")):
        for f, values in zip(FEATURES, rows.where(side).approxQuantile(list(FEATURES), steps, 0.0)):
            points[f].update(values)
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in ((f, sorted(v)) for f, v in points.items())}


def _histogram(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
    """Good and bad rows by feature and bin; a few hundred numbers whatever the rows."""
    stack = ", ".join(f"'{f}', bin_{f}" for f in FEATURES)
    counted = rows.selectExpr("good", f"stack({len(FEATURES)}, {stack}) AS (feature, bin)").groupBy(
        "feature", "bin").agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count(F.when(~F.col("good"), 1)).alias("b"))
    out: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
    for r in counted.collect():
        out[r["feature"]][r["bin"]] = [r["b"], r["g"]]
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], learner: Learner) -> list[Condition]:
    """Conditions of highest gain; among equal cuts of a feature the middle one."""
    rule: list[Condition] = []
    while len(rule) < learner.conditions:
        held = _histogram(rows.where(conjunction(rule)))
        any_feature = next(iter(FEATURES))
        bad, good = (sum(v[k] for v in held[any_feature].values()) for k in (0, 1))
        if bad < learner.least or good == 0:
            break
        before, found = math.log2(bad / (bad + good)), []
        for f in FEATURES:
            below_bad = below_good = 0
            for k, cut in enumerate(cuts[f]):
                b, g = held[f].get(k, (0, 0))
                below_bad, below_good = below_bad + b, below_good + g
                for side, (b, g) in (("<=", (below_bad, below_good)), (">", (bad - below_bad, good - below_good))):
                    if b >= learner.least:
                        found.append((b * (math.log2(b / (b + g)) - before), f, side, cut))
        best = max(found, default=None, key=lambda x: x[0])
        if best is None or best[0] <= 1e-9:
            break
        same = [x[1:] for x in found if x[0] >= best[0] - 1e-9 and x[1:3] == best[1:3]]
        rule.append(same[len(same) // 2])
    return rule


def _prune(rows: DataFrame, rule: list[Condition], learner: Learner) -> list[Condition]:
    """The prefix of highest precision on the rows set apart, if it is precise on all."""
    if not rule:
        return []
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    tests = [conjunction(p) & side for p in prefixes for side in (~F.col("good"), F.col("good"))]
    counts = rows.agg(*(F.count(F.when(t & F.col("apart"), 1)) for t in tests),
                      *(F.count(F.when(t, 1)) for t in tests)).first()
    apart = list(zip(counts[:len(tests):2], counts[1:len(tests):2]))
    whole = list(zip(counts[len(tests)::2], counts[len(tests) + 1::2]))
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in apart]
    best = max(range(len(worth)), key=lambda k: (worth[k], -k))
    bad, good = whole[best]
    return prefixes[best] if bad >= learner.least and bad >= learner.precision * (bad + good) else []


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional: the first rule that fits rejects, what fits none is kept."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(conjunction(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, learner: Learner = Learner()) -> DataFrame:
    """Counts, base_failed and kept of each row of `docs` (doc_id, text; others are not read).

    A null or empty text has no words and so fails the base. Without labels only the base
    decides. Repeated rows are judged each for itself; no documents give no rows.
    """
    stats = stored(statistics(docs), "quality-counts")
    rules = learn(stats, labels, learner)
    return stats.selectExpr("*", *(f"{e} AS f_{n}" for n, e in FEATURES.items())).select(
        "doc_id", *COUNTS[:5], base_failed().alias("base_failed"),
        _renamed(rules).alias("kept"))


def _renamed(rules):
    return verdict([[(f"f_{f}", side, cut) for f, side, cut in rule] for rule in rules])

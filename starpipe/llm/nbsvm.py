"""Quality scores by a support vector machine on Naive Bayes ratios (operator 12).

Indicators of a text are its word and mark n-grams, and how often its most repeated n-grams recur,
hashed into a fixed number of slots. One pass over the labelled texts counts them by class and keeps
the indicators of a bounded sample. Indicators are scaled by the log ratio of their class
counts, a linear hinge-loss model is fitted to the sample by dual coordinate descent, and
margins of rows left out turn its margins into probabilities. Scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import byte_slices, merge_lookup, python_tasks, stored
from starpipe.llm.jaccard import MIX, _powers, mixed

#: Class of each byte: 0 blank, 1 word (letters and all beyond ASCII), 2 digit, 3 mark.
KIND = np.array([0 if c in b" \t\n\v\f\r" else 2 if 48 <= c <= 57 else 1 if c >= 128 or chr(c).isalpha() else 3
                 for c in range(256)], np.uint8)
KEPT = pa.schema([("slot", pa.int32()), ("good", pa.int64()), ("bad", pa.int64()), ("label", pa.bool_()),
                  ("place", pa.int64()), ("slots", pa.binary())])
SCORED = pa.schema([("doc_id", pa.int64()), ("margin", pa.float64())])


@dataclass(frozen=True)
class Model:
    """Settings of the features and of the fit.

    `sample` bounds the labelled rows that are fitted, by a hash of doc_id, and `sample_slots` their
    indicators; class counts cover all labelled rows. Probabilities follow from margins of rows
    that a model of the other `folds` has not seen.
    """

    slots: int = 1 << 18
    grams: int = 2
    repeat_gram: int = 3
    sample: int = 20_000
    sample_slots: int = 1 << 24
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 10
    folds: int = 3


def indicators(texts: Sequence[str | None], model: Model) -> list[np.ndarray]:
    """Sorted distinct slots of each text."""
    flat = np.frombuffer(b"\n".join((t or "").encode().lower().replace(b"\n", b" ") for t in texts) + b"\n", np.uint8)
    up, down = _powers(len(flat) + 1)
    value = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) * MIX + MIX) * up[:len(flat)], out=value[1:], dtype=np.uint64)
    kind = KIND[flat]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    start, end = edge[:-1], edge[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    token = mixed((value[end] - value[start]) * down[start])
    row = np.searchsorted(np.flatnonzero(flat == 10), start)
    found, gram = [], token
    for n in range(1, max(model.grams, model.repeat_gram) + 1):
        if n > 1:
            gram = mixed(gram[:-1] * MIX + token[n - 1:])
        inside = row[:len(gram)] == row[n - 1:] if n > 1 else np.ones(len(gram), bool)
        if n <= model.grams:
            found.append((row[:len(gram)][inside], gram[inside]))
        if n == model.repeat_gram:
            # One indicator for each power of two that the count of some n-gram reaches.
            pair = np.stack([row[:len(gram)][inside].astype(np.uint64), gram[inside]])
            by = np.lexsort(pair)
            pair = pair[:, by]
            first = np.flatnonzero(np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(0)])) if pair.shape[1] else np.zeros(0, int)
            count = np.diff(np.append(first, pair.shape[1]))
            level = np.log2(np.maximum(count, 1)).astype(np.uint64)
            often = level > 0
            found.append((pair[0][first][often].astype(np.int64), mixed(level[often] + np.uint64(1 << 40))))
    rows = np.concatenate([r for r, _ in found]).astype(np.int64)
    slot = (np.concatenate([g for _, g in found]) % np.uint64(model.slots)).astype(np.int64)
    code = np.unique(rows * model.slots + slot)
    cut = np.searchsorted(code // model.slots, np.arange(1, len(texts)))
    return [(c % model.slots).astype(np.int32) for c in np.split(code, cut)]


def _kept(model: Model, share: float):
    """Class counts of the slots in what the task read, and the indicators of sampled rows."""
    def rows(batches):
        good, bad = np.zeros((2, model.slots), np.int64)
        for batch in byte_slices(batches, "text", 1 << 20):
            labels, places = batch.column("label").to_pylist(), batch.column("place").to_pylist()
            found = indicators(batch.column("text").to_pylist(), model)
            for slots, label in zip(found, labels):
                (good if label else bad)[slots] += 1
            pick = [k for k, p in enumerate(places) if (p & 0xFFFFFFFF) < share * 2**32]
            if pick:
                n = len(pick)
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    pa.array([labels[k] for k in pick]), pa.array([places[k] for k in pick], pa.int64()),
                    pa.array([found[k].tobytes() for k in pick], pa.binary())], schema=KEPT)
        slot = np.flatnonzero(good + bad)
        n = len(slot)
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(slot, pa.int32()), pa.array(good[slot]), pa.array(bad[slot]), pa.nulls(n, pa.bool_()),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=KEPT)

    return rows


def descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray, model: Model) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model by dual coordinate descent.

    A row's values are the ratios of its indicators at unit length, and 1. Both classes cost the same in sum.
    """
    weight = np.zeros(len(ratio) + 1)
    value = [ratio[s] / max(1e-12, float(np.sqrt(np.square(ratio[s]).sum()))) for s in rows]
    norm = np.array([np.square(v).sum() + 1 for v in value])
    each = np.array([(sign == s).sum() for s in (-1, 1)])
    cost = model.cost * len(sign) / (2 * np.maximum(each, 1))[((sign + 1) // 2).astype(int)]
    alpha, random = np.zeros(len(sign)), np.random.default_rng(7)
    for _ in range(model.epochs):
        for i in random.permutation(len(sign)):
            slots, v = rows[i], value[i]
            gradient = sign[i] * (weight[slots] @ v + weight[-1]) - 1
            now = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if now != alpha[i]:
                step = (now - alpha[i]) * sign[i]
                weight[slots] += step * v
                weight[-1] += step
                alpha[i] = now
    return weight


def margins(rows: list[np.ndarray], weight: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), weight[-1])
    for k, slots in enumerate(rows):
        r = ratio[slots]
        out[k] += (weight[slots] @ r) / max(1e-12, float(np.sqrt(np.square(r).sum())))
    return out


def calibration(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    n, m = good.sum(), (~good).sum()
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    a, b = 1.0, float(np.log((n + 1) / (m + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((target - p) * margin).sum() - 1e-3 * (a - 1), (target - p).sum()])
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


@dataclass(frozen=True)
class Fitted:
    """Ratios, weights and the scale of probabilities; without both classes one share for all."""

    ratio: np.ndarray
    weight: np.ndarray
    a: float
    b: float


def log_ratios(good: np.ndarray, bad: np.ndarray, model: Model) -> np.ndarray:
    """Log ratio of the smoothed shares of each slot in the two classes; 0 for a slot never seen."""
    p, q = good + model.smoothing, bad + model.smoothing
    return np.where(good + bad > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def fit(docs: DataFrame, labels: DataFrame, model: Model = Model()) -> Fitted:
    """A model from the rows of `docs` (doc_id, text) that `labels` (doc_id, quality) mark.

    Null texts are empty, null labels and ids teach nothing; of a repeated label one 1 is enough.
    Only texts with a label are read further, once.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    marks = stored(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).alias("label")), "nbsvm-labels")
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").where("doc_id IS NOT NULL")
    known = merge_lookup(texts, marks, ["doc_id"], "inner").select("text", "label", F.xxhash64("doc_id").alias("place"))
    share = min(1.0, model.sample / max(1, marks.count()))
    kept = stored(known.mapInArrow(_kept(model, share), "slot int, good long, bad long, label boolean, place long, slots binary"), "nbsvm-rows")

    counts = kept.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    good, bad = np.zeros((2, model.slots), np.int64)
    at = counts.column("slot").to_numpy()  # of a fixed number of slots
    good[at], bad[at] = counts.column("good").to_numpy(), counts.column("bad").to_numpy()
    ratio = log_ratios(good, bad, model)

    rows = kept.where("slot IS NULL")
    held = rows.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0)).alias("n")).first()["n"] // 4
    # The share of the largest hashes goes if long texts bring too many indicators.
    limit = int(min(1.0, model.sample_slots / max(1, held)) * share * 2**32)
    taken = rows.where(F.col("place").bitwiseAND(0xFFFFFFFF) < limit).select("label", "place", "slots").toArrow()
    order = np.lexsort((taken.column("label").to_numpy(), taken.column("place").to_numpy()))
    slots = [np.frombuffer(taken.column("slots")[int(i)].as_py(), np.int32) for i in order]
    good_row = taken.column("label").to_numpy()[order].astype(bool)
    share_good = (good_row.sum() + 1) / (len(good_row) + 2)
    flat = Fitted(ratio, np.zeros(model.slots + 1), 0.0, float(np.log(share_good / (1 - share_good))))
    if min(good_row.sum(), (~good_row).sum()) < model.folds:
        return flat
    # Each class is dealt to the folds in turn; a row's margin comes from the other folds.
    fold, margin = np.zeros(len(slots), np.int64), np.zeros(len(slots))
    for side in (good_row, ~good_row):
        fold[side] = np.arange(side.sum()) % model.folds
    sign = np.where(good_row, 1.0, -1.0)
    for f in range(model.folds):
        mine = fold == f
        weight = descend([s for s, x in zip(slots, mine) if not x], sign[~mine], ratio, model)
        margin[mine] = margins([s for s, x in zip(slots, mine) if x], weight, ratio)
    return Fitted(ratio, descend(slots, sign, ratio, model), *calibration(margin, good_row))


def _margins(shared, model: Model):
    def rows(batches):
        ratio, weight = shared.value
        for batch in byte_slices(batches, "text", 1 << 20):
            found = indicators(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(margins(found, weight, ratio))], schema=SCORED)

    return rows


def score(docs: DataFrame, fitted: Fitted, model: Model = Model()) -> DataFrame:
    """doc_id, score (0 to 1) of each row of `docs` (doc_id, text); a null text is empty.

    A text without indicators has the score of the bias. Repeated rows are scored each; other
    columns are not read; no documents give no rows.
    """
    python_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((fitted.ratio, fitted.weight))  # of fixed size
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    logit = F.lit(fitted.a) * F.col("margin") + F.lit(fitted.b)
    return narrow.mapInArrow(_margins(shared, model), "doc_id long, margin double").select(
        "doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: every fifth by the checksum of their id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, model: Model = Model(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs`, learnt from rows not held out."""
    fitted = fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))), model)
    return score(docs, fitted, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Language identification with a bit-sliced Bloom filter of n-grams (operator 7).

Training counts character n-grams by language. An n-gram belongs to every language in which
its relative frequency is at least `share` of its highest one. The filter has a fixed number of
slots; a slot holds one bit per language, so reading `hashes` slots and AND-ing them gives all
languages that contain an n-gram at once. A text's n-grams are looked up, the bits are counted
per language, the counts are corrected for the false positives that the fill of a language's
slice implies, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import byte_slices, python_tasks, stored

UNDETERMINED = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()),
                       ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class LanguageFilter:
    """`slot_bits` bounds the filter: 2^slot_bits slots of one 64-bit word per 64 languages."""

    length: int = 3
    share: float = 0.1
    rare: float = 1e-6
    slot_bits: int = 20
    hashes: int = 2
    slice_bytes: int = 1 << 20
    held_grams: int = 1 << 20


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, made once per process from the Unicode properties."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams whose second character is a letter, and the row of each.

    Texts are lower-cased; whatever is no letter counts as one kind of blank, and a text has
    blanks around it, so every letter of a text has its n-gram.
    """
    pad = " " * (length - 1)
    flat = np.frombuffer("".join(" " + (t or "").lower() + pad for t in texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len((t or "").lower()) + length for t in texts), np.int64, len(texts))
    letter = letters()[flat]
    codes = np.where(letter, flat, 32).astype(np.uint64)
    keep = np.flatnonzero(letter[1:len(flat) - length + 2])
    mixed = np.zeros(len(keep), np.uint64)
    for k in range(length):
        mixed = (mixed + codes[keep + k]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed, np.repeat(np.arange(len(texts)), sizes)[keep + 1]


def _count(config: LanguageFilter):
    def rows(held) -> pa.RecordBatch:
        langs, keys, counts = [], [], []
        for lang, (gram, n) in held.items():
            langs += [lang] * len(gram)
            keys.append(gram.view(np.int64))
            counts.append(n)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))],
            schema=COUNTS)

    def merged(parts):
        gram, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return gram, np.bincount(where, np.concatenate([p[1] for p in parts]), len(gram)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in byte_slices(batches, "text", config.slice_bytes):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                gram, n = np.unique(grams([t for t, x in zip(texts, langs) if x == lang], config.length)[0],
                                    return_counts=True)
                held[lang] = merged([held[lang], (gram, n)]) if lang in held else (gram, n)
            if sum(len(g) for g, _ in held.values()) > config.held_grams:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return count


@dataclass(frozen=True)
class Model:
    languages: list[str]
    slots: np.ndarray  # words x 2^slot_bits
    false_rate: np.ndarray
    common: int
    config: LanguageFilter


def slots_of(gram: np.ndarray, config: LanguageFilter) -> list[np.ndarray]:
    out = []
    for k in range(config.hashes):
        gram = (gram ^ (gram >> np.uint64(31))) * MIX
        out.append((gram >> np.uint64(64 - config.slot_bits)).astype(np.int64))
    return out


def train(labelled: DataFrame, config: LanguageFilter = LanguageFilter()) -> Model:
    """The filter of all rows of (text, lang) with both present.

    What reaches the driver is one row per language and at most one row per slot and 64 languages.
    """
    python_tasks(labelled.sparkSession)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").selectExpr(
        "CAST(text AS STRING) AS text", "CAST(lang AS STRING) AS lang")
    counts = stored(rows.mapInArrow(_count(config), "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")), "language-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
    languages, total = [r["lang"] for r in totals], {r["lang"]: r["n"] for r in totals}
    slots = np.zeros(((len(languages) + 63) // 64 or 1, 1 << config.slot_bits), np.uint64)
    fill = np.zeros(len(languages), np.int64)
    if languages:
        rate = F.col("n") / F.create_map(*[F.lit(x) for kv in total.items() for x in kv])[F.col("lang")]
        rated = counts.withColumn("rate", rate).where(F.col("rate") >= config.rare)
        top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
        kept = rated.join(top, "gram").where(F.col("rate") >= config.share * F.col("top"))
        code = F.create_map(*[F.lit(x) for kv in zip(languages, range(len(languages))) for x in kv])
        places = kept.select(code[F.col("lang")].alias("lang"), "gram").mapInArrow(_places(config), "lang int, slot int")
        for r in places.groupBy(F.expr("lang DIV 64").cast("int").alias("word"), "slot").agg(
                F.bit_or(F.expr("shiftleft(1L, lang % 64)")).alias("bits")).toArrow().to_batches():
            word, slot, bits = (r.column(c).to_numpy(zero_copy_only=False) for c in ("word", "slot", "bits"))
            slots[word, slot] = bits.view(np.uint64)
        fill = np.array([np.count_nonzero(slots[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))])
    common = max(range(len(languages)), key=lambda k: (total[languages[k]], -k)) if languages else -1
    return Model(languages, slots, (fill / (1 << config.slot_bits)) ** config.hashes, common, config)


def _places(config: LanguageFilter):
    schema = pa.schema([("lang", pa.int32()), ("slot", pa.int32())])

    def places(batches):
        for batch in batches:
            lang = batch.column("lang").to_numpy(zero_copy_only=False).astype(np.int32)
            for slot in slots_of(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), config):
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(slot.astype(np.int32))], schema=schema)

    return places


def judge(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the corrected share of its n-grams that the language has."""
    gram, row = grams(texts, model.config.length)
    n = np.bincount(row, minlength=len(texts))
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    places = slots_of(gram, model.config)
    masks = []
    for word in model.slots:
        mask = word[places[0]]
        for place in places[1:]:
            mask &= word[place]
        masks.append(mask)
    hits = np.stack([np.bincount(row, (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1), len(texts))
                     for k in range(len(model.languages))])
    rate = model.false_rate[:, None]
    held = np.clip((hits - n * rate) / np.maximum(1 - rate, 1e-9), 0, n)
    best = held.argmax(0)
    best[held.max(0) == 0] = model.common
    score = held[best, np.arange(len(texts))] / np.maximum(n, 1)
    return [model.languages[b] if c else UNDETERMINED for b, c in zip(best, n)], score


def _predict(shared):
    def predict(batches):
        model = shared.value
        for batch in byte_slices(batches, "text", model.config.slice_bytes):
            langs, score = judge(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()),
                pa.array(score, pa.float64())], schema=PREDICTED)

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of `docs` (doc_id, text).

    `und` with score 0 for a null text, a text without a letter, or a model that learnt nothing.
    A text whose n-grams no language has gets the commonest language with score 0; equal counts
    go to the first language by name. The filter is broadcast; its size is fixed.
    """
    python_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text has a language with at least the score `least`; all columns stay.

    Null texts, texts without a letter and all rows of a model that learnt nothing go; repeated rows are
    judged alike; no documents give no rows.
    """
    python_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in byte_slices(batches, "text", shared.value.config.slice_bytes):
            langs, score = judge(batch.column("text").to_pylist(), shared.value)
            yield batch.filter(pa.array([x != UNDETERMINED and y >= least for x, y in zip(langs, score)]))

    return docs.mapInArrow(keep, docs.schema)


def held_out():
    """Whether a document is kept from training; a null doc_id is neither trained on nor held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
                      & F.col("lang").isNotNull()).select("text", "lang")


def identify(docs: DataFrame, config: LanguageFilter = LanguageFilter()) -> DataFrame:
    """Train on the documents that are not held out and judge all of them."""
    return predict(docs, train(training_rows(docs), config))

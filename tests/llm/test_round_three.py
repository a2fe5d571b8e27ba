"""Filter audit, quality classifier and spelling variants."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from starpipe.llm import audit, nbsvm, queries, spelling
from starpipe.llm.common import table
from tests.llm import fixtures

LABELS = "doc_id int, quality int, toxic int, text string, mask int, n int"


# --- 11: filter audit ---------------------------------------------------------------------

def report(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*audit.COUNTS, "shapley")) for r in df.collect()}


def test_audit_of_odd_rows(spark):
    docs = fixtures.odd(spark)
    labels = spark.createDataFrame([(d, q, t, "x", 9, 9) for d, q, t in [
        (6, 1, 0), (7, 0, 1), (7, 1, None), (8, None, None), (None, 1, 1), (10, 1, 1), (12, 0, 0), (999, 1, 1)]], LABELS)
    want = fixtures.audited([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r)[:3] for r in labels.collect()])
    assert report(audit.audit(docs, labels)) == want and len(want) == 600 * len({p for p, _, _ in want})
    assert report(audit.audit(docs, labels.limit(0))) == {k: (*v[:4], 0, 0, v[6]) for k, v in want.items()}
    assert audit.audit(fixtures.empty(spark), labels).collect() == []


def test_audit_of_the_table(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    want = fixtures.audited([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()],
                            [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert report(queries.op11_filter_audit(spark, sf_dir)) == want


def test_many_parts_and_a_hot_copy(spark):
    """More parts than a task holds; a third of all rows share one text."""
    rows = [(i, "same" if i % 3 == 0 else f"text {i}", f"p{i % 700}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3)
    assert report(audit.audit(docs, spark.createDataFrame([], LABELS))) == fixtures.audited(rows, [])


def test_fields_do_not_overflow():
    total = (2**63 - 1) * audit.packed(0b11111 | audit.GOOD | audit.TOXIC) + audit.packed(0)
    counts = audit.unpacked(total)
    assert set(np.unique(counts)) == {0, 1, 2**63 - 1}
    assert (counts[0] == 1).all() and (counts[1, :, 0] == 2**63 - 1).all()


# --- 12: quality classifier ---------------------------------------------------------------

def test_quality_on_rows_held_out(spark, sf_dir):
    """Scores tell labels apart that were never learnt."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    rows = queries.op12_quality_classifier(spark, folder).collect()
    docs = {r["doc_id"] for r in table(spark, folder, "documents").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == docs and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    label = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    good, bad = ([r["score"] for r in rows if r["held_out"] and label.get(r["doc_id"]) == q] for q in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([b < 0.3 for b in bad]) > 0.7 and np.mean([g >= 0.3 for g in good]) > 0.97


def test_labels_held_out_teach_nothing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(nbsvm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (sorted(map(tuple, nbsvm.judge(docs, x).collect())) for x in (labels, turned))
    assert first == second
    moved = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}).repartition(7)
    assert sorted(map(tuple, nbsvm.judge(moved, labels).collect())) == first


def plain_indicators(text, model):
    """n-grams of a text as strings, to count distinct ones."""
    kinds = "".join("_" if c in b" \t\n\v\f\r" else "d" if 48 <= c <= 57 else "w" if c >= 128 or chr(c).isalpha() else "m" for c in text.encode())
    raw, tokens, start = text.encode().lower(), [], 0
    for k in range(1, len(kinds) + 1):
        if k == len(kinds) or kinds[k] != kinds[start]:
            if kinds[start] != "_":
                tokens.append(raw[start:k])
            start = k
    grams = {tuple(tokens[i:i + n]) for n in range(1, model.grams + 1) for i in range(len(tokens) - n + 1)}
    often = Counter(tuple(tokens[i:i + model.repeat_gram]) for i in range(len(tokens) - model.repeat_gram + 1))
    return len(grams) + len({n.bit_length() for n in often.values() if n > 1})


def test_indicators_are_the_distinct_n_grams():
    model = replace(nbsvm.Model(), slots=1 << 30)  # collisions are rare
    texts = ["", None, " \t\n ", "a", "a b\nc", "aa###bb 12 || é漢 x", "b a " * 40, "q\nr " * 7, "x" * 3000, *(r[1] for r in fixtures.odd_rows())]
    alone = [nbsvm.indicators([t], model)[0] for t in texts]
    for one, many, text in zip(alone, nbsvm.indicators(texts, model), texts):
        assert (one == many).all() and len(one) == plain_indicators(text or "", model), text


def test_dual_descent_finds_the_hinge_minimum():
    """The primal objective is no higher than around it."""
    random_ = np.random.default_rng(1)
    model = replace(nbsvm.Model(), slots=12, epochs=200)
    rows = [np.unique(random_.integers(0, 12, 5)) for _ in range(80)]
    sign = np.where([(3 in r) ^ (random_.random() < 0.1) for r in rows], 1.0, -1.0)
    ratio = random_.normal(size=12)
    weight = nbsvm.descend(rows, sign, ratio, model)
    each = np.array([(sign == s).sum() for s in (-1, 1)])
    cost = model.cost * len(sign) / (2 * each)[((sign + 1) // 2).astype(int)]

    def objective(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - sign * nbsvm.margins(rows, w, ratio))

    least = objective(weight)
    assert all(least <= objective(weight + d * 0.01) + 1e-4 for d in random_.normal(size=(200, 13)))


def test_classifier_without_usable_labels(spark):
    odd = fixtures.odd(spark)
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(6, 1, 0, "t", 1, 1), (None, 0, 0, "t", 1, 1), (7, None, 0, "t", 1, 1)], LABELS)
    for labels in (none, one):
        rows = nbsvm.judge(odd, labels).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in fixtures.odd_rows())
        assert len({r["score"] for r in rows}) == 1 and 0 < rows[0]["score"] < 1
    assert nbsvm.judge(fixtures.empty(spark), one).collect() == []


def test_sample_is_bounded_and_order_is_free(spark):
    """A smaller sample still learns; rows in another order give the same scores."""
    rows = [(i, ("bad ### $$$ " if i % 3 == 0 else "good plain words ") * (1 + i % 4) + f"w{i % 50}", i % 3 != 0) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(g), 0, "x", 1, 1) for i, _, g in rows], LABELS)
    small = replace(nbsvm.Model(), sample=200, sample_slots=1500)
    scores = [sorted(map(tuple, nbsvm.judge(d, labels, small).collect())) for d in (docs, docs.repartition(5))]
    assert scores[0] == scores[1]
    assert all((s > 0.5) == rows[i][2] for i, _, s, _ in scores[0])


# --- 13: spelling variants ----------------------------------------------------------------

def variant_rows(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("config", [spelling.Variants(), spelling.Variants(filter_bytes=4096, cells=64),
                                    spelling.Variants(block_words=200, held_bytes=2000)])
def test_variants_of_the_table(spark, sf_dir, config):
    """With one filter, with many passes and slices of sizes, and with filters that hardly hold anything back."""
    docs = table(spark, sf_dir, "documents")
    want = sorted(fixtures.spelling([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    assert len(want) > 1000 and any(w[1] and w[1] != w[2] for w in want)
    assert variant_rows(spelling.variants(docs, config)) == want


def test_variants_of_odd_rows(spark):
    long_ = "ab" * 3000
    extra = [(100 + i, f"{long_} {long_[:-1]} Öffnung öffnung Ünder ünder ××××× 漢字kanji漢 aaaaa aaaaaa aaaaaaa") for i in range(4)]
    docs = spark.createDataFrame([(*r[:2], "x", 1) for r in fixtures.odd_rows()] + [(*e, "x", 1) for e in extra], "doc_id int, text string, word string, n int")
    assert variant_rows(spelling.variants(docs)) == sorted(fixtures.spelling([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    assert spelling.variants(fixtures.empty(spark)).collect() == []
    assert spelling.variants(docs.where("doc_id = 2")).collect() == []


def test_chain_of_forms(spark):
    """Every word is near the next and half as frequent: forms are followed to the last."""
    chain = ["aaaaa" + "b" * k for k in range(8)]
    docs = spark.createDataFrame([(None, " ".join([w] * (3 << k))) for k, w in enumerate(chain)], "doc_id int, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(docs, replace(spelling.Variants(), typo=2**32)).collect()}
    assert got == {w: (chain[k + 1] if k < 7 else None, chain[-1]) for k, w in enumerate(chain)}


def test_edits_reach_every_near_word():
    random.seed(3)
    letters = "abcdeéÿ÷"
    alphabet = sorted(map(ord, letters))

    def code(words):
        return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)

    for size in (1, 2, 5, 9):
        words = ["".join(random.choices(letters, k=size)) for _ in range(30)]
        made = {(t, w, int(h)) for t, rows, hashes in spelling.edits(code(words), alphabet) for w, h in zip((words[r] for r in rows), hashes)}
        want = set()
        for w in words:
            near = {w[:i] + w[i + 1:] for i in range(size)} | {w[:i] + c + w[i + 1:] for i in range(size) for c in letters if c > w[i]}
            want |= {(len(x), w, int(spelling.word_hashes(code([x]))[0]) if x else 0) for x in near}
        assert made == want

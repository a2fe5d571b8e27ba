"""Each corpus operator against a plain version, SQL, a round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from starpipe.llm import graph, jaccard, language, mixing, packing, quality, queries, secrets, substring, suffixes, topk, urls
from starpipe.llm.common import table
from tests.llm import fixtures
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def odd(spark):
    return fixtures.odd(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return fixtures.empty(spark)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None


# --- 1: lines -----------------------------------------------------------------------------

def plain_lines(docs, units=substring.Units()):
    """Each row is a document; which of equal rows is the first does not show in the counted result."""
    def plain(text):
        return tuple(text.encode().lower().split())

    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seen, whole, gone = set(), set(), defaultdict(set)
    for i in order:
        text = docs[i][1] or ""
        run, held, mine = [], 0, units.of(text)
        for k, unit in [*enumerate(mine), (None, "end")]:
            words = plain(unit)
            if k is not None and not words:
                continue
            if k is not None and words in seen:
                run.append(k)
                held += len(words)
                continue
            if held >= units.run_words:
                gone[i].update(run)
            run, held = [], 0
            if k is not None:
                seen.add(words)
        if plain(text) in whole:
            gone[i] = set(range(len(mine)))
        if plain(text):
            whole.add(plain(text))
    out = []
    for i, (d, t) in enumerate(docs):
        parts = units.of(t) if t is not None else []
        out.append((d, len(parts), len(gone[i]), None if t is None else "".join(p for k, p in enumerate(parts) if k not in gone[i])))
    return Counter(out)


def test_lines(odd, nothing):
    got = substring.remove_repeats(odd).collect()
    assert Counter((r["doc_id"], r["n_units"], r["n_removed"], r["text"]) for r in got) == plain_lines(pairs(odd))
    assert substring.remove_repeats(nothing).collect() == []


def test_removed_lines_have_original_offsets(spark):
    line = "one two three four five six seven."
    docs = fixtures.frame(spark, [(2, f"é {line}\nzz", "", ""), (1, line, "", "")], "doc_id int, text string, a string, b string")
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs, substring.Units(("\n", "é "), 7)).collect()}
    assert got[1]["n_removed"] == 0
    assert (got[2]["removed"], got[2]["text"]) == (f"2:{3 + len(line)}", "é zz")


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    unique = "zz yy xx ww vv uu tt"
    rows = [(0, unique), (9, "pp qq rr ss tt uu vv ww"), (9, unique), (9, "one of a kind"), (None, "a b\nsame line here of words enough to go at once by it all\nc"),
            (None, "same line here of words enough to go at once by it all\nd e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = Counter(r["text"] for r in substring.remove_repeats(docs).collect())
    assert got[unique] == 1 and got["pp qq rr ss tt uu vv ww"] == got["one of a kind"] == 1 and got[""] == 1
    texts = "".join(got)
    assert texts.count("same line") == 1 and "a b" in texts and "d e" in texts


def test_copies_of_short_lines_go_whole_and_chance_stays(spark):
    """Verse and lists go as copies; a sentence that recurs alone stays; a passage goes with its short sentences."""
    verse = "One.\nTwo.\n\nThree four. Five"
    passage = "It is so. " + " ".join(f"p{i}" for i in range(20)) + ". Yes. No. " + " ".join(f"q{i}" for i in range(20)) + ". "
    docs = spark.createDataFrame([(1, verse), (2, verse), (3, verse.upper()), (4, "Other text. One.\nTwo."), (5, "Begin. " + passage + "End one."),
                                  (6, "Start. " + passage + "End two. Yes. Ok."), (7, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    assert got == {1: verse, 2: "", 3: "", 4: "Other text. One.\nTwo.", 5: "Begin. " + passage + "End one.", 6: "Start. End two. Yes. Ok.", 7: ""}


def test_lines_left_alone(spark, sf_dir):
    """Documents that share no twelve words in a row with another lose nothing, but for a few by chance."""
    docs = pairs(table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"))
    where = defaultdict(set)
    for d, t in docs:
        words = t.lower().split()
        for i in range(len(words) - 11):
            where[tuple(words[i:i + 12])].add(d)
    shared = {d for ids in where.values() if len(ids) > 1 for d in ids}
    own = [(d, t) for d, t in docs if d not in shared and len(set(t.lower().split())) > 0.5 * len(t.split())]
    lost = {r["doc_id"] for r in queries.op1_substring_dedup(spark, sf_dir.replace("sf0.001", "sf0.01")).collect() if r["n_removed"]}
    assert len(own) > 500 and sum(d in lost for d, _ in own) < 0.03 * len(own)


# --- 2: URLs ------------------------------------------------------------------------------

def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "abc": ("", "", None), "": ("", "", None), "http://A.COM?x=/en/": ("a.com", "", None),
        "s://www.Example.com/en/x#?": ("www.example.com", "/en/x", "www.example.com/en/"),
        "http://example.com/en/": ("example.com", "/en/", "example.com/en/"), "http://xexample.com/en/": ("xexample.com", "/en/", "com/"),
        "http://a.net/fr/": ("a.net", "/fr/", "net/fr/"), "http://net/es/q": ("net", "/es/q", "net/es/"), "http://xnet/fr/": ("xnet", "/fr/", None),
        "http://h#/a": ("h", "", None), "a://b?://c/d": ("b", "", None), "://É.com/": ("É.com", "/", "com/"), "http://x\n.com/a\nb": ("x\n.com", "/a\nb", "com/"),
    }
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(cases)], "page_id int, url string, host string, rule string")
    rows = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    for i, (url, want) in enumerate(cases.items()):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == want, url
        assert rows[i]["verdict"] in ("allow", "block")
        if want[2]:
            assert rows[i]["verdict"] == {r.text: r.verdict for r in urls.RULES}[want[2]]
    assert urls.judge_urls(pages.limit(0)).collect() == []
    lone = urls.judge_urls(pages.where("url = 'abc'")).collect()
    assert [(r["verdict"], r["score"]) for r in lone] == [("allow", 0.5)]


def test_url_trees_learn(spark):
    """Half of the labels teach; the other half, whose rules are hidden, must be told apart."""
    rows = [(i, f"http://{'shop' if i % 2 else 'bad'}.{'com' if i % 2 else 'net'}/{'fr' if i % 2 == 0 else 'x'}/{i}" + ("?a=1&b=2" if i % 2 == 0 else ""))
            for i in range(400)]
    hidden = [(1000 + i, u.replace("/fr/", "/zz/").replace(".com", ".org")) for i, u in rows]
    got = urls.judge_urls(spark.createDataFrame(rows + hidden, "page_id int, url string")).where("rule IS NULL").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in got)
    assert len(got) == 400 and right >= 380


def test_urls_whole_table(spark, sf_dir):
    """Hosts, paths, rules, verdicts and scores of all pages against plain rules and plain boosting."""
    pages = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "pages")
    long_ = "http://x" + "é" * 3000 + "1" * 2000 + ".com/" + "a/" * 500 + "?" + "b=1&" * 300
    more = [(10_000 + i, u) for i, u in enumerate([None, "", "abc", long_, long_, "HTTP://A.NET/fr/x", "http://a.net/fr/x?y=1&z=2#w"])]
    docs = pages.select("page_id", "url").unionByName(spark.createDataFrame(more, "page_id long, url string"))
    boosting, urls_ = urls.Boosting(), {r["page_id"]: r["url"] for r in docs.collect()}
    rows = {r["page_id"]: r for r in urls.judge_urls(docs).collect()}
    assert rows.keys() == urls_.keys()

    rules = [(r.verdict, r.host, r.path) for r in urls.RULES]
    rule, parts = {}, {}
    for i, url in urls_.items():
        parts[i] = fixtures.url_parts(url)
        rule[i] = fixtures.fitted(*parts[i], rules)
        assert (rows[i]["host"], rows[i]["path"]) == parts[i]
        assert rows[i]["rule"] == (rule[i] and rule[i][1] + rule[i][2])
        assert rows[i]["verdict"] == (rule[i][0] if rule[i] else "block" if rows[i]["score"] >= 0.5 else "allow")

    described = urls.with_suffix_rate(urls.described(docs, urls.RULES, boosting), boosting)
    shown = {r["page_id"]: r for r in described.select("page_id", "slot", "suffix_rate", "judged", *(
        F.expr(e).alias(f"f_{f}") for f, e in urls.FEATURES.items())).collect()}
    known = [i for i in urls_ if rule[i]]
    blocked = {i: int(rule[i][0] == "block") for i in known}
    whole, plain = sum(blocked.values()) / len(known), {}
    for i, url in urls_.items():
        mine = [blocked[k] for k in known if shown[k]["slot"] == shown[i]["slot"]]
        suffix = (sum(mine) + boosting.prior * whole) / (len(mine) + boosting.prior)
        plain[i] = fixtures.url_features(url or "", *parts[i]) | {"suffix": suffix}
        assert [shown[i][f"f_{f}"] for f in urls.FEATURES] == pytest.approx([plain[i][f] for f in urls.FEATURES], abs=1e-9)

    steps = [(k + 1) / boosting.bins for k in range(boosting.bins - 1)]
    labelled = described.where("judged IS NOT NULL").select(*(F.expr(e).alias(f) for f, e in urls.FEATURES.items()))
    cuts = [sorted(set(q)) for q in labelled.approxQuantile(list(urls.FEATURES), steps, 0.01)]
    bins = {i: [sum(shown[i][f"f_{f}"] > c for c in q) for f, q in zip(urls.FEATURES, cuts)] for i in urls_}
    want = fixtures.boosted([bins[i] for i in known], [blocked[i] for i in known], [bins[i] for i in urls_])
    assert [rows[i]["score"] for i in urls_] == pytest.approx(want, abs=1e-6)


# --- 3: mixing ----------------------------------------------------------------------------

def test_mixing(spark, odd, nothing):
    for docs in (odd, fixtures.frame(spark, [(i, "w " * (1 + i % 9), "", f"s{i % 7 % 4}", *[None] * 9) for i in range(900)])):
        rows = mixing.mix(docs).collect()
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, fixtures.word_counts(t)[0]) for d, t in pairs(docs))
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
        assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in rows)
    targets = {(r["source_size"], r["target"]) for r in rows}
    assert math.isclose(sum(t for _, t in targets), sum(r["size"] for r in rows))
    for size, target in targets:
        taken = sum(r["taken"] for r in rows if r["source_size"] == size and r["target"] == target)
        assert abs(taken - target) <= 9
    assert mixing.mix(nothing).collect() == []


# --- 4: top-k -----------------------------------------------------------------------------

def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 6) for i in range(300)]  # one very common vector
    rows += [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 6), (1300, [float("inf")]), (1400, [2.0]), (None, [1.0]), (5, [9.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, score int, cell int")
    got = topk.top_k(df, topk.Search(chunk=64, queries=3)).collect()
    whole = [(i, np.pad(x, (0, 6 - len(x)))) for i, v in rows if i is not None
             and (x := topk.whole_numbers([None if c is None else float(np.float32(c)) for c in v] if v is not None else None, 1024)) is not None]
    for q, x in whole:
        if q % 100 == 0:
            want = sorted((-int(x @ y), i) for i, y in whole if i != q)[:10]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert {r["query_id"] for r in got} == {q for q, _ in whole if q % 100 == 0}
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where("vec_id = 1000")).collect() == []


def test_top_k_of_repeated_queries(spark):
    """Equal rows of a query's vec_id ask once, and none of them takes the place of an answer in the bounds."""
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(1, 90)]
    rows += [(100, [1.0, 2.0, 3.0, 1.0])] * 30 + [(200, [float(i), 1.0, 0.0, 0.0]) for i in (1, 2, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    for search in (topk.Search(every=100, chunk=16), topk.Search(every=100, pivots=40, k=5)):
        got = topk.top_k(df, search).collect()
        for q in (100, 200):
            asked = {tuple(v) for i, v in rows if i == q}
            want = sorted((-1024 * 1024 * int(np.dot(x, y)), i) for x in asked for i, y in rows if i != q)[:search.k]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_bounds_count_vec_ids(spark):
    """Ten rows of the query's own vec_id are nearest; the pair of cells that holds the answer stays joined."""
    rows = [(100, False, 0, 0.1)] * 10 + [(1, False, 1, 0.2), (2, False, 1, 3.0)]
    cells = spark.createDataFrame(rows, "vec_id long, query boolean, cell int, distance double")
    asked = spark.createDataFrame([(100, 0, 0.1)], "vec_id long, cell int, distance double")
    limits = topk.bounds(cells, asked, topk.Search(k=1), np.array([[0.0], [5.0]]))
    assert limits[0, 1] <= 0.2


def test_top_k_of_clusters_moves_little(spark, monkeypatch):
    """Clusters far apart and of different norms: queries go to few cells, and the answers stay exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (24, 8)) * rng.uniform(0.5, 1.5, (24, 1))
    x = centres[rng.integers(0, 24, 6000)] + rng.normal(0, 0.05, (6000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    kept, went = topk.stored, []

    def counted(frame, purpose):
        out = kept(frame, purpose)
        if purpose == "knn-reach":
            went.extend(len(r["data_cell"]) for r in out.collect())
        return out

    monkeypatch.setattr(topk, "stored", counted)
    got = topk.top_k(df, topk.Search(pivots=24, chunk=200, queries=16)).collect()
    whole = np.array([topk.whole_numbers(v, 1024) for v in x])
    for q in range(0, 6000, 100):
        scores = whole @ whole[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [
            (k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert len(went) == 60 and sum(went) < 60 * 24 / 3


def test_whole_numbers_of_extreme_components():
    assert topk.whole_numbers([1e308, -1e308, 0.5], 1024).tolist() == [2 ** 62, -2 ** 62, 512]
    assert topk.whole_numbers([float("inf")], 1024) is None and topk.whole_numbers([None], 1024) is None


def test_products_are_exact():
    big = np.array([[2 ** 40, 3], [1, -(2 ** 40)]])
    assert (topk.products(big, np.array([[2 ** 20 + 1, 5]])) == big @ np.array([[2 ** 20 + 1], [5]])).all()


# --- 5: quality rules ---------------------------------------------------------------------

def test_quality_counts(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = quality.judge(odd, labels).collect()
    want = Counter((d, *fixtures.word_counts(t)) for d, t in pairs(odd))
    assert Counter((r["doc_id"], *(r[c] for c in quality.COUNTS[:5])) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    assert quality.judge(nothing, labels).collect() == []


def test_quality_rules_hold_out(spark, sf_dir):
    """Rules learnt from two thirds of the labels judge the others."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    apart = F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(3)) == 0
    judged = quality.judge(docs, labels.where(~apart)).where("NOT base_failed").join(labels.where(apart), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert len(judged) > 80 and right >= 0.95 * len(judged)
    assert all(r["kept"] for r in judged if r["quality"] == 1)


# --- 6: secrets ---------------------------------------------------------------------------

def check_secrets(docs):
    rows = secrets.digest(secrets.scan_documents(docs)).collect()
    want = Counter()
    for d, t in pairs(docs):
        found = fixtures.base_secrets(t)
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        want[(d, *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want
    return rows


def test_secrets(spark, odd, nothing, sf_dir):
    check_secrets(odd)
    check_secrets(table(spark, sf_dir, "documents"))
    assert check_secrets(nothing) == []


def test_character_model_finds_random_strings(spark):
    rng = random.Random(5)
    letters = secrets.ALPHABET[:62]

    def key(n=32):
        return "".join(rng.choice(letters) for _ in range(n))

    plain = ["the connection_handler returned another_identifier_name while reading configuration_settings_file"] * 400
    rows = [(i, f"{plain[i]} password={key()}" if i % 2 else plain[i]) for i in range(400)]
    hidden = [(1000 + i, f"some words {key()} and_an_ordinary_identifier_name here") for i in range(10)]
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan_documents(
        spark.createDataFrame(rows + hidden, "doc_id int, text string"))).collect()}
    assert sum(got[d] == "markov:11:43" for d, _ in hidden) >= 9
    assert all("markov" not in got[d] for d, _ in rows)


def test_redaction(odd):
    out = secrets.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[12] == "ünïcode 漢字 😀 [secret] and tail 😀 [secret]\""
    assert texts[2] is None and texts[1] == "" and texts[6] == fixtures.PASSAGE


def plain_redaction(text, spans, mark="[secret]"):
    out, at = "", 0
    for span in spans.split(",") if spans else ():
        start, end = map(int, span.split(":")[1:])
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:] if spans else text


def test_spans_that_meet_and_overlap(spark):
    """Random texts of keys, assignments and tokens that touch: all spans and the redaction against plain versions."""
    rng = random.Random(11)

    def token():
        kind, body = rng.randrange(5), "".join(rng.choices(secrets.ALPHABET[:62], k=rng.randrange(4, 40)))
        return [body, "AKIA" + body.upper(), f"password={body}", "0123456789abcdef" * 2 + rng.choice(["", body]),
                f"{body}/token: {body}"][kind]

    texts = ["".join(token() + rng.choice([" ", "", " 😀 ", "\n", "é=", " " * 5000]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "s", "e", "b", 1) for i, t in enumerate(texts)],
                                 "doc_id int, text string, __spans string, ends string, blocks string, `row` int")
    rows = {r["doc_id"]: r["spans"] for r in check_secrets(docs)}
    whole = {r["doc_id"]: r for r in secrets.scan_documents(docs).collect()}
    every = {r["doc_id"]: r for r in secrets.scan_documents(docs, secrets.Scan(odds=-1e9)).collect()}
    edge = 0
    for i, text in enumerate(texts):
        base = fixtures.base_secrets(text)
        spans = [(s["start"], s["kind"], s["end"]) for s in whole[i]["spans"]]
        assert spans == sorted(spans) and [s for s in spans if s[1] < 3] == base
        tokens = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text)]
        alone = [t for t in tokens if not any(a < t[1] and t[0] < b for a, _, b in base)]
        assert {(a, b) for a, k, b in spans if k == 3} <= set(alone)
        assert [(s["start"], s["end"]) for s in every[i]["spans"] if s["kind"] == 3] == alone
        assert all(text[s["start"]:s["end"]].endswith(s["value"]) for s in whole[i]["spans"])
        edge += len(tokens) - len(alone)
    assert edge > 100 and any("markov" in s for s in rows.values())
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {i: plain_redaction(t, rows[i]) for i, t in enumerate(texts)}


def test_hits_of_one_text_cost_alike(spark):
    """Ten times the hits of a text take about ten times as long, not a hundred times."""
    def seconds(hits):
        text = " ".join(f"{hashlib.md5(str(i).encode()).hexdigest()}é" for i in range(hits))
        docs = spark.createDataFrame([(1, text)], "doc_id int, text string").cache()
        docs.count()
        started = time.time()
        clean = secrets.redacted(docs).first()["text"]
        took = time.time() - started
        assert clean == " ".join(["[secret]é"] * hits)
        return took

    seconds(100)
    assert seconds(40_000) < 12 * max(seconds(4_000), 1)


# --- 7: languages -------------------------------------------------------------------------

def test_language_hold_out(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["held_out"] for r in got} == {True, False}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)


def test_languages_equal_exact_sets(spark, sf_dir):
    """Predictions of all documents against exact n-gram sets; the filter's false positives are corrected to 0.01."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in language.identify(table(spark, sf_dir, "documents")).collect()}
    assert got.keys() == {r["doc_id"] for r in docs}
    training = [(r["text"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] and r["text"]]
    order, shares = fixtures.language_shares(training, [r["text"] for r in docs])
    for r, share in zip(docs, shares):
        mine = got[r["doc_id"]]
        if share is None:
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        assert mine["score"] == pytest.approx(max(share), abs=0.01)
        assert share[order.index(mine["lang_pred"])] >= max(share) - 0.01


def test_language_odd_rows(odd, nothing):
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count()
    learnt = {r["lang"] for r in odd.collect()} - {None}
    for r in rows:
        text = dict(pairs(odd)).get(r["doc_id"]) if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert r["lang_pred"] in learnt | {"und"}
    assert language.identify(nothing).collect() == []
    unlearnt = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlearnt} == {("und", 0.0)}


def test_many_languages_fill_several_words(spark):
    """70 languages of their own two letters each need two words a slot."""
    pairs_ = [(chr(0x4E00 + 2 * k), chr(0x4E01 + 2 * k)) for k in range(70)]
    rows = [(i, "".join(random.Random(i).choices(p, k=60)), f"l{i % 70:02d}") for i, p in enumerate(pairs_ * 9)]
    got = language.identify(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 70:02d}" and r["score"] > 0.9 for r in got)


# --- 8: packing ---------------------------------------------------------------------------

def check_packing(docs, plan=packing.Packing()):
    rows, held = packing.pack_documents(docs, plan).collect(), defaultdict(list)
    for d, t in pairs(docs):
        held[d].append(packing.token_ids(t))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= plan.capacity and at & (at - 1) == 0  # no padding at a power of two
    for d, all_ids in held.items():
        for ids in all_ids:
            mine, copies = sorted(pieces[d, len(ids)]), sum(len(x) == len(ids) for x in all_ids)
            cover = Counter()
            for start, length, crc in mine:
                assert any(zlib.crc32(x[start:start + length].tobytes()) == crc for x in all_ids)
                cover.update(range(start, start + length))
            assert cover == {k: copies for k in range(len(ids))}
    return rows


def test_packing(spark, odd, nothing, sf_dir):
    check_packing(odd)
    check_packing(odd, packing.Packing(capacity=64, window=500))
    check_packing(table(spark, sf_dir, "documents"))
    assert check_packing(nothing) == []


def test_ids_equal_the_other_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in pairs(table(spark, sf_dir, "documents"))] + [r[1] or "" for r in fixtures.odd_rows()]
    odd_runs = ["<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  <|endoftext|>", " " * 120_000 + "x", "a" + " \n" * 60_000,
                "abc" * 100_000, "#" * 60_000, "\u00a0" * 60_000 + " end"]
    for text in [*texts, *odd_runs]:
        assert packing.token_ids(text).tolist() == [*other.encode(text, add_special_tokens=False).ids, 1]


def test_very_long_runs_are_packed(spark):
    """Two million blanks, letters or blanks behind a word: none ends the task, and no id is lost."""
    assert packing.token_ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 1]
    docs = spark.createDataFrame([(1, " " * 2_000_000), (2, "abc" * 700_000), (3, "a" + "\n" * 1_000_000 + "b")], "doc_id int, text string")
    rows = packing.pack_documents(docs).collect()
    for d, n in {r["doc_id"]: r["doc_tokens"] for r in rows}.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == d) == n > 100


def test_low_cost_sequences_first():
    """Equal documents spread evenly, and a piece is cut only if it fits nowhere."""
    pieces = packing.assign([1000] * 8, packing.Packing())
    assert len(pieces) < 8 + len(packing.capacities(8000, 2048))
    assert sorted(k for _, start, n, k, _ in pieces if n == 1000)[:4] == [0, 0, 1, 1]
    assert sum(n for _, _, n, _, _ in pieces) == 8000


# --- 9: Jaccard join ----------------------------------------------------------------------

def near_copies(n=60, seed=2):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(n // 4)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 3 % 101, " ".join(words)))
    return rows


@pytest.mark.parametrize("config", [
    jaccard.Similarity(), jaccard.Similarity(unit_words=150, slots=8, frequent=10, held=50),
    jaccard.Similarity(unit_words=150, hubs=1, hot=2), jaccard.Similarity(unit_sets=2, hubs=0, hot=0)])
def test_jaccard(spark, odd, config):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    for frame in (docs, odd):
        got = jaccard.linked(frame, config).collect()
        assert Counter(map(tuple, got)) == Counter(fixtures.jaccard_components(pairs(frame)))


def test_jaccard_whole_table(spark, sf_dir, nothing):
    docs = table(spark, sf_dir, "documents")
    assert Counter(map(tuple, queries.QUERIES["op9_jaccard_join"](spark, sf_dir).collect())) == Counter(
        fixtures.jaccard_components(pairs(docs)))
    assert jaccard.linked(nothing).collect() == []


def test_a_group_of_near_copies_is_sent_about_once(spark, monkeypatch):
    """One group of many blocks and some texts of other words that hang on to it by a chain."""
    rng, base = random.Random(4), [f"b{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(40):  # each differs from the one before by two words
        base = base[2:] + [f"c{i}", f"d{i}"]
        rows.append((3000 + i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sent, stored = {}, jaccard.stored

    def counted(df, purpose):
        out = stored(df, purpose)
        sent.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    config = jaccard.Similarity(unit_sets=100, hot=500, frequent=1 << 12)
    got = jaccard.linked(docs, config).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 3040
    members, blocks = sent["jaccard-members"][0], 31
    assert sum(sent["jaccard-units"]) < 2 * members + 4 * config.hubs * blocks < members * blocks / 4


def test_sizes_of_similar_sets_are_in_neighbouring_bands():
    for config in (jaccard.Similarity(), jaccard.Similarity(at_least=80), jaccard.Similarity(at_least=100)):
        for n in range(1, 3000):
            for m in range(n, config.of * n // config.at_least + 1):
                assert config.band(m) - config.band(n) in (0, 1)


def test_links_lose_no_component():
    rng = random.Random(9)
    for _ in range(40):
        base = [rng.randrange(2 ** 63) for _ in range(rng.randint(1, 60))]
        sets = []
        for _ in range(25):
            s = set(base)
            for _ in range(rng.randint(0, len(base) // 6)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(2 ** 63))
            sets.append(np.array(sorted(s), np.uint64))
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    label = [label[i] if x == label[j] else x for x in label]
        mine = list(range(len(sets)))
        for i, j in jaccard.links(sets, jaccard.Similarity()):
            mine = [mine[i] if x == mine[j] else x for x in mine]
        assert len(set(zip(label, mine))) == len(set(label)) == len(set(mine))


def test_one_of_each_group_stays(odd):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    smallest = {d for d, _, c in fixtures.jaccard_components(pairs(odd)) if d is not None and d == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter(smallest)
    assert ids.count(None) == 1  # the copy of a document that has an id goes


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 300), (300, 200), (400, 399)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[300] == got[200] == 200 and got[400] == 399
    hub = [(7, i) for i in range(8, 400)]
    assert {r["component"] for r in graph.components(spark.createDataFrame(hub, "u long, v long")).collect()} == {7}


def test_one_of_each_judges_texts(spark):
    """Two texts under one id, copies under one id and without any, near copies of both, texts without words."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a30", "zz")
    rows = [(1, a), (1, b), (1, b), (2, near), (3, c), (None, c), (None, "only here without an id at all"), (None, "only here without an id at all"),
            (None, near), (None, None), (None, ""), (7, ""), (7, "")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id int, text string, _key string, _rows int").repartition(5)
    kept = jaccard.one_of_each(docs, jaccard.Similarity(words=3, at_least=80))
    assert kept.columns == docs.columns
    assert Counter(tuple(r)[:2] for r in kept.collect()) == Counter([
        (1, a), (1, b), (3, c), (None, "only here without an id at all"), (None, None), (None, ""), (7, ""), (7, "")])


# --- 10: suffixes -------------------------------------------------------------------------

def test_suffix_order_finds_repeats():
    rng = random.Random(1)
    for _ in range(200):
        length, alphabet = rng.choice([8, 16, 24]), rng.choice([b"ab", b"abc", b"a", bytes(range(97, 123))])
        regions = [bytes(rng.choice(alphabet) for _ in range(rng.randint(length, length + 60))) for _ in range(rng.randint(1, 5))]
        seen, begin = defaultdict(list), 0
        for r in regions:
            for i in range(len(r) - length + 1):
                seen[r[i:i + length]].append(begin + i)
            begin += len(r) + 1
        want = sorted(p for v in seen.values() if len(v) > 1 for p in v)
        assert suffixes.repeated_starts(regions, [len(r) - length + 1 for r in regions], length).tolist() == want


def removed(docs, config=suffixes.Repeats()):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                   for r in suffixes.remove_repeats(docs, config).collect())


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffixes(spark, odd, crowd):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcde ") for _ in range(700))
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 900)))
             + passage[rng.randint(0, 200):rng.randint(300, 700)] + "é" * rng.randint(0, 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    short = odd.where("doc_id IS NULL OR doc_id <> 10")
    for frame in (docs, short):
        assert removed(frame, suffixes.Repeats(crowd=crowd, slots=16)) == Counter(fixtures.repeated_bytes(pairs(frame)))


def test_suffixes_whole_table(spark, sf_dir, nothing):
    docs = table(spark, sf_dir, "documents")
    assert removed(docs) == Counter(fixtures.repeated_bytes(pairs(docs)))
    assert removed(nothing) == Counter()


def test_a_very_long_text(spark):
    """A text longer than a stretch of anchor places, with one repeat far apart."""
    rng = np.random.default_rng(7)
    text = rng.integers(97, 123, 9_000_000).astype(np.uint8)
    text[-500:] = text[1000:1500]
    docs = spark.createDataFrame([(1, text.tobytes().decode())], "doc_id int, text string")
    row = suffixes.remove_repeats(docs).first()
    assert row["removed"] == "1000:1500,8999500:9000000"


def test_spans_of_many_copies_are_bounded_by_their_text(spark, monkeypatch):
    """One text in every task: the list of its spans does not grow with the copies."""
    text, seen = " ".join(f"w{i * 7919 % 997}" for i in range(400)), []
    monkeypatch.setattr(suffixes, "stored", lambda df, name, keep=suffixes.stored: (lambda out: (seen.append(out) if name == "repeat-spans" else None, out)[1])(keep(df, name)))
    for parts in (4, 16):
        docs = spark.createDataFrame([(i, text + f" tail{i % 2}" * 9) for i in range(64)], "doc_id int, text string").repartition(parts)
        assert Counter(r["n_bytes"] - r["n_removed"] for r in suffixes.remove_repeats(docs).collect()) == {0: 64}
    few, many = (max(len(r["spans"]) for r in s.collect()) for s in seen)
    assert many <= few + 1

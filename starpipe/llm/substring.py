"""Substring deduplication by hashing lines (operator 1).

Lines are cut further at sentence ends so that a passage set into a line is found too. Units and
whole texts are normalised and digested; digests are grouped over all documents; the occurrence
of lowest rank, by document id and then position, is the first. A text that repeats a whole
earlier one goes as a whole. Elsewhere a repeated unit goes where it stands in a stretch of repeated
units with enough words together, so that passages go with all their short sentences, and sentences
that recur by chance stay. What is kept and removed is told in offsets of the original text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import byte_slices, merge_lookup, python_tasks, stored

UNITS = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("unit", pa.int32())])
CLEANED = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()),
                     ("removed", pa.string()), ("text", pa.string())])
WHOLE = -1  # the number of the whole text among its units


@dataclass(frozen=True)
class Units:
    """Units end with one of `ends`; neighbours that repeat go if they have `run_words` words together."""

    ends: tuple[str, ...] = ("\n", ". ")
    run_words: int = 12

    def of(self, text: str) -> list[str]:
        """The units of a text with their ends; joined they are the text."""
        pieces = [text]
        for end in self.ends:
            cut = [p.split(end) for p in pieces]
            pieces = [x for c in cut for x in (*(y + end for y in c[:-1]), c[-1])]
        return pieces


def digest(words: list[bytes]) -> bytes:
    """MD5 of the words in lower case (A to Z), joined by one blank."""
    return hashlib.md5(b" ".join(words)).digest()


def digests(text: str | None, units: Units) -> list[tuple[int, bytes]]:
    """Number and digest of each unit that has a word, and of the whole text."""
    words = [u.encode().lower().split() for u in units.of(text or "")]
    found = [(k, digest(w)) for k, w in enumerate(words) if w]
    return [(WHOLE, digest([b"", *(x for w in words for x in w)])), *found] if found else []


def gone(parts: list[str], repeated: set[int], units: Units) -> set[int]:
    """Numbers of the units to remove, of those that repeat; units without words do not part a stretch."""
    if WHOLE in repeated:
        return set(range(len(parts)))
    out: set[int] = set()
    run: list[int] = []
    held = 0
    for k in range(len(parts) + 1):
        words = len(parts[k].encode().split()) if k < len(parts) else -1
        if k in repeated:
            run.append(k)
            held += words
        elif words:
            if held >= units.run_words:
                out.update(run)
            run, held = [], 0
    return out


def _digests(units: Units):
    def rows(batches):
        for batch in byte_slices(batches, "text", 1 << 20):
            found = [(int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc_id, row, k)
                     for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")))
                     for k, d in digests(text, units)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found), UNITS)], schema=UNITS)

    return rows


def _clean(units: Units):
    def rows(batches):
        for batch in byte_slices(batches, "text"):
            out = []
            for doc_id, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "repeated"))):
                if text is None:
                    out.append((doc_id, 0, 0, "", None))
                    continue
                parts, start, kept, spans = units.of(text), 0, [], []
                drop = gone(parts, set(repeated or ()), units)
                for k, part in enumerate(parts):
                    if k in drop:
                        spans.append(f"{start}:{start + len(part)}")
                    else:
                        kept.append(part)
                    start += len(part)
                out.append((doc_id, len(parts), len(spans), ",".join(spans), "".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), CLEANED)], schema=CLEANED)

    return rows


def repeats(rows: DataFrame, units: Units = Units()) -> DataFrame:
    """row and the numbers of its units that are not the first of their kind. `rows` is stored."""
    python_tasks(rows.sparkSession)
    found = stored(rows.mapInArrow(_digests(units), "high long, low long, doc_id long, row long, unit int"), "line-digests")
    place = F.struct("doc_id", "row", "unit")
    first = stored(found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("unit").alias("n"))
                   .where("n > 1").select("high", "low", "first"), "line-first")
    later = merge_lookup(found, first, ["high", "low"], "inner").where(~place.eqNullSafe(F.col("first")))
    return stored(later.groupBy("row").agg(F.collect_set("unit").alias("repeated")), "line-removals")


def remove_repeats(docs: DataFrame, units: Units = Units()) -> DataFrame:
    """doc_id, n_units, n_removed, removed, text of each row of `docs` (doc_id, text).

    `removed` lists start:end of the removed units in code points of the original, comma-joined;
    `text` is what stays. A null text stays null without units, an empty one has one unit that
    stays. The rank is (doc_id, row, position), null ids first; each row is a document of its own,
    so rows that share an id, or have none, lose what another row has first. Rows are
    numbered by a stored copy of the two columns; others are not read. Units differing only in ASCII
    case or white space are equal. No documents give no rows.
    """
    numbered = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                  F.monotonically_increasing_id().alias("row")), "line-documents")
    joined = merge_lookup(numbered, repeats(numbered, units), ["row"], "left").select("doc_id", "text", "repeated")
    return joined.mapInArrow(_clean(units), "doc_id long, n_units long, n_removed long, removed string, text string")


SQL = r"""
WITH s AS (SELECT doc_id, string_split(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), chr(1)) AS u
           FROM documents),
u AS (SELECT doc_id, UNNEST(u) AS unit, UNNEST(range(len(u))) AS k FROM s),
p AS (SELECT doc_id, k, unit, COALESCE(SUM(length(unit)) OVER (
        PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        array_to_string(regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^ 	-
]+'), ' ') AS words FROM u),
b AS (SELECT doc_id, k, words, len(string_split(words, ' ')) AS n,
             ROW_NUMBER() OVER (PARTITION BY words ORDER BY doc_id, k) > 1 AS again,
             ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM p WHERE words <> ''),
i AS (SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY doc_id, again ORDER BY k) AS run FROM b),
g AS (SELECT doc_id, k, again AND SUM(n) OVER (PARTITION BY doc_id, again, run) >= 12 AS gone FROM i),
t AS (SELECT doc_id, string_agg(words, ' ' ORDER BY k) AS words FROM b GROUP BY doc_id),
w AS (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY words ORDER BY doc_id) > 1 AS copy FROM t),
r AS (SELECT p.doc_id, p.k, unit, start, COALESCE(gone, FALSE) OR COALESCE(copy, FALSE) AS gone
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.k = g.k LEFT JOIN w ON p.doc_id = w.doc_id)
SELECT t.doc_id, COALESCE(n_units, 0) AS n_units, COALESCE(n_removed, 0) AS n_removed,
       COALESCE(removed, '') AS removed, kept AS text
FROM documents t LEFT JOIN (
  SELECT doc_id, COUNT(*) AS n_units, COUNT(*) FILTER (gone) AS n_removed,
         string_agg(start || ':' || start + length(unit), ',' ORDER BY k) FILTER (gone) AS removed,
         COALESCE(string_agg(unit, '' ORDER BY k) FILTER (NOT gone), '') AS kept
  FROM r GROUP BY doc_id) x ON t.doc_id = x.doc_id
"""

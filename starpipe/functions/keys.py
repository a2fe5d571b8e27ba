"""Date keys, ISO text and row hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS"  # fixed value: timestamp text of the export


def date_key(ts: Column) -> Column:
    """yyyyMMdd as an integer, by arithmetic rather than by formatting and parsing."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def row_hash(columns: Iterable[Column], null_marker: str | None = None) -> Column:
    """SHA-256 of the column texts joined by a bar.

    Without a marker nulls are skipped, so (a, null, b) and (a, b, null) hash alike; that is
    the published form. A marker keeps their places apart.
    """
    texts = [c.cast("string") for c in columns]
    if null_marker is not None:
        texts = [F.coalesce(t, F.lit(null_marker)) for t in texts]
    return F.sha2(F.concat_ws("|", *texts), 256)

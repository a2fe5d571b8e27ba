"""Helpers of the corpus operators: stored tables, size-checked lookups, bounded batches."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpipe.session import shared_folder

#: A word is a longest run of characters that are none of the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and estimated bytes up to which the smaller side of a lookup is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 24 << 20
#: Text bytes that a Python helper holds at once; a single longer text comes alone.
SLICE_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_SHIPPED: set[str] = set()


def python_tasks(spark: SparkSession) -> None:
    """Make this package importable in Python workers; Spark itself hands the archive to executors.

    Batches for Python are bounded by their bytes too, unless the session has a lower bound: rows alone
    would let one hold all texts of a task, in the worker and several times in the executor's JVM.
    Spark takes the bound when a plan is run, so it stays with the session.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(BATCH_BYTES).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > SLICE_BYTES:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = f"{tempfile.mkdtemp()}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Whether `df` (stored, so that counting is cheap) may be broadcast."""
    return df.count() <= min(BROADCAST_ROWS, BROADCAST_BYTES // max(1, row_bytes))


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Join `df` to a stored summary (a row per source or the like): broadcast below the bounds,
    else as `merge_lookup`."""
    if small_enough(small, row_bytes):
        return df.join(F.broadcast(small), on, how)
    return merge_lookup(df, small, on, how)


def merge_lookup(df: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join `df` to a table that grows with it and has one row per key.

    Both sides are exchanged by the key whatever their size; adaptive execution splits keys that
    hold many rows of `df`.
    """
    return df.join(other.hint("merge"), on, how)


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About `rows` rows of a stored `df` by a hash of `key`, or all if there are fewer; no sort."""
    total, grain = df.count(), 1_000_000
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*key), F.lit(grain)) < max(1, grain * rows // total))


def byte_slices(batches: Iterable[pa.RecordBatch], column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `limit` bytes in each."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)

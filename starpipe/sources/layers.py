"""Layer reads: one month's folder, the trial's own before the shared one."""

from __future__ import annotations

from collections import defaultdict
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpipe.sinks.files import file_sizes
from starpipe.sources.landing import read_first
from starpipe.sources.records import partition_count
from starpipe.spec import Layout

PART_MIB = 256  # of a table that is worked on in parts
PARTS = 8


def read_layer(
    spark: SparkSession, layout: Layout, layer: str, year: int, month: int,
    fallback: bool = True,
) -> DataFrame:
    """Read the month folder itself, so year and month stay those stored in the rows."""
    paths = layout.candidates(layer, year, month)
    return read_first(paths if fallback else paths[:1], spark.read.parquet)


def in_parts(df: DataFrame) -> list[DataFrame]:
    """The rows of a Parquet layer as frames over some of its files each, for work that is done a part after the other.

    Every row is in one of them. They are about equal, of PART_MIB at least, and PARTS at most, so that what is done once for
    each part grows no faster than the layer.
    """
    spark = df.sparkSession
    sizes = file_sizes(spark, sorted(unquote(f) for f in df.inputFiles()))
    whole = sum(sizes.values())
    parts = min(PARTS, int(whole / (PART_MIB * 2**20)))
    if parts < 2:
        return [df]
    files, before = defaultdict(list), 0
    for file, size in sizes.items():
        files[before * parts // whole].append(file)
        before += size
    return [spark.read.schema(df.schema).parquet(*some) for some in files.values()]


def spread_out(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table comes in fewer pieces than there are; else as they are.

    A file of one row group is read by one task, which would do all the work behind it alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if partition_count(df) >= cores else df.repartition(cores)


def read_dictionaries(
    spark: SparkSession, layout: Layout, names: tuple[str, ...],
    overrides: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All dictionaries by name; each path can be overridden, all must exist."""
    paths = {name: (overrides or {}).get(name) or layout.dictionary(name) for name in names}
    return {name: read_first([path], spark.read.parquet) for name, path in paths.items()}


def month_of_table(spark: SparkSession, table: str, year: int, month: int) -> DataFrame:
    """One month of a table partitioned by year and month."""
    return spark.table(table).where((F.col("year") == year) & (F.col("month") == month))

"""The warehouse fact: a catalogue table partitioned by month, loaded one month at a time.

A month is a folder of versions; the catalogue names the one that counts. A load writes a new
version and then changes that name, so a month is replaced as a whole or not at all.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starpipe.operators.constraints import ForeignKey, LoadRejected, require_loadable
from starpipe.session import shared_folder
from starpipe.sinks.files import folder_mib, folder_names, move, remove_folder, write_text
from starpipe.sinks.parquet import replace_months, write_parquet

# A key is the month's number (12 bits) and the row's number (51 bits).
_MONTH_SHIFT = 51
_ROW_BITS = 33  # of monotonically_increasing_id, which has the task above them


@dataclass(frozen=True)
class LoadReport:
    """`mib` is what the month takes in the table, `mib_in` the size of the files it was read from."""

    rows_loaded: int
    wall_sec: float
    mib: float = 0.0
    mib_in: float = 0.0

    def record(self) -> dict[str, object]:
        """The load as bench columns; rates are of what was read, over the wall time of the whole load."""
        rate = 1 / self.wall_sec if self.wall_sec else None
        return {"rows_out": self.rows_loaded, "wall_sec": self.wall_sec, "bytes_in_mb": self.mib_in,
                "bytes_out_mb": self.mib, "copy_throughput_mib_s": rate and round(self.mib_in * rate, 6),
                "copy_throughput_rows_s": rate and round(self.rows_loaded * rate, 6)}


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 without gaps, whatever the number of tasks.

    `df` comes from files by projections, so that its tasks hold the same rows when they are
    counted first. One row per task is summed up and broadcast.
    """
    at = df.withColumn(name, F.monotonically_increasing_id())
    task = F.shiftright(name, _ROW_BITS).alias("__task")
    counts = at.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    placed = at.withColumn("__task", task).join(F.broadcast(starts), "__task")
    row = F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("__start")
    return placed.select(*df.columns, row.alias(name))


def surrogate_key(year: Column, month: Column, row: Column) -> Column:
    """A key unique over all months from a row number unique within the month."""
    serial = ((year - 1970) * 12 + month).cast("long")
    fits = serial.between(0, (1 << 63 - _MONTH_SHIFT) - 1) & (row < F.lit(1 << _MONTH_SHIFT))
    return F.when(fits, F.shiftleft(serial, _MONTH_SHIFT) + row).otherwise(
        F.raise_error(F.lit("month or row number outside of what a surrogate key holds")))


def stamp(df: DataFrame, month: tuple[int, int] | None = None) -> DataFrame:
    """Add the surrogate key and the load time; with `month` all keys are of that month."""
    year_of, month_of = map(F.lit, month) if month else (F.col("year"), F.col("month"))
    return numbered(df, "__row").select(
        surrogate_key(year_of, month_of, F.col("__row")).alias("trip_id"),
        *[F.col(c) for c in df.columns],
        F.current_timestamp().alias("load_dt"),
    )


def _new_version() -> str:
    """A name that sorts behind those given before."""
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


@dataclass(frozen=True)
class MonthTable:
    """A table of the catalogue whose months are versioned folders below `root`.

    A version is written once and never changed. Readers see the version that the catalogue's
    partition points to, so a write that dies leaves the month as it was, and a reader that
    began before a switch finishes on the version before. One load of a month runs at a time.
    """

    spark: SparkSession
    name: str
    root: str

    def folder(self, year: int, month: int) -> str:
        return f"{self.root}/year={year}/month={month}"

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def snapshot(self, year: int, month: int) -> DataFrame:
        """The rows of the month's version as it is now, by its folder: they stay readable without the catalogue."""
        columns = self.read().schema
        rows = self.spark.read.schema(T.StructType([f for f in columns if f.name not in ("year", "month")])).parquet(
            f"{self.folder(year, month)}/{self.current(year, month)}")
        return rows.withColumns({"year": F.lit(year), "month": F.lit(month)}).select(*columns.names)

    def current(self, year: int, month: int) -> str | None:
        """The version that counts; None for a month without one."""
        if f"year={year}/month={month}" not in self._months():
            return None
        described = self.spark.sql(f"DESCRIBE EXTENDED {self.name} PARTITION (year={year}, month={month})")
        places = [r["data_type"] for r in described.where("col_name = 'Location'").collect()]
        return places[0].rsplit("/", 1)[1]

    def _months(self) -> set[str]:
        return {r["partition"] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()}

    def versions(self, year: int, month: int) -> list[str]:
        """All version folders of a month, oldest first."""
        return [n for n in folder_names(self.spark, self.folder(year, month)) if n.startswith("v")]

    def complete(self, year: int, month: int) -> list[str]:
        return [v for v in self.versions(year, month)
                if "_SUCCESS" in folder_names(self.spark, f"{self.folder(year, month)}/{v}")]

    def write_version(self, df: DataFrame, year: int, month: int, codec: str = "snappy") -> str:
        """The rows as a new version, which nothing points to yet."""
        version = _new_version()
        write_parquet(df.drop("year", "month"), f"{self.folder(year, month)}/{version}", codec=codec)
        return version

    def unchecked(self, year: int, month: int) -> str:
        """A fresh folder beside the versions for rows that are not checked: never taken for a version."""
        return f"{self.folder(year, month)}/new-{uuid.uuid4().hex}"

    def adopt(self, folder: str, year: int, month: int) -> None:
        """Make a folder of checked rows the month's version, then let older ones go as `replace` does."""
        before, version = self.current(year, month), _new_version()
        move(self.spark, folder, f"{self.folder(year, month)}/{version}")
        self._take(version, before, year, month)

    def switch(self, versions: Mapping[tuple[int, int], str]) -> None:
        """Make versions those of their months: one change of the catalogue for each known month, and
        one for all new months together."""
        known, added = self._months(), []
        for (year, month), version in versions.items():
            part, place = f"PARTITION (year={year}, month={month})", f"'{self.folder(year, month)}/{version}'"
            if f"year={year}/month={month}" in known:
                self.spark.sql(f"ALTER TABLE {self.name} {part} SET LOCATION {place}")
            else:
                added.append(f"{part} LOCATION {place}")
        if added:
            self.spark.sql(f"ALTER TABLE {self.name} ADD {' '.join(added)}")

    def replace(self, df: DataFrame, year: int, month: int, codec: str = "snappy") -> None:
        """Write, then switch; the version before stays for its readers, older ones go."""
        before = self.current(year, month)
        self._take(self.write_version(df, year, month, codec), before, year, month)

    def _take(self, version: str, before: str | None, year: int, month: int) -> None:
        self.switch({(year, month): version})
        for old in self.versions(year, month):
            if old < version and old != before:
                remove_folder(self.spark, f"{self.folder(year, month)}/{old}")

    def replace_months(self, df: DataFrame) -> None:
        """Each month that the rows have: all are written by one job, then switched."""
        version, written = _new_version(), {}
        staged = f"{self.root}/_{version}"
        replace_months(df, staged)
        for year in _numbers(self.spark, staged, "year="):
            for month in _numbers(self.spark, f"{staged}/year={year}", "month="):
                place = f"{self.folder(year, month)}/{version}"
                move(self.spark, f"{staged}/year={year}/month={month}", place)
                write_text(self.spark, f"{place}/_SUCCESS", "")
                written[year, month] = version
        self.switch(written)
        remove_folder(self.spark, staged)

    def drop(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def open_months(spark: SparkSession, name: str, root: str, schema: T.StructType) -> MonthTable:
    """The table of that name. If the catalogue lacks it, it is made, of what lies below `root`.

    A catalogue that outlives its sessions (a metastore) always knows its tables. Without one, the
    latest complete version of each month is taken: only checked rows are written as versions.
    """
    table = MonthTable(spark, name, root)
    if spark.catalog.tableExists(name):
        return table
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in ("year", "month"))
    spark.sql(f"CREATE TABLE {name} ({columns}, year INT, month INT) USING parquet "
              f"PARTITIONED BY (year, month) LOCATION '{root}'")
    found = {(y, m): table.complete(y, m) for y in _numbers(spark, root, "year=")
             for m in _numbers(spark, f"{root}/year={y}", "month=")}
    table.switch({month: done[-1] for month, done in found.items() if done})
    return table


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    found = [n.removeprefix(prefix) for n in folder_names(spark, folder) if n.startswith(prefix)]
    return sorted(int(n) for n in found if n.isdigit())


def stamped_schema(df: DataFrame) -> T.StructType:
    """The columns of the rows with their stamps, without running anything."""
    fields = [T.StructField("trip_id", T.LongType()), *df.schema.fields, T.StructField("load_dt", T.TimestampType())]
    return T.StructType(fields)


def load_month(
    df: DataFrame, table: MonthTable, year: int, month: int, *, flag: str,
    allowed: Sequence[str], foreign_keys: Sequence[ForeignKey] = (), mib_in: float = 0.0, from_files: bool = False,
    codec: str = "snappy",
) -> LoadReport:
    """Check the month, then replace it; a violation or a failure leaves the table untouched.

    The rows are staged first, so that the input is computed once and what was checked is what
    is loaded. With `from_files` the rows come from files by projections, as `numbered` needs them:
    they are checked where they lie, by the columns the checks need, before anything is written. Then
    they are written once, with their stamps beside the versions, and that folder becomes the version
    if it got as many rows as were checked. No rows leave the month empty. `mib_in` is the size of the
    files behind `df`.
    """
    spark = df.sparkSession
    started = time.monotonic()
    if from_files:
        rows = require_loadable(df, year, month, flag, allowed, foreign_keys)
    staging = table.unchecked(year, month) if from_files else shared_folder(spark, "staging")
    try:
        if from_files:
            seen = Observation("loaded")
            write_parquet(stamp(df, (year, month)).drop("year", "month"), staging, codec=codec, seen=seen)
            if seen.get["rows"] != rows:
                raise LoadRejected(f"rows_checked={rows}, rows_written={seen.get['rows']}")
            table.adopt(staging, year, month)
        else:
            write_parquet(df, staging)
            staged = spark.read.schema(df.schema).parquet(staging)
            rows = require_loadable(staged, year, month, flag, allowed, foreign_keys)
            table.replace(stamp(staged), year, month, codec)
    finally:
        remove_folder(spark, staging)
    wall = round(time.monotonic() - started, 3)
    size = folder_mib(spark, f"{table.folder(year, month)}/{table.current(year, month)}")
    return LoadReport(rows, wall, size, mib_in)


def register(spark: SparkSession, table: str, path: str) -> None:
    """Make a month-partitioned folder a catalogue table and discover its months."""
    spark.catalog.createTable(table, path=path, source="parquet")
    spark.sql(f"MSCK REPAIR TABLE {table}")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def analyze(
    spark: SparkSession, table: str, year: int | None = None, month: int | None = None,
    columns: Sequence[str] = (), bins: int = 64,
) -> None:
    """Refresh row count and size, of one month if given, and statistics of columns of the table.

    Columns get their range, nulls, distinct values and a histogram of equal heights, which
    cost-based optimisation (`spark.sql.cbo.enabled`) reads.
    """
    part = f" PARTITION (year={year}, month={month})" if year is not None else ""
    spark.sql(f"ANALYZE TABLE {table}{part} COMPUTE STATISTICS")
    if columns:
        names = ", ".join(f"`{c}`" for c in columns)
        with _setting(spark, "spark.sql.statistics.histogram.enabled", "true"), \
                _setting(spark, "spark.sql.statistics.histogram.numBins", str(bins)):
            spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {names}")


def column_statistics(spark: SparkSession, table: str, columns: Sequence[str]) -> DataFrame:
    """column, min, max, nulls, distinct_values, bins: what the catalogue knows of analysed columns."""
    def one(column: str) -> DataFrame:
        facts = spark.sql(f"DESCRIBE EXTENDED {table} `{column}`")

        def fact(name):
            return F.max(F.when(F.col("info_name") == name, F.nullif(F.col("info_value"), F.lit("NULL"))))

        return facts.agg(
            F.lit(column).alias("column"), fact("min").alias("min"), fact("max").alias("max"),
            fact("num_nulls").cast("long").alias("nulls"), fact("distinct_count").cast("long").alias("distinct_values"),
            F.count_if(F.col("info_name").startswith("bin_")).alias("bins"))

    found = [one(c) for c in columns]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def refresh_dimension(df: DataFrame, table: str, path: str | None = None) -> None:
    """Full reload of a dimension table. Facts that point at it stay."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)

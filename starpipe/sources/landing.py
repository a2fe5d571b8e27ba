"""Raw CSV landing: finding a month, reading it untyped, selecting what is new."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starpipe.sinks.files import folder_names


def read_first(paths: Sequence[str], reader: Callable[[str], DataFrame]) -> DataFrame:
    """Read the first path Spark can list; the error names every path tried."""
    for path in paths:
        try:
            return reader(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
    raise FileNotFoundError("no input found, tried:\n" + "\n".join(f" - {p}" for p in paths))


def read_csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header CSV with every column as text; several files make one relation."""
    return spark.read.option("header", True).csv(path)


def landing_globs(
    root: str, dataset: str, year: int, month: int, explicit: str | None = None
) -> list[str]:
    """Where a month may lie: an explicit pattern, key=value folders, plain folders."""
    base = f"{root.rstrip('/')}/landing/{dataset}"
    globs = [f"{base}/year={year}/month={month}/*.csv", f"{base}/{year}/{month:02d}/*.csv"]
    return [explicit, *globs] if explicit else globs


def read_landing(
    spark: SparkSession,
    root: str,
    dataset: str,
    year: int,
    month: int,
    explicit: str | None = None,
) -> DataFrame:
    paths = landing_globs(root, dataset, year, month, explicit)
    return read_first(paths, lambda path: read_csv_text(spark, path))


def in_month(ts: Column, year: int, month: int) -> Column:
    """The whole month, half-open, so its last second counts in full."""
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1)).cast("timestamp_ntz")
    end = F.add_months(F.make_date(F.lit(year), F.lit(month), F.lit(1)), 1).cast("timestamp_ntz")
    return (ts >= start) & (ts < end)


def month_slice(df: DataFrame, ts: str, year: int, month: int) -> DataFrame:
    return df.where(in_month(F.col(ts), year, month))


def select_months(
    df: DataFrame, years: Iterable[int], months: Iterable[int],
    year: str = "year", month: str = "month",
) -> DataFrame:
    """Every listed month of every listed year; prunes partitions of those two columns."""
    return df.where(F.col(year).isin(*years) & F.col(month).isin(*months))


def in_listed_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of the months that another table lists (`year`, `month`; twelve rows a year).

    Over a table partitioned by month the list prunes partitions when the query runs, whatever
    it is derived from: it is read first, and only the folders of its months are opened.
    """
    listed = F.broadcast(months.select(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")))
    return df.join(listed, ["year", "month"], "left_semi").select(*df.columns)


def landed_months(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """Months that a folder partitioned by year and month has, from its listing alone.

    A month counts once its folder has a file; nothing of the files is read.
    """
    def numbers(folder, prefix):
        names = [n.removeprefix(prefix) for n in folder_names(spark, folder) if n.startswith(prefix)]
        return sorted(int(n) for n in names if n.isdigit())

    return [(y, m) for y in numbers(root, "year=") for m in numbers(f"{root}/year={y}", "month=")
            if any(not n.startswith(("_", ".")) for n in folder_names(spark, f"{root}/year={y}/month={m}"))]


def not_landed(incoming: DataFrame, landed: Iterable[tuple[int, int]], force: bool = False) -> DataFrame:
    """Rows of months that the ledger does not have, or all of them when forced.

    `landed` are months as `landed_months` gives them. They are known when the query is planned,
    so landed partitions of `incoming` are not opened either. Rows without a month are new.
    """
    known = sorted({y * 100 + m for y, m in landed})
    if force or not known:
        return incoming
    return incoming.where(F.coalesce(~(F.col("year") * 100 + F.col("month")).isin(*known), F.lit(True)))


def new_months(incoming: DataFrame, landed: DataFrame, force: bool = False) -> DataFrame:
    """Rows of months that another table does not have, or all of them when forced.

    Both sides carry `year` and `month`. The landed side shrinks to its distinct months, twelve a
    year, which are broadcast: shuffling by so few keys would put a large month into one task. For
    a table partitioned by month `not_landed` knows them without reading it.
    """
    if force:
        return incoming
    seen = F.broadcast(landed.select("year", "month").distinct())
    return incoming.join(seen, ["year", "month"], "left_anti")

"""Step metrics, event logs, and what a set of files amounts to."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpipe.functions.measures import MIB
from starpipe.sinks.files import folder_names
from starpipe.sources.landing import read_first

# The part of the public event-log format the statistics need.
EVENT_SCHEMA = """
    `Event` string,
    `Stage ID` int,
    `Stage IDs` array<int>,
    `Properties` map<string, string>,
    `Stage Info` struct<`Stage ID`: int>,
    `Task Info` struct<`Task ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint, `Failed`: boolean>,
    `Task Metrics` struct<
        `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>,
        `Executor Run Time`: bigint, `JVM GC Time`: bigint,
        `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint,
        `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint,
                                       `Total Bytes Read`: bigint>,
        `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint, `Bytes Written`: bigint>>
"""


def read_event_log(spark: SparkSession, log_dir: str, app_id: str) -> DataFrame:
    """Event lines of exactly one application, single file or rolling folder; none if missing.

    The exact name is taken, else the rolling folder of that name, else the one entry of the
    folder that has the name as a whole, such as an attempt of it. A line that is not JSON
    becomes a row of nulls and is dropped.
    """
    names = folder_names(spark, log_dir)
    whole = re.compile(rf"(^|_){re.escape(app_id)}($|[_.])")
    found = [n for n in (app_id, f"eventlog_v2_{app_id}") if n in names][:1] or [n for n in names if whole.search(n)]
    if not found:
        return spark.createDataFrame([], EVENT_SCHEMA)
    if len(found) > 1:
        raise ValueError(f"several logs of {app_id}: {found}")
    path = f"{log_dir.rstrip('/')}/{found[0]}"
    rolling = [n for n in folder_names(spark, path) if n.startswith("events_")]
    events = spark.read.schema(EVENT_SCHEMA).json([f"{path}/{n}" for n in rolling] or path)
    return events.where(F.col("Event").isNotNull())


def event_log_stats(events: DataFrame) -> DataFrame:
    """Shuffle, spill, time, task and stage totals of a log, as one row."""
    task = F.col("Event") == "SparkListenerTaskEnd"
    m = "`Task Metrics`"
    read, write = f"{m}.`Shuffle Read Metrics`", f"{m}.`Shuffle Write Metrics`"
    read_total = F.nullif(F.col(f"{read}.`Total Bytes Read`"), F.lit(0))
    read_parts = (F.coalesce(F.col(f"{read}.`Remote Bytes Read`"), F.lit(0))
                  + F.coalesce(F.col(f"{read}.`Local Bytes Read`"), F.lit(0)))
    written = F.coalesce(F.col(f"{write}.`Shuffle Bytes Written`"),
                         F.col(f"{write}.`Bytes Written`"))

    def total(column):
        return F.coalesce(F.sum(F.when(task, column)), F.lit(0))

    def mib(column):
        return F.round(total(column) / MIB, 3)

    run = F.col(f"{m}.`Executor Run Time`")
    positive = F.when(task & (run > 0), run)
    stage = F.when(F.col("Event") == "SparkListenerStageCompleted",
                   F.col("`Stage Info`.`Stage ID`"))
    return events.agg(
        mib(F.coalesce(read_total, read_parts)).alias("shuffle_read_mb"),
        mib(written).alias("shuffle_write_mb"),
        F.count_if(task).alias("tasks_total"),
        F.count_distinct(stage).alias("stages"),
        mib(F.col(f"{m}.`Disk Bytes Spilled`")).alias("disk_spill_mb"),
        mib(F.col(f"{m}.`Memory Bytes Spilled`")).alias("memory_spill_mb"),
        total(F.col(f"{m}.`JVM GC Time`")).alias("gc_time_ms"),
        total(run).alias("executor_run_time_ms"),
        F.round(F.max(positive) / F.avg(positive), 6).alias("skew_factor"),
    )


def part_times(events: DataFrame, group: str) -> DataFrame:
    """stage, task, seconds, rows, mib of the tasks that read the input of a group of jobs.

    That is the first of its stages whose tasks read rows: later ones read what it staged. Failed
    attempts do not count.
    """
    named = events.where((F.col("Event") == "SparkListenerJobStart") & (F.col("Properties")["spark.jobGroup.id"] == group))
    stages = named.select(F.explode("`Stage IDs`").alias("stage")).distinct()
    info, metrics = "`Task Info`", "`Task Metrics`.`Input Metrics`"
    tasks = events.where((F.col("Event") == "SparkListenerTaskEnd") & ~F.coalesce(F.col(f"{info}.`Failed`"), F.lit(False))).select(
        F.col("`Stage ID`").alias("stage"), F.col(f"{info}.`Task ID`").alias("task"),
        ((F.col(f"{info}.`Finish Time`") - F.col(f"{info}.`Launch Time`")) / 1000.0).alias("seconds"),
        F.col(f"{metrics}.`Records Read`").alias("rows"), (F.col(f"{metrics}.`Bytes Read`") / MIB).alias("mib"))
    read = tasks.where("rows > 0").join(F.broadcast(stages), "stage", "left_semi")
    first = read.agg(F.min("stage")).scalar()
    return read.where(F.col("stage") == first)


def part_totals(parts: DataFrame) -> DataFrame:
    """Number of parts, the sum of their seconds and the longest, as one row."""
    return parts.agg(
        F.count(F.lit(1)).alias("parts"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("copy_sec_sum"),
        F.round(F.max("seconds"), 3).alias("copy_sec_max"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_read"))


def read_metrics(
    spark: SparkSession, paths: Sequence[str], schema: str | None = None, lines: bool = False,
) -> DataFrame:
    """Metrics JSON of a step: the first of the paths that exists. One record a file, or one a line."""
    reader = spark.read.schema(schema) if schema else spark.read
    return read_first(paths, reader.option("multiLine", not lines).json)


def read_metric_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The same files as JSON text, one record per file, for the bench table."""
    def read(path):
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "record")

    return read_first(paths, read)


def file_stats(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Files and bytes below a folder, one row read per file and nothing of its content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").where(F.col("path").endswith(suffix)).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.round(F.coalesce(F.sum("length"), F.lit(0)) / MIB, 3).alias("mib"),
    )


def partition_count(df: DataFrame) -> int:
    """How many input partitions a plan reads, as planned, without reading them."""
    return df.rdd.getNumPartitions()

"""Session construction, run settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

from starpipe.spec import RunSettings

EXCHANGES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app_name: str = "starpipe",
    master: str | None = None,
    settings: RunSettings | None = None,
    event_log_dir: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session in UTC. With `event_log_dir` it writes an uncompressed event log there.

    Recording the call site of every column expression is off: plans of many columns are
    built from library code here, and it takes longer than the plans themselves.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if event_log_dir:
        builder = (
            builder.config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", event_log_dir)
            .config("spark.eventLog.compress", "false")
        )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if settings:
        apply_settings(spark, settings)
    return spark


def apply_settings(spark: SparkSession, settings: RunSettings) -> None:
    """Set the run's knobs on a live session; all of them are runtime settings."""
    for key, value in _values(settings).items():
        spark.conf.set(key, value)


def _values(settings: RunSettings) -> dict[str, str]:
    return {
        "spark.sql.adaptive.enabled": str(settings.aqe).lower(),
        "spark.sql.parquet.compression.codec": settings.codec,
        "spark.sql.shuffle.partitions": str(settings.shuffle_partitions),
        "spark.sql.files.maxPartitionBytes": str(settings.max_partition_bytes),
        # What a step exchanged goes when its write ends, not when the driver collects garbage.
        EXCHANGES_GO: "true",
    }


@contextmanager
def applied(spark: SparkSession, settings: RunSettings) -> Iterator[None]:
    """The run's knobs inside the block; afterwards the session's own again."""
    with _set(spark, _values(settings)):
        yield


@contextmanager
def freed_exchanges(spark: SparkSession) -> Iterator[None]:
    """Inside the block, what a query exchanged goes when it ends."""
    with _set(spark, {EXCHANGES_GO: "true"}):
        yield


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="starpipe-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, for staged tables and round trips.

    It lies under the cluster's `spark.checkpoint.dir`. Only a local session without that
    setting gets a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

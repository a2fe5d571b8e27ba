"""Dictionary CSVs with fixed schemas, the zone dictionary and the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starpipe.functions.keys import date_key
from starpipe.sources.landing import read_csv_text
from starpipe.trips import DICTIONARY_SCHEMAS, ZONE_HEADER


def read_dictionary(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name == "zones":
        return name_zones(read_csv_text(spark, path))
    if name not in DICTIONARY_SCHEMAS:
        raise ValueError(f"unknown dictionary: {name}")
    return spark.read.option("header", True).schema(DICTIONARY_SCHEMAS[name]).csv(path)


def name_zones(raw: DataFrame) -> DataFrame:
    """Published zone header to canonical names; a byte-order mark on it is tolerated."""
    found = {c.lstrip("﻿").lower(): c for c in raw.columns}
    names = {target: found.get(source.lower(), found.get(target))
             for source, target in ZONE_HEADER.items()}
    return raw.select(
        F.col(f"`{names['zone_id']}`").try_cast("int").alias("zone_id"),
        *[F.col(f"`{names[c]}`").alias(c) for c in ("borough", "zone_name", "service_zone")],
    )


def calendar_columns(day: Column) -> dict[str, Column]:
    iso_dow = F.weekday(day) + 1
    return {
        "date_id": date_key(day),
        "date": day,
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "iso_week": F.weekofyear(day),
        "iso_dow": iso_dow,
        "is_weekend": iso_dow >= 6,
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": day == F.last_day(day),
    }


def calendar(span: DataFrame) -> DataFrame:
    """One row per day for each (first_day, last_day) row of `span`, both included."""
    days = span.select(F.explode(F.sequence("first_day", "last_day")).alias("d"))
    return days.select(*[c.alias(n) for n, c in calendar_columns(F.col("d")).items()])


def calendar_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    return calendar(spark.sql(
        "SELECT CAST(:a AS DATE) AS first_day, CAST(:b AS DATE) AS last_day",
        args={"a": first, "b": last},
    ))


def calendar_covering(df: DataFrame, ts: str) -> DataFrame:
    """The calendar of the days between the first and the last timestamp of a table."""
    return calendar(df.agg(
        F.to_date(F.min(ts)).alias("first_day"), F.to_date(F.max(ts)).alias("last_day")
    ))

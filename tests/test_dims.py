"""Dimension normalisation, the calendar and the dictionaries."""

from __future__ import annotations

import datetime as dt

import pytest

from starpipe import trips
from starpipe.operators import dims
from starpipe.sources import dictionaries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_zone_names_from_the_published_header(spark):
    df = spark.createDataFrame([("1", "EWR", "Newark", "EWR"), ("2", "N/A", "N/A", "x")],
                               ["LocationID", "Borough", "Zone", "service_zone"])
    out = dims.normalize_dim(df, trips.ZONES)
    assert out.columns == ["zone_id", "zone_name", "borough"]
    assert rows(out) == [(1, "Newark", "EWR"), (2, "N/A", "N/A")]


def test_repeated_keys_give_one_stable_row(spark):
    data = [(1, None), (1, "b"), (1, "a"), (2, None), (None, "x")]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "payment_type_id int, description string").repartition(4)
        assert rows(dims.normalize_dim(df, trips.PAYMENTS)) == [(1, "a"), (2, None), (None, "x")]


def test_missing_description_and_text_keys(spark):
    df = spark.createDataFrame([("1.0",), ("oops",)], "RatecodeID string")
    assert rows(dims.normalize_dim(df, trips.RATECODES)) == [(1, None), (None, None)]
    flags = spark.createDataFrame([(" y ", "yes")], "flag string, desc string")
    assert rows(dims.normalize_dim(flags, trips.STORE_FLAGS)) == [("Y", "yes")]
    with pytest.raises(ValueError, match="vendor"):
        dims.normalize_dim(spark.range(1), trips.VENDORS)


SUNDAY = (20210103, dt.date(2021, 1, 3), 53, 7, True)


@pytest.mark.parametrize("columns, row", [
    ("date string", ("2021-01-03",)),
    ("full_date string", ("2021-01-03 05:06:07",)),
    ("year int, month int, day int", (2021, 1, 3)),
    ("DateId int, date date", (20210103, dt.date(2021, 1, 3))),
    ("date_key string, year string, month string, day string", ("20210103", "2021", "1", "3")),
])
def test_date_dimension_from_each_kind_of_source(spark, columns, row):
    out = dims.normalize_dim_date(spark.createDataFrame([row], columns))
    got = out.select("date_id", "date", "iso_week", "iso_dow", "is_weekend").first()
    assert tuple(got) == SUNDAY


def test_date_dimension_without_a_date(spark):
    df = spark.createDataFrame([(20210103, 7, 53)], "date_id int, day_of_week int, week_of_year int")
    out = dims.normalize_dim_date(df)
    assert out.columns == ["date_id", "iso_week", "iso_dow", "is_weekend", "is_month_start",
                           "is_month_end"]
    assert tuple(out.first()) == (20210103, 53, 7, True, None, None)
    with pytest.raises(ValueError):
        dims.normalize_dim_date(spark.range(1))


def test_calendar(spark):
    days = {r["date_id"]: r for r in dictionaries.calendar_between(
        spark, trips.CALENDAR_START, trips.CALENDAR_END).collect()}
    assert len(days) == 731
    leap = days[20200229]
    assert (leap["quarter"], leap["is_month_end"], leap["is_month_start"]) == (1, True, False)
    new_year = days[20210101]
    assert (new_year["iso_week"], new_year["iso_dow"], new_year["is_month_start"]) == (53, 5, True)
    assert days[20211231]["quarter"] == 4


def test_dictionaries(spark, tmp_path):
    flag = tmp_path / "store_flag.csv"
    flag.write_text("store_flag,description\nY,stored\nN,not stored")
    assert rows(dictionaries.read_dictionary(spark, "store_flag", str(flag))) == [
        ("N", "not stored"), ("Y", "stored")]
    zones = tmp_path / "zones.csv"
    zones.write_text('﻿"LocationID","Borough","Zone","service_zone"\n264,"Unknown","N/A","N/A"\n',
                     encoding="utf-8")
    assert rows(dictionaries.read_dictionary(spark, "zones", str(zones))) == [
        (264, "Unknown", "N/A", "N/A")]
    with pytest.raises(ValueError, match="unknown dictionary"):
        dictionaries.read_dictionary(spark, "nothing", str(flag))

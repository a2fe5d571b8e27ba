"""Names, casts, defaults, flags, keys and hashes on hand-made rows."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from starpipe import trips
from starpipe.functions.casts import tolerant_cast
from starpipe.functions.keys import row_hash
from starpipe.operators import canonical

SPEC = trips.TRIPS
TS = dt.datetime(2021, 1, 31, 23, 59, 59)


def one(df, *columns):
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize("names", [
    ("vendor_id", "pickup_ts", "pu_zone_id"),
    ("VendorID", "tpep_pickup_datetime", "PULocationID"),
    ("vendorid", "pickup_datetime", "pulocationid"),
    ("VENDORID", "pickup_at", "pickup_location_id"),
])
def test_every_naming_is_found(spark, names):
    df = spark.createDataFrame([("2", "2021-01-31 23:59:59", "7")], list(names))
    out = canonical.canonicalize(df, SPEC)
    assert out.columns == [c.name for c in SPEC.columns]
    assert one(out, "vendor_id", "pickup_ts", "pu_zone_id", "extra") == (2, TS, 7, None)
    assert dict(out.dtypes)["extra"] == "double"


def test_case_of_a_source_name_does_not_lose_it(spark):
    df = spark.createDataFrame([("3",)], ["Payment_Type"])
    assert one(canonical.canonicalize(df, SPEC), "payment_type") == (3,)


def test_first_of_several_names_wins(spark):
    df = spark.createDataFrame([("old", "new")], ["store_and_fwd", "store_and_fwd_flag"])
    assert one(canonical.canonicalize(df, SPEC), "store_and_fwd_flag") == ("new",)


def test_names_differing_in_case_only_are_an_error(spark):
    df = spark.range(1).selectExpr("1 AS VendorID", "2 AS vendorid")
    with pytest.raises(ValueError, match="case"):
        canonical.canonicalize(df, SPEC)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_casts_give_null_for_bad_values(spark, ansi):
    texts = ["1", "1.0", "1.9", " 2 ", "-3", "", "x", "3000000000", "1.x", "1e3", None]
    numbers = spark.createDataFrame([(t,) for t in texts], "t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        def cast(df, target):
            column = tolerant_cast(F.col("t"), df.schema["t"].dataType, target)
            return [r[0] for r in df.select(column).collect()]

        assert cast(numbers, "int") == [1, 1, 1, 2, -3, None, None, None, None, None, None]
        assert cast(numbers, "double") == [1.0, 1.0, 1.9, 2.0, -3.0, None, None, 3e9, None, 1000.0,
                                           None]
        times = spark.createDataFrame([(t,) for t in (
            "2021-01-31 23:59:59", "2021-01-31T23:59:59.250", "2021-01-31", "2021-02-30", "bad", "")],
            "t string")
        assert cast(times, "timestamp") == [
            TS, TS.replace(microsecond=250000), dt.datetime(2021, 1, 31), None, None, None]
        assert cast(spark.createDataFrame([(1.9,), (3e9,)], "t double"), "int") == [1, None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_defaults_and_flags(spark):
    flags = ["y", "N", " y ", "", None, "Z"]
    df = spark.createDataFrame([(f,) for f in flags], "store_and_fwd string")
    out = canonical.fill_defaults(canonical.canonicalize(df, SPEC), SPEC)
    assert [r[0] for r in out.select("store_and_fwd_flag").collect()] == ["Y", "N", "U", "U", "U", "U"]
    assert one(out, "vendor_id", "ratecode_id", "payment_type", "passenger_count") == (99, 99, 5, 0)


def test_quality_flags_and_rules_treat_null_and_fractions_apart(spark):
    df = spark.createDataFrame([
        ("2021-01-01 00:00:00", "2021-01-01 00:00:00", None, 0.0),
        ("2021-01-01 00:00:00.200", "2021-01-01 00:00:00.700", 0.0, -0.01),
        ("2021-01-01 00:00:01", "2021-01-01 00:00:00", 1.0, None),
        ("2021-01-01 00:00:01", None, -1.0, 5.0),
        ("1969-12-31 23:59:59.500", "1970-01-01 00:00:00.400", 2.0, 5.0),
    ], "pickup_ts string, dropoff_ts string, trip_distance double, total_amount double")
    rows = canonical.canonicalize(df, SPEC)
    flags = canonical.add_quality_flags(rows, SPEC)
    assert [tuple(r) for r in flags.select(
        "is_zero_distance", "is_zero_duration", "is_negative_total").collect()] == [
        (True, True, False), (True, True, True), (False, True, False),
        (True, None, False), (False, False, False)]
    rules = trips.silver_rules()
    assert [tuple(r) for r in rows.select(
        rules["zero_distance_pct"], rules["zero_duration_pct"], rules["drop_lt_pickup_pct"]
    ).collect()] == [(None, True, False), (True, False, False), (False, True, True),
                     (True, None, None), (False, False, False)]


def test_date_keys_keep_a_given_month(spark):
    df = spark.createDataFrame([
        ("2020-02-29 10:00:00", "2020-03-01 00:00:00", None, None),
        ("2020-12-31 23:59:59", None, "2021", "1"),
        (None, None, None, None),
    ], "pickup_ts string, dropoff_ts string, year string, month string")
    out = canonical.add_date_keys(canonical.canonicalize(df, SPEC), SPEC)
    assert [tuple(r) for r in out.select("pickup_date_id", "dropoff_date_id", "year", "month")
            .collect()] == [(20200229, 20200301, 2020, 2), (20201231, None, 2021, 1),
                            (None, None, None, None)]


def test_row_hash_forms(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    columns = [F.col(c) for c in df.columns]
    skipping = [r[0] for r in df.select(row_hash(columns)).collect()]
    assert skipping[0] == skipping[1] == hashlib.sha256(b"a|b").hexdigest()
    marked = [r[0] for r in df.select(row_hash(columns, "~")).collect()]
    assert marked == [hashlib.sha256(t).hexdigest() for t in (b"a|~|b", b"a|b|~")]


def test_given_hash_is_kept_in_silver_and_replaced_in_export(spark):
    df = spark.createDataFrame([("2021-01-05 01:02:03", "given")], ["pickup_at", "hash"])
    silver = canonical.to_silver_rows(df, SPEC)
    assert silver.columns == list(trips.SILVER_COLUMNS)
    assert one(silver, "row_hash") == ("given",)
    export = canonical.to_export_rows(silver, SPEC, "exp")
    assert export.columns == list(trips.EXPORT_COLUMNS)
    text = "99|2021-01-05T01:02:03.000|0|99|U|5|2021|1"
    assert one(export, "pickup_ts", "load_src", "row_hash") == (
        "2021-01-05T01:02:03.000", "exp", hashlib.sha256(text.encode()).hexdigest())


def test_large_doubles_hash_as_spark_writes_them(spark):
    df = spark.createDataFrame([(12345678.5,)], "x double")
    assert df.select(row_hash([F.col("x")])).first()[0] == hashlib.sha256(b"1.23456785E7").hexdigest()


def test_silver_needs_no_shuffle(spark, sf_dir):
    from starpipe.catalog import frames

    plan = frames.silver(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_whole_numbers_are_matched_without_going_back(spark):
    """F11, F12, F16: one match decides whether a text is a whole number, in time linear in its length."""
    from starpipe.functions import casts

    texts = [" ", "+", ".", "1", " -2 ", "1.", "1.9", "-.5", "+ 1", "1 1", "\t7\n", "99999999999", "1e3", "1..2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(casts.text_to_int(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [None, None, None, 1, -2, 1, 1, 0, None, None, 7, None, None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("substring_index") == 1

"""Dimension normalisation: canonical names, typed key, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.functions.casts import flag_text, tolerant_cast
from starpipe.functions.keys import date_key
from starpipe.operators.canonical import find_column
from starpipe.sources.dictionaries import calendar_columns
from starpipe.spec import DimSpec


def conform_dim(df: DataFrame, spec: DimSpec) -> DataFrame:
    """Canonical key and attributes; an attribute without a source is a null text."""
    key = find_column(df, spec.key_sources)
    if key is None:
        raise ValueError(f"{spec.name}: none of {spec.key_sources} in {df.columns}")
    value = F.col(f"`{key}`")
    typed = (flag_text(value) if spec.key_type == "flag"
             else tolerant_cast(value, df.schema[key].dataType, spec.key_type))

    def attribute(name, sources):
        found = find_column(df, sources)
        return (F.col(f"`{found}`") if found else F.lit(None)).cast("string").alias(name)

    return df.select(typed.alias(spec.key), *[attribute(*a) for a in spec.attributes.items()])


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest row of each key, values before nulls: the same one on every run."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = F.struct(*[p for c in rest for p in (F.col(c).isNull(), F.col(c))])
    best = F.min_by(F.struct(*rest), order)
    picked = df.groupBy(*keys).agg(best.alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def normalize_dim(df: DataFrame, spec: DimSpec) -> DataFrame:
    return one_row_per_key(conform_dim(df, spec), [spec.key])


# The columns of the date dimension and the other names they arrive under.
DATE_COLUMNS = (
    "date_id", "date", "year", "quarter", "month", "day",
    "iso_week", "iso_dow", "is_weekend", "is_month_start", "is_month_end",
)
DATE_ID_NAMES = ("date_id", "DateId", "date_key")
ISO_DOW_NAMES = ("iso_dow", "day_of_week")
ISO_WEEK_NAMES = ("iso_week", "week_of_year")


def conform_dim_date(df: DataFrame) -> DataFrame:
    """Date dimension from a date, a full date or year-month-day; the rest is derived.

    Weekday and week follow from the date if there is one, and are taken as given otherwise; every
    other column that is given stays as given. Year, quarter, month and day appear only if the
    source has them.
    """
    def given(names):
        found = find_column(df, names)
        return F.col(f"`{found}`") if found else None

    parts = [given([p]) for p in ("year", "month", "day")]
    has_parts = all(p is not None for p in parts)
    day = given(["date"])
    if day is not None:
        day = day.try_cast("date")
    elif (full := given(["full_date"])) is not None:
        day = full.try_cast("timestamp").try_cast("date")
    elif has_parts:
        day = F.make_date(*[p.try_cast("int") for p in parts])

    date_id = given(DATE_ID_NAMES)
    if date_id is None:
        if day is None:
            raise ValueError(f"no date and no date id in {df.columns}")
        date_id = date_key(day)
    derived = calendar_columns(day) if day is not None else {}

    def dated(names):
        """The ISO column itself, else from the date, else under its other name."""
        own, other = given(names[:1]), given(names[1:])
        for value in (own, derived.get(names[0]), other):
            if value is not None:
                return value.try_cast("int")
        return None

    iso_dow, iso_week = dated(ISO_DOW_NAMES), dated(ISO_WEEK_NAMES)
    weekend = iso_dow >= 6 if iso_dow is not None else None
    start = parts[2].try_cast("int") == 1 if parts[2] is not None else None
    fallback = {"is_weekend": weekend, "is_month_start": start,
                "is_month_end": derived.get("is_month_end")}
    columns = {"date_id": date_id.try_cast("int"), "date": day,
               **{name: given([name]) for name in ("year", "quarter", "month", "day")},
               "iso_week": iso_week, "iso_dow": iso_dow}
    for name, value in fallback.items():
        own = given([name])
        value = own if own is not None else value
        columns[name] = value if value is not None else F.lit(None).cast("boolean")
    return df.select(*[columns[n].alias(n) for n in DATE_COLUMNS if columns[n] is not None])


def normalize_dim_date(df: DataFrame) -> DataFrame:
    return one_row_per_key(conform_dim_date(df), ["date_id"])

"""From whatever columns a source has to the canonical fact."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpipe.functions.casts import tolerant_cast
from starpipe.functions.flags import below_zero, no_duration, normal_flag, zero_or_less
from starpipe.functions.keys import date_key, iso_text, row_hash
from starpipe.spec import FactSpec


def find_column(df: DataFrame, names: Iterable[str]) -> str | None:
    """First of the names that the frame has, whatever its case.

    Two columns that differ only in case cannot be told apart in Spark and are an error.
    """
    by_name = defaultdict(list)
    for column in df.columns:
        by_name[column.lower()].append(column)
    for name in names:
        hits = by_name.get(name.lower(), [])
        if len(hits) > 1:
            raise ValueError(f"columns {hits} differ only in case")
        if hits:
            return hits[0]
    return None


def canonicalize(df: DataFrame, spec: FactSpec) -> DataFrame:
    """Every canonical column in one projection: renamed, cast, or a typed null."""
    def pick(column) -> SparkColumn:
        source = find_column(df, column.names())
        if source is None:
            return F.lit(None).cast(column.type).alias(column.name)
        value = F.col(f"`{source}`")
        return tolerant_cast(value, df.schema[source].dataType, column.type).alias(column.name)

    return df.select(*[pick(c) for c in spec.columns])


def replace_columns(df: DataFrame, new: dict[str, SparkColumn]) -> DataFrame:
    """Replace or add columns in a single projection."""
    kept = [new.pop(c).alias(c) if c in new else F.col(c) for c in df.columns]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def fill_defaults(df: DataFrame, spec: FactSpec) -> DataFrame:
    """Domain defaults for nulls, and the flag reduced to its known values."""
    filled = {c.name: F.coalesce(F.col(c.name), F.lit(c.default))
              for c in spec.columns if c.default is not None}
    filled[spec.flag] = normal_flag(F.col(spec.flag), spec.flag_values, spec.flag_unknown)
    return replace_columns(df, filled)


def add_date_keys(df: DataFrame, spec: FactSpec, keep_given: bool = False) -> DataFrame:
    """Date ids of both timestamps; year and month unless the source brought them."""
    start, end = F.col(spec.start_ts), F.col(spec.end_ts)
    keys = {spec.start_date_id: date_key(start), spec.end_date_id: date_key(end)}
    if keep_given:
        keys = {name: F.coalesce(F.col(name), key) for name, key in keys.items()}
    return replace_columns(df, {
        **keys,
        "year": F.coalesce(F.col("year"), F.year(start)),
        "month": F.coalesce(F.col("month"), F.month(start)),
    })


def add_quality_flags(df: DataFrame, spec: FactSpec) -> DataFrame:
    return replace_columns(df, {
        "is_zero_distance": zero_or_less(F.col(spec.distance)),
        "is_zero_duration": no_duration(F.col(spec.start_ts), F.col(spec.end_ts)),
        "is_negative_total": below_zero(F.col(spec.total)),
        "is_passenger_missing": zero_or_less(F.col(spec.passengers)),
    })


def add_row_hash(
    df: DataFrame, spec: FactSpec, keep_given: bool = True, null_marker: str | None = None
) -> DataFrame:
    computed = row_hash([F.col(c) for c in spec.hash_inputs], null_marker)
    if keep_given:
        computed = F.coalesce(F.col(spec.hash_column), computed)
    return replace_columns(df, {spec.hash_column: computed})


def to_silver_rows(
    raw: DataFrame, spec: FactSpec, null_marker: str | None = None
) -> DataFrame:
    """The whole row-level clean-up, without a shuffle."""
    typed = fill_defaults(canonicalize(raw, spec), spec)
    flagged = add_quality_flags(add_date_keys(typed, spec), spec)
    return add_row_hash(flagged, spec, null_marker=null_marker).select(*spec.output)


def to_export_rows(
    df: DataFrame, spec: FactSpec, load_source: str, null_marker: str | None = None
) -> DataFrame:
    """Canonical export: ISO timestamps, backfilled keys, hash over the exported text."""
    keyed = add_date_keys(canonicalize(df, spec), spec, keep_given=True)
    texts = replace_columns(keyed, {
        spec.start_ts: iso_text(F.col(spec.start_ts)),
        spec.end_ts: iso_text(F.col(spec.end_ts)),
        "load_src": F.lit(load_source),
    })
    return add_row_hash(texts, spec, keep_given=False, null_marker=null_marker).select(
        *spec.export
    )


def order_within_tasks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sort each written file by itself; no global sort."""
    return df.sortWithinPartitions(*columns)

"""Numeric expressions of the reports: shares, changes, rates, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024


def share_pct(predicate: Column) -> Column:
    """Percentage of rows where the predicate holds; null counts as false, no rows as 0."""
    hit = F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.round(F.coalesce(F.avg(hit) * 100.0, F.lit(0.0)), 6)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero or null denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def change_pct(value: Column, base: Column) -> Column:
    return ratio((value - base).cast("double") * 100.0, base)


def rounded(column: Column, digits: int) -> Column:
    """Half away from zero, as a double. Rounds the exact decimal, not its binary image."""
    return F.round(column.cast("decimal(38,12)"), digits).cast("double")


def step_position(step: Column, order: tuple[str, ...]) -> Column:
    """1-based place of the step in a fixed list; null, hence last, for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in order]), step), F.lit(0))

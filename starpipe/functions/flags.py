"""Row-level quality flags.

These are the silver forms. The rule forms used for percentages differ on purpose: a rule
does not count a null distance as zero, and compares exact timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_or_less(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)) <= 0


def below_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)) < 0


def no_duration(start: Column, end: Column) -> Column:
    """Whole-second difference not above zero; null when either side is null."""
    def seconds(ts: Column) -> Column:
        return F.unix_seconds(ts.cast("timestamp"))

    return seconds(end) - seconds(start) <= 0


def normal_flag(column: Column, known: Sequence[str], unknown: str) -> Column:
    upper = F.upper(column)
    return F.when(upper.isin(*known), upper).otherwise(F.lit(unknown))

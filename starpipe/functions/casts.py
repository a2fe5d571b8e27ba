"""Casts that turn bad values into null, independent of the session's ANSI setting.

A failing `try_cast` costs an exception, thousands of times a good one. Text is therefore
matched against the shape its target needs first, and only text that fits is cast; what fits
and still fails (an overflow, a 30th of February) is left to `try_cast`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number with an optional fraction, which is cut off: "1", " -2 ", "1.0", "1.9". No part of a pattern can give back
# what it took, so that nothing is tried twice.
_WHOLE = r"^\s*+[+-]?+\d++(?:\.\d*+)?+\s*+$"
# Nothing but a fraction: "-.5".
_FRACTION = r"^\s*+[+-]?+\.\d++\s*+$"
# The starts of the other texts Spark's own casts accept.
_STARTS = {
    "double": r"(?i)^\s*[+-]?(\.?\d|nan|inf)",
    "timestamp": r"^\s*([+-]?\d|T)",
    "timestamp_ntz": r"^\s*([+-]?\d|T)",
    "date": r"^\s*[+-]?\d",
}


def text_to_int(text: Column) -> Column:
    whole = F.substring_index(text, ".", 1)
    return F.when(text.rlike(_WHOLE), whole.try_cast("int")).when(text.rlike(_FRACTION), 0)


def tolerant_cast(column: Column, source: T.DataType, target: str) -> Column:
    if source.simpleString() == target:
        return column
    if isinstance(source, T.StringType):
        if target == "int":
            return text_to_int(column)
        if target in _STARTS:
            return F.when(column.rlike(_STARTS[target]), column.try_cast(target))
    return column.try_cast(target)


def flag_text(column: Column) -> Column:
    """Join form of a flag: trimmed upper-case text."""
    return F.upper(F.trim(column.cast("string")))

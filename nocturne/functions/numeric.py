"""Number parsing, rounding and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def to_number(col: Column) -> Column:
    """Text to DOUBLE; anything that is not a plain number becomes NULL.

    The pattern comes first because a bare cast also reads ``1d``, ``inf`` and
    ``nan``.
    """
    return F.regexp_extract(col.cast("string"), NUMBER, 1).try_cast("double")


def percent_number(col: Column) -> Column:
    """Text such as ``91.0%`` to DOUBLE."""
    return to_number(F.replace(col.cast("string"), F.lit("%"), F.lit("")))


def leading_number(col: Column) -> Column:
    """The number a text starts with, as a browser's ``parseFloat`` reads it."""
    return F.regexp_extract(col.cast("string"), LEADING_NUMBER, 1).try_cast("double")


def no_nan(col: Column) -> Column:
    """NaN to NULL: Spark ranks NaN above every number, the data means missing."""
    return F.when(~F.isnan(col), col)


def clamp(col: Column, low: float, high: float) -> Column:
    """NULL stays NULL: least and greatest alone would skip it."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def half_up(col: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(col + 0.5)


def holds(condition: Column) -> Column:
    """A comparison with a missing side is false, not unknown."""
    return F.coalesce(condition, F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, zero where the bottom is zero."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

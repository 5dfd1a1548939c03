from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    column = as_column(c)
    return F.when(~F.isnan(column), column)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(as_column(a), as_column(b))


def rounded(c: str | Column, places: int, exactly: Column) -> Column:
    """``exactly``, a rounding of a double to so many places by way of decimals, without decimals where both agree.

    Off the middle between two results the nearest multiple is the same either way, and dividing its whole number by a
    power of ten gives the double nearest to it, as decimals do. Around the middle, and for values of 17 digits, infinities and NaN,
    ``exactly`` is taken. The margin of a hundredth of a unit covers roundings to two more places that come first.
    """
    scaled = as_column(c) * 10.0**places
    off_middle = F.abs(scaled - F.floor(scaled) - 0.5) > 0.01
    return F.when((F.abs(scaled) < 1e13) & off_middle, F.floor(scaled + 0.5).cast("double") / 10.0**places).otherwise(exactly)

"""Null handling that keeps null and NaN apart, unlike DataFrame.na.

Null means absent; NaN is a value, and the largest one. ``drop_nulls`` and ``fill_null`` leave NaN alone.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without a null in any of the columns; NaN stays. No columns: all rows."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True)))


def fill_null(c: Column | str, value: Column | float) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, value if isinstance(value, Column) else F.lit(value))


def nan_to_null(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x), x)


def finite(c: Column | str) -> Column:
    """NaN becomes 0, infinities the largest and smallest number; null stays."""
    x = F.col(c) if isinstance(c, str) else c
    big = 1.7976931348623157e308
    return F.when(F.isnan(x), F.lit(0.0)).when(x > big, F.lit(big)).when(x < -big, F.lit(-big)).otherwise(x)


def clip(c: Column | str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """c within bounds; null stays null (least and greatest would skip it), a null bound doesn't bind."""
    x = F.col(c) if isinstance(c, str) else c
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)

"""Exact order statistics per group, without gathering a group."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ranges import running, same_keys
from millrace.plans.shared import written

BRACKET = 0.01  # share of a group's rows left on each side of a rank after the first pass
ACCURACY = 1_000  # of the sketch: its rank error is at most one in ACCURACY, well within the bracket


def _at_places(df: DataFrame, by: list[str], value: str, q: float, places: list[Callable[[Column], Column]]) -> DataFrame:
    """(by, v0, v1, ...): per group the values at 0-based places, all within two of q * n, of its n non-null values in order.

    Two passes: a mergeable sketch brackets the rank; then only the values inside the bracket, about BRACKET of a
    group on each side, are counted, with a count of those below, and ranked by running sums over ranges. So no task holds
    a hot group, with keys or without. The sketches run while the query is built.
    """
    rows = df.select(*by, F.col(value).alias("__v"))
    shares = F.array(F.lit(max(0.0, q - BRACKET)), F.lit(min(1.0, q + BRACKET)))
    bounds = rows.groupBy(*[F.col(c) for c in by]).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", shares, F.lit(ACCURACY)).alias("__b"))
    # Small groups are ranked whole: there the bracket is narrower than the differences between definitions of a rank.
    wide = F.col("__n") * BRACKET >= 5
    lo = F.when(wide, F.get("__b", F.lit(0))) if q - BRACKET > 0 else F.lit(None).cast("double")
    hi = F.when(wide, F.get("__b", F.lit(1))) if q + BRACKET < 1 else F.lit(None).cast("double")
    bounds = written(bounds.select(*[F.col(c).alias(f"__k_{c}") for c in by], "__n", lo.alias("__lo"), hi.alias("__hi")), "quantile-bounds")
    known = rows.where("__v is not null")
    joined = known.join(bounds, same_keys(by, "__k_")) if by else known.crossJoin(F.broadcast(bounds))  # without keys: one row
    below = F.coalesce(F.col("__v") < F.col("__lo"), F.lit(False))
    above = F.coalesce(F.col("__v") > F.col("__hi"), F.lit(False))
    # One count a group for all values below the bracket, and one for each value within it.
    counted = joined.where(~above).groupBy(*by, F.when(below, F.lit(None)).otherwise(F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    inside = running(counted, by, "__v", "__c", "__upto", "__all").where("__v is not null")
    found = inside.groupBy(*[F.col(c) for c in by]).agg(*[F.min(F.when(F.col("__upto") > place(F.col("__n")), F.col("__v"))).alias(f"v{k}") for k, place in enumerate(places)])
    if not by:
        return found
    groups = bounds.select(*[F.col(f"__k_{c}").alias(c) for c in by])
    return groups.join(found.withColumnsRenamed({c: f"__k_{c}" for c in by}), same_keys(by, "__k_"), "left").select(*by, *[f"v{k}" for k in range(len(places))])


def nearest_quantile(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """(by, name): per group the value at the 0-based place floor((n - 1) * q + 0.5) of its n non-null values in order.

    Groups without values give null. NaN counts as the largest value. Null keys form one group. With no ``by``, one row.
    """
    found = _at_places(df, by, value, q, [lambda n: F.floor((n - 1) * q + 0.5)])
    return found.select(*by, F.col("v0").alias(name))


def median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the mean of the two middle values, or the middle one; otherwise as nearest_quantile."""
    found = _at_places(df, by, value, 0.5, [lambda n: F.floor((n - 1) / 2), lambda n: F.ceil((n - 1) / 2)])
    return found.select(*by, ((F.col("v0") + F.col("v1")) / 2).alias(name))

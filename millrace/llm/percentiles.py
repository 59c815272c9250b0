"""Percentiles of very large columns by cumulative frequencies, combinable over days and shares of the rows."""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.shared import written


def bucketed(value: Column, relative_error: float) -> Column:
    """The value as its geometric bucket's representative, which is off by at most relative_error of it.

    Buckets reach from a to a * (1 + e) / (1 - e), and a * (1 + e) stands for them.
    """
    base = math.log1p(2 * relative_error / (1 - relative_error))
    middle = F.exp(F.floor(F.log(F.abs(value)) / base) * base) * (1 + relative_error)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * middle)


def frequencies(df: DataFrame, by: list[str], value: str, relative_error: float = 0.0) -> DataFrame:
    """(by, value, n): how often each value occurs per group. Null and NaN are no values; null groups are left out.

    Such tables of days or shares of the rows add up by ``combined``. With relative_error they have a bounded number of
    rows a group, whatever the number of rows: about log(largest / smallest) / (2 * relative_error) for each sign.
    """
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("value")).where("value is not null and not isnan(value)").where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True)))
    # 0.0 and -0.0 are one value.
    exact = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))
    rows = rows.withColumn("value", bucketed(F.col("value"), relative_error) if relative_error else exact)
    return rows.groupBy(*by, "value").agg(F.count("*").alias("n"))


def combined(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """The frequencies of several parts together, per group of ``by`` (which may be fewer columns than the parts have)."""
    out = parts[0].select(*by, "value", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select(*by, "value", "n"))
    return out.groupBy(*by, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, value, n_rows): for each group the first value at which at least ``share`` of its rows are reached.

    counts: as ``frequencies`` gives them. Exact on exact values; else off by their relative error. The counts are
    range-sorted by group and value; running sums are taken within each range and group, to which the totals of the
    ranges before are added, so a group with most of the rows is spread over many ranges and no window holds all of it.
    """
    ranged = counts.repartitionByRange(*[F.col(c) for c in by], F.col("value")).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "percentile-ranges")  # fixes the ranges
    within = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy("part", *by).orderBy("value")))
    totals = ranged.groupBy("part", *by).agg(F.sum("n").alias("here"))
    w = Window.partitionBy(*by).orderBy("part")
    offsets = totals.select("part", *by, F.coalesce(F.sum("here").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy(*by)).alias("n_rows"))
    ranks = within.join(offsets, ["part", *by]).withColumn("upto", F.col("upto") + F.col("before"))
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    # The rank of a share: the least whole number of rows that is at least the share of them, 1 at least.
    rank = lambda s: F.greatest(F.ceil(s * F.col("n_rows") - F.lit(1e-9)), F.lit(1))
    hit = F.filter(wanted, lambda s: (rank(s) <= F.col("upto")) & (rank(s) > F.col("upto") - F.col("n")))
    return ranks.select(*by, F.explode(hit).alias("share"), "value", "n_rows")

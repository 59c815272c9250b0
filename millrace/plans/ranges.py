"""Running sums over groups of any size: range-sorted, summed within ranges, offset by the ranges before."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.shared import written


def same_keys(by: list[str], prefix: str) -> Column:
    """That each column of by equals the column of its name with a prefix, nulls too; without columns, true."""
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(prefix + c))
    return same


def running(counts: DataFrame, by: list[str], order: str, n: str, upto: str = "upto", total: str = "total") -> DataFrame:
    """counts with ``upto``, the sum of ``n`` over the rows of the group up to each in ascending order (unique in the group,

    nulls first), and ``total`` over the group. The rows are range-sorted by group and order; running sums are taken within a
    range and added to those of the ranges before, one short row a range and group, so no window holds a whole group. The
    range-sorted rows are written, which fixes the ranges; that job runs while the query is built.
    """
    ranged = written(counts.repartitionByRange(*[F.col(c) for c in by], F.col(order)).withColumn("__part", F.spark_partition_id()), "running-ranges")
    within = ranged.withColumn("__within", F.sum(n).over(Window.partitionBy("__part", *by).orderBy(F.col(order).asc_nulls_first())))
    sums = ranged.groupBy("__part", *by).agg(F.sum(n).alias("__here"))
    before = F.sum("__here").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("__part").alias("__r___part"), *[F.col(c).alias(f"__r_{c}") for c in by], F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__here").over(Window.partitionBy(*by)).alias(total))
    joined = within.join(sums, same_keys(["__part", *by], "__r_"))
    return joined.withColumn(upto, F.col("__within") + F.col("__before")).drop("__part", "__within", "__before", "__r___part", *[f"__r_{c}" for c in by])

"""Scores of many yes-or-no classes in long form (item, cls, y, p): F1, thresholds, folds, weights, wide and long form."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The thresholds that are tried, 0.05 to 0.93 by 0.02.
GRID = [round(0.05 + 0.02 * k, 2) for k in range(45)]


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    below = 2 * tp + fp + fn
    return F.when(below > 0, 2.0 * tp / below).otherwise(F.lit(0.0))


def f1_per_class(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """(cls, f1): 0 where a class has neither labels nor predictions."""
    yes = F.col("p") >= threshold
    c = lambda cond: F.count_if(cond)
    return scored.groupBy("cls").agg(_f1(c(yes & (F.col("y") == 1)), c(yes & (F.col("y") == 0)), c(~yes & (F.col("y") == 1))).alias("f1"))


def macro_f1(scored: DataFrame, classes: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """One row (macro_f1): the mean over all ``classes`` (cls), 0 for those without rows."""
    return classes.select("cls").distinct().join(f1_per_class(scored, threshold), "cls", "left").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"))


def best_thresholds(scored: DataFrame, grid: list[float] = GRID, default: float = 0.5) -> DataFrame:
    """(cls, threshold, f1): the first threshold of the grid with the largest F1; ``default`` and null for classes without a positive.

    Each row falls into one cell of the grid (how many thresholds it reaches); one count a cell and label is shuffled
    and the cells' counts are summed from the top, so the grid's size doesn't multiply the rows.
    """
    steps = F.array(*[F.lit(t) for t in sorted(grid)])
    reached = F.size(F.filter(steps, lambda t: t <= F.col("p")))
    cells = scored.groupBy("cls", reached.alias("cell")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    per_class = cells.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("pos", "neg")))).alias("m"), F.sum("pos").alias("pos"))
    curve = per_class.select("cls", "pos", "m", F.posexplode(steps).alias("k", "threshold"))
    above = lambda what: F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] > F.col("k"), e["value"][what]).otherwise(0))
    tp, fp = above("pos"), above("neg")
    scored_ = curve.withColumn("f1", _f1(tp, fp, F.col("pos") - tp))
    # Largest F1, and of equal ones the smallest threshold.
    best = scored_.groupBy("cls", "pos").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select("cls", F.when(F.col("pos") > 0, -F.col("b.t")).otherwise(F.lit(default)).alias("threshold"), F.when(F.col("pos") > 0, F.col("b.f1")).alias("f1"))


def labelled(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(item, cls, label): 1 where p reaches its class's threshold; classes without one are left out."""
    t = thresholds.select(F.col("cls").alias("__c"), "threshold")
    return scored.join(t, F.col("cls") == F.col("__c")).select("item", "cls", (F.col("p") >= F.col("threshold")).cast("int").alias("label"))


def positive_weights(labels: DataFrame) -> DataFrame:
    """(cls, pos, neg, weight): negatives per positive, 1 where either is missing."""
    counts = labels.groupBy("cls").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return counts.withColumn("weight", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("neg") / F.col("pos")).otherwise(F.lit(1.0)))


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """A fold by hash: the same on every engine and cluster, whatever the order of rows."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def shuffled_folds(n: int, folds: int = 5, seed: int = 42) -> np.ndarray:
    """The fold of each of n rows by a seeded shuffle and even cuts, the first folds one larger: for tables whose row numbers the driver can hold."""
    places = np.arange(n)
    np.random.RandomState(seed).shuffle(places)
    out = np.empty(n, np.int32)
    for k, part in enumerate(np.array_split(places, folds)):
        out[part] = k
    return out


def fold_average(predictions: DataFrame, folds: int) -> DataFrame:
    """(item, cls, p): the folds' probabilities, each divided by their number, summed."""
    return predictions.groupBy("item", "cls").agg(F.sum(F.col("p") / folds).alias("p"))


def to_long(wide: DataFrame, key: list[str], columns: list[str], name: str = "cls", value: str = "y") -> DataFrame:
    return wide.unpivot(key, columns, name, value)


def to_wide(long: DataFrame, key: list[str], classes: list[str], name: str = "cls", value: str = "label") -> DataFrame:
    """One column a class, in the order given; 0 where a class has no row. The classes are given, so no pass looks for them."""
    return long.groupBy(*key).pivot(name, classes).agg(F.max(value)).na.fill(0, classes)

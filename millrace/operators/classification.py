"""Many yes-or-no classes, from features to labels that agree with a hierarchy: folds, boosted trees, thresholds, closure, score."""

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.operators import multilabel
from millrace.operators.ontology import closure
from millrace.plans.shared import written

AT_ONCE = 4  # models that are fitted at one time, each on the whole cluster
BINS = 32  # intervals of a feature, as many as Spark's trees tell apart
SENT = 4_000_000  # probabilities that may be sent to all executors instead of joined by a shuffle


def cut_points(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """For each feature (array<double>) what parts its intervals: the middles between all its values where these are at most ``bins``, else quantiles over all rows."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray | None] = {}
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                for j in range(x.shape[1]):
                    if held.get(j, x[:0, j]) is not None:
                        values = np.unique(np.concatenate([held.get(j, x[:0, j]), x[:, j]]))
                        held[j] = values if len(values) <= bins else None
        f, v = [], []
        for j, values in held.items():
            f += [j] * (1 if values is None else len(values))
            v += [None] if values is None else values.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(v, pa.float64())], names=["f", "v"])

    seen: dict[int, list] = {}
    for f, v in rows.select("features").mapInArrow(few, "f int, v double").distinct().orderBy("f", "v").toLocalIterator():
        seen.setdefault(f, []).append(v)
    many = [f for f, v in seen.items() if v[0] is None or len(v) > bins]
    cuts = {f: (np.array(v[:-1]) + np.array(v[1:])) / 2 for f, v in seen.items() if f not in many}
    if many:
        wide = rows.select(*[F.col("features")[f].alias(f"f{f}") for f in many])
        for f, q in zip(many, wide.approxQuantile(wide.columns, [i / bins for i in range(1, bins)], 0.001), strict=True):
            cuts[f] = np.unique(q)
    return [cuts[f] for f in sorted(cuts)]


def boosted_folds(train: DataFrame, test: DataFrame, classes: list[str], *, item: str, folds: int = 5, trees: int = 300, depth: int = 6, gain: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(out of fold: item, cls, y, p; test: item, cls, p): a boosted-tree model for each class and fold on ``features`` (vector).

    train: item, features and a 0/1 column a class (null counts as 0). An item's fold is that of its hash. A model is fitted on the
    other folds, positives weighed by negatives per positive, with at most ``trees`` trees of 2 ** depth leaves; it stops where a
    further tree betters the error on its own fold by less than ``gain`` of it, so that fold only sees models it didn't train.
    Test probabilities are the folds' mean. A fold whose training rows have one kind of label gives that share as p.

    Trees tell only a feature's intervals apart, so rows are put into intervals once and those alike in all features, fold and
    labels are counted: models are fitted on the counts as weights, and predict for each combination that occurs, not each row.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    of = multilabel.fold_of(F.col(item), folds, seed)
    labelled = train.select(item, vector_to_array("features").alias("features"), of.alias("__fold"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in classes])
    cuts = cut_points(labelled)

    def binned(rows: DataFrame) -> DataFrame:
        """rows with the intervals of their features, a byte each, in place of these."""
        at = rows.columns.index("features")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column(at).flatten().to_numpy().reshape(b.num_rows, -1)
                    bytes_ = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
                    ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(cuts)
                    key = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bytes_))])
                    yield pa.RecordBatch.from_arrays([key if j == at else c for j, c in enumerate(b.columns)], names=b.schema.names)

        return rows.mapInArrow(run, StructType([StructField("features", BinaryType()) if f.name == "features" else f for f in rows.schema])).withColumnRenamed("features", "__key")

    placed, asked = binned(labelled), binned(test.select(item, vector_to_array("features").alias("features")))
    cells = written(placed.groupBy("__key", "__fold", *classes).agg(F.count("*").alias("__n")), "boosted-cells")
    counts = {r["__fold"]: r for r in cells.groupBy("__fold").agg(F.sum("__n").alias("n"), *[F.sum(F.col("__n") * F.col(c)).alias(c) for c in classes]).collect()}
    n = sum(r["n"] for r in counts.values())
    numbers = F.transform(F.sequence(F.lit(1), F.lit(len(cuts))), lambda i: F.conv(F.hex(F.substring(F.col("__key"), i, F.lit(1))), 16, 10).cast("double"))
    keys = written(cells.select("__key").union(asked.select("__key")).distinct().withColumn("__a", numbers), "boosted-keys")
    vectors = lambda df: df.withColumn("features", array_to_vector("__a")).drop("__a")
    shapes = cells.withColumn("__a", numbers)

    def fit(job: tuple[str, int]):
        c, fold = job
        own = counts.get(fold)
        rows, positive = n - (own["n"] if own else 0), sum(r[c] for r in counts.values()) - (own[c] if own else 0)
        if positive in (0, rows):
            return float(positive / rows) if rows else 0.0
        weight = F.when(F.col(c) == 1, F.lit((rows - positive) / positive)).otherwise(F.lit(1.0))
        held = (F.col("__fold") == fold).alias("__held")
        data = vectors(shapes.groupBy("__a", F.col(c).alias(c), held).agg(F.sum("__n").alias("__n"))).select("features", F.col(c).alias("__y"), (weight * F.col("__n")).alias("__w"), "__held")
        return GBTClassifier(featuresCol="features", labelCol="__y", weightCol="__w", validationIndicatorCol="__held", validationTol=gain, maxIter=trees, maxDepth=depth, maxBins=BINS, stepSize=0.05, seed=seed).fit(data)

    jobs = [(c, k) for c in classes for k in range(folds)]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        models = dict(zip(jobs, pool.map(fit, jobs), strict=True))
    known = vectors(keys)
    for j, job in enumerate(jobs):
        m = models[job]
        if isinstance(m, float):
            known = known.withColumn(f"__p{j}", F.lit(m))
        else:
            before = known.columns
            known = m.transform(known).select(*before, vector_to_array("probability")[1].alias(f"__p{j}"))
    of_class = lambda k: F.array(*[F.col(f"__p{j}") for j, (c, _) in enumerate(jobs) if c == classes[k]])
    known = written(known.select("__key", F.array(*[of_class(k) for k in range(len(classes))]).alias("__p")), "boosted-probabilities")
    if known.count() * len(jobs) <= SENT:
        known = F.broadcast(known)
    p = lambda k: F.col("__p")[k]
    own = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(c).cast("int").alias("y"), F.get(p(k), F.col("__fold")).alias("p")) for k, c in enumerate(classes)])
    mean = F.array(*[F.struct(F.lit(c).alias("cls"), F.aggregate(p(k), F.lit(0.0), lambda s, x: s + x / folds).alias("p")) for k, c in enumerate(classes)])
    return placed.join(known, "__key").select(item, F.inline(own)), asked.join(known, "__key").select(item, F.inline(mean))


def agreeing_labels(held: DataFrame, tested: DataFrame, edges: DataFrame, *, default: float = 0.5) -> DataFrame:
    """(item, cls, p, label) for test probabilities (item, cls, p): each class's threshold is the best one out of fold (item, cls, y, p).

    Probabilities, then labels, are raised to the largest of a class's descendants in edges (child, parent). Classes that have no
    probability for an item get their descendants'; classes without out-of-fold rows are labelled at ``default``.
    """
    over = closure(edges).groupBy(F.col("descendant").alias("__c")).agg(F.collect_list("ancestor").alias("__up"))

    def risen(rows: DataFrame) -> DataFrame:
        """rows once for their class and once for each above it, from one scan; __own: whether it is their class."""
        all_ = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("__up", F.array().cast("array<string>")))
        each = rows.join(over, F.col("cls") == F.col("__c"), "left").withColumn("__a", F.explode(all_)).drop("__c", "__up")
        return each.withColumn("__own", F.col("__a").isNull()).withColumn("cls", F.coalesce("__a", "cls")).drop("__a")

    raised = risen(tested.select("item", "cls", "p")).groupBy("item", "cls").agg(F.max("p").alias("p"))
    best = multilabel.best_thresholds(held, default=default).select(F.col("cls").alias("__c"), "threshold")
    own = raised.join(best, F.col("cls") == F.col("__c"), "left").select("item", "cls", "p", (F.col("p") >= F.coalesce("threshold", F.lit(default))).cast("int").alias("label"))
    # A class above has a row of its own by now, so one aggregate has both its probability and all labels below it.
    return risen(own).groupBy("item", "cls").agg(F.max(F.when(F.col("__own"), F.col("p"))).alias("p"), F.max("label").alias("label"))


def save(model, path: str) -> None:
    """A fitted Spark ML model to a folder that all executors share, over what is there."""
    model.write().overwrite().save(path)


def load(path: str):
    """A Spark ML model as ``save`` left it."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, None)

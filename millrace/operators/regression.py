"""Per-device models: ridge in closed form, logistic regression by Newton steps, two stages, holdout, seasonal split.

Ridge regressions and all scales are solved from sums over all rows (counts, sums and products, reduced before the shuffle).
Only the chance of being on, a classifier, is fitted on at most a stated number of a device's rows, a sample by hash, so that
a hot device doesn't gather in one task. Predictions, means and errors cover all rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.retrieval import seeded_sample
from millrace.plans.shared import written

SENSORS = ["t4", "t5", "t8", "t13", "t6", "t12", "t1", "t10", "t11"]
FEATURES = [*SENSORS, "dt4", "dt8", "month_sin", "month_cos"]
ON = 0.001  # above this share of power a pump is on


def features(df: DataFrame, extra: list[str] | None = None) -> Column:
    """The features of a row in fixed order as an array, nulls as 0; ``solar`` where given as extra."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*FEATURES, *(extra or [])] if c in df.columns])


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and intercept by damped Newton steps; L2 with 1 / c, the intercept isn't penalised."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    pen = np.append(np.full(x.shape[1], 1 / c), 0.0)

    def loss(v: np.ndarray) -> float:
        z = xb @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (pen * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -500, 500)))
        g = xb.T @ (p - y) + pen * w
        h = (xb * (p * (1 - p))[:, None]).T @ xb + np.diag(pen) + 1e-9 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(w - t * d) > now:
            t /= 2
        w = w - t * d
        new = loss(w)
        if abs(now - new) < 1e-10 * max(1.0, abs(now)):
            break
        now = new
    return w[:-1], float(w[-1])


class Sums:
    """What ridge regression needs of rows: their number, and the means and products of [features, target]."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray):
        self.n, self.mean = n, sums / max(n, 1)
        k = len(sums)
        self.covariance = np.zeros((k, k))
        self.covariance[np.triu_indices(k)] = products
        self.covariance += np.triu(self.covariance, 1).T
        self.covariance = self.covariance / max(n, 1) - np.outer(self.mean, self.mean)

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> "Sums":
        z = np.column_stack([x, y])
        return cls(len(z), z.sum(0), (z.T @ z)[np.triu_indices(z.shape[1])])

    def scales(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation of each feature; no deviation counts as 1."""
        variance = np.diag(self.covariance)[:-1]
        # What rounding leaves of a constant feature is none.
        flat = variance <= 1e-11 * np.maximum(self.mean[:-1] ** 2, 1e-300)
        return self.mean[:-1], np.where(flat, 1.0, np.sqrt(np.maximum(variance, 0)))

    def weights(self, s: np.ndarray, alpha: float) -> np.ndarray:
        """Of the features less their means over s."""
        xx = self.n * self.covariance[:-1, :-1] / np.outer(s, s)
        return np.linalg.solve(xx + alpha * np.eye(len(s)), self.n * self.covariance[:-1, -1] / s)

    def ridge(self, alpha: float) -> dict:
        """Scales, weights for the scaled features, and the intercept, which isn't penalised."""
        m, s = self.scales()
        return {"m": m, "s": s, "w": self.weights(s, alpha), "b": float(self.mean[-1])}


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept for x as it is; the intercept isn't penalised."""
    all_ = Sums.of(x, y)
    w = all_.weights(np.ones(x.shape[1]), alpha)
    return w, float(all_.mean[-1] - all_.mean[:-1] @ w)


def _single(x: Column) -> Column:
    """Features as 32-bit numbers, in which models are fitted and applied."""
    return F.transform(x, lambda v: v.cast("float").cast("double"))


def _dot(x: Column, m: Column, s: Column, w: Column) -> Column:
    """The features less m, over s, times the weights, summed."""
    z = F.zip_with(F.zip_with(_single(x), m, lambda a, c: a - c), s, lambda a, c: a / c)
    return F.aggregate(F.zip_with(z, w, lambda a, c: a * c), F.lit(0.0), lambda t, v: t + v)


def sums(df: DataFrame, by: list[str], size: int, x: str, target: str, where: Column | None = None) -> DataFrame:
    """(by, n, sums, products): over the rows' [features, target], the upper triangle of products by rows. One row without by."""
    z = [F.get("__x", F.lit(i)) for i in range(size)] + [F.col("__y")]
    rows = df if where is None else df.where(where)
    rows = rows.select(*by, _single(F.col(x)).alias("__x"), F.col(target).cast("double").alias("__y"))
    products = [F.sum(z[i] * z[j]) for i in range(size + 1) for j in range(i, size + 1)]
    return rows.groupBy(*[F.col(c) for c in by]).agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in z]).alias("sums"), F.array(*products).alias("products"))


def _overall(found: DataFrame, size: int) -> Sums:
    """The one row of sums over all rows."""
    r = found.first()
    return Sums(r["n"], np.array(r["sums"]), np.array(r["products"])) if r and r["n"] else Sums(0, np.zeros(size + 1), np.zeros((size + 1) * (size + 2) // 2))


def fit_two_stage(x: np.ndarray, y: np.ndarray, least: int = 50) -> dict:
    """Ridge on all rows where on or off has fewer than ``least``, else the chance of on times ridge on the on rows."""
    x = np.asarray(x, np.float32).astype(float)
    on = y > ON
    return _two_stage(Sums.of(x, y), Sums.of(x[on], y[on]), x, on, least)


def _two_stage(whole: Sums, ons: Sums, x: np.ndarray, on: np.ndarray, least: int = 50) -> dict:
    """From the sums over all rows and over the rows that are on, and rows to fit the chance of on by."""
    if ons.n < least or whole.n - ons.n < least:
        return {"kind": "ridge", **whole.ridge(0.1)}
    m, s = whole.scales()
    wl, bl = logistic((np.asarray(x, np.float32).astype(float) - m) / s, on.astype(float))
    second = ons.ridge(0.1)
    return {"kind": "two_stage", "m": m, "s": s, "wl": wl, "bl": bl, "m2": second["m"], "s2": second["s"], "w": second["w"], "b": second["b"]}


def predict_two_stage(model: dict, x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32).astype(float)
    z = (x - model["m"]) / model["s"]
    if model["kind"] == "ridge":
        return np.maximum(z @ model["w"] + model["b"], 0)
    on = 1 / (1 + np.exp(-np.clip(z @ model["wl"] + model["bl"], -500, 500)))
    return on * np.maximum((x - model["m2"]) / model["s2"] @ model["w"] + model["b"], 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def sampled(df: DataFrame, key: str, row: str, most: int) -> DataFrame:
    """At most ``most`` rows a key, in the order of a hash: the documented bound on the rows that a key's classifier is fitted on."""
    return seeded_sample(df, row, most, by=[key])


def predict_monthly(train: DataFrame, predict: DataFrame, *, key: str, row: str, target: str, least: int = 200, fallback: int = 50_000, most: int = 200_000) -> DataFrame:
    """(key, year, month, prediction): per device two-stage models, the mean of their predictions a month, within 0 and 1.

    train, predict: key, row (a unique number), year, month, features ("x", array) and in train the target. Devices with fewer
    than ``least`` training rows use one model on a hash sample of ``fallback`` rows of all; devices without training rows
    get no prediction. Ridge stages and scales are from all of a device's rows; the chance of on is fitted on at most
    ``most`` of them, a hash sample; predictions cover all rows.
    """
    train = train.where(F.col(key).isNotNull())
    whole = seeded_sample(train.select(row, "x", target), row, fallback).toPandas()
    overall = fit_two_stage(_matrix(whole["x"]), whole[target].to_numpy(float)) if len(whole) else None
    fields = ["kind", "m", "s", "wl", "bl", "m2", "s2", "w", "b"]
    kinds = f"`{key}` {dict(train.dtypes)[key]}, kind string, m array<double>, s array<double>, wl array<double>, bl double, m2 array<double>, s2 array<double>, w array<double>, b double"
    size = len(whole["x"].iloc[0]) if len(whole) else 0
    # One row a device, which meets the sample's rows.
    total = sums(train, [key], size, "x", target).withColumnRenamed(key, "__key")
    ons = sums(train, [key], size, "x", target, F.col(target) > ON).select(F.col(key).alias("__on_key"), F.col("n").alias("on_n"), F.col("sums").alias("on_sums"), F.col("products").alias("on_products"))
    total = total.join(ons, F.col("__key") == F.col("__on_key"), "left").drop("__on_key")
    total = written(total, "regression-sums")
    # Only devices with a classifier need their rows.
    need = total.where((F.col("n") >= least) & (F.coalesce("on_n", F.lit(0)) >= 50) & (F.col("n") - F.col("on_n") >= 50)).select("__key")
    chosen = sampled(train.select(key, row, "x", target).join(need, F.col(key) == F.col("__key"), "left_semi"), key, row, most)
    none = Sums(0, np.zeros(size + 1), np.zeros((size + 1) * (size + 2) // 2))

    def fit(_: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found):
            return pd.DataFrame(columns=[key, *fields])
        f = found.iloc[0]
        model = overall
        if f["n"] >= least:
            ons = Sums(int(f["on_n"]), np.array(f["on_sums"]), np.array(f["on_products"])) if f["on_sums"] is not None else none
            x = _matrix(rows["x"]) if len(rows) else np.zeros((0, size))
            model = _two_stage(Sums(int(f["n"]), np.array(f["sums"]), np.array(f["products"])), ons, x, rows[target].to_numpy(float) > ON)
        return pd.DataFrame([[f["__key"], *[model.get(c) for c in fields]]], columns=[key, *fields])

    models = chosen.groupBy(key).cogroup(total.groupBy("__key")).applyInPandas(fit, kinds)
    joined = predict.select(key, "year", "month", "x").join(models.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"))

    # Linear models are applied by array functions, so rows stay in the JVM.
    c = F.col
    level = F.greatest(F.lit(0.0), _dot(c("x"), c("m"), c("s"), c("w")) + c("b"))
    second = F.greatest(F.lit(0.0), _dot(c("x"), c("m2"), c("s2"), c("w")) + c("b"))
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), _dot(c("x"), c("m"), c("s"), c("wl")) + c("bl")))))
    each = joined.select(key, "year", "month", F.when(c("kind") == "ridge", level).otherwise(chance * second).alias("p"))
    means = each.groupBy(key, "year", "month").agg(F.avg("p").alias("prediction"))
    return means.withColumn("prediction", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")))


def holdout(context: DataFrame, held: DataFrame, *, key: str, row: str, target: str, least: int = 200) -> DataFrame:
    """(key, actual, predicted, baseline): per device the mean of the held rows, of a ridge model's predictions for them, and of its context.

    Devices with fewer than ``least`` context rows use one model (alpha 1) on all rows of all devices; a device without
    context is left out. All models are from sums over all rows.
    """
    size = context.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    overall = _overall(sums(context, [], size, "x", target), size).ridge(1.0)
    kind = dict(context.dtypes)[key]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            models = [Sums(int(n), np.array(s), np.array(p)).ridge(0.1) if n >= least else overall for n, s, p in zip(b["n"], b["sums"], b["products"], strict=True)]
            yield pd.DataFrame([[k, m["m"], m["s"], m["w"], m["b"]] for k, m in zip(b[key], models, strict=True)], columns=["__key", "m", "s", "w", "b"])

    models = sums(context, [key], size, "x", target).mapInPandas(fit, f"__key {kind}, m array<double>, s array<double>, w array<double>, b double")
    dot = _dot(F.col("x"), F.col("m"), F.col("s"), F.col("w"))
    scored = held.join(models, F.col(key) == F.col("__key")).withColumn("__p", F.greatest(F.lit(0.0), dot + F.col("b")))
    result = scored.groupBy(key).agg(F.avg(target).alias("actual"), F.avg("__p").alias("predicted"))
    base = context.groupBy(F.col(key).alias("__key")).agg(F.avg(target).alias("baseline"))
    return result.join(base, F.col(key) == F.col("__key"), "left").drop("__key")


def seasonal(context: DataFrame, held: DataFrame, *, key: str, row: str, target: str, months: list[int], deviation: float = 0.25, least: int = 200, least_held: int = 10, least_warm: int = 100) -> DataFrame:
    """(key, error_all, error_split, high): absolute errors of a device's mean by a model on all its context, and by one on

    the given months where the target varies more than ``deviation`` and enough such rows exist. Devices with fewer than
    ``least`` context or ``least_held`` held rows are left out.
    """
    counts = context.groupBy(key).agg(F.count("*").alias("n"), F.stddev_samp(target).alias("sd"), F.count_if(F.col("month").isin(months)).alias("warm"))
    enough = counts.join(held.groupBy(key).agg(F.count("*").alias("nh")), key).where((F.col("n") >= least) & (F.col("nh") >= least_held))
    both = holdout(context.join(enough.select(key), key, "left_semi"), held.join(enough.select(key), key, "left_semi"), key=key, row=row, target=target, least=least)
    split = enough.where((F.col("sd") > deviation) & (F.col("warm") >= least_warm)).select(key)
    warm = holdout(context.where(F.col("month").isin(months)).join(split, key, "left_semi"), held.join(split, key, "left_semi"), key=key, row=row, target=target, least=least_warm)
    w = warm.select(F.col(key).alias("__key"), F.abs(F.col("actual") - F.col("predicted")).alias("__e"))
    e = F.abs(F.col("actual") - F.col("predicted"))
    return both.join(w, F.col(key) == F.col("__key"), "left").join(enough.select(F.col(key).alias("__k2"), "sd"), F.col(key) == F.col("__k2")).select(key, e.alias("error_all"), F.coalesce("__e", e).alias("error_split"), (F.col("sd") > deviation).alias("high"))

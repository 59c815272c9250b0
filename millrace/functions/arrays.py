"""Waveforms as arrays of numbers: resampling, scaling, differences, moving means, error measures, guarded correlation."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def resampled(samples: Column, n: int) -> Column:
    """n values at places i * len / n (the end excluded) by linear interpolation, held at the last sample; an array of n is kept.

    Null for null and empty arrays.
    """
    size = F.size(samples)

    def at(i: Column) -> Column:
        x = i * size / F.lit(float(n))
        lo = F.least(F.floor(x).cast("int"), size - 1)
        hi = F.least(lo + 1, size - 1)
        a = F.get(samples, lo).cast("double")
        return a + (F.get(samples, hi).cast("double") - a) * (x - lo)

    return F.when(size == n, _double(samples)).when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def extrapolated(samples: Column, n: int) -> Column:
    """As resampled, but beyond the last sample the last segment goes on; a single sample is repeated."""
    size = F.size(samples)

    def at(i: Column) -> Column:
        x = i * size / F.lit(float(n))
        lo = F.greatest(F.least(F.floor(x).cast("int"), size - 2), F.lit(0))
        a = F.get(samples, lo).cast("double")
        b = F.coalesce(F.get(samples, lo + 1).cast("double"), a)
        return a + (b - a) * (x - lo)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, not once an element where it is used within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def std(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / F.size(a))))


def covariance(a: Column, b: Column) -> Column:
    """Population covariance."""
    return let(F.struct(mean(a).alias("a"), mean(b).alias("b")), lambda m: mean(F.zip_with(a, b, lambda x, y: (x.cast("double") - m["a"]) * (y.cast("double") - m["b"]))))


def differences(a: Column) -> Column:
    """Each value less the one before; empty for fewer than two."""
    n = F.size(a)
    return F.when(n >= 2, F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1), lambda x, y: x.cast("double") - y)).when(n >= 0, F.array().cast("array<double>"))


def affine(a: Column, shift: Column | float, scale: Column | float) -> Column:
    """(x - shift) / scale for each x."""
    s = shift if isinstance(shift, Column) else F.lit(float(shift))
    k = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.transform(a, lambda x: (x.cast("double") - s) / k)


def clipped(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double"))))


def moving_mean(a: Column, window: int) -> Column:
    """Sums over an odd window divided by its width; places beyond the ends count as 0."""
    half = window // 2
    return F.transform(_double(a), lambda _, i: total(F.slice(a, F.greatest(i - half + 1, F.lit(1)), F.least(i + half + 1, F.size(a)) - F.greatest(i - half + 1, F.lit(1)) + 1)) / window)


def mae(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def mse(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mse(a, b))


def safe_correlation(a: Column, b: Column) -> Column:
    """Pearson's; 0 for fewer than two values or where either hardly varies (population deviation under 1e-8)."""
    spread = F.struct(F.size(a).alias("n"), std(a).alias("a"), std(b).alias("b"), covariance(a, b).alias("c"))
    return let(spread, lambda s: F.when((s["n"] < 2) | (s["a"] < 1e-8) | (s["b"] < 1e-8), F.lit(0.0)).otherwise(F.try_divide(s["c"], s["a"] * s["b"])))


def composite_loss(p: Column, t: Column, l1: float, derivative: float, correlation: float) -> Column:
    """Squared error + l1 * absolute error + derivative * squared error of differences + correlation * (1 - r), r with small constants."""
    spread = F.struct((std(p) * std(p) + 1e-8).alias("p"), (std(t) * std(t) + 1e-8).alias("t"), covariance(p, t).alias("c"))
    r = let(spread, lambda s: s["c"] / (F.sqrt(s["p"] * s["t"]) + 1e-8))
    steps = let(F.struct(differences(p).alias("p"), differences(t).alias("t")), lambda d: mse(d["p"], d["t"]))
    return mse(p, t) + l1 * mae(p, t) + derivative * steps + correlation * (1 - r)


def augmented(a: Column, seed: int, amplitude: float = 0.1, offset: float = 0.05, noise: float = 0.01) -> Column:
    """A random scale and offset for the array and noise for each value, reproducible for a seed and partitioning."""
    scale = 1 + (F.rand(seed) * 2 - 1) * amplitude
    shift = (F.rand(seed + 1) * 2 - 1) * offset
    base = F.transform(a, lambda x: x.cast("double") * scale + shift)
    # Noise from a hash of place and value: random functions give one value an array.
    unit = lambda x, i, k: F.pmod(F.xxhash64(x, i, F.lit(seed + k)), F.lit(1 << 24)).cast("double") / (1 << 24)
    gauss = lambda x, i: F.sqrt(-2 * F.log(unit(x, i, 2) + 1e-9)) * F.cos(6.283185307179586 * unit(x, i, 3))
    return F.transform(base, lambda x, i: x + noise * gauss(x, i))

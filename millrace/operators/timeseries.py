"""Cleaning and features of per-device series: capping, differences, lags, weather, calendar, months, fallbacks, errors."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.nulls import clip
from millrace.operators.quantiles import median, nearest_quantile

UNTIMED = 10_000  # ties to a bucket of rows without time


def utc_time(c: Column | str) -> Column:
    """A text like ``2025-04-01 12:00:00 UTC`` as a time without zone; anything else is null."""
    text = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.regexp_replace(text, " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def non_negative(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value is null or not negative."""
    return df.where(F.col(column).isNull() | (F.col(column) >= 0))


def winsorized(df: DataFrame, key: str, column: str, q: float, training: Column) -> DataFrame:
    """column capped, in all rows, at its key's nearest quantile q over the training rows; keys without such rows aren't capped."""
    caps = nearest_quantile(df.where(training), [key], column, q, "__cap").withColumnRenamed(key, "__key")
    joined = df.join(caps, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(column, clip(column, high=F.col("__cap"))).drop("__cap", "__key")


def lagged(df: DataFrame, key: str, time: str, tie: str, columns: dict[str, tuple[str, int]], bucket: str = "DAY") -> DataFrame:
    """df with columns {name: (source, n)}: the source's value n rows before, in the key's order of time (nulls first), then tie.

    A key's rows are spread over buckets of time, those without time over buckets of a whole-number tie (of any other
    tie they are one bucket); each bucket is ordered by itself, and only the last rows of the buckets before, found by
    a window over one short row a bucket, cross its border. tie must make the order total.
    """
    most = max(n for _, n in columns.values())
    sources = sorted({s for s, _ in columns.values()})
    whole = dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint")
    untimed = F.when(F.col(time).isNull(), F.floor(F.col(tie) / UNTIMED)) if whole else F.lit(None)
    b = df.withColumn("__bucket", F.struct(F.date_trunc(bucket, F.col(time)).cast("timestamp_ntz").alias("t"), untimed.cast("long").alias("u")))
    within = Window.partitionBy(key, "__bucket").orderBy(F.col(time).asc_nulls_first(), tie)
    b = b.withColumn("__rn", F.row_number().over(within))
    values = F.struct(F.lit(1).alias("__row"), *sources)
    for k in range(1, most + 1):
        b = b.withColumn(f"__lag{k}", F.lag(values, k).over(within))
    # The last rows of each bucket, newest first; lags already hold the ones before a bucket's last row.
    last = F.max_by(F.array(values, *[F.col(f"__lag{k}") for k in range(1, most)]), "__rn")
    tails = b.groupBy(key, "__bucket").agg(last.alias("__tail"))
    tails = tails.withColumn("__tail", F.filter("__tail", lambda s: s.isNotNull()))
    order = Window.partitionBy(key).orderBy(F.col("__bucket").asc_nulls_first())
    # Up to ``most`` buckets back hold enough rows, as each has at least one.
    before = F.flatten(F.array(*[F.coalesce(F.lag("__tail", k).over(order), F.expr("slice(__tail, 1, 0)")) for k in range(1, most + 1)]))
    tails = tails.withColumn("__before", before).drop("__tail").withColumnsRenamed({key: "__key", "__bucket": "__b"})
    joined = b.join(tails, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__b")), "left")
    for name, (source, n) in columns.items():
        own = F.col(f"__lag{n}")
        joined = joined.withColumn(name, F.when(own.isNotNull(), own[source]).otherwise(F.get("__before", n - F.col("__rn"))[source]))
    return joined.drop("__key", "__b", "__before", "__bucket", "__rn", *[f"__lag{k}" for k in range(1, most + 1)])


def differences(df: DataFrame, key: str, time: str, tie: str, columns: list[str], prefix: str = "d") -> DataFrame:
    """Each column less its value in the key's row before, as ``prefix`` + column."""
    with_lags = lagged(df, key, time, tie, {f"__prev_{c}": (c, 1) for c in columns})
    for c in columns:
        with_lags = with_lags.withColumn(prefix + c, F.col(c) - F.col(f"__prev_{c}"))
    return with_lags.drop(*[f"__prev_{c}" for c in columns])


def tenth(c: Column | str) -> Column:
    """A coordinate in whole tenths of a degree, half up: an exact key for joins, unlike rounded doubles; null for NaN."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x), F.round(x * 10).cast("int"))


def with_weather(df: DataFrame, devices: DataFrame, weather: DataFrame | None, *, key: str = "deviceId", time: str = "timedate", value: str = "solar_rad") -> DataFrame:
    """df with its device's coordinates (in tenths of a degree) and the weather there at that hour; without weather, df.

    Devices and weather may hold a key several times: rows then multiply, as in any left join, but copies and devices
    without coordinates are left out first.
    """
    if weather is None:
        return df
    places = devices.select(F.col(key).alias("__device"), tenth("latitude").alias("lat10"), tenth("longitude").alias("lon10")).where("lat10 is not null and lon10 is not null").distinct()
    at = weather.select(tenth("latitude").alias("__lat"), tenth("longitude").alias("__lon"), F.col("hour").cast("timestamp_ntz").alias("__hour"), value).distinct()
    placed = df.join(places, F.col(key) == F.col("__device"), "left").drop("__device").withColumn("__h", F.date_trunc("HOUR", time).cast("timestamp_ntz"))
    joined = placed.join(at, (F.col("lat10") == F.col("__lat")) & (F.col("lon10") == F.col("__lon")) & (F.col("__h") == F.col("__hour")), "left")
    return joined.drop("__lat", "__lon", "__hour", "__h")


def calendar(df: DataFrame, time: str) -> DataFrame:
    """df with year, month (ints), and month_sin, month_cos."""
    angle = 2 * math.pi * F.col("month") / 12
    return df.withColumns({"year": F.year(time), "month": F.month(time)}).withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def scaled_by_max(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """column, nulls as 0, over the largest of its group plus 1e-6. The maxima are reduced first and joined, not gathered."""
    x = F.coalesce(F.col(column), F.lit(0.0))
    top = df.groupBy(*by).agg(F.max(x).alias("__top")).withColumnsRenamed({c: f"__k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return df.join(top, same).withColumn(name, x / (F.col("__top") + 1e-6)).drop("__top", *[f"__k_{c}" for c in by])


def monthly_means(df: DataFrame, key: str, time: str, value: str, name: str = "prediction", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(key, year, month, name): means within bounds; groups without values are null."""
    means = df.groupBy(key, F.year(time).alias("year"), F.month(time).alias("month")).agg(F.avg(value).alias(name))
    return means.withColumn(name, clip(name, low, high))


def grid(keys: DataFrame, key: str, year: int, months: list[int]) -> DataFrame:
    """Every distinct key with every month: an explode, not a join."""
    return keys.select(key).distinct().select(key, F.lit(year).alias("year"), F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))


def grid_filled(cells: DataFrame, monthly: DataFrame, key: str, value: str = "prediction") -> DataFrame:
    """cells with the monthly value, else the key's median month, else the median of all months."""
    per_key = median(monthly, [key], value, "__own")
    overall = median(monthly, [], value, "__all")  # one row
    out = cells.join(monthly.select(key, "year", "month", value), [key, "year", "month"], "left").join(per_key, key, "left").crossJoin(F.broadcast(overall))
    return out.select(key, "year", "month", F.coalesce(value, "__own", "__all").alias(value))


def split_month(df: DataFrame, time: str, year: int, month: int) -> tuple[DataFrame, DataFrame]:
    """(rows of that month, rows of other months); rows without time are in neither."""
    hit = (F.year(time) == year) & (F.month(time) == month)
    return df.where(hit), df.where(~hit)


def error_report(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mae, mse, rmse, bias and n of the rows where both are given."""
    both = pairs.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(predicted) - F.col(actual)
    return both.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count("*").alias("n"))

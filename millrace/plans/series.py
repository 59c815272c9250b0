"""Queries of the time-series operators on the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.nulls import drop_nulls, nan_to_null
from millrace.operators import regression
from millrace.operators import timeseries as ts
from millrace.operators.quantiles import median, nearest_quantile
from millrace.plans.catalogue import Catalogue
from millrace.plans.tables import table

C = Catalogue()
SENSORS = ["t4", "t5", "t8", "t13", "t6", "t12", "t1", "t10", "t11"]


def readings(spark: SparkSession, d: str) -> DataFrame:
    """The readings with parsed time; NaN is taken as absent."""
    df = table(spark, d, "device_data").select("reading_id", "deviceId", "timedate", "period", "deviceType", *[nan_to_null(c).alias(c) for c in ("x2", *SENSORS)])
    return df.withColumn("ts", ts.utc_time("timedate"))


def _sql(rest: str) -> str:
    cols = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("x2", *SENSORS))
    return f"""WITH r AS (SELECT reading_id, "deviceId", timedate, period, "deviceType", {cols},
  TRY_STRPTIME(regexp_replace(timedate, ' UTC$', ''), '%Y-%m-%d %H:%M:%S') AS ts FROM device_data){rest}"""


NEAREST = "floor((n - 1) * {q} + 0.5)"


def _nearest(source: str, by: str, value: str, q: float, name: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}{value} AS {name} FROM (SELECT {head}{value}, row_number() OVER ({part} ORDER BY {value}) - 1 AS i, count(*) OVER ({part}) AS n FROM {source} WHERE {value} IS NOT NULL) WHERE i = floor((n - 1) * {q} + 0.5)"""


@C.add(_sql(""" SELECT reading_id, "deviceId", period, x2, t4 FROM r"""))
def ts_scan_project(spark, d):
    return readings(spark, d).select("reading_id", "deviceId", "period", "x2", "t4")


@C.add(_sql(""" SELECT reading_id, CAST(epoch(ts) AS BIGINT) AS epoch_s FROM r"""))
def ts_parse_lenient(spark, d):
    return readings(spark, d).select("reading_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch_s"))


@C.add(_sql(" SELECT reading_id, x2 FROM r WHERE x2 IS NULL OR x2 >= 0"))
def ts_nonneg_or_null(spark, d):
    return ts.non_negative(readings(spark, d), "x2").select("reading_id", "x2")


@C.add(_sql(f""", p AS (SELECT * FROM r WHERE x2 IS NULL OR x2 >= 0),
 c AS ({_nearest("(SELECT * FROM p WHERE period = 'train')", '"deviceId"', "x2", 0.995, "cap")})
 SELECT reading_id, CASE WHEN x2 IS NULL OR cap IS NULL THEN x2 ELSE least(x2, cap) END AS x2 FROM p LEFT JOIN c USING ("deviceId")"""))
def ts_winsorize_p995(spark, d):
    kept = ts.non_negative(readings(spark, d), "x2")
    return ts.winsorized(kept, "deviceId", "x2", 0.995, F.col("period") == "train").select("reading_id", "x2")


@C.add(_sql(""" SELECT reading_id, round(t4 - lag(t4) OVER w, 6) AS dt4, round(t8 - lag(t8) OVER w, 6) AS dt8 FROM r
 WINDOW w AS (PARTITION BY "deviceId" ORDER BY ts NULLS FIRST, reading_id)"""))
def ts_delta(spark, d):
    out = ts.differences(readings(spark, d), "deviceId", "ts", "reading_id", ["t4", "t8"])
    return out.select("reading_id", F.round("dt4", 6).alias("dt4"), F.round("dt8", 6).alias("dt8"))


@C.add(_sql(""" SELECT reading_id, lag(x2, 1) OVER w AS x2_lag1, lag(x2, 2) OVER w AS x2_lag2 FROM r
 WINDOW w AS (PARTITION BY "deviceId" ORDER BY ts NULLS FIRST, reading_id)"""))
def ts_lags(spark, d):
    out = ts.lagged(readings(spark, d), "deviceId", "ts", "reading_id", {"x2_lag1": ("x2", 1), "x2_lag2": ("x2", 2)})
    return out.select("reading_id", "x2_lag1", "x2_lag2")


WEATHER = """, p AS (SELECT DISTINCT "deviceId", CAST(round(latitude * 10) AS INTEGER) AS lat10, CAST(round(longitude * 10) AS INTEGER) AS lon10 FROM devices WHERE NOT isnan(latitude) AND NOT isnan(longitude)),
 w AS (SELECT DISTINCT CAST(round(latitude * 10) AS INTEGER) AS lat10, CAST(round(longitude * 10) AS INTEGER) AS lon10, hour, solar_rad FROM weather_cache),
 j AS (SELECT r.*, p.lat10, p.lon10, w.solar_rad FROM r LEFT JOIN p USING ("deviceId") LEFT JOIN w ON p.lat10 = w.lat10 AND p.lon10 = w.lon10 AND date_trunc('hour', r.ts) = w.hour)"""


def _weathered(spark, d):
    places = table(spark, d, "devices").where("not isnan(latitude) and not isnan(longitude)")
    return ts.with_weather(readings(spark, d), places, table(spark, d, "weather_cache"), time="ts")


@C.add(_sql(WEATHER + " SELECT reading_id, lat10, lon10, solar_rad FROM j"))
def ts_weather_join(spark, d):
    return _weathered(spark, d).select("reading_id", "lat10", "lon10", "solar_rad")


@C.add(_sql(""" SELECT reading_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, strftime(ts, '%Y-%m') AS ym, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s FROM r WHERE ts IS NOT NULL"""))
def ts_calendar(spark, d):
    df = ts.calendar(readings(spark, d).where("ts is not null"), "ts")
    return df.select("reading_id", "year", "month", F.date_format("ts", "yyyy-MM").alias("ym"), F.unix_seconds(F.date_trunc("HOUR", "ts").cast("timestamp")).alias("hour_s"))


@C.add(_sql(" SELECT reading_id, round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS month_cos FROM r WHERE ts IS NOT NULL"))
def ts_cyclic(spark, d):
    df = ts.calendar(readings(spark, d).where("ts is not null"), "ts")
    return df.select("reading_id", F.round("month_sin", 6).alias("month_sin"), (F.round("month_cos", 6) + 0.0).alias("month_cos"))


@C.add(_sql(WEATHER + """ SELECT reading_id, round(coalesce(solar_rad, 0) / (max(coalesce(solar_rad, 0)) OVER (PARTITION BY "deviceId", period) + 1e-6::DOUBLE), 6) AS solar FROM j"""))
def ts_solar_scale(spark, d):
    out = ts.scaled_by_max(_weathered(spark, d).select("reading_id", "deviceId", "period", "solar_rad"), "solar_rad", ["deviceId", "period"], "solar")
    return out.select("reading_id", F.round("solar", 6).alias("solar"))


@C.add("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 4""")
def ts_month_split(spark, d):
    hit, _ = ts.split_month(table(spark, d, "orders"), "o_orderdate", 1997, 4)
    return hit.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@C.add("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE NOT (year(o_orderdate) = 1997 AND month(o_orderdate) = 4)""")
def ts_month_complement(spark, d):
    _, rest = ts.split_month(table(spark, d, "orders"), "o_orderdate", 1997, 4)
    return rest.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@C.add(_sql(f""", p AS (SELECT * FROM r WHERE x2 IS NULL OR x2 >= 0),
 c AS ({_nearest("(SELECT * FROM p WHERE period = 'train')", '"deviceId"', "x2", 0.995, "cap")}),
 w AS (SELECT "deviceId", ts, CASE WHEN x2 IS NULL OR cap IS NULL THEN x2 ELSE least(x2, cap) END AS x2 FROM p LEFT JOIN c USING ("deviceId"))
 SELECT "deviceId", CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, round(least(greatest(avg(x2), 0), 1), 6) AS prediction FROM w WHERE x2 IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3"""))
def ts_monthly_mean_clip(spark, d):
    kept = ts.non_negative(readings(spark, d), "x2")
    capped = drop_nulls(ts.winsorized(kept, "deviceId", "x2", 0.995, F.col("period") == "train"), ["x2", "ts"])
    return ts.monthly_means(capped, "deviceId", "ts", "x2").withColumn("prediction", F.round("prediction", 6))


MONTHLY = """SELECT user_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, avg(value / 100) AS prediction FROM events GROUP BY 1, 2, 3"""


def _monthly(spark, d):
    return ts.monthly_means(table(spark, d, "events").withColumn("v", F.col("value") / 100), "user_id", "ts", "v", high=1e9, low=-1e9)


@C.add(f"SELECT user_id, round(median(prediction), 6) AS fallback FROM ({MONTHLY}) GROUP BY 1")
def ts_device_median(spark, d):
    return median(_monthly(spark, d), ["user_id"], "prediction", "fallback").withColumn("fallback", F.round("fallback", 6))


@C.add(f"""WITH m AS ({MONTHLY}), o AS (SELECT user_id, median(prediction) AS own FROM m GROUP BY 1), g AS (SELECT median(prediction) AS every FROM m),
 k AS (SELECT DISTINCT c_custkey AS user_id, CAST(2024 AS INTEGER) AS year, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS month FROM customer)
 SELECT k.user_id, k.year, k.month, round(coalesce(m.prediction, own, every), 6) AS prediction FROM k LEFT JOIN m USING (user_id, year, month) LEFT JOIN o USING (user_id) CROSS JOIN g""")
def ts_grid_fill(spark, d):
    # Many customers have no events, so all fallbacks are met.
    cells = ts.grid(table(spark, d, "customer").withColumnRenamed("c_custkey", "user_id"), "user_id", 2024, [1, 2, 3, 4])
    return ts.grid_filled(cells, _monthly(spark, d), "user_id").withColumn("prediction", F.round("prediction", 6))


HOLDOUT = """WITH c AS (SELECT user_id, avg(value) AS predicted FROM events WHERE ts < TIMESTAMP '2024-01-24' GROUP BY 1),
 h AS (SELECT user_id, avg(value) AS actual FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1), j AS (SELECT actual, predicted FROM h JOIN c USING (user_id))"""


def _holdout(spark, d):
    events = table(spark, d, "events")
    cut = F.lit("2024-01-24").cast("timestamp_ntz")
    context = events.where(F.col("ts") < cut).groupBy("user_id").agg(F.avg("value").alias("predicted"))
    actual = events.where(F.col("ts") >= cut).groupBy("user_id").agg(F.avg("value").alias("actual"))
    return actual.join(context, "user_id")


@C.add(HOLDOUT + " SELECT round(avg(abs(predicted - actual)), 6) AS mae, round(avg(pow(predicted - actual, 2)), 6) AS mse, round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse, round(avg(predicted - actual), 6) AS bias, count(*) AS n FROM j")
def ts_holdout_metrics(spark, d):
    r = ts.error_report(_holdout(spark, d), "actual", "predicted")
    return r.select(*[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse", "bias")], "n")


@C.add(HOLDOUT + ", e AS (SELECT round(abs(predicted - actual), 6) AS err FROM j) " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, err FROM ({_nearest('e', '', 'err', q, 'err')})" for q in (0.25, 0.5, 0.75, 0.95)))
def ts_error_quantiles(spark, d):
    errors = _holdout(spark, d).select(F.round(F.abs(F.col("predicted") - F.col("actual")), 6).alias("err"))
    out = None
    for q in (0.25, 0.5, 0.75, 0.95):
        one = nearest_quantile(errors, [], "err", q, "err").select(F.lit(q).alias("q"), "err")
        out = one if out is None else out.unionByName(one)
    return out


@C.add("SELECT DISTINCT period FROM device_data")
def ts_distinct_periods(spark, d):
    return table(spark, d, "device_data").select("period").distinct()


@C.add("""SELECT count(*) AS n, count(*) - count(x2) AS n_null, count(*) FILTER (isnan(x2)) AS n_nan, round(avg(x2) FILTER (NOT isnan(x2)), 6) AS mean, round(stddev_samp(x2) FILTER (NOT isnan(x2)), 6) AS std,
 min(x2) AS low, max(x2) FILTER (NOT isnan(x2)) AS high FROM device_data""")
def ts_describe(spark, d):
    x, v = F.col("x2"), nan_to_null("x2")
    return table(spark, d, "device_data").agg(
        F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x)).alias("n_nan"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def _featured(spark, d):
    """Readings with differences, calendar and features, rows with all sensors only."""
    df = ts.differences(ts.non_negative(readings(spark, d), "x2"), "deviceId", "ts", "reading_id", ["t4", "t8"])
    df = drop_nulls(ts.calendar(df.where("ts is not null and deviceId is not null"), "ts"), SENSORS)
    return df.withColumn("x", regression.features(df))


@C.add()
def ts_two_stage_predict(spark, d):
    df = _featured(spark, d)
    return regression.predict_monthly(df.where("period = 'train' and x2 is not null"), df.where("period in ('valid', 'test')"), key="deviceId", row="reading_id", target="x2")


@C.add()
def ts_holdout_model(spark, d):
    df = _featured(spark, d).where("period = 'train' and x2 is not null")
    late = F.dayofmonth("ts") >= 4
    return regression.holdout(df.where(~late), df.where(late), key="deviceId", row="reading_id", target="x2")


@C.add()
def ts_seasonal_split(spark, d):
    df = _featured(spark, d).where("period = 'train' and x2 is not null")
    late = F.dayofmonth("ts") >= 4
    return regression.seasonal(df.where(~late), df.where(late), key="deviceId", row="reading_id", target="x2", months=[1], deviation=0.03)

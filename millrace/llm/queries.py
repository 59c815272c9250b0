"""Queries of this subpackage on the test tables, and their SQL for DuckDB."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leaks, lookalikes, packing, percentiles, syntax
from millrace.llm.documented import paired
from millrace.operators.readings import instant, named
from millrace.plans.tables import table

SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.995]
ERROR = 0.01


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return paired(table(spark, d, "entities"), table(spark, d, "source_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("file_id", "name", "line_start")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return syntax.checked(table(spark, d, "source_files"), keep=("repo",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("not valid").select("file_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_judged(spark, d), ["repo", "language"])


def _powers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "device_data").select(named("deviceId").alias("deviceId"), instant("timedate").alias("at"), "x2")
    return rows.select("deviceId", F.floor(F.col("at") / 86_400_000_000).cast("long").alias("day"), "x2")


def p7_device(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of x2 per device."""
    return percentiles.percentiles(percentiles.frequencies(_powers(spark, d), ["deviceId"], "x2"), ["deviceId"], SHARES)


def p7_device_day(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of x2 per device and day (days since 1970)."""
    return percentiles.percentiles(percentiles.frequencies(_powers(spark, d), ["deviceId", "day"], "x2"), ["deviceId", "day"], SHARES)


def p7_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of x2 per device over all days, from the days' frequencies; readings without a usable day are in no day."""
    days = percentiles.frequencies(_powers(spark, d), ["deviceId", "day"], "x2")
    return percentiles.percentiles(percentiles.combined([days], ["deviceId"]), ["deviceId"], SHARES)


def p7_bounded(spark: SparkSession, d: str) -> DataFrame:
    """As p7_device, off by at most one in a hundred, from at most some hundred counts a device."""
    found = percentiles.percentiles(percentiles.frequencies(_powers(spark, d), ["deviceId"], "x2", ERROR), ["deviceId"], SHARES)
    return found.withColumn("value", F.round("value", 9))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p8_filling(spark: SparkSession, d: str) -> DataFrame:
    return packing.filling(p8_packed(spark, d))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("item_id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.pairs(table(spark, d, "documents")).select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p5_found, p5_rates, p7_device, p7_device_day, p7_combined, p7_bounded, p8_packed, p8_filling, p9_found, p9_leaks, p10_found, p10_canonical)
}

_NAME = """CASE WHEN lower(trim(deviceId)) IN ('', '-', '--', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', 'undefined', 'dev-') THEN NULL ELSE trim(deviceId) END"""
_EPOCH_S = r"""CASE WHEN regexp_matches(trim(timedate), '^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?\s*(UTC|GMT|Z|[+-]\d{2}:?\d{2})?$') THEN
  epoch(TRY_CAST(replace(regexp_replace(trim(timedate), '\s*(UTC|GMT|Z|[+-]\d{2}:?\d{2})$', ''), 'T', ' ') AS TIMESTAMP))
  - CASE WHEN regexp_matches(trim(timedate), '[+-]\d{2}:\d{2}$') THEN
      (CASE WHEN regexp_extract(trim(timedate), '([+-])\d{2}:\d{2}$', 1) = '-' THEN -1 ELSE 1 END)
      * (CAST(regexp_extract(trim(timedate), '[+-](\d{2}):\d{2}$', 1) AS BIGINT) * 3600 + CAST(regexp_extract(trim(timedate), '[+-]\d{2}:(\d{2})$', 1) AS BIGINT) * 60)
    ELSE 0 END END"""


def _percentile_sql(by: str, value: str = "x2", more: str = "", digits: str = "value") -> str:
    keys = by.split(", ")
    return f"""
WITH v AS (SELECT {_NAME} AS "deviceId", CAST(floor(({_EPOCH_S}) / 86400) AS BIGINT) AS day, {value} AS value FROM device_data WHERE x2 IS NOT NULL AND NOT isnan(x2)),
     k AS (SELECT * FROM v WHERE {" AND ".join(f"{k} IS NOT NULL" for k in keys)}{more}),
     r AS (SELECT {by}, value, row_number() OVER (PARTITION BY {by} ORDER BY value) AS rn, count(*) OVER (PARTITION BY {by}) AS n_rows FROM k),
     s AS (SELECT unnest([{", ".join(map(str, SHARES))}]::DOUBLE[]) AS share)
SELECT {by}, share, {digits} AS value, n_rows FROM r CROSS JOIN s WHERE rn = greatest(1, CAST(ceil(share * n_rows - 1e-9) AS BIGINT))
"""


# The representative of a value's geometric bucket.
_BASE = math.log1p(2 * ERROR / (1 - ERROR))
_BUCKET = f"CASE WHEN x2 = 0 THEN 0 ELSE sign(x2) * exp(floor(ln(abs(x2)) / {_BASE!r}::DOUBLE) * {_BASE!r}::DOUBLE) * {1 + ERROR}::DOUBLE END"
SQL: dict[str, str] = {
    "p7_device": _percentile_sql("deviceId"),
    "p7_combined": _percentile_sql("deviceId", more=" AND day IS NOT NULL"),
    "p7_device_day": _percentile_sql("deviceId, day"),
    "p7_bounded": _percentile_sql("deviceId", _BUCKET, digits="round(value, 9)"),
}

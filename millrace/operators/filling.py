"""Filling missing values from the same source, batch or time, every filled value marked."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.readings import batch_names, instant, measured, named
from millrace.plans.shards import ROWS_PER_SHARD, along, pack
from millrace.plans.shared import written


def _carried(shards: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """shards with, for each field, the last observation before the shard and the first one after it (at, value).

    A shard's own first and last observation are found by array functions; they are carried over shards without
    any by windows over these summaries, one short row a shard.
    """

    def seen(f: str) -> Column:
        pairs = F.arrays_zip(F.col("at"), F.col(f).alias("v"))
        return F.filter(pairs, lambda p: ~F.isnan(p["v"]))

    ends = shards.select(key, "shard", *[seen(f).alias(f) for f in fields])
    ends = ends.select(key, "shard", *[F.when(F.size(f) > 0, F.struct(F.get(f, F.lit(0)).alias("lo"), F.get(f, F.size(f) - 1).alias("hi"))).alias(f) for f in fields])
    back = along(key).rowsBetween(Window.unboundedPreceding, -1)
    ahead = along(key).rowsBetween(1, Window.unboundedFollowing)
    carried = [F.struct(F.last(F.col(f"{f}.hi"), True).over(back).alias("prev"), F.first(F.col(f"{f}.lo"), True).over(ahead).alias("next")).alias(f"{f}_near") for f in fields]
    return shards.join(ends.select(key, "shard", *carried), [key, "shard"])


def neighbours(at: np.ndarray, v: np.ndarray, near: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Time and value of the last observation up to each place and of the first from it on; NaN where there is none.

    near: {"prev": {"at", "v"} | None, "next": ...}, the observations carried in from other shards. Of several at
    one time the last (looking back) or first (looking ahead) counts.
    """
    ok = np.nonzero(~np.isnan(v))[0]
    t, x = at[ok].astype(float), v[ok]
    prev, nxt = (near or {}).get("prev"), (near or {}).get("next")
    t = np.concatenate([[prev["at"] if prev else np.nan], t, [nxt["at"] if nxt else np.nan]])
    x = np.concatenate([[prev["v"] if prev else np.nan], x, [nxt["v"] if nxt else np.nan]])
    i = np.searchsorted(ok, np.arange(len(v)), "right")
    j = np.searchsorted(ok, np.arange(len(v)), "left") + 1
    return t[i], x[i], t[j], x[j]


def fill_missing(
    df: DataFrame,
    numeric: dict[str, Column | None],
    *,
    categories: tuple[str, ...] = (),
    device: str = "deviceId",
    time: str = "timedate",
    row: str = "reading_id",
    batch: str = "batch_id",
    gap_minutes: float = 180,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """(row, field, value, text, method, distance_s): a row for every value that is missing and can be filled.

    numeric: fields, each with a condition on the rows that shall be filled (None: all rows). Missing means null,
    NaN or an entry that only stands for "no value"; copies of a row are filled alike.

    - device: named by another row of the batch: method ``batch``; distance to the nearest time at which the batch
      names it. A row without device belongs to its batch's device for all that follows.
    - numeric fields: ``interpolated`` in time between the device's observations before and after, ``carried`` from
      the only side that has one, or, for rows without usable time, ``mean`` of the device; distance is that to the
      nearer observation in seconds, null for a mean.
    - categories: ``carried`` from the device's nearest observation within gap_minutes, else not filled.

    Values whose device never reports the field stay missing and give no row; neither does an empty table. Hot
    devices are cut into time shards, hot batches reduced to one row before the join.
    """
    want = [F.coalesce(F.lit(True) if c is None else c, F.lit(False)).alias(f"__want_{f}") for f, c in numeric.items()]
    codes = [F.when(named(c).isNull(), F.lit(None)).otherwise(F.xxhash64(named(c))).alias(f"__code_{c}") for c in categories]
    base = df.select(
        F.col(row).cast("long").alias("rid"),
        F.col(batch).alias("batch"),
        named(device).alias("name"),
        instant(time).alias("at"),
        *[measured(F.col(f).cast("double")).alias(f"__v_{f}") for f in numeric],
        *want,
        *codes,
    )
    spans = base.where("name is not null and batch is not null").groupBy("batch").agg(F.min("name").alias("batch_device"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    nameless = base.where("name is null").join(spans.withColumnRenamed("batch", "__batch"), F.col("batch") == F.col("__batch"), "left").drop("__batch")
    away = F.greatest(F.col("lo") - F.col("at"), F.col("at") - F.col("hi"), F.lit(0)) / 1e6
    devices = nameless.where("batch_device is not null").select(
        F.col("rid").alias(row), F.lit(device).alias("field"), F.lit(None).cast("double").alias("value"), F.col("batch_device").alias("text"), F.lit("batch").alias("method"), F.when(F.col("at").isNotNull() & F.col("lo").isNotNull(), away).alias("distance_s")
    )
    known = base.where("name is not null").unionByName(nameless.withColumn("name", F.col("batch_device")).drop("batch_device", "lo", "hi")).where("name is not null").drop("batch")
    # Range partitioning reads its input twice, so times are parsed and names joined once, before it.
    known = written(known, "filling-readings")

    fields = [f"__v_{f}" for f in numeric]
    cats = [f"__code_{c}" for c in categories]
    timed = known.where("at is not null")
    for f in numeric:
        timed = timed.withColumn(f"__want_{f}", (F.col(f"__want_{f}") & F.col(f"__v_{f}").isNull()).cast("long"))
    # Categories travel as 64-bit codes, shown as doubles' bit patterns would be; 0 stands for missing.
    timed = timed.select("name", "at", "rid", *fields, *[f"__want_{f}" for f in numeric], *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cats])
    shards = written(pack(timed, "name", "at", ["rid"], ["rid", "at", *fields, *[f"__want_{f}" for f in numeric], *cats], rows_per_shard), "filling-shards")
    full = _carried(shards, "name", fields)
    if cats:
        full = _carried_codes(full, "name", cats)
    schema = pa.schema([("rid", pa.int64()), ("field", pa.string()), ("value", pa.float64()), ("code", pa.int64()), ("method", pa.string()), ("distance_s", pa.float64())])

    names = list(numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell = {c: b.column(c)[i] for c in b.schema.names}
                at, rid = cell["at"].values.to_numpy(), cell["rid"].values.to_numpy()
                for f in names:
                    need = np.nonzero(cell[f"__want_{f}"].values.to_numpy())[0]
                    if not len(need):
                        continue
                    t0, x0, t1, x1 = (a[need] for a in neighbours(at, cell[f"__v_{f}"].values.to_numpy(), cell[f"__v_{f}_near"].as_py()))
                    t = at[need].astype(float)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        between = np.where(t1 > t0, x0 + (x1 - x0) * (t - t0) / (t1 - t0), x0)
                    both = ~np.isnan(x0) & ~np.isnan(x1)
                    value = np.where(both, between, np.where(np.isnan(x0), x1, x0))
                    ok = ~np.isnan(value)
                    distance = np.fmin(t - t0, t1 - t) / 1e6
                    if ok.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rid[need][ok]), pa.array([f] * int(ok.sum())), pa.array(value[ok]), pa.nulls(int(ok.sum()), pa.int64()), pa.array(np.where(both, "interpolated", "carried")[ok].tolist()), pa.array(distance[ok])], schema=schema
                        )
                for c in categories:
                    code = cell[f"__code_{c}"].values.to_numpy()
                    need = np.nonzero(code == 0)[0]
                    if not len(need):
                        continue
                    seen = np.nonzero(code)[0]
                    near = cell[f"__code_{c}_near"].as_py()
                    ts = np.concatenate([[near["prev"]["at"] if near["prev"] else np.nan], at[seen].astype(float), [near["next"]["at"] if near["next"] else np.nan]])
                    cs = np.concatenate([[near["prev"]["v"] if near["prev"] else 0], code[seen], [near["next"]["v"] if near["next"] else 0]]).astype(np.int64)
                    k = np.searchsorted(seen, need)
                    t = at[need].astype(float)
                    d0, d1 = t - ts[k], ts[k + 1] - t
                    later = np.isnan(d0) | (d1 < d0)
                    distance = np.where(later, d1, d0) / 1e6
                    ok = distance <= gap_minutes * 60
                    if ok.any():
                        n = int(ok.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(rid[need][ok]), pa.array([c] * n), pa.nulls(n, pa.float64()), pa.array(np.where(later, cs[k + 1], cs[k])[ok]), pa.array(["carried"] * n), pa.array(distance[ok])], schema=schema)

    filled = full.mapInArrow(run, "rid long, field string, value double, code long, method string, distance_s double")
    if cats:
        words = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), named(c).alias("text")) for c in categories])).alias("w")).select("w.*").where("text is not null").distinct()
        filled = filled.join(words.select("field", "text", F.xxhash64("text").alias("code")), ["field", "code"], "left")
    else:
        filled = filled.withColumn("text", F.lit(None).cast("string"))
    filled = filled.select(F.col("rid").alias(row), "field", "value", "text", "method", "distance_s")

    # Rows without usable time: the device's mean. Only these few rows are joined, with one row a device.
    untimed = known.where("at is null").select("rid", "name", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"__want_{f}") & F.col(f"__v_{f}").isNull()).alias("need")) for f in numeric]))).where("need")
    means = known.groupBy("name").agg(*[F.avg(f"__v_{f}").alias(f) for f in numeric]).select(F.col("name").alias("__name"), F.inline(F.array(*[F.struct(F.lit(f).alias("__field"), F.col(f).alias("value")) for f in numeric])))
    level = untimed.join(means, (F.col("name") == F.col("__name")) & (F.col("field") == F.col("__field"))).where("value is not null")
    level = level.select(F.col("rid").alias(row), "field", "value", F.lit(None).cast("string").alias("text"), F.lit("mean").alias("method"), F.lit(None).cast("double").alias("distance_s"))
    return devices.unionByName(filled).unionByName(level)


def _carried_codes(shards: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """As _carried, for long columns in which 0 stands for missing."""
    out = shards
    for c in codes:
        seen = F.filter(F.arrays_zip(F.col("at"), F.col(c).alias("v")), lambda p: p["v"] != 0)
        ends = shards.select(key, "shard", seen.alias("s")).select(key, "shard", F.get("s", F.lit(0)).alias("lo"), F.get("s", F.size("s") - 1).alias("hi"))
        back, ahead = along(key).rowsBetween(Window.unboundedPreceding, -1), along(key).rowsBetween(1, Window.unboundedFollowing)
        near = F.struct(F.last("hi", True).over(back).alias("prev"), F.first("lo", True).over(ahead).alias("next")).alias(f"{c}_near")
        out = out.join(ends.select(key, "shard", near), [key, "shard"])
    return out

"""Irregular readings onto a regular grid, by time shards with carried boundary states."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.filling import _carried
from millrace.operators.readings import instant, measured, named
from millrace.plans.shards import ROWS_PER_SHARD, along, pack
from millrace.plans.shared import written

BLOCK = 65_536  # slots put out at once, so that a long gap needs no memory


def _copies(at: np.ndarray, v: list[np.ndarray]) -> np.ndarray:
    """Which of the ordered readings but the first are copies of the one before."""
    same = np.diff(at) == 0
    for x in v:
        same &= (np.diff(x) == 0) | (np.isnan(x[1:]) & np.isnan(x[:-1]))
    return same


def _parts(shards: DataFrame, values: list[str]) -> DataFrame:
    """(name, first, parts): of each slot in several shards, what all but the last of them have of it, in order: head

    and tail, a part's first and last reading (time, then values), by which copies are known that lie in two parts; n,
    sums and counts (one for each value column) of its readings but the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("name", "first", "shard", "n", "sums", "counts", "head", "tail")}
            for i in range(b.num_rows):
                cell = {c: b.column(c)[i] for c in b.schema.names}
                at, v = cell["at"].values.to_numpy(), [cell[c].values.to_numpy() for c in values]
                keep = np.concatenate([[True], ~_copies(at, v)])
                found = [(y := x[keep][:-1])[~np.isnan(y)] for x in v]
                for c, value in (("n", int(keep.sum()) - 1), ("sums", [float(x.sum()) for x in found]), ("counts", [len(x) for x in found]), ("head", [float(at[0]), *(float(x[0]) for x in v)]), ("tail", [float(at[-1]), *(float(x[-1]) for x in v)])):
                    out[c].append(value)
                for c in ("name", "first", "shard"):
                    out[c].append(cell[c].as_py())
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    many, whole = pa.list_(pa.float64()), pa.int64()
    schema = pa.schema([("name", pa.string()), ("first", whole), ("shard", whole), ("n", whole), ("sums", many), ("counts", pa.list_(whole)), ("head", many), ("tail", many)])
    parts = shards.where("more").select("name", "first", "shard", "at", *values).mapInArrow(run, "name string, first long, shard long, n long, sums array<double>, counts array<long>, head array<double>, tail array<double>")
    return parts.groupBy("name", "first").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "sums", "counts", "head", "tail"))).alias("parts"))


def _before(parts: list[dict], head: list[float]) -> tuple[int, np.ndarray, np.ndarray]:
    """Readings, sums and counts of a slot's parts before the one that begins with head; copies in two parts count in the later."""
    n, sums, counts = 0, np.zeros(len(head) - 1), np.zeros(len(head) - 1, np.int64)
    for part, following in zip(parts, [*(p["head"] for p in parts), head][1:], strict=True):
        n, sums, counts = n + part["n"], sums + part["sums"], counts + part["counts"]
        if not np.array_equal(part["tail"], following, equal_nan=True):
            x = np.array(part["tail"][1:])
            n, sums, counts = n + 1, sums + np.where(np.isnan(x), 0, x), counts + ~np.isnan(x)
    return n, sums, counts


def regular(
    df: DataFrame,
    fields: list[str],
    *,
    device: str = "deviceId",
    time: str = "timedate",
    row: str = "reading_id",
    step_s: int = 300,
    fill_gap_s: int = 3600,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """(device, slot_epoch, n_readings, then for each field f: f, f_state): one row per device and slot.

    The slots (of step_s seconds, starts divisible by it) run from a device's first to its last usable reading: one
    whose row itself names the device and states a full valid date and time; its values may be missing. A slot's value
    is the mean of its readings' values, copies (same time and values) counted once: state ``observed``. Without any it is
    interpolated in time between the last value before and the first value after the slot, from its middle, if these
    are at most fill_gap_s apart: ``interpolated``; else null: ``missing``. Impossible values are kept as they are.

    Method: readings are cut into time shards; each shard's first and last reading are summarised, carried over the
    shards without values by a prefix scan, and then all shards are filled independently; a shard also answers for the
    empty slots up to the next shard's first reading. Of a slot in several shards the last gives the row, from the sums
    and counts of all. Empty input gives no rows.
    """
    slot = F.floor(F.col("at") / F.lit(step_s * 1_000_000)).cast("long")
    usable = df.select(named(device).alias("name"), instant(time).alias("at"), F.col(row).cast("long").alias("rid"), *[measured(F.col(f).cast("double")).alias(f"__v_{f}") for f in fields])
    usable = usable.where("name is not null and at is not null").withColumn("slot", slot)
    # Range partitioning reads its input twice, so times are parsed once, before it.
    usable = written(usable, "grid-readings")
    values = [f"__v_{f}" for f in fields]
    shards = written(pack(usable, "name", "slot", ["at", *values, "rid"], ["at", "slot", *values], rows_per_shard), "grid-shards")
    carried = _carried(shards, "name", values)
    ahead = F.lead("first").over(along("name")).alias("next_slot")
    continued = F.coalesce(F.lag("more").over(along("name")), F.lit(False)).alias("continued")
    edges = shards.select("name", "shard", "first", "more", ahead, continued).where("not more")
    parts = _parts(shards, values)
    edges = edges.join(parts.withColumnRenamed("first", "slot_parted").withColumnRenamed("name", "parted"), F.col("continued") & (F.col("name") == F.col("parted")) & (F.col("first") == F.col("slot_parted")), "left")
    full = carried.join(edges.select("name", "shard", "next_slot", "parts"), ["name", "shard"])
    out = [("name", pa.string()), ("slot_epoch", pa.int64()), ("n_readings", pa.int64())]
    for f in fields:
        out += [(f, pa.float64()), (f"{f}_state", pa.string())]
    schema = pa.schema(out)
    middle = step_s * 500_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = np.array(["missing", "interpolated", "observed"], object)
        for b in batches:
            for i in range(b.num_rows):
                cell = {c: b.column(c)[i] for c in b.schema.names}
                at, slots = cell["at"].values.to_numpy(), cell["slot"].values.to_numpy()
                v = [cell[c].values.to_numpy() for c in values]
                keep = np.concatenate([[True], ~_copies(at, v)])
                first, end = int(slots[0]), cell["next_slot"].as_py()
                end = int(slots[-1]) + 1 if end is None else end
                parts = cell["parts"].as_py()
                n_before, sums, counts = _before(parts or [], [float(at[0]), *(float(x[0]) for x in v)])
                observed = []
                for f, (c, x) in enumerate(zip(values, v, strict=True)):
                    ok = keep & ~np.isnan(x)
                    near = cell[f"{c}_near"].as_py()
                    t = np.concatenate([[near["prev"]["at"] if near["prev"] else np.nan], at[ok].astype(float), [near["next"]["at"] if near["next"] else np.nan]])
                    y = np.concatenate([[near["prev"]["v"] if near["prev"] else np.nan], x[ok], [near["next"]["v"] if near["next"] else np.nan]])
                    own, start = np.unique(slots[ok], return_index=True)
                    mean = np.add.reduceat(x[ok], start) / np.diff(np.append(start, ok.sum())) if len(own) else np.empty(0)
                    if counts[f]:
                        here = x[ok][slots[ok] == first]
                        later = own > first
                        own = np.concatenate([[first], own[later]])
                        mean = np.concatenate([[(sums[f] + here.sum()) / (counts[f] + len(here))], mean[later]])
                    observed.append((own, mean, t, y))
                present, n = np.unique(slots[keep], return_counts=True)
                n[0] += n_before
                for lo in range(first, end, BLOCK):
                    s = np.arange(lo, min(lo + BLOCK, end))
                    count = np.zeros(len(s), np.int64)
                    inside = (present >= s[0]) & (present <= s[-1])
                    count[present[inside] - s[0]] = n[inside]
                    cols = [pa.array([cell["name"].as_py()] * len(s)), pa.array(s * step_s), pa.array(count)]
                    for own, mean, t, y in observed:
                        when = s * (step_s * 1_000_000.0) + middle
                        k = np.searchsorted(t[1:-1], when) + 1
                        with np.errstate(invalid="ignore", divide="ignore"):
                            value = y[k - 1] + (y[k] - y[k - 1]) * (when - t[k - 1]) / (t[k] - t[k - 1])
                            state = (t[k] - t[k - 1] <= fill_gap_s * 1e6).astype(int)
                        inside = (own >= s[0]) & (own <= s[-1])
                        value[own[inside] - s[0]], state[own[inside] - s[0]] = mean[inside], 2
                        cols += [pa.array(np.where(state == 0, np.nan, value), from_pandas=True), pa.array(states[state].tolist(), pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    kinds = "name string, slot_epoch long, n_readings long" + "".join(f", `{f}` double, `{f}_state` string" for f in fields)
    return full.mapInArrow(run, kinds).withColumnRenamed("name", device)

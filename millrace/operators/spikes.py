"""Implausible readings: impossible values, spikes (Hampel filter) and stuck values, per source."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.readings import instant, with_device
from millrace.plans.shards import ROWS_PER_SHARD, along, pack
from millrace.plans.shared import written

HALF = 5  # readings on each side in the rolling median
SIDE = 4  # readings on each side that a spike must leave and return to
LONGEST = 3  # readings in a spike
HALO = HALF + LONGEST + SIDE
BINS_PER_OCTAVE, LOWEST = 8, -40  # of the histograms of a source's own steps and excursions


def rolling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median, and median absolute deviation from it, of the 2 * HALF + 1 readings around each; shorter at the ends."""
    padded = np.concatenate([np.full(HALF, np.nan), x, np.full(HALF, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * HALF + 1)
    inner = slice(HALF, max(HALF, len(x) - HALF))
    med, mad = np.empty(len(x)), np.empty(len(x))
    if len(x) > 2 * HALF:
        w = windows[inner]
        med[inner] = np.partition(w, HALF, axis=1)[:, HALF]
        mad[inner] = np.partition(np.abs(w - med[inner, None]), HALF, axis=1)[:, HALF]
    for i in [*range(min(HALF, len(x))), *range(max(HALF, len(x) - HALF), len(x))]:
        med[i] = np.nanmedian(windows[i])
        mad[i] = np.nanmedian(np.abs(windows[i] - med[i]))
    return med, mad


def excursions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reading, of the spike of 1 to LONGEST readings around it that stands out most: by how much all of

    its readings lie beyond the SIDE readings before and after; and the distance of the levels (medians) before and after.
    """
    n = len(x)
    best, step = np.zeros(n), np.zeros(n)
    if n < 3:
        return best, step
    p = np.concatenate([np.full(SIDE, np.nan), x, np.full(SIDE, np.nan)])
    with np.errstate(invalid="ignore"):
        for size in range(1, min(LONGEST, n - 2) + 1):
            m = n - size + 1
            before = np.stack([p[SIDE - k : SIDE - k + m] for k in range(1, SIDE + 1)])
            after = np.stack([p[SIDE + size - 1 + k : SIDE + size - 1 + k + m] for k in range(1, SIDE + 1)])
            both = np.concatenate([before, after])
            inside = np.stack([x[j : j + m] for j in range(size)])
            up = inside.min(0) - np.fmax.reduce(both, axis=0)
            down = np.fmin.reduce(both, axis=0) - inside.max(0)
            e = np.fmax(up, down)
            # At the very ends there is nothing to return to.
            e[np.isnan(before[0]) | np.isnan(after[0])] = 0
            hit = np.nonzero(e > 0)[0]
            if not len(hit):
                continue
            lb, la = _median(before[:, hit]), _median(after[:, hit])
            for j in range(size):
                at = hit + j
                more = e[hit] > best[at]
                best[at[more]], step[at[more]] = e[hit][more], np.abs(lb - la)[more]
    return best, step


def _median(columns: np.ndarray) -> np.ndarray:
    """Of each column, without NaN; no column is all NaN."""
    ordered = np.sort(columns, axis=0)
    n = (~np.isnan(columns)).sum(0)
    i = np.arange(columns.shape[1])
    return (ordered[(n - 1) // 2, i] + ordered[n // 2, i]) / 2


def _bin(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.log2(x) * BINS_PER_OCTAVE), LOWEST * BINS_PER_OCTAVE).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of one value, and the end."""
    return np.concatenate([[0], np.nonzero(np.diff(x))[0] + 1, [len(x)]]) if len(x) else np.array([0])


def long_form(df: DataFrame, fields: dict[str, tuple[float, float]], device: str, time: str, row: str, batch: str) -> DataFrame:
    """(series, at, rid, v): one row per possible value of a known device at a usable time; series is field|device."""
    known = with_device(df.select(row, device, time, batch, *fields), device, batch)
    known = known.withColumn("at", instant(time)).where("device_known is not null and at is not null").select("device_known", "at", row, *fields)
    # Range partitioning reads its input twice, so times are parsed and names joined once, before it.
    known = written(known, "spikes-readings")
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for f, (lo, hi) in fields.items()])
    flat = known.select("device_known", "at", F.col(row).cast("long").alias("rid"), F.inline(pairs))
    return flat.where("v is not null and not isnan(v) and v between lo and hi").select(F.concat_ws("|", "f", "device_known").alias("series"), "at", "rid", "v")


def impossible(df: DataFrame, fields: dict[str, tuple[float, float]], row: str) -> DataFrame:
    """(row, field, value, reason, score) of the values outside the physical bounds; null and NaN are no values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for f, (lo, hi) in fields.items()])
    return df.select(row, F.inline(pairs)).where("not isnan(value) and (value < lo or value > hi)").select(row, "field", "value", F.lit("impossible").alias("reason"), F.lit(None).cast("double").alias("score"))


def _summaries(shards: DataFrame) -> DataFrame:
    """The shards' edges: up to HALO + 1 readings, the first and last reading, and the run of one value at either end

    (first and last time, readings). Copies of a reading (same time and value) count once, so runs are counted in
    readings, not in rows. A shard whose first reading is a copy of the last of the shard before is ``copied``; that
    reading counts there, so head, tail and n (readings) are without it here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("series", "shard", "n", "begin", "end", "head", "tail", "runs")}
            for series, shard, at, v in zip(*(b.column(c) for c in ("series", "shard", "at", "v")), strict=True):
                t, x = at.values.to_numpy(), v.values.to_numpy()
                keep = _firsts(t, x)
                t, x = t[keep], x[keep]
                starts = _runs(x)
                lo, hi = int(starts[1]), int(starts[-2])
                runs = [(float(x[0]), int(t[0]), int(t[lo - 1]), lo)]
                if hi:
                    runs.append((float(x[-1]), int(t[hi]), int(t[-1]), len(x) - hi))
                for k, value in (("series", series.as_py()), ("shard", shard.as_py()), ("n", len(x)), ("begin", {"at": int(t[0]), "v": float(x[0])}), ("end", {"at": int(t[-1]), "v": float(x[-1])}), ("head", x[: HALO + 1].tolist()), ("tail", x[-HALO - 1 :].tolist()), ("runs", [dict(zip(("value", "t0", "t1", "n"), r, strict=True)) for r in runs])):
                    out[k].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    one = pa.struct([("value", pa.float64()), ("t0", pa.int64()), ("t1", pa.int64()), ("n", pa.int64())])
    reading = pa.struct([("at", pa.int64()), ("v", pa.float64())])
    schema = pa.schema([("series", pa.string()), ("shard", pa.int64()), ("n", pa.int64()), ("begin", reading), ("end", reading), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64())), ("runs", pa.list_(one))])
    found = shards.select("series", "shard", "at", "v").mapInArrow(run, "series string, shard long, n long, begin struct<at:long,v:double>, end struct<at:long,v:double>, head array<double>, tail array<double>, runs array<struct<value:double,t0:long,t1:long,n:long>>")
    found = found.withColumn("copied", F.coalesce(F.lag("end").over(along("series")) == F.col("begin"), F.lit(False)))
    tail = F.when(F.col("copied") & (F.size("tail") == F.col("n")), F.slice("tail", 2, HALO + 1)).otherwise(F.col("tail")).alias("tail")
    head = F.when(F.col("copied"), F.slice("head", 2, HALO + 1)).otherwise(F.col("head")).alias("head")
    # A copied reading is left out of the run that it begins; it is of the run before.
    runs = F.transform("runs", lambda r, i: F.when(F.col("copied") & (i == 0), r.withField("n", r["n"] - 1)).otherwise(r)).alias("runs")
    return found.select("series", "shard", "copied", (F.col("n") - F.col("copied").cast("long")).alias("n"), head, tail, runs)


def _firsts(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of readings that aren't copies: rows are in order of time, value and row."""
    return np.concatenate([[0], np.nonzero((np.diff(t) != 0) | (np.diff(x) != 0))[0] + 1])


def borders(summaries: DataFrame) -> DataFrame:
    """(series, shard, copied, before, after, head_run, tail_run): the neighbours' readings, and the whole runs that

    reach a shard's ends, however many shards they cross: gaps and islands over at most two runs a shard. before and
    after have up to HALO + 1 readings, from several shards where these are short. A copied reading ends before.
    """
    pieces = summaries.select("series", "shard", F.posexplode("runs").alias("end", "run"))
    order = Window.partitionBy("series").orderBy("shard", "end")
    # The two runs at a shard's ends are never one run: another value lies between or the values differ.
    new = (F.col("end") == 1) | F.lag("run.value").over(order).isNull() | (F.lag("run.value").over(order) != F.col("run.value"))
    island = pieces.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(order))
    whole = Window.partitionBy("series", "island")
    total = island.select("series", "shard", "end", F.struct(F.min("run.t0").over(whole).alias("t0"), F.max("run.t1").over(whole).alias("t1"), F.sum("run.n").over(whole).alias("n")).alias("run"))
    runs = total.groupBy("series", "shard").agg(F.min_by("run", "end").alias("head_run"), F.max_by("run", "end").alias("tail_run"))
    # Shards with readings of their own are numbered; the others, all copies, follow the last of these.
    numbered = summaries.select("series", "shard", "copied", "n", "head", "tail", F.sum((F.col("n") > 0).cast("long")).over(along("series").rowsBetween(Window.unboundedPreceding, 0)).alias("place"))
    own = numbered.where("n > 0")
    back = F.flatten(F.collect_list("tail").over(along("series").rowsBetween(-HALO - 1, -1)))
    upto = F.flatten(F.collect_list("tail").over(along("series").rowsBetween(-HALO - 1, 0)))
    ahead = F.flatten(F.collect_list("head").over(along("series").rowsBetween(1, HALO + 1)))
    near = own.select(F.col("series").alias("__series"), F.col("place").alias("__place"), *[F.slice(x, F.greatest(F.size(x) - HALO, F.lit(1)), F.lit(HALO + 1)).alias(c) for c, x in (("back", back), ("upto", upto))], F.slice(ahead, 1, HALO + 1).alias("after"))
    near = numbered.join(near, (F.col("series") == F.col("__series")) & (F.col("place") == F.col("__place")))
    near = near.select("series", "shard", "copied", F.when(F.col("n") > 0, F.col("back")).otherwise(F.col("upto")).alias("before"), "after")
    return near.join(runs, ["series", "shard"])


def _habits(shards: DataFrame) -> DataFrame:
    """(series, noise, jump, usual): the median and the 97th percentile of a source's steps between readings, and the

    excursion that nine in ten stay below. All are read off histograms with eight bins an octave, which add up over
    shards and days. The few largest are left aside, so that spikes of a short series don't define what is usual in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"series": [], "kind": [], "bin": [], "n": []}
            for series, at, v, copied, before, after in zip(*(b.column(c) for c in ("series", "at", "v", "copied", "before", "after")), strict=True):
                x, lo, hi = _extended(at, v, copied, before, after)[:3]
                lo += copied.as_py()  # counted where it is the last reading
                if lo == hi:
                    continue
                steps = np.abs(np.diff(x[: hi + 1]))[max(lo - 1, 0) :]
                for kind, values in (("step", steps), ("excursion", excursions(x)[0][lo:hi])):
                    bins, n = np.unique(_bin(values[values > 0]), return_counts=True)
                    out["series"] += [series.as_py()] * len(bins)
                    out["kind"] += [kind] * len(bins)
                    out["bin"] += bins.tolist()
                    out["n"] += n.tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("series", pa.string()), ("kind", pa.string()), ("bin", pa.int64()), ("n", pa.int64())]))

    bins = shards.select("series", "at", "v", "copied", "before", "after").mapInArrow(run, "series string, kind string, bin long, n long").groupBy("series", "kind", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("series", "kind").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("series", "kind"))
    summed = bins.withColumn("upto", upto).withColumn("total", total)
    size = F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS_PER_OCTAVE)

    def reached(kind: str, rank: str) -> Column:
        return F.min(F.when((F.col("kind") == kind) & F.expr(f"upto >= {rank}"), size))

    return summed.groupBy("series").agg(reached("step", "total * 0.5").alias("noise"), reached("step", "(total - 6) * 0.97").alias("jump"), reached("excursion", "(total - 4) * 0.9").alias("usual"))


def _extended(at, v, copied, before, after) -> tuple[np.ndarray, int, int, np.ndarray, np.ndarray]:
    """The shard's readings without copies between the neighbours' last and first; where its own begin and end; their times; each row's reading."""
    t, x = at.values.to_numpy(), v.values.to_numpy()
    keep = _firsts(t, x)
    of_row = np.zeros(len(t), np.int64)
    of_row[keep[1:]] = 1
    b = before.values.to_numpy() if before.is_valid else np.empty(0)
    b = (b[:-1] if copied.as_py() else b)[-HALO:]
    a = after.values.to_numpy()[:HALO] if after.is_valid else np.empty(0)
    return np.concatenate([b, x[keep], a]), len(b), len(b) + len(keep), t[keep], np.cumsum(of_row)


def implausible(
    df: DataFrame,
    fields: dict[str, tuple[float, float]],
    *,
    device: str = "deviceId",
    time: str = "timedate",
    row: str = "reading_id",
    batch: str = "batch_id",
    idle: dict[str, float] | None = None,
    hampel: float = 3.0,
    noise: float = 4.0,
    jump: float = 2.3,
    usual: float = 3.0,
    mild_jump: float = 1.4,
    rare: float = 6.2,
    back: float = 0.9,
    stuck_readings: int = 12,
    stuck_minutes: float = 90,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """(row, field, value, reason, score): the readings that cannot be right, per source and against its own habits.

    - ``impossible``: outside ``fields[f]``, in any row.
    - ``spike``: 1 to 3 readings in a row beyond ``hampel`` scaled MADs from the rolling median of 11 readings (the
      Hampel filter; where a change of level widens the window's MAD beyond the source's median step, that step counts)
      that lie beyond the four readings before and after, by more than ``noise`` times the median step, and by more than
      ``back`` times the difference of the levels before and after. The excess must be more than ``jump`` times the 97th
      percentile of the source's steps (its switching) and ``usual`` times its common excursions, or more than ``mild_jump``
      and ``rare`` times these; common excursions count as no larger than the switching, as in a calm source spikes
      themselves would be what is common. score is the excess over the median step.
    - ``stuck``: runs of at least ``stuck_readings`` readings over ``stuck_minutes`` with one value, except values up to
      ``idle[f]``; score is the run's length.

    A row without device belongs to its batch's device. Rows of one device with equal time and value are copies:
    they count as one reading and are flagged together. Rows without usable time or device are judged by (a) only.
    Null and NaN are no readings and don't break runs. Columns of the same names as the result's don't matter.
    """
    idle = idle or {}
    series = long_form(df, fields, device, time, row, batch)
    shards = written(pack(series, "series", "at", ["v", "rid"], ["rid", "at", "v"], rows_per_shard), "spikes-shards")
    at_border = written(borders(_summaries(shards)), "spikes-borders")
    keys = ["series", "shard"]
    full = shards.join(at_border, keys)
    full = full.join(_habits(full), "series", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i in range(b.num_rows):
                cell = {c: b.column(c)[i] for c in b.schema.names}
                field = cell["series"].as_py().split("|", 1)[0]
                x, lo, hi, t, of_row = _extended(cell["at"], cell["v"], cell["copied"], cell["before"], cell["after"])
                own = x[lo:hi]
                # Spikes.
                flat = cell["noise"].as_py() or 0.0
                switching = cell["jump"].as_py() or 0.0
                common = min(cell["usual"].as_py() or 0.0, switching)
                med, mad = rolling(x)
                e, step = excursions(x)
                spike = (np.abs(x - med) > hampel * np.minimum(1.4826 * mad, flat)) & (e > noise * flat) & (e > back * step) & (e > 0)
                spike &= ((e > jump * switching) & (e > usual * common)) | ((e > mild_jump * switching) & (e > rare * common))
                spike = spike[lo:hi]
                # Stuck values: runs at the shard's ends have the totals of the whole run.
                starts = _runs(own)
                n, t0, t1 = np.diff(starts), t[starts[:-1]].copy(), t[starts[1:] - 1].copy()
                for k, whole in ((0, cell["head_run"].as_py()), (-1, cell["tail_run"].as_py())):
                    n[k], t0[k], t1[k] = whole["n"], whole["t0"], whole["t1"]
                bad = (n >= stuck_readings) & (t1 - t0 >= stuck_minutes * 60e6) & (own[starts[:-1]] > idle.get(field, -np.inf))
                length = np.repeat(np.where(bad, n, 0), np.diff(starts))
                for reason, hit, score in (("spike", spike, e[lo:hi] / max(flat, 1e-12)), ("stuck", (length > 0) & ~spike, length.astype(float))):
                    rows = np.nonzero(hit[of_row])[0]
                    if len(rows):
                        for k, col in enumerate((cell["rid"].values.to_numpy()[rows], np.full(len(rows), field, object), cell["v"].values.to_numpy()[rows], np.full(len(rows), reason, object), score[of_row[rows]])):
                            out[k].append(col)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["rid", "field", "value", "reason", "score"])

    found = full.mapInArrow(run, "rid long, field string, value double, reason string, score double")
    return impossible(df, fields, row).unionByName(found.withColumnRenamed("rid", row))

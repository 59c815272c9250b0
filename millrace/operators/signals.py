"""Waveform records (record, lead, samples): comparison, validation, zero filling, runs, peaks, tracing of drawn lines."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.plans.ranges import running

# The twelve leads in order, and the layout of a page's rows.
LEADS = ["I", "II", "III", "AVR", "AVL", "AVF", "V1", "V2", "V3", "V4", "V5", "V6"]
LAYOUT = [["I", "AVR", "V1", "V4"], ["II", "AVL", "V2", "V5"], ["III", "AVF", "V3", "V6"]]
ALIASES = {"aVR": "AVR", "aVL": "AVL", "aVF": "AVF"}
SAMPLES = 1_250


def lead_name(name: Column) -> Column:
    return F.coalesce(*[F.when(name == a, F.lit(b)) for a, b in ALIASES.items()], name)


def record_of(key: Column) -> Column:
    """The record in a key like ``record_LEAD``; null without a lead's suffix."""
    found = F.regexp_extract(key, "^(.*)_(" + "|".join(LEADS) + ")$", 1)
    return F.when(key.rlike("^.*_(" + "|".join(LEADS) + ")$"), found)


def lead_of(key: Column) -> Column:
    found = F.regexp_extract(key, "^(.*)_(" + "|".join(LEADS) + ")$", 2)
    return F.when(found != "", found)


def pairs(predicted: DataFrame, truth: DataFrame, segments: DataFrame) -> DataFrame:
    """(record, lead, pred, gt): both sides of each lead; the truth cut to its segment (or the first SAMPLES) and resampled to the prediction's length.

    predicted, truth: record, lead, samples; segments: record, lead, start_sample, end_sample (the first by place counts).
    """
    t = truth.select("record", "lead", F.col("samples").alias("__t"))
    s = segments.groupBy("record", "lead").agg(F.min(F.struct("place", "start_sample", "end_sample")).alias("__s"))
    j = predicted.join(t, ["record", "lead"]).join(s, ["record", "lead"], "left")
    start = F.coalesce("__s.start_sample", F.lit(0))
    end = F.least(F.coalesce("__s.end_sample", F.lit(SAMPLES)), F.size("__t"))
    cut = F.slice("__t", start + 1, F.greatest(end - start, F.lit(0)))
    n = F.size("samples")
    # The length differs from row to row, so the expression for a fixed length doesn't serve.
    at = lambda i: i * F.size("__c") / n.cast("double")
    lo = lambda i: F.least(F.floor(at(i)).cast("int"), F.size("__c") - 1)
    value = lambda i: F.get("__c", lo(i)) + (F.get("__c", F.least(lo(i) + 1, F.size("__c") - 1)) - F.get("__c", lo(i))) * (at(i) - lo(i))
    out = j.withColumn("__c", F.transform(cut, lambda x: x.cast("double"))).where("size(__c) > 0 and size(samples) > 0")
    return out.select("record", "lead", F.col("samples").alias("pred"), F.when(F.size("__c") == n, F.col("__c")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), value)).alias("gt"))


def metrics(pairs_: DataFrame, keys: list[str]) -> DataFrame:
    p, g = F.col("pred"), F.col("gt")
    return pairs_.select(
        *keys, A.mae(p, g).alias("mae"), A.rmse(p, g).alias("rmse"), A.safe_correlation(p, g).alias("corr"), F.array_min("pred").alias("pred_min"), F.array_max("pred").alias("pred_max"), F.array_min("gt").alias("gt_min"), F.array_max("gt").alias("gt_max")
    )


def summary(metrics_: DataFrame) -> DataFrame:
    return metrics_.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("corr").alias("corr"), F.count("*").alias("n"))


def issues(waves: DataFrame, leads: list[str] = LEADS, length: int = SAMPLES, peak: float = 10.0) -> DataFrame:
    """(record, lead, issue): missing leads, unknown leads, wrong length, values that aren't finite, and, as a warning, a high peak."""
    known = F.array(*[F.lit(x) for x in leads])
    have = waves.groupBy("record").agg(F.collect_set("lead").alias("have"))
    missing = have.select("record", F.explode(F.array_except(known, F.col("have"))).alias("lead"), F.lit("missing").alias("issue"))
    bad = F.exists("samples", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    checks = F.array(
        F.when(~F.array_contains(known, F.col("lead")), F.lit("unknown lead")),
        F.when(F.size("samples") != length, F.lit("length")),
        F.when(bad, F.lit("not finite")),
        F.when(F.array_max(F.transform("samples", lambda x: F.abs(x))) > peak, F.lit("peak")),
    )
    own = waves.select("record", "lead", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("issue"))
    return missing.unionByName(own)


def zero_filled(records: DataFrame, waves: DataFrame, leads: list[str] = LEADS, length: int = SAMPLES) -> DataFrame:
    """(record, lead, samples): every lead of every record, zeros where a record has none. An explode, not a cross join."""
    cells = records.select("record").distinct().select("record", F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead"))
    return cells.join(waves.select("record", "lead", "samples"), ["record", "lead"], "left").withColumn("samples", F.coalesce("samples", F.array_repeat(F.lit(0.0).cast("float"), length)))


def train_validation(waves: DataFrame, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Waves split by record: about ``ratio`` of the records (one at least) for validation, in the order of a hash; fewer than two

    records are in both. The order is by running counts over ranges of the hash, so no task ranks all records.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "record"))
    records = waves.where("record is not null").select("record", h.alias("h")).distinct().withColumn("n", F.lit(1))
    ranked = running(records, [], "h", "n", "place", "records")
    held = ranked.where(F.col("place") <= F.greatest(F.lit(1), F.round(F.col("records") * ratio))).select(F.col("record").alias("__record"), "records")
    both = waves.where("record is not null").join(held, F.col("record") == F.col("__record"), "left")
    return both.where("__record is null or records < 2").drop("__record", "records"), both.where("__record is not null").drop("__record", "records")


def scale_of(waves: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, std): over all samples; a deviation under 1e-6 counts as 1."""
    s = waves.select(*by, F.explode("samples").alias("x"))
    out = s.groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-6, F.lit(1.0)).otherwise(F.col("std")))


def active_bands(profile: DataFrame, by: list[str], place: str, value: str, share: float = 0.2, least: int = 1) -> DataFrame:
    """(by, start, end): runs of places whose value is at least ``share`` of the group's largest (and at least 1), ``least`` places long."""
    top = F.max(value).over(Window.partitionBy(*by))
    w = Window.partitionBy(*by).orderBy(place)
    on = profile.withColumn("__on", F.col(value) >= F.greatest(F.lit(1.0), top * share))
    runs = on.withColumn("__run", F.sum((F.col("__on") != F.lag("__on", 1, False).over(w)).cast("int")).over(w)).where("__on")
    return runs.groupBy(*by, "__run").agg(F.min(place).alias("start"), F.max(place).alias("end")).where(F.col("end") - F.col("start") + 1 >= least).drop("__run")


def largest_bands(bands: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n widest bands of each group, of equal ones the first."""
    w = Window.partitionBy(*by).orderBy((F.col("start") - F.col("end")), "start")
    return bands.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def peak_spacing(profile: DataFrame, by: list[str], place: str, value: str, share: float = 0.45, low: int = 4, high: int = 80) -> DataFrame:
    """(by, spacing): the median distance of neighbouring peaks (no smaller than both neighbours and ``share`` of the largest, at least 1) within bounds; 0 without any."""
    w = Window.partitionBy(*by).orderBy(place)
    top = F.max(value).over(Window.partitionBy(*by))
    v = F.col(value)
    marked = profile.withColumn("__p", (v >= F.lag(value).over(w)) & (v >= F.lead(value).over(w)) & (v >= F.greatest(F.lit(1.0), top * share)))
    gaps = marked.where("__p").withColumn("__g", F.col(place) - F.lag(place).over(w))
    found = gaps.where(F.col("__g").between(low, high)).groupBy(*by).agg(F.median("__g").alias("spacing"))
    renamed = found.withColumnsRenamed({c: f"__k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return profile.select(*by).distinct().join(renamed, same, "left").select(*by, F.coalesce("spacing", F.lit(0.0)).alias("spacing"))


def pixels_per_mm(width: int, spacings: list[float], density: float) -> float:
    """A page is 250 mm wide; the grid's own spacing counts where it is dense enough and within a fifth of that."""
    by_width = width / 250.0
    good = [s for s in spacings if s > 0]
    if density < 0.005 or not good:
        return by_width
    own = float(np.median(good))
    return own if 0.8 * by_width < own < 1.2 * by_width else by_width


def trace(mask: np.ndarray, reach: int = 5, cost: float = 0.05) -> np.ndarray:
    """The row of a drawn line in each column: the path of most ink whose steps of up to ``reach`` rows cost ``cost`` a row.

    Of equal paths the smaller step wins, then the one from above. mask: rows by columns, 0 to 255.
    """
    gain = mask.astype(np.float32) / np.float32(255) * 2 - np.float32(0.5)
    h, w = gain.shape
    steps = [0] + [s for j in range(1, reach + 1) for s in (-j, j)]
    came = np.zeros((h, w), np.int32)
    score = gain[:, 0].copy()
    padded = np.full(h + 2 * reach, -np.inf, np.float32)
    for x in range(1, w):
        padded[reach : reach + h] = score
        options = np.stack([padded[reach + s : reach + s + h] - np.float32(abs(s) * cost) for s in steps])
        pick = options.argmax(axis=0)
        came[:, x] = np.arange(h) + np.take(steps, pick)
        score = options[pick, np.arange(h)] + gain[:, x]
    path = np.empty(w, np.int32)
    path[-1] = int(score.argmax())
    for x in range(w - 1, 0, -1):
        path[x - 1] = came[path[x], x]
    return path


def waveform(mask: np.ndarray, ppm: float, samples: int = SAMPLES, smooth: int = 7, limit: float = 6.0) -> np.ndarray:
    """Millivolts of a drawn line: traced, smoothed, about its median, 10 mm a millivolt, clipped, resampled with the last segment going on."""
    h, w = mask.shape
    if not h or not w:
        return np.zeros(samples, np.float32)
    y = trace(mask).astype(float)
    window = min(smooth if smooth % 2 else smooth + 1, w if w % 2 else w - 1)
    if w >= 3 and window >= 3:
        y = np.convolve(y, np.full(window, 1 / window), mode="same")
    mv = np.clip((np.median(y) - y) / max(ppm * 10, 1e-6), -limit, limit)
    if w == 1:
        return np.full(samples, mv[0], np.float32)
    at = np.arange(samples) * w / samples
    lo = np.minimum(at.astype(int), w - 2)
    return (mv[lo] + (mv[lo + 1] - mv[lo]) * (at - lo)).astype(np.float32)


def traced(blocks: DataFrame, keep: list[str], samples: int = SAMPLES) -> DataFrame:
    """keep columns and samples of line drawings (height, width, mask: binary of rows, ppm: pixels a millimetre)."""
    rows = blocks.select(*keep, "height", "width", "mask", "ppm")
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            waves = [waveform(np.frombuffer(m, np.uint8).reshape(int(h), int(w)), float(p), samples) for h, w, m, p in zip(b["height"], b["width"], b["mask"], b["ppm"], strict=True)]
            yield b[keep].assign(samples=[list(map(float, x)) for x in waves])

    return rows.mapInPandas(run, f"{kinds}, samples array<float>")


def _strips(profile: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` places where the smoothed profile reaches a fifth of its largest value (1 at least)."""
    if not len(profile) or profile.max() <= 0:
        return []
    window = max(7, (len(profile) // 50) | 1)
    smooth = np.convolve(profile, np.full(window, 1 / window), mode="same")
    on = smooth >= max(1.0, smooth.max() * 0.2)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def row_bands(mask: np.ndarray, rows: int = 3) -> list[tuple[int, int]]:
    """The page's strips of signal: the ``rows`` widest runs of inked rows, or an even split."""
    profile = mask.sum(axis=1) / 255.0
    runs = _strips(profile, max(8, len(profile) // 50))
    if len(runs) >= rows:
        return sorted(sorted(runs, key=lambda r: r[0] - r[1])[:rows])
    cuts = np.linspace(0, len(profile), rows + 1).astype(int)
    return [(int(a), int(b) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def column_bands(mask: np.ndarray, columns: int = 4) -> list[tuple[int, int]]:
    """A strip's leads: even cuts, each moved to the least inked column (the first of equal ones) within a sixtieth of the width, 5 at least."""
    w = mask.shape[1]
    drawn = mask.sum(axis=0, dtype=np.int64)
    even = np.rint(np.arange(1, columns) * w / columns).astype(int)
    reach = max(5, w // 60)
    moved = [max(0, at - reach) + int(np.argmin(near)) if len(near := drawn[max(0, at - reach) : at + reach + 1]) else at for at in even.tolist()]
    starts, ends = [0, *moved], [*moved, w]
    return [(a, max(a, b - 1)) for a, b in zip(starts, ends, strict=True)]


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels (0: background) of the 8-connected parts of a mask, and their number, by union of runs."""
    h, w = mask.shape
    labels = np.zeros((h, w), np.int32)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (mask[y] > 0).astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            touching = {root(n) for s, e, n in above if s <= b and e >= a}
            if touching:
                n = min(touching)
                for t in touching:
                    parent[t] = n
            else:
                n = len(parent)
                parent.append(n)
            labels[y, a:b] = n
            here.append((a, b, n))
        above = here
    roots = np.array([root(i) for i in range(len(parent))])
    names, out = np.unique(roots[labels], return_inverse=True)
    out = out.reshape(h, w)
    return (out if names[0] == 0 else out + 1).astype(np.int32), len(names) - (names[0] == 0)


def without_small(mask: np.ndarray, least: int = 20) -> np.ndarray:
    """The mask without parts of fewer than ``least`` pixels."""
    labels, n = components(mask)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    return np.where((labels > 0) & (sizes[labels] >= least), mask, 0).astype(mask.dtype)


def boxes(labels: np.ndarray, n: int) -> np.ndarray:
    """(left, top, width, height, pixels) of the parts 1 to n of a labelled mask, one row each."""
    y, x = np.nonzero(labels)
    part = labels[y, x] - 1
    out = np.zeros((n, 5), np.int64)
    out[:, 4] = np.bincount(part, minlength=n)
    for column, size, values in ((0, 2, x), (1, 3, y)):
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(low, part, values)
        np.maximum.at(high, part, values)
        out[:, column], out[:, size] = low, high - low + 1
    return out


def _kept(mask: np.ndarray, labels: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.where(np.concatenate([[False], keep])[labels], 255, 0).astype(np.uint8)


# The shares and sizes in without_text and without_vertical.
def without_text(mask: np.ndarray, area: float = 0.02, width: float = 0.18, height: float = 0.35) -> np.ndarray:
    """The mask without parts like letters: within shares of the page's area, width and height (8 at least), off its left and top edges."""
    h, w = mask.shape
    labels, n = components(mask)
    b = boxes(labels, n)
    small = (b[:, 4] <= max(8, int(h * w * area))) & (b[:, 2] <= max(8, int(w * width))) & (b[:, 3] <= max(8, int(h * height)))
    return _kept(mask, labels, ~(small & (b[:, 0] > 0) & (b[:, 1] > 0)))


def without_vertical(mask: np.ndarray, height: float = 0.45, width: float = 0.06) -> np.ndarray:
    """The mask without tall, narrow parts such as lead separators."""
    h, w = mask.shape
    labels, n = components(mask)
    b = boxes(labels, n)
    return _kept(mask, labels, ~((b[:, 3] >= max(8, round(h * height))) & (b[:, 2] <= max(2, round(w * width)))))


def line_grid(mask: np.ndarray, length: int = 25) -> np.ndarray:
    """The pixels in straight runs of at least ``length``, across or down: an opening by lines."""
    on = mask > 0

    def runs(a: np.ndarray) -> np.ndarray:
        padded = np.pad(a.astype(np.int64), ((0, 0), (1, 1)))
        edge = np.diff(padded, axis=1)
        rows, begins = np.nonzero(edge == 1)
        ends = np.nonzero(edge == -1)[1]
        long = ends - begins >= length
        marks = np.zeros((a.shape[0], a.shape[1] + 1), np.int64)
        np.add.at(marks, (rows[long], begins[long]), 1)
        np.add.at(marks, (rows[long], ends[long]), -1)
        return np.cumsum(marks, axis=1)[:, :-1] > 0

    return np.where(runs(on) | runs(on.T).T, 255, 0).astype(np.uint8)


def crop_box(mask: np.ndarray, grid: np.ndarray | None = None, pad: int = 12, rows: int = 3) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of the signal: as wide as the grid where that spans over half the page, else the whole width;

    as high as what is drawn with ``pad`` rows more, and within that from the first to the ``rows``-th strip where there are as many.
    """
    h, w = mask.shape
    drawn = (mask > 0) | (grid > 0) if grid is not None and grid.shape == mask.shape else mask > 0
    if not drawn.any():
        return 0, 0, w, h
    left, right = 0, w
    if grid is not None and (grid > 0).any():
        x = np.flatnonzero((grid > 0).any(axis=0))
        if x[-1] + 1 - x[0] > w * 0.5:
            left, right = int(x[0]), int(x[-1]) + 1
    y = np.flatnonzero(drawn.any(axis=1))
    top, bottom = max(0, int(y[0]) - pad), min(h, int(y[-1]) + 1 + pad)
    part = mask[top:bottom, left:right]
    strips = _strips(part.sum(axis=1) / 255.0, max(8, part.shape[0] // 40))
    if len(strips) >= rows:
        bottom = top + min(part.shape[0], strips[rows - 1][1] + pad)
        top += max(0, strips[0][0] - pad)
    return left, top, right, bottom


def _cells(mask: np.ndarray) -> Iterator[tuple[str, slice, slice]]:
    for names, (y0, y1) in zip(LAYOUT, row_bands(mask), strict=True):
        for name, (x0, x1) in zip(names, column_bands(mask[y0 : y1 + 1]), strict=True):
            yield name, slice(y0, y1 + 1), slice(x0, x1 + 1)


def split_leads(mask: np.ndarray) -> dict[str, np.ndarray]:
    """The part of a page's mask for each lead of LAYOUT."""
    return {name: mask[y, x] for name, y, x in _cells(mask)}


def split_leads_like(mask: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """The parts of another array of the page where the mask's leads are."""
    return [other[y, x] for _, y, x in _cells(mask)]

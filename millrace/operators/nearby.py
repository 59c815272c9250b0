"""Points near other points or inside regions: trapezoidal decomposition, in slabs of latitude.

A region's boundary is cut into trapezoids between parallels: above each a left and a right edge. Slabs of a fixed
height are spread over the cluster; a point looks for its trapezoids by binary search among the slab's edges, which
are in order. Slabs are cut along the meridians into cells, and full cells into tiles of bounded size.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
TILE = 20_000  # points, or trapezoids, of a cell that meet in one task


def placed(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(id, lat, lon) of the rows with a place, each once: not null, NaN, beyond the poles or the date line, nor 0/0."""
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    good = F.col(key).isNotNull() & ~F.isnan(y) & ~F.isnan(x) & y.between(-90, 90) & x.between(-180, 180) & ~((y == 0) & (x == 0))
    return df.where(good).select(F.col(key).alias("id"), y.alias("lat"), x.alias("lon")).distinct()


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def disc_trapezoids(discs: DataFrame, radius_m: float, bands: int = 6) -> DataFrame:
    """Trapezoids that cover, closely, the discs around (id, lat, lon): region, y0, y1, l0, l1, r0, r1 (and lat, lon).

    A disc is cut at ``bands`` + 1 parallels; in a band its half width in degrees is that at the latitude where the disc
    is widest, so the edges are meridians. A disc over a pole is as wide as the earth; one across the date line is two.
    """
    r = math.degrees(radius_m / EARTH_M)
    d = radius_m / EARTH_M
    edges = [-r + 2 * r * k / bands for k in range(bands + 1)]
    cut = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    rows = discs.select(F.col("id").alias("region"), "lat", "lon", F.inline(cut))
    lat = F.radians("lat")
    # The disc is widest where sin(y) = sin(lat) / cos(d); elsewhere the width falls away from there.
    widest = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(lat) / math.cos(d)))))
    y = F.radians(F.greatest(F.col("lat") + F.col("a"), F.least(F.col("lat") + F.col("b"), widest)))
    cosine = (F.lit(math.cos(d)) - F.sin(lat) * F.sin(y)) / F.greatest(F.cos(lat) * F.cos(y), F.lit(1e-12))
    half = F.when(F.abs("lat") + r >= 90, F.lit(360.0)).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))) * 1.000001 + 1e-9)
    rows = rows.withColumn("half", half).withColumn("y0", F.col("lat") + F.col("a") - 1e-9).withColumn("y1", F.col("lat") + F.col("b") + 1e-9)
    west, east = F.col("lon") - F.col("half"), F.col("lon") + F.col("half")
    whole = F.array(F.struct(F.lit(-180.0).alias("l"), F.lit(180.0).alias("r")))
    parts = (
        F.when(F.col("half") >= 180, whole)
        .when(west < -180, F.array(F.struct((west + 360).alias("l"), F.lit(180.0).alias("r")), F.struct(F.lit(-180.0).alias("l"), east.alias("r"))))
        .when(east > 180, F.array(F.struct(west.alias("l"), F.lit(180.0).alias("r")), F.struct(F.lit(-180.0).alias("l"), (east - 360).alias("r"))))
        .otherwise(F.array(F.struct(west.alias("l"), east.alias("r"))))
    )
    rows = rows.select("region", "lat", "lon", "y0", "y1", F.inline(parts))
    return rows.select("region", "y0", "y1", F.col("l").alias("l0"), F.col("l").alias("l1"), F.col("r").alias("r0"), F.col("r").alias("r1"), "lat", "lon")


def polygon_trapezoids(polygons: DataFrame) -> DataFrame:
    """The trapezoids of polygons (region, ring: array<struct<lon,lat>>; closed or not): between the parallels through

    consecutive vertices, by the even-odd rule over all rings of a region, so a ring within another is a hole. Rings of fewer
    than three points, or with a null, are none. Edges must cross neither the date line nor one another. A region's
    rings meet in one task, as its trapezoids lie between edges of all of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for region, rings in zip(b["region"], b["rings"], strict=True):
                sides, levels = [], set()
                for ring in rings:
                    pts = [(float(x), float(y)) if x is not None and y is not None else (math.nan, math.nan) for x, y in zip(ring["x"], ring["y"], strict=True)]
                    if len(pts) >= 3 and all(c == c for p in pts for c in p):
                        sides += [(p, q) if p[1] < q[1] else (q, p) for p, q in zip(pts, pts[1:] + pts[:1], strict=True) if p[1] != q[1]]
                        levels |= {p[1] for p in pts}
                out += _between(region, sides, sorted(levels))
            yield pd.DataFrame(out, columns=["region", "y0", "y1", "l0", "l1", "r0", "r1"])

    corners = F.struct(F.transform("ring", lambda p: p["lon"].cast("double")).alias("x"), F.transform("ring", lambda p: p["lat"].cast("double")).alias("y"))
    whole = polygons.where("region is not null and ring is not null").groupBy("region").agg(F.collect_list(corners).alias("rings"))
    return whole.mapInPandas(run, "region string, y0 double, y1 double, l0 double, l1 double, r0 double, r1 double")


def _between(region: str, sides: list, levels: list[float]) -> list[tuple]:
    """Level by level, the trapezoids between the first and second, third and fourth side, and so on."""
    out = []
    ahead = sorted(sides, key=lambda e: e[0][1])
    here: list = []
    k = 0
    for y0, y1 in zip(levels[:-1], levels[1:], strict=True):
        here = [e for e in here if e[1][1] >= y1]
        while k < len(ahead) and ahead[k][0][1] <= y0:
            here += [ahead[k]] if ahead[k][1][1] >= y1 else []
            k += 1
        at = [((q[0] - p[0]) / (q[1] - p[1]), p) for p, q in here]
        xs = sorted(((p[0] + m * (y0 - p[1]), p[0] + m * (y1 - p[1])) for m, p in at), key=lambda e: e[0] + e[1])
        out += [(region, y0, y1, a[0], a[1], c[0], c[1]) for a, c in zip(xs[::2], xs[1::2], strict=True)]
    return out


def located(points: DataFrame, trapezoids: DataFrame, slab_deg: float, cell_deg: float) -> DataFrame:
    """(id, region): each point (id, lat, lon) with each region whose trapezoids hold it; a pair may come several times.

    slab_deg, cell_deg: height and width of cells, best a little more than those of a usual trapezoid. A trapezoid goes
    to all cells that it touches, a point to one. Cells with more than TILE points or trapezoids are cut into tiles:
    each point to one, trapezoids to one per share of the points. Within a tile see ``meet``.
    """
    slab = lambda c: F.floor(c / slab_deg).cast("long")
    cell = lambda c: F.floor(c / cell_deg).cast("long")
    p = points.select("id", "lat", "lon", slab(F.col("lat")).alias("slab"), cell(F.col("lon")).alias("cell"))
    t = trapezoids.select("region", "y0", "y1", "l0", "l1", "r0", "r1", F.explode(F.sequence(slab(F.col("y0")), slab(F.col("y1")))).alias("slab"))
    t = t.withColumn("cell", F.explode(F.sequence(cell(F.least("l0", "l1")), cell(F.greatest("r0", "r1")))))
    # Only cells with both, and how many tiles each needs: counts, reduced before they are joined.
    shares = p.groupBy("slab", "cell").agg(F.count("*").alias("np")).join(t.groupBy("slab", "cell").agg(F.count("*").alias("nt")), ["slab", "cell"])
    shares = shares.select("slab", "cell", F.ceil(F.col("np") / TILE).cast("int").alias("kp"), F.ceil(F.col("nt") / TILE).cast("int").alias("kt"))
    p = p.join(shares, ["slab", "cell"]).withColumn("a", F.pmod(F.xxhash64("id"), F.col("kp")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("kt") - 1)))
    t = t.join(shares, ["slab", "cell"]).withColumn("b", F.pmod(F.xxhash64("region", "y0", "l0"), F.col("kt")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("kp") - 1)))
    none = F.lit(None).cast("double")
    rows = t.select("slab", "cell", "a", "b", F.lit(0).alias("kind"), F.col("region").alias("id"), "y0", "y1", "l0", "l1", "r0", "r1").unionByName(
        p.select("slab", "cell", "a", "b", F.lit(1).alias("kind"), "id", F.col("lat").alias("y0"), none.alias("y1"), F.col("lon").alias("l0"), none.alias("l1"), none.alias("r0"), none.alias("r1"))
    )
    rows = rows.repartition("slab", "cell", "a", "b").sortWithinPartitions("slab", "cell", "a", "b", "kind")
    tile = ["slab", "cell", "a", "b"]

    columns = ["kind", "id", "y0", "y1", "l0", "l1", "r0", "r1"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        key = None

        def joined() -> dict[str, np.ndarray]:
            return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in columns}

        for b in batches:
            if b.empty:
                continue
            keys, values = b[tile].to_numpy(), {c: b[c].to_numpy() for c in columns}
            change = (keys[1:] != keys[:-1]).any(axis=1).nonzero()[0] + 1
            found = []
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(b)], strict=True):
                k = tuple(keys[lo].tolist())
                if k != key and held:
                    found.append(_met(joined()))
                    held = []
                key = k
                held.append({c: v[lo:hi] for c, v in values.items()})
            if found:
                yield pd.DataFrame({"id": np.concatenate([f[0] for f in found]), "region": np.concatenate([f[1] for f in found])})
        if held:
            yield pd.DataFrame(dict(zip(("id", "region"), _met(joined()), strict=True)))

    return rows.mapInPandas(run, "id string, region string")


def meet(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, region): the points of a tile (kind 1) with the trapezoids (kind 0) that hold them."""
    return pd.DataFrame(dict(zip(("id", "region"), _met({c: rows[c].to_numpy() for c in rows.columns}), strict=True)))


def _met(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The points of a tile, located among its trapezoids.

    Trapezoids of like height (within a factor of two) are put in sub-slabs of about that height, those of like width
    among them in order of their left edges; a point finds by binary search in its sub-slabs those that begin left of it, no
    further than the widest alike. So a wide or high one among many small ones adds no candidates but itself.
    """
    is_point = rows["kind"] == 1
    names, regions = rows["id"][is_point], rows["id"][~is_point]
    found_p, found_t = [], []
    if len(names) and len(regions):
        y0, y1, l0, l1, r0, r1 = (rows[c][~is_point].astype(float) for c in ("y0", "y1", "l0", "l1", "r0", "r1"))
        left = np.minimum(l0, l1)
        width, height = np.maximum(r0, r1) - left, y1 - y0
        py, px = rows["y0"][is_point].astype(float), rows["l0"][is_point].astype(float)
        base = y0.min()
        # No more than 4,096 sub-slabs, so that places and sub-slabs fit one number.
        least = max((max(y1.max(), py.max()) - base) / 4_096, 1e-9)
        high = np.ceil(np.log2(np.maximum(height, least))).astype(int)
        wide = np.ceil(np.log2(np.maximum(width, 1e-9))).astype(int)
        for h, w in sorted(set(zip(high.tolist(), wide.tolist(), strict=True))):
            own = np.nonzero((high == h) & (wide == w))[0]
            size = 2.0**h
            first, last = np.floor((y0[own] - base) / size), np.floor((y1[own] - base) / size)
            n = (last - first).astype(int) + 1
            t = np.repeat(own, n)
            slab = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # Longitudes, and the width before them, fall short of 1,000.
            place = slab * 1_000 + left[t] + 200
            order = np.argsort(place, kind="stable")
            place, t = place[order], t[order]
            at = np.floor((py - base) / size) * 1_000 + px + 200
            lo, hi = np.searchsorted(place, at - width[own].max() - 1e-6, "left"), np.searchsorted(place, at + 1e-6, "right")
            # A block of points at a time: their candidates are the edges between both searches.
            for s in range(0, len(px), 256):
                n = hi[s : s + 256] - lo[s : s + 256]
                i = np.repeat(np.arange(s, min(s + 256, len(px))), n)
                j = t[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s : s + 256], n)]
                y, x = py[i], px[i]
                share = (y - y0[j]) / np.maximum(y1[j] - y0[j], 1e-300)
                hit = (y >= y0[j]) & (y <= y1[j]) & (x >= l0[j] + share * (l1[j] - l0[j])) & (x <= r0[j] + share * (r1[j] - r0[j]))
                found_p.append(i[hit])
                found_t.append(j[hit])
    i, j = (np.concatenate(a) if a else np.empty(0, int) for a in (found_p, found_t))
    return names[i], regions[j]


def inside(points: DataFrame, polygons: DataFrame, slab_deg: float = 0.1, cell_deg: float = 0.2) -> DataFrame:
    """(id, region): each place (id, lat, lon) with each region (polygons: region, ring) that holds it, each pair once.

    An id with several places has the regions of all. Points on an edge are inside. Empty inputs give no rows.
    """
    return located(points, polygon_trapezoids(polygons), slab_deg, cell_deg).distinct()


def within(points: DataFrame, centres: DataFrame, radius_m: float) -> DataFrame:
    """(id, centre, metres): each place (id, lat, lon) and each centre (id, lat, lon) at most radius_m apart, each pair once.

    Both as ``placed`` gives them; an id may have several places, and the nearest counts. Located through the discs'
    trapezoids, then measured exactly.
    """
    # A place keeps its coordinates in its id, so that an id with several places stays several points.
    place = F.concat_ws("|", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("id"))
    p = points.select(place.alias("id"), "lat", "lon")
    c = centres.select(place.alias("id"), "lat", "lon")
    deg = math.degrees(radius_m / EARTH_M)
    near = located(p, disc_trapezoids(c, radius_m), slab_deg=2 * deg, cell_deg=4 * deg).distinct()
    part = lambda c, k: F.split_part(F.col(c), F.lit("|"), F.lit(k))
    rest = lambda c: F.regexp_replace(F.col(c), r"^[^|]*\|[^|]*\|", "")
    at = [part("id", 1).cast("double"), part("id", 2).cast("double"), part("region", 1).cast("double"), part("region", 2).cast("double")]
    pairs = near.select(rest("id").alias("id"), rest("region").alias("centre"), distance_m(*at).alias("metres")).where(F.col("metres") <= radius_m)
    return pairs.groupBy("id", "centre").agg(F.min("metres").alias("metres"))

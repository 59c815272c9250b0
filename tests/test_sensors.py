"""The operators on readings: against plain versions, across shards, and at the edges."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.filling import fill_missing
from millrace.operators.gridding import regular
from millrace.operators.nearby import EARTH_M, placed, polygon_trapezoids, located, within
from millrace.operators.readings import instant, measured, named
from millrace.operators.spikes import implausible

SCHEMA = "reading_id long, deviceId string, timedate string, period string, x2 double, t4 double, t8 double, batch_id long, deviceType string"
BOUNDS = {"x2": (0.0, 1.0), "t8": (-70.0, 120.0)}
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return (START + dt.timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S UTC")


def frame(spark, rows):
    """rows: dicts; extra columns have names that operators use inside."""
    full = [tuple({"period": "train", **r}.get(c) for c in [f.split(" ")[0] for f in SCHEMA.split(", ")]) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("at", "v", "rid", "name", "series", "value", "field", "first", "device_known", "batch", "slot", "n")})


def flags(df, **how):
    return {(r[0], r[1], r[3]) for r in implausible(df, BOUNDS, idle={"x2": 0.001}, **how).collect()}


def noisy(n=300, seed=1, device="d1", first=1, level=40.0):
    rng = random.Random(seed)
    return [dict(reading_id=first + i, deviceId=device, timedate=at(5 * i), t8=round(level + rng.gauss(0, 0.2), 2), x2=round(0.05 + rng.gauss(0, 0.002), 5), batch_id=first + i // 50) for i in range(n)]


def test_spike_found_and_level_change_kept(spark):
    rows = noisy()
    rows[100]["t8"] += 15
    rows[150]["t8"] -= 12
    rows[151]["t8"] -= 12
    for r in rows[200:]:
        r["t8"] = round(r["t8"] + 9, 2)
    assert flags(frame(spark, rows)) == {(101, "t8", "spike"), (151, "t8", "spike"), (152, "t8", "spike")}


def test_impossible_whatever_the_row(spark):
    rows = [dict(reading_id=1, x2=65535.0, t8=-273.2), dict(reading_id=2, deviceId="d", timedate="n/a", x2=-0.1, t8=float("nan")), dict(reading_id=3, x2=1.0, t8=120.0)]
    assert flags(frame(spark, rows)) == {(1, "x2", "impossible"), (1, "t8", "impossible"), (2, "x2", "impossible")}


def test_stuck_needs_length_and_time_and_not_idle(spark):
    rows = noisy()
    for r in rows[50:80]:
        r["t8"] = 41.5
    for r in rows[100:130]:
        r["x2"] = 0.0003
    for r in rows[200:211]:
        r["t8"] = 41.5
    fast = [dict(reading_id=1000 + i, deviceId="fast", timedate=(START + dt.timedelta(seconds=10 * i)).strftime("%Y-%m-%d %H:%M:%S UTC"), t8=20.0 if i < 50 else 20.0 + i % 7, x2=None, batch_id=9) for i in range(300)]
    got = flags(frame(spark, rows + fast))
    assert {(i, f) for i, f, why in got if why == "stuck"} == {(r, "t8") for r in range(51, 81)}


def test_copies_and_nameless_rows_follow_their_reading(spark):
    rows = noisy()
    rows[100]["t8"] = 90.0
    copy = {**rows[100], "reading_id": 900}
    rows[160].update(t8=5.0, deviceId="unknown")
    got = flags(frame(spark, [*rows, copy]))
    assert {(101, "t8", "spike"), (900, "t8", "spike"), (161, "t8", "spike")} == got


@pytest.mark.parametrize("per_shard", [7, 40, 128])
def test_shards_do_not_matter(spark, per_shard):
    rows = noisy(260, 2) + noisy(90, 3, "d2", 2000, 30.0)
    for i in (20, 77, 78, 199):
        rows[i]["t8"] += 20
    for r in rows[120:190]:
        r["t8"] = 41.11
    df = frame(spark, rows)
    assert flags(df, rows_per_shard=per_shard) == flags(df)


def test_spikes_edges(spark):
    assert flags(frame(spark, [])) == set()
    rows = [dict(reading_id=1), dict(reading_id=None, deviceId=None), dict(reading_id=3, deviceId="d", timedate=at(1), x2=0.5, t8=20.0), dict(reading_id=4, deviceId="d", timedate=at(1), x2=0.5, t8=20.0)]
    assert flags(frame(spark, rows)) == set()


def test_times_and_names(spark):
    cases = {
        "2024-01-01 00:00:05 UTC": 5, "2024-01-01 00:00:05": 5, "2024-01-01T00:00:05Z": 5, "2024-01-01 02:00:05+02:00": 5, "2023-12-31T19:00:05-05:00": 5, " 2024-01-01 00:00:05.000 UTC ": 5,
        "2024-01-01": None, "0000-00-00 00:00:00 UTC": None, "2024-02-30 00:00:00 UTC": None, "2024-13-41 25:61:00 UTC": None, "": None, "n/a": None, None: None,
    }
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", instant("t").alias("us")).collect()
    assert {r.t: r.us for r in got} == {c: None if s is None else (base + s) * 1_000_000 for c, s in cases.items()}
    names = spark.createDataFrame([("dev-1",), ("dev-",), (" ",), ("N/A",), ("unknown",), (None,)], "n string").select(named("n").alias("n")).collect()
    assert [r.n for r in names] == ["dev-1", None, None, None, None, None]
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (-999.0,), (-9999.0,), (None,)], "x double").select(measured("x").alias("x")).collect()
    assert [r.x for r in numbers] == [1.0, None, None, None, None]


def filled(df, **how):
    return {(r.reading_id, r.field): r for r in fill_missing(df, {"x2": F.col("period") == "train", "t4": None}, categories=("deviceType",), **how).collect()}


def test_filling(spark):
    rows = [
        dict(reading_id=1, deviceId="d", timedate=at(0), x2=0.1, t4=30.0, batch_id=1, deviceType="a"),
        dict(reading_id=2, deviceId=None, timedate=at(10), x2=None, t4=-999.0, batch_id=1),
        dict(reading_id=3, deviceId="d", timedate=at(40), x2=0.5, t4=34.0, batch_id=1, deviceType="b"),
        dict(reading_id=4, deviceId="d", timedate=at(70), x2=None, t4=float("nan"), batch_id=1, period="test"),
        dict(reading_id=5, deviceId="d", timedate="--", x2=None, t4=None, batch_id=1),
        dict(reading_id=6, deviceId="other", timedate=at(0), x2=None, t4=None, batch_id=2),
        dict(reading_id=7, deviceId="-", timedate=at(0), x2=None, t4=None, batch_id=3),
        dict(reading_id=8, deviceId="d", timedate=at(10), x2=None, t4=-999.0, batch_id=1),
    ]
    got = filled(frame(spark, rows))
    assert set(got) == {(2, "deviceId"), (2, "x2"), (2, "t4"), (2, "deviceType"), (4, "t4"), (4, "deviceType"), (5, "x2"), (5, "t4"), (8, "x2"), (8, "t4"), (8, "deviceType")}
    assert got[2, "deviceId"].text == "d" and got[2, "deviceId"].method == "batch"
    assert got[2, "x2"].value == pytest.approx(0.2) and got[2, "x2"].method == "interpolated" and got[2, "x2"].distance_s == 600
    assert got[4, "t4"].value == 34.0 and got[4, "t4"].method == "carried" and got[4, "t4"].distance_s == 1800
    assert got[5, "x2"].value == pytest.approx(0.3) and got[5, "x2"].method == "mean" and got[5, "x2"].distance_s is None
    assert got[2, "deviceType"].text == "a" and got[8, "deviceType"].text == "a" and got[4, "deviceType"].text == "b"
    assert got[8, "x2"].value == got[2, "x2"].value


def test_filling_across_shards_and_empty(spark):
    rng = random.Random(5)
    rows = [dict(reading_id=i, deviceId="d" if i % 3 else "e", timedate=at(i), x2=rng.random() if rng.random() < 0.2 else None, t4=float(i) if rng.random() < 0.1 else None, batch_id=i // 9, deviceType="k" if rng.random() < 0.3 else None) for i in range(400)]
    df = frame(spark, rows)
    whole, cut = filled(df), filled(df, rows_per_shard=11)
    assert set(whole) == set(cut)
    for k, r in whole.items():
        assert (r.method, r.text, r.distance_s) == (cut[k].method, cut[k].text, cut[k].distance_s)
        assert r.value is None or r.value == pytest.approx(cut[k].value)
    assert filled(frame(spark, [])) == {}
    assert filled(frame(spark, [dict(reading_id=1), dict(reading_id=2, deviceId="a", timedate=at(0))])) == {}


def grid_by_hand(rows):
    """Slots, their counts and mean x2, copies once."""
    seen, out = {}, {}
    for r in rows:
        if r.get("deviceId") and r.get("timedate") and len(r["timedate"]) > 10:
            t = int((dt.datetime.strptime(r["timedate"], "%Y-%m-%d %H:%M:%S UTC") - dt.datetime(1970, 1, 1)).total_seconds())
            seen.setdefault(r["deviceId"], set()).add((t, r.get("x2"), r.get("t4")))
    for d, readings in seen.items():
        slots = {t // 300 for t, _, _ in readings}
        for s in range(min(slots), max(slots) + 1):
            own = [x for t, x, _ in readings if t // 300 == s]
            known = [x for x in own if x is not None]
            out[d, s * 300] = (len(own), sum(known) / len(known) if known else None)
    return out


@pytest.mark.parametrize("per_shard", [5, 20_000])
def test_grid(spark, per_shard):
    rng = random.Random(7)
    rows = [dict(reading_id=i, deviceId=rng.choice(["a", "b", "a", "a"]), timedate=at(rng.choice([i, i + 40])), x2=round(rng.random(), 3) if rng.random() < 0.7 else None, t4=None) for i in range(0, 900, 4)]
    rows.append({**rows[3], "reading_id": 5000})
    got = regular(frame(spark, rows), ["x2", "t4"], rows_per_shard=per_shard).collect()
    want = grid_by_hand(rows)
    assert {(r.deviceId, r.slot_epoch): r.n_readings for r in got} == {k: n for k, (n, _) in want.items()}
    for r in got:
        n, mean = want[r.deviceId, r.slot_epoch]
        if mean is not None:
            assert r.x2 == pytest.approx(mean) and r.x2_state == "observed"
        else:
            assert r.x2_state in ("interpolated", "missing") and (r.x2 is None) == (r.x2_state == "missing")
        assert r.t4 is None and r.t4_state == "missing"


def test_grid_long_gap_and_edges(spark):
    rows = [dict(reading_id=1, deviceId="a", timedate=at(0), x2=1.0), dict(reading_id=2, deviceId="a", timedate=at(60 * 24 * 400), x2=3.0), dict(reading_id=3, deviceId="", timedate=at(0)), dict(reading_id=4, deviceId="b", timedate="2024-01-01")]
    got = regular(frame(spark, rows), ["x2"])
    assert got.count() == 12 * 24 * 400 + 1
    assert got.where("x2_state = 'missing'").count() == 12 * 24 * 400 - 1
    assert regular(frame(spark, []), ["x2"]).count() == 0


def metres(a, b):
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(min(1, np.sqrt(h)))


def test_within_against_all_pairs(spark):
    rng = random.Random(3)
    centres = [(50, 20), (0.001, -0.001), (10, 179.999), (-10, -179.999), (89.97, 30), (-89.99, 0), (65, 179.95)]
    rows = [(f"p{i}", la + rng.uniform(-0.05, 0.05), ((lo + rng.uniform(-0.08, 0.08) + 180) % 360) - 180) for i, (la, lo) in enumerate(rng.choice(centres) for _ in range(700))]
    rows = [(n, max(-90.0, min(90.0, la)), lo) for n, la, lo in rows]
    rows += [("q1", 90.0, 0.0), ("q2", 90.0, 100.0), ("same", 50.0, 20.0), ("same", 50.0, 20.0), ("same", 50.01, 20.0)]
    df = placed(spark.createDataFrame(rows, "k string, la double, lo double"), "k", "la", "lo")
    for radius in (400.0, 3000.0):
        got = {(r.id, r.centre): r.metres for r in within(df, df, radius).collect()}
        want = {}
        for a in rows:
            for b in rows:
                d = metres(a[1:], b[1:])
                if d <= radius and d < want.get((a[0], b[0]), np.inf):
                    want[a[0], b[0]] = d
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_places_that_are_none(spark):
    rows = [("a", None, 1.0), ("b", 0.0, 0.0), ("c", 91.0, 1.0), ("d", 1.0, -181.0), ("e", float("nan"), 1.0), (None, 1.0, 1.0), ("f", 1.0, 1.0), ("f", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, la double, lo double").withColumn("id", F.lit("clash"))
    assert placed(df, "k", "la", "lo").collect() == [("f", 1.0, 1.0)]
    none = placed(df.limit(0), "k", "la", "lo")
    assert within(none, none, 100).count() == 0


def test_points_in_polygons_and_full_cells(spark, monkeypatch):
    rng = random.Random(9)
    ring = [(0.0, 0.0), (4.0, 0.5), (3.0, 3.0), (2.0, 1.2), (0.5, 3.5)]  # not convex
    polygons = spark.createDataFrame([("r", [{"lon": x, "lat": y} for x, y in ring]), ("bad", [{"lon": 1.0, "lat": 1.0}]), ("none", None)], "region string, ring array<struct<lon:double,lat:double>>")
    points = [(f"p{i}", rng.uniform(-1, 5), rng.uniform(-1, 5)) for i in range(600)]
    df = spark.createDataFrame(points, "id string, lat double, lon double")
    monkeypatch.setattr("millrace.operators.nearby.TILE", 16)
    got = {r.id for r in located(df, polygon_trapezoids(polygons), 1.0, 1.0).distinct().collect()}

    def inside(y, x):
        hit = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                hit = not hit
        return hit

    assert got == {n for n, la, lo in points if inside(la, lo)}


def crowded():
    """Two devices, one of them with far more rows at some times than 8 shards of two rows hold: copies, other values, and none."""
    rows = noisy(60) + noisy(40, seed=2, device="d2", first=5_000)
    rows[20]["t8"], rows[29]["t8"] = 90.0, None
    more = [dict(rows[20]) for _ in range(50)] + [dict(rows[30]) for _ in range(45)] + [dict(rows[30], t8=39.0 + (k % 7) / 8, x2=None) for k in range(40)]
    more += [dict(rows[40], x2=None, t8=None) for _ in range(35)] + [dict(rows[29]) for _ in range(20)] + [dict(rows[50], x2=0.06, t8=41.0 + k / 64) for k in range(37)]
    return rows + [dict(r, reading_id=10_000 + k) for k, r in enumerate(more)]


@pytest.mark.parametrize("per_shard", [1, 2, 5])
def test_many_rows_of_one_time_in_several_shards(spark, per_shard):
    rows = crowded()
    df = frame(spark, rows)
    cut, whole = ([tuple(r) for r in implausible(df, BOUNDS, idle={"x2": 0.001}, stuck_readings=2, stuck_minutes=0, rows_per_shard=n).collect()] for n in (per_shard, 20_000))
    assert sorted((r[:4] for r in cut), key=str) == sorted((r[:4] for r in whole), key=str) and sum(r[0] > 9_999 for r in whole) > 50
    assert len({(r[0], r[1], r[3]) for r in cut}) == len(cut)

    cut, whole = (sorted((tuple(r) for r in fill_missing(df, {"x2": None, "t8": None}, categories=("deviceType",), rows_per_shard=n).collect()), key=str) for n in (per_shard, 20_000))
    assert cut == whole and len({r[:2] for r in cut}) == len(cut) > 100

    got = {n: {(r.deviceId, r.slot_epoch): r for r in regular(df, ["x2", "t8"], rows_per_shard=n).collect()} for n in (per_shard, 20_000)}
    assert regular(df, ["x2", "t8"], rows_per_shard=per_shard).count() == len(got[per_shard])
    assert set(got[per_shard]) == set(got[20_000])
    for k, b in got[20_000].items():
        a = got[per_shard][k]
        assert (a.n_readings, a.x2_state, a.t8_state) == (b.n_readings, b.x2_state, b.t8_state)
        assert (a.x2, a.t8) == (pytest.approx(b.x2, rel=1e-12), pytest.approx(b.t8, rel=1e-12))
    assert max(r.n_readings for r in got[20_000].values()) == 38

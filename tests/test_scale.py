"""Operators at hot keys, many rows of one kind, and at the borders of what is split."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import assembly, classification, codegraph, pages, regression, retrieval, signals
from millrace.operators import timeseries as ts
from millrace.operators.nearby import inside, meet
from millrace.operators.quantiles import median, nearest_quantile
from millrace.plans import shared
from millrace.plans.ranges import running
from millrace.sources import python_code, readers, writers


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, float(v), rng.randint(1, 5)) for k in ("a", "b", None) for v in {rng.randint(0, 2000) for _ in range(900)}] + [("a", None, 7)]
    got = running(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", "n").collect()
    for key in ("a", "b", None):
        own = sorted(((v if v is not None else -math.inf, n) for k, v, n in rows if k == key))
        sums = np.cumsum([n for _, n in own]).tolist()
        assert sorted((r.v if r.v is not None else -math.inf, r.upto) for r in got if r.k == key) == [(v, s) for (v, _), s in zip(own, sums, strict=True)]
        assert {r.total for r in got if r.k == key} == {sums[-1]}
    assert running(spark.createDataFrame([], "v double, n long"), [], "v", "n").count() == 0


def test_quantile_of_all_rows(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    q = nearest_quantile(df, [], "x", 0.95, "v")
    assert q.first().v == sorted(values)[math.floor(19_999 * 0.95 + 0.5)]
    assert median(df, [], "x", "v").first().v == pytest.approx(float(np.median(values)))


def test_seeded_samples_are_those_of_a_full_sort(spark):
    import hashlib

    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "i long, k string")
    h = lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()
    assert {r.i for r in retrieval.seeded_sample(df, "i", 25).collect()} == set(sorted(range(3_000), key=h)[:25])
    got = retrieval.seeded_sample(df, "i", 4, by=["k"]).collect()
    for k in {k for _, k in rows}:
        assert {r.i for r in got if r.k == k} == set(sorted((i for i, x in rows if x == k), key=h)[:4])
    assert retrieval.seeded_sample(df.limit(0), "i", 4).count() == 0


def test_lags_of_rows_without_time(spark):
    rows = [(i, "a", None if i % 4 else f"2024-01-{1 + i % 9:02d} 00:00:00", float(i)) for i in range(0, 60_000, 7)]
    df = spark.createDataFrame(rows, "i long, k string, t string, x double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.i: r.p for r in ts.lagged(df, "k", "t", "i", {"p": ("x", 2)}).select("i", "p").collect()}
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0]))
    assert got == {r[0]: (order[n - 2][3] if n >= 2 else None) for n, r in enumerate(order)}


def test_names_of_many_calls_and_definitions(spark):
    index = spark.range(5_000).select(F.format_string("f%05d:x:1", "id").alias("id"), F.format_string("f%05d", "id").alias("file_path"), F.lit("x").alias("name"))
    wanted = spark.range(5_000).select(F.format_string("c%05d", "id").alias("src"), F.when(F.col("id") % 2 == 0, F.format_string("f%05d", "id")).otherwise("other").alias("file"), F.lit("x").alias("dep"))
    found = codegraph.resolved(wanted, index, "dep", "file", ["src", "dep"])
    got = {r.src: r.target for r in found.collect()}
    assert len(got) == 5_000 and got["c00004"] == "f00004:x:1" and got["c00005"] == "f00000:x:1"
    # Every input row is in at most one row of any join.
    paths = wanted.limit(30).withColumn("path", F.lit("f0000"))
    by_path = codegraph.resolved_by_path(paths, index, "dep", "path", ["src"], most=100)
    assert {r.target for r in by_path.collect()} == {"f00000:x:1"} and by_path.count() == 30
    none = codegraph.resolved_by_path(wanted.withColumn("path", F.lit("nowhere")), index, "dep", "path", ["src"]).select("target").distinct().collect()
    assert none == [("f00000:x:1",)]


def test_import_edges_by_whole_parts(spark):
    kind = "file_path string, name string, type string, line_start int, line_end int, parent string, dependencies array<string>"
    rows = [(p, "f", "function", 1, 2, None, []) for p in ("a/b/c.py", "x/b/c/__init__.py", "a/ab/c.py", "main.py")]
    imports = spark.createDataFrame([("main.py", "b.c"), ("main.py", ""), ("main.py", None), ("main.py", "nothing")], "file_path string, module string")
    e = codegraph.edges(spark.createDataFrame(rows, kind), imports).where("relation = 'IMPORTS'")
    assert {(r.src, r.dst) for r in e.collect()} == {("main.py:module", "a/b/c.py:module"), ("main.py:module", "x/b/c/__init__.py:module")}


def test_ridge_from_sums_equals_ridge_on_rows(spark):
    rng = np.random.RandomState(3)
    x = rng.normal(20, 3, (500, 4)).astype(np.float32).astype(float)
    x[:, 3] = 7.5
    y = x @ [0.2, -0.1, 0.05, 0] + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(i, "ab"[i % 2], list(map(float, x[i])), float(y[i])) for i in range(500)], "i long, k string, x array<double>, y double")
    for r in regression.sums(df, ["k"], 4, "x", "y").collect():
        own = np.arange(500) % 2 == "ab".index(r.k)
        m = regression.Sums(r.n, np.array(r.sums), np.array(r.products)).ridge(0.1)
        s = np.where(x[own].std(0) < 1e-9, 1, x[own].std(0))
        z = (x[own] - x[own].mean(0)) / s
        w = np.linalg.solve(z.T @ z + 0.1 * np.eye(4), z.T @ (y[own] - y[own].mean()))
        assert np.allclose(m["w"], w, atol=1e-6) and np.allclose(m["s"], s) and abs(m["b"] - y[own].mean()) < 1e-9
    assert regression._overall(regression.sums(df.limit(0), [], 4, "x", "y"), 4).n == 0


def test_training_and_validation_by_record(spark):
    w = spark.range(400).select(F.concat(F.lit("r"), (F.col("id") / 2).cast("int").cast("string")).alias("record"), F.lit("I").alias("lead"))
    train, held = signals.train_validation(w, 0.25)
    a, b = {r.record for r in train.collect()}, {r.record for r in held.collect()}
    assert not a & b and len(a) == 150 and len(b) == 50
    one = w.where("record = 'r1'")
    assert [x.count() for x in signals.train_validation(one, 0.25)] == [2, 2]
    assert [x.select("record").distinct().count() for x in signals.train_validation(w.where("record in ('r1', 'r2')"), 0.0)] == [1, 1]
    assert [x.count() for x in signals.train_validation(w.limit(0), 0.25)] == [0, 0]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        shared.folder(Session())
    assert shared.folder(spark)


def test_scratch_tables_go_with_their_block(spark):
    with shared.scratch(spark):
        df = shared.written(spark.range(5), "scratch")
        path = df.inputFiles()[0]
        assert df.count() == 5 and readers.exists(spark, path)
    assert not readers.exists(spark, path)
    assert shared.written(spark.range(3), "scratch").count() == 3


def test_entities_of_broken_python(spark):
    code = "import os\n\ndef good(a: int) -> int:\n    '''Doc.'''\n    return len(a)\n\nclass K(Base):\n    def m(self):\n        return g(\n            1)\n\n    def broken(self:\n        pass\n\ndef cut(x,\n"
    got = [(e["name"], e["type"], e["line_start"], e["line_end"], e["parent"], e["docstring"], e["dependencies"]) for e in python_code.tolerant_entities_of(code)]
    assert got == [("good", "function", 3, 5, None, "Doc.", ["len"]), ("K", "class", 7, 13, None, None, []), ("m", "method", 8, 10, "K", None, ["g"]), ("broken", "method", 12, 13, "K", None, []), ("cut", "function", 15, 15, None, None, [])]
    assert python_code.tolerant_entities_of(None) == [] and python_code.tolerant_entities_of("") == [] and python_code.tolerant_entities_of("<<<<<<< x") == []
    sound = "class A:\n    def f(self):\n        pass\n"
    assert python_code.tolerant_entities_of(sound) == python_code.entities_of(sound)
    files = spark.createDataFrame([("a.py", code)], "path string, content string")
    assert python_code.entities(files, ["path"]).count() == 0 and python_code.entities(files, ["path"], tolerant=True).count() == 5


def test_identifiers_of_code(spark):
    got = spark.createDataFrame([("x1 = Foo(bar) # note\nFOO('text', self.x1, len(Bar), ä2)",), ("",), (None,)], "c string").select(T.code_identifiers(F.col("c")).alias("i")).collect()
    assert got[0].i == ["x1", "Foo", "bar", "ä2"] and got[1].i == [] and got[2].i is None


def test_lines_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"repo": "r{k}"}}' if k % 9 else "" for k in range(4_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"repo": "z"}\r\n\r\n{"repo": "y", "id": "i"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.json_lines(spark, str(tmp_path / "*.jsonl")).select("id", "line_num", "repo").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(f"task_{k}", k, f"r{k}") for k in range(4_000) if k % 9} | {("task_0", 0, "z"), ("i", 2, "y")}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_binaries_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/b.bin", bytearray(b"\0\1")), ("c", bytearray(b"")), (None, bytearray(b"x")), ("d", None)], "name string, content binary")
    writers.binaries(df, f"file://{tmp_path}/out")
    assert (tmp_path / "out/a/b.bin").read_bytes() == b"\0\1" and (tmp_path / "out/c").read_bytes() == b"" and not (tmp_path / "out/d").exists()


def test_reports(spark):
    tasks = spark.createDataFrame([(1, "a", "p"), (2, "a", "q"), (3, "b", "p"), (4, "a", "p"), (5, None, "p")], "task long, repo string, path string")
    got = assembly.task_report(tasks, spark.createDataFrame([("a",), ("a",)], "repo string"), spark.createDataFrame([("a", "p")], "repo string, path string"), spark.createDataFrame([(1, "x"), (4, ""), (1, "y")], "task long, context string"))
    assert {tuple(r) for r in got.collect()} == {("a", 3, 1, 0, 1, 1), ("b", 1, 0, 1, 0, 0), (None, 1, 0, 1, 0, 0)}
    assert tuple(assembly.cache_statistics(spark.createDataFrame([("k", "ab"), ("k", "abc"), (None, "x")], "key string, abstract string"), 0.5).first()) == (1, 3, 0.5)
    assert tuple(assembly.cache_statistics(spark.createDataFrame([], "key string, abstract string"), 0.5).first()) == (0, 0, 0.0)


def test_folds_see_no_model_of_their_own(spark, tmp_path):
    rng = np.random.RandomState(5)
    rows = [(i, float(v), float(rng.rand()), int(v > 0.6), 0) for i, v in enumerate(rng.rand(300))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "item long, a double, b double, yes int, never int"))
    held, tested = classification.boosted_folds(df, df.limit(20), ["yes", "never"], item="item", folds=2, trees=5, depth=2)
    got = held.toPandas()
    assert len(got) == 600 and tested.count() == 40 and (got[got.cls == "never"].p == 0).all()
    own = got[got.cls == "yes"]
    assert ((own.p > 0.5) == (own.y == 1)).mean() > 0.95
    model = GBTClassifier(labelCol="yes", maxIter=1, maxDepth=1).fit(df)
    classification.save(model, f"file://{tmp_path}/m")
    assert isinstance(classification.load(f"file://{tmp_path}/m"), GBTClassificationModel)


def test_trees_are_fitted_on_counts_of_like_rows(spark, monkeypatch):
    """5,000 rows of nine combinations: a model sees a row a combination, label and fold, with all their weight; rare values stay apart."""
    rng = np.random.RandomState(7)
    rows = [(i, float(a), float(b), int(a == 2 or rng.rand() < 0.1)) for i, (a, b) in enumerate(zip(rng.choice([0, 1, 2], 5_000, p=[0.6, 0.397, 0.003]), rng.randint(0, 3, 5_000), strict=True))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "item long, a double, b double, yes int"))
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: seen.append(data.agg(F.count("*"), F.sum(F.when(F.col("__y") == 0, F.col("__w")))).first()) or fit(self, data))
    held, tested = classification.boosted_folds(df, df, ["yes"], item="item", folds=2, trees=5, depth=2)
    assert len(seen) == 2 and all(n <= 9 * 2 * 2 and w == sum(y == 0 for *_, y in rows) for n, w in seen)
    p = {r.item: r.p for r in held.collect()}
    assert len(p) == tested.count() == 5_000 and min(p[i] for i, a, _, _ in rows if a == 2) > max(p[i] for i, a, _, _ in rows if a != 2)


def test_cut_points(spark):
    x = np.stack([np.arange(1_000) % 4, np.arange(1_000)], axis=1).astype(float)
    few, many = classification.cut_points(spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(3))
    assert few.tolist() == [0.5, 1.5, 2.5] and len(many) == 31 and np.bincount(np.searchsorted(many, x[:, 1], side="left")).max() < 40


def test_labels_from_one_scan(spark):
    """Probabilities are read once, however many classes are above, and no items are joined."""
    held = spark.createDataFrame([(i, "c", int(i > 5), i / 10) for i in range(10)], "item long, cls string, y int, p double")
    tested = spark.range(50).select(F.col("id").alias("item"), F.lit("c").alias("cls"), (F.col("id") / 50).alias("p"))
    labels = classification.agreeing_labels(held, tested, spark.createDataFrame([("c", "d"), ("d", "e"), ("c", "e")], "child string, parent string"))
    assert labels._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 50") == 1
    assert {(r.item, r.cls): (r.p, r.label) for r in labels.collect()} == {(i, c): (i / 50, int(i / 50 >= (0.51 if c == "c" else 0.5))) for i in range(50) for c in "cde"}


def test_labels_agree_with_the_hierarchy(spark):
    held = spark.createDataFrame([(i, "child", int(i > 5), i / 10) for i in range(10)], "item long, cls string, y int, p double")
    tested = spark.createDataFrame([(1, "child", 0.9), (1, "parent", 0.1), (2, "child", 0.1), (2, "parent", 0.3)], "item long, cls string, p double")
    edges = spark.createDataFrame([("child", "parent"), ("parent", "top")], "child string, parent string")
    got = {(r.item, r.cls): (r.p, r.label) for r in classification.agreeing_labels(held, tested, edges).collect()}
    assert got == {(1, "child"): (0.9, 1), (1, "parent"): (0.9, 1), (1, "top"): (0.9, 1), (2, "child"): (0.1, 0), (2, "parent"): (0.3, 0), (2, "top"): (0.3, 0)}


def test_pages_come_back_as_waves(spark):
    x = np.linspace(0, 4 * np.pi, 240)
    page = np.full((390, 1000, 3), 255, np.uint8)
    for j in range(3):
        page[j::25, :] = page[:, j::25] = (255, 190, 190)
    for k in range(12):
        rows = np.rint(130 * (k // 4) + 65 - 30 * np.sin(x + k)).astype(int)
        for c, (a, e) in enumerate(zip(rows, [*rows[1:], rows[-1]], strict=True)):
            page[min(a, e) - 2 : max(a, e) + 3, 250 * (k % 4) + 5 + c] = 0
    content = b"P6\n# made here\n1000 390\n255\n" + page.tobytes()
    assert (pages.bitmap(content) == page).all()
    got = {r.lead: np.array(r.samples) for r in pages.digitised(spark.createDataFrame([("r", bytearray(content)), ("n", None)], "record string, content binary"), samples=240).collect()}
    assert set(got) == {n for row in signals.LAYOUT for n in row}
    for k, name in enumerate(n for row in signals.LAYOUT for n in row):
        assert np.corrcoef(got[name], np.sin(x + k))[0, 1] > 0.9, name
    assert all((w == 0).all() for w in pages.leads(np.zeros((0, 0), np.uint8)).values())
    for bad in (b"", b"P5", b"P4 1 1 1\n\0", b"GIF89a", b"P5 2 2 999\n\0\0\0\0"):
        with pytest.raises(ValueError):
            pages.bitmap(bad)


def test_regions_with_holes(spark):
    ring = lambda *pts: [dict(lon=float(x), lat=float(y)) for x, y in pts]
    rows = [("a", ring((0, 0), (10, 0), (10, 10), (0, 10))), ("a", ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))), ("b", ring((20, 0), (30, 5), (20, 10))), ("c", ring((0, 0), (1, 1))), ("d", None), (None, ring((0, 0), (1, 0), (0, 1)))]
    polygons = spark.createDataFrame(rows, "region string, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([("in", 1.0, 1.0), ("hole", 5.0, 5.0), ("tip", 5.0, 29.0), ("out", 5.0, 31.0), ("above", 9.0, 25.0)], "id string, lat double, lon double")
    assert {tuple(r) for r in inside(points, polygons, 1.0, 1.0).collect()} == {("in", "a"), ("tip", "b")}
    assert inside(points, polygons.limit(0)).count() == 0 and inside(points.limit(0), polygons).count() == 0


def test_a_wide_region_among_small_ones():
    import pandas as pd

    rng = np.random.RandomState(6)
    n = 3_000
    x, y, s = rng.uniform(0, 10, n), rng.uniform(0, 10, n), rng.uniform(0.001, 0.01, n)
    s[0], x[0], y[0] = 10, 0, 0
    traps = pd.DataFrame(dict(kind=0, id=[f"t{i}" for i in range(n)], y0=y, y1=y + s, l0=x, l1=x, r0=x + s, r1=x + s))
    px, py = rng.uniform(-1, 11, 2_000), rng.uniform(-1, 11, 2_000)
    px[:500], py[:500] = x[:500] + s[:500] / 2, y[:500] + s[:500]
    points = pd.DataFrame(dict(kind=1, id=[f"p{i}" for i in range(2_000)], y0=py, y1=np.nan, l0=px, l1=np.nan, r0=np.nan, r1=np.nan))
    got = set(meet(pd.concat([traps, points], ignore_index=True)).itertuples(index=False, name=None))
    want = {(f"p{i}", f"t{j}") for i in range(2_000) for j in np.nonzero((y <= py[i]) & (py[i] <= y + s) & (x <= px[i]) & (px[i] <= x + s))[0]}
    assert got == want and len(want) > 1_000

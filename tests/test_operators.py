"""The reference's own operators against plain Python, at small sizes and at the edges."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.functions.nulls import clip, drop_nulls, fill_null, finite, nan_to_null
from millrace.operators import adapters, assembly, codegraph, multilabel, ontology, regression, retrieval, signals, style
from millrace.operators import timeseries as ts
from millrace.operators.quantiles import nearest_quantile

NAN = float("nan")


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def one(spark, expression, **cells):
    names = ", ".join(f"{k} {kind}" for k, (_, kind) in cells.items())
    return spark.createDataFrame([tuple(v for v, _ in cells.values())], names).select(expression.alias("r")).first().r


def test_null_and_nan_stay_apart(spark):
    df = column(spark, [1.0, None, NAN, math.inf])
    assert drop_nulls(df, ["x"]).count() == 3
    got = df.orderBy("i").select(fill_null("x", 0.0).alias("a"), clip("x", 0, 2).alias("b"), finite("x").alias("c"), nan_to_null("x").alias("d")).collect()
    assert [r.b for r in got] == [1.0, None, 2.0, 2.0] and got[1].a == 0.0 and math.isnan(got[2].a)
    assert got[2].c == 0.0 and got[3].c > 1e308 and got[1].c is None and got[2].d is None


def test_no_merging_null_helpers_in_code():
    import pathlib

    for p in pathlib.Path("millrace").rglob("*.py"):
        text = p.read_text()
        assert ".na.drop(" not in text and (".na.fill(" not in text or p.name == "multilabel.py"), p


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.995, 1.0])
def test_nearest_quantile(spark, q):
    rng = random.Random(4)
    rows = [("big", round(rng.gauss(0, 1), 2)) for _ in range(4000)] + [("small", float(i)) for i in range(7)] + [("one", 5.0), ("none", None), (None, 2.0), (None, None)]
    got = {r.k: r.v for r in nearest_quantile(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", q, "v").collect()}
    for k in ("big", "small", "one", None):
        values = sorted(v for a, v in rows if a == k and v is not None)
        assert got[k] == values[math.floor((len(values) - 1) * q + 0.5)]
    assert got["none"] is None
    assert nearest_quantile(spark.createDataFrame([], "x double"), [], "x", q, "v").collect() == [(None,)]


def test_lags_over_buckets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), None if rng.random() < 0.05 else f"2024-01-{rng.randint(1, 20):02d} 0{rng.randint(0, 9)}:00:00", rng.choice([None, float(i)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.id: (r.l1, r.l2, r.l3) for r in ts.lagged(df, "k", "t", "id", {"l1": ("v", 1), "l2": ("v", 2), "l3": ("v", 3)}).collect()}
    for k in "ab":
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or "", r[0]))
        for n, r in enumerate(own):
            assert got[r[0]] == tuple(own[n - j][3] if n >= j else None for j in (1, 2, 3))


def test_time_text(spark):
    df = spark.createDataFrame([("2025-04-01 12:00:00 UTC",), ("2025-04-01 12:00:00",), ("2025-04-01",), ("x",), (None,)], "t string")
    assert [r.t is None for r in df.select(ts.utc_time("t").alias("t")).collect()] == [False, False, True, True, True]


def test_closure_levels_and_consistency(spark):
    rng = random.Random(2)
    edges = {(c, rng.randrange(c)) for c in range(1, 40) for _ in range(2)}
    df = spark.createDataFrame(sorted(edges), "child int, parent int")
    up = {}
    for c in range(40):
        reach, todo = {}, [(p, 1) for x, p in edges if x == c]
        while todo:
            n, d = todo.pop(0)
            if n not in reach or d < reach[n]:
                reach[n] = d
                todo += [(p, d + 1) for x, p in edges if x == n]
        up[c] = reach
    closed = ontology.closure(df)
    assert {(r.ancestor, r.descendant): r.depth for r in closed.collect()} == {(a, c): d for c, r in up.items() for a, d in r.items()}
    nodes = spark.createDataFrame([(n,) for n in range(42)], "node int")
    level = {r.node: r.level for r in ontology.levels(df, nodes).collect()}
    assert set(level) == set(range(42)) and all(level[c] > level[p] for c, p in edges) and level[41] == 0
    cyclic = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "child int, parent int")
    assert {r.node for r in ontology.levels(cyclic, nodes.where("node in (1, 2, 3, 4)")).collect()} == {4}
    scores = [(i, n, rng.random()) for i in range(5) for n in range(40) if rng.random() < 0.6]
    out = {(r.item, r.node): r.score for r in ontology.consistent(spark.createDataFrame(scores, "item int, node int, score double"), closed).collect()}
    for i in range(5):
        own = {n: s for a, n, s in scores if a == i}
        for n in range(40):
            below = [own[c] for c in own if c == n or n in up[c]]
            assert out.get((i, n)) == (max(below) if below else None)
    assert ontology.closure(df.limit(0)).count() == 0


def test_thresholds_against_search(spark):
    rng = random.Random(6)
    rows = [(i, c, int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(300) for c in ("a", "b")] + [(i, "none", 0, 0.7) for i in range(10)]
    got = {r.cls: r for r in multilabel.best_thresholds(spark.createDataFrame(rows, "item int, cls string, y int, p double")).collect()}
    for c in ("a", "b"):
        best = (-1.0, 0.5)
        for t in multilabel.GRID:
            tp = sum(1 for r in rows if r[1] == c and r[3] >= t and r[2])
            fp = sum(1 for r in rows if r[1] == c and r[3] >= t and not r[2])
            fn = sum(1 for r in rows if r[1] == c and r[3] < t and r[2])
            f = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
            if f > best[0]:
                best = (f, t)
        assert got[c].f1 == pytest.approx(best[0]) and got[c].threshold == best[1]
    assert got["none"].threshold == 0.5 and got["none"].f1 is None


TEXTS = ["getHTTPResponse user_name XMLParser v2", "", "a", "ñabc école naïve x1 _y __init__ self return", "def foo(bar): return foo_bar + bar", None]


def test_tokens_and_identifiers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").orderBy("i")
    got = df.select(T.code_tokens(F.col("t")).alias("c"), T.identifiers(F.col("t")).alias("n")).collect()
    for t, r in zip(TEXTS, got):
        if t is None:
            assert r.c is None and r.n is None
            continue
        s = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", t))
        assert r.c == [x.lower() for x in re.findall("[a-zA-Z0-9]+", s)]
        seen = dict.fromkeys(m for m in re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", t) if len(m) > 1 and m not in T.STOP_WORDS)
        assert r.n == list(seen)


def test_truncation_and_estimate(spark):
    code = "line\n" * 100
    r = one(spark, F.struct(T.truncated(F.col("c"), F.lit(30)).alias("t"), T.token_estimate(F.col("c")).alias("e"), T.truncated(F.col("c"), F.lit(1000)).alias("w")), c=(code, "string"))
    assert r.t == ("line\n" * 24)[:119] + "\n# ... (truncated)" and r.e == int(500 / 3.5) and r.w == code


def test_style_marks(spark):
    names = {"snake_case": "snake", "camelCase": "camel", "PascalCase": "pascal", "hello": "other", "": "other", None: "other", "Snake_Case": "pascal"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.naming(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == names
    docs = {"x": "google", "": "none", None: "none", "a\n  Args:\n b": "google", "a\n Parameters\n ----\n": "numpy", "a :param b: c": "rest"}
    got = spark.createDataFrame([(n,) for n in docs], "n string").select("n", T.doc_style(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == docs


def test_profile_and_gate(spark):
    rows = [("r", "my_func", "function", "def my_func(a: int) -> int", "def my_func(a: int) -> int:\n    return 'x'", "Doc."), ("r", "other_one", "function", "def other_one(b: str) -> str", 'return "y"', None), ("s", "myFunc", "method", "myFunc(a)", "'q'", ":param a:")]
    df = spark.createDataFrame(rows, "repo string, name string, type string, signature string, raw_code string, docstring string")
    p = {r.repo: r for r in style.profile(df, ["repo"]).collect()}
    assert p["r"].naming_snake == 1.0 and p["r"].type_hints == 1.0 and p["r"].doc_none == 0.5 and p["r"].functional_ratio == 1.0 and p["s"].doc_rest == 1.0
    g = {r.repo: r for r in style.gate(style.profile(df, ["repo"]), style.profile(df.where("repo = 'r'"), []), []).collect()}
    assert g["r"].divergence == pytest.approx(0, abs=1e-12) and not g["r"].update and g["s"].update
    assert "snake_case" in style.profile(df.where("repo = 'r'"), []).select(style.instruction().alias("s")).first().s


@pytest.mark.parametrize("most", [1_000, 3])
def test_scores_raised_along_edges(spark, most):
    """Cycles, null items, nodes and scores, NaN, nodes without edges; items too large for a task by the closure."""
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame([(n, n // d) for n in range(1, 60) for d in (2, 3)] + [(100, 101), (101, 100)], "child long, parent long")
    rows = [(int(i) if i else None, int(n), float(s)) for i, n, s in zip(rng.integers(0, 9, 40), rng.integers(0, 60, 40), rng.random(40), strict=True)]
    rows += [(1, 100, 0.5), (1, None, 0.3), (2, 999, 0.1), (3, 50, None), (4, 51, float("nan")), (5, 7, -1.0)]
    scores = spark.createDataFrame(rows, "item long, node long, score double")
    got = ontology.consistent_along(scores, edges, most=most)
    want = ontology.consistent(scores, ontology.closure(edges))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    if most > 3:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan


def test_bm25_by_hand(spark):
    docs = [["python", "code", "code"], ["java", "code"], ["python", "python", "tutorial"], []]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, t array<string>")
    q = spark.createDataFrame([("q", ["python", "code", "code", "unknown"]), ("empty", [])], "q string, t array<string>")
    got = {r.id: r.score for r in retrieval.bm25(df, "id", F.col("t"), q, "q", F.col("t"), 10).collect()}
    n, avg = 4, sum(map(len, docs)) / 4
    for i, d in enumerate(docs):
        want = 0.0
        for term in ["python", "code", "code"]:
            f = d.count(term)
            have = sum(term in x for x in docs)
            want += math.log((n - have + 0.5) / (have + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / avg)) if f else 0
        assert got.get(i, 0.0) == pytest.approx(want)


def test_bm25_shuffles_no_pairs(spark):
    """A term that all documents and queries share: only the best rows of each task leave it."""
    rng = np.random.default_rng(3)
    docs = [["common", *rng.choice(["a", "b", "c", "d"], 3).tolist()] for _ in range(300)]
    df = spark.createDataFrame([(f"k{i}", d) for i, d in enumerate(docs)], "id string, t array<string>").repartition(3)
    q = spark.createDataFrame([(i, ["common", "abcd"[i % 4]]) for i in range(40)], "q int, t array<string>")
    ranked = retrieval.bm25(df, "id", F.col("t"), q, "q", F.col("t"), 5)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]
    got = ranked.collect()
    n, avg = len(docs), 4.0
    for i in range(40):
        score = {}
        for k, d in enumerate(docs):
            for term in ("common", "abcd"[i % 4]):
                f, have = d.count(term), sum(term in x for x in docs)
                if f:
                    score[f"k{k}"] = score.get(f"k{k}", 0) + math.log((n - have + 0.5) / (have + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * 4 / avg))
        want = sorted(score, key=lambda k: (-round(score[k], 9), k))[:5]
        assert [r.id for r in sorted((r for r in got if r.q == i), key=lambda r: r.place)] == want


@pytest.mark.parametrize("positive", [True, False])
def test_sparse_top_against_full_products(spark, positive):
    """Blocks of queries, several batches of rows, ties, rows that share nothing and rows without weights."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (2_600, 12)) * (rng.random((2_600, 12)) < 0.3)
    x[7] = 0
    q = x[rng.choice(2_600, 30, replace=False)]
    q[0, :] = 0
    q[0, 11], x[:, 11] = 1, 0
    side = lambda m, name: spark.createDataFrame([(i, np.nonzero(v)[0].tolist(), v[v > 0].astype(float).tolist()) for i, v in enumerate(m)], f"{name} long, ids array<long>, weights array<double>")
    got = retrieval.sparse_top(side(x, "k"), "k", side(q, "q"), "q", 4, positive=positive, block=50).collect()
    held = np.nonzero(x.sum(axis=1))[0]
    for i in range(30):
        score = x[held] @ q[i]
        want = [int(k) for k in held[np.lexsort((held, -score))] if q[i].any() and (not positive or x[k] @ q[i] > 0)][:4]
        assert [r.k for r in sorted((r for r in got if r.q == i), key=lambda r: r.place)] == want


def test_bm25_of_repositories_shuffles_no_pairs(spark):
    """As contexts are searched: each repository for itself, in which all share a term."""
    rng = np.random.default_rng(5)
    docs = [(f"{r}{i}", r, ["common", *rng.choice(["a", "b", "c"], 2).tolist()]) for r in "xyz" for i in range(20)]
    df = spark.createDataFrame(docs, "id string, repo string, t array<string>")
    q = spark.createDataFrame([(i, "xyz"[i % 3], ["common", "a"]) for i in range(9)], "task long, repo string, t array<string>")
    ranked = retrieval.bm25(df, "id", F.col("t"), q, "task", F.col("t"), 4, by=["repo"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]
    got = ranked.collect()
    listed = lambda rows, task: [(r.id, round(r.score, 9)) for r in sorted((r for r in rows if r.task == task), key=lambda r: r.place)]
    for k, repo in enumerate("xyz"):
        alone = retrieval.bm25(df.where(F.col("repo") == repo), "id", F.col("t"), q.where(F.col("task") == k), "task", F.col("t"), 4).collect()
        assert listed(alone, k) == listed(got, k) == listed(got, k + 3) == listed(got, k + 6) and len(alone) == 4


def test_dense_top_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "id int, v array<double>")
    q = df.where("id < 7").select(F.col("id").alias("q"), "v")
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    got = retrieval.dense_top(df, "id", "v", q, "q", "v", 5, block=3).collect()
    for k in range(7):
        order = np.lexsort((np.arange(60), -(u @ u[k]).round(9)))[:5]
        assert [r.id for r in sorted((r for r in got if r.q == k), key=lambda r: r.place)] == order.tolist()
    assert retrieval.dense_top(df, "id", "v", q.limit(0), "q", "v", 5).count() == 0


def test_hybrid_search_joins_no_pairs(spark, small):
    from millrace.plans import code

    plan = code.ret_rrf_hybrid(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan.split("MapInArrow")[0]


def test_fusion_sides(spark):
    a = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "q string, id int, place int")
    b = spark.createDataFrame([("q", 3, 0), ("q", 2, 1)], "q string, id int, place int")
    got = {r.id: r.score for r in retrieval.fused(a, b, "q", "id", 10).collect()}
    assert got == {1: pytest.approx(0.5 / 61), 2: pytest.approx(1 / 62), 3: pytest.approx(0.5 / 61)}
    assert {r.id for r in retrieval.fused(a, b, "q", "id", 10, alpha=0.0).collect()} == {2, 3}


def test_neighbours_and_edges(spark):
    chain = spark.createDataFrame([("A", "B", "CALLS"), ("B", "C", "CALLS"), ("C", "D", "DEFINES"), ("D", "A", "CALLS")], "src string, dst string, relation string")
    start = spark.createDataFrame([("A",)], "id string")
    assert {(r.id, r.depth) for r in codegraph.neighbours(chain, start, 2).collect()} == {("B", 1), ("D", 1), ("C", 2)}
    assert {(r.id, r.depth) for r in codegraph.neighbours(chain, start, 1, ["DEFINES"]).collect()} == set()
    hub = spark.createDataFrame([(f"c{i}", "hub", "CALLS") for i in range(25)], "src string, dst string, relation string")
    assert codegraph.high_degrees(hub).collect() == [("hub", 25)]


def test_budget_skips_and_cuts(spark):
    items = [("t", 1, "current_file", 2.0, 0, "x" * 3500), ("t", 2, "retrieval_seed", 0.1, 0, "y" * 350), ("t", 3, "retrieval_seed", 0.2, 0, "z" * 490), ("t", 4, "retrieval_seed", 0.3, 0, "w" * 35)]
    df = spark.createDataFrame(items, "task string, id int, source string, score double, pos int, text string").withColumn("stage", F.lit(0))
    got = {r.id: (r.tokens, r.text) for r in assembly.budgeted(df, 1000).collect()}
    assert got[1][0] == 300 and got[1][1].endswith("(truncated)") and len(got[1][1]) == 1200 + len("\n# ... (truncated)")
    assert set(got) == {1, 2, 4} and got[2][0] == 100 and got[4][0] == 10


def test_rendered_order_and_cover(spark):
    rows = [
        ("t", "a/x.py", "f", "function", "F", "seed", 0.5, 5, 6, "1"), ("t", "a/y.py", "C", "class", "CC", "current_file", 2.0, 1, 20, "2"), ("t", "a/y.py", "m", "method", "M", "current_file", 2.0, 3, 4, "3"), ("t", "a/x.py", "g", "function", "G", "import_definition", 1.8, 9, 9, "4"),
    ]
    df = spark.createDataFrame(rows, "task string, file_path string, name string, kind string, text string, source string, score double, line_start int, line_end int, id string").withColumns({"stage": F.lit(0), "pos": F.lit(0)})
    assert assembly.rendered(df).first().context == "<|file_sep|>\n# File: x.py\n# function: f\nF\n\n# function: g\nG\n\n<|file_sep|>\n# File: y.py\n# class: C\nCC\n"


def test_arrays(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0]
    c = F.col("x")
    r = one(spark, F.struct(A.resampled(c, 8).alias("r"), A.extrapolated(c, 8).alias("e"), A.moving_mean(c, 3).alias("m"), A.std(c).alias("s"), A.differences(c).alias("d"), A.safe_correlation(c, A.differences(F.array(F.lit(1.0)))).alias("k")), x=(x, "array<double>"))
    at = np.arange(8) * 5 / 8
    assert np.allclose(r.r, np.interp(at, np.arange(5), x))
    ext = [x[min(int(a), 3)] + (x[min(int(a), 3) + 1] - x[min(int(a), 3)]) * (a - min(int(a), 3)) for a in at]
    assert np.allclose(r.e, ext) and np.allclose(r.m, np.convolve(x, np.ones(3) / 3, "same")) and r.s == pytest.approx(np.std(x)) and np.allclose(r.d, np.diff(x))
    empty = one(spark, F.struct(A.resampled(F.col("x"), 4).alias("r"), A.std(F.col("x")).alias("s"), A.differences(F.col("x")).alias("d")), x=([], "array<double>"))
    assert empty.r is None and empty.s is None and empty.d == []


def test_trace_against_plain_search():
    rng = np.random.default_rng(3)
    mask = (rng.random((12, 15)) * 255).astype(np.uint8)
    gain = mask.astype(np.float32) / 255 * 2 - 0.5
    path = signals.trace(mask)

    def value(p):
        return sum(gain[r, x] for x, r in enumerate(p)) - 0.05 * sum(abs(int(a) - int(b)) for a, b in zip(p, p[1:]))

    best = {r: gain[r, 0] for r in range(12)}
    for x in range(1, 15):
        best = {r: max(best[s] - 0.05 * abs(r - s) for s in range(12) if abs(r - s) <= 5) + gain[r, x] for r in range(12)}
    assert value(path) == pytest.approx(max(best.values()), abs=1e-4) and np.abs(np.diff(path)).max() <= 5


def test_drawn_line_comes_back():
    y = (20 + 12 * np.sin(np.arange(200) / 15)).round().astype(int)
    mask = np.zeros((50, 200), np.uint8)
    mask[y, np.arange(200)] = 255
    assert (signals.trace(mask) == y).all()
    wave = signals.waveform(mask, 4.0)
    assert wave.shape == (1250,) and np.isfinite(wave).all() and wave.max() > 0.2 and wave.min() < -0.2
    assert (signals.waveform(np.zeros((0, 5), np.uint8), 1.0) == 0).all()


def test_components_and_page():
    mask = np.zeros((60, 80), np.uint8)
    mask[5, 5] = mask[6, 6] = mask[7, 5] = 255
    mask[20:30, 10:40] = 255
    labels, n = signals.components(mask)
    assert n == 2 and labels[5, 5] == labels[7, 5] and signals.without_small(mask, 10).sum() == 300 * 255
    assert set(signals.split_leads(mask)) == set(signals.LEADS)


def test_regression_closed_forms():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + 3 + rng.normal(size=400) * 0.01
    w, b = regression.ridge(x, y, 1e-9)
    assert np.allclose(w, [1, -2, 0.5, 0], atol=0.01) and b == pytest.approx(3, abs=0.01)
    on = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    w, b = regression.logistic(x, on)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(x.T @ (p - on) + w, 0, atol=1e-4) and abs((p - on).sum()) < 1e-4
    model = regression.fit_two_stage(x, np.where(on > 0, 0.1 + 0.01 * x[:, 1], 0.0))
    assert model["kind"] == "two_stage" and (regression.predict_two_stage(model, x) >= 0).all()
    assert regression.fit_two_stage(x[:60], y[:60])["kind"] == "ridge"


def test_issues_and_keys(spark):
    waves = spark.createDataFrame([("r", "I", [1.0] * 4), ("r", "X", [NAN] * 4), ("r", "II", [99.0] * 3)], "record string, lead string, samples array<double>")
    got = {(r.lead, r.issue) for r in signals.issues(waves, length=4).collect()}
    assert {("X", "unknown lead"), ("X", "not finite"), ("II", "length"), ("II", "peak")} <= got and ("III", "missing") in got and ("I", "missing") not in got


def test_adapters(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    with pytest.raises(adapters.MissingAdapter):
        adapters.embedded(df, "t", None)
    out = adapters.embedded(df, "t", lambda: lambda texts: np.ones((len(texts), 2))).collect()
    assert out[0].embedding == [1.0, 1.0] and out[1].embedding is None
    assert sum(one(spark, adapters.hashed_ngrams(F.col("t")), t=("CCO=C", "string")).values()) == 3
    known = spark.createDataFrame([], "key string, abstract string")
    assert [r.abstract for r in adapters.summarised(df, "t", known, lambda: str.upper).orderBy(F.desc("t")).collect()] == ["AB", None]


def test_page_parts():
    page = np.zeros((200, 300), np.uint8)
    page[40:44, 10:290] = page[100:104, 10:290] = page[160:164, 10:290] = 255  # long strokes
    page[70:76, 50:55] = 255  # a letter
    labels, n = signals.components(page)
    assert n == 4 and signals.boxes(labels, n).tolist()[1] == [50, 70, 5, 6, 30]
    assert (signals.without_text(page) == np.where(labels == 2, 0, page)).all()
    tall = np.zeros((100, 100), np.uint8)
    tall[10:80, 50] = 255
    tall[90, 5:95] = 255
    assert signals.without_vertical(tall)[:85].sum() == 0 and signals.without_vertical(tall)[90].sum() == 90 * 255
    grid = signals.line_grid(page)
    assert (grid[40:44, 10:290] == 255).all() and grid[70:76].sum() == 0
    assert (signals.line_grid(tall)[10:80, 50] == 255).all()
    full = np.zeros_like(page)
    full[20:180, 30:280:10] = 255
    left, top, right, bottom = signals.crop_box(page, full)
    assert (left, right) == (30, 271) and top < 40 and bottom > 163
    assert signals.crop_box(np.zeros((5, 7), np.uint8)) == (0, 0, 7, 5)


def test_shuffled_folds_are_even():
    f = multilabel.shuffled_folds(23)
    assert np.bincount(f).tolist() == [5, 5, 5, 4, 4] and (f == multilabel.shuffled_folds(23)).all()


def test_levels_beyond_the_limit_raise(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "child long, parent long")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "node long")
    assert {tuple(r) for r in ontology.levels(edges, nodes, limit=3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    with pytest.raises(RuntimeError):
        ontology.levels(edges, nodes, limit=2)

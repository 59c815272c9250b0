"""The completion pipeline on a small repository, and splits of records."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import assembly, completion, signals

ENTITY = "repo string, id string, file_path string, name string, kind string, line_start int, line_end int, place int, signature string, raw_code string, docstring string, parent string, dependencies array<string>"


def entity(repo, path, name, kind, a, b, parent=None, code=None):
    return (repo, f"{repo}/{path}:{name}:{a}", path, name, kind, a, b, a, f"def {name}()", code or f"def {name}(): # {name}", None, parent, [])


@pytest.fixture(scope="module")
def repository(spark):
    rows = [
        entity("r", "a.py", "Child", "class", 1, 20, code="class Child(Base):\n    pass"), entity("r", "a.py", "load", "method", 3, 9, "Child"), entity("r", "b.py", "Base", "class", 1, 5), entity("r", "b.py", "other", "function", 40, 45),
        entity("r", "c.py", "read_rows", "function", 1, 4), entity("r", "c.py", "near", "function", 30, 33), entity("r", "c.py", "far", "function", 300, 301), entity("r", "d.py", "helper", "function", 1, 2), entity("s", "c.py", "read_rows", "function", 1, 4),
    ]
    e = spark.createDataFrame(rows, ENTITY)
    edges = spark.createDataFrame([("r/c.py:read_rows:1", "r/d.py:helper:1", "CALLS")], "src string, dst string, relation string")
    tasks = [("t", "r", "a.py", "from d import helper\n\n\nx = read_rows()\n", "read_rows()", ["a.py", "b.py"]), ("none", "q", "z.py", None, None, None)]
    return spark.createDataFrame(tasks, "task string, repo string, path string, prefix string, suffix string, modified array<string>"), e, edges


def test_contexts(repository):
    got = {r.task: r.context for r in completion.contexts(*repository, seeds=1).collect()}
    assert got["none"] == ""
    text = got["t"]
    # The import wins over the graph's neighbour; far lines and other repositories stay out; the cursor's entity comes last.
    assert text.count("helper()") == 1 and "far" not in text and text.count("def read_rows") == 1 and "near" in text
    order = [text.index(w) for w in ("# function: read_rows", "# function: helper", "# class: Base", "# class: Child")]
    assert order == sorted(order) and "# method: load" not in text


def test_resolved_imports(spark, repository):
    _, e, _ = repository
    rows = [("t", "r", "from", "c", "read_rows", 0), ("t", "r", "from", "x.d", "helper", 1), ("t", "r", "import", "d", "helper", 2), ("t", "r", "from", "c", "read_rows", 3), ("t", "r", "from", "c", "unknown", 4)]
    imports = spark.createDataFrame(rows, "task string, repo string, type string, module string, name string, place int")
    got = completion.resolved_imports(imports, e).orderBy("place").collect()
    assert [(r.id, r.place) for r in got] == [("r/c.py:read_rows:1", 0), ("r/d.py:helper:1", 1)]
    assert completion.resolved_imports(imports, e, most=1).count() == 1


def test_hot_group_fold_is_pruned_without_effect(spark):
    rows = [(i, "x" * (7 * (i % 23 + 1))) for i in range(3000)] + [(5000, "")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("g", F.lit("hot"))
    got = sorted((r.id, r.tokens) for r in assembly.within_budget(df, ["g"], ["id"], "text", F.lit(400), F.lit(True), 5).collect())
    used, want = 0, [(5000, 0)]
    for i, t in rows[:-1]:
        n = int(len(t) / 3.5)
        take = n if n <= 400 - used else 400 - used if 400 - used > 5 else 0
        used += take
        want += [(i, take)] if take else []
    assert got == sorted(want)


def test_split_by_record(spark):
    waves = spark.createDataFrame([(f"r{i // 3}", str(i)) for i in range(60)], "record string, lead string")
    train, held = signals.train_validation(waves, 0.2)
    a, b = ({r.record for r in x.collect()} for x in (train, held))
    assert len(a) == 16 and len(b) == 4 and not a & b
    one = waves.where("record = 'r1'")
    assert [x.count() for x in signals.train_validation(one, 0.2)] == [3, 3]

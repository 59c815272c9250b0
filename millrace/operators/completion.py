"""Context for code completions: all tasks at once, each within its repository, from candidates to rendered text."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import assembly, codegraph, retrieval
from millrace.plans.shared import written
from millrace.sources import python_code

MODIFIED, IMPORTED = 10, 10  # files and imports that count


def resolved_imports(imports: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """(task, id, place): for imports (task, repo, module, name, place) of the form "from", the entity of that name, one in a

    file whose path holds the module before others; each entity once, the first ``most`` by place.
    """
    want = imports.where("type = 'from'").select("task", "place", "module", F.concat_ws("\0", "repo", "name").alias("want"), F.translate("module", ".", "/").alias("path"))
    index = entities.select("id", F.concat_ws("\0", "repo", "name").alias("name"), "file_path")
    one = codegraph.resolved_by_path(want, index, "want", "path", ["task", "place"])
    once = one.groupBy("task", F.col("target").alias("id")).agg(F.min("place").alias("place"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("task").orderBy("place", "id"))).where(F.col("r") <= most).drop("r")


def contexts(tasks: DataFrame, entities: DataFrame, edges: DataFrame, *, max_tokens: int = 8_000, seeds: int = 5, depth: int = 1, dense: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """(task, context) for every task, empty where nothing is found.

    tasks: task, repo, path, prefix, suffix, modified; entities: repo, id (unique over repositories), file_path, name, kind,
    line_start, line_end, place (order in the file), signature, raw_code, docstring, parent, dependencies; edges: src, dst, relation.
    dense: an optional ranking (task, id, place) to fuse with BM25.

    Stages, each entity counting where it comes first: the entity at the cursor and a method's class (2.0); the first entity of
    up to ten other modified files (1.7); imported entities and base classes from other files (1.85); retrieval seeds, and for
    each the entities within 50 lines (0.8 of its score) and its neighbours in the graph (0.7 to the power of their depth).
    """
    # Tables that are read many times are written once.
    e = entities.withColumn("n_deps", F.coalesce(F.size("dependencies"), F.lit(0))).withColumn("at", F.concat_ws("\0", "repo", "file_path"))
    e, edges = written(e, "completion-entities"), written(edges, "completion-edges")
    cursors = tasks.select(F.col("task").alias("cursor"), F.concat_ws("\0", "repo", "path").alias("file_path"), F.size(F.split(F.coalesce("prefix", F.lit("")), "\n", -1)).alias("line"))
    found = codegraph.at_cursor(e.drop("file_path").withColumnRenamed("at", "file_path"), cursors)
    current = found.select(F.col("cursor").alias("task"), "id", F.lit("current_file").alias("source"), F.lit(2.0).alias("score"), F.when(F.col("role") == "parent", 0).otherwise(1).alias("pos"))

    files = tasks.select("task", "repo", "path", F.posexplode("modified").alias("pos", "file_path")).where("file_path <> path")
    files = files.withColumn("r", F.row_number().over(Window.partitionBy("task").orderBy("pos"))).where(F.col("r") <= MODIFIED)
    first = e.groupBy("repo", "file_path").agg(F.min(F.struct("place", "id")).alias("f"))
    modified = files.join(first, ["repo", "file_path"]).select("task", F.col("f.id").alias("id"), F.lit("modified_file").alias("source"), F.lit(1.7).alias("score"), "pos")

    # Imports of the prefix in order, the first ten; and base classes of the file's entities.
    listed = python_code.imports(tasks.select("task", "repo", "path", "prefix"), ["task", "repo", "path"], "prefix").select("task", "repo", "path", F.col("name").alias("want"), F.monotonically_increasing_id().alias("order"))
    listed = listed.withColumn("pos", F.row_number().over(Window.partitionBy("task").orderBy("order"))).where(F.col("pos") <= IMPORTED).drop("order")
    own = tasks.select("task", "repo", "path").join(e.select("repo", F.col("file_path").alias("path"), T.base_class(F.col("raw_code")).alias("want"), "place"), ["repo", "path"]).where("want is not null")
    wanted = listed.withColumn("base", F.lit(False)).unionByName(own.select("task", "repo", "path", "want", (F.col("place") + 1000).alias("pos"), F.lit(True).alias("base")))
    # One row a name and file, then a name's smallest id and the smallest of its other files: names of many entities don't multiply.
    in_file = e.groupBy("repo", F.col("name").alias("want"), "file_path").agg(F.min("id").alias("id"))
    least = in_file.groupBy("repo", "want").agg(F.min(F.struct("id", "file_path")).alias("c"))
    other = in_file.join(least, ["repo", "want"]).where(F.col("file_path") != F.col("c.file_path")).groupBy("repo", "want").agg(F.min("id").alias("other"))
    one = wanted.join(least, ["repo", "want"]).join(other, ["repo", "want"], "left")
    away = F.col("c.file_path") != F.col("path")
    one = one.select("task", "pos", "want", "base", F.struct((~away & F.col("other").isNull()).alias("same"), F.when(away, F.col("c.id")).otherwise(F.coalesce("other", "c.id")).alias("id")).alias("c"))
    imported = one.where(~(F.col("base") & F.col("c.same"))).select("task", F.col("c.id").alias("id"), F.lit("import_definition").alias("source"), F.lit(1.85).alias("score"), "pos")

    before = written(assembly.first_stage([current, modified, imported]), "completion-stages")
    words = T.code_tokens(T.sparse_text(F.col("name"), F.col("signature"), F.col("docstring"), F.col("raw_code")))
    asked = tasks.select("task", "repo", T.code_tokens(T.completion_query(F.coalesce("prefix", F.lit("")), F.coalesce("suffix", F.lit("")))).alias("t"))
    ranked = retrieval.bm25(e.withColumn("t", words), "id", F.col("t"), asked, "task", F.col("t"), seeds * 10, by=["repo"])
    ranked = retrieval.fused(dense, ranked, "task", "id", seeds * 5, alpha if dense is not None else 0.0)
    fresh = ranked.join(before.select("task", "id"), ["task", "id"], "left_anti").join(e.select("id", "name", "file_path", F.col("raw_code").alias("code")), "id")
    scored = assembly.seed_scores(fresh, codegraph.degrees(edges))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("task").orderBy(F.col("score").desc(), "id"))).where(F.col("n") <= seeds).select("task", "id", "score", "n")
    best = written(best, "completion-seeds")
    chosen = best.select("task", "id", F.lit("retrieval_seed").alias("source"), "score", (F.col("n") * 10).alias("pos"))
    places = best.join(e.select("id", "at", "line_start"), "id").select(F.col("id").alias("seed"), F.col("at").alias("file_path"), "line_start").distinct()
    near = codegraph.adjacent(e.drop("file_path").withColumnRenamed("at", "file_path"), places)
    adjacent = best.select("task", F.col("id").alias("seed"), "score", "n").join(near, "seed").select("task", "id", F.lit("adjacent_chunk").alias("source"), (F.col("score") * 0.8).alias("score"), (F.col("n") * 10 + 1).alias("pos"))
    around = codegraph.neighbours(edges, best.select("id").distinct(), depth, ["CALLS", "CONTAINS"]).join(e.select("id"), "id", "left_semi")
    linked = best.select("task", F.col("id").alias("start"), "score", "n").join(around, "start").select("task", "id", F.lit("neighbor").alias("source"), (F.col("score") * F.pow(F.lit(0.7), F.col("depth"))).alias("score"), (F.col("n") * 10 + 1 + F.col("depth")).alias("pos"))

    late = chosen.unionByName(adjacent).unionByName(linked)
    items = assembly.first_stage([before, late]).join(e, "id")
    shown = items.withColumn("text", F.coalesce(T.shown_code(F.col("raw_code"), F.col("signature"), F.col("docstring")), F.lit("")))
    text = assembly.rendered(assembly.budgeted(shown.select("task", "id", "source", "score", "stage", "pos", "text", "file_path", "name", "kind", "line_start", "line_end"), max_tokens))
    return assembly.with_empty(tasks.select("task"), text, "task")

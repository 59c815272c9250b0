"""Context for a completion: stages of candidate entities, first-wins order, token budgets, rendering."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import base_name, token_estimate, truncated

# A source's rank when rendered, its budget as a share of all tokens, and whether an item that
# doesn't fit may be cut.
PRIORITY = {"current_file": 3, "modified_file": 2, "import_definition": 1}
BUDGETS = {"current_file": 0.30, "import_definition": 0.30, "modified_file": 0.25, "other": 0.12}


def seed_scores(seeds: DataFrame, degrees: DataFrame | None = None, threshold: int = 20) -> DataFrame:
    """Retrieved seeds (id, name, file_path, code, score) without low-value ones, scores weighed.

    Left out: small test functions (path with "test", name test_... or empty_..., code under 100 characters), and setup,
    teardown, __init__ and main with a score under 0.5. Times 1.2 outside tests, halved for entities of high degree.
    """
    in_tests = F.lower("file_path").contains("test")
    tiny = in_tests & (F.col("name").startswith("test_") | F.col("name").startswith("empty_")) & (F.length(F.coalesce("code", F.lit(""))) < 100)
    generic = F.col("name").isin("setup", "teardown", "__init__", "main") & (F.col("score") < 0.5)
    kept = seeds.where(~(tiny | generic)).withColumn("score", F.when(in_tests, F.col("score")).otherwise(F.col("score") * 1.2))
    if degrees is None:
        return kept
    d = degrees.select(F.col("id").alias("__id"), "degree")
    return kept.join(d, F.col("id") == F.col("__id"), "left").withColumn("score", F.when(F.col("degree") > threshold, F.col("score") * 0.5).otherwise(F.col("score"))).drop("__id", "degree")


def first_stage(stages: list[DataFrame]) -> DataFrame:
    """(task, id, source, score, stage, pos): each entity of a task once, from the first stage and place that has it.

    Each of stages: task, id, source, score, pos. The choice is an aggregate, reduced before the shuffle.
    """
    out = None
    for k, s in enumerate(stages):
        part = s.select("task", "id", F.struct(F.lit(k).alias("stage"), "pos", "source", "score").alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("task", "id").agg(F.min("s").alias("s")).select("task", "id", "s.source", "s.score", "s.stage", "s.pos")


def budget_class(source: Column) -> Column:
    return F.when(source.isin([s for s in BUDGETS if s != "other"]), source).otherwise(F.lit("other"))


def within_budget(items: DataFrame, by: list[str], order: list[str], text: str, limit: Column, cuttable: Column, least: int = 100) -> DataFrame:
    """The items that fit, per group and in ascending order, with ``tokens``; an item that doesn't fit is skipped, later ones may fit.

    A cuttable item that doesn't fit is cut to what is left, if more than ``least`` tokens are. limit and cuttable are the
    same for all rows of a group; order must be total. Items of no tokens always fit.

    Not a running sum but a fold over a group's sizes. It needs only the first limit / t + 1 items of t tokens (and the first
    that exceeds the limit): of one size, none fits after one that didn't. So a group's fold holds about limit * ln(limit)
    sizes at most, however many items the group has.
    """
    rows = items.withColumn("__t", token_estimate(F.col(text))).withColumn("__limit", limit.cast("int")).withColumn("__c", cuttable).withColumn("__o", F.struct(*order))
    size = F.least("__t", F.col("__limit") + 1)
    place = F.row_number().over(Window.partitionBy(*by, size).orderBy("__o"))
    few = rows.where("__t > 0").withColumn("__n", place).where(F.col("__n") <= F.when(size > F.col("__limit"), 1).otherwise(F.floor(F.col("__limit") / size) + 1))
    sizes = few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("__o").alias("o"), F.col("__t").alias("t")))).alias("all"), F.max("__limit").alias("limit"), F.max("__c").alias("c"))
    empty = F.expr("transform(slice(all, 1, 0), x -> named_struct('o', x.o, 't', x.t, 'cut', false))")
    start = F.struct(F.lit(0).alias("used"), empty.alias("kept"))

    def step(s: Column, x: Column) -> Column:
        left = F.col("limit") - s["used"]
        fits = x["t"] <= left
        cut = ~fits & F.col("c") & (left > least)
        take = F.when(fits, x["t"]).when(cut, left).otherwise(F.lit(0)).cast("int")
        entry = F.array(F.struct(x["o"].alias("o"), take.alias("t"), cut.alias("cut")))
        return F.struct((s["used"] + take).alias("used"), F.when(fits | cut, F.concat(s["kept"], entry)).otherwise(s["kept"]).alias("kept"))

    kept = sizes.select(*by, F.inline(F.aggregate("all", start, step)["kept"]))
    renamed = kept.withColumnsRenamed({c: f"__k_{c}" for c in by})
    same = F.col("__o") == F.col("o")
    for c in by:
        same &= F.col(c) == F.col(f"__k_{c}")
    extra = ["__t", "__limit", "__c", "__o"]
    out = rows.join(renamed, same).withColumn(text, F.when(F.col("cut"), truncated(F.col(text), F.col("t"))).otherwise(F.col(text)))
    out = out.withColumn("tokens", F.col("t")).drop(*extra, "o", "t", "cut", *[f"__k_{c}" for c in by])
    return out.unionByName(rows.where("__t = 0").withColumn("tokens", F.lit(0)).drop(*extra))


def budgeted(items: DataFrame, max_tokens: int = 8_000) -> DataFrame:
    """Items (task, id, source, score, pos, text) under the budgets of their sources, taken in ascending score."""
    kind = budget_class(F.col("source"))
    limit = F.coalesce(*[F.when(F.col("budget") == k, F.lit(int(max_tokens * share))) for k, share in BUDGETS.items()])
    return within_budget(items.withColumn("budget", kind), ["task", "budget"], ["score", "stage", "pos", "id"], "text", limit, F.col("budget") != "other")


def rendered(items: DataFrame, key: str = "task") -> DataFrame:
    """(task, context): items (task, file_path, name, kind, text, source, score, line_start, line_end, id) as text, files grouped.

    Order: source priority, then score, ascending, so that the most relevant comes last; an item within the lines of an
    earlier one of its file is left out. Files come in the order of their first item.
    """
    priority = F.coalesce(*[F.when(F.col("source") == s, F.lit(p)) for s, p in PRIORITY.items()], F.lit(0))
    placed = items.withColumn("__p", F.row_number().over(Window.partitionBy(key).orderBy(priority, "score", "stage", "pos", "id")))
    parts = F.struct("__p", "file_path", "name", "kind", "text", "line_start", "line_end")
    listed = placed.groupBy(key).agg(F.sort_array(F.collect_list(parts)).alias("all"))
    # A task's items are bounded by its budget.
    held = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["__p"] < x["__p"]) & (y["file_path"] == x["file_path"]) & (y["line_start"] <= x["line_start"]) & (x["line_end"] <= y["line_end"])))
    kept = listed.select(key, held.alias("kept"))
    files = F.array_distinct(F.transform("kept", lambda x: x["file_path"]))
    one = lambda x: F.concat(F.lit("# "), x["kind"], F.lit(": "), x["name"], F.lit("\n"), x["text"], F.lit("\n"))
    body = lambda f: F.array_join(F.transform(F.filter("kept", lambda x: x["file_path"] == f), one), "\n")
    block = lambda f: F.concat(F.lit("<|file_sep|>\n# File: "), base_name(f), F.lit("\n"), body(f))
    return kept.select(key, F.array_join(F.transform(files, block), "\n").alias("context"))


def source_counts(items: DataFrame) -> DataFrame:
    """(source, n): how many items each source gave."""
    return items.groupBy("source").agg(F.count("*").alias("n"))


def cache_statistics(cache: DataFrame, unit: float, key: str = "key", text: str = "abstract") -> DataFrame:
    """One row: n cached keys, n_chars of their texts, and what making them all again costs at ``unit`` each; a key counts once."""
    once = cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.length(text)).alias("c"))
    return once.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chars"), (F.count("*") * F.lit(unit)).alias("cost"))


def task_report(tasks: DataFrame, archives: DataFrame, files: DataFrame, contexts: DataFrame) -> DataFrame:
    """(repo, tasks, ok, no_archive, no_target, no_context): what hinders the tasks of each repository, the first thing counts.

    tasks: task, repo, path; archives: repo, for those at hand; files: repo, path; contexts: task, context. An empty context is none.
    """
    a = archives.select(F.col("repo").alias("__ar")).where("__ar is not null").distinct()
    f = files.select(F.col("repo").alias("__fr"), F.col("path").alias("__fp")).distinct()
    c = contexts.where(F.col("context") != "").select(F.col("task").alias("__ct")).distinct()
    j = tasks.select("task", "repo", "path").join(a, F.col("repo") == F.col("__ar"), "left").join(f, (F.col("repo") == F.col("__fr")) & (F.col("path") == F.col("__fp")), "left").join(c, F.col("task") == F.col("__ct"), "left")
    state = F.when(F.col("__ar").isNull(), "no_archive").when(F.col("__fr").isNull(), "no_target").when(F.col("__ct").isNull(), "no_context").otherwise("ok")
    return j.groupBy("repo").agg(F.count("*").alias("tasks"), *[F.count_if(state == s).alias(s) for s in ("ok", "no_archive", "no_target", "no_context")])


def paged(rows: DataFrame, order: list[Column], skip: int = 0, limit: int = 0) -> DataFrame:
    """Rows after ``skip``, at most ``limit`` (0: all), in a total order."""
    out = rows.orderBy(*order).offset(skip)
    return out.limit(limit) if limit else out


def with_empty(tasks: DataFrame, results: DataFrame, key: str, value: str = "context") -> DataFrame:
    """Every task with its result, or an empty text where there is none."""
    r = results.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return tasks.join(r, F.col(key) == F.col("__k"), "left").withColumn(value, F.coalesce("__v", F.lit(""))).drop("__k", "__v")

"""The graph of a code base: nodes (id, file_path, name, ...) and edges (src, dst, relation), resolution and neighbourhoods."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.shared import written


def entity_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"))


def nodes(entities: DataFrame) -> DataFrame:
    """(id, file_path, name, kind, line_start, line_end, parent): entities once each, and a module node a file."""
    own = entities.select(entity_id(F.col("file_path"), F.col("name"), F.col("line_start")).alias("id"), "file_path", "name", F.col("type").alias("kind"), "line_start", "line_end", "parent")
    files = entities.select("file_path").distinct()
    modules = files.select(F.concat("file_path", F.lit(":module")).alias("id"), "file_path", F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit("module").alias("kind"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit(None).cast("string").alias("parent"))
    return own.dropDuplicates(["id"]).unionByName(modules)


def resolved(wanted: DataFrame, index: DataFrame, name: str, file: str, keep: list[str]) -> DataFrame:
    """wanted joined to the entities of index called ``name``, one each: the smallest id of its own ``file``, else of all.

    index: id, file_path, name. The index is first reduced to one row for a name and file, and one for a name, so a name with
    very many entities and callers multiplies nothing.
    """
    in_file = index.groupBy(F.col("name").alias("c_name"), F.col("file_path").alias("c_file")).agg(F.min("id").alias("c_id"))
    first = in_file.groupBy(F.col("c_name").alias("f_name")).agg(F.min(F.struct("c_id", "c_file")).alias("f"))
    asked = wanted.select(*dict.fromkeys([*keep, name, file])).distinct()
    own = asked.join(in_file, (F.col(name) == F.col("c_name")) & (F.col(file) == F.col("c_file")), "left")
    both = own.join(first, F.col(name) == F.col("f_name"))
    return both.select(*keep, F.coalesce("c_id", "f.c_id").alias("target"), F.coalesce("c_file", "f.c_file").alias("target_file"))


def resolved_by_path(wanted: DataFrame, index: DataFrame, name: str, path: str, keep: list[str], most: int = 1_000) -> DataFrame:
    """wanted joined to the entities of index called ``name``, one each: the smallest id of a file whose path contains ``path``,

    else of all. Both sides are reduced first, wanted to one row for a name and path, the index to one for a name and file; a
    name's paths are all compared with its files, as any text can contain another, in shares of ``most`` files each.
    """
    files = index.groupBy(F.col("name").alias("c_name"), F.col("file_path").alias("c_file")).agg(F.min("id").alias("c_id"))
    shares = files.groupBy(F.col("c_name").alias("f_name")).agg(F.min(F.struct("c_id", "c_file")).alias("f"), F.ceil(F.count("*") / most).cast("int").alias("shares"))
    asked = wanted.select(F.col(name).alias("a_name"), F.col(path).alias("a_path")).distinct().join(shares, F.col("a_name") == F.col("f_name")).drop("f_name")
    spread = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    cut = files.join(shares.select("f_name", "shares"), F.col("c_name") == F.col("f_name")).withColumn("c_share", F.pmod(F.xxhash64("c_file"), F.col("shares")).cast("int")).drop("f_name", "shares")
    hit = spread.join(cut, (F.col("a_name") == F.col("c_name")) & (F.col("share") == F.col("c_share")) & F.contains("c_file", "a_path"))
    best = hit.groupBy("a_name", "a_path").agg(F.min(F.struct("c_id", "c_file")).alias("c")).select(F.col("a_name").alias("b_name"), F.col("a_path").alias("b_path"), "c")
    out = asked.join(best, (F.col("a_name") == F.col("b_name")) & (F.col("a_path") == F.col("b_path")), "left").select("a_name", "a_path", F.coalesce("c", "f").alias("c"))
    return wanted.select(*dict.fromkeys([*keep, name, path])).distinct().join(out, (F.col(name) == F.col("a_name")) & (F.col(path) == F.col("a_path"))).select(*keep, F.col("c.c_id").alias("target"), F.col("c.c_file").alias("target_file"))


def edges(entities: DataFrame, imports: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """(src, dst, relation): DEFINES (file to entity), CONTAINS (class to method), CALLS, IMPORTS (file to file).

    Calls are resolved over all entities by their full name, the caller's own file first, then the smallest id. Dotted
    calls don't match bare names. imports: file_path, module; a module is each file whose path without suffix is it or ends with
    it, in whole parts. strict leaves out CONTAINS and IMPORTS.
    """
    all_ = nodes(entities)
    own = all_.where("kind <> 'module'")
    defines = own.select(F.concat("file_path", F.lit(":module")).alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("relation"))
    calls = entities.select(entity_id(F.col("file_path"), F.col("name"), F.col("line_start")).alias("src"), "file_path", F.explode("dependencies").alias("dep")).distinct()
    called = resolved(calls, own.select("id", "file_path", "name"), "dep", "file_path", ["src", "dep"])
    out = defines.unionByName(called.select("src", F.col("target").alias("dst"), F.lit("CALLS").alias("relation")))
    if not strict:
        classes = own.where("kind = 'class'").groupBy("file_path", F.col("name").alias("parent")).agg(F.min("id").alias("src"))
        contains = own.where("parent is not null").join(classes, ["file_path", "parent"]).select("src", F.col("id").alias("dst"), F.lit("CONTAINS").alias("relation"))
        out = out.unionByName(contains)
        if imports is not None:
            # A file goes by each end of its path without suffix, whole parts only: one row a part, and equal keys to join on.
            parts = F.split(F.regexp_replace("file_path", r"(/__init__)?\.\w+$", ""), "/")
            ends = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", k, F.size("parts")), "/"))
            modules = entities.select("file_path").distinct().select(F.col("file_path").alias("target"), parts.alias("parts")).select("target", F.explode(ends).alias("path"))
            want = imports.select("file_path", F.translate("module", ".", "/").alias("path")).where("path <> ''").distinct()
            hit = want.join(modules, "path")
            out = out.unionByName(hit.select(F.concat("file_path", F.lit(":module")).alias("src"), F.concat("target", F.lit(":module")).alias("dst"), F.lit("IMPORTS").alias("relation")))
    return out.distinct()


def by_id(nodes_: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the given ids (id); unknown ones have no row."""
    return nodes_.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left_semi")


def of_files(nodes_: DataFrame, files: DataFrame) -> DataFrame:
    """The entities of the given files (file_path), without the files' own nodes."""
    return nodes_.where("kind <> 'module'").join(files.select(F.col("file_path").alias("__f")).distinct(), F.col("file_path") == F.col("__f"), "left_semi")


def of_names(nodes_: DataFrame, names: DataFrame) -> DataFrame:
    """The entities of the given names (name)."""
    return nodes_.where("kind <> 'module'").join(names.select(F.col("name").alias("__n")).distinct(), F.col("name") == F.col("__n"), "left_semi")


def sizes(nodes_: DataFrame) -> DataFrame:
    """One row: n_nodes, files' nodes included, n_entities, n_files."""
    return nodes_.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") != "module").alias("n_entities"), F.count_if(F.col("kind") == "module").alias("n_files"))


def known_edges(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """The edges of which both ends are nodes."""
    ids = nodes_.select("id").distinct()
    return edges_.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def degrees(edges_: DataFrame) -> DataFrame:
    """(id, degree): edges in and out; a loop counts twice."""
    return edges_.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def high_degrees(edges_: DataFrame, threshold: int = 20) -> DataFrame:
    return degrees(edges_).where(F.col("degree") > threshold)


def callees(edges_: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): what each start (id) calls."""
    return edges_.where("relation = 'CALLS'").join(starts.select(F.col("id").alias("start")), F.col("src") == F.col("start")).select("start", F.col("dst").alias("id")).distinct()


def callers(edges_: DataFrame, starts: DataFrame) -> DataFrame:
    return edges_.where("relation = 'CALLS'").join(starts.select(F.col("id").alias("start")), F.col("dst") == F.col("start")).select("start", F.col("src").alias("id")).distinct()


def neighbours(edges_: DataFrame, starts: DataFrame, depth: int = 1, relations: list[str] | None = None) -> DataFrame:
    """(start, id, depth): nodes within ``depth`` edges of each start (id), either way, by the fewest edges; the start left out.

    Level by level; each level is a join with the newest nodes only, without those met before, and its result is written.
    """
    e = edges_ if relations is None else edges_.where(F.col("relation").isin(relations))
    both = written(e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "graph-edges")
    met = written(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct(), "graph-level")
    newest = met
    for level in range(1, depth + 1):
        far = newest.join(both, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        newest = written(far.join(met.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(level)), "graph-level")
        met = met.unionByName(newest)
    return met.where("depth > 0")


def at_cursor(entities: DataFrame, cursors: DataFrame) -> DataFrame:
    """(cursor, id, role): for each cursor (cursor, file_path, line) the innermost entity around the line, and for a method its class.

    Where no entity holds the line: the class with most dependencies, else the file's first entity. Ties: smallest id.
    """
    e = entities.select("id", "file_path", "kind", "name", "parent", "line_start", "line_end", "n_deps", "place")
    j = cursors.join(e, "file_path")
    inside = (F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end"))
    best = j.groupBy("cursor", "file_path").agg(
        F.min(F.when(inside, F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "id", "kind", "parent"))).alias("inner"),
        F.min(F.when(F.col("kind") == "class", F.struct((-F.col("n_deps")).alias("size"), "place", "id"))).alias("main"),
        F.min(F.struct("place", "id")).alias("first"),
    )
    own = best.select("cursor", F.coalesce("inner.id", "main.id", "first.id").alias("id"), F.lit("entity").alias("role"))
    methods = best.where("inner.kind = 'method' and inner.parent is not null").select("cursor", "file_path", F.col("inner.parent").alias("name"))
    parents = methods.join(e.where("kind = 'class'").select("file_path", "name", "id", "place"), ["file_path", "name"]).groupBy("cursor").agg(F.min(F.struct("place", "id")).alias("p"))
    return own.unionByName(parents.select("cursor", F.col("p.id").alias("id"), F.lit("parent").alias("role")))


def adjacent(entities: DataFrame, seeds: DataFrame, lines: int = 50, file: str = "file_path", line: str = "line_start", key: str = "id") -> DataFrame:
    """(seed, key): entities of the same file that begin within ``lines`` of a seed (seed, file, line); the seed itself left out.

    Files are cut into bands of ``lines`` lines, so a very long file is no hot group: a seed looks into three bands.
    """
    band = lambda c: F.floor(c / lines).cast("int")
    s = seeds.select("seed", F.col(file).alias("__f"), F.col(line).alias("__l"), F.explode(F.array(*[band(F.col(line)) + k for k in (-1, 0, 1)])).alias("__b"))
    e = entities.select(key, F.col(file).alias("__ef"), F.col(line).alias("__el"), band(F.col(line)).alias("__eb"))
    near = s.join(e, (F.col("__f") == F.col("__ef")) & (F.col("__b") == F.col("__eb"))).where((F.abs(F.col("__l") - F.col("__el")) <= lines) & (F.col(key) != F.col("seed")))
    return near.select("seed", key)


def uncovered(items: DataFrame, group: list[str], start: str, end: str, tie: str) -> DataFrame:
    """The items whose range lies in no other range of their group; of equal ranges the first by tie stays.

    In the order of start, then of end from the far one, an item is covered exactly if an earlier one ends no sooner: one
    running maximum, no pairs.
    """
    w = Window.partitionBy(*group).orderBy(F.col(start), F.col(end).desc(), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("__reach", F.max(end).over(w)).where(F.col("__reach").isNull() | (F.col("__reach") < F.col(end))).drop("__reach")


def row_number(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))

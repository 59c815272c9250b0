"""Queries of the readers and writers: test tables written as files of each kind, in the shared folder, and read back whole."""

import io
import os
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators import codegraph
from millrace.plans.catalogue import Catalogue
from millrace.plans.classes import EDGES, _edges
from millrace.plans.code import EDGES_SQL, _listed
from millrace.plans.shared import folder, removed_at_end
from millrace.plans.tables import table
from millrace.plans.waves import LEADS_SQL, _leads
from millrace.sources import readers, writers
from millrace.streaming import incremental

C = Catalogue()


def _place(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; it is deleted when the driver ends."""
    path = os.path.join(folder(spark), "millrace", f"{name}-{uuid.uuid4().hex}")
    removed_at_end(spark, path)
    return path if ":" in path else "file://" + path


def _files(df: DataFrame, name: str) -> str:
    at = _place(df.sparkSession, name)
    writers.binaries(df, at)
    return at


@C.add("""SELECT reading_id, nullif("deviceId", '') AS "deviceId", nullif(timedate, '') AS timedate, period, x2, t4 FROM device_data""")
def src_csv(spark, d):
    at = _place(spark, "csv")
    writers.csv(table(spark, d, "device_data"), at, ["reading_id"])
    schema = T.StructType([T.StructField("reading_id", T.LongType()), *readers.READING.fields])
    return readers.csv(spark, at, schema, ["reading_id", "deviceId", "timedate", "period", "x2", "t4"], multi_line=True)


@C.add("SELECT count(*) AS n, count(DISTINCT \"deviceId\") AS n_devices FROM devices")
def src_csv_devices(spark, d):
    """One file with a header, read by the columns' names; an entry that is no number is null."""
    at = _place(spark, "csv")
    writers.csv(table(spark, d, "devices").select("longitude", "deviceId", "latitude"), at, ["deviceId"], one_file=True)
    return readers.csv(spark, at, readers.DEVICE).agg(F.count("*").alias("n"), F.count_distinct("deviceId").alias("n_devices"))


TASKS = """SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS k, repo, revision, file_path AS path, left(content, length(content) // 2) AS prefix FROM source_files"""


@C.add(f"SELECT coalesce(CASE WHEN file_id % 5 > 0 THEN CAST(file_id AS VARCHAR) END, 'task_' || k) AS id, CAST(k AS INTEGER) AS line_num, repo, path, md5(prefix) AS prefix FROM ({TASKS})")
def src_json_lines(spark, d):
    """Tasks in the order of their files, in one file whose lines are numbered; every fifth has no id."""
    f = table(spark, d, "source_files").select(F.when(F.col("file_id") % 5 > 0, F.col("file_id").cast("string")).alias("id"), "file_id", "repo", "revision", F.col("file_path").alias("path"), F.left("content", F.floor(F.length("content") / 2).cast("int")).alias("prefix"))
    at = _place(spark, "tasks")
    writers.json_lines(f.coalesce(1), at, "file_id", ["id", "repo", "revision", "path", "prefix"])
    return readers.json_lines(spark, at).select("id", "line_num", "repo", "path", F.md5("prefix").alias("prefix"))


@C.add("SELECT task, context FROM (SELECT file_id AS task, md5(coalesce(content, '')) AS context FROM source_files)")
def src_predictions(spark, d):
    """Contexts as JSON lines in order, with a second part appended."""
    f = table(spark, d, "source_files").select(F.col("file_id").alias("task"), F.coalesce("content", F.lit("")).alias("context"))
    at = _place(spark, "predictions")
    writers.json_lines(f.where("task % 2 = 0"), at, "task", ["task", "context"])
    writers.json_lines(f.where("task % 2 = 1"), at, "task", ["task", "context"], append=True)
    return spark.read.schema("task long, context string").json(at).select("task", F.md5("context").alias("context"))


@C.add("SELECT file_id || '/' || file_path AS path, md5(content) AS content FROM source_files WHERE content IS NOT NULL AND file_path LIKE '%.py' AND NOT list_contains(string_split(file_path, '/'), 'vendor')")
def src_archives(spark, d):
    """ZIP archives of up to two hundred files under one top folder."""

    def zipped(batches):
        for b in batches:
            out = []
            for name, files in zip(b["name"], b["files"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for f in files:
                        z.writestr(f"top/{f['path']}", f["content"])
                out.append((f"{name}.zip", held.getvalue()))
            yield pd.DataFrame(out, columns=["name", "content"])

    path = F.concat_ws("/", F.col("file_id").cast("string"), "file_path").alias("path")
    f = table(spark, d, "source_files").where("content is not null").select(F.expr("file_id div 200").alias("name"), F.struct(path, "content").alias("f"))
    at = _files(f.groupBy("name").agg(F.collect_list("f").alias("files")).mapInPandas(zipped, "name string, content binary"), "archives")
    return readers.archives(spark, f"{at}/*.zip", excluded=("vendor",)).select("path", F.md5("content").alias("content"))


@C.add("SELECT CAST(file_id AS VARCHAR) AS file, md5(content) AS content FROM source_files WHERE content <> '' AND file_path LIKE '%.py'")
def src_sources(spark, d):
    """Files in folders, found by their ending."""
    ending = F.concat(F.lit("f."), F.element_at(F.split("file_path", r"\."), -1))
    f = table(spark, d, "source_files").select(F.concat_ws("/", F.col("file_id").cast("string"), ending).alias("name"), F.encode("content", "UTF-8").alias("content"))
    read = readers.sources(spark, _files(f, "sources"), "*.py", excluded=("none",))
    return read.select(F.element_at(F.split("path", "/"), -2).alias("file"), F.md5("content").alias("content"))


PLACED = """WITH t AS (SELECT file_id AS id, repo, revision, CASE WHEN file_id % 3 = 0 THEN replace(repo, '/', '_') || '.zip' END AS archive, CASE WHEN file_id % 2 = 0 THEN 'dataset' END AS stage FROM source_files),
 p AS (SELECT DISTINCT 'python-practice/' || replace(repo, '/', '__') || '-' || revision || CASE WHEN file_id % 4 = 0 THEN '.zip' ELSE '' END AS place FROM source_files WHERE file_id % 7 > 0 UNION SELECT DISTINCT 'dataset/' || replace(repo, '/', '_') FROM source_files WHERE file_id % 5 = 0 UNION SELECT DISTINCT 'python-dataset1/' || replace(repo, '/', '_') || '.zip' FROM source_files),
 n AS (SELECT *, coalesce(stage, 'practice') AS st, 'python-' || coalesce(stage, 'practice') || '/' || replace(repo, '/', '__') || '-' || revision AS own, replace(archive, '.zip', '') AS bare FROM t),
 c AS (SELECT id, unnest(CASE WHEN archive <> '' AND st = 'dataset' THEN ['python-dataset/' || bare, 'python-dataset1/' || bare, 'dataset/' || bare, 'python-dataset/' || archive, 'python-dataset1/' || archive, 'dataset/' || archive, own, own || '.zip'] ELSE [own, own || '.zip'] END) AS place,
  generate_subscripts(CASE WHEN archive <> '' AND st = 'dataset' THEN [1, 2, 3, 4, 5, 6, 7, 8] ELSE [1, 2] END, 1) AS k FROM n)"""


@C.add(PLACED + " SELECT t.id, b.place FROM t LEFT JOIN (SELECT id, min_by(place, k) AS place FROM c SEMI JOIN p USING (place) GROUP BY 1) b USING (id)")
def src_located(spark, d):
    f = table(spark, d, "source_files")
    c = F.col
    tasks = f.select(c("file_id").alias("id"), "repo", "revision", F.when(c("file_id") % 3 == 0, F.concat(F.translate("repo", "/", "_"), F.lit(".zip"))).alias("archive"), F.when(c("file_id") % 2 == 0, F.lit("dataset")).alias("stage"))
    own = f.where("file_id % 7 > 0").select(F.concat(F.lit("python-practice/"), F.replace("repo", F.lit("/"), F.lit("__")), F.lit("-"), "revision", F.when(c("file_id") % 4 == 0, F.lit(".zip")).otherwise(F.lit(""))).alias("place"))
    flat = F.translate("repo", "/", "_")
    places = own.union(f.where("file_id % 5 = 0").select(F.concat(F.lit("dataset/"), flat))).union(f.select(F.concat(F.lit("python-dataset1/"), flat, F.lit(".zip"))))
    return readers.located(tasks, places)


@C.add("SELECT id AS file_id FROM (SELECT unnest(string_split('12, 5,7', ',')) AS t, CAST(trim(t) AS BIGINT) AS id) WHERE id IN (SELECT file_id FROM source_files)")
def src_identifiers(spark, d):
    """Files chosen by a list of ids."""
    wanted = spark.createDataFrame([(int(i),) for i in readers.identifiers("12, 5,\n7,\n")], "file_id long")
    return table(spark, d, "source_files").select("file_id").join(wanted, "file_id", "left_semi")


@C.add(f"SELECT CAST(child AS INTEGER) AS child, CAST(parent AS INTEGER) AS parent FROM ({EDGES})")
def src_ontology(spark, d):
    """The parts' hierarchy as OBO files of a thousand stanzas each."""
    name = lambda c: F.concat(F.lit("class_"), c.cast("string"))
    lines = _edges(spark, d).groupBy("child").agg(F.array_join(F.transform(F.sort_array(F.collect_list("parent")), lambda p: F.concat(F.lit("is_a: "), name(p))), "\n").alias("is_a"))
    stanza = F.concat(F.lit("[Term]\nid: "), name(F.col("child")), F.lit("\nname: part\n"), "is_a", F.lit("\n"))
    held = lines.groupBy(F.concat(F.expr("child div 1000").cast("string"), F.lit(".obo")).alias("name")).agg(F.encode(F.concat(F.lit("format-version: 1.2\n\n"), F.array_join(F.collect_list(stanza), "\n")), "UTF-8").alias("content"))
    read = readers.ontology(spark, f"{_files(held, 'ontology')}/*.obo")
    return read.select(*[readers.class_number(F.col(c)).alias(c) for c in ("child", "parent")])


def _wfdb(spark, d) -> str:
    """A header, a signal file and segments for each record of twelve vectors: 16-bit values, a thousand to the unit."""

    def made(batches):
        for b in batches:
            out = []
            for record, rows in zip(b["record"], b["w"], strict=True):
                grid = np.stack([np.rint(np.asarray(r["samples"], float) * 1000) for r in rows], axis=1).astype("<i2")
                head = [f"{record} {len(rows)} 500 {len(grid)}"] + [f"{record}.dat 16 1000(0)/mV 16 0 0 0 0 {r['lead'].replace('AV', 'aV')}" for r in rows]
                cut = [f'{{"lead_name": "{r["lead"]}", "start_sample": {k}.4, "end_sample": {k + 40}}}' for k, r in enumerate(rows)]
                out += [(f"{record}.hea", "\n".join(head).encode()), (f"{record}.dat", grid.tobytes()), (f"{record}.json", ('{"leads": [' + ", ".join(cut) + "]}").encode())]
            yield pd.DataFrame(out, columns=["name", "content"])

    w = _leads(spark, d).groupBy("record").agg(F.sort_array(F.collect_list(F.struct("vec_id", "lead", "samples"))).alias("w"))
    return _files(w.mapInPandas(made, "name string, content binary"), "wfdb")


WHOLE = "list_sum([CAST(round_even(x::DOUBLE * 1000, 0) AS DOUBLE) for x in embedding]) / 1000"


@C.add(f"SELECT 'r' || vec_id // 12 AS record, {LEADS_SQL} AS lead, round({WHOLE}, 3) AS total FROM embeddings")
def src_signals(spark, d):
    at = _wfdb(spark, d)
    read = readers.signals(spark, f"{at}/*.dat", readers.headers(spark, f"{at}/*.hea"))
    return read.select("record", "lead", F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@C.add(f"SELECT 'r' || vec_id // 12 AS record, {LEADS_SQL} AS lead, CAST(row_number() OVER (PARTITION BY vec_id // 12 ORDER BY vec_id) - 1 AS INTEGER) AS start_sample, CAST(row_number() OVER (PARTITION BY vec_id // 12 ORDER BY vec_id) + 39 AS INTEGER) AS end_sample FROM embeddings")
def src_segments(spark, d):
    return readers.segments(spark, f"{_wfdb(spark, d)}/*.json").select("record", "lead", "start_sample", "end_sample")


@C.add(f"SELECT 'r' || vec_id // 12 AS record, {LEADS_SQL} AS lead, round(list_sum([x::DOUBLE for x in embedding]), 5) AS total FROM embeddings")
def src_npz(spark, d):
    """An NPZ file a record, keys of record and lead; a key without lead and an array of two dimensions are left out."""

    def made(batches):
        for b in batches:
            out = []
            for record, rows in zip(b["record"], b["w"], strict=True):
                held = io.BytesIO()
                np.savez_compressed(held, **{f"{record}_{r['lead']}": np.asarray(r["samples"], np.float32) for r in rows}, other=np.zeros(3), square=np.zeros((2, 2)))
                out.append((f"{record}.npz", held.getvalue()))
            yield pd.DataFrame(out, columns=["name", "content"])

    w = _leads(spark, d).groupBy("record").agg(F.collect_list(F.struct("lead", "samples")).alias("w"))
    read = readers.npz(spark, f"{_files(w.mapInPandas(made, 'name string, content binary'), 'npz')}/*.npz")
    return read.select("record", "lead", F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@C.add("SELECT 'v' || vec_id AS record, CAST(17 + 64 AS INTEGER) AS n_bytes FROM embeddings WHERE label > 2 AND vec_id >= 0")
def src_images(spark, d):
    """Pictures of one row each, without those that are done."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("record"), "label")
    files = v.select(F.concat("record", F.lit(".pgm")).alias("name"), F.concat(F.encode(F.lit("P5 64 000001 255\n"), "UTF-8"), F.unhex(F.repeat(F.lit("80"), 64))).alias("content"))
    read = readers.images(spark, f"{_files(files, 'images')}/*.pgm", done=v.where("label <= 2"))
    return read.select("record", F.length("content").alias("n_bytes"))


@C.add("SELECT DISTINCT left(md5(raw_code), 16) AS key, max(docstring) OVER (PARTITION BY left(md5(raw_code), 16)) AS abstract FROM entities WHERE raw_code IS NOT NULL AND docstring IS NOT NULL")
def src_cache(spark, d):
    """A cache of descriptions, half as JSON files, half as an appended table."""
    e = table(spark, d, "entities").where("raw_code is not null and docstring is not null").groupBy(X.content_key(F.col("raw_code")).alias("key")).agg(F.max("docstring").alias("abstract"))
    first = F.substring("key", 1, 1) < "8"
    files = e.where(first).select(F.concat("key", F.lit(".json")).alias("name"), F.encode(F.to_json(F.struct(F.col("key").alias("code_hash"), "abstract")), "UTF-8").alias("content"))
    held = _place(spark, "cache") + ".parquet"
    removed_at_end(spark, held)
    writers.cache(e.where(~first & (F.substring("key", 2, 1) < "8")), held)
    writers.cache(e.where(~first & (F.substring("key", 2, 1) >= "8")), held)
    return readers.cached_texts(spark, f"{_files(files, 'abstracts')}/*.json").unionByName(readers.cached_texts(spark, held))


@C.add(EDGES_SQL + " SELECT src, dst, relation FROM g")
def src_graph(spark, d):
    listed, at = _listed(spark, d), _place(spark, "graph")
    writers.graph(codegraph.nodes(listed), codegraph.edges(listed), at)
    assert readers.exists(spark, f"{at}/nodes")
    return spark.read.parquet(f"{at}/edges")


@C.add("""SELECT o_orderkey AS mol_id, o_orderpriority AS smiles, CAST(count(*) FILTER (l_returnflag = 'A') > 0 AS INTEGER) AS "A", CAST(count(*) FILTER (l_returnflag = 'N') > 0 AS INTEGER) AS "N" FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def src_wide_labels(spark, d):
    at = _place(spark, "labels")
    labels = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mol_id"), F.col("l_returnflag").alias("cls"), F.lit(1).alias("label"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("mol_id"), F.col("o_orderpriority").alias("smiles"))
    writers.wide_labels(labels, rows, ["mol_id", "smiles"], ["A", "N"], at)
    return readers.optional_parquet(spark, at)


@C.add("SELECT 'weather_cache' AS name, TRUE AS found UNION ALL SELECT 'no_such_table', FALSE")
def src_optional(spark, d):
    names = ["weather_cache", "no_such_table"]
    return spark.createDataFrame([(n, readers.optional_parquet(spark, f"{d}/{n}.parquet") is not None) for n in names], "name string, found boolean")


@C.add("SELECT o_orderkey, o_totalprice FROM orders")
def stream_resumed(spark, d):
    """Orders that arrive in two lots; each run takes on what is new, and no order is lost or doubled."""
    source, out, checkpoint = (_place(spark, n) for n in ("arriving", "resumed", "checkpoint"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for lot in (0, 1):
        orders.where(F.col("o_orderkey") % 2 == lot).write.mode("append").parquet(source)
        incremental.resumed(incremental.arriving(spark, source, orders.schema), lambda df: df.where("o_orderkey is not null"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("o_orderkey", "o_totalprice")


@C.add("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def stream_only_new(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental.only_new(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")

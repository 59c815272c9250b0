"""Readers: delimited text, JSON lines, archives, ontologies, waveform files, optional tables. Plans are built only after a check that inputs exist."""

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.signals import ALIASES, lead_of, record_of

TASK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "repo", "revision", "path", "prefix", "suffix", "archive", "stage")] + [T.StructField("modified", T.ArrayType(T.StringType()))]
)
READING = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("deviceId", "timedate", "period")] + [T.StructField("x2", T.DoubleType()), T.StructField("x3", T.DoubleType()), T.StructField("deviceType", T.StringType())] + [T.StructField(f"t{i}", T.DoubleType()) for i in range(1, 14)]
)
DEVICE = T.StructType([T.StructField("deviceId", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has any file, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def required(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, read by column name with the given types; entries that don't fit and empty texts are null.

    Files are read by position, so the header's order is looked up first; columns that the file lacks are null.
    multi_line: quoted texts may have line breaks. A file then isn't split, and a quote that is never closed takes the rest of
    it; ``writers.csv`` closes all and writes as many files as its sort has partitions.
    """
    required(spark, path)
    header = spark.read.csv(path, header=True).columns
    kinds = {f.name: f.dataType for f in schema.fields}
    full = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    df = spark.read.csv(path, header=True, schema=full, enforceSchema=True, mode="PERMISSIVE", multiLine=multi_line)
    return df.select([F.col(f"`{c}`") if c in header else F.lit(None).cast(kinds[c]).alias(c) for c in columns or [f.name for f in schema.fields]])


def optional_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    return spark.read.parquet(path) if exists(spark, path) else None


def json_lines(spark: SparkSession, path: str, schema: T.StructType = TASK, default_id: str = "task_") -> DataFrame:
    """Tasks, one a line, with ``line_num`` from 0 in its file and an ``id`` for lines without one. A line that is no JSON fails the

    read; blank lines count but give no row. Files are read in splits: lines are numbered within a split and offset by
    the splits of the file before, one short row a split.
    """
    required(spark, path)
    # Within a partition rows come in the order of the file, split by split.
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__row"), "value")
    splits = at.groupBy("__file", "__split").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy("__file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("__file").alias("__f"), F.col("__split").alias("__s"), (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first")).alias("__add"))
    lines = at.join(splits, (F.col("__file") == F.col("__f")) & (F.col("__split") == F.col("__s"))).select((F.col("__row") + F.col("__add")).cast("int").alias("line_num"), F.col("value").alias("line")).where("trim(line) <> ''")
    parsed = lines.select("line_num", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("t")).select("line_num", "t.*")
    if "id" in schema.names:
        parsed = parsed.withColumn("id", F.coalesce("id", F.concat(F.lit(default_id), F.col("line_num").cast("string"))))
    return parsed


def identifiers(text: str) -> list[str]:
    """Ids from a list with commas or line breaks."""
    return [p.strip() for p in text.replace("\n", ",").split(",") if p.strip()]


def archives(spark: SparkSession, path: str, suffix: str = ".py", excluded: tuple[str, ...] = ()) -> DataFrame:
    """(archive, path, content): the text files in ZIP archives with a suffix, read in memory; undecodable bytes are replaced.

    path lacks the archive's single top directory. Files under an excluded directory name are left out, and so are
    archives that can't be opened.
    """
    required(spark, path)
    zips = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b["archive"], b["content"], strict=True):
                try:
                    held = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                names = [n for n in held.namelist() if not n.endswith("/")]
                tops = {n.split("/", 1)[0] for n in names}
                cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
                for n in names:
                    inner = n[cut:]
                    if inner.endswith(suffix) and not set(inner.split("/")) & set(excluded):
                        out.append((name, inner, held.read(n).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["archive", "path", "content"])

    return zips.mapInPandas(run, "archive string, path string, content string")


def sources(spark: SparkSession, path: str, pattern: str = "*.py", excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of text files below a directory, without those under an excluded name; files of no bytes give no row."""
    required(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = files.select("path", F.expr("decode(content, 'UTF-8')").alias("content")) if not spark.conf.get("spark.sql.ansi.enabled", "true") == "true" else files.select("path", _replaced(F.col("content")).alias("content"))
    return text.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded]))) if excluded else text


def _replaced(content: Column) -> Column:
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", "replace"), na_action="ignore")

    return F.pandas_udf(decode, "string")(content)


# The folders that archives of the dataset stage may be in, in order.
DATASET_FOLDERS = ["python-dataset", "python-dataset1", "dataset"]


def candidates(archive: Column, stage: Column, repo: Column, revision: Column) -> Column:
    """Where a task's repository may be, best first: for the dataset stage the archive's folder, then the archive, in each of

    DATASET_FOLDERS; then the folder and the archive of the repository's name and revision in the stage's folder."""
    named = F.concat(F.lit("python-"), stage, F.lit("/"), F.replace(repo, F.lit("/"), F.lit("__")), F.lit("-"), revision)
    bare = F.replace(archive, F.lit(".zip"), F.lit(""))
    sets = F.array(*[F.concat(F.lit(f"{d}/"), bare) for d in DATASET_FOLDERS], *[F.concat(F.lit(f"{d}/"), archive) for d in DATASET_FOLDERS])
    own = F.array(named, F.concat(named, F.lit(".zip")))
    return F.when((archive != "") & (stage == "dataset"), F.concat(sets, own)).otherwise(own)


def located(tasks: DataFrame, places: DataFrame, stage: str = "practice") -> DataFrame:
    """(id, place): for each task (id, repo, revision, archive, stage) the first of its candidates among the places (place) that are

    there, null where none is. Tasks without a stage are of ``stage``. One equi-join; the choice is an aggregate.
    """
    there = places.select(F.col("place").alias("__there")).where("__there is not null").distinct()
    tried = tasks.select("id", F.posexplode_outer(candidates(F.col("archive"), F.coalesce("stage", F.lit(stage)), F.col("repo"), F.col("revision"))).alias("__k", "__c"))
    best = tried.join(there, F.col("__c") == F.col("__there"), "left").groupBy("id").agg(F.min(F.when(F.col("__there").isNotNull(), F.struct("__k", "__there"))).alias("b"))
    return best.select("id", F.col("b.__there").alias("place"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent): the is_a lines of an OBO file's stanzas, ids up to the first blank."""
    required(spark, path)
    stanzas = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n(?=\[)")).alias("s"))
    child = F.regexp_extract("s", r"(?m)^\s*id: (\S+)", 1)
    parents = F.regexp_extract_all("s", F.lit(r"(?m)^\s*is_a: (\S+)"), F.lit(1))
    return stanzas.where(child != "").select(child.alias("child"), F.explode(parents).alias("parent"))


def class_number(name: Column, prefix: str = "class_") -> Column:
    """The number in ``class_N``; null for other names."""
    return F.when(name.rlike(f"^{prefix}\\d+$"), F.substring(name, len(prefix) + 1, 9).cast("int"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(record, n_leads, fs, n_samples, place, gain, baseline, lead): one row a lead of WFDB header files."""
    required(spark, path)
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    head = F.split(F.trim(F.get("l", F.lit(0))), r"\s+")
    rows = text.select(F.get(head, F.lit(0)).alias("record"), F.get(head, F.lit(1)).cast("int").alias("n_leads"), F.get(head, F.lit(2)).cast("double").alias("fs"), F.get(head, F.lit(3)).cast("int").alias("n_samples"), "l")
    leads = rows.select("record", "n_leads", "fs", "n_samples", F.posexplode(F.slice("l", F.lit(2), F.col("n_leads"))).alias("place", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    third = F.get(parts, F.lit(2))
    alias = F.coalesce(*[F.when(F.element_at(parts, -1) == a, F.lit(b)) for a, b in ALIASES.items()], F.element_at(parts, -1))
    return leads.select("record", "n_leads", "fs", "n_samples", "place", F.regexp_extract(third, r"^([^(]+)\(", 1).cast("double").alias("gain"), F.regexp_extract(third, r"\(([^)]+)\)", 1).cast("double").alias("baseline"), alias.alias("lead"))


def signals(spark: SparkSession, path: str, header: DataFrame) -> DataFrame:
    """(record, lead, samples): 16-bit little-endian interleaved files, as (raw - baseline) / gain. A file of another size than its header says raises."""
    required(spark, path)
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.dat$", 1).alias("record"), "content")
    leads = header.groupBy("record").agg(F.max("n_samples").alias("n_samples"), F.sort_array(F.collect_list(F.struct("place", "gain", "baseline", "lead"))).alias("leads"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for record, content, n, info in zip(b["record"], b["content"], b["n_samples"], b["leads"], strict=True):
                x = np.frombuffer(content, "<i2")
                if x.size != n * len(info):
                    raise ValueError(f"{record}.dat: {x.size} values, expected {n * len(info)}")
                grid = x.reshape(int(n), len(info)).astype(np.float32)
                out += [(record, i["lead"], ((grid[:, k] - np.float32(i["baseline"])) / np.float32(i["gain"])).tolist()) for k, i in enumerate(info)]
            yield pd.DataFrame(out, columns=["record", "lead", "samples"])

    return raw.join(leads, "record").mapInPandas(run, "record string, lead string, samples array<float>")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(record, lead, place, start_sample, end_sample) from JSON files with ``leads``; numbers rounded half to even."""
    required(spark, path)
    kind = "leads array<struct<lead_name:string,start_sample:double,end_sample:double>>"
    j = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("record"), F.from_json(F.col("content").cast("string"), kind).alias("j"))
    rows = j.select("record", F.posexplode("j.leads").alias("place", "x"))
    alias = F.coalesce(*[F.when(F.col("x.lead_name") == a, F.lit(b)) for a, b in ALIASES.items()], F.col("x.lead_name"))
    return rows.select("record", alias.alias("lead"), "place", F.bround("x.start_sample").cast("int").alias("start_sample"), F.bround("x.end_sample").cast("int").alias("end_sample"))


def npz(spark: SparkSession, path: str) -> DataFrame:
    """(record, lead, samples) of NPZ files with keys ``record_LEAD``; other keys and arrays that aren't 1-D are left out."""
    required(spark, path)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                held = np.load(io.BytesIO(content))
                out += [(k, held[k].astype(np.float32).tolist()) for k in held.files if held[k].ndim == 1]
            yield pd.DataFrame(out, columns=["key", "samples"])

    keyed = files.mapInPandas(run, "key string, samples array<float>")
    return keyed.select(record_of(F.col("key")).alias("record"), lead_of(F.col("key")).alias("lead"), "samples").where("record is not null and lead is not null")


def images(spark: SparkSession, path: str, limit: int = 0, done: DataFrame | None = None) -> DataFrame:
    """(path, record, content) of image files in the order of their paths, the first ``limit`` (0: all), without records in ``done``."""
    required(spark, path)
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("record"), "content")
    if limit:
        first = files.select("path").orderBy("path").limit(limit)
        files = files.join(first, "path", "left_semi")
    return files.join(done.select("record"), "record", "left_anti") if done is not None else files


def cached_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, abstract) of a cache of JSON files or a Parquet table."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("key", "abstract")
    required(spark, path)
    j = spark.read.format("binaryFile").load(path).select(F.from_json(F.col("content").cast("string"), "code_hash string, abstract string").alias("j"))
    return j.select(F.col("j.code_hash").alias("key"), "j.abstract")


"""Readers and writers by round trips, and the incremental runs."""

import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.plans import files
from millrace.sources import comparison, python_code, readers, writers
from millrace.streaming import incremental
from tests.oracle import connection


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "d.csv").write_text("longitude,deviceId,latitude,other\n2.5,a,1.5,x\n,b,bad,y\n")
    got = readers.csv(spark, str(tmp_path / "d.csv"), readers.DEVICE).orderBy("deviceId").collect()
    assert got == [("a", 1.5, 2.5), ("b", None, None)]
    with pytest.raises(FileNotFoundError):
        readers.csv(spark, str(tmp_path / "none.csv"), readers.DEVICE)
    assert readers.optional_parquet(spark, str(tmp_path / "none.parquet")) is None


def test_csv_texts_and_numbers_return(spark, tmp_path):
    """Line breaks, quotes and escapes in texts, and numbers that aren't finite, are the same as by the query's SQL; NaN isn't null."""
    texts = ["a\nb", "\r\n", "\r", 'x"\n"', "\\\n", '"', ',\\', ' a ', "", None]
    numbers = [float("nan"), None, float("inf"), -0.0, 5e-324]
    rows = [(i, t, t, "train", numbers[i % 5], numbers[i // 2 % 5]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "reading_id long, deviceId string, timedate string, period string, x2 double, t4 double").write.parquet(str(tmp_path / "device_data.parquet"))
    got = files.C.queries["src_csv"](spark, str(tmp_path)).collect()
    want = connection(str(tmp_path)).sql(files.C.sql["src_csv"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_json_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"id": "x", "prefix": "a"}\n\n{"repo": "r", "modified": ["m"]}\n')
    got = readers.json_lines(spark, str(p)).orderBy("line_num").collect()
    assert [(r.line_num, r.id) for r in got] == [(0, "x"), (2, "task_2")] and got[1].modified == ["m"]
    writers.json_lines(readers.json_lines(spark, str(p)).select("line_num", F.lit("c").alias("context")), str(tmp_path / "out"), "line_num", ["context"])
    lines = [ln for f in sorted((tmp_path / "out").glob("part*")) for ln in f.read_text().splitlines()]
    assert [json.loads(ln) for ln in lines] == [{"context": "c"}] * 2
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p)).collect()


def test_archives_and_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "o__r-1.zip", "w") as z:
        z.writestr("top/a.py", "x = 1\n")
        z.writestr("top/venv/b.py", "y")
        z.writestr("top/c.txt", "z")
    (tmp_path / "bad.zip").write_bytes(b"no")
    assert readers.archives(spark, str(tmp_path / "*.zip"), excluded=("venv",)).collect() == [("o__r-1.zip", "a.py", "x = 1\n")]
    (tmp_path / "s" / "deep").mkdir(parents=True)
    (tmp_path / "s" / "deep" / "m.py").write_bytes(b"caf\xe9")
    assert [r.content for r in readers.sources(spark, str(tmp_path / "s")).collect()] == ["caf�"]


def test_ontology(spark, tmp_path):
    (tmp_path / "o.obo").write_text("format-version: 1\n\n[Term]\nid: class_0\nname: root\n\n[Term]\nid: class_2 ! x\nis_a: class_0 ! root\nis_a: class_1\n\n[Typedef]\nname: y\n")
    got = readers.ontology(spark, str(tmp_path / "o.obo"))
    assert {tuple(r) for r in got.collect()} == {("class_2", "class_0"), ("class_2", "class_1")}
    assert {r.n for r in got.select(readers.class_number(F.col("parent")).alias("n")).collect()} == {0, 1}


def test_waveform_files(spark, tmp_path):
    (tmp_path / "rec.hea").write_text("rec 2 500 3\nrec.dat 16 200(10)/mV 16 0 0 0 0 I\nrec.dat 16 100(0)/mV 16 0 0 0 0 aVR\n")
    (tmp_path / "rec.dat").write_bytes(struct.pack("<6h", 210, 100, 410, 200, 10, -100))
    (tmp_path / "rec.json").write_text(json.dumps({"leads": [{"lead_name": "I", "start_sample": 0.5, "end_sample": 2.5}, {"lead_name": "I", "start_sample": 9, "end_sample": 9}]}))
    header = readers.headers(spark, str(tmp_path / "*.hea"))
    assert [(r.lead, r.gain, r.baseline, r.fs) for r in header.orderBy("place").collect()] == [("I", 200.0, 10.0, 500.0), ("AVR", 100.0, 0.0, 500.0)]
    waves = {r.lead: r.samples for r in readers.signals(spark, str(tmp_path / "*.dat"), header).collect()}
    assert waves == {"I": [1.0, 2.0, 0.0], "AVR": [1.0, 2.0, -1.0]}
    assert [(r.start_sample, r.end_sample) for r in readers.segments(spark, str(tmp_path / "*.json")).orderBy("place").collect()] == [(0, 2), (9, 9)]
    (tmp_path / "rec.dat").write_bytes(b"12")
    with pytest.raises(Exception, match="expected 6"):
        readers.signals(spark, str(tmp_path / "*.dat"), header).collect()


def test_npz_round_trip(spark, tmp_path):
    waves = spark.createDataFrame([("r1", "I", [0.5, 1.0]), ("r1", "V1", [2.0])], "record string, lead string, samples array<float>")
    assert writers.npz(waves, str(tmp_path / "w.npz")) == 2
    assert np.load(tmp_path / "w.npz")["r1_I"].dtype == np.float16
    assert {(r.record, r.lead): r.samples for r in readers.npz(spark, str(tmp_path / "*.npz")).collect()} == {("r1", "I"): [0.5, 1.0], ("r1", "V1"): [2.0]}


def test_against_truth(spark, tmp_path):
    (tmp_path / "rec.hea").write_text("rec 1 500 4\nrec.dat 16 100(0)/mV 16 0 0 0 0 I\n")
    (tmp_path / "rec.dat").write_bytes(struct.pack("<4h", 0, 100, 200, 300))
    (tmp_path / "rec.json").write_text(json.dumps({"leads": [{"lead_name": "I", "start_sample": 0, "end_sample": 4}]}))
    np.savez(tmp_path / "p.npz", rec_I=np.array([0, 1, 2, 4], np.float32), rec_V9=np.zeros(3), other=np.zeros(2))
    paths = [str(tmp_path / f"*.{x}") for x in ("npz", "hea", "dat", "json")]
    got = comparison.against_truth(spark, *paths).collect()
    assert [(r.record, r.lead, r.mae, r.gt_max) for r in got] == [("rec", "I", 0.25, 3.0)] and got[0].corr > 0.97


def test_wide_labels_and_graph(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "C"), ("m2", "O")], "mol_id string, smiles string")
    labels = spark.createDataFrame([("m1", "class_1", 1)], "mol_id string, cls string, label int")
    writers.wide_labels(labels, rows, ["mol_id", "smiles"], ["class_0", "class_1"], str(tmp_path / "s"))
    assert sorted(spark.read.parquet(str(tmp_path / "s")).collect()) == [("m1", "C", 0, 1), ("m2", "O", 0, 0)]
    writers.cache(spark.createDataFrame([("k", "a")], "key string, abstract string"), str(tmp_path / "c.parquet"))
    assert readers.cached_texts(spark, str(tmp_path / "c.parquet")).collect() == [("k", "a")]


CODE = '''"""Module."""
import os, sys as system
from a.b import c as d
from . import e

def outer(x: int, *args, y=1, **kw) -> str:
    """Doc."""
    def inner():
        return helper(x)
    return self.run(inner())

class K(Base, mod.Other):
    def m(self): pass
    async def skipped(self): pass

async def also_skipped(): pass
'''


def test_python_entities_and_imports(spark):
    got = python_code.entities_of(CODE)
    assert [(e["name"], e["type"], e["parent"]) for e in got] == [("outer", "function", None), ("K", "class", None), ("m", "method", "K")]
    assert got[0]["signature"] == "def outer(x: int, *args, **kw) -> str" and got[0]["dependencies"] == ["helper", "inner", "self.run"] and got[1]["signature"] == "class K(Base, mod.Other)"
    assert [(i["type"], i["module"], i["full_name"], i["level"]) for i in python_code.imports_of(CODE)] == [("import", "os", "os", 0), ("import", "sys", "system", 0), ("from", "a.b", "d", 0), ("from", "", "e", 1)]
    assert python_code.entities_of("def broken(") == [] and python_code.imports_of(None) == []
    df = spark.createDataFrame([(1, CODE), (2, None), (3, "x = (")], "id int, content string")
    assert python_code.entities(df, ["id"]).count() == 3 and python_code.imports(df, ["id"]).count() == 4


def test_incremental(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).write.mode("append").parquet(src)
        stream = incremental.arriving(spark, src, spark.read.parquet(src).schema)
        incremental.resumed(stream, lambda df: df.withColumn("twice", F.col("id") * 2), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == (k + 1) * 5
    done = spark.read.parquet(out).where("id < 9")
    assert [r.id for r in incremental.only_new(spark.range(10), done, "id").collect()] == [9]


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "b"), ("2024-01-01 01:00:00", "z")]
    df = spark.createDataFrame(rows, "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "e"))
    stream = incremental.windowed_counts(incremental.arriving(spark, str(tmp_path / "e"), df.schema), "t", "k", "5 minutes", "10 minutes")
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.n) for r in spark.sql("select k, n from counts").collect()} == {("a", 2), ("b", 1), ("z", 1)}

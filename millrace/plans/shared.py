"""Tables written to the folder that all executors share, to cut lineage or to read a result more than once."""

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list] = []


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset a local one is made for a local master; a cluster

    without it raises, as its workers wouldn't find one another's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; it is deleted when the driver ends.

    Unlike a cached frame it outlives executors, and unlike checkpoint() it is columnar and compressed.
    """
    spark = df.sparkSession
    path = os.path.join(folder(spark), "millrace", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Has a path deleted when the driver ends, or before, when the innermost ``scratch`` ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _scopes:
        _scopes[-1].append(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were written in its block when that ends, for long sessions: results must be consumed within it."""
    _scopes.append([])
    try:
        yield
    finally:
        for at in _scopes.pop():
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def once(name: str, make: Callable[[], Any]) -> Any:
    """What make() gives, made once a process: functions sent to workers lose their modules' state with every task."""
    held = sys.__dict__.setdefault("_millrace", {})
    if name not in held:
        held[name] = make()
    return held[name]

"""Writers: Parquet and CSV results, JSON lines in input order, NPZ export, append-only caches."""

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.multilabel import to_wide


def wide_labels(labels: DataFrame, rows: DataFrame, key: list[str], classes: list[str], path: str) -> None:
    """Parquet: key columns of ``rows`` and one 0/1 column a class, 0 where labels (key[0], cls, label) have none."""
    wide = to_wide(labels, [key[0]], classes)
    rows.select(*key).join(wide, key[0], "left").select(*key, *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in classes]).write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """CSV with a header, in order; one file only where it is asked for, as that takes one task."""
    ordered = df.repartition(1).sortWithinPartitions(*order) if one_file else df.orderBy(*order)
    ordered.write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_lines(df: DataFrame, path: str, order: str, columns: list[str], append: bool = False) -> None:
    """One JSON object a line, in the order of a column: part files follow each other in that order."""
    lines = df.orderBy(order).select(F.to_json(F.struct(*columns)).alias("value"))
    lines.write.mode("append" if append else "overwrite").text(path)


def npz(waves: DataFrame, path: str) -> int:
    """A compressed NPZ of float16 arrays, key ``record_LEAD``; returns their number.

    An export for one reader: waves come to the driver one by one and go straight into the file, so memory holds one.
    """
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for row in waves.select("record", "lead", "samples").toLocalIterator():
            held = io.BytesIO()
            np.save(held, np.asarray(row["samples"], np.float16))
            out.writestr(f"{row['record']}_{row['lead']}.npy", held.getvalue())
            n += 1
    return n


def binaries(df: DataFrame, path: str) -> None:
    """One file a row (name, content) below a path, written by the tasks; names may hold folders. A repeated task overwrites its files.

    path: with the scheme of a file system that all executors reach and pyarrow knows. Null names or contents write nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                at = f"{root}/{name}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(b)]})

    df.where("name is not null and content is not null").select(F.col("name").cast("string"), F.col("content").cast("binary")).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables below a path; read back with ``spark.read.parquet``."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def cache(df: DataFrame, path: str) -> None:
    """Appends (key, abstract) to a Parquet cache."""
    df.select("key", "abstract").write.mode("append").parquet(path)

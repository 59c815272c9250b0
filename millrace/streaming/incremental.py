"""Incremental runs, beyond the batch operators: new files or rows only, exactly once, by Structured Streaming."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """The rows of Parquet files as they appear in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def resumed(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on what is new since the last run and appends the result; ends when all is done.

    The checkpoint holds what was done, so a run that broke off is resumed without losing or doubling output: each batch has its
    own directory, which a repeated batch overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """(window start, by, n): tumbling windows with a watermark; rows later than ``late`` are left out."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def only_new(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Batch form: the inputs whose key isn't among the outputs yet."""
    return inputs.join(done.select(F.col(key).alias("__done")).distinct(), F.col(key) == F.col("__done"), "left_anti")

"""The tables of a data directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a directory, with its own schema; missing tables raise before a plan is built."""
    return spark.read.parquet(f"{directory}/{name}.parquet")

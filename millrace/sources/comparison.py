"""Predicted waveforms against recorded ones, from their files."""

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import signals
from millrace.sources import readers


def against_truth(spark: SparkSession, predictions: str, header: str, data: str, segments: str) -> DataFrame:
    """(record, lead, mae, rmse, corr, ...) for NPZ predictions and WFDB records with JSON segments; paths may be globs.

    Leads that either side lacks are left out; ``signals.summary`` gives the means.
    """
    heads = readers.headers(spark, header)
    return signals.metrics(signals.pairs(readers.npz(spark, predictions), readers.signals(spark, data, heads), readers.segments(spark, segments)), ["record", "lead"])

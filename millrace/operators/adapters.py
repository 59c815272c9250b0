"""Where a step needs a library or service that isn't part of this engine: protocols, the defaults there are, and a clear error."""

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MissingAdapter(RuntimeError):
    """A step has no default; an adapter must be given."""


class Embedder(Protocol):
    """Texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Corrector(Protocol):
    """A batch of waveforms (n, samples) to corrected ones."""

    def __call__(self, waves: np.ndarray) -> np.ndarray: ...


class Fingerprinter(Protocol):
    """Molecule texts to a feature matrix."""

    def __call__(self, smiles: list[str]) -> np.ndarray: ...


class Summariser(Protocol):
    """Code to a short description, such as by a language model."""

    def __call__(self, code: str) -> str: ...


def need(adapter: object | None, what: str) -> None:
    if adapter is None:
        raise MissingAdapter(f"{what} needs an adapter: none of the libraries for it is part of this engine")


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder] | None, name: str = "embedding") -> DataFrame:
    """df with a vector a text; ``make`` builds the embedder once a task. Null texts have none."""
    need(make, "embedding text")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for texts in batches:
            known = texts.notna().to_numpy()
            vectors = iter(np.asarray(embed(texts[known].tolist()), np.float32).tolist() if known.any() else [])
            yield pd.Series([next(vectors) if k else None for k in known], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(run, "array<float>")(F.col(text)))


def corrected(waves: DataFrame, make: Callable[[], Corrector] | None, samples: int = 1_250) -> DataFrame:
    """Waves (record, lead, samples) of the right length corrected, others passed through."""
    need(make, "correcting waveforms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        correct = make()
        for b in batches:
            right = b["samples"].map(len).to_numpy() == samples
            if right.any():
                b.loc[right, "samples"] = pd.Series(list(np.asarray(correct(np.stack(b["samples"][right])), np.float32)), index=b.index[right])
            yield b

    return waves.select("record", "lead", "samples").mapInPandas(run, "record string, lead string, samples array<float>")


def hashed_ngrams(text: Column, n: int = 3, dimension: int = 2_048) -> Column:
    """A stand-in for chemical fingerprints: counts of character n-grams in hash buckets, as a map. Not the same features."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(dimension)).cast("int"))
    return F.aggregate(grams, F.create_map().cast("map<int,int>"), lambda m, g: F.map_zip_with(m, F.map_from_arrays(F.array(g), F.array(F.lit(1))), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))


def fingerprints(df: DataFrame, text: str, make: Callable[[], Fingerprinter] | None, name: str = "features") -> DataFrame:
    need(make, "chemical fingerprints")
    return embedded(df, text, make, name)


def summarised(df: DataFrame, code: str, known: DataFrame, make: Callable[[], Summariser] | None, name: str = "abstract") -> DataFrame:
    """df with a description a code: from ``known`` (key, abstract) by content, else from the adapter; without one, null."""
    key = F.left(F.md5(F.col(code)), F.lit(16))
    joined = df.withColumn("__key", key).join(known.select(F.col("key").alias("__k"), F.col("abstract").alias(name)), F.col("__key") == F.col("__k"), "left").drop("__k")
    if make is None:
        return joined.drop("__key")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        write = make()
        for codes in batches:
            yield codes.map(write, na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    fresh = F.pandas_udf(run, "string")(F.when(F.col(name).isNull(), F.col(code)))
    return joined.withColumn(name, F.coalesce(name, fresh)).drop("__key")

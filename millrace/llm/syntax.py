"""Source files that are no valid source of the language that their extension names."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.gll import accepts, furthest
from millrace.llm.grammars import grammar
from millrace.llm.lexers import LEXERS

# Extensions of the supported languages.
EXTENSIONS = {
    "py": "python",
    "pyi": "python",
    "pyw": "python",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "java": "java",
    "go": "go",
}


def language_of(path: Column) -> Column:
    """The language that a path's extension names (in any case; either separator), else null."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(extension.isin([e for e, x in EXTENSIONS.items() if x == language]), F.lit(language)) for language in sorted(set(EXTENSIONS.values()))])


def dialect(text: str, language: str) -> str | None:
    """The first dialect of the language that accepts the whole text, or None. An empty text is valid."""
    if not text.strip("﻿ \t\r\n\f"):
        return "empty"
    tokens = LEXERS[language](text)
    return accepts(grammar(language), *tokens) if tokens else None


def share_accepted(text: str, language: str) -> float:
    """How far the tokens of a rejected text are accepted, as a share; 0 if it cannot be cut into tokens."""
    tokens = LEXERS[language](text)
    return furthest(grammar(language), *tokens) / max(len(tokens[0]), 1) if tokens else 0.0


def checked(files: DataFrame, *, file: str = "file_id", path: str = "file_path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, *keep, language, valid, dialect, accepted): one row per file of a supported extension.

    language is that of the extension; dialect is the one that accepts the file, null if every dialect rejects it, and
    accepted is then the share of its tokens before the first that no dialect accepts. Empty files and files without
    functions are valid; null content is not judged and gives no row, nor does another or missing extension. Each row is
    parsed whole and by itself; equal rows give equal results.
    """
    rows = files.select(file, *keep, language_of(F.col(path)).alias("__language"), F.col(content).alias("__content")).where("__language is not null and __content is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [dialect(t, x) for t, x in zip(b["__content"], b["__language"], strict=True)]
            b = b.assign(language=b["__language"], valid=[d is not None for d in found], dialect=found)
            b["accepted"] = [1.0 if d else share_accepted(t, x) for d, t, x in zip(found, b["__content"], b["__language"], strict=True)]
            yield b.drop(columns=["__content", "__language"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c not in ("__language", "__content"))
    return rows.mapInPandas(run, f"{kinds}, language string, valid boolean, dialect string, accepted double")


def rates(judged: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_files, n_invalid, rate): the share of rejected files per group, such as repository and language."""
    bad = F.sum(F.when(F.col("valid"), 0).otherwise(1)).cast("long")
    return judged.groupBy(*by).agg(F.count("*").alias("n_files"), bad.alias("n_invalid"), (bad / F.count("*")).alias("rate"))

"""Functions and methods paired with their documentation."""

import re
from collections.abc import Iterator
from inspect import cleandoc

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.docwords import says_something
from millrace.llm.islands import Water, at_line, cleaned
from millrace.llm.syntax import language_of


def paired(entities: DataFrame, files: DataFrame, *, only_documented: bool = True) -> DataFrame:
    """(file_id, name, line_start, language, signature, documentation, code, documented): each listed function or method once.

    entities: file_id, name, type, line_start, signature, raw_code, docstring; files: file_id, file_path, content. Classes
    and other types are left out; so are rows without file_id, name or line_start. The identity is (file_id, name,
    line_start); of several listings the first non-blank value counts, the smallest if they differ.

    documentation: that of the island which the file's language grammar finds on the line, without its delimiters; else the
    listed docstring, else that of the island in raw_code. Code and signature are as listed, else the island's.
    In damaged files, where a text left open hides the rest, the island is parsed from its own line on. Entities whose
    file is missing have their listing only. only_documented keeps those whose documentation says what the code does.

    A file goes to the entities' side once, with all its lines to find, so its content is shuffled once.
    """
    filled = lambda c: F.min(F.when(F.trim(F.col(c)) != "", F.col(c))).alias(c)
    listed = entities.where(F.lower("type").isin("function", "method") & F.col("file_id").isNotNull() & F.col("name").isNotNull() & F.col("line_start").isNotNull())
    listed = listed.groupBy("file_id", "name", "line_start").agg(filled("signature"), filled("raw_code"), filled("docstring"))
    # At most one entry a line and name: bounded by the file itself.
    wanted = listed.groupBy("file_id").agg(F.collect_list(F.struct("name", "line_start", "signature", "raw_code", "docstring")).alias("entities"))
    source = files.where("file_id is not null").select(F.col("file_id").alias("__file"), language_of(F.col("file_path")).alias("language"), "content").dropDuplicates(["__file"])
    rows = wanted.join(source, F.col("file_id") == F.col("__file"), "left").drop("__file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "name", "line_start", "language", "signature", "documentation", "code", "documented"]
        for b in batches:
            out = []
            for file_id, entries, language, content in zip(b["file_id"], b["entities"], b["language"], b["content"], strict=True):
                water = Water(content, language) if content and language else None
                for e in sorted(entries, key=lambda e: e["line_start"]):
                    name, line = e["name"], int(e["line_start"])
                    found = None
                    if water is not None and 1 <= line <= len(water.lines):
                        hidden = water.covered(water.starts[line - 1] + len(water.lines[line - 1]) - len(water.lines[line - 1].lstrip()))
                        found = at_line(Water(content, language, water.starts[line - 1]) if hidden else water, line, name)
                    doc = cleaned(cleandoc(found.doc) if language == "python" else found.doc) if found and found.doc else None
                    doc = doc or cleaned(e["docstring"])
                    if not doc and e["raw_code"] and language == "python":
                        own = at_line(Water(e["raw_code"], language), 1, name)
                        doc = cleaned(own.doc) if own else None
                    code = e["raw_code"] or (found.code if found else None)
                    signature = e["signature"] or (found.signature if found else None)
                    inside = re.search(r"\((.*)\)", signature or "", re.S)
                    out.append((file_id, name, line, language, signature, doc or None, code, says_something(doc, name, inside.group(1) if inside else "")))
            yield pd.DataFrame(out, columns=columns)

    kinds = "file_id long, name string, line_start int, language string, signature string, documentation string, code string, documented boolean"
    result = rows.mapInPandas(run, kinds)
    return result.where("documented") if only_documented else result

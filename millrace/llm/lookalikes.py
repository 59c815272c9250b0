"""Texts that look the same in different characters: one form for comparison, classes, and their canonical members."""

import re
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.shared import once, written

# Greek, Cyrillic, Armenian, Cherokee, Lisu, Coptic and other letters and signs that look like a Latin letter or an ASCII sign.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ν": "v", "ѵ": "v", "ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "Օ": "O", "Ս": "U", "Տ": "S", "օ": "o", "ո": "n", "հ": "h", "ս": "u", "զ": "q", "ց": "g", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "ʼ": "'", "․": ".", "‚": ",", "∕": "/", "⁄": "/", "∶": ":", "ː": ":", "∣": "|", "ǀ": "|", "¸": ",", "˗": "-", "∼": "~", "˜": "~", "Ꞌ": "'", "‧": "·", "∙": "·", "⋅": "·", "∆": "Δ", "∑": "Σ", "∏": "Π",
}
# These are told apart by the eye although compatibility would join them.
_DIFFERENT = {"ſ", "ẛ"}
_BLANKS = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs" and c != " "]
# Blocks with letters and signs of several forms or looks, and with invisible characters.
_RANGES = [
    (0xA0, 0x590), (0x13A0, 0x1400), (0x1D00, 0x2000), (0x2000, 0x2070), (0x20A0, 0x2190), (0x2200, 0x2300), (0x2C80, 0x2D00), (0x3000, 0x3001), (0xA4D0, 0xA500), (0xA720, 0xA800),
    (0xFB00, 0xFB18), (0xFE50, 0xFE70), (0xFF01, 0xFFF0), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0xE0000, 0xE0080),
]
_SAME_FORM = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>"}


def tables() -> tuple[dict[str, str], dict[str, str]]:
    return once("look-alike tables", _tables)


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one to one or none, one to several): what each character becomes in the form for comparison.

    By rule: format and other invisible characters vanish; blanks of all widths but line breaks become one blank; wide,
    narrow, compatibility and font variants become their plain form, but raised, lowered, circled and vulgar fractions
    stay, as they look different; look-alike letters become the Latin one, with their accents.
    """
    single: dict[str, str] = {"\t": " "}
    several: dict[str, str] = {}
    for c in map(chr, [i for a, b in _RANGES for i in range(a, b)]):
        if unicodedata.category(c) in ("Cf", "Mn") and c not in LOOKALIKES:
            if unicodedata.category(c) == "Cf":
                single[c] = ""
            continue
        out = c
        kind = unicodedata.decomposition(c).split(" ")[0]
        if c not in _DIFFERENT and (kind in _SAME_FORM or (kind and not kind.startswith("<"))):
            plain = unicodedata.normalize("NFKC" if kind.startswith("<") else "NFC", c)
            if not any(unicodedata.combining(x) for x in plain) and not (" " in plain and c not in _BLANKS):
                out = plain
        base = unicodedata.normalize("NFD", out) if len(out) == 1 else out
        mapped = "".join(LOOKALIKES.get(x, x) for x in base)
        if mapped != base:
            out = unicodedata.normalize("NFC", mapped)
        if out != c:
            (single if len(out) == 1 else several)[c] = out
    for c in _BLANKS:
        single[c] = " "
    for c in ("​", "‌", "‍", "‎", "‏", "⁠", "⁡", "⁢", "⁣", "⁤", "﻿", "­", "͏", "؜", "᠎", *map(chr, range(0x202A, 0x202F)), *map(chr, range(0x2066, 0x2070)), *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))):
        single[c] = ""
    return single, several


def _bare() -> dict[str, str]:
    """Letters with accents to letters without, after tables(): for a key that all members of a class share."""
    out = {}
    for c in map(chr, [i for a, b in [*_RANGES, (0x300, 0x370)] for i in range(a, b)]):
        if unicodedata.category(c) == "Mn":
            out[c] = ""
        else:
            d = unicodedata.normalize("NFD", c)
            if len(d) > 1:
                out[c] = LOOKALIKES.get(d[0], d[0])
    return out


def form(text: str) -> str:
    """The text in the form for comparison: mapped by ``tables``, with composed accents."""
    if text.isascii():
        return text.replace("\t", " ")
    # Few characters change, which a search finds faster than a translation of each.
    changing = once("look-alike search", _changing)
    if not changing.search(text):
        return text
    single, several = tables()
    return unicodedata.normalize("NFC", changing.sub(lambda m: single.get(c := m[0], several.get(c, c)), unicodedata.normalize("NFC", text)))


def changing_pattern() -> str:
    """A class of all characters of the tables but the tab, and of those that composition may change.

    The rare characters beyond the basic plane are one range, as single ones are slow to search for."""
    single, several = tables()
    return "[" + "".join(c if ord(c) > 127 else re.escape(c) for c in sorted({*single, *several} - {"\t"}) if ord(c) < 0x10000) + "\u0300-\u036f\u2126\u212a\u212b\u1100-\u11ff\u3099\u309a\U00010000-\U0010ffff]"


def _changing() -> re.Pattern:
    return re.compile("[\t" + changing_pattern()[1:])


def _accented() -> tuple[Callable[[Callable[[re.Match], str], str], str], Callable[[re.Match], str]]:
    letters = _bare()
    return re.compile("[" + "".join(map(re.escape, letters)) + "]").sub, lambda m: letters[m[0]]


def key_of(text: str) -> bytes:
    """A digest that texts which look the same share: of the form for comparison without accents."""
    bare, letter = once("look-alike accents", _accented)
    return md5(bare(letter, form(text)).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def one_form(text: Column) -> Column:
    """The form for comparison of a column of texts; null stays null."""

    def mapped(texts: pd.Series) -> pd.Series:
        return texts.map(form, na_action="ignore")

    return F.pandas_udf(mapped, "string")(text)


def digests(source: DataFrame) -> DataFrame:
    """(doc, exact, key) of (doc, text): 128-bit digests of the text itself and of its key."""
    kind = dict(source.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            exact = [md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, pa.binary()), pa.array([key_of(t) for t in texts], pa.binary())], names=["doc", "exact", "key"])

    return source.mapInArrow(run, f"doc {kind}, exact binary, key binary")


def classes(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, lookalikes). members: doc, exact (a digest of the text), key, one row per document; lookalikes: class_id,

    exact, key, rep: the texts that share their class with a different text, a row per text; class_id and rep are the
    smallest document of the class and of the text. Every other text is a class of its own copies.

    Copies are reduced first. Only texts whose accent-free key is shared by a different text are mapped and grouped
    under the accent- and case-sensitive Unicode collation, which also holds canonical variants of accents equal.
    Documents with null text or id have no class. Empty texts are one class, with those of invisible characters.
    """
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    members = written(digests(source), "lookalike-members")
    texts = members.groupBy("key", "exact").agg(F.min("doc").alias("rep"))
    shared = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    chosen = texts.join(shared, "key")
    mapped = chosen.join(source, F.col("rep") == F.col("doc")).select("key", "exact", "rep", one_form(F.col("text")).alias("form")).dropDuplicates(["rep"])
    mapped = written(mapped, "lookalike-forms").withColumn("form", F.collate("form", "UNICODE"))
    grouped = mapped.groupBy("key", "form").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = mapped.alias("m").join(grouped.alias("g"), (F.col("m.key") == F.col("g.key")) & (F.col("m.form") == F.col("g.form"))).select("class_id", "m.exact", "m.key", "m.rep")
    return members, written(found, "lookalike-texts")


def canonical(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, class_id, is_canonical): each document with a text, the smallest document that looks the same, joined back."""
    members, found = classes(docs, doc=doc, text=text)
    own = members.groupBy("key", "exact").agg(F.min("doc").alias("rep"))
    known = own.join(found.select("key", "exact", "class_id"), ["key", "exact"], "left").select("key", "exact", F.coalesce("class_id", "rep").alias("class_id"))
    out = members.join(known, ["key", "exact"])
    return out.select(F.col("doc").alias(doc), "class_id", (F.col("doc") == F.col("class_id")).alias("is_canonical"))


def pairs(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), smaller first: the documents of one class with different texts, each pair once.

    Pairs are formed between the different texts of a class, then spread over their copies; texts of large classes and copies
    of hot texts are in several shares, so that no task holds all of one.
    """
    members, found = classes(docs, doc=doc, text=text)
    of_class = found.select("class_id", "exact")
    different = _salted(of_class.select("class_id", F.col("exact").alias("ea")), of_class.select("class_id", F.col("exact").alias("eb")), "class_id", "ea", 1_000).where("ea < eb").select("ea", "eb")
    copies = members.join(found.select("key", "exact"), ["key", "exact"]).select("exact", "doc")
    half = _salted(copies.select(F.col("exact").alias("ea"), F.col("doc").alias("da")), different, "ea", "da", 10_000)
    both = _salted(half.select("eb", "da"), copies.select(F.col("exact").alias("eb"), F.col("doc").alias("db")), "eb", "da", 10_000)
    return both.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b")).distinct()


def _salted(left: DataFrame, right: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """left joined to right on key; a key of more than ``most`` rows of left has them in several shares, by a hash of ``by``,

    to each of which its rows of right go."""
    shares = left.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count("*") / most).cast("int").alias("__shares"))
    own = left.join(shares, F.col(key) == F.col("__key")).withColumn("__share", F.pmod(F.xxhash64(by), F.col("__shares")).cast("int")).drop("__key", "__shares")
    spread = right.join(shares, F.col(key) == F.col("__key")).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__key", "__shares")
    return own.join(spread, [key, "__share"]).drop("__share")


def normalised(docs: DataFrame, *, text: str = "text", out: str = "one_form") -> DataFrame:
    """docs with the text's form for comparison in a further column; null stays null."""
    return docs.withColumn(out, one_form(F.col(text)))


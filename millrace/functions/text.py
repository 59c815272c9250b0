"""Text and code as column expressions: tokens, identifiers, queries, estimates, truncation, style marks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of Python that are no identifiers of interest.
STOP_WORDS = """and as break class cls continue def elif else enumerate except False finally for from if import in is lambda len
None not or pass print raise range return self True try while with yield zip""".split()


# Python's keywords in lower case, and names too common to search for.
KEYWORDS = """and as assert async await break class continue def del elif else except false finally for from global if import in is
lambda none nonlocal not or pass raise return true try while with yield""".split()
KNOWN_NAMES = """self cls print len range enumerate zip super object int str list dict set""".split()


def code_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, camel case and underscores split; null for null."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(split, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)


def space_tokens(text: Column) -> Column:
    """Lower-case runs without white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def identifiers(code: Column) -> Column:
    """ASCII identifiers of two or more characters in order of first use, without STOP_WORDS; case matters.

    Words are taken whole, letters of any script included, so the ASCII rest of a mixed word is no identifier.
    """
    words = F.regexp_extract_all(code, F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[a-zA-Z_][a-zA-Z0-9_]+$") & ~F.array_contains(stop, w)))


def code_identifiers(code: Column) -> Column:
    """Identifiers of Python code outside comments and texts, of two or more characters, in order of first use, without

    keywords and KNOWN_NAMES; case doesn't matter, the first spelling stays. Texts over several lines count as their rows.
    """
    plain = F.regexp_replace(code, r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", " ")
    words = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    known = F.array(*[F.lit(w) for w in [*KEYWORDS, *KNOWN_NAMES]])
    kept = F.filter(words, lambda w: w.rlike(r"^[\p{L}_][\p{L}\p{N}\p{M}_]+$") & ~F.array_contains(known, F.lower(w)))
    lower = F.transform(kept, F.lower)
    return F.filter(kept, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)


def completion_query(prefix: Column, suffix: Column, weight: float = 0.6) -> Column:
    """Search text for a place in a file: identifiers around it, repeated by weight, then the last 10 and next 5 lines.

    The repetitions are whole numbers, int(3 * weight) and int(3 * (1 - weight)).
    """
    before = identifiers(F.right(prefix, F.lit(1000)))
    after = identifiers(F.left(suffix, F.lit(500)))
    lines = F.split(prefix, "\n", -1)
    last = F.slice(lines, F.greatest(F.size(lines) - 9, F.lit(1)), F.lit(10))
    repeated = [before] * int(weight * 3) + [after] * int((1 - weight) * 3)
    return F.array_join(F.concat(*repeated, last, F.slice(F.split(suffix, "\n", -1), 1, 5)), " ")


def lexical_share(query: Column) -> Column:
    """The weight of dense search: .2 for three or more identifier-like places, .4 for any, else .7."""
    n = F.size(F.regexp_extract_all(query, F.lit("[a-z][A-Z]|[A-Z][A-Z][a-z]"), F.lit(0)))
    return F.when(n >= 3, F.lit(0.2)).when(n >= 1, F.lit(0.4)).otherwise(F.lit(0.7))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(3.5)).cast("int")


def truncated(code: Column, tokens: Column) -> Column:
    """At most 4 characters a token, back to the last line end if that is in the last fifth, and a mark."""
    most = tokens * 4
    cut = F.substring(code, F.lit(1), most.cast("int"))
    line_end = F.length(cut) - F.locate("\n", F.reverse(cut))
    at_line = (F.locate("\n", cut) > 0) & (line_end > most * 0.8)
    kept = F.when(at_line, F.substring(cut, F.lit(1), line_end.cast("int"))).otherwise(cut)
    return F.when(F.length(code) <= most, code).otherwise(F.concat(kept, F.lit("\n# ... (truncated)")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def content_key(text: Column) -> Column:
    """The first 16 hexadecimal digits of the text's MD5."""
    return F.left(F.md5(text), F.lit(16))


def dense_text(name: Column, kind: Column, signature: Column, doc: Column, code: Column) -> Column:
    """The text that is embedded for an entity; missing parts are left out, of code the first 10 lines count."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    head = F.array_join(F.slice(F.split(code, "\n", -1), 1, 10), "\n")
    return F.concat_ws("\n", part("Name", name), part("Type", kind), part("Signature", signature), part("Documentation", doc), F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("Code:\n"), head)))


def sparse_text(name: Column, signature: Column, doc: Column, code: Column) -> Column:
    return F.concat_ws(" ", name, *[F.when(c != "", c) for c in (signature, doc, code)])


def abstract(signature: Column, doc: Column, dependencies: Column) -> Column:
    """A short stand-in for an entity: its documentation if longer than 10 characters, else signature, documentation and five calls."""
    uses = F.when(F.size(dependencies) > 0, F.concat(F.lit("# Uses: "), F.array_join(F.slice(dependencies, 1, 5), ", ")))
    plain = F.concat_ws("\n", signature, F.when(doc != "", F.concat(F.lit('"""'), doc, F.lit('"""'))), uses)
    return F.when(F.length(F.trim(doc)) > 10, doc).otherwise(plain)


def shown_code(code: Column, signature: Column, doc: Column) -> Column:
    """The code itself, or signature and documentation where it is missing."""
    rest = F.concat_ws("\n", F.when(signature != "", signature), F.when(doc != "", F.concat(F.lit('"""'), doc, F.lit('"""'))))
    return F.coalesce(F.when(code != "", code), rest)


def base_class(code: Column) -> Column:
    """What stands between the brackets of the first class statement, as one text; null without any."""
    found = F.trim(F.regexp_extract(code, r"class\s+\w+\s*\(([^)]+)\)", 1))
    return F.when(found != "", found)


def naming(name: Column) -> Column:
    """snake (underscores, no capitals), camel, pascal or other."""
    first = F.substring(name, 1, 1)
    upper = name.rlike(r"\p{Lu}")
    return F.when(F.coalesce(name, F.lit("")) == "", "other").when(name.contains("_") & ~upper, "snake").when(first.rlike(r"\p{Ll}") & upper, "camel").when(first.rlike(r"\p{Lu}"), "pascal").otherwise("other")


def has_type_hints(signature: Column) -> Column:
    return F.coalesce(signature.contains("->") | signature.rlike(r"\w+\s*:\s*\w+"), F.lit(False))


def doc_style(doc: Column) -> Column:
    """google, numpy, rest or none; documentation without marks of a style counts as google."""
    return (
        F.when(F.coalesce(doc, F.lit("")) == "", "none")
        .when(doc.rlike(r"\n\s*Args:") | doc.rlike(r"^\s*Args:"), "google")
        .when(doc.rlike(r"\n\s*Parameters\s*\n\s*-+"), "numpy")
        .when(doc.contains(":param") | doc.contains(":return:"), "rest")
        .otherwise("google")
    )


def single_quoted(code: Column) -> Column:
    return F.coalesce(code.rlike("'[^']*'"), F.lit(False))


def double_quoted(code: Column) -> Column:
    return F.coalesce(code.rlike('"[^"]*"'), F.lit(False))

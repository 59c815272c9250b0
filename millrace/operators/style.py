"""Style profiles of code, their divergence, and the gate on it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.retrieval import seeded_sample

SHARES = ["naming_snake", "naming_camel", "naming_pascal", "type_hints", "doc_google", "doc_numpy", "doc_rest", "doc_none", "quote_single", "quote_double", "functional_ratio"]


def profile(entities: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: shares of naming and documentation styles, type hints, quotes and plain functions, mean line length, size.

    Null texts count as empty; quote shares and function ratio are 0 where nothing is counted. One pass of partial sums.
    """
    code = F.coalesce("raw_code", F.lit(""))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    named, style = T.naming(F.col("name")), T.doc_style(F.col("docstring"))
    single, double = F.sum(T.single_quoted(code).cast("int")), F.sum(T.double_quoted(code).cast("int"))
    functions, methods = F.count_if(F.col("type") == "function"), F.count_if(F.col("type") == "method")
    lines = F.sum(F.size(F.split(code, "\n", -1)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return entities.groupBy(*by).agg(
        *[share(named == k).alias(f"naming_{k}") for k in ("snake", "camel", "pascal")],
        share(T.has_type_hints(F.col("signature"))).alias("type_hints"),
        *[share(style == k).alias(f"doc_{k}") for k in ("google", "numpy", "rest", "none")],
        ratio(single, single + double).alias("quote_single"),
        ratio(double, single + double).alias("quote_double"),
        ((F.sum(F.length(code)) - lines + F.count("*")) / lines).alias("avg_line_length"),
        ratio(functions, functions + methods).alias("functional_ratio"),
        F.count("*").alias("sample_size"),
    )


def _kl(p: list[Column], q: list[Column], floor: float = 1e-10) -> Column:
    a, b = [F.greatest(x, F.lit(floor)) for x in p], [F.greatest(x, F.lit(floor)) for x in q]
    sa, sb = sum(a[1:], a[0]), sum(b[1:], b[0])
    terms = [x / sa * F.log((x / sa) / (y / sb)) for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def divergence(p: str, q: str) -> Column:
    """The mean of three divergences (naming, documentation, quotes) and two differences (type hints, functions); p and q are prefixes of columns."""
    c = lambda prefix, names: [F.col(f"{prefix}{n}") for n in names]
    groups = [["naming_snake", "naming_camel", "naming_pascal"], ["doc_google", "doc_numpy", "doc_rest", "doc_none"], ["quote_single", "quote_double"]]
    kls = [_kl(c(p, g), c(q, g)) for g in groups]
    return (kls[0] + kls[1] + kls[2] + F.abs(F.col(f"{p}type_hints") - F.col(f"{q}type_hints")) + F.abs(F.col(f"{p}functional_ratio") - F.col(f"{q}functional_ratio"))) / 5


def gate(local: DataFrame, overall: DataFrame, on: list[str], threshold: float = 0.15) -> DataFrame:
    """local's rows with ``divergence`` from the overall profile of the same ``on`` (or the only one) and ``update``: whether it is above the threshold."""
    names = [n for n in SHARES]
    q = overall.select(*[F.col(c).alias(f"__on_{c}") for c in on], *[F.col(n).alias(f"__q_{n}") for n in names])
    same = F.lit(True)
    for c in on:
        same &= F.col(c) == F.col(f"__on_{c}")
    joined = local.join(q, same) if on else local.crossJoin(F.broadcast(q))
    return joined.withColumn("divergence", divergence("", "__q_")).withColumn("update", F.col("divergence") > threshold).drop(*[f"__q_{n}" for n in names], *[f"__on_{c}" for c in on])


def file_gates(entities: DataFrame, file: str, repo: str, key: str, local: int = 5, overall: int = 20, threshold: float = 0.15) -> DataFrame:
    """Each file's style against its repository's, by ``gate``: profiles of ``local`` of its entities and ``overall`` of the repository's, by hash.

    The samples are the feature: a style is told from few entities.
    """
    own = profile(seeded_sample(entities, key, local, by=[repo, file]), [repo, file])
    return gate(own, profile(seeded_sample(entities, key, overall, by=[repo]), [repo]), [repo], threshold)


def instruction() -> Column:
    """A sentence on a profile's style."""
    c = F.col
    naming = F.when(c("naming_snake") > 0.5, "snake_case").when(c("naming_camel") > 0.5, "camelCase").when(c("naming_pascal") > 0.5, "PascalCase")
    docs = F.when(c("doc_google") > 0.3, "Google-style").when(c("doc_numpy") > 0.3, "NumPy-style").when(c("doc_rest") > 0.3, "reST-style")
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("Use "), naming, F.lit(" naming convention")),
        F.when(c("type_hints") > 0.5, "include type hints").otherwise("avoid type hints"),
        F.concat(F.lit("use "), docs, F.lit(" docstrings")),
        F.when(c("quote_single") > c("quote_double"), "prefer single quotes").otherwise("prefer double quotes"),
        F.when(c("functional_ratio") > 0.7, "favor functional programming").when(c("functional_ratio") < 0.3, "favor object-oriented programming"),
    )
    return F.concat(F.lit("Code style: "), parts, F.lit("."))

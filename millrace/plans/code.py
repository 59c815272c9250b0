"""Queries of the text, retrieval, code, assembly and style operators on the test tables."""

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import assembly, codegraph, completion, retrieval, style
from millrace.plans.catalogue import Catalogue
from millrace.plans.tables import table
from millrace.sources import python_code

C = Catalogue()

# DuckDB forms of the expressions in functions.text.
TOKENS = r"""[lower(x) for x in regexp_extract_all(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[a-zA-Z0-9]+')]"""
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
# List functions keep no order of first use by themselves: positions of the first of each.
IDENTIFIERS = rf"""(SELECT coalesce(list(w ORDER BY i), []) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT regexp_extract_all({{c}}, '[\p{{{{L}}}}\p{{{{N}}}}\p{{{{M}}}}_]+') AS a))
 WHERE regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]+') AND w NOT IN ({STOP}) GROUP BY w))"""


def _ids(c: str) -> str:
    return IDENTIFIERS.replace("{{", "{").replace("}}", "}").replace("{c}", c)


def _joined(c: str) -> str:
    return f"array_to_string({c}, ' ')"


@C.add(f"SELECT doc_id, {_joined(TOKENS.format(c='text'))} AS tokens FROM documents")
def txt_tokenize_code(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.code_tokens(F.col("text")), " ").alias("tokens"))


@C.add(r"SELECT doc_id, CAST(len([x for x in regexp_split_to_array(lower(text), '\s+') if x <> '']) AS INTEGER) AS n_tokens FROM documents")
def txt_tokenize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.space_tokens(F.col("text"))).alias("n_tokens"))


@C.add(f"SELECT entity_id, {_joined(_ids('raw_code'))} AS ids FROM entities WHERE raw_code IS NOT NULL")
def txt_identifiers(spark, d):
    return table(spark, d, "entities").where("raw_code is not null").select("entity_id", F.array_join(T.identifiers(F.col("raw_code")), " ").alias("ids"))


SPLIT = "(SELECT file_id, file_path, left(content, length(content) // 2) AS prefix, substr(content, length(content) // 2 + 1) AS suffix FROM source_files)"


def _tasks(spark, d):
    f = table(spark, d, "source_files")
    half = F.floor(F.length("content") / 2).cast("int")
    return f.select("file_id", "file_path", F.substring("content", F.lit(1), half).alias("prefix"), F.substring("content", half + 1, F.length("content")).alias("suffix"))


@C.add(f"""WITH t AS {SPLIT}, q AS (SELECT file_id, array_to_string(list_concat({_ids("right(prefix, 1000)")}, {_ids("left(suffix, 500)")}, string_split(prefix, chr(10))[-10:], string_split(suffix, chr(10))[1:5]), ' ') AS query FROM t) SELECT file_id, md5(query) AS query FROM q""")
def txt_query_build(spark, d):
    return _tasks(spark, d).select("file_id", F.md5(T.completion_query(F.col("prefix"), F.col("suffix"))).alias("query"))


@C.add("""SELECT doc_id, CASE WHEN n >= 3 THEN 0.2 WHEN n >= 1 THEN 0.4 ELSE 0.7 END::DOUBLE AS alpha FROM (SELECT doc_id, len(regexp_extract_all(text, '[a-z][A-Z]|[A-Z][A-Z][a-z]')) AS n FROM documents)""")
def txt_alpha(spark, d):
    return table(spark, d, "documents").select("doc_id", T.lexical_share(F.col("text")).alias("alpha"))


@C.add("SELECT doc_id, CAST(floor(length(text) / 3.5::DOUBLE) AS INTEGER) AS tokens FROM documents")
def txt_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@C.add("""WITH c AS (SELECT doc_id, text, left(text, 400) AS cut FROM documents), e AS (SELECT *, length(cut) - strpos(reverse(cut), chr(10)) AS line_end FROM c)
 SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE (CASE WHEN strpos(cut, chr(10)) > 0 AND line_end > 320 THEN left(cut, line_end) ELSE cut END) || chr(10) || '# ... (truncated)' END) AS shown FROM e""")
def txt_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncated(F.col("text"), F.lit(100))).alias("shown"))


@C.add("SELECT doc_id, left(md5(text), 16) AS key FROM documents")
def txt_md5_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_key(F.col("text")).alias("key"))


@C.add("SELECT file_id, string_split(file_path, '/')[-1] AS name FROM source_files")
def txt_basename(spark, d):
    return table(spark, d, "source_files").select("file_id", T.base_name(F.col("file_path")).alias("name"))


@C.add(r"""SELECT entity_id, md5(coalesce(name, '') || CASE WHEN coalesce(signature, '') <> '' THEN ' ' || signature ELSE '' END || CASE WHEN coalesce(docstring, '') <> '' THEN ' ' || docstring ELSE '' END || CASE WHEN coalesce(raw_code, '') <> '' THEN ' ' || raw_code ELSE '' END) AS sparse,
 CASE WHEN length(trim(coalesce(docstring, ''))) > 10 THEN 'doc' ELSE 'sig' END AS abstract_of FROM entities""")
def txt_entity_texts(spark, d):
    e = table(spark, d, "entities")
    c = F.col
    short = T.abstract(c("signature"), c("docstring"), c("dependencies"))
    return e.select("entity_id", F.md5(T.sparse_text(c("name"), c("signature"), c("docstring"), c("raw_code"))).alias("sparse"), F.when(short.eqNullSafe(c("docstring")) & (F.length(F.trim("docstring")) > 10), "doc").otherwise("sig").alias("abstract_of"))


KNOWN = ", ".join(f"'{w}'" for w in [*T.KEYWORDS, *T.KNOWN_NAMES])
PLAIN = r"""regexp_replace(raw_code, '#[^\n]*|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''', ' ', 'g')"""


@C.add(rf"""WITH w AS (SELECT entity_id, [x for x in regexp_extract_all({PLAIN}, '[\p{{L}}\p{{N}}\p{{M}}_]+') if regexp_full_match(x, '[\p{{L}}_][\p{{L}}\p{{N}}\p{{M}}_]+') AND lower(x) NOT IN ({KNOWN})] AS a FROM entities WHERE raw_code IS NOT NULL),
 l AS (SELECT entity_id, a, [lower(x) for x in a] AS b FROM w) SELECT entity_id, array_to_string([a[i] for i in range(1, len(a) + 1) if list_position(b, b[i]) = i], ' ') AS ids FROM l""")
def txt_code_identifiers(spark, d):
    return table(spark, d, "entities").where("raw_code is not null").select("entity_id", F.array_join(T.code_identifiers(F.col("raw_code")), " ").alias("ids"))


@C.add("""SELECT entity_id, md5(concat_ws(chr(10), CASE WHEN name <> '' THEN 'Name: ' || name END, CASE WHEN type <> '' THEN 'Type: ' || type END, CASE WHEN signature <> '' THEN 'Signature: ' || signature END, CASE WHEN docstring <> '' THEN 'Documentation: ' || docstring END,
 CASE WHEN raw_code <> '' THEN 'Code:' || chr(10) || array_to_string(string_split(raw_code, chr(10))[1:10], chr(10)) END)) AS dense FROM entities""")
def txt_dense_text(spark, d):
    c = F.col
    return table(spark, d, "entities").select("entity_id", F.md5(T.dense_text(c("name"), c("type"), c("signature"), c("docstring"), c("raw_code"))).alias("dense"))


# Retrieval: the corpus is the entities' code; queries are the signatures of every fiftieth entity.
CORPUS = f"(SELECT entity_id, {TOKENS.format(c=chr(34) + 'raw_code' + chr(34))} AS t FROM entities)"


def _corpus(spark, d):
    return table(spark, d, "entities").select("entity_id", T.code_tokens(F.col("raw_code")).alias("t"))


def _asked(spark, d):
    return table(spark, d, "entities").where("entity_id % 50 = 0 and signature is not null").select(F.col("entity_id").alias("query_id"), T.code_tokens(F.col("signature")).alias("t"))


BM25 = f"""WITH RECURSIVE dummy AS (SELECT 1), c AS {CORPUS}, n AS (SELECT count(*) AS n_docs, avg(coalesce(len(t), 0)) AS avg_dl FROM c),
 p AS (SELECT entity_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT entity_id, unnest(t) AS term, len(t) AS dl FROM c) GROUP BY 1, 2),
 i AS (SELECT term, count(*) AS df, ln((n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM p CROSS JOIN n GROUP BY term, n_docs),
 q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT entity_id AS query_id, unnest({TOKENS.format(c="signature")}) AS term FROM entities WHERE entity_id % 50 = 0 AND signature IS NOT NULL) GROUP BY 1, 2),
 s AS (SELECT query_id, entity_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score FROM q JOIN p USING (term) JOIN i USING (term) CROSS JOIN n GROUP BY 1, 2),
 r AS (SELECT query_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_id) - 1 AS place FROM s WHERE score > 0)"""


@C.add(BM25.replace("RECURSIVE dummy AS (SELECT 1), ", "") + " SELECT term, df, round(idf, 6) AS idf FROM i")
def ret_df_idf(spark, d):
    docs = _corpus(spark, d)
    posts = retrieval.postings(docs, "entity_id", F.col("t"))
    return retrieval.inverse_frequencies(posts, retrieval.corpus_size(docs, F.col("t")), "entity_id").withColumn("idf", F.round("idf", 6))


def _bm25(spark, d, k):
    return retrieval.bm25(_corpus(spark, d), "entity_id", F.col("t"), _asked(spark, d), "query_id", F.col("t"), k)


@C.add(BM25.replace("RECURSIVE dummy AS (SELECT 1), ", "") + " SELECT query_id, entity_id, round(score, 6) AS score FROM r WHERE place < 10")
def ret_bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("query_id", "entity_id", F.round("score", 6).alias("score"))


DENSE = """WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_sum([x * x for x in e])) + 1e-8::DOUBLE AS n FROM v),
 s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum([z[1] * z[2] for z in list_zip(a.e, b.e)]) / (a.n * b.n) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0),
 r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) - 1 AS place FROM s)"""


def _dense(spark, d, k):
    v = table(spark, d, "embeddings")
    return retrieval.dense_top(v, "vec_id", "embedding", v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "embedding", k)


@C.add(DENSE + " SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE place < 10")
def ret_dense_topk(spark, d):
    return _dense(spark, d, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@C.add(f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format(c="text")}) AS term FROM documents), b AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
 SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""")
def ret_hash_embed(spark, d):
    return retrieval.hashed_embedding(table(spark, d, "documents"), "doc_id", T.code_tokens(F.col("text"))).withColumn("weight", F.round("weight", 6))


# Dense search by hashed embeddings of the same tokens, and its fusion with BM25.
BUCKET = "CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 384 AS INTEGER)"
HASHED = f"""e AS (SELECT entity_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY entity_id)) AS w FROM (SELECT entity_id, {BUCKET} AS bucket, count(*) AS n FROM (SELECT entity_id, unnest(t) AS term FROM c) GROUP BY 1, 2)),
 g AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM (SELECT query_id, {BUCKET} AS bucket, sum(qtf) AS n FROM q GROUP BY 1, 2)),
 o AS (SELECT query_id, entity_id, sum(g.w * e.w) AS dot FROM g JOIN e USING (bucket) GROUP BY 1, 2),
 z AS (SELECT query_id, entity_id, coalesce(dot, 0) / ((1 + 1e-8::DOUBLE) * (1 + 1e-8::DOUBLE)) AS score FROM (SELECT DISTINCT query_id FROM g) CROSS JOIN (SELECT DISTINCT entity_id FROM e) LEFT JOIN o USING (query_id, entity_id)),
 y AS (SELECT query_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_id) - 1 AS place FROM z)"""


def _hashed(spark, d):
    docs = retrieval.sparse_units(retrieval.hashed_embedding(_corpus(spark, d), "entity_id", F.col("t")), "entity_id")
    asked = retrieval.sparse_units(retrieval.hashed_embedding(_asked(spark, d), "query_id", F.col("t")), "query_id")
    return retrieval.sparse_top(docs, "entity_id", asked, "query_id", 20, positive=False)


@C.add(BM25.replace("RECURSIVE dummy AS (SELECT 1), ", "") + f", {HASHED} SELECT query_id, entity_id, round(score, 6) AS score FROM y WHERE place < 20")
def ret_hashed_topk(spark, d):
    return _hashed(spark, d).select("query_id", "entity_id", F.round("score", 6).alias("score"))


@C.add(BM25.replace("RECURSIVE dummy AS (SELECT 1), ", "") + f""", {HASHED}, p2 AS (SELECT query_id, entity_id, 0.4::DOUBLE / (61 + place) AS part FROM y WHERE place < 20 UNION ALL SELECT query_id, entity_id, (1 - 0.4::DOUBLE) / (61 + place) FROM r WHERE place < 20),
 f AS (SELECT query_id, entity_id, sum(part) AS score FROM p2 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, entity_id) AS n FROM f)
 SELECT query_id, entity_id, round(score, 9) AS score FROM k WHERE n <= 10""")
def ret_rrf_hybrid(spark, d):
    return retrieval.fused(_hashed(spark, d), _bm25(spark, d, 20), "query_id", "entity_id", 10, alpha=0.4).select("query_id", "entity_id", F.round("score", 9).alias("score"))


# The file baseline: every fiftieth file is to be completed in its middle, by the best files of its repository.
WORDS = r"[x for x in regexp_split_to_array(lower({c}), '\s+') if x <> '']"


@C.add(rf"""WITH c AS (SELECT repo, file_id, file_path, content, {WORDS.format(c="content")} AS t FROM source_files), n AS (SELECT repo, count(*) AS n_docs, avg(coalesce(len(t), 0)) AS avg_dl FROM c GROUP BY 1),
 p AS (SELECT repo, file_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT repo, file_id, unnest(t) AS term, len(t) AS dl FROM c) GROUP BY 1, 2, 3),
 i AS (SELECT repo, term, ln((n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM p JOIN n USING (repo) GROUP BY repo, term, n_docs),
 a AS (SELECT repo, file_id AS task, right(left(content, length(content) // 2), 1000) || ' ' || left(substr(content, length(content) // 2 + 1), 500) AS asked FROM source_files WHERE file_id % 50 = 0),
 q AS (SELECT repo, task, term, count(*) AS qtf FROM (SELECT repo, task, unnest({WORDS.format(c="asked")}) AS term FROM a) GROUP BY 1, 2, 3),
 s AS (SELECT task, file_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score FROM q JOIN p USING (repo, term) JOIN i USING (repo, term) JOIN n USING (repo) GROUP BY 1, 2),
 r AS (SELECT task, file_id, row_number() OVER (PARTITION BY task ORDER BY round(score, 9) DESC, file_id) - 1 AS place FROM s WHERE score > 0),
 b AS (SELECT r.task, r.place, file_path, content, coalesce(sum(length(content)) OVER (PARTITION BY task ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN c USING (file_id) WHERE place < 3),
 x AS (SELECT task, md5(string_agg('<|file_sep|>' || chr(10) || '# File: ' || string_split(file_path, '/')[-1] || chr(10) || left(content, CAST(32000 - before AS BIGINT)), chr(10) || chr(10) ORDER BY place)) AS context FROM b WHERE before < 32000 GROUP BY task)
 SELECT task, coalesce(context, '') AS context FROM a LEFT JOIN x USING (task)""")
def ret_file_baseline(spark, d):
    f = table(spark, d, "source_files").withColumn("t", T.space_tokens(F.col("content")))
    half = F.floor(F.length("content") / 2).cast("int")
    asked = F.concat(F.right(F.left("content", half), F.lit(1000)), F.lit(" "), F.left(F.substring(F.col("content"), half + 1, F.length("content")), F.lit(500)))
    tasks = f.where("file_id % 50 = 0").select("repo", F.col("file_id").alias("task"), T.space_tokens(asked).alias("t"))
    ranked = retrieval.bm25(f, "file_id", F.col("t"), tasks, "task", F.col("t"), 3, by=["repo"]).join(f.select("file_id", "file_path", "content"), "file_id")
    found = retrieval.joined_files(ranked, "task", "place", T.base_name(F.col("file_path")), F.col("content"), 32_000)
    return assembly.with_empty(tasks.select("task"), found.withColumn("context", F.md5("context")), "task")


@C.add("SELECT repo, file_id FROM (SELECT repo, file_id, row_number() OVER (PARTITION BY repo ORDER BY md5('42:' || file_id), file_id) AS k FROM source_files) WHERE k = 1")
def ret_random_seeded(spark, d):
    return retrieval.seeded_sample(table(spark, d, "source_files"), "file_id", 1, by=["repo"]).select("repo", "file_id")


def _python(spark, d):
    return table(spark, d, "source_files").where(F.lower("file_path").rlike(r"\.pyi?$"))


@C.add()
def code_entities(spark, d):
    """Of Python files, whose entities this is the parser of."""
    return python_code.entities(_python(spark, d), ["file_id", "file_path"])


@C.add()
def code_entities_tolerant(spark, d):
    return python_code.entities(_python(spark, d), ["file_id", "file_path"], tolerant=True)


@C.add()
def code_imports(spark, d):
    return python_code.imports(_python(spark, d), ["file_id", "file_path"])


# The listed entities, each identity once, with the path of their file; what they call is read off their code.
CALL = r"([A-Za-z_]\w*)\("
LISTED = rf"""l AS (SELECT file_id || '/' || s.file_path AS path, name, type, line_start, min(line_end) AS line_end, min(e.parent) AS parent, max(raw_code) AS code FROM entities e JOIN source_files s USING (file_id) GROUP BY ALL),
 e AS (SELECT *, [c for c in list_distinct(regexp_extract_all(coalesce(code, ''), '{CALL}', 1)) if c <> name] AS deps FROM l),
 x AS (SELECT path || ':' || name || ':' || line_start AS id, * FROM e)"""


def _listed(spark, d):
    e = table(spark, d, "entities").join(table(spark, d, "source_files").select("file_id", F.col("file_path").alias("own_path")), "file_id")
    path = F.concat_ws("/", F.col("file_id").cast("string"), "own_path")
    once = e.groupBy(path.alias("file_path"), "name", "type", "line_start").agg(F.min("line_end").alias("line_end"), F.min("parent").alias("parent"), F.max("raw_code").alias("code"))
    calls = F.array_distinct(F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(CALL), F.lit(1)))
    return once.withColumn("dependencies", F.filter(calls, lambda c: c != F.col("name"))).drop("code")


EDGES_SQL = f"""WITH {LISTED}, c AS (SELECT DISTINCT id AS src, path, unnest(deps) AS dep FROM x),
 k AS (SELECT c.src, c.dep, min(CASE WHEN x.path = c.path THEN '0' ELSE '1' END || x.id) AS t FROM c JOIN x ON x.name = c.dep GROUP BY 1, 2),
 p AS (SELECT path, name AS parent, min(id) AS src FROM x WHERE type = 'class' GROUP BY 1, 2),
 g AS (SELECT path || ':module' AS src, id AS dst, 'DEFINES' AS relation FROM x UNION SELECT src, substr(t, 2), 'CALLS' FROM k UNION SELECT p.src, x.id, 'CONTAINS' FROM x JOIN p USING (path, parent))"""


@C.add(EDGES_SQL + " SELECT src, dst, relation FROM g")
def code_edges(spark, d):
    return codegraph.edges(_listed(spark, d))


@C.add(EDGES_SQL + ", u AS (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) SELECT id, count(*) AS degree FROM u GROUP BY 1")
def code_degree(spark, d):
    return codegraph.degrees(codegraph.edges(_listed(spark, d)))


@C.add(EDGES_SQL + ", u AS (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) SELECT id, count(*) AS degree FROM u GROUP BY 1 HAVING count(*) > 6")
def code_high_degree(spark, d):
    return codegraph.high_degrees(codegraph.edges(_listed(spark, d)), 6)


# Imports: what the parser lists of Python files ("import a.b", "from a.b import c"), and of each file the next one of its repository.
IMPORTED = r"""i AS (SELECT DISTINCT path, replace(m, '.', '/') AS module FROM (SELECT file_id || '/' || s.file_path AS path, coalesce(nullif(regexp_extract(t, '^from\s+([A-Za-z_][\w.]*)\s+import', 1), ''), nullif(regexp_extract(t, '^import\s+([A-Za-z_][\w.]*)', 1), '')) AS m
  FROM (SELECT file_id, unnest(imports) AS t FROM parse_results) JOIN source_files s USING (file_id) WHERE regexp_matches(lower(s.file_path), '\.pyi?$')
  UNION ALL SELECT file_id || '/' || file_path, array_to_string(string_split(regexp_replace(lead(file_path) OVER (PARTITION BY repo ORDER BY file_id), '\.\w+$', ''), '/')[-2:], '.') FROM source_files) WHERE m IS NOT NULL),
 d AS (SELECT DISTINCT path AS target, string_split(regexp_replace(path, '(/__init__)?\.\w+$', ''), '/') AS parts FROM x), u AS (SELECT target, unnest([array_to_string(parts[k:], '/') for k in range(1, len(parts) + 1)]) AS module FROM d)"""


def _imported(spark, d):
    path = F.concat_ws("/", F.col("file_id").cast("string"), "file_path").alias("file_path")
    t = table(spark, d, "parse_results").select("file_id", F.explode("imports").alias("t")).join(_python(spark, d).select("file_id", path), "file_id")
    from_, plain = F.regexp_extract("t", r"^from\s+([A-Za-z_][\w.]*)\s+import", 1), F.regexp_extract("t", r"^import\s+([A-Za-z_][\w.]*)", 1)
    parsed = t.select("file_path", F.when(from_ != "", from_).when(plain != "", plain).alias("module"))
    stem = F.split(F.regexp_replace(F.lead("file_path").over(codegraph.Window.partitionBy("repo").orderBy("file_id")), r"\.\w+$", ""), "/")
    follow = table(spark, d, "source_files").select(path, F.array_join(F.slice(stem, F.greatest(F.size(stem) - 1, F.lit(1)), F.lit(2)), ".").alias("module"))
    return parsed.unionByName(follow).where("module is not null")


@C.add(EDGES_SQL + f", {IMPORTED} SELECT src, dst, relation FROM g UNION SELECT i.path || ':module', u.target || ':module', 'IMPORTS' FROM i JOIN u USING (module)")
def code_edges_imports(spark, d):
    return codegraph.edges(_listed(spark, d), _imported(spark, d))


@C.add(f"WITH {LISTED} SELECT count(*) + count(DISTINCT path) AS n_nodes, count(*) AS n_entities, count(DISTINCT path) AS n_files FROM x")
def code_graph_size(spark, d):
    return codegraph.sizes(codegraph.nodes(_listed(spark, d)))


# Lookups of every fiftieth file's entities, the entities of their names, and these by their ids again.
@C.add(f"WITH {LISTED}, f AS (SELECT DISTINCT file_id || '/' || file_path AS path FROM source_files WHERE file_id % 50 = 0) SELECT DISTINCT id, path AS file_path, name FROM x WHERE name IN (SELECT name FROM x SEMI JOIN f USING (path))")
def code_lookup(spark, d):
    n = codegraph.nodes(_listed(spark, d))
    files = table(spark, d, "source_files").where("file_id % 50 = 0").select(F.concat_ws("/", F.col("file_id").cast("string"), "file_path").alias("file_path"))
    same = codegraph.of_names(n, codegraph.of_files(n, files).select("name"))
    return codegraph.by_id(n, same.select("id")).select("id", "file_path", "name")


@C.add(f"WITH {LISTED}, k AS (SELECT src, dst FROM (SELECT file_id || '/' || s.file_path || ':' || name || ':' || line_start AS src, lead(file_id || '/' || s.file_path || ':' || name || ':' || line_start, 1, 'none') OVER (ORDER BY entity_id) AS dst FROM entities JOIN source_files s USING (file_id))) SELECT DISTINCT src, dst FROM k WHERE dst IN (SELECT id FROM x)")
def code_known_edges(spark, d):
    """Each listing's link to the next one, of which the last leads nowhere."""
    e = table(spark, d, "entities").join(table(spark, d, "source_files").select("file_id", F.col("file_path").alias("own")), "file_id")
    ids = e.select("entity_id", codegraph.entity_id(F.concat_ws("/", F.col("file_id").cast("string"), "own"), F.col("name"), F.col("line_start")).alias("src"))
    nxt = ids.select(F.col("src").alias("dst"), F.col("entity_id").alias("__e"))
    ranks = ids.select("entity_id").distinct()
    follow = ranks.join(ranks.select((F.col("entity_id") - 1).alias("__p"), F.col("entity_id").alias("__n")), F.col("entity_id") == F.col("__p"), "left")
    links = ids.join(follow, "entity_id").join(nxt, F.col("__n") == F.col("__e"), "left").select("src", F.coalesce("dst", F.lit("none")).alias("dst"))
    return codegraph.known_edges(links, codegraph.nodes(_listed(spark, d))).distinct()


# Orders as a graph: a supplier delivers parts.
SP = "(SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'CALLS' AS relation FROM lineitem)"


def _supply(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("CALLS").alias("relation")).distinct()


# The starts: suppliers and parts whose key is divisible by 50.
SUPPLIERS, PARTS = ("(SELECT '{0}' || {1} AS id FROM {2} WHERE {1} % 50 = 0)".format(*x) for x in (("s", "s_suppkey", "supplier"), ("p", "p_partkey", "part")))


def _starts(spark, d, prefix, key, name):
    return table(spark, d, name).where(F.col(key) % 50 == 0).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"))


@C.add(f"SELECT DISTINCT src AS start, dst AS id FROM {SP} SEMI JOIN {SUPPLIERS} s ON src = s.id")
def code_callees(spark, d):
    return codegraph.callees(_supply(spark, d), _starts(spark, d, "s", "s_suppkey", "supplier"))


@C.add(f"SELECT DISTINCT dst AS start, src AS id FROM {SP} SEMI JOIN {PARTS} s ON dst = s.id")
def code_callers(spark, d):
    return codegraph.callers(_supply(spark, d), _starts(spark, d, "p", "p_partkey", "part"))


@C.add(f"""WITH b AS MATERIALIZED (SELECT src, dst FROM {SP} UNION SELECT dst, src FROM {SP}), a1 AS MATERIALIZED (SELECT DISTINCT s.id AS start, dst AS id FROM b JOIN {SUPPLIERS} s ON src = s.id),
 a2 AS (SELECT DISTINCT start, b.dst AS id FROM b JOIN a1 ON b.src = a1.id)
 SELECT start, id, CAST(1 AS INTEGER) AS depth FROM a1 WHERE id <> start UNION ALL SELECT start, id, 2 FROM a2 ANTI JOIN a1 USING (start, id) WHERE id <> start""")
def code_neighbors(spark, d):
    return codegraph.neighbours(_supply(spark, d), _starts(spark, d, "s", "s_suppkey", "supplier"), 2)


@C.add(f"""WITH {LISTED}, c AS (SELECT DISTINCT id AS src, path, unnest(deps) AS dep FROM x), k AS (SELECT c.src, c.dep, min(CASE WHEN x.path = c.path THEN '0' ELSE '1' END || x.id) AS t FROM c JOIN x ON x.name = c.dep GROUP BY 1, 2)
 SELECT src, dep, substr(t, 2) AS target FROM k""")
def code_resolve_call(spark, d):
    e = _listed(spark, d).withColumn("id", codegraph.entity_id(F.col("file_path"), F.col("name"), F.col("line_start")))
    calls = e.select(F.col("id").alias("src"), "file_path", F.explode("dependencies").alias("dep")).distinct()
    return codegraph.resolved(calls, e.select("id", "file_path", "name"), "dep", "file_path", ["src", "dep"]).select("src", "dep", "target")


# Each file imports the first entity of the next file of its repository.
NEXT = f"""WITH {LISTED}, a AS (SELECT path, min_by(name, line_start * 1000 + length(name)) AS first FROM x GROUP BY 1),
 f AS (SELECT file_id, lead(file_id || '/' || file_path) OVER (PARTITION BY repo ORDER BY file_id) AS path FROM source_files), w AS (SELECT f.file_id, a.first AS name, replace(regexp_replace(f.path, '\\.\\w+$', ''), '/', '.') AS module FROM f JOIN a USING (path))"""


@C.add(NEXT + """, k AS (SELECT w.file_id, w.name, w.module, min(CASE WHEN contains(x.path, replace(w.module, '.', '/')) THEN '0' ELSE '1' END || x.id) AS t FROM w JOIN x ON x.name = w.name GROUP BY 1, 2, 3)
 SELECT file_id, name, module, substr(t, 2) AS target FROM k""")
def code_resolve_import(spark, d):
    e = _listed(spark, d).withColumn("id", codegraph.entity_id(F.col("file_path"), F.col("name"), F.col("line_start")))
    first = e.groupBy("file_path").agg(F.min_by("name", F.col("line_start") * 1000 + F.length("name")).alias("want"))
    path = F.concat_ws("/", F.col("file_id").cast("string"), "file_path")
    nxt = F.lead(path).over(codegraph.Window.partitionBy("repo").orderBy("file_id"))
    follow = table(spark, d, "source_files").select("file_id", nxt.alias("next"))
    want = follow.join(first, F.col("next") == F.col("file_path")).select("file_id", "want", F.translate(F.regexp_replace("next", r"\.\w+$", ""), "/", ".").alias("module"))
    want = want.withColumn("path", F.translate("module", ".", "/"))
    return codegraph.resolved_by_path(want, e.select("id", "file_path", "name"), "want", "path", ["file_id", "want", "module"]).select("file_id", F.col("want").alias("name"), "module", "target")


# Places in files: the line in the middle of each.
CURSOR = f"""WITH {LISTED}, f AS (SELECT file_id || '/' || file_path AS path, len(string_split(left(content, length(content) // 2), chr(10))) AS line FROM source_files),
 j AS (SELECT f.path, f.line, x.id, x.line_end - x.line_start AS size FROM f JOIN x USING (path) WHERE f.line BETWEEN x.line_start AND x.line_end)"""


def _placed(spark, d):
    e = _listed(spark, d)
    return e.select(codegraph.entity_id(F.col("file_path"), F.col("name"), F.col("line_start")).alias("id"), "file_path", F.col("type").alias("kind"), "name", "parent", "line_start", "line_end", F.size("dependencies").alias("n_deps"), F.col("line_start").alias("place"))


def _cursors(spark, d):
    t = _tasks(spark, d)
    path = F.concat_ws("/", F.col("file_id").cast("string"), "file_path")
    return t.select(path.alias("cursor"), path.alias("file_path"), F.size(F.split("prefix", "\n", -1)).alias("line"))


@C.add(CURSOR + """, r AS (SELECT path, min_by(id, (size, id)) AS inner_id FROM j GROUP BY 1), m AS (SELECT path, min_by(id, (-len(deps), line_start, id)) AS main_id FROM x WHERE type = 'class' GROUP BY 1),
 o AS (SELECT path, min_by(id, (line_start, id)) AS first_id FROM x GROUP BY 1), a AS (SELECT path, coalesce(inner_id, main_id, first_id) AS id, inner_id FROM f JOIN o USING (path) LEFT JOIN r USING (path) LEFT JOIN m USING (path)),
 p AS (SELECT a.path, min_by(k.id, (k.line_start, k.id)) AS id FROM a JOIN x ON x.id = a.inner_id JOIN x k ON k.path = x.path AND k.name = x.parent WHERE x.type = 'method' AND k.type = 'class' GROUP BY 1)
 SELECT path AS cursor, id, 'entity' AS role FROM a UNION ALL SELECT path, id, 'parent' FROM p""")
def ctx_cursor_entity(spark, d):
    """Where no entity holds the middle of a file, the stand-in that is chosen."""
    return codegraph.at_cursor(_placed(spark, d), _cursors(spark, d))


@C.add("SELECT a.l_orderkey * 10 + a.l_linenumber AS seed, b.l_orderkey * 10 + b.l_linenumber AS key FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_partkey - b.l_partkey) <= 50 AND a.l_orderkey * 10 + a.l_linenumber <> b.l_orderkey * 10 + b.l_linenumber")
def ctx_adjacent(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_orderkey", "l_partkey")
    return codegraph.adjacent(li, li.withColumnRenamed("key", "seed"), 50, "l_orderkey", "l_partkey", "key")


@C.add(f"""WITH {LISTED}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_start, line_end DESC, id) AS n FROM x)
 SELECT id FROM o i WHERE NOT EXISTS (SELECT 1 FROM o a WHERE a.path = i.path AND a.n < i.n AND a.line_start <= i.line_start AND i.line_end <= a.line_end)""")
def ctx_contained(spark, d):
    e = _placed(spark, d)
    return codegraph.uncovered(e, ["file_path"], "line_start", "line_end", "id").select("id")


@C.add("""SELECT entity_id, round(0.01 * (entity_id % 100) * CASE WHEN contains(lower(file_path), 'test') THEN 1 ELSE 1.2 END::DOUBLE, 6) AS score FROM entities
 WHERE NOT (contains(lower(file_path), 'test') AND (starts_with(name, 'test_') OR starts_with(name, 'empty_')) AND length(coalesce(raw_code, '')) < 100) AND NOT (name IN ('setup', 'teardown', '__init__', 'main') AND 0.01 * (entity_id % 100) < 0.5)""")
def ctx_seed_score(spark, d):
    e = table(spark, d, "entities").select(F.col("entity_id").alias("id"), "name", "file_path", F.col("raw_code").alias("code"), (F.lit(0.01) * (F.col("entity_id") % 100)).alias("score"))
    return assembly.seed_scores(e).select(F.col("id").alias("entity_id"), F.round("score", 6).alias("score"))


@C.add("""WITH RECURSIVE i AS (SELECT source, doc_id, CAST(floor(length(text) / 3.5::DOUBLE) AS INTEGER) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
 w AS (SELECT source, 0 AS r, 0 AS used, FALSE AS kept, CAST(NULL AS BIGINT) AS doc_id, 0 AS t FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT w.source, w.r + 1, w.used + CASE WHEN w.used + i.t <= 3000 THEN i.t ELSE 0 END, w.used + i.t <= 3000, i.doc_id, i.t FROM w JOIN i ON i.source = w.source AND i.r = w.r + 1)
 SELECT source, doc_id, CAST(t AS INTEGER) AS tokens FROM w WHERE kept""")
def ctx_budget_fold(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return assembly.within_budget(docs, ["source"], ["doc_id"], "text", F.lit(3000), F.lit(False)).select("source", "doc_id", "tokens")


@C.add()
def ctx_assemble(spark, d):
    """Contexts for every Python file, as if it were completed in its middle, from its own repository."""
    files = _python(spark, d)
    tasks = _tasks(spark, d).join(files.select("file_id", "repo", "revision"), "file_id")
    path = F.concat_ws("/", F.col("file_id").cast("string"), "file_path")
    tasks = tasks.select(F.col("file_id").alias("task"), "repo", path.alias("path"), "prefix", "suffix", F.array(path).alias("modified"))
    own = table(spark, d, "entities").select("file_id", "name", "line_start", "signature", "raw_code", "docstring")
    texts = own.groupBy("file_id", "name", "line_start").agg(*[F.max(c).alias(c) for c in ("signature", "raw_code", "docstring")])
    listed = _listed(spark, d)
    number = F.split_part("file_path", F.lit("/"), F.lit(1)).cast("long")
    e = listed.withColumn("file_id", number).join(texts, ["file_id", "name", "line_start"]).join(files.select("file_id", "repo"), "file_id")
    e = e.select("repo", codegraph.entity_id(F.col("file_path"), F.col("name"), F.col("line_start")).alias("id"), "file_path", "name", F.col("type").alias("kind"), "line_start", "line_end", F.col("line_start").alias("place"), "signature", "raw_code", "docstring", "parent", "dependencies")
    return completion.contexts(tasks, e, codegraph.edges(listed), max_tokens=2000)


@C.add("""SELECT doc_id, md5('<|file_sep|>' || chr(10) || '# File: ' || source || chr(10) || '# document: ' || coalesce(topic, 'none') || chr(10) || text || chr(10)) AS context FROM documents""")
def ctx_render(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("task"), F.concat(F.lit("docs/"), "source").alias("file_path"), F.coalesce("topic", F.lit("none")).alias("name"), F.lit("document").alias("kind"), "text", F.lit("seed").alias("source"), F.lit(1.0).alias("score"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit("x").alias("id"), F.lit(0).alias("stage"), F.lit(0).alias("pos"))
    return assembly.rendered(items).select(F.col("task").alias("doc_id"), F.md5("context").alias("context"))


@C.add("SELECT coalesce(source, 'none') AS source, count(*) AS n FROM documents GROUP BY 1")
def ctx_source_counts(spark, d):
    return assembly.source_counts(table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source")))


@C.add("SELECT count(*) AS n, coalesce(sum(c), 0)::BIGINT AS n_chars, round(count(*) * 0.25::DOUBLE, 6) AS cost FROM (SELECT left(md5(raw_code), 16) AS k, max(length(docstring)) AS c FROM entities WHERE raw_code IS NOT NULL GROUP BY 1)")
def cache_statistics(spark, d):
    held = table(spark, d, "entities").select(T.content_key(F.col("raw_code")).alias("key"), F.col("docstring").alias("abstract"))
    return assembly.cache_statistics(held, 0.25).withColumn("cost", F.round("cost", 6))


@C.add("""WITH t AS (SELECT file_id AS task, repo, file_path FROM source_files), a AS (SELECT DISTINCT repo FROM source_files WHERE n_bytes > 3000), f AS (SELECT DISTINCT repo, file_path FROM source_files WHERE language IS NOT NULL), c AS (SELECT DISTINCT file_id FROM parse_results WHERE module_docstring <> ''),
 s AS (SELECT t.repo, CASE WHEN a.repo IS NULL THEN 'no_archive' WHEN f.repo IS NULL THEN 'no_target' WHEN c.file_id IS NULL THEN 'no_context' ELSE 'ok' END AS s FROM t LEFT JOIN a ON t.repo = a.repo LEFT JOIN f ON t.repo = f.repo AND t.file_path = f.file_path LEFT JOIN c ON t.task = c.file_id)
 SELECT repo, count(*) AS tasks, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'no_archive') AS no_archive, count(*) FILTER (s = 'no_target') AS no_target, count(*) FILTER (s = 'no_context') AS no_context FROM s GROUP BY 1""")
def ctx_task_report(spark, d):
    f = table(spark, d, "source_files")
    contexts = table(spark, d, "parse_results").select(F.col("file_id").alias("task"), F.col("module_docstring").alias("context"))
    return assembly.task_report(f.select(F.col("file_id").alias("task"), "repo", F.col("file_path").alias("path")), f.where("n_bytes > 3000").select("repo"), f.where("language is not null").select("repo", F.col("file_path").alias("path")), contexts)


# Imports of names: each file asks for the first entities of the next file of its repository, by the module's last part.
@C.add(NEXT + """, w2 AS (SELECT file_id, name, string_split(module, '.')[-1] AS module FROM w), l2 AS (SELECT s.repo, x.* FROM x JOIN source_files s ON x.path = s.file_id || '/' || s.file_path), w3 AS (SELECT w2.*, s.repo FROM w2 JOIN source_files s USING (file_id)),
 k AS (SELECT w3.file_id, w3.name, w3.module, min(CASE WHEN contains(l2.path, w3.module) THEN '0' ELSE '1' END || l2.id) AS t FROM w3 JOIN l2 USING (repo, name) GROUP BY 1, 2, 3) SELECT file_id AS task, substr(t, 2) AS id FROM k""")
def code_resolve_symbols(spark, d):
    e = _listed(spark, d).withColumn("id", codegraph.entity_id(F.col("file_path"), F.col("name"), F.col("line_start")))
    files = table(spark, d, "source_files")
    path = F.concat_ws("/", F.col("file_id").cast("string"), "file_path")
    first = e.groupBy("file_path").agg(F.min_by("name", F.col("line_start") * 1000 + F.length("name")).alias("name"))
    follow = files.select(F.col("file_id").alias("task"), "repo", F.lead(path).over(codegraph.Window.partitionBy("repo").orderBy("file_id")).alias("next"))
    want = follow.join(first, F.col("next") == F.col("file_path")).select("task", "repo", "name", F.element_at(F.split(F.regexp_replace("next", r"\.\w+$", ""), "/"), -1).alias("module"), F.lit("from").alias("type"), F.lit(0).alias("place"))
    in_repo = e.join(files.select(path.alias("file_path"), "repo"), "file_path").select("repo", "name", "id", "file_path")
    return completion.resolved_imports(want, in_repo).select("task", "id")


@C.add("SELECT file_id FROM source_files ORDER BY file_id OFFSET 3 LIMIT 40")
def ctx_task_page(spark, d):
    return assembly.paged(table(spark, d, "source_files").select("file_id"), [F.col("file_id")], 3, 40)


@C.add("SELECT file_id, coalesce(m, '') AS context FROM source_files LEFT JOIN (SELECT file_id, max(module_docstring) AS m FROM parse_results WHERE module_docstring IS NOT NULL GROUP BY 1) USING (file_id)")
def ctx_fill_empty(spark, d):
    results = table(spark, d, "parse_results").where("module_docstring is not null").groupBy("file_id").agg(F.max("module_docstring").alias("context"))
    return assembly.with_empty(table(spark, d, "source_files").select("file_id"), results, "file_id")


# Style.
NAMING = r"""CASE WHEN coalesce(name, '') = '' THEN 'other' WHEN contains(name, '_') AND NOT regexp_matches(name, '\p{Lu}') THEN 'snake' WHEN regexp_matches(name, '^\p{Ll}') AND regexp_matches(name, '\p{Lu}') THEN 'camel' WHEN regexp_matches(name, '^\p{Lu}') THEN 'pascal' ELSE 'other' END"""
HINTS = r"""coalesce(contains(signature, '->') OR regexp_matches(signature, '\w+\s*:\s*\w+'), FALSE)"""
DOC = r"""CASE WHEN coalesce(docstring, '') = '' THEN 'none' WHEN regexp_matches(docstring, '\n\s*Args:') OR regexp_matches(docstring, '^\s*Args:') THEN 'google' WHEN regexp_matches(docstring, '\n\s*Parameters\s*\n\s*-+') THEN 'numpy' WHEN contains(docstring, ':param') OR contains(docstring, ':return:') THEN 'rest' ELSE 'google' END"""
PROFILE = f"""(SELECT <by> avg((nm = 'snake')::INT) AS naming_snake, avg((nm = 'camel')::INT) AS naming_camel, avg((nm = 'pascal')::INT) AS naming_pascal, avg(th::INT) AS type_hints,
 avg((ds = 'google')::INT) AS doc_google, avg((ds = 'numpy')::INT) AS doc_numpy, avg((ds = 'rest')::INT) AS doc_rest, avg((ds = 'none')::INT) AS doc_none,
 CASE WHEN sum(q1) + sum(q2) > 0 THEN sum(q1) / (sum(q1) + sum(q2)) ELSE 0 END AS quote_single, CASE WHEN sum(q1) + sum(q2) > 0 THEN sum(q2) / (sum(q1) + sum(q2)) ELSE 0 END AS quote_double,
 (sum(length(code)) - sum(nl) + count(*)) / sum(nl) AS avg_line_length, CASE WHEN sum(fn) + sum(me) > 0 THEN sum(fn) / (sum(fn) + sum(me)) ELSE 0 END AS functional_ratio, count(*) AS sample_size
 FROM (SELECT repo, {NAMING} AS nm, {HINTS} AS th, {DOC} AS ds, coalesce(raw_code, '') AS code, len(string_split(coalesce(raw_code, ''), chr(10))) AS nl, coalesce(regexp_matches(raw_code, '''[^'']*'''), FALSE)::INT AS q1, coalesce(regexp_matches(raw_code, '"[^"]*"'), FALSE)::INT AS q2,
  (type = 'function')::INT AS fn, (type = 'method')::INT AS me FROM entities JOIN source_files USING (file_id)) <group>)"""


def _profile(by: str = "") -> str:
    return PROFILE.replace("<by>", f"{by}," if by else "").replace("<group>", f"GROUP BY {by}" if by else "")


def _styled(spark, d):
    return table(spark, d, "entities").join(table(spark, d, "source_files").select("file_id", "repo"), "file_id")


@C.add(f"SELECT entity_id, {NAMING} AS naming, {HINTS} AS type_hints, {DOC} AS doc_style FROM entities")
def sty_detect(spark, d):
    e = table(spark, d, "entities")
    return e.select("entity_id", T.naming(F.col("name")).alias("naming"), T.has_type_hints(F.col("signature")).alias("type_hints"), T.doc_style(F.col("docstring")).alias("doc_style"))


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in [*style.SHARES, "avg_line_length"])


@C.add(f"SELECT repo, {ROUNDED}, sample_size FROM {_profile("repo")}")
def sty_profile(spark, d):
    p = style.profile(_styled(spark, d), ["repo"])
    return p.select("repo", *[F.round(c, 6).alias(c) for c in [*style.SHARES, "avg_line_length"]], "sample_size")


@C.add(f"""SELECT repo, 'Code style: ' || concat_ws(', ', 'Use ' || CASE WHEN naming_snake > 0.5 THEN 'snake_case' WHEN naming_camel > 0.5 THEN 'camelCase' WHEN naming_pascal > 0.5 THEN 'PascalCase' END || ' naming convention',
 CASE WHEN type_hints > 0.5 THEN 'include type hints' ELSE 'avoid type hints' END, 'use ' || CASE WHEN doc_google > 0.3 THEN 'Google-style' WHEN doc_numpy > 0.3 THEN 'NumPy-style' WHEN doc_rest > 0.3 THEN 'reST-style' END || ' docstrings',
 CASE WHEN quote_single > quote_double THEN 'prefer single quotes' ELSE 'prefer double quotes' END, CASE WHEN functional_ratio > 0.7 THEN 'favor functional programming' WHEN functional_ratio < 0.3 THEN 'favor object-oriented programming' END) || '.' AS style FROM {_profile("repo")}""")
def sty_instruction(spark, d):
    return style.profile(_styled(spark, d), ["repo"]).select("repo", style.instruction().alias("style"))


def _kl_sql(names: list[str]) -> str:
    p = [f"greatest(p.{n}, 1e-10::DOUBLE)" for n in names]
    q = [f"greatest(q.{n}, 1e-10::DOUBLE)" for n in names]
    sp, sq = " + ".join(p), " + ".join(q)
    return "(" + " + ".join(f"{a} / ({sp}) * ln(({a} / ({sp})) / ({b} / ({sq})))" for a, b in zip(p, q, strict=True)) + ")"


@C.add(f"""WITH p AS {_profile("repo")}, q AS {_profile()},
 v AS (SELECT repo, ({_kl_sql(["naming_snake", "naming_camel", "naming_pascal"])} + {_kl_sql(["doc_google", "doc_numpy", "doc_rest", "doc_none"])} + {_kl_sql(["quote_single", "quote_double"])} + abs(p.type_hints - q.type_hints) + abs(p.functional_ratio - q.functional_ratio)) / 5 AS v FROM p CROSS JOIN q)
 SELECT repo, round(v, 6) AS divergence, v > 0.15 AS update FROM v""")
def sty_kl_gate(spark, d):
    e = _styled(spark, d)
    return style.gate(style.profile(e, ["repo"]), style.profile(e, []), []).select("repo", F.round("divergence", 6).alias("divergence"), "update")


@C.add()
def sty_file_gate(spark, d):
    return style.file_gates(_styled(spark, d), "file_id", "repo", "entity_id").select("repo", "file_id", "divergence", "update")


@C.add("""SELECT f.file_id, f.k AS key, c.k IS NOT NULL AS hit FROM (SELECT file_id, file_path, left(md5(content), 16) AS k FROM source_files) f
 LEFT JOIN (SELECT DISTINCT left(md5(content), 16) AS k FROM source_files SEMI JOIN (SELECT file_id FROM parse_results WHERE len(entities) > 0) USING (file_id)) c USING (k)""")
def cache_hit_miss(spark, d):
    f = table(spark, d, "source_files").select("file_id", T.content_key(F.col("content")).alias("key"))
    parsed = table(spark, d, "parse_results").where("size(entities) > 0").select("file_id")
    cached = f.join(parsed, "file_id", "left_semi").select(F.col("key").alias("__k")).distinct()
    return f.join(cached, F.col("key") == F.col("__k"), "left").select("file_id", "key", F.col("__k").isNotNull().alias("hit"))

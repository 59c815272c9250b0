"""Queries of the hierarchy and multi-label operators on the test tables."""

from pyspark.sql import functions as F

from millrace.operators import classification
from millrace.operators import multilabel as ml
from millrace.operators import ontology as onto
from millrace.plans.catalogue import Catalogue
from millrace.plans.tables import table

C = Catalogue()

# A hierarchy over the parts with several parents: those of half and of a third of a part's number, so paths differ in length.
EDGES = "SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0"
CLOSED = f"""WITH RECURSIVE e AS ({EDGES}), c AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM e
 UNION SELECT c.ancestor, e.child, c.depth + 1 FROM c JOIN e ON c.descendant = e.parent)"""


def _edges(spark, d):
    p = table(spark, d, "part").where("p_partkey > 0")
    return p.select(F.col("p_partkey").alias("child"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("parent")).distinct()


def _nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


@C.add(f"SELECT * FROM ({EDGES}) WHERE parent IN (SELECT p_partkey FROM part)")
def onto_edges(spark, d):
    return onto.valid_edges(_edges(spark, d), _nodes(spark, d))


@C.add(CLOSED + " SELECT ancestor, descendant, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2")
def onto_closure(spark, d):
    return onto.closure(_edges(spark, d))


@C.add(CLOSED + """, l AS (SELECT descendant AS node, max(depth) AS level FROM c GROUP BY 1)
 SELECT p_partkey AS node, CAST(coalesce(level, 0) AS INTEGER) AS level FROM part LEFT JOIN l ON p_partkey = node""")
def onto_topo_level(spark, d):
    return onto.levels(_edges(spark, d), _nodes(spark, d))


SCORES = "(SELECT l_orderkey AS item, l_partkey AS node, max(l_discount * 10) AS score FROM lineitem GROUP BY 1, 2)"


def _scores(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("node")).agg(F.max(F.col("l_discount") * 10).alias("score"))


@C.add(CLOSED + f""", p AS (SELECT DISTINCT ancestor, descendant FROM c), s AS {SCORES},
 u AS (SELECT * FROM s UNION ALL SELECT s.item, p.ancestor, s.score FROM s JOIN p ON s.node = p.descendant) SELECT item, node, max(score) AS score FROM u GROUP BY 1, 2""")
def onto_enforce_max(spark, d):
    return onto.consistent_along(_scores(spark, d), _edges(spark, d))


@C.add(f"""WITH e AS ({EDGES}), s AS {SCORES}, l AS MATERIALIZED (SELECT item, node, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS label FROM s),
 x AS MATERIALIZED (SELECT item, parent AS node FROM l JOIN e ON node = child WHERE label = 1) SELECT count(*) AS n FROM x JOIN l USING (item, node) WHERE label = 0""")
def onto_inconsistencies(spark, d):
    labels = _scores(spark, d).select("item", "node", (F.col("score") >= 0.5).cast("int").alias("label"))
    return onto.inconsistencies(labels, _edges(spark, d))


SCORED = "(SELECT l_orderkey * 10 + l_linenumber AS item, l_returnflag AS cls, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS y, l_discount * 10 AS p FROM lineitem)"


def _scored(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_returnflag").alias("cls"), (F.col("l_tax") > 0.04).cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))


@C.add(f"""WITH s AS {SCORED}, f AS (SELECT cls, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM s GROUP BY 1)
 SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM f""")
def ml_f1_macro(spark, d):
    s = _scored(spark, d)
    return ml.macro_f1(s, s.select("cls")).select(F.round("macro_f1", 6).alias("macro_f1"))


@C.add(f"""WITH s AS {SCORED}, t AS (SELECT unnest([{", ".join(map(str, ml.GRID))}]::DOUBLE[]) AS threshold),
 g AS (SELECT cls, y, p, count(*) AS n FROM s GROUP BY ALL),
 f AS (SELECT cls, threshold, coalesce(sum(n) FILTER (p >= threshold AND y = 1), 0) AS tp, coalesce(sum(n) FILTER (p >= threshold AND y = 0), 0) AS fp, coalesce(sum(n) FILTER (p < threshold AND y = 1), 0) AS fn FROM g CROSS JOIN t GROUP BY 1, 2),
 r AS (SELECT cls, threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM f)
 SELECT cls, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, threshold) AS k FROM r) WHERE k = 1""")
def ml_threshold_search(spark, d):
    return ml.best_thresholds(_scored(spark, d)).select("cls", "threshold", F.round("f1", 6).alias("f1"))


@C.add(f"SELECT cls, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 6) AS weight FROM {SCORED} GROUP BY 1")
def ml_pos_weight(spark, d):
    return ml.positive_weights(_scored(spark, d)).withColumn("weight", F.round("weight", 6))


@C.add("SELECT l_partkey AS item, l_returnflag AS cls, round(sum(l_discount / 5), 6) AS p FROM lineitem GROUP BY 1, 2")
def ml_fold_average(spark, d):
    li = table(spark, d, "lineitem")
    return ml.fold_average(li.select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("cls"), F.col("l_discount").alias("p")), 5).withColumn("p", F.round("p", 6))


@C.add("SELECT o_orderkey, CAST(CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders")
def ml_kfold(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ml.fold_of(F.col("o_orderkey"), 5).alias("fold"))


@C.add("""SELECT l_orderkey AS item, CAST(coalesce(max(CASE WHEN l_returnflag = 'A' THEN 1 END), 0) AS INTEGER) AS "A", CAST(coalesce(max(CASE WHEN l_returnflag = 'N' THEN 1 END), 0) AS INTEGER) AS "N",
 CAST(coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 END), 0) AS INTEGER) AS "R" FROM lineitem GROUP BY 1""")
def ml_wide_long(spark, d):
    long = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("cls"), F.lit(1).alias("label"))
    wide = ml.to_wide(long, ["item"], ["A", "N", "R"])
    back = ml.to_long(wide, ["item"], ["A", "N", "R"], "cls", "label")
    return ml.to_wide(back, ["item"], ["A", "N", "R"])


# Four classes of a line item, one above two others, with a probability each.
CLASSES = """(SELECT l_orderkey * 10 + l_linenumber AS item, unnest([{'cls': 'A', 'y': (l_returnflag = 'A')::INT, 'p': l_discount * 10}, {'cls': 'R', 'y': (l_returnflag = 'R')::INT, 'p': l_tax * 12}, {'cls': 'N', 'y': (l_returnflag = 'N')::INT, 'p': l_quantity / 50},
 {'cls': 'back', 'y': (l_returnflag <> 'N')::INT, 'p': (l_discount + l_tax) * 4}], recursive := true) FROM lineitem)"""
OVER = "(VALUES ('A', 'back'), ('R', 'back')) e(child, parent)"


def _classed(spark, d):
    c = F.col
    cells = F.array(*[F.struct(F.lit(n).alias("cls"), y.cast("int").alias("y"), p.alias("p")) for n, y, p in (("A", c("l_returnflag") == "A", c("l_discount") * 10), ("R", c("l_returnflag") == "R", c("l_tax") * 12), ("N", c("l_returnflag") == "N", c("l_quantity") / 50), ("back", c("l_returnflag") != "N", (c("l_discount") + c("l_tax")) * 4))])
    return table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("item"), F.inline(cells))


def _over(spark):
    return spark.createDataFrame([("A", "back"), ("R", "back")], "child string, parent string")


AGREED = f"""WITH s AS MATERIALIZED {CLASSES}, t AS (SELECT unnest([{", ".join(map(str, ml.GRID))}]::DOUBLE[]) AS threshold), g AS (SELECT cls, y, p, count(*) AS n FROM s GROUP BY ALL),
 f AS (SELECT cls, threshold, coalesce(sum(n) FILTER (p >= threshold AND y = 1), 0) AS tp, coalesce(sum(n) FILTER (p >= threshold AND y = 0), 0) AS fp, coalesce(sum(n) FILTER (p < threshold AND y = 1), 0) AS fn FROM g CROSS JOIN t GROUP BY 1, 2),
 b AS (SELECT cls, threshold FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END DESC, threshold) AS k FROM f) WHERE k = 1),
 r AS (SELECT item, cls, max(p) AS p FROM (SELECT item, cls, p FROM s UNION ALL SELECT item, parent, p FROM s JOIN {OVER} ON cls = child) GROUP BY 1, 2),
 o AS (SELECT item, cls, p, (p >= threshold)::INT AS label FROM r JOIN b USING (cls)), l AS (SELECT item, cls, max(label) AS label FROM (SELECT item, cls, label FROM o UNION ALL SELECT item, parent, label FROM o JOIN {OVER} ON cls = child) GROUP BY 1, 2)"""


@C.add(AGREED + " SELECT l.item, l.cls, round(o.p, 6) AS p, CAST(l.label AS INTEGER) AS label FROM l JOIN o ON l.item = o.item AND l.cls = o.cls")
def ml_agreeing_labels(spark, d):
    """The steps after the models, on probabilities made from the table: thresholds, hierarchy, labels."""
    scored = _classed(spark, d)
    return classification.agreeing_labels(scored, scored.select("item", "cls", "p"), _over(spark)).withColumn("p", F.round("p", 6))


@C.add(AGREED + """, j AS (SELECT l.cls, y, label FROM l JOIN s USING (item, cls)), k AS (SELECT cls, count(*) FILTER (label = 1 AND y = 1) AS tp, count(*) FILTER (label = 1 AND y = 0) AS fp, count(*) FILTER (label = 0 AND y = 1) AS fn FROM j GROUP BY 1)
 SELECT cls, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM k""")
def ml_agreeing_f1(spark, d):
    scored = _classed(spark, d)
    labels = classification.agreeing_labels(scored, scored.select("item", "cls", "p"), _over(spark)).select("item", "cls", F.col("label").cast("double").alias("p"))
    return ml.f1_per_class(labels.join(scored.select("item", "cls", "y"), ["item", "cls"])).select("cls", F.round("f1", 6).alias("f1"))


@C.add("SELECT l_orderkey * 10 + l_linenumber AS item, CAST((l_discount * 10 >= 0.5) AS INTEGER) AS label FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey * 10 + l_linenumber, CAST((l_discount * 10 >= 0.7) AS INTEGER) FROM lineitem WHERE l_returnflag = 'R'")
def ml_labelled(spark, d):
    """Labels by given thresholds; class N has none and is left out."""
    limits = spark.createDataFrame([("A", 0.5), ("R", 0.7)], "cls string, threshold double")
    return ml.labelled(_scored(spark, d), limits).select("item", "label")


def _returned(spark, d):
    from pyspark.ml.feature import VectorAssembler

    li = table(spark, d, "lineitem").withColumn("item", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = li.withColumns({c: (F.col("l_returnflag") == c).cast("int") for c in ("A", "N", "R")}).withColumn("back", 1 - F.col("N"))
    return VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], outputCol="features").transform(rows)


@C.add()
def ml_ovr_gbt(spark, d):
    """Out-of-fold probabilities of what became of a line item, from its numbers: a model for each class and fold."""
    rows = _returned(spark, d)
    return classification.boosted_folds(rows, rows.select("item", "features"), ["A", "N", "R"], item="item")[0]


@C.add()
def ml_pipeline(spark, d):
    """From features to labels that agree with the hierarchy; what is labelled are the orders' line items themselves."""
    rows = _returned(spark, d)
    held, tested = classification.boosted_folds(rows, rows.select("item", "features"), ["A", "N", "R", "back"], item="item")
    return classification.agreeing_labels(held, tested, _over(spark))

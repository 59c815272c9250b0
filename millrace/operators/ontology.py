"""Hierarchies as edge tables (child, parent): closure, levels, scores made consistent with the hierarchy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from millrace.plans.shared import written

SENT = 4_000_000  # edges that are sent to all executors
AT_ONCE = 20_000  # scores that are raised at one time


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both nodes (node), each once; null ends are dropped."""
    known = nodes.select(F.col("node").alias("__n")).where("__n is not null").distinct()
    return edges.select("child", "parent").distinct().join(known, F.col("child") == F.col("__n"), "left_semi").join(known, F.col("parent") == F.col("__n"), "left_semi")


def closure(edges: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(ancestor, descendant, depth): all pairs on a path of edges, by the shortest; cycles give a node as its own ancestor.

    By doubling: once all pairs up to depth d are known, those of depth d to 2 d are the pairs of depth exactly d, each
    followed by any known pair, as the first d steps of a shortest path are a shortest path. So a pair is found once for each
    node in its middle, and the rounds grow as the logarithm of the depth. Each round's result is written, which cuts the
    lineage. Raises if paths are longer than ``limit``.
    """
    known = written(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).where("ancestor is not null and descendant is not null").distinct().withColumn("depth", F.lit(1)), "closure")
    reach = 1
    while reach <= limit:
        top = known.where(F.col("depth") == reach).select("ancestor", F.col("descendant").alias("__via"))
        rest = known.select(F.col("ancestor").alias("__via"), "descendant", "depth")
        far = top.join(rest, "__via").groupBy("ancestor", "descendant").agg((F.min("depth") + reach).alias("depth"))
        found = written(far.join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"), "closure")
        if found.isEmpty():
            return known
        known = known.unionByName(found)
        reach *= 2
    raise RuntimeError(f"paths are longer than {limit}")


def levels(edges: DataFrame, nodes: DataFrame, limit: int = 1_000) -> DataFrame:
    """(node, level): the length of the longest path from a root; nodes on a cycle or below one are left out.

    The order of ``level`` is a topological order, found by peeling: a round takes the nodes whose parents are all taken.
    More than ``limit`` levels below the roots raise.
    """
    step = written(edges.select("child", "parent").distinct(), "level-edges")
    left = nodes.select("node").where("node is not null").distinct()
    done = None
    for level in range(limit + 2):
        held = step.join(left, F.col("parent") == F.col("node"), "left_semi").select("child").distinct()
        round_ = written(left.join(held, F.col("node") == F.col("child"), "left").select("node", F.col("child").isNull().alias("free")), "levels")
        free = round_.where("free").select("node", F.lit(level).alias("level"))
        if free.isEmpty():
            break
        if level > limit:
            raise RuntimeError(f"there are more than {limit} levels")
        done = free if done is None else done.unionByName(free)
        left = round_.where("not free").select("node")
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def consistent(scores: DataFrame, closed: DataFrame, *, item: str = "item", node: str = "node", score: str = "score") -> DataFrame:
    """scores with each node's score raised to the largest of its descendants' for the same item.

    Nodes without a score of their own get their descendants' largest. closed: as ``closure`` gives it. Scores are
    reduced before the shuffle by partial maxima.
    """
    up = scores.join(closed.select("ancestor", F.col("descendant").alias("__d")), F.col(node) == F.col("__d")).select(item, F.col("ancestor").alias(node), score)
    return scores.select(item, node, score).unionByName(up).groupBy(item, node).agg(F.max(score).alias(score))


def consistent_along(scores: DataFrame, edges: DataFrame, *, most: int = 100_000, item: str = "item", node: str = "node", score: str = "score") -> DataFrame:
    """As ``consistent`` with the closure of edges (child, parent), without a shuffle of the raised scores: only scores are grouped by item.

    Each task walks up the edges, which are sent to all executors, for some items at a time. For more than SENT edges, nodes
    that aren't longs or scores that aren't doubles, and for items of more than ``most`` scores, the closure is joined instead.
    """
    edges = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    scores = scores.select(item, node, score)
    typed = isinstance(scores.schema[node].dataType, LongType) and isinstance(scores.schema[score].dataType, DoubleType)
    pairs = edges.select(F.col("child").cast("long"), F.col("parent").cast("long")).limit(SENT + 1).toArrow() if typed else None
    if pairs is None or pairs.num_rows > SENT:
        return consistent(scores, closure(edges), item=item, node=node, score=score)
    child, parent = (pairs[c].to_numpy().astype(np.int64) for c in ("child", "parent"))
    order = np.argsort(child, kind="stable")
    shared = scores.sparkSession.sparkContext.broadcast((child[order], parent[order]))

    def raised(t: pa.Table) -> Iterator[pa.RecordBatch]:
        child, parent = shared.value
        codes = t[item].combine_chunks().dictionary_encode("encode")
        of = codes.indices.to_numpy()
        nodes = np.unique(np.concatenate([t[node].to_numpy(), parent]))
        key = of.astype(np.int64) * len(nodes) + np.searchsorted(nodes, t[node].to_numpy())
        value = np.where(t[score].is_null().to_numpy(), -np.inf, t[score].to_numpy(zero_copy_only=False))

        def largest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            o = np.lexsort((value, key))
            key, value = key[o], value[o]
            last = np.concatenate([key[1:] != key[:-1], [True]])
            return key[last], value[last]

        key, value = largest(key, value)
        new, new_value = key, value
        while len(new):
            own = nodes[new % len(nodes)]
            first, n = np.searchsorted(child, own, "left"), np.searchsorted(child, own, "right")
            n -= first
            ends = np.cumsum(n)
            if not ends[-1]:
                break
            up = parent[np.arange(ends[-1]) - np.repeat(ends - n - first, n)]
            new, new_value = largest(np.repeat(new // len(nodes) * len(nodes), n) + np.searchsorted(nodes, up), np.repeat(new_value, n))
            # Only what betters a score, or is new, goes on; so cycles end.
            at = np.minimum(np.searchsorted(key, new), len(key) - 1)
            known = key[at] == new
            better = ~known | (new_value > value[at]) | (np.isnan(new_value) & ~np.isnan(value[at]))
            value[at[known & better]] = new_value[known & better]
            fresh = ~known
            where = np.searchsorted(key, new[fresh])
            key, value = np.insert(key, where, new[fresh]), np.insert(value, where, new_value[fresh])
            new, new_value = new[better], new_value[better]
        items = codes.dictionary.take(pa.array(key // len(nodes)))
        out = pa.table({item: items, node: nodes[key % len(nodes)], score: pa.array(value, mask=np.isneginf(value))})
        yield from out.to_batches(100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= AT_ONCE:
                t = pa.Table.from_batches(held)
                of = t[item].combine_chunks().dictionary_encode("encode").indices.to_numpy()
                change = np.nonzero(of[1:] != of[:-1])[0]
                if len(change):
                    cut = int(change[-1]) + 1
                    yield from raised(t.slice(0, cut))
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from raised(pa.Table.from_batches(held))

    given = scores.where(F.col(node).isNotNull())
    large = written(given.groupBy(item).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(F.col(item).alias("__i")), "large-items")
    some = not large.isEmpty()
    small = given.join(large, F.col(item).eqNullSafe(F.col("__i")), "left_anti") if some else given
    out = small.repartition(F.col(item)).sortWithinPartitions(item).mapInArrow(run, scores.schema)
    out = out.unionByName(scores.where(F.col(node).isNull()).groupBy(item, node).agg(F.max(score).alias(score)))
    if some:
        out = out.unionByName(consistent(given.join(large, F.col(item).eqNullSafe(F.col("__i")), "left_semi"), closure(edges), item=item, node=node, score=score))
    return out


def inconsistencies(labels: DataFrame, edges: DataFrame, *, item: str = "item", node: str = "node", label: str = "label") -> DataFrame:
    """One row (n): how often a child is labelled 1 for an item whose parent is labelled 0."""
    child = labels.where(F.col(label) == 1).select(item, F.col(node).alias("child"))
    parent = labels.where(F.col(label) == 0).select(F.col(item).alias("__i"), F.col(node).alias("__p"))
    e = edges.select("child", "parent").distinct()
    return child.join(e, "child").join(parent, (F.col(item) == F.col("__i")) & (F.col("parent") == F.col("__p"))).agg(F.count("*").alias("n"))

"""Filling containers of fixed capacity with texts: a grouping genetic algorithm on islands."""

import base64
import hashlib
import os
import random
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.shared import once, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PER_SHARD = 2_000
LARGEST_VOCABULARY = 64_000_000  # bytes of a ranks file that is sent to the workers


def token_counts(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc, n_tokens) of every document with an id and a text, counted by a public tokenizer's ranks file.

    The file is read by the driver and sent to the workers, which need not have it; a file over LARGEST_VOCABULARY raises.
    """
    if os.path.getsize(tokenizer) > LARGEST_VOCABULARY:
        raise ValueError(f"{tokenizer} has more than {LARGEST_VOCABULARY} bytes")
    with open(tokenizer, "rb") as held:
        content = held.read()
    name = f"tokenizer {hashlib.sha256(content + pattern.encode()).hexdigest()}"
    shared = docs.sparkSession.sparkContext.broadcast(content)
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    kind = dict(source.dtypes)["doc"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def encoder() -> Callable[[str], list[int]]:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        encode = once(name, encoder)
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "n_tokens": [len(encode(t)) for t in b["text"]]})

    return source.mapInPandas(run, f"doc {kind}, n_tokens long").withColumnRenamed("doc", doc)


class Packing:
    """A solution: bins of item numbers, and each bin's load."""

    __slots__ = ("bins", "load")

    def __init__(self, bins: list[list[int]], load: list[int]):
        self.bins, self.load = bins, load

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then the more uneven: a sum of squared loads, so that well-filled bins count."""
        return -len(self.bins), sum(x * x for x in self.load) / (capacity * capacity)


def best_fit(bins: list[list[int]], load: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Puts items, in the order given, into the fullest bin that still holds them, or a new one."""
    free = sorted((capacity - x, k) for k, x in enumerate(load))
    for i in items:
        s = sizes[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
            load[k] += s
            insort(free, (room - s, k))
        else:
            bins.append([i])
            load.append(s)
            insort(free, (capacity - s, len(bins) - 1))
    return Packing(bins, load)


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """A child of a: whole well-filled bins of b are injected, a's bins that share an item with them are dissolved,

    and the displaced items go, largest first, where they fit best."""
    ranked = sorted(range(len(b.bins)), key=lambda k: -b.load[k])
    well = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(well, max(1, len(well) // rng.randint(2, 6)))
    injected = [b.bins[k][:] for k in chosen]
    taken = {i for bin_ in injected for i in bin_}
    kept = [k for k, bin_ in enumerate(a.bins) if taken.isdisjoint(bin_)]
    held = set(kept)
    displaced = [i for k, bin_ in enumerate(a.bins) if k not in held for i in bin_ if i not in taken]
    return _mutated([a.bins[k][:] for k in kept] + injected, [a.load[k] for k in kept] + [b.load[k] for k in chosen], displaced, sizes, capacity, rng)


def _mutated(bins: list[list[int]], load: list[int], displaced: list[int], sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """The emptiest and two random bins are dissolved too; then all loose items are placed anew."""
    for _ in range(min(3, len(bins) - 1)):
        k = min(range(len(load)), key=load.__getitem__) if _ == 0 else rng.randrange(len(bins))
        displaced += bins[k]
        bins[k], load[k] = bins[-1], load[-1]
        bins.pop()
        load.pop()
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(bins, load, displaced, sizes, capacity)


def evolve(sizes: list[int], capacity: int, elites: list[list[int]], seed: int, population: int, generations: int) -> list[list[int]]:
    """Two elite solutions (for each item its bin) after some generations on one island, the best first.

    elites: solutions to start from (its own and migrants); the population is filled up by best fit in orders that are
    shuffled ever more. Ends early at the least possible number of bins.
    """
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    descending = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = [_decoded(e, sizes) for e in elites]
    while len(people) < population:
        blur = 0.02 * len(people)
        order = sorted(descending, key=lambda i: -sizes[i] * (1 + rng.uniform(-blur, blur)))
        people.append(best_fit([], [], order, sizes, capacity))
        if len(people[-1].bins) <= least:
            break
    people.sort(key=lambda p: p.fitness(capacity), reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least or len(people) < 2:
            break
        children = []
        for _ in range(max(1, population // 2)):
            a, b = (min(rng.sample(range(len(people)), 2)) for _ in range(2))
            children.append(cross(people[a], people[b if b != a else (a + 1) % len(people)], sizes, capacity, rng))
        people = sorted(people + children, key=lambda p: p.fitness(capacity), reverse=True)[:population]
    return [_encoded(p, len(sizes)) for p in people[:2]]


def _encoded(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, bin_ in enumerate(p.bins):
        for i in bin_:
            out[i] = k
    return out


def _decoded(of: list[int], sizes: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
    load = [0] * len(bins)
    for i, k in enumerate(of):
        bins[k].append(i)
        load[k] += sizes[i]
    return Packing(bins, load)


def pack(items: DataFrame, capacity: int, *, islands: int = 3, population: int = 6, generations: int = 8, epochs: int = 2, rounds: int = 3, per_shard: int = PER_SHARD, seed: int = 17) -> DataFrame:
    """(item, size, container_id) for items (item: a unique id, size: at most capacity), every item whole and once.

    Items are spread by hash over shards of about per_shard, so no task holds more, whatever the input's size. Each shard
    is evolved on several islands; after an epoch each island's elite migrates to the next. The best solution's
    containers are kept, but for the least filled ones of each shard: their items meet those of other shards
    in the next round. Items that fill a container alone need no search. Sizes of 0 are packed like any other.
    """
    pool = items.select("item", F.col("size").cast("int").alias("size"))
    kind = dict(pool.dtypes)["item"]
    full = pool.where(F.col("size") >= capacity).select("item", "size", F.concat(F.lit("f"), F.col("item").cast("string")).alias("container_id"))
    pool = pool.where(F.col("size") < capacity)
    results = [full]
    for round_ in range(rounds):
        n = pool.count()
        if not n:
            break
        shards = max(1, round(n / per_shard))
        last = round_ == rounds - 1 or shards == 1
        grouped = pool.groupBy(F.pmod(F.xxhash64(F.col("item"), F.lit(round_)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("items"))
        state = grouped.select("shard", F.col("items.item").alias("ids"), F.col("items.size").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("elites"))
        for epoch in range(epochs):
            state = _epoch(state, kind, capacity, seed + 1000 * round_ + epoch, population, generations)
            if epoch < epochs - 1:
                # Read twice, by the islands themselves and by those that their elites migrate to.
                state = written(state, f"packing-{round_}-{epoch}")
                own = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elites", 1, 1).alias("migrants"))
                state = state.join(own, ["shard", "island"]).select("shard", "ids", "sizes", "island", F.concat("elites", "migrants").alias("elites"))
        best = state.groupBy("shard").agg(F.min_by(F.struct("ids", "sizes", F.get("elites", F.lit(0)).alias("of")), F.struct(F.array_max(F.get("elites", F.lit(0))), F.col("island"))).alias("b"))
        rows = best.select("shard", F.inline(F.arrays_zip(F.col("b.ids").alias("item"), F.col("b.sizes").alias("size"), F.col("b.of").alias("bin"))))
        rows = written(rows, f"packing-{round_}")
        name = F.concat_ws("-", F.lit(f"r{round_}"), F.col("shard").cast("string"), F.col("bin").cast("string"))
        if last:
            results.append(rows.select("item", "size", name.alias("container_id")))
            break
        # The emptiest twentieth of a shard's containers, and all that are less than nine tenths full.
        loads = rows.groupBy("shard", "bin").agg(F.sum("size").alias("load"))
        ranked = loads.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("load", "bin"))).alias("b"))
        open_ = ranked.select("shard", F.explode(F.expr(f"filter(b, (x, i) -> i < ceil(size(b) / 20.0) or x.load < {capacity} * 0.9)")).alias("x")).select("shard", F.col("x.bin").alias("bin"))
        results.append(rows.join(open_, ["shard", "bin"], "left_anti").select("item", "size", name.alias("container_id")))
        pool = rows.join(open_, ["shard", "bin"]).select("item", "size")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _epoch(state: DataFrame, kind: str, capacity: int, seed: int, population: int, generations: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            elites = []
            for shard, island, sizes, known in zip(b["shard"], b["island"], b["sizes"], b["elites"], strict=True):
                elites.append(evolve([int(x) for x in sizes], capacity, [[int(x) for x in e] for e in known], seed * 7919 + int(shard) * 31 + int(island), population, generations))
            yield b.assign(elites=elites)

    # One island a row: small batches, spread over the cluster.
    spread = state.repartition(F.col("shard"), F.col("island"))
    return spread.mapInPandas(run, f"shard bigint, ids array<{kind}>, sizes array<int>, island int, elites array<array<int>>")


def packed(docs: DataFrame, capacity: int = 2_048, *, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, **how) -> DataFrame:
    """(doc, piece, n_tokens, container_id): every document with a text, in one piece if it fits a container.

    Longer texts are cut every ``capacity`` tokens (piece 0, 1, ...). Empty texts have one piece of no tokens. doc must be
    unique; equal texts are packed one by one. Documents with null text have no row.
    """
    counts = written(token_counts(docs, doc=doc, text=text, tokenizer=tokenizer), "packing-tokens")
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int")
    pieces = counts.select(F.col(doc).alias("doc"), "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity)
    items = pieces.select(F.struct("doc", "piece").alias("item"), size.alias("size"))
    done = pack(items, capacity, **how)
    return done.select(F.col("item.doc").alias(doc), F.col("item.piece").alias("piece"), F.col("size").cast("long").alias("n_tokens"), "container_id")


def filling(packing: DataFrame, capacity: int = 2_048) -> DataFrame:
    """(n_containers, least_possible, n_tokens, fill): how well the containers are filled."""
    loads = packing.groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(F.count("*").alias("n_containers"), F.ceil(F.sum("load") / capacity).cast("long").alias("least_possible"), F.sum("load").alias("n_tokens"), (F.sum("load") / (F.count("*") * capacity)).alias("fill"))

"""Evaluation texts leaking into a corpus: a prefix-filtered set join on word shingles, with positional bounds and exact alignment."""

import html
import re
import sys
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.lookalikes import changing_pattern, form
from millrace.plans.shared import once

SHINGLE = 3  # words; with one word in eight changed, five-word shingles would leave too little in common
BAND = 16  # how far (document place - item place) may wander within a passage, in words
BATCH_CHARS = 2_000_000  # of texts that are read at once; one longer text is read alone
BATCH_WORDS = 500_000  # of words that are numbered at once

_TAG = re.compile(r"""</?[A-Za-z][\w:-]*+(?>\s+[\w:-]+(?>\s*=\s*(?>"[^"]*"|'[^']*'|[^\s"'=<>`]+))?+)*+\s*/?>""")
_HYPHEN = re.compile(r"(?<=\w)[-‐]\r?\n[ \t]*(?=[a-zß-ÿ])")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"""(?<=[.!?:;…])["”’»)]*\s+|\n+""")


def evened(text: str) -> str:
    """The text without case, typography and markup: look-alike characters mapped, tags and entities dropped."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = form(text)
    if "-\n" in text or "-\r" in text:
        text = _HYPHEN.sub("", text)
    return text.lower()


def words_of(text: str) -> list[str]:
    return _WORD.findall(evened(text))


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence or line; together they are the text's words."""
    return [w for part in _SENTENCE.split(evened(text)) if (w := _WORD.findall(part))]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each code point belongs to a word, a number for each, and one for each place in a word."""
    points = np.arange(1, sys.maxunicode + 2, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)]), _mixed(points * np.uint64(0x9E3779B97F4A7C15)), _mixed(points[: 1 << 16] * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, words): 64-bit numbers of the words of evened texts, and where each text's words begin (and the end)."""
    inside, letter, place = once("leak letters", _letters)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.zeros(len(points) + 2, bool)
    own[1:-1] = inside[points]
    edge = np.nonzero(own[1:] != own[:-1])[0]
    first, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.searchsorted(first, ends, "left")])
    out = np.empty(len(first), np.uint64)
    for lo in range(0, len(first), BATCH_WORDS):
        a, n = first[lo : lo + BATCH_WORDS], end[lo : lo + BATCH_WORDS] - first[lo : lo + BATCH_WORDS]
        at = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(at, n)
        with np.errstate(over="ignore"):
            out[lo : lo + len(a)] = _mixed(np.add.reduceat(letter[points[np.repeat(a, n) + inner]] * place[inner & 0xFFFF], at) + n.astype(np.uint64))
    return starts, out


def read(docs: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str], np.ndarray, np.ndarray]]:
    """(documents, their texts evened, starts, words) of a batch without nulls, some documents at a time."""
    ok = pc.and_(pc.is_valid(docs), pc.is_valid(texts))
    docs, texts = docs.filter(ok), texts.filter(ok)
    if not len(docs):
        return
    # Most texts need nothing but lower case, which a search finds out faster than the mapping.
    odd = pc.match_substring_regex(texts, once("leak odd", lambda: changing_pattern() + "|[<&]|[-‐]\r?\n")).to_numpy(zero_copy_only=False)
    done, held, size = 0, [], 0
    for k, (text, other) in enumerate(zip(texts.to_pylist(), odd, strict=True)):
        held.append(evened(text) if other else text.lower())
        size += len(text)
        if size >= BATCH_CHARS or k == len(docs) - 1:
            yield docs[done : k + 1].to_pylist(), held, *numbered(held)
            done, held, size = k + 1, [], 0


def shingles(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit numbers of the SHINGLE-word shingles at each word; 0 where a text's words end before."""
    h = np.zeros(len(words), np.uint64)
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return h
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            h[:n] = h[:n] * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n] + np.uint64(1)
            h[:n] ^= h[:n] >> np.uint64(29)
    for back in range(1, SHINGLE):
        last = starts[1:] - back
        h[last[last >= 0]] = 0
    return h


class Items:
    """A block of evaluation texts, with what a scan of the corpus needs: all of it bounded by the block's words."""

    def __init__(self, rows: list[tuple[int, str, list[tuple[int, int]]]], least: int, changed: float):
        kept = [(i, w, stock or []) for i, t, stock in rows if len(w := words_of(t)) >= least]
        self.ids = [i for i, _, _ in kept]
        self.words = [w for _, w, _ in kept]
        # Of each item, the words within runs that many items have.
        self.stock = [np.zeros(len(w), bool) for w in self.words]
        for mask, (_, _, runs) in zip(self.stock, kept, strict=True):
            for a, e in runs:
                mask[a:e] = True
        self.least = least
        self.window = least - SHINGLE + 1
        # Every changed word takes SHINGLE shingles from a window at most.
        self.needed = max(1, self.window - SHINGLE * round(least * changed))
        starts, numbers = numbered([" ".join(w) for w in self.words])
        of_item = np.repeat(np.arange(len(self.words)), np.diff(starts))
        place = np.arange(len(numbers)) - starts[of_item]
        flat = shingles(numbers, starts)
        whole = place < np.diff(starts)[of_item] - SHINGLE + 1
        flat, item, place = flat[whole], of_item[whole], place[whole]
        self.known, of = np.unique(flat, return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.known)))]).astype(np.int64)
        self.item, self.place, self.listed = item[order].astype(np.int32), place[order].astype(np.int32), of
        self.per_item = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(self.words)))]).astype(np.int64)
        bits = max(16, int(np.ceil(np.log2(len(self.known) * 16 + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.known & self.mask] = True
        self.prefix = np.ones(len(flat), bool)

    @classmethod
    def of(cls, state: dict) -> "Items":
        block = cls.__new__(cls)
        block.__dict__.update(state)
        return block

    def choose(self, frequency: np.ndarray) -> None:
        """Marks the shingles that must be joined: of each item-sized window, so many of the rarest in the corpus that a

        document with ``needed`` of the window's shingles has one of them.
        """
        many = self.window - self.needed + 1
        chosen = np.zeros(len(self.listed), bool)
        # Rank by rarity; equal ones by their number, so that all windows agree.
        rank = np.empty(len(self.known), np.int64)
        rank[np.lexsort((self.known, frequency))] = np.arange(len(self.known))
        for k in range(len(self.words)):
            lo, hi = self.per_item[k], self.per_item[k + 1]
            r = rank[self.listed[lo:hi]]
            for s in range(0, hi - lo - self.window + 1):
                chosen[lo + s + np.argpartition(r[s : s + self.window], many - 1)[:many]] = True
        order = np.argsort(self.listed, kind="stable")
        self.prefix = chosen[order]
        self.rare = np.zeros(len(self.known), bool)
        self.rare[self.listed[chosen]] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in h that hold known shingles, and which."""
        maybe = np.nonzero(self.table[h & self.mask])[0]
        if not len(maybe) or not len(self.known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        ok = self.known[k] == h[maybe]
        return maybe[ok], k[ok]

    def expand(self, of: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each listing of the shingles, the entry of ``of`` beside the shingle, and the listing's number."""
        n = self.at[which + 1] - self.at[which]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.at[which], n)
        return np.repeat(of, n), j


def align(doc: np.ndarray, item: np.ndarray, stock: np.ndarray, least: int, changed: float, lo: int, hi: int) -> tuple[int, int, int, int] | None:
    """(words, same, item_start, doc_start) of the longest passage of the item in order in the document's words, or None.

    words counts the item's words from the first to the last that agree; the words that don't (in the longer of both
    texts) may be at most ``changed`` of them, rounded to the nearest. ``least`` words must be no stock, less those that may have changed.
    Only passages that begin on the diagonals (document place - item place) lo to hi - 1 count; of equally long ones
    that with the most agreeing words, then the first in the item, then in the document.

    Exact: from each pair of equal words, longest common subsequences over the diagonals a passage can wander to. Pairs
    are left out whose words within those diagonals can't make a passage as long as the longest so far.
    """
    n, far = len(item), int(len(item) * changed + 0.5)
    wide = 2 * far + 1
    # Equal words by item place and diagonal, from lo - far on.
    columns = np.arange(lo - far, hi + far)
    padded = np.full(n + len(columns) - 1, -1, np.int64)
    inside = slice(max(0, columns[0]), max(0, columns[0] + len(padded)))
    padded[inside.start - columns[0] :][: len(doc[inside])] = doc[inside]
    equal = np.lib.stride_tricks.sliding_window_view(padded, len(columns)) == item[:, None]
    row, start = np.nonzero(equal[: max(0, n - least + 1), far : len(columns) - far])
    if not len(row):
        return None
    sums = np.zeros((n, len(columns) + 1), np.int32)
    np.cumsum(equal, axis=1, out=sums[:, 1:])
    over = np.zeros((n + 1, hi - lo))
    np.cumsum(sums[:, wide:] == sums[:, : hi - lo], axis=0, out=over[1:])
    over -= np.arange(n + 1)[:, None] * changed
    # The last end that the absent words allow: ends further on all have more of them.
    ahead = np.minimum.accumulate(over[::-1], axis=0)[::-1]
    reach = np.concatenate([(ahead[:, start[k : k + 1_000]] <= over[row[k : k + 1_000], start[k : k + 1_000]] + 0.5 + 1e-9).sum(axis=0) - 1 for k in range(0, len(row), 1_000)]) - row
    own = np.concatenate([[0], np.cumsum(~stock)])
    order = np.lexsort((start, row, -reach))
    order = order[reach[order] >= least]
    bands = np.lib.stride_tricks.sliding_window_view(equal, wide, axis=1)
    drift = np.maximum(np.arange(-far, far + 1), 0)
    best, done, chunk = None, 0, 16
    while done < len(order) and reach[order[done]] >= (best[0] if best else least):
        take = order[done : done + chunk]
        done, chunk = done + chunk, min(4 * chunk, 256)
        i, c, upto = row[take], start[take], reach[take]
        # Words in common up to a place of the item and a diagonal; far below 0 before the first.
        same = np.full((len(take), wide), -n - 1, np.int32)
        same[:, far:] = 1
        for k in range(1, int(upto.max())):
            if k % 8 == 0:
                alive = (upto > k) & (k - same.max(axis=1) <= upto * changed + 0.5 + 1e-9) & (upto >= (best[0] if best else least))
                i, c, upto, same = i[alive], c[alive], upto[alive], same[alive]
                if not len(i):
                    break
            hit = bands[np.minimum(i + k, n - 1), c]
            with_hit = same + hit
            if k + 1 >= max(least, best[0] if best else 0):
                ends = hit & (k + 1 + drift - with_hit <= (k + 1) * changed + 0.5 + 1e-9) & (with_hit >= least * (1 - changed)) & ((upto > k) & (own[np.minimum(i + k + 1, n)] - own[i] >= least * (1 - changed)))[:, None]
                if ends.any():
                    most = np.where(ends, with_hit, 0).max(axis=1)
                    x = min(np.nonzero(most == most.max())[0], key=lambda x: (i[x], c[x]))
                    got = (k + 1, int(most[x]), int(i[x]), int(i[x] + c[x] + lo))
                    if best is None or (got[0], got[1], -got[2], -got[3]) > (best[0], best[1], -best[2], -best[3]):
                        best = got
            with_hit[:, :-1] = np.maximum(with_hit[:, :-1], same[:, 1:])
            same = np.maximum.accumulate(with_hit, axis=1)
    return best


def _pairs(items: Items, docs: int, starts: np.ndarray, places: np.ndarray, which: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """Of one batch, the pairs (document, item) that pass the prefix join and the positional bounds: for each the first

    diagonals of the bands that passed."""
    n_items = len(items.ids)
    doc_of = np.searchsorted(starts, places, "right") - 1
    # Length bound: documents with enough known shingles at all.
    enough = np.bincount(doc_of, minlength=docs) >= items.needed
    # Prefix join: pairs that share a necessary shingle.
    rare = items.rare[which] & enough[doc_of]
    d, j = items.expand(doc_of[rare], which[rare])
    d, j = d[items.prefix[j]], j[items.prefix[j]]
    wanted = np.zeros(docs * n_items, bool)
    wanted[d * n_items + items.item[j]] = True
    # Positional bound: enough shared shingles, and then within one window of the item and one band of places.
    some = np.nonzero(wanted.reshape(docs, n_items).any(axis=1)[doc_of])[0]
    at, j = items.expand(some, which[some])
    pair = doc_of[at] * n_items + items.item[j]
    keep = wanted[pair]
    at, j, pair = at[keep], j[keep], pair[keep]
    keep = (np.bincount(pair, minlength=len(wanted)) >= items.needed)[pair]
    p, q, pair = places[at[keep]], items.place[j[keep]].astype(np.int64), pair[keep]
    passed: dict[tuple[int, int], list[int]] = {}
    if not len(p):
        return passed
    diagonal = p - starts[pair // n_items] - q
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        order = np.lexsort((q, band, pair))
        a, b, c = pair[order], band[order], q[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        a, b, c = a[new], b[new], c[new]
        group = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        key = group * (1 << 32) + c
        enough = np.searchsorted(key, key + items.window, "left") - np.arange(len(key)) >= items.needed
        for x in np.unique(group[enough]):
            k = np.searchsorted(group, x, "left")
            passed.setdefault(divmod(int(a[k]), n_items), []).append(int(b[k]) * BAND - shift)
    return passed


def _aligned(items: Items, item: int, words: list[str], firsts: list[int], changed: float) -> tuple[int, int, int, int] | None:
    """The item's longest passage in a document's words through the bands that passed; words are compared, not their numbers."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(items.words[item]))}
    own = np.array([ids[w] for w in items.words[item]])
    text = np.array([ids.get(w, -2) for w in words])
    best = None
    # Diagonals on which a passage through a passed band can begin, each taken once and not too many together.
    wander = int(len(own) * changed + 0.5)
    done = -len(own)
    for first in sorted(firsts):
        done = max(done, first - wander)
        while done < (end := min(first + BAND + wander, len(text))):
            lo, done = done, min(end, done + 2 * wander + 2 * BAND)
            got = align(text, own, items.stock[item], items.least, changed, lo, done)
            if got and (best is None or (got[0], got[1], -got[2], -got[3]) > (best[0], best[1], -best[2], -best[3])):
                best = got
    return best


def stock_runs(items: DataFrame, item: str, text: str, least: int, stock_items: int) -> DataFrame:
    """(item, stock): of each item the runs of words (start, end) that at least stock_items of all items have: whole

    sentences, and runs of ``least`` words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = sentences_of(t)
                words = [x for part in parts for x in part]
                ends = np.cumsum([len(part) for part in parts]).tolist()
                runs = [(e - len(part), e) for e, part in zip(ends, parts, strict=True)] + [(k, k + least) for k in range(len(words) - least + 1)]
                out += [(i, a, e, md5(" ".join(words[a:e]).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()) for a, e in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["item", "start", "end", "key"])

    source = items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    runs = source.mapInArrow(cut, "item long, start int, end int, key binary")
    common = runs.select("key", "item").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= stock_items).select("key")
    return runs.join(common, "key", "left_semi").groupBy("item").agg(F.collect_set(F.struct("start", "end")).alias("stock"))


def blocks(items: DataFrame, item: str, text: str, stock: DataFrame, block_words: int) -> Iterator[list[tuple[int, str, list[tuple[int, int]]]]]:
    """The evaluation texts, with their stock, in blocks of about block_words words; the stated query set of the search."""
    held: list[tuple[int, str, list[tuple[int, int]]]] = []
    size = 0
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").join(stock, "item", "left")
    for row in rows.toLocalIterator():
        held.append((row[0], row[1], row[2]))
        size += len(row[1]) // 5
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaked(
    docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 30, changed: float = 0.125, stock_items: int = 4, block_words: int = 200_000
) -> DataFrame:
    """(item_id, doc_id, words, same, item_start, doc_start): each document with a passage of each item, by its longest passage.

    A passage: at least ``least`` words running of the item, in order, of which at most ``changed`` (to the nearest word) differ,
    after look-alike characters, case, typography and markup are evened out. Sentences, and runs of ``least`` words, that at least
    stock_items of all items have are stock and don't count towards ``least``; nor do items shorter than that or null texts. Equal rows give
    equal rows once for each copy of a document or item.

    The items are the query set: they are taken in blocks of block_words words, each broadcast to two scans of the corpus, so
    nothing that grows with the corpus is broadcast, collected, shuffled or written, and no document or word is hot. The first
    scan counts, over all documents, how many hold each shingle of the block; it runs while the query is built. By that rarity
    order the necessary prefix of every item-sized window is chosen. The second joins documents on prefix shingles only, bounds
    the pairs by the shingles shared within a window and a band of positions, and aligns the rest word by word.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    result = None
    for rows in blocks(items, item, item_text, stock_runs(items, item, item_text, least, stock_items), block_words):
        found = _block(spark, source, Items(rows, least, changed), changed)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], "item_id long, doc_id long, words int, same int, item_start int, doc_start int")
    return result.withColumnsRenamed({"item_id": item, "doc_id": doc}) if (item, doc) != ("item_id", "doc_id") else result


def _block(spark: SparkSession, source: DataFrame, items: Items, changed: float) -> DataFrame:
    # Plain arrays: workers need not have this package to read a broadcast.
    shared = spark.sparkContext.broadcast(vars(items))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items.of(shared.value)
        total = np.zeros(len(block.known), np.int64)
        for b in batches:
            for _, _, starts, words in read(b.column(0), b.column(1)):
                places, which = block.hits(shingles(words, starts))
                d = np.searchsorted(starts, places, "right") - 1
                total += np.bincount(np.unique(d * len(total) + which) % len(total), minlength=len(total)) if len(places) else 0
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

    # At most one row a shingle of the block.
    frequency = np.zeros(len(items.known), np.int64)
    got = source.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    frequency[got["shingle"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    items.choose(frequency)
    ready = spark.sparkContext.broadcast(vars(items))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items.of(ready.value)
        names = ["item_id", "doc_id", "words", "same", "item_start", "doc_start"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            for docs, texts, starts, words in read(b.column(0), b.column(1)):
                places, which = block.hits(shingles(words, starts))
                if not len(places):
                    continue
                rows = []
                for (d, i), firsts in _pairs(block, len(docs), starts, places, which).items():
                    best = _aligned(block, i, _WORD.findall(texts[d]), firsts, changed)
                    if best:
                        rows.append((block.ids[i], docs[d], *best))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return source.mapInArrow(join, "item_id long, doc_id long, words int, same int, item_start int, doc_start int")

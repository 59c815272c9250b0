"""Texts: look-alikes, leaks, packing, percentiles, against plain versions and at the edges."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import leaks, lookalikes, packing, percentiles

DOC = "doc_id long, text string"


def docs(spark, rows):
    clash = ("doc", "exact", "key", "rep", "class_id", "form", "words", "n_tokens", "item", "size")
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in clash})


SAME = ["Café Ωmega 5 ℃ file", "Cafe\u0301 Ωmega 5 °C file", "Ｃafé Ωmega 5 ℃ ﬁle", "C\u0430f\u00e9\u00a0Ωmega 5 °C file", "Caf\u00e9\u2009Ω\u200bmega 5\u202f°C f\u00adile"]
OTHER = ["Cafe Ωmega 5 °C file", "café Ωmega 5 °C file", "Café Ωmega ⁵ °C file", "Café Ωmega 5  °C file", "Café Ωmega\n5 °C file", "Café Ωmega 5 °C file."]


def test_lookalike_classes(spark):
    rows = [(i, t) for i, t in enumerate([*SAME, *OTHER, SAME[0], None, "", "\u200b", "ї", "і\u0308", "ï"])] + [(None, "x")]
    df = docs(spark, rows)
    got = {(r.doc_a, r.doc_b) for r in lookalikes.pairs(df).collect()}
    text = {i: t for i, t in rows if i is not None and t is not None}
    groups = [[i for i, t in text.items() if t in SAME], [13, 14], [15, 16, 17]]
    want = {(a, b) for g in groups for a in g for b in g if a < b and text[a] != text[b]}
    assert got == want
    member = {r.doc_id: (r.class_id, r.is_canonical) for r in lookalikes.canonical(df).collect()}
    assert set(member) == set(text)
    assert all(member[i] == (min(g), i == min(g)) for g in groups for i in g)
    assert all(member[i] == (i, True) for i in range(5, 11))


def test_lookalike_forms_against_rule():
    rng = random.Random(1)
    letters = "abcoeápy żółć Ωµ²°–’"
    swaps = {"a": "а", "o": "о", "e": "е", "p": "р", "y": "у", " ": "\u2007"}
    for _ in range(200):
        t = "".join(rng.choice(letters) for _ in range(30))
        other = "".join(swaps.get(c, c) if rng.random() < 0.3 else c for c in t)
        other = unicodedata.normalize("NFD", other) if rng.random() < 0.5 else other
        other = other[:7] + "\u200d" + other[7:]
        assert lookalikes.form(t) == lookalikes.form(other) and lookalikes.key_of(t) == lookalikes.key_of(other)
    assert lookalikes.form("2²") == "2²" and lookalikes.form("é") != lookalikes.form("e") and lookalikes.form("l1I") == "l1I"


def test_lookalike_edges(spark):
    assert lookalikes.pairs(docs(spark, [])).count() == 0 and lookalikes.canonical(docs(spark, [])).count() == 0
    many = docs(spark, [(i, "same text") for i in range(500)] + [(1000, "s\u0430me text")])
    assert lookalikes.pairs(many).count() == 500
    long = "ab" * 300_000
    assert lookalikes.pairs(docs(spark, [(1, long), (2, long + "\u200b")])).collect() == [(1, 2)]


WORDS = [a + b for a in "ka lo mi nu pe ra su ti vo zy".split() for b in "bar den fil gos hut jam".split()]


def sentence(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)]


def longest_shared(doc, item, share=0.125):
    """The most words of an item's window, word by word on one diagonal, of which at most share differ."""
    best = 0
    for shift in range(-len(item), len(doc)):
        same = [0 <= k + shift < len(doc) and doc[k + shift] == item[k] for k in range(len(item))]
        for a in range(len(item)):
            if same[a]:
                bad = 0
                for b in range(a, len(item)):
                    bad += not same[b]
                    if bad > (len(item)) * share + 1:
                        break
                    if same[b] and bad <= (b - a + 1) * share + 0.5:
                        best = max(best, b - a + 1)
    return best


def test_leaks_against_all_windows(spark):
    rng = random.Random(2)
    items = [sentence(rng, rng.randint(40, 90)) for _ in range(12)]
    rows, want = [], set()
    for d in range(150):
        words = sentence(rng, rng.randint(5, 60))
        if rng.random() < 0.7:
            k = rng.randrange(12)
            n = rng.choice([10, 20, 25, 31, 36, 40])
            a = rng.randrange(len(items[k]) - n + 1)
            part = items[k][a : a + n]
            if rng.random() < 0.5:
                part = [w if j % 9 != 4 else rng.choice(WORDS) for j, w in enumerate(part)]
            words[len(words) // 2 : len(words) // 2] = part
        rows.append((d, words))
        want |= {(k, d) for k in range(12) if longest_shared(words, items[k]) >= 30}
    marks = ["{}", "**{}**", "<b>{}</b>", "{},", "“{}”", "{}\u200b"]
    texts = [(d, " ".join(rng.choice(marks).format(w.upper() if rng.random() < 0.1 else w) for w in words)) for d, words in rows]
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").withColumn("lang", F.lit("x"))
    got = {(r.item_id, r.doc_id) for r in leaks.leaked(docs(spark, texts), frame).collect()}
    assert got == want and len(want) > 20
    assert {(r.item_id, r.doc_id) for r in leaks.leaked(docs(spark, texts), frame, block_words=100).collect()} == want


def test_leaks_that_are_none(spark):
    rng = random.Random(3)
    a = sentence(rng, 60)
    stock = sentence(rng, 34)
    items = spark.createDataFrame([(1, " ".join(a)), (2, None), (3, "too short"), (None, " ".join(a)), *[(10 + k, " ".join(sentence(rng, 20) + stock)) for k in range(5)]], "item_id long, text string")
    shuffled = a[:]
    rng.shuffle(shuffled)
    rows = [(1, " ".join(shuffled)), (2, " ".join(a[:25])), (3, " ".join(stock)), (4, None), (5, ""), (6, "<b>" + " ".join(a[5:45]).title() + "</b>"), (None, " ".join(a)), (7, " ".join(sentence(rng, 60_000) + a + a))]
    got = {(r.item_id, r.doc_id, r.words) for r in leaks.leaked(docs(spark, rows), items).collect()}
    assert got == {(1, 6, 40), (1, 7, 60)}
    assert leaks.leaked(docs(spark, []), items).count() == 0 and leaks.leaked(docs(spark, rows), items.limit(0)).count() == 0


def test_leaks_beside_a_longer_quotation(spark):
    rng = random.Random(6)
    a = sentence(rng, 150)
    passage = [w if k % 8 != 7 or k > 31 else "other" for k, w in enumerate(a[:40])]
    items = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    rows = [(1, " ".join(a[110:125] + sentence(rng, 5) + passage)), (2, " ".join(sentence(rng, 7) + passage)), (3, " ".join(a[110:125] + sentence(rng, 5) + a[:25]))]
    got = {(r.doc_id, r.words, r.same, r.item_start, r.doc_start) for r in leaks.leaked(docs(spark, rows), items).collect()}
    assert got == {(1, 40, 36, 0, 20), (2, 40, 36, 0, 7)}


def longest_passage(doc, item, least, changed=0.125):
    """(words, same, item_start, doc_start) by longest common subsequences from every pair of equal words."""
    found = []
    for i, j in ((i, j) for i in range(len(item)) for j in range(len(doc)) if item[i] == doc[j]):
        before = [1] * (len(doc) - j)
        for k in range(1, len(item) - i):
            now = [1]
            for o in range(1, len(doc) - j):
                hit = item[i + k] == doc[j + o]
                now.append(max(now[-1], before[o], before[o - 1] + 1 if hit else 0))
                same = before[o - 1] + 1
                if hit and k + 1 >= least and same >= least * (1 - changed) and max(k, o) + 1 - same <= (k + 1) * changed + 0.5:
                    found.append((k + 1, same, -i, -j))
            before = now
    if not found:
        return None
    n, same, i, j = max(found)
    return n, same, -i, -j


def test_alignment_against_all_passages():
    rng = random.Random(7)
    none = 0
    for _ in range(60):
        size, least = rng.choice([4, 12, 60]), rng.choice([8, 10, 12])
        item = [rng.randrange(size) for _ in range(rng.randint(least, 28))]
        a = rng.randrange(len(item) - least + 1)
        part = [w if rng.random() > 0.1 else rng.randrange(size) for w in item[a : a + rng.randint(least, 28)]]
        part[rng.randrange(len(part)) :][:1] = [rng.randrange(size)] * rng.randrange(3)
        doc = [rng.randrange(size) for _ in range(rng.randrange(12))] + part + [rng.randrange(size) for _ in range(rng.randrange(12))]
        want = longest_passage(doc, item, least)
        none += want is None
        assert leaks.align(np.array(doc), np.array(item), np.zeros(len(item), bool), least, 0.125, -len(item), len(doc)) == want
    assert 5 < none < 55


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.choice([3, 50, rng.randint(60, 700), rng.randint(60, 700), 2500]))) for i in range(300)] + [(900, ""), (901, None), (None, "x"), (902, "w " * 20_000)]
    df = docs(spark, rows)
    out = packing.packed(df, 1000, per_shard=60).collect()
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert set(counts) == {i for i, t in rows if i is not None and t is not None}
    pieces, loads = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, {})[r.piece] = r.n_tokens
        loads[r.container_id] = loads.get(r.container_id, 0) + r.n_tokens
    assert {d: sum(p.values()) for d, p in pieces.items()} == counts and sum(len(p) for p in pieces.values()) == len(out)
    assert all(set(p) == set(range(max(1, math.ceil(counts[d] / 1000)))) and all(n == 1000 for k, n in p.items() if k < len(p) - 1) for d, p in pieces.items())
    assert max(loads.values()) <= 1000
    assert len(loads) <= 1.03 * math.ceil(sum(counts.values()) / 1000) + 2
    f = packing.filling(packing.packed(df, 1000)).first()
    assert f.n_tokens == sum(counts.values()) and f.fill <= 1
    assert packing.packed(docs(spark, [])).count() == 0


def test_crossover_keeps_every_item_and_improves():
    rng = random.Random(5)
    sizes = [rng.randint(1, 700) for _ in range(400)]
    first = packing.best_fit([], [], list(range(400)), sizes, 1000)
    other = packing.best_fit([], [], sorted(range(400), key=lambda i: -sizes[i]), sizes, 1000)
    child = packing.cross(first, other, sizes, 1000, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) == x <= 1000 for b, x in zip(child.bins, child.load))
    best = packing.evolve(sizes, 1000, [], 1, 6, 10)[0]
    assert max(best) + 1 <= min(len(first.bins), len(other.bins))


@pytest.mark.parametrize("error", [0.0, 0.01])
def test_percentiles(spark, error):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(3), round(rng.gauss(0, 1), rng.choice([1, 4]))) for _ in range(3000)] + [("b", 0, float(i)) for i in range(5)] + [("c", 1, -0.0), ("c", 1, 0.0), ("n", 0, None), ("n", 0, float("nan")), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, day int, x double").withColumns({"value": F.lit("clash"), "n": F.lit("clash"), "part": F.lit("clash")})
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    whole = percentiles.percentiles(percentiles.frequencies(df, ["g"], "x", error), ["g"], shares)
    days = percentiles.combined([percentiles.frequencies(df.where(f"day = {k}"), ["g", "day"], "x", error) for k in range(3)], ["g"])
    got = {(r.g, r.share): (r.value, r.n_rows) for r in whole.collect()}
    assert got == {(r.g, r.share): (r.value, r.n_rows) for r in percentiles.percentiles(days, ["g"], shares).collect()}
    assert {g for g, _ in got} == {"hot", "b", "c"}
    for g in ("hot", "b", "c"):
        values = sorted(x for k, _, x in rows if k == g)
        for s in shares:
            want = values[max(math.ceil(s * len(values) - 1e-9), 1) - 1]
            assert got[g, s][1] == len(values) and abs(got[g, s][0] - want) <= error * abs(want) * 1.0000001 + 1e-12
    assert percentiles.percentiles(percentiles.frequencies(df.limit(0), ["g"], "x"), ["g"], shares).count() == 0


def test_words_by_number():
    texts = ["", "One two-three vier", "   ", "ЇЖАК їжак x", "one", "a" * 70_000 + " ß"]
    even = [leaks.evened(t) for t in texts]
    starts, numbers = leaks.numbered(even)
    words = [w for t in texts for w in leaks.words_of(t)]
    assert np.diff(starts).tolist() == [len(leaks.words_of(t)) for t in texts]
    assert len({*numbers.tolist()}) == len({*words}) and [words.index(w) for w in words] == [numbers.tolist().index(n) for n in numbers]
    h = leaks.shingles(numbers, starts)
    assert ((h == 0) == np.concatenate([np.arange(n) >= n - leaks.SHINGLE + 1 for n in np.diff(starts)])).all()


def test_stock_sentences_of_leaks(spark):
    rng = random.Random(8)
    closing = "Answer with the number and its unit, or say unknown when no sensor of this site was ever read at all."
    own = [sentence(rng, 28) for _ in range(5)]
    items = spark.createDataFrame([(k, f"{' '.join(w)}. {closing}") for k, w in enumerate(own)], "item_id long, text string")
    rows = [(k, f"{' '.join(w)}. {closing}") for k, w in enumerate(own[:2])] + [(7, " ".join(own[3][8:]) + ". " + closing)]
    got = {(r.item_id, r.doc_id) for r in leaks.leaked(docs(spark, rows), items, block_words=10).collect()}
    assert got == {(0, 0), (1, 1)}
    assert {(r.item_id, r.doc_id) for r in leaks.leaked(docs(spark, rows), items, stock_items=6).collect()} == {(0, 0), (1, 1), (3, 7)}


def test_forms_of_further_scripts():
    want = {"𝐀": "A", "𝟎": "0", "ꓮ": "A", "Ꭺ": "A", "ν": "v", "Օ": "O", "\U000e0041": "", "\U000e0101": "", "①": "①", "²": "²", "α": "α", "😀": "😀", "𝛼": "α"}
    assert {c: lookalikes.form("x" + c)[1:] for c in want} == want
    assert lookalikes.key_of("ｘ\té") == lookalikes.key_of("x é") == lookalikes.key_of("x e")


def test_pairs_of_a_large_class(spark):
    texts = [(k, "abc" if k % 3 == 0 else "аbc" if k % 3 == 1 else "ab​c") for k in range(30)]
    frame = docs(spark, texts)
    left, right = (spark.range(50).selectExpr("id % 2 AS k", f"id AS {c}") for c in "ab")
    assert {(r.k, r.a, r.b) for r in lookalikes._salted(left, right, "k", "a", 3).collect()} == {(a % 2, a, b) for a in range(50) for b in range(a % 2, 50, 2)}
    assert {(r.doc_a, r.doc_b) for r in lookalikes.pairs(frame).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 3 != b % 3}

"""Operators 11 to 13 against brute force: nulls, empty and very long texts, ties, repeated rows, clashing names, hot
sources, many groups and blocks, and reruns of an input that is dealt out otherwise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseloom.llm import common, lexical, mixing, resampling

R = random.Random(12)
VOCAB = ["".join(R.choice("abcdeé9") for _ in range(R.randint(1, 4))) for _ in range(250)]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = "doc_id long, text string, source string, score double, rank string, item int, place long, part int, copy long, n int"
LONG = 2**63 - 1


def say(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def _rows():
    out = [(i, say(R.choice([3, 20, 25, 60, 200])), R.choice(["b", "a", "é", None, "", "hot", "hot", "hot"])) for i in range(300)]
    out += [(400, None, "a"), (401, "", "b"), (402, " \n\t", None), (403, "!? ...", "tiny"), (None, say(40), "hot"), (None, None, "hot"), (LONG, say(30), "a"), (-5, "AbC dEf! É é" + say(20), "b"), (404, say(30_000), "long"), (7, out[7][1], out[7][2])]
    out += [(405, "same text over and over again", "hot")] * 120 + [(406 + i, out[3][1], "a") for i in range(40)]
    return out


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in ROWS], CLASH).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Mixing


def wanted_targets(sizes):
    """Shares by weight, capped and reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest, free = total - sum(3 * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * w[s] / free for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(docs, none):
    got = mixing.mix(docs, cell=40).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in ROWS)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += size(t)
    target = wanted_targets(sizes)
    at = {(i, size(t)): s for i, t, s in ROWS}
    taken, most, count, drawn = Counter(), Counter(), Counter(), Counter()
    for r in got:
        s = at[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert r.taken in {r.size * math.floor(rate + 1e-9), r.size * math.ceil(rate - 1e-9)} and r.taken <= 3 * r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
        if r.size:
            count[s] += 1
            drawn[s] += r.taken // r.size
    for s in sizes:
        # Balanced on tokens and documents, but for the two that land.
        assert abs(taken[s] - target[s]) <= 2 * most[s] and abs(drawn[s] - count[s] * target[s] / max(1, sizes[s])) <= 2 + sum(1 for i, t, x in ROWS if x == s and not size(t))
    assert rows(mixing.mix(docs.repartition(2), cell=40)) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(none).count() == 0 and [c for c, _ in mixing.mix(none).dtypes] == ["doc_id", "size", "source_size", "target", "taken"]


def test_targets_are_shared_again_where_many_sources_are_full(spark):
    sizes = {f"s{i:02d}": 10 ** (i % 6) for i in range(31)} | {None: 7, "empty": 0}
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    assert {r.source: pytest.approx(r.target) for r in mixing.targets(table, len(sizes)).collect()} == wanted_targets(sizes)


def test_flight_keeps_sums_and_expectations():
    rng, r = np.random.default_rng(3), random.Random(3)
    size = np.array([r.randint(1, 500) for _ in range(60)])
    start = np.array([r.random() for _ in range(60)])
    mean = np.zeros(60)
    for _ in range(2000):
        p = start.copy()
        mixing.fly(p, size, rng)
        assert abs(p.sum() - start.sum()) < 1e-6 and abs(p @ size - start @ size) < 1e-3 and ((p > 0) & (p < 1)).sum() <= 2
        mixing.land(p, size, rng)
        assert set(p) <= {0.0, 1.0}
        mean += p / 2000
    assert np.abs(mean - start).max() < 0.06  # five standard errors
    equal = np.full(9, 0.5)
    mixing.fly(equal, np.full(9, 4), rng)
    assert ((equal > 0) & (equal < 1)).sum() <= 1
    # Two of very different sizes land with the probabilities they had.
    hits = np.zeros(2)
    for _ in range(4000):
        p = np.array([0.3, 0.6])
        mixing.land(p, np.array([1, 1000]), rng)
        hits += p / 4000
    assert np.abs(hits - [0.3, 0.6]).max() < 0.04


def test_copies_are_numbered_without_meeting(spark):
    many = spark.range(0, 5000, 1, 7).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(2).cast("long").alias("size"))
    assert [r["copy"] for r in mixing.copies(many).orderBy("copy").collect()] == list(range(5000))


# Search


def best(texts, item, k=50):
    terms = [TERM.findall(lower(t)) for _, t in texts]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for ts in terms for w in set(ts))
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for (i, _), ts in zip(texts, terms, strict=True):
        tf = Counter(ts)
        m = 50 + 50 * len(ts) * n // total
        score = sum(w[t] * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(TERM.findall(lower(item))) if t in tf)
        if score > 0:
            out.append((-score, LONG if i is None else i, i))
    return [(i, -s) for s, _, i in sorted(out, key=lambda x: x[:2])[:k]]


ITEMS = [(1, say(30)), (2, VOCAB[0].upper() + " " + VOCAB[1]), (3, None), (4, "no-such-term zzzzzz"), (None, say(12)), (1, say(25)), (5, ROWS[0][1]), (6, "é É"), *[(10 + i, say(40)) for i in range(20)]]


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, docs, none, monkeypatch, small):
    if small:  # many groups, blocks and nodes
        for name, value in {"GROUP_ITEMS": 5, "DOCS_A_BLOCK": 40, "DOCS_1": 16, "LEAF_DOCS": 4, "LEAF_ITEMS": 2, "NODES_1": 3}.items():
            monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    k = 7 if small else 50
    got = lexical.search(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    texts = [(i, t) for i, t, _ in ROWS]
    want = [(q, n + 1, i, s) for q, t in ITEMS for n, (i, s) in enumerate(best(texts, t, k))]
    assert rows(got) == sorted(want, key=repr)
    assert lexical.search(none, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_search_spares_batches(spark):
    """Documents and items of ten subjects: few leaf pairs are multiplied out, and the result is exact."""
    subject = [[f"{chr(97 + s)}{w}" for w in range(60)] for s in range(10)]
    r = random.Random(5)
    texts = [(i, " ".join(r.choices(subject[i % 10], k=50))) for i in range(2000)]
    items = [[f"{chr(97 + s)}{w}" for w in r.sample(range(60), 12)] for s in range(10) for _ in range(8)]
    vocabulary = sorted({w for ws in items for w in ws})
    number = {w.encode(): i for i, w in enumerate(vocabulary)}
    blocks = lexical.postings(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), sorted(number))
    row = blocks.collect()
    n, total, df = lexical.frequencies(blocks, len(number))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df.tolist()])
    search = lexical.Search(lexical.Items([sorted(number[w.encode()] for w in ws) for ws in items], weights), 5)
    for one in row:
        search.block(lexical.Docs(one, search.items, n, total))
    found = search.rows()
    for at, ws in enumerate(items):
        mine = found[found["item"] == at]
        assert list(zip(mine["doc_id"].tolist(), mine["score"].tolist(), strict=True)) == best(texts, " ".join(ws), 5)
    assert search.solved < search.pairs / 3


def test_products_stay_exact_beyond_doubles():
    few = lexical.Items([[0, 1]], np.array([5, 7]))
    assert few.exact and few.own[0][1].dtype == np.float64
    many = lexical.Items([list(range(300_000))], np.full(300_000, 40_000))
    assert not many.exact and many.own[0][1].dtype == np.int64


# Resampling


def test_planes():
    r = np.random.default_rng(1)
    counts, gains = r.integers(0, 2000, resampling.BUCKETS) * (r.random(resampling.BUCKETS) < 0.1), r.integers(-30000, 30000, resampling.BUCKETS)
    whole = lambda x: [resampling._whole(p) for p in resampling.planes_of(x)]
    assert resampling.weighed(resampling.planes_of(counts), whole(np.maximum(gains, 0)), whole(np.maximum(-gains, 0))) == int(counts @ gains)
    assert resampling.planes_of(np.zeros(resampling.BUCKETS, np.int64)) == []


def drawn(texts, items, least, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    own = [Counter(map(bucket, words(t))) for _, t in texts]
    s, t = sum(own, Counter()), sum((Counter(map(bucket, words(x))) for x in items), Counter())
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for (i, _), c in zip(texts, own, strict=True):
        n = c.total()
        weight = sum(k * gain(b) for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], LONG if r[0] is None else r[0], r[1], r[2]))
    for place, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [0, 10, 60, 100])
def test_resample(spark, docs, monkeypatch, percent):
    monkeypatch.setattr(common, "ROWS_TO_NUMBER", 20)  # many ranges, several of equal rows
    items = spark.createDataFrame([(t, "x") for _, t in ITEMS], "text string, doc_id string")
    got = resampling.resample(docs, items, percent=percent)
    assert rows(got) == drawn([(i, t) for i, t, _ in ROWS], [t for _, t in ITEMS], 20, percent)


def test_resample_empty(spark, docs, none):
    items = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, items).count() == 0
    assert rows(resampling.resample(docs, items.limit(0))) == drawn([(i, t) for i, t, _ in ROWS], [], 20, 10)


def test_numbers_are_gapless_over_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_TO_NUMBER", 100)
    table = spark.range(2000).select((F.col("id") % 3 > 0).cast("int").alias("a"), (F.col("id") * 0).alias("part"))
    got = common.numbered(table, ["a"], "n", 2000).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 2001)) and [r.a for r in got] == sorted(r.a for r in got) and got[0].part == 0

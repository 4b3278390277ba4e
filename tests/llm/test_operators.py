"""Every operator against a brute-force version, an exact round trip or held-out accuracy, on a small table with nulls,
empty and long texts, repeated rows, ties and an extra column whose name clashes with ours."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from proseloom.llm import fm, katz, media, nearjoin, packing, pieces, quality, repeats, sharding, tokens, topk
from proseloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, block string, n_chars long"
R = random.Random(4)
VOCAB = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 5))) for _ in range(300)]


def _texts():
    say = lambda n: " ".join(R.choice(VOCAB) for _ in range(n))
    passage, base = say(70), say(300)
    near = base.split()
    near[50], near[200] = "zz", "yy"
    out = [(1, say(120)), (2, base), (3, " ".join(near)), (4, base), (5, say(40) + " " + passage + " " + say(30)), (6, say(9) + "\n" + passage + "\t" + say(60)), (7, passage), (8, None), (9, ""), (10, " \n "), (11, "Aa aA b"), (12, "\x1codd space\x85here"), (13, say(6000)), (14, " ".join(["same"] * 130)), (15, " ".join(["same"] * 130)), (4, base), (16, "a b c d"), (17, "a b c d"), (18, say(49)), (19, "▁mark  two  spaces "), (None, say(60)), (None, None), (20, base[: len(base) // 2] + " " + passage)]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra", len(t or "")) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_media(spark, docs, none):
    got = media.features(media.media_column(docs)).collect()
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert by(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    table = media.packets(media.media_column(docs.where("doc_id = 13")))
    rows = table.orderBy("packet").collect()
    assert [r.timestamp_ns for r in rows] == [k * 32_000_000 for k in range(len(rows))] and all(r.error is None for r in rows)
    assert media.features(media.media_column(none)).count() == 0
    cut = media.mux(b"a" * 3000)[:-20]
    bad = spark.createDataFrame([(2**60 + 1, bytearray(b"no media at all")), (None, None), (3, bytearray(cut)), (4, bytearray(b"\x1aE\xdf\xa3"))], "doc_id long, media binary")
    assert by(media.packets(bad).collect(), "doc_id", "track") == [(2**60 + 1, None), (3, None), (4, None)]
    rows = {r.doc_id: r for r in media.features(bad).collect()}
    assert rows[None].feature is None and rows[None].payload_bytes is None and all(rows[i].feature.startswith("error: ") for i in (2**60 + 1, 3, 4))


def test_matroska_lacings_and_unknown_sizes():
    m = media
    frames = [bytes([k]) * n for k, n in enumerate([300, 20, 700, 20])]
    flags, body = m.lace(frames)
    xiph = bytes([3]) + b"\xff" + bytes([45, 20]) + b"\xff\xff" + bytes([190]) + b"".join(frames)
    block = lambda f, b: m.element(m.SIMPLE, b"\x81\x00\x05" + bytes([f]) + b)
    inner = m.uint(m.TIMESTAMP, 100) + block(flags, body) + block(0x02, xiph) + block(0x04, bytes([1]) + b"aabb") + m.element(m.GROUP, m.element(m.BLOCK, b"\x81\xff\xff\x00zz") + m.uint(m.BLOCK_DURATION, 4))
    unknown = m.id_bytes(m.CLUSTER) + b"\x01" + b"\xff" * 7 + inner
    data = m._HEAD + m.id_bytes(m.SEGMENT) + b"\xff" + m.element(m.INFO, m.uint(m.SCALE, 1000)) + unknown + m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 200) + block(0, b"q"))
    p = m.parse(data)["packets"]
    assert [data[s:e] for *_, s, e in p] == [*frames, *frames, b"aa", b"bb", b"zz", b"q"]
    assert p[0][1] == 105_000 and p[-2][1] == 99_000 and p[-1][1] == 205_000 and flags in (0x02, 0x06)
    with pytest.raises(ValueError):
        m.parse(data[:-3])


def test_katz(docs, none):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    toks = [(i, WORD.findall((t or "").translate(low)) + ["\n"]) for i, t in TEXTS]
    one, two, starts = Counter(), Counter(), 0
    for i, t in toks:
        if not held(i):
            one.update(t)
            two.update(zip(["\n<", *t], t, strict=False))
            starts += 1
    n = sum(one.values())
    d1, d2 = (katz.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in (one, two))
    cut = lambda c, d: c - 0.01 if c > 5 else d[c] * c
    unknown = 1 - sum(cut(c, d1) for c in one.values()) / n
    prior = lambda w: cut(one[w], d1) / n if one[w] else unknown
    ctx = one + Counter({"\n<": starts})

    def prob(v, w):
        if two[v, w]:
            return cut(two[v, w], d2) / ctx[v]
        if not ctx[v]:
            return prior(w)
        after = [x for (a, x) in two if a == v]
        return (1 - sum(cut(two[v, x], d2) for x in after) / ctx[v]) / (1 - sum(map(prior, after))) * prior(w)

    assert math.isclose(sum(prob("same", w) for w in one) + prob("same", "never seen"), 1, abs_tol=1e-9)
    got = {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in katz.score(docs, 2).collect()}
    want = {(i, len(t), round(sum(math.log10(prob(v, w)) for v, w in zip(["\n<", *t], t, strict=False)), 6)) for i, t in toks}
    assert got == want and katz.score(none).count() == 0
    full = by(katz.score(docs, 2).collect(), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    v = len(one)
    base = lambda t: sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    for r, (i, t) in zip(full, sorted(toks, key=lambda x: repr((x[0], held(x[0]), len(x[1]), sum(one[w] > 0 for w in x[1]), n, base(x[1])))), strict=True):
        assert r[:5] == (i, held(i), len(t), sum(one[w] > 0 for w in t), n) and math.isclose(r[5], base(t), rel_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order(spark, order):
    r = random.Random(9)
    texts = [(i, " ".join(r.choice("abcdefgh" if i % 3 else "abcdefghijk") for _ in range(r.randint(0, 40)))) for i in range(120)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    toks = [(i, [*t.split(), "\n"]) for i, t in texts]
    seen, after = [Counter() for _ in range(order + 1)], {}
    histories = lambda t, j: ["\n<", *t][max(0, j + 2 - order) : j + 1] if order > 1 else []
    ctx = Counter()
    for i, t in toks:
        for j, w in enumerate(t if not held(i) else []):
            h = histories(t, j)
            for k in range(len(h) + 1):
                g = (*h[k:], w)
                seen[len(g)][g] += 1
                ctx[g[:-1]] += 1
                after.setdefault(g[:-1], set()).add(w)
    d = [None] + [katz.discounts([sum(c == x for c in s.values()) for x in range(1, 7)]) for s in seen[1:]]
    cut = lambda g: seen[len(g)][g] - 0.01 if seen[len(g)][g] > 5 else d[len(g)][seen[len(g)][g]] * seen[len(g)][g]

    def prob(h, w):
        g = (*h, w)
        if seen[len(g)][g]:
            return cut(g) / ctx[h]
        if not h:
            return 1 - sum(cut((x,)) for x in after[()]) / ctx[()]
        if not ctx[h]:
            return prob(h[1:], w)
        return (1 - sum(cut((*h, x)) for x in after[h]) / ctx[h]) / (1 - sum(prob(h[1:], x) for x in after[h])) * prob(h[1:], w)

    got = {q.doc_id: q.score for q in katz.score(spark.createDataFrame(texts, "doc_id long, text string"), order).collect()}
    want = {i: sum(math.log10(prob(tuple(histories(t, j)), w)) for j, w in enumerate(t)) for i, t in toks}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-6) for i in got)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_a_stored_model_scores_other_texts(spark, order):
    r = random.Random(5)
    say = lambda: " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 30)))
    old, new = [(i, say()) for i in range(150)], [(1000 + i, say() + " unseen") for i in range(40)] + [(None, None)]
    table = spark.createDataFrame(old, "doc_id long, text string")
    stored = katz.train(table, order)
    kinds = {f.split("kind=")[1].split("/")[0] for f in stored.counts.inputFiles()}
    assert kinds == {str(k) for k in range(1, order + 1)} and all("kind=" in f for f in stored.weights.inputFiles())
    same = lambda rows: {x.doc_id: round(x.score, 9) for x in rows.collect()}
    assert same(katz.score_by(table, stored)) == same(katz.score(table, order))
    # Other texts beside the old ones, all of them held out by their ids: training with them learns the same model.
    held = [(i, t) for i, (_, t) in zip((k for k in range(10**6) if zlib.crc32(str(k).encode()) % 10 == 0 and k >= 1000), new, strict=False)]
    more = spark.createDataFrame(held, "doc_id long, text string")
    assert same(katz.score_by(more, stored)) == {k: v for k, v in same(katz.score(table.unionByName(more), order)).items() if k in dict(held)}


@pytest.mark.parametrize("pivots, block", [(8, 50), (None, 8192), (3, 1)])
def test_top_k(spark, pivots, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 520)] + [(600, None), (700, [1.0, None]), (800, [float("nan")] * 8), (None, [0.1] * 8), (900, [0.25, -0.5]), (1000, []), (2**60 + 1, [0.3] * 8), (3, [0.4] * 8), (200, [9.0] * 8)]
    rows += [(1100, [3e9, 1.0]), (1101, [-2e9] * 8), (1102, [1e300] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    held = lambda x: max(-(2**63), min(2**63 - 1, math.floor(1024 * x)))
    ok = [(i, [int(float(held(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in ok if i % 100 == 0}:
        ask = min(v for i, v in ok if i == q)
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ask, v, strict=False)))), i) for i, v in ok if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert by(topk.top_k(table, pivots=pivots, block=block).collect(), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(table.where("vec_id < 0")).count() == 0


def test_bounds_prune_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (20, 16))
    rows = [(i, [float(x) for x in centre[i % 20] + rng.normal(0, 0.02, 16)]) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    share = [r.cells_reached / r.cells for r in topk.cells_reached(table, pivots=60).collect()]
    assert len(share) == 30 and max(share) < 0.5


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (1, 100):
        v = np.floor(1024 * rng.normal(0, scale, (600, 5)) * rng.choice([0.01, 1, 1], (600, 1)))
        centre = v[:25]
        d = np.sqrt(((v[:, None] - centre) ** 2).sum(2))
        cell, far, norm = d.argmin(1), d.min(1), np.sqrt((v * v).sum(1))
        rows = [{"cell": c, "n": int((cell == c).sum()), "norm": norm[cell == c].max(), "low": far[cell == c].min(), "high": far[cell == c].max(), "near": sorted(far[cell == c])[:5]} for c in range(25) if (cell == c).any()]
        floor, ceiling = topk.Summary(centre, rows, 4).bounds(v)
        scores = v @ v.T
        for q in range(len(v)):
            others = np.delete(scores[q], q)
            assert np.sort(others)[-4] >= floor[q] and all(scores[q][cell == c].max() <= ceiling[q, c] for c in range(25) if (cell == c).any())


def test_quality(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(VOCAB) for _ in range(60)) + "." if i % 3 else " | ".join(rng.choice(VOCAB) for _ in range(60)), "x", 0) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    scored = quality.score(table, model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1) > 0.95 * sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(600))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect()) and quality.score(none, model).count() == 0
    assert quality.train(table, labels.where("doc_id < 0")) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    row, col, val = quality.rows_of(["a b b", ""])
    z, _ = quality.margins(model, row, col, val, 2)
    for k in range(2):  # the identity against the double sum
        f = [(model[c], v) for r, c, v in zip(row, col, val, strict=True) if r == k]
        direct = sum(m[0] * v for m, v in f) + sum(float(f[i][0][1:] @ f[j][0][1:]) * f[i][1] * f[j][1] for i in range(len(f)) for j in range(i))
        assert math.isclose(z[k], direct, rel_tol=1e-3, abs_tol=1e-3)
    assert quality.reject(table, labels).columns == table.columns


def test_sharding(docs, none, spark):
    rows = sharding.shard(docs, shards=5).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(TEXTS) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert by(rows, "doc_id", "size", "text_crc32") == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS), key=repr)
    assert by(rows, "doc_id", "size", "shard", "slot")[:5] == by(sharding.shard(docs.repartition(7), shards=5).collect(), "doc_id", "size", "shard", "slot")[:5]
    for n in (1, 2, 3, 5, 17, 1000):
        from pyspark.sql import functions as F

        got = spark.range(n).select(sharding.permuted(F.col("id"), n, 7).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
    assert sharding.shard(none).count() == 0


def _repeated():
    toks = [(i if i is not None else 1 << 62, WORD.findall(t or "")) for i, t in TEXTS]
    first = {}
    for i, w in sorted(toks, key=lambda x: x[0]):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    out = []
    for (i, w), (own, _) in zip(toks, TEXTS, strict=True):
        gone = [0] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [1] * 50
        out.append((own, w, gone))
    return out


@pytest.mark.parametrize("hot", [0, 1, 1000])
def test_repeats(docs, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    want = sorted(((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, w, g in _repeated()), key=repr)
    assert by(repeats.repeats(docs, repeats.fm_solver, repeats.kept, repeats.REMOVED).collect(), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    rows = repeats.repeats(docs, repeats.suffix_solver, repeats.spans, repeats.SPANS).collect()
    assert by(rows, "doc_id", "n_words", "n_repeated") == sorted(((i, len(w), sum(g)) for i, w, g in _repeated()), key=repr)
    assert all(sum(s["length"] for s in r.spans) == r.n_repeated for r in rows)
    assert repeats.repeats(none, repeats.fm_solver, repeats.kept, repeats.REMOVED).count() == 0


def test_cleaned(docs):
    want = sorted((i, " ".join(x for x, y in zip(w, g, strict=True) if not y) if any(g) else t) for (i, w, g), (_, t) in zip(_repeated(), TEXTS, strict=True) if i is not None and t is not None and not (any(g) and all(g)))
    got = repeats.cleaned(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None and r.text is not None) == want


def _statistics(held, text, most):
    """By trying: the longest match of each place of a text in the held texts, and the texts that hold a whole window."""
    out = []
    for j in range(len(text)):
        n = max([m for m in range(min(most, len(text) - j) + 1) if m == 0 or any(tuple(text[j : j + m]) == tuple(h[k : k + m]) for h in held for k in range(len(h) - m + 1))])
        out.append((n, [i for i, h in enumerate(held) if n == most and any(tuple(text[j : j + n]) == tuple(h[k : k + n]) for k in range(len(h) - n + 1))]))
    return out


@pytest.mark.parametrize("symbols, most", [(2, 8), (3, 4), (6, 5), (40, 3)])
def test_fm_index_matching_statistics(symbols, most):
    rng = np.random.default_rng(symbols)
    held = [rng.integers(0, symbols, n) for n in (30, 50, 1, 20, 12)]
    held.append(held[1][5:25].copy())
    marks = np.array([7, 5, 9, 3, 8, 2])
    index = fm.Index(np.concatenate(held).astype(np.int32), np.array(list(map(len, held))), marks, symbols, most)
    other = [np.concatenate([held[0][4:20], [symbols + 3], rng.integers(0, symbols, 30), held[1][10:30], [-1]]), np.zeros(0, int), rng.integers(0, symbols, 25), held[5]]
    length, least = index.matching(np.concatenate(other).astype(np.int32), np.array(list(map(len, other))))
    at = 0
    for text in other:
        for n, who in _statistics(held, text, most):
            assert length[at] == n and (n < most or least[at] == min(marks[who]))
            at += 1
    assert index.common.max() <= most and index.common.dtype == np.uint8


def test_the_index_decides(docs, monkeypatch):
    """Without what the streamed search finds, copies would be first occurrences: the answer comes through the index."""
    monkeypatch.setattr(fm.Index, "_lanes", lambda self, texts, start, lens, length, mark: None)
    words = np.repeat(np.arange(60, dtype=np.uint64)[None], 2, 0).reshape(-1)
    lens, offsets, ids = np.array([60, 60]), np.array([20, 20]), np.array([3, 9])
    found = []

    def once(self, texts, lens_):
        found.append(len(lens_))
        return np.full(len(texts), 50, np.uint8), np.full(len(texts), 4)

    monkeypatch.setattr(fm.Index, "matching", once)
    assert repeats.fm_solver(words, lens, offsets, ids).tolist() == [3] * 11 + [4] * 11 and found == [1]


@pytest.mark.parametrize("limit", [64, 2])
def test_near_duplicates(docs, none, limit, monkeypatch):
    monkeypatch.setattr(nearjoin, "LIMIT", limit)
    monkeypatch.setattr(nearjoin, "TILE", limit)
    toks = [(i, tuple(WORD.findall(t or ""))) for i, t in TEXTS]
    sets = {w: {w[j : j + 5] for j in range(len(w) - 4)} for _, w in toks}
    near = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    links = {w: [v for v in sets if v != w and near(w, v)] for w in sets}
    low = {w: min((i for i, v in toks if v == w and i is not None), default=1 << 62) for w in sets}
    group = dict(low)
    for _ in sets:
        for w in sets:
            group[w] = min([group[w], *(group[v] for v in links[w])])
    shown = lambda x: None if x == 1 << 62 else x
    want = sorted(((i, shown(group[w]), shown(low[w]), sum(v == w for _, v in toks), len(links[w])) for i, w in toks), key=repr)
    assert by(nearjoin.near_duplicates(docs).collect(), "doc_id", "class_id", "text_class_id", "n_copies", "n_links") == want
    assert nearjoin.near_duplicates(none).count() == 0


def test_recall_at_full_depth():
    """Of 6,000 pairs at the threshold (40 of 50 shingles) hardly one never meets on a path of full depth."""
    pairs = 6000
    lens = np.tile([44, 54], pairs)
    ids = np.concatenate([np.concatenate([np.arange(44), np.arange(54)]) + 54 * k for k in range(pairs)])
    row = {"block": 0, "has_id": tokens.pack(np.ones(2 * pairs, bool)), "doc_ids": tokens.pack(np.arange(2 * pairs)), "lens": tokens.pack(lens.astype(np.int32)), "ids": tokens.pack(ids.astype(np.int32)), "words": tokens.squeeze("\n".join(map(str, range(54 * pairs))).encode())}
    s = nearjoin.Sets(tokens.Block(type("Row", (), row)))
    runs = nearjoin.runs_for(nearjoin.RECALL)
    more = [nearjoin.branch_for(nearjoin.RECALL, runs, nearjoin.DEPTH)] if hasattr(nearjoin, "branch_for") else []
    keys, nodes = s.chosen(runs)
    for _ in range(nearjoin.DEPTH - 1):
        keys, nodes = s.deeper(keys, nodes, *more)
    pair = np.empty(len(s.node), np.int64)
    pair[s.of] = np.arange(2 * pairs) // 2
    seen = np.unique(np.stack([keys, nodes.astype(np.uint64)], 1), axis=0)
    same = seen[1:, 0] == seen[:-1, 0]
    met = np.unique(pair[seen[1:, 1][same].astype(np.int64)])
    assert pairs - len(met) <= 3


def test_large_group_is_dealt_out(spark, monkeypatch, tmp_path):
    """No comparison holds more than two tiles of a large near-copy group, and none is left out."""
    folder = str(tmp_path)

    def watched(rows):
        import uuid

        from proseloom.llm.nearjoin import verified

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(rows)))
        return verified(rows)

    monkeypatch.setattr(nearjoin, "TILE", 16)
    monkeypatch.setattr(nearjoin, "verified", watched)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]]), "", 0) for i in range(400) for at in [i % 200]]
    got = nearjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert by(got, "doc_id", "class_id", "n_links") == by([{"doc_id": i, "class_id": 0, "n_links": 399} for i in range(400)], "doc_id", "class_id", "n_links")
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) >= 400 * 25 and max(sizes) <= 6 * 16


def test_one_of_each(docs):
    kept = nearjoin.one_of_each(docs)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == docs.columns and 2 in ids and not {3, 4, 15, 17, 9, 10} & set(ids) and ids == sorted(set(ids))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


def test_packing(docs, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, windows=4).collect()
    want = Counter()
    for i, t in TEXTS:
        want[i, len(coder.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    ids = {(i, n): coder.encode(t or "", add_special_tokens=False).ids + [1] for i, t in TEXTS for n in [len(coder.encode(t or "", add_special_tokens=False).ids) + 1]}
    covered, sequences = Counter(), {}
    for r in rows:
        part = ids[r.doc_id, r.doc_tokens][r.start : r.start + r.length]
        assert len(part) == r.length and (r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) or want[r.doc_id, r.doc_tokens] > 1)
        covered[r.doc_id, r.doc_tokens] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({k: k[1] * n for k, n in want.items()})
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= 1 and packing.pack_documents(none).count() == 0


def test_word_by_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    coder, path = Tokenizer.from_file(packing.default_tokenizer()), packing.default_tokenizer()
    texts = ["Don't STOP now", "é ÉA ΑΣ ΑΣΑ a b", "x<|endoftext|>y <|startoftext|>", " odd\x1cspaces\x85​here 123abc", "  ", "…!? a_b 漢字"]
    r = random.Random(7)
    texts += ["".join(r.choice("abcXYZ éÉßàÿ×÷'\"'sdmtrvel019.,-<|_*#@¿") for _ in range(60)) for _ in range(3000)] + ["".join(chr(r.choice([*range(32, 128), *range(160, 600), 0x300, 0x301, 0x1E9E, 0x212A])) for _ in range(40)) for _ in range(1500)]
    assert packing.Coder(path).encode(texts) == [np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    other = packing.Coder(path.replace("word_bpe_49k", "byte_bpe_50k"))  # other rules: whole texts
    assert not other.by_word and other.encode(texts[:50]) == [np.array(other.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:50]]


def _message(*parts):
    """A protocol buffer message of (field, value): whole numbers, bytes, floats."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, v in parts:
        v = v.encode() if isinstance(v, str) else v
        out += number(field << 3 | (0 if isinstance(v, int) else 5 if isinstance(v, float) else 2))
        out += number(v) if isinstance(v, int) else struct.pack("<f", v) if isinstance(v, float) else number(len(v)) + v
    return out


def _unigram(scores, squeeze):
    """A model file written by hand: unknown, ends, byte pieces, then the given pieces."""
    listed = [_message((1, "<unk>"), (2, 0.0), (3, 2)), _message((1, "<s>"), (2, 0.0), (3, 3)), _message((1, "</s>"), (2, 0.0), (3, 3))]
    listed += [_message((1, f"<0x{i:02X}>"), (2, 0.0), (3, 6)) for i in range(256)] + [_message((1, p), (2, s)) for p, s in scores.items()]
    return _message(*[(1, x) for x in listed], (2, _message((3, 1), (35, 1))), (3, _message((1, "identity"), (2, b""), (3, 1), (4, int(squeeze)), (5, 1))))


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_ids_are_the_librarys(squeeze):
    import sentencepiece

    r = random.Random(6)
    scores = {"\u2581": -3.0, **{c: -4.0 - k / 8 for k, c in enumerate("abcdeé")}}
    while len(scores) < 150:
        p = r.choice(["", "", "\u2581"]) + "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
        scores.setdefault(p, -3.0 - r.randint(0, 64) / 8)
    proto = _unigram(scores, squeeze)
    p, sp = pieces.Pieces(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    texts = ["", " ", "a", "  abc  de ", "xyz 漢字 abé", "a\nb\u2581c"] + ["".join(r.choice("abcdeé  x") for _ in range(r.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        ids = p.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t) and p.decode(ids) == sp.decode(sp.encode(t))


def test_bpe_ids_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    p, sp = pieces.pieces(None), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(8)
    texts = [t or "" for _, t in TEXTS] + ["   ", "a  b ", "\u2581\u2581 x", "\x00 漢字 𝔘", "Elle a dit"] + ["".join(r.choice("etaoinshr ETA.,'é1\n") for _ in range(60)) for _ in range(1500)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if x.text]
    for t in texts:
        ids = p.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t) and p.decode(ids) == sp.decode(sp.encode(t)) and p.decode(p.encode(t, True)) == t


def test_pieces(spark, docs, none):
    back = pieces.decode(pieces.encode(docs, lossless=True)).collect()
    assert by(back, "doc_id", "text") == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    p = pieces.pieces(None)
    want = sorted(((i, zlib.crc32(p.encode(t or "")), hashlib.sha256((t or "").replace("\u2581", " ").encode()).hexdigest(), "\u2581" not in (t or "")) for i, t in TEXTS), key=repr)
    assert by(pieces.digests(docs).collect(), "doc_id", "ids_crc32", "decoded_sha256", "exact") == want and pieces.digests(none).count() == 0
    empty = spark.createDataFrame([(2**60 + 1, None), (None, [265])], "doc_id long, ids array<int>")
    assert by(pieces.decode(empty).collect(), "doc_id")[0] == (2**60 + 1,) and {r.text is None for r in pieces.decode(empty).collect()} == {True, False}


def test_a_worker_keeps_one_operators_cache():
    from proseloom.llm.common import worker_cache

    first = worker_cache("packing")
    first["x"] = 1
    assert worker_cache("packing") is first and worker_cache("quality") == {} and worker_cache("packing") == {}


def test_blocks_and_words():
    assert tokens.words_of("a\x1cb c d\x85\n e") == WORD.findall("a\x1cb c d\x85\n e")

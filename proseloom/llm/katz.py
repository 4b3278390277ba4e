"""Operator 2: Katz backoff language model with Good-Turing discounts.

Training counts all n-grams up to the order (3 in the query) of the documents with crc32(doc_id as text) mod 10 other
than 0, sentence start included as a context; the first tokens of a text have contexts as short as their history.
Counts r <= 5 are discounted by Good-Turing (Katz's formula), larger ones by a constant of 0.01 counts, so that every
context keeps some mass. P(w | h) = d(c) c / c(h) if the n-gram h w was seen, else alpha(h) P(w | h'), where h' is h
without its first token and alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of P(. | h') over the words seen after h):
the probabilities of a context, the one unknown word included, sum to exactly 1. An unseen context backs off with
weight 1. Where counts of counts are too thin for Good-Turing (a zero, or a discount outside (0, 1)), that discount is
absolute: n1 / (n1 + 2 n2) counts.

The corpus side: blocks of documents send each distinct n-gram, with its training count, to the bucket of its key. Words
and pairs go first, then each longer kind by itself, and Spark drops the files of an exchange when its table is written,
so that the disk holds one exchange at a time. The buckets write the count tables, in folders by kind (the n of the
n-grams) and in rows by key range: the answers to each block, counts of counts, and, for a stored model, keys and counts.
Backoff weights per context are gathered and written the same way. Each
block then evaluates its tokens recursively: the longest n-gram, else alpha and the next shorter one, down to the unknown
word. Nothing of corpus size reaches one task.

`score` trains and scores the same documents and keeps the weights that these need (training documents have seen all of
their n-grams, so only contexts of documents held out back off). `train` writes a `Stored` model with the weights of all
contexts, by which `score_by` scores other texts without counting again.

Keys are 64-bit hashes of n-grams. Nulls: a null text is empty (its only token is the end); a null id has the
crc of the empty string, so it is held out. Repeated rows train as often as they occur. Empty table: empty result. No
training rows: every token is unknown with probability 1. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, one_exchange, pack, scratch, staged, table, unpack
from .tokens import Block, blocks, bucket_count, dealt, hashes, ids_out, joined, mix, of_blocks, with_replies

K, FLOOR, ORDER = 5, 0.01, 3
END, START = hashes(["\n</s>", "\n<s>"])  # no word has a line feed
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
COUNTS = [f"n{r}" for r in range(1, K + 2)] + ["over", "types", "tokens"]
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(ids: np.ndarray, has_id: np.ndarray) -> np.ndarray:
    return np.array([crc_of_id(i if known else None) % 10 == 0 for i, known in zip(ids.tolist(), has_id.tolist(), strict=True)], bool)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in ascending order, the place of one of each, and for each entry which it is. As np.unique,
    which takes four times as long since it looks for the first place."""
    order = np.argsort(x)
    values = x[order]
    new = np.ones(len(x), bool)
    new[1:] = values[1:] != values[:-1]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return values[new], order[new], which


class Gram:
    """A block's distinct n-grams of one n. ``at``: the tokens that end one, ``of``: which; ``context`` and ``lower``:
    the n-grams of one less without the last and the first token; ``sent``: twice the training count, plus 1 if a
    document held out has it."""

    def __init__(self, at: np.ndarray, of: np.ndarray, context, lower, raw: np.ndarray, counts: np.ndarray, held: np.ndarray):
        self.at, self.of, self.context, self.lower, self.raw = at, of, context, lower, raw
        self.order = np.argsort(raw)
        self.keys, self.sent = raw[self.order], (counts * 2 + held)[self.order].astype(np.uint32)


class Grams:
    """A block's tokens and its distinct n-grams up to the order; ``grams[0]`` are the words."""

    def __init__(self, b: Block, order: int):
        low, number = "\n".join(b.words).encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n") if b.words else [], {}
        to = np.array([number.setdefault(w, len(number)) for w in low], np.int64)
        v = len(number)
        self.hash = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, v), [END, START]]).astype(np.uint64)
        n = len(b.lens)
        ends = b.starts[1:] + np.arange(n)
        self.word = np.full(len(b.ids) + n, v, np.int64)
        inside = np.ones(len(self.word), bool)
        inside[ends] = False
        if len(b.ids):
            self.word[inside] = to[b.ids]
        self.doc = np.repeat(np.arange(n), b.lens + 1)
        self.held = held_out(b.doc_ids, b.has_id)
        self.train = ~self.held[self.doc]
        counts = np.bincount(self.word[self.train], minlength=v + 2)
        counts[v + 1] = (~self.held).sum()
        held = np.bincount(self.word[~self.train], minlength=v + 2) > 0
        held[v + 1] = self.held.any()
        everywhere = np.arange(len(self.word))
        self.grams = [Gram(everywhere, self.word, None, None, mix(self.hash), counts, held)]
        place = everywhere - np.repeat(ends - b.lens, b.lens + 1)
        ending = self.word
        for k in range(2, order + 1):
            at = np.nonzero(place >= k - 2)[0]
            context = np.where(place[at] > 0, ending[at - 1], v + 1)  # the start comes before a first token
            own, some, of = distinct(context * (v + 2) + self.word[at])
            context = own // (v + 2)
            raw = mix(self.grams[-1].raw[context] + self.hash[own % (v + 2)] * np.uint64(0x9E3779B97F4A7C15))
            counts, held = (np.bincount(of[x[at]], minlength=len(own)) for x in (self.train, ~self.train))
            self.grams.append(Gram(at, of, context, ending[at[some]], raw, counts, held > 0))
            ending = np.full(len(self.word), -1, np.int64)
            ending[at] = of


ASK = "kind int, block long, bucket int, keys binary, counts binary"


def rounds(order: int) -> list[list[int]]:
    """The kinds whose counts are asked for together."""
    return [[k for k in (1, 2) if k <= order], *[[k] for k in range(3, order + 1)]]


def asked(b: Block, buckets: int, kinds: list[int]) -> list[dict]:
    rows = []
    for kind, g in list(enumerate(Grams(b, kinds[-1]).grams, 1))[kinds[0] - 1 :]:
        keys, counts = g.keys, g.sent
        cut = dealt(keys, buckets)
        rows += [{"kind": kind, "block": b.block, "bucket": i, "keys": pack(keys[s:e]), "counts": pack(counts[s:e])} for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
    return rows


ANSWER = "block long, bucket int, keys binary, answer binary, " + ", ".join(f"{c} long" for c in COUNTS) + ", kind int"
_START_KEY = mix(np.array([START], np.uint64))[0]


def counted(rows: pd.DataFrame, complete: bool = False) -> pd.DataFrame:
    """The corpus counts of a bucket's keys, for each block that asked; one block that asked owns an n-gram. Row -1 holds
    the bucket's counts of counts and, if the table is to be complete, its keys and counts."""
    rows = rows.sort_values("block")
    kind, bucket = int(rows["kind"].iloc[0]), int(rows["bucket"].iloc[0])
    keys = [unpack(k, np.uint64) for k in rows["keys"]]
    flat = np.concatenate(keys)
    own, some, inverse = distinct(flat)
    sent = np.concatenate([unpack(c, np.uint32) for c in rows["counts"]])
    totals = np.bincount(inverse, (sent >> np.uint32(1)).astype(np.float64), len(own)).astype(np.int64)
    held = np.bincount(inverse, sent & np.uint32(1), len(own)) > 0
    owner = np.zeros(len(flat), np.uint64)
    owner[some] = 1
    sent = (totals * 4 + held * 2)[inverse].astype(np.uint64) + owner
    cut = np.cumsum([0, *map(len, keys)])
    out = pd.DataFrame({"kind": kind, "block": rows["block"].to_numpy(), "bucket": bucket, "answer": [pack(sent[s:e]) for s, e in zip(cut, cut[1:], strict=False)]})
    real = totals[(totals > 0) & ~((own == _START_KEY) & (kind == 1))]
    size = np.bincount(np.minimum(real, K + 2), minlength=K + 3)
    seen = totals > 0
    stats = {"kind": kind, "block": -1, "bucket": bucket, "keys": pack(own[seen]) if complete else None, "answer": pack(totals[seen]) if complete else None, **{f"n{r}": size[r] for r in range(1, K + 2)}, "over": int((real > K).sum()), "types": len(real), "tokens": int(real.sum())}
    return pd.concat([out, pd.DataFrame([stats])]).reindex(columns=[c.split()[0] for c in ANSWER.split(", ")]).astype({c: "Int64" for c in COUNTS})


def looked_up(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """What `counted` answers, from the count table of a stored model."""
    names = [c.split()[0] for c in ANSWER.split(", ")]
    if not len(rows):
        return pd.DataFrame(columns=names)
    own, totals = unpack(model["keys"].iloc[0], np.uint64) if len(model) else np.zeros(0, np.uint64), unpack(model["answer"].iloc[0], np.int64) if len(model) else np.zeros(0, np.int64)
    rows = rows.sort_values("block")
    out = []
    for r in rows.itertuples(index=False):
        keys = unpack(r.keys, np.uint64)
        at = np.searchsorted(own, keys)
        found = at < len(own)
        found[found] = own[at[found]] == keys[found]
        total = np.zeros(len(keys), np.int64)
        total[found] = totals[at[found]]
        out.append({"kind": r.kind, "block": r.block, "bucket": r.bucket, "answer": pack((total * 4 + 2).astype(np.uint64))})
    return pd.DataFrame(out).reindex(columns=names).astype({c: "Int64" for c in COUNTS})


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r = 0..K from the counts of counts n[0] = n1, ..., n[K] = n(K+1); d[0] is unused."""
    d = np.ones(K + 1)
    absolute = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d[r] = (r - absolute) / r
        if all(n) and common < 1:
            exact = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
            if 0 < exact < 1:
                d[r] = exact
    return d


class Model:
    """Fixed-size part of the model: totals and the discounts of each order."""

    def __init__(self, stats: dict[int, dict], order: int):
        none = dict.fromkeys(COUNTS, 0)
        one = stats.get(1, none)
        self.tokens, self.types = one["tokens"], one["types"]
        n = [one[f"n{r}"] for r in range(1, K + 2)]
        self.of = {k: discounts([stats.get(k, none)[f"n{r}"] for r in range(1, K + 2)]) for k in range(1, order + 1)}
        kept_back = sum(n[r - 1] * r * (1 - self.of[1][r]) for r in range(1, K + 1)) + FLOOR * one["over"]
        self.unknown = kept_back / self.tokens if self.tokens else 1.0

    @staticmethod
    def shrunk(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(c > K, c - FLOOR, d[np.minimum(c, K)] * c)

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.shrunk(c, self.of[1]) / max(1, self.tokens), self.unknown)


SCORED = "part string, block long, kind int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"


def scored(b: Block, answers: pd.DataFrame, model: Model, buckets: int, order: int, complete: bool = False) -> pd.DataFrame:
    """Rows of three parts: the block's documents with what their seen n-grams give, sums per context of the n-grams
    the block owns, and the contexts whose backoff weight it needs."""
    p = Grams(b, order)
    counts, owned, held = [], [], []
    for kind, g in enumerate(p.grams, 1):
        reply = joined(answers, kind, "answer", np.uint64)
        answer = np.empty(len(reply), np.int64)
        answer[g.order] = reply.astype(np.int64)
        counts.append(answer >> 2)
        held.append((answer & 2).astype(bool))
        owned.append((answer & 1).astype(bool))
    # What an n-gram gives where it was seen; of words, the unknown one too.
    value = [model.word(counts[0])]
    for k in range(2, order + 1):
        value.append(model.shrunk(counts[k - 1], model.of[k]) / np.maximum(1, counts[k - 2][p.grams[k - 1].context]))
    n, docs, count = len(b.lens), p.doc, counts[0]
    known = np.bincount(docs, count[p.word] > 0, n)
    base = np.bincount(docs, np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[p.word], n)
    given = np.zeros(len(p.word))
    left = np.ones(len(p.word), bool)
    needs = {}
    for k in range(order, 1, -1):
        g = p.grams[k - 1]
        seen = counts[k - 1][g.of] > 0
        now = left[g.at] & seen
        given[g.at[now]] = value[k - 1][g.of[now]]
        left[g.at[now]] = False
        backs = left[g.at] & (counts[k - 2][g.context] > 0)[g.of]
        needs[k] = (g.at[backs], g.context[g.of[backs]])
    given[left] = value[0][p.word[left]]
    part = np.bincount(docs, np.log10(given), n)
    rows, whose, place, base_rank = [], [], [], 0
    for k in range(2, order + 1):
        raw = p.grams[k - 2].raw
        at, context = needs[k]
        need, _, where = distinct(context)
        keys = raw[need]
        by_key = np.argsort(keys)
        rank = np.empty(len(by_key), np.int32)
        rank[by_key] = np.arange(len(by_key))
        whose.append(docs[at].astype(np.int32))
        place.append((rank[where] + base_rank).astype(np.int32))
        base_rank += len(need)
        cut = dealt(keys[by_key], buckets)
        rows += [{"part": "ask", "block": b.block, "kind": k, "bucket": i, "a": pack(keys[by_key][s:e])} for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
        g = p.grams[k - 1]
        # All n-grams of training documents are seen, so only contexts in documents held out are asked for.
        mine = owned[k - 1] & (counts[k - 1] > 0) & (held[k - 2][g.context] | complete)
        have, _, slot = distinct(g.context[mine])
        spare = np.bincount(slot, (counts[k - 1] - model.shrunk(counts[k - 1], model.of[k]))[mine], len(have))
        below = np.bincount(slot, value[k - 2][g.lower[mine]], len(have))
        total = counts[k - 2][have]
        keys = raw[have]
        by_key = np.argsort(keys)
        cut = dealt(keys[by_key], buckets)
        rows += [{"part": "sum", "block": b.block, "kind": k, "bucket": i, "a": pack(keys[by_key][s:e]), "b": pack(spare[by_key][s:e]), "c": pack(below[by_key][s:e]), "d": pack(total[by_key][s:e])} for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
    whose, place = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (whose, place))
    rows.append({"part": "docs", "block": b.block, "a": pack(b.doc_ids), "b": pack(b.lens + 1), "c": pack(np.stack([known, base, part], 1).reshape(-1)), "d": pack(whose), "e": pack(place), "f": pack(b.has_id)})
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCORED.split(", ")]).astype({"kind": "Int32", "bucket": "Int32"})


WEIGHTS = "block long, bucket int, keys binary, alpha binary, kind int"


def summed(rows: pd.DataFrame, complete: bool = False) -> pd.DataFrame:
    """Backoff weights of a bucket's contexts, from what discounts spare and the lower-order mass of the words seen after
    each, for the blocks that asked; row -1 is the bucket's part of the table of weights, if it is to be complete."""
    rows = rows.sort_values(["part", "block"])
    given, asks = rows[rows["part"] == "sum"], rows[rows["part"] == "ask"]
    keys = np.concatenate([np.zeros(0, np.uint64), *[unpack(a, np.uint64) for a in given["a"]]])
    own, some, inverse = distinct(keys)
    spare, below = [np.bincount(inverse, np.concatenate([np.zeros(0), *[unpack(x, np.float64) for x in given[c]]]), len(own)) for c in "bc"]
    total = np.concatenate([np.zeros(0, np.int64), *[unpack(x, np.int64) for x in given["d"]]])[some]
    # Every discount spares something, and the unknown word is never among those seen, so neither side is 0.
    alpha = spare / total / (1 - below)
    out = [(r.block, r.bucket, None, pack(alpha[np.searchsorted(own, unpack(r.a, np.uint64))]), r.kind) for r in asks.itertuples(index=False)]
    if complete:
        out.append((-1, int(rows["bucket"].iloc[0]), pack(own), pack(alpha), int(rows["kind"].iloc[0])))
    return pd.DataFrame(out, columns=["block", "bucket", "keys", "alpha", "kind"])


def weighed(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """What `summed` answers, from the table of weights of a stored model. All contexts that are asked for are there."""
    out = []
    if len(rows):
        own, alpha = unpack(model["keys"].iloc[0], np.uint64), unpack(model["alpha"].iloc[0], np.float64)
        out = [(r.block, r.bucket, None, pack(alpha[np.searchsorted(own, unpack(r.a, np.uint64))]), r.kind) for r in rows.itertuples(index=False)]
    return pd.DataFrame(out, columns=["block", "bucket", "keys", "alpha", "kind"])


def finished(docs: pd.DataFrame, weights: pd.DataFrame, tokens: int) -> pd.DataFrame:
    names = [c.split()[0] for c in RESULT.split(", ")]
    if not len(docs):
        return pd.DataFrame(columns=names)
    r = next(docs.itertuples(index=False))
    ids, lens, has_id = unpack(r.a, np.int64), unpack(r.b, np.int64), unpack(r.f, np.bool_)
    known, base, part = unpack(r.c, np.float64).reshape(-1, 3).T
    weights = weights.sort_values(["kind", "bucket"])
    alpha = np.concatenate([np.zeros(0), *[unpack(x, np.float64) for x in weights["alpha"]]])
    part = part + np.bincount(unpack(r.d, np.int32), np.log10(alpha)[unpack(r.e, np.int32)], len(ids))
    return pd.DataFrame({"doc_id": ids_out(ids, has_id), "held_out": held_out(ids, has_id), "n_tokens": lens, "n_known": known.astype(np.int64), "train_tokens": tokens, "base_score": base, "score": part})


def _model(counts: DataFrame, order: int) -> Model:
    stats = counts.where("block = -1").groupBy("kind").agg(*[F.sum(c).alias(c) for c in COUNTS]).collect()  # a row for each n
    return Model({r["kind"]: {c: int(r[c]) for c in COUNTS} for r in stats}, order)


def _counted(docs: DataFrame, order: int, complete: bool) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, the table of counts, what blocks know of their documents and contexts, and the number of buckets."""
    parts = blocks(docs)
    buckets = bucket_count(parts)
    counts = None
    for kinds in rounds(order):
        asks = of_blocks(parts, lambda b, kinds=kinds: asked(b, buckets, kinds), ASK)
        some = staged(asks.groupBy("kind", "bucket").applyInPandas(lambda rows: counted(rows, complete), ANSWER), "ngram-counts", keep=complete, by=("kind",))
        counts = some if counts is None else counts.unionByName(some)
    model = _model(counts, order)
    answers = counts.where("block >= 0").select("kind", "block", "bucket", "answer")
    first = with_replies(parts, answers, lambda b, a: scored(b, a, model, buckets, order, complete), SCORED)
    return model, counts, staged(first, "scored", up=1), buckets


def _trained(docs: DataFrame, order: int, complete: bool) -> tuple[Model, DataFrame, DataFrame, DataFrame, int]:
    """As `_counted`, with the table of weights third. Blocks, and counts unless kept, are gone when weights are summed."""
    with scratch(docs.sparkSession):
        model, counts, first, buckets = _counted(docs, order, complete)
    sums = first.where("part <> 'docs'").groupBy("kind", "bucket").applyInPandas(lambda rows: summed(rows, complete), WEIGHTS)
    return model, counts, staged(sums, "ngram-backoff", keep=complete, by=("kind",)), first, buckets


def _evaluated(first: DataFrame, weights: DataFrame, tokens: int) -> DataFrame:
    docs = first.where("part = 'docs'").groupBy("block")
    return docs.cogroup(weights.where("block >= 0").groupBy("block")).applyInPandas(lambda d, w: finished(d, w, tokens), RESULT)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """By n-grams up to the order, learned from the documents that are not held out: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score for every document."""
    with scratch(docs.sparkSession), one_exchange(docs.sparkSession):
        model, _, weights, first, _ = _trained(docs, order, False)
        return staged(_evaluated(first, weights, model.tokens), "katz", keep=True)


class Stored(NamedTuple):
    """A model in tables: ``counts`` and ``weights`` by kind and bucket; row -1 of each holds keys and values."""

    counts: DataFrame
    weights: DataFrame
    order: int
    buckets: int


def train(docs: DataFrame, order: int = ORDER) -> Stored:
    """The model of the documents that are not held out, with the backoff weights of all contexts."""
    with scratch(docs.sparkSession), one_exchange(docs.sparkSession):
        _, counts, weights, _, buckets = _trained(docs, order, True)
    return Stored(counts.where("block = -1"), weights.where("block = -1"), order, buckets)


def score_by(docs: DataFrame, stored: Stored) -> DataFrame:
    """What `score` returns, by a stored model. Its buckets are looked up, not counted again."""
    order, buckets = stored.order, stored.buckets
    with scratch(docs.sparkSession):
        parts, model = blocks(docs), _model(stored.counts, order)
        asks = of_blocks(parts, lambda b: asked(b, buckets, list(range(1, order + 1))), ASK)
        answers = asks.groupBy("kind", "bucket").cogroup(stored.counts.groupBy("kind", "bucket")).applyInPandas(looked_up, ANSWER)
        first = staged(with_replies(parts, answers.select("kind", "block", "bucket", "answer"), lambda b, a: scored(b, a, model, buckets, order), SCORED), "scored")
        weights = first.where("part = 'ask'").groupBy("kind", "bucket").cogroup(stored.weights.groupBy("kind", "bucket")).applyInPandas(weighed, WEIGHTS)
        return staged(_evaluated(first, weights, model.tokens), "katz", keep=True)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), ORDER)

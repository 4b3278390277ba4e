"""Operator 12: exact ranked lexical search of many items at once, by a dual tree.

Items are split into a tree: all, NODES_1 nodes, leaves of LEAF_ITEMS. The documents of a block are ordered by the item
node they fit best and by how well, and make a tree too: the block, runs of DOCS_1, leaves of LEAF_DOCS. A node of
documents holds for each term the largest impact of any of them, a node of items the largest weight of any of them; the
sum over terms of their product bounds every score between the two. A pair of nodes whose bound is below the weakest
k-th best score of its items is left out with all pairs below it; leaves that stay are multiplied out, the best bound
first, so that k-th scores rise early. Impacts and weights are integers and all sums exact.

Documents are read once for each group of items (GROUP_ITEMS items or GROUP_BYTES of text on average; the number of
groups grows with the items): a block keeps the terms its group has, as packed postings. Only a group's terms, weights
and floors are sent to the tasks. The first block of each partition is searched without floors; the k-th best scores over
all of these are floors for every other block, so tasks return few rows besides.

Nulls: a null text has no terms, an item without terms no rows. A null doc_id is ordered as the largest long and comes
back null, as does a null item_id. Repeated documents are ranked as often as they occur, repeated items are each
answered. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_bytes, pack, scratch, staged, table, terms_of, unpack, with_nulls, worker_cache

TOP = 50
GROUP_ITEMS, GROUP_BYTES = 256, 8 << 20
NODES_1, LEAF_ITEMS = 8, 8
DOCS_A_BLOCK, POSTINGS_A_BLOCK, DOCS_1, LEAF_DOCS = 4096, 1 << 20, 256, 16
NO_ID = np.iinfo(np.int64).max
BLOCK = "seq int, n_docs long, n_terms long, has_id binary, ids binary, sizes binary, lens binary, terms binary, tfs binary"
FOUND = "item int, has_id boolean, doc_id long, score long"


def _bounds(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens)])


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """BLOCK: of documents with a term of the vocabulary their ids, numbers of terms and postings; n_docs and n_terms
    count all documents and all their terms."""
    spread = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("lexical")
        number = {w: i for i, w in enumerate(spread.value)}
        get, width, seq = number.get, len(number), 0
        n_docs = n_terms = 0
        has, ids, sizes, lens, terms, tfs, held = [], [], [], [], [], [], 0

        def row() -> pd.DataFrame:
            flat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)
            return pd.DataFrame([{"seq": seq, "n_docs": n_docs, "n_terms": n_terms, "has_id": pack(np.array(has, np.bool_)), "ids": pack(np.array(ids, np.int64)), "sizes": pack(np.array(sizes, np.int64)), "lens": pack(np.array(lens, np.int32)), "terms": pack(flat(terms)), "tfs": pack(flat(tfs))}])

        for b in batches:
            for known, doc_id, raw in b.itertuples(index=False):
                words = terms_of(raw)
                n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                mine = array("i", [v for v in map(get, words) if v is not None])
                if not mine:
                    continue
                counts = np.bincount(np.frombuffer(mine, np.int32)) if len(mine) * 8 > width else None
                own, n = (np.flatnonzero(counts), counts[counts > 0]) if counts is not None else np.unique(np.frombuffer(mine, np.int32), return_counts=True)
                has.append(known)
                ids.append(doc_id if known else NO_ID)
                sizes.append(len(words))
                lens.append(len(own))
                terms.append(own)
                tfs.append(n)
                held += len(own)
                if len(ids) >= DOCS_A_BLOCK or held >= POSTINGS_A_BLOCK:
                    yield row()
                    has, ids, sizes, lens, terms, tfs, held, n_docs, n_terms, seq = [], [], [], [], [], [], 0, 0, 0, seq + 1
        yield row()

    return keyed_bytes(docs).mapInPandas(run, BLOCK)


def frequencies(blocks: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms, and by term of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(width, np.int64)
        for b in batches:
            for blob in b["terms"]:
                df += np.bincount(unpack(blob, np.int32), minlength=width)
        yield pd.DataFrame({"term": np.flatnonzero(df), "n": df[df > 0]})

    held = blocks.select("terms").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n, terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = np.zeros(width, np.int64)
    for r in held.collect():  # no more rows than the group has terms
        out[r["term"]] = r["n"]
    return n or 0, terms or 0, out


def halves(order: np.ndarray, vectors: list[dict], least: int) -> np.ndarray:
    """The items in an order whose runs are alike: split by which of two far items they share more weight with, in two
    halves of whole leaves, again and again."""
    if len(order) <= least:
        return order
    shared = lambda a, b: sum(w for t, w in vectors[a].items() if t in vectors[b])
    one = min(order, key=lambda i: (shared(order[0], i), i))
    other = min(order, key=lambda i: (shared(one, i), i))
    ranked = np.array(sorted(order, key=lambda i: (shared(other, i) - shared(one, i), i)))
    half = -(-len(ranked) // (2 * least)) * least
    return np.concatenate([halves(ranked[:half], vectors, least), halves(ranked[half:], vectors, least)])


class Items:
    """The tree over a group's items; ``order`` lists them as its leaves do."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        vectors = [{t: int(weights[t]) for t in terms} for terms in items]
        self.order = halves(np.arange(len(items)), vectors, LEAF_ITEMS)
        width = len(weights)
        cut = lambda n: [(at, min(at + n, len(items))) for at in range(0, len(items), n)]
        self.leaves = cut(LEAF_ITEMS)
        each = -(-len(self.leaves) // NODES_1)
        self.inner = [(i, min(i + each, len(self.leaves))) for i in range(0, len(self.leaves), each)]
        # Largest weight by term: of the leaves, the inner nodes, and all.
        leaf = np.zeros((width, len(self.leaves)), np.int64)
        self.own = []
        for n, (a, b) in enumerate(self.leaves):
            terms = np.array(sorted({t for i in self.order[a:b] for t in items[i]}), np.int64)
            held = np.array([[int(weights[t]) if t in vectors[i] else 0 for i in self.order[a:b]] for t in terms.tolist()], np.int64).reshape(len(terms), b - a)
            leaf[terms, n] = held.max(1, initial=0)
            self.own.append((terms, held))
        inner = np.stack([leaf[:, a:b].max(1) for a, b in self.inner], 1)
        self.tops = [inner.max(1, keepdims=True), inner, leaf]
        # Products of doubles are exact below 2^53; an impact is under 10^6.
        self.exact = max((int(h.sum(0).max(initial=0)) for _, h in self.own), default=0) * 10**6 < 2**53
        if self.exact:
            self.own = [(t, h.astype(np.float64)) for t, h in self.own]


class Docs:
    """The tree over a block's documents."""

    def __init__(self, row, items: Items, n: int, total: int):
        has, ids, sizes = unpack(row.has_id, np.bool_), unpack(row.ids, np.int64), unpack(row.sizes, np.int64)
        lens, terms, tfs = unpack(row.lens, np.int32).astype(np.int64), unpack(row.terms, np.int32).astype(np.int64), unpack(row.tfs, np.int32).astype(np.int64)
        long = [100 - 50 + (50 * s * n) // total for s in sizes.tolist()]
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(np.array(long, np.int64), lens))
        # Documents by the inner item node they fit best, and by how well.
        fit = self._sums(lens, terms, impact, items.tops[1])
        best = fit.argmax(1)
        order = np.lexsort((ids, -fit[np.arange(len(ids)), best], best))
        at = _bounds(lens)[:-1][order]
        lens = lens[order]
        place = np.repeat(at - _bounds(lens)[:-1], lens) + np.arange(lens.sum())
        self.has, self.ids, self.terms, self.impact, self.cut = has[order], ids[order], terms[place], impact[place], _bounds(lens)
        node = np.repeat(np.arange(len(ids)), lens)
        self.levels = [self._node(node // size) for size in (len(ids), DOCS_1, LEAF_DOCS)]

    @staticmethod
    def _sums(lens: np.ndarray, terms: np.ndarray, values: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """Row by row the sum of value * top over its terms; some rows at a time, so memory is bounded."""
        cut, out = _bounds(lens), []
        step = max(1, (1 << 21) // max(1, tops.shape[1]))
        at = 0
        while at < len(lens):
            end = max(at + 1, int(np.searchsorted(cut, cut[at] + step, "right")) - 1)
            part = slice(cut[at], cut[end])
            out.append(np.add.reduceat(values[part, None] * tops[terms[part]], cut[at:end] - cut[at], axis=0))
            at = end
        return np.concatenate(out)

    def _node(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, terms and largest impacts of nodes."""
        key = np.lexsort((self.terms, node))
        t, v, k = self.terms[key], self.impact[key], node[key]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
        return np.bincount(k[first]), t[first], np.maximum.reduceat(v, first)

    def bounds(self, level: int, rows: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """Bounds of some nodes of a level against all item nodes given by their largest weights."""
        lens, terms, values = self.levels[level]
        cut = _bounds(lens)
        place = np.repeat(cut[:-1][rows] - _bounds(lens[rows])[:-1], lens[rows]) + np.arange(lens[rows].sum())
        return self._sums(lens[rows], terms[place], values[place], tops)


class Search:
    """The best documents of a group's items so far. ``pairs`` counts leaf pairs, ``solved`` those multiplied out."""

    def __init__(self, items: Items, k: int, floors: np.ndarray | None = None):
        self.items, self.k, self.pairs, self.solved = items, k, 0, 0
        self.kth = np.zeros(len(items.order), np.int64) if floors is None else floors[items.order].copy()
        self.scores = [np.zeros(0, np.int64) for _ in items.order]
        self.docs = [np.zeros(0, np.int64) for _ in items.order]
        self.has = [np.zeros(0, np.bool_) for _ in items.order]
        self.where = np.full(len(items.tops[2]), -1, np.int64)

    def block(self, d: Docs) -> None:
        items, n = self.items, len(d.ids)
        weakest = lambda a, b: self.kth[items.leaves[a][0] : items.leaves[b - 1][1]].min()
        stays = lambda bound, floor: (bound >= floor) & (bound > 0)
        runs, leaves = -(-n // DOCS_1), -(-n // LEAF_DOCS)
        self.pairs += leaves * len(items.leaves)
        if not stays(d.bounds(0, np.array([0]), items.tops[0]), self.kth.min()).any():
            return
        floor = np.array([weakest(a, b) for a, b in items.inner])
        inner = stays(d.bounds(1, np.arange(runs), items.tops[1]), floor)
        rows = np.flatnonzero(np.repeat(inner.any(1), DOCS_1 // LEAF_DOCS)[:leaves])
        if not len(rows):
            return
        bound = d.bounds(2, rows, items.tops[2])
        under = np.repeat(np.arange(len(items.inner)), [b - a for a, b in items.inner])
        floor = np.array([weakest(i, i + 1) for i in range(len(items.leaves))])
        keep = stays(bound, floor) & inner[rows // (DOCS_1 // LEAF_DOCS)][:, under]
        r, c = np.nonzero(keep)
        for i in np.argsort(-bound[r, c], kind="stable").tolist():
            if bound[r[i], c[i]] >= weakest(c[i], c[i] + 1):
                self.leaf(d, int(rows[r[i]]) * LEAF_DOCS, int(c[i]))

    def leaf(self, d: Docs, at: int, leaf: int) -> None:
        self.solved += 1
        end, (terms, held), (a, b) = min(at + LEAF_DOCS, len(d.ids)), self.items.own[leaf], self.items.leaves[leaf]
        part = slice(d.cut[at], d.cut[end])
        self.where[terms] = np.arange(len(terms))
        column = self.where[d.terms[part]]
        self.where[terms] = -1
        row, some = np.repeat(np.arange(end - at), np.diff(d.cut[at : end + 1])), column >= 0
        dense = np.zeros((end - at, len(terms)), held.dtype)
        dense[row[some], column[some]] = d.impact[part][some]
        scores = (dense @ held).astype(np.int64)
        for j in np.flatnonzero(((scores >= self.kth[a:b]) & (scores > 0)).any(0)).tolist():
            hit = np.flatnonzero((scores[:, j] >= self.kth[a + j]) & (scores[:, j] > 0))
            s, i, h = np.concatenate([self.scores[a + j], scores[hit, j]]), np.concatenate([self.docs[a + j], d.ids[at + hit]]), np.concatenate([self.has[a + j], d.has[at + hit]])
            best = np.lexsort((i, -s))[: self.k]
            self.scores[a + j], self.docs[a + j], self.has[a + j] = s[best], i[best], h[best]
            if len(best) == self.k:
                self.kth[a + j] = max(self.kth[a + j], s[best[-1]])

    def rows(self) -> pd.DataFrame:
        lens = [len(s) for s in self.scores]
        flat = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        return pd.DataFrame({"item": np.repeat(self.items.order, lens).astype(np.int32), "has_id": flat(self.has, np.bool_), "doc_id": flat(self.docs, np.int64), "score": flat(self.scores, np.int64)})


def searched(blocks: DataFrame, items: list[list[int]], weights: np.ndarray, n: int, total: int, k: int, floors: np.ndarray | None = None) -> DataFrame:
    """FOUND: the k best documents of each item among a partition's blocks, none below its floor."""
    spread = blocks.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(Items(*spread.value), k, floors)
        for b in batches:
            for row in b.itertuples(index=False):
                d = Docs(row, search.items, n, total) if row.n_docs and len(unpack(row.lens, np.int32)) else None
                if d:
                    search.block(d)
        yield search.rows()

    return blocks.mapInPandas(run, FOUND)


def _group(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """FOUND and rank of a group's items, by their place in the group."""
    found = [sorted(set(terms_of(t))) for t in texts]
    vocabulary = sorted({w for ws in found for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    items = [[number[w] for w in ws] for ws in found]
    blocks = staged(postings(docs, vocabulary), "postings")
    n, total, df = frequencies(blocks, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.when(F.col("has_id"), F.col("doc_id")).otherwise(F.lit(NO_ID)))
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = staged(best(searched(blocks.where("seq = 0"), items, weights, n, total, k)), "home")
    floors = np.zeros(len(items), np.int64)
    for r in home.where(F.col("rank") == k).select("item", "score").collect():  # one row an item of the group
        floors[r["item"]] = r["score"]
    return best(home.drop("rank").unionByName(searched(blocks.where("seq > 0"), items, weights, n, total, k, floors)))


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item, scores above 0 only."""
    spark = docs.sparkSession
    with scratch(spark):
        asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.monotonically_increasing_id().alias("row"))
        count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
        groups = max(-(-count // GROUP_ITEMS), -(-size // GROUP_BYTES))
        asked = staged(asked.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(max(1, groups))).cast("int")), "items")
        out = None
        for g in range(groups):
            # One group is at the driver at a time, a few megabytes.
            own = asked.where(F.col("group") == g).orderBy("row").collect()
            if not own:
                continue
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], "item int, item_id long")
            found = with_nulls(_group(docs, [bytes(r["raw"]) for r in own], k)).join(F.broadcast(names), "item")
            found = staged(found.select("item_id", "rank", "doc_id", "score"), "ranked", keep=True)
            out = found if out is None else out.unionByName(found)
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Operator 7: Jaccard self-join on word 5-grams (similarity 0.8 and more) by chosen paths.

Documents with equal word sequences are one node. In each of several runs a node x chooses each of its shingles with
probability 1 / (0.8 |x|), by a hash all nodes share; nodes that choose a common shingle meet in its bucket. Buckets of
more than LIMIT nodes are split again: their nodes extend the path by further chosen shingles, up to DEPTH. Small
buckets are compared outright, first by a sketch of 64 bytes that only drops pairs six standard deviations below the
threshold. The number of runs follows from the target recall (`runs_for`), for the hardest pair at the threshold and
three levels of splitting; split paths choose each shingle more often (`branch_for`), so that the target holds at full
depth with the same runs. Buckets still large at full depth hold nodes with many shingles in common; they are linked to
their smallest node as candidates.

Candidates only group nodes: in each connected group all pairs are then compared exactly on their whole shingle sets,
groups of over TILE nodes in pairs of tiles spread over the cluster, and only counts and a spanning forest are kept.
So links are exact, no pair is written out, and a group of n near copies sends n * ceil(n / TILE) sets, about 2 TILE of
them to each comparison.

Result: one row per document with class_id (smallest doc_id of the documents it is linked with, directly or through
others), text_class_id (smallest doc_id with the same words), n_copies (documents with the same words) and n_links
(other word sequences with similarity of 0.8 or more). Documents under five words have no shingles and only match equal
words; so do null and empty texts, which count as equal. A null id is ordered as the largest long; where that is the
smallest of a class, its rows without an id get null as their class. Repeated rows are copies. Empty table: empty
result. Extra columns are ignored.

Nothing here gathers a hot key: a block sends at most LIMIT + 1 nodes of a shingle or path, equal texts are one node of
a block, and joins on a class send classes of many nodes to the rows instead (`spread_join`).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, pack, scratch, sized, spread_join, staged, table, unpack, with_pairs, words_hash
from .components import components
from .repeats import Rolling, _cut
from .tokens import NO_ID, Block, blocks, bucket_count, dealt, hashes, ids_out, joined, mix, of_blocks, with_replies

GRAM, SIMILAR, RECALL = 5, 0.8, 0.9999
LIMIT, DEPTH, TILE, BINS = 64, 5, 512, 64
_EDGES = np.array([], np.int64)


def meets(levels: int, branch: float = 1.0) -> float:
    """Probability that a pair at the threshold meets on a path of so many levels of one run. Its common chosen shingles
    number 1 on average at the first level and ``branch`` at each further one (Poisson)."""
    p = 1.0
    for _ in range(levels - 1):
        p = 1 - math.exp(-branch * p)
    return 1 - math.exp(-p)


def runs_for(recall: float, levels: int = 3) -> int:
    """Runs until a pair at the threshold has met on a path of so many levels with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meets(levels)))


def branch_for(recall: float, runs: int, levels: int) -> float:
    """How much oftener split paths choose a shingle, in steps of 1/64, so that these runs reach the recall."""
    steps = 64
    while (1 - meets(levels, steps / 64)) ** runs > 1 - recall:
        steps += 1
    return steps / 64


class Sets:
    """A block's nodes and their shingle sets. Nodes are signed 64-bit hashes of the word sequence."""

    def __init__(self, b: Block):
        h = hashes(b.words)[b.ids] if len(b.ids) else np.zeros(0, np.uint64)
        rolling, n = Rolling(h), b.lens
        whole = mix(rolling.at(b.starts[:-1], n) + mix(n.astype(np.uint64)))
        self.node, first, self.of = np.unique(whole.view(np.int64), return_index=True, return_inverse=True)
        self.low = np.full(len(self.node), NO_ID)
        np.minimum.at(self.low, self.of, b.doc_ids)
        self.copies = np.bincount(self.of, minlength=len(self.node))
        size = np.maximum(0, n[first] - GRAM + 1)
        self.owner = np.repeat(np.arange(len(first)), size)
        at = np.repeat(b.starts[first] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        grams = rolling.at(at, GRAM) if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((grams, self.owner))
        grams, owner = grams[order], self.owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.grams, self.owner = grams[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(self.node))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        with np.errstate(divide="ignore"):
            self.bar = np.minimum(2.0**64 / (SIMILAR * self.size), 2.0**64 - 2048).astype(np.uint64)

    def chosen(self, runs: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first level and the nodes that chose them."""
        keys, nodes = [], []
        bar = self.bar[self.owner]
        for r in range(runs):
            seed = mix(np.array([r + 1], np.uint64))
            pick = np.nonzero(mix(self.grams ^ seed) < bar)[0]
            keys.append(mix(self.grams[pick] + seed))
            nodes.append(self.owner[pick])
        return np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*nodes, np.zeros(0, np.int64)])

    def deeper(self, keys: np.ndarray, nodes: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
        """The paths one level longer, of the given paths."""
        with np.errstate(divide="ignore"):
            bar = np.minimum(branch * 2.0**64 / (SIMILAR * self.size), 2.0**64 - 2048).astype(np.uint64)
        out, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at in range(0, len(keys), 2000):
            k, n = keys[at : at + 2000], nodes[at : at + 2000]
            size = self.size[n]
            index = np.repeat(self.start[n] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            path, g = np.repeat(k, size), self.grams[index]
            pick = mix(g ^ path) < np.repeat(bar[n], size)
            out.append(mix(path[pick] * np.uint64(3) + g[pick]))
            whose.append(np.repeat(n, size)[pick])
        return np.concatenate(out), np.concatenate(whose)

    def sketches(self) -> np.ndarray:
        """For each node and bin of the hash range a byte of the smallest shingle in it; 0 for none."""
        out = np.zeros((len(self.node), BINS), np.uint8)
        bin_ = (self.grams >> np.uint64(64 - int(math.log2(BINS)))).astype(np.int64)
        new = np.ones(len(bin_), bool)
        new[1:] = (bin_[1:] != bin_[:-1]) | (self.owner[1:] != self.owner[:-1])
        out[self.owner[new], bin_[new]] = (mix(self.grams[new] + np.uint64(77)) % np.uint64(255)).astype(np.uint8) + 1
        return out


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each distinct one begins, and each entry's rank among those of its key."""
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return first, np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


ASK = "kind int, block long, bucket int, keys binary, nodes binary, low binary, copies binary"
REPLY = "kind int, block long, bucket int, answer binary, copies binary"


def asked(b: Block, buckets: int, runs: int) -> list[dict]:
    s = Sets(b)
    key = mix(s.node.view(np.uint64))
    order = np.argsort(key)
    cut = dealt(key[order], buckets)
    rows = [{"kind": 0, "block": b.block, "bucket": i, "keys": pack(key[order][x:y]), "low": pack(s.low[order][x:y]), "copies": pack(s.copies[order][x:y])} for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
    keys, nodes = s.chosen(runs)
    order = np.argsort(keys)
    keys, nodes = keys[order], s.node[nodes[order]]
    some = ranks(keys)[1] <= LIMIT  # more would not change the answer
    keys, nodes = keys[some], nodes[some]
    cut = dealt(keys, buckets)
    return rows + [{"kind": 1, "block": b.block, "bucket": i, "keys": pack(keys[x:y]), "nodes": pack(nodes[x:y])} for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]


def counted(rows: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: smallest doc_id and copies of each node. Kind 1: distinct nodes at each key (at most LIMIT + 1)."""
    rows = rows.sort_values("block")
    kind = int(rows["kind"].iloc[0])
    each = [unpack(k, np.uint64) for k in rows["keys"]]
    keys, lens = np.concatenate(each), [len(k) for k in each]
    out = pd.DataFrame({"kind": kind, "block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy()})
    own, inverse = np.unique(keys, return_inverse=True)
    if kind:
        nodes = np.concatenate([unpack(x, np.int64) for x in rows["nodes"]])
        order = np.lexsort((nodes, inverse))
        new = np.ones(len(order), bool)
        new[1:] = (inverse[order][1:] != inverse[order][:-1]) | (nodes[order][1:] != nodes[order][:-1])
        count = np.bincount(inverse[order[new]], minlength=len(own))
        return out.assign(answer=_cut(np.minimum(count, LIMIT + 1).astype(np.uint8)[inverse], lens), copies=None)
    low = np.full(len(own), NO_ID)
    np.minimum.at(low, inverse, np.concatenate([unpack(x, np.int64) for x in rows["low"]]))
    # One block speaks for a node: the first.
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    copies = np.bincount(inverse, np.concatenate([unpack(x, np.int64) for x in rows["copies"]]), len(own)).astype(np.int64)
    return out.assign(answer=_cut(low[inverse], lens), copies=_cut(copies[inverse] * 2 + first, lens))


class Known:
    """A block's sets with what the corpus says of its nodes."""

    def __init__(self, b: Block, answers: pd.DataFrame):
        s = self.sets = Sets(b)
        order = np.argsort(mix(s.node.view(np.uint64)))
        low, copies = joined(answers, 0, "answer", np.int64), joined(answers[answers["kind"] == 0], 0, "copies", np.int64)
        self.low, self.copies, self.speaks = np.empty(len(order), np.int64), np.empty(len(order), np.int64), np.empty(len(order), bool)
        self.low[order], self.copies[order], self.speaks[order] = low, copies >> 1, (copies & 1).astype(bool)


PARTS = "part string, block long, bucket int, depth binary, keys binary, nodes binary, sketches binary, low binary, copies binary, docs binary, has_id binary, words binary"


def word_hashes(b: Block, s: Sets) -> np.ndarray:
    """For each document the hash of its words as `words_hash` takes it of the text, one computation a node."""
    words = np.array(b.words, object)
    _, first = np.unique(s.of, return_index=True)
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[b.ids[b.starts[i] : b.starts[i + 1]]]).encode("utf-8", "surrogatepass"), 42) for i in first], np.uint64)
    return h[s.of] if len(s.of) else h


def members(b: Block, answers: pd.DataFrame, buckets: int, runs: int, branch: float, keyed: bool) -> pd.DataFrame:
    """Rows 'docs': the documents and their nodes; 'meet': nodes at buckets they share, with sketches; 'edge': links of
    nodes that share a path of full depth with more than LIMIT others of the block."""
    k = Known(b, answers)
    s = k.sets
    rows = [{"part": "docs", "block": b.block, "docs": pack(b.doc_ids), "has_id": pack(b.has_id), "nodes": pack(s.node[s.of]), "low": pack(k.low[s.of]), "copies": pack(k.copies[s.of]), "words": pack(word_hashes(b, s)) if keyed else None}]
    keys, nodes = s.chosen(runs)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first, rank = ranks(keys)
    sent = rank <= LIMIT
    count = joined(answers, 1, "answer", np.uint8)[(np.cumsum(sent) - 1)[first]] if len(keys) else np.zeros(0, np.uint8)
    count = np.repeat(count, np.diff(np.append(first, len(keys))))
    speaks = k.speaks[nodes] if len(nodes) else np.zeros(0, bool)
    some = speaks & (count > 1) & (count <= LIMIT)
    found = [(keys[some], nodes[some], np.ones(int(some.sum()), np.int8))]
    hot = speaks & (count > LIMIT)
    path, whose = keys[hot], nodes[hot]
    for depth in range(2, DEPTH + 1):
        path, whose = s.deeper(path, whose, branch)
        found.append((path, whose, np.full(len(path), depth, np.int8)))
    keys, nodes, depth = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((nodes, keys))
    keys, nodes, depth = keys[order], nodes[order], depth[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, depth = keys[new], nodes[new], depth[new]
    # Paths crowded in this block alone: at full depth one node goes on for all, before that longer paths do.
    first, rank = ranks(keys)
    size = np.repeat(np.diff(np.append(first, len(keys))), np.diff(np.append(first, len(keys))))
    crowd, last = size > LIMIT, depth == DEPTH
    speaker = nodes[np.repeat(first, np.diff(np.append(first, len(keys))))] if len(keys) else nodes
    local = crowd & last & (rank > 0)
    if local.any():
        rows.append({"part": "edge", "block": b.block, "nodes": pack(s.node[nodes[local]]), "docs": pack(s.node[speaker[local]])})
    depth = np.where(crowd & last, DEPTH + 1, depth).astype(np.int8)
    on = ~crowd | last & (rank == 0)
    keys, nodes, depth = keys[on], nodes[on], depth[on]
    cut, sketches = dealt(keys, buckets), s.sketches()
    # A node's sketch goes once to each bucket range it meets others in.
    for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
        if y > x:
            own, at = np.unique(nodes[x:y], return_inverse=True)
            rows.append({"part": "meet", "block": b.block, "bucket": i, "depth": pack(depth[x:y]), "keys": pack(keys[x:y]), "nodes": pack(s.node[own]), "docs": pack(at.astype(np.int32)), "sketches": pack(sketches[own].reshape(-1)), "low": pack(s.size[own])})
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")]).astype({"bucket": "Int32"})


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches agree as those of sets at the threshold do, within six standard deviations."""
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    return same >= SIMILAR * used - 6 * np.sqrt(SIMILAR * (1 - SIMILAR) * used)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix the smallest place it is connected with."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def met(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidate edges of the buckets of a range: a spanning forest of each bucket's likely pairs."""
    rows = rows.sort_values("block")
    keys = np.concatenate([unpack(x, np.uint64) for x in rows["keys"]])
    depth = np.concatenate([unpack(x, np.int8) for x in rows["depth"]])
    each = [unpack(x, np.int64) for x in rows["nodes"]]
    base = np.cumsum([0, *map(len, each)])
    who = np.concatenate([unpack(x, np.int32) + n for x, n in zip(rows["docs"], base, strict=False)])
    node = np.concatenate(each)
    sketch = np.concatenate([unpack(x, np.uint8) for x in rows["sketches"]]).reshape(-1, BINS)
    order = np.lexsort((node[who], keys))
    keys, depth, who = keys[order], depth[order], who[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (node[who[1:]] != node[who[:-1]])
    keys, depth, who = keys[new], depth[new], who[new]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    size = np.diff(np.concatenate([first, [len(keys)]]))
    hot = np.maximum.reduceat(depth, first) > DEPTH
    two = first[(size == 2) & ~hot]
    a, b = who[two], who[two + 1]
    yes = likely(sketch[a], sketch[b]) if len(a) else np.zeros(0, bool)
    left, right = [node[a[yes]]], [node[b[yes]]]
    more = hot | (size > 2)
    for f, n, full in zip(first[more], size[more], hot[more], strict=True):
        w = who[f : f + n]
        if n <= LIMIT and not full:
            label = forest(likely(sketch[w][:, None], sketch[w][None]))
            left.append(node[w])
            right.append(node[w[label]])
        elif full or depth[f] == DEPTH:
            left.append(node[w])
            right.append(np.full(n, node[w[0]]))
    pairs = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
    return pairs[pairs["a"] != pairs["b"]].drop_duplicates()


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Common shingles of each of the first ``left`` sets with every set: a product of 0/1 matrices over the shingles
    that occur twice or more, a stretch of them at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    own, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inverse]
    keep = column >= 0
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((left, len(sets)), np.float32)
    width = max(256, min(8192, 8_000_000 // len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[x:y], column[x:y] - at] = 1
        out += m[:left] @ m.T
    return out


LINKS = "node long, links long, root long, tiled boolean"


def verified(rows: pd.DataFrame) -> pd.DataFrame:
    """Exact links of the groups (or pairs of tiles) of a bin: links per node, and the smallest node reached."""
    out = []
    for (_, low, high), g in rows.groupby(["root", "low", "high"], sort=False):
        g = g.sort_values(["tile", "node"])
        sets = [unpack(x, np.uint64) for x in g["grams"]]
        size = np.array([len(x) for x in sets], np.float64)
        same = low == high
        left = len(sets) if same else int((g["tile"] == low).sum())
        if left == 0 or left == len(sets) and not same:
            continue
        common = overlaps(sets, left)
        union = size[:left, None] + size[None] - common
        linked = common >= SIMILAR * union - 1e-6
        if same:
            np.fill_diagonal(linked, False)
            full = linked
        else:
            linked[:, :left] = False
            full = np.zeros((len(sets), len(sets)), bool)
            full[:left] = linked
            full |= full.T
        node = g["node"].to_numpy()
        out.append(pd.DataFrame({"node": node, "links": full.sum(1), "root": node[forest(full)], "tiled": g["tiled"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"node": _EDGES, "links": _EDGES, "root": _EDGES, "tiled": np.array([], bool)})


SET = "root long, tile int, tiles int, node long, grams binary"


def dealt_out(sets: DataFrame, bins: int) -> DataFrame:
    """Each node's set once for every pair of tiles of its group, with what the exact comparison is grouped by: groups
    of one tile share the bins, of larger groups each pair of tiles is a group of its own."""
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = F.col("tiles") > 1
    return pairs.select(
        F.when(tiled, F.col("root")).alias("group"), F.when(tiled, -1).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).cast("int").alias("bin"),
        "root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "grams", tiled.alias("tiled"),
    )


def unpacked_edges(batches):
    for x in batches:
        for r in x.itertuples(index=False):
            yield pd.DataFrame({"a": unpack(r.nodes, np.int64), "b": unpack(r.docs, np.int64)})


def unpacked_nodes(batches):
    for x in batches:
        for r in x.itertuples(index=False):
            node, at = np.unique(unpack(r.nodes, np.int64), return_index=True)
            yield pd.DataFrame({"block": r.block, "node": node, "low": unpack(r.low, np.int64)[at]})


FOUND = "doc_id long, class_id long, text_class_id long, n_copies long, n_links long, first boolean, words long"


def told_documents(docs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block, given the classes of its nodes. first: the row decides for its class."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    if not len(docs):
        return pd.DataFrame(columns=names)
    r = next(docs.itertuples(index=False))
    ids, has, low = unpack(r.docs, np.int64), unpack(r.has_id, np.bool_), unpack(r.low, np.int64)
    nodes = nodes.sort_values("node")
    at = np.searchsorted(nodes["node"].to_numpy(), unpack(r.nodes, np.int64))
    top = nodes["class_low"].to_numpy()[at]
    first = nodes["first"].to_numpy()[at] & (ids == low)
    words = np.zeros(len(ids), np.int64) if r.words is None else unpack(r.words, np.uint64).view(np.int64)
    return pd.DataFrame({"doc_id": ids_out(ids, has), "class_id": ids_out(top, has | (top != NO_ID)), "text_class_id": ids_out(low, has | (low != NO_ID)), "n_copies": unpack(r.copies, np.int64), "n_links": nodes["n_links"].to_numpy()[at], "first": first, "words": words})[names]


def classified(docs: DataFrame, recall: float, keyed: bool) -> DataFrame:
    """FOUND of every document; words is 0 unless keyed."""
    runs = runs_for(recall)
    branch = branch_for(recall, runs, DEPTH)
    parts = blocks(docs)
    buckets = bucket_count(parts)
    asks = of_blocks(parts, lambda b: asked(b, buckets, runs), ASK)
    replies = staged(asks.groupBy("kind", "bucket").applyInPandas(counted, REPLY), "nodes")
    meet = staged(with_replies(parts, replies, lambda b, a: members(b, a, buckets, runs, branch, keyed), PARTS), "members")
    edges = meet.where("part = 'meet'").groupBy("bucket").applyInPandas(met, "a long, b long")
    edges = edges.unionByName(meet.where("part = 'edge'").select("nodes", "docs").mapInPandas(unpacked_edges, "a long, b long"))
    documents = parts.agg(F.sum("n_docs")).first()[0] or 0  # no table of nodes has more rows
    group = staged(sized(components(edges), documents), "groups")
    sizes = group.groupBy("root").agg(F.count("*").alias("n"))
    group = spread_join(group, sizes, "root", group.count(), sizes.agg(F.max("n")).first()[0] or 0).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))

    # A node is one row for each block that has it; the first of these speaks for it.
    flat = staged(meet.where("part = 'docs'").select("block", "nodes", "low").mapInPandas(unpacked_nodes, "block long, node long, low long"), "block-nodes")
    homes = staged(sized(flat.groupBy("node").agg(F.min("block").alias("block"), F.min("low").alias("low")), documents), "node-homes")
    told = group.join(homes, "node").groupBy("block").agg(F.collect_list(F.struct("node", "root", "tiles")).alias("of"))  # at most a block's documents
    told = told.select(F.lit(0).alias("kind"), "block", F.lit(0).alias("bucket"), "of")

    def send(b: Block, a: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a):
            s = Sets(b)
            for x in a["of"].iloc[0]:
                at = int(np.searchsorted(s.node, x["node"]))
                own = int(mix(np.array([x["node"]], np.int64).view(np.uint64))[0] % np.uint64(x["tiles"]))
                rows.append((x["root"], own, x["tiles"], x["node"], pack(s.grams[s.start[at] : s.start[at + 1]])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SET.split(", ")])

    sets = dealt_out(with_replies(parts, told, send, SET), max(16, -(-group.where("tiles = 1").count() // 1000)))
    links = staged(sets.groupBy("bin", "group", "low", "high").applyInPandas(verified, LINKS), "links")
    totals = links.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    # Groups in one piece are done; those in tiles are joined over their forests.
    over = components(links.where("tiled and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "joined")
    nodes = totals.join(over, "node", "left").select("node", "n_links", F.coalesce("joined", "root").alias("root"))
    nodes = homes.join(nodes, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    nodes = staged(sized(nodes, documents), "linked")
    classes = nodes.groupBy("root").agg(F.min(F.struct("low", "node")).alias("best"), F.count("*").alias("n"))
    joined_up = spread_join(nodes, classes, "root", nodes.count(), classes.agg(F.max("n")).first()[0] or 0)
    of_node = joined_up.select("node", F.col("best.low").alias("class_low"), (F.col("node") == F.col("best.node")).alias("first"), "n_links")
    of_block = flat.select("block", "node").join(of_node, "node")
    return meet.where("part = 'docs'").select("block", "docs", "has_id", "nodes", "low", "copies", "words").groupBy("block").cogroup(of_block.groupBy("block")).applyInPandas(told_documents, FOUND)


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, text_class_id, n_copies, n_links for every document."""
    with scratch(docs.sparkSession):
        return staged(classified(docs, recall, False).drop("first", "words"), "near-duplicates", keep=True)


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns it came with: of the rows with the smallest id (null: last) those of
    one text, and of rows that repeat both id and words one."""
    with scratch(docs.sparkSession):
        found = staged(classified(docs, RECALL, True).select("doc_id", "words", "first"), "classes", keep=True)
    kept = with_pairs(docs, found.where("not first").select("doc_id", "words").distinct(), "left_anti")
    again = found.where("first").groupBy("doc_id", "words").count().where("count > 1").select("doc_id", "words")
    if not again.isEmpty():
        hash_ = fresh(docs, "words")
        one = with_pairs(kept, again, "left_semi").withColumn(hash_, words_hash(F.col("text"))).dropDuplicates(["doc_id", hash_]).drop(hash_)
        kept = with_pairs(kept, again, "left_anti").unionByName(one)
    return kept

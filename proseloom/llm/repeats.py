"""Operators 5 and 10: passages of 50 words and more that repeat across documents.

Both find, for every window of 50 consecutive words, the smallest doc_id in which the same window starts; a word is
repeated if a window over it also starts in a document with a smaller id. Candidate search is by minimisers: among the
31 runs of 20 words in a window, the one with the smallest hash. Equal windows have equal minimisers, so

1. each block of documents asks which of its minimisers occur in more than one document (see tokens.py); a window
   whose minimiser is not repeated can't be. Minimisers of more than HOT occurrences would bring every document that
   merely starts or ends a common passage into one shard; their windows ask once more, by a hash of the whole window,
   and only those that may be in two documents go on;
2. the stretches of remaining windows that share a minimiser go to that minimiser's shard, equal ones of a block once.
   There a solver answers with the smallest doc_id of each window:
   - operator 10 (`fm_solver`): a compressed FM-index (fm.py) of first occurrences only. The stretches of the smallest
     document of each minimiser are indexed, all others are streamed through backward search; windows it doesn't find
     are first occurrences themselves and make the next, larger index, until none is left;
   - operator 5 (`suffix_solver`): a sparse suffix array of the suffixes at the minimisers, sorted; neighbours are
     compared and matches extended to the left and right, word by word.
   A window that all documents share is one entry a block in its shard.

Document ids decide by value; rows with equal ids are one document. A null id counts as the largest long and comes back
null; a null text has no words. Texts under 50 words have no window. Empty table: empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm
from .common import fresh, pack, scratch, staged, table, unpack, with_pairs, words_hash
from .tokens import Block, blocks, bucket_count, dealt, hashes, ids_out, joined, mix, of_blocks, with_replies

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1  # runs of GRAM words in a window
HOT = 1000
#: An odd multiplier and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any run of a sequence of 64-bit hashes, modulo 2^64."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(BASE, len(h))[: len(h)], dtype=np.uint64)])
        self.undo = powers(INVERSE, len(h))

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.undo[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return self.at(np.arange(max(0, n)), length)


def sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost minimum of each window of ``width``."""
    value, place, step = g, np.arange(len(g)), 1
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def lower(v, p, gap, count):
        left = v[:count] <= v[gap : gap + count]
        return np.where(left, v[:count], v[gap : gap + count]), np.where(left, p[:count], p[gap : gap + count])

    while 2 * step <= width:
        value, place = lower(value, place, step, len(value) - step)
        step *= 2
    return lower(value, place, width - step, n)[1]


class Windows:
    """The windows of a block that lie inside one document: their starts, minimisers, hashes."""

    def __init__(self, b: Block):
        self.hash = hashes(b.words)[b.ids] if len(b.ids) else np.zeros(0, np.uint64)
        second = mix(self.hash ^ np.uint64(0xD1B54A32D192ED03))
        self.rolling, self.other = Rolling(self.hash), Rolling(second)
        self.doc = b.docs()
        n = len(self.hash) - WINDOW + 1
        self.start = np.nonzero(self.doc[:n] == self.doc[WINDOW - 1 :])[0] if n > 0 else np.zeros(0, np.int64)
        grams = self.rolling.all(GRAM)
        self.minimiser = sliding_argmin(grams, SPAN)[self.start] if n > 0 else np.zeros(0, np.int64)
        self.place = np.unique(self.minimiser)  # ascending positions of selected runs
        # Mixed again: minima crowd at the low end of the hash range.
        self.key = mix(grams[self.place] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if len(self.place) else np.zeros(0, np.uint64)
        self.keys, self.slot = np.unique(self.key, return_inverse=True)
        ids = b.doc_ids[self.doc[self.place]] if len(self.place) else np.zeros(0, np.int64)
        self.low, self.high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.slot, ids)
        np.maximum.at(self.high, self.slot, ids)
        self.count = np.bincount(self.slot, minlength=len(self.keys))


ASK = "kind int, block long, bucket int, keys binary, low binary, high binary, count binary"
REPLY = "kind int, block long, bucket int, answer binary"


def asked(b: Block, buckets: int) -> list[dict]:
    w = Windows(b)
    cut = dealt(w.keys, buckets)
    return [{"kind": 0, "block": b.block, "bucket": i, "keys": pack(w.keys[s:e]), "low": pack(w.low[s:e]), "high": pack(w.high[s:e]), "count": pack(w.count[s:e].astype(np.int32))} for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]


def _cut(values: np.ndarray, lens: list[int]) -> list[bytes]:
    edge = np.cumsum([0, *lens])
    return [pack(values[s:e]) for s, e in zip(edge, edge[1:], strict=False)]


def shared(rows: pd.DataFrame) -> pd.DataFrame:
    """0: in one document only, 1: in more, 2: in more, and so often that its windows are to ask themselves."""
    keys = [unpack(k, np.uint64) for k in rows["keys"]]
    own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    low, high = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, np.concatenate([unpack(x, np.int64) for x in rows["low"]]))
    np.maximum.at(high, inverse, np.concatenate([unpack(x, np.int64) for x in rows["high"]]))
    count = np.bincount(inverse, np.concatenate([unpack(x, np.int32) for x in rows["count"]]), len(own))
    kind = int(rows["kind"].iloc[0])
    flag = np.where(low == high, 0, np.where((count > HOT) & (kind == 0), 2, 1)).astype(np.uint8)[inverse]
    return pd.DataFrame({"kind": kind, "block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "answer": _cut(flag, [len(k) for k in keys])})


class Asking:
    """The windows of a block whose minimiser is repeated; of those with a hot one, the distinct windows by hash."""

    def __init__(self, b: Block, answers: pd.DataFrame):
        w = self.windows = Windows(b)
        flag = joined(answers, 0, "answer", np.uint8)[w.slot] if len(w.place) else np.zeros(0, np.uint8)
        spot = np.searchsorted(w.place, w.minimiser)
        keep = flag[spot] > 0 if len(spot) else np.zeros(0, bool)
        self.start, self.mini, self.spot = w.start[keep], w.minimiser[keep], spot[keep]
        self.own = b.doc_ids[w.doc[self.start]] if len(self.start) else np.zeros(0, np.int64)
        self.hot = np.nonzero(flag[self.spot] == 2)[0] if len(self.spot) else np.zeros(0, np.int64)
        self.keys, self.slot = np.unique(w.rolling.at(self.start[self.hot], WINDOW), return_inverse=True)


def asked_again(b: Block, answers: pd.DataFrame, buckets: int) -> pd.DataFrame:
    a = Asking(b, answers)
    low, high = np.full(len(a.keys), np.iinfo(np.int64).max), np.full(len(a.keys), np.iinfo(np.int64).min)
    np.minimum.at(low, a.slot, a.own[a.hot])
    np.maximum.at(high, a.slot, a.own[a.hot])
    cut, once = dealt(a.keys, buckets), np.ones(len(a.keys), np.int32)
    rows = [(2, b.block, i, pack(a.keys[s:e]), pack(low[s:e]), pack(high[s:e]), pack(once[s:e])) for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ASK.split(", ")])


class Candidates:
    """What a block sends to the shards: distinct stretches by minimiser."""

    def __init__(self, b: Block, answers: pd.DataFrame, buckets: int):
        a = Asking(b, answers)
        w = self.windows = a.windows
        on = np.ones(len(a.start), bool)
        on[a.hot] = joined(answers, 2, "answer", np.uint8)[a.slot] > 0
        s, m, own, spot = a.start[on], a.mini[on], a.own[on], a.spot[on]
        self.start = s
        # Stretches of consecutive windows with one minimiser.
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1] + 1) | (m[1:] != m[:-1])
        first = np.nonzero(new)[0]
        count = np.diff(np.concatenate([first, [len(s)]]))
        begin, length = s[first], count + WINDOW - 1
        content = w.rolling.at(begin, length) ^ mix(length.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
        second = w.other.at(begin, length) if len(first) else np.zeros(0, np.uint64)
        order = np.lexsort((second, content))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (content[order][1:] != content[order][:-1]) | (second[order][1:] != second[order][:-1])
        slot = np.empty(len(order), np.int64)
        slot[order] = np.cumsum(fresh) - 1
        at = order[fresh]
        key = w.key[spot[first]][at] if len(first) else np.zeros(0, np.uint64)
        by_key = np.argsort(key, kind="stable")
        rank = np.empty(len(by_key), np.int64)
        rank[by_key] = np.arange(len(by_key))
        at = at[by_key]
        self.of, self.count = rank[slot], count
        self.begin, self.length = begin[at], length[at]
        self.offset = m[first][at] - self.begin
        self.doc = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(self.doc, self.of, own[first])
        self.bounds = dealt(key[by_key], buckets)


SENT = "kind int, block long, bucket int, words binary, ids binary, lens binary, offsets binary, docs binary"


def places(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin..begin+length-1 of each stretch, end to end."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def sent(b: Block, answers: pd.DataFrame, buckets: int) -> pd.DataFrame:
    c = Candidates(b, answers, buckets)
    rows = []
    for i, (s, e) in enumerate(zip(c.bounds, c.bounds[1:], strict=False)):
        if e > s:
            inside = places(c.begin[s:e], c.length[s:e])
            own, at, ids = np.unique(b.ids[inside], return_index=True, return_inverse=True)
            words = c.windows.hash[inside[at]]
            rows.append((1, b.block, i, pack(words), pack(ids.astype(np.int32)), pack(c.length[s:e].astype(np.int32)), pack(c.offset[s:e].astype(np.int32)), pack(c.doc[s:e])))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SENT.split(", ")])


def fm_solver(words: np.ndarray, lens: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest doc of each window of the stretches, by backward search in FM-indexes of first occurrences.

    Windows that are equal have one minimiser, so the smallest document of a minimiser holds first occurrences, and what
    is not found there is one itself. The n-th index holds, of each minimiser, the 4^n smallest stretches still open."""
    vocabulary, symbols = np.unique(words, return_inverse=True)
    symbols, sigma = symbols.astype(np.int32), len(vocabulary)
    starts = np.concatenate([[0], np.cumsum(lens)])
    gram = Rolling(words).at(starts[:-1] + offsets, GRAM)
    windows = lens - WINDOW + 1
    out_at = np.concatenate([[0], np.cumsum(windows)])
    out = np.full(out_at[-1], np.iinfo(np.int64).max)
    unsolved = np.ones(out_at[-1], bool)
    left, share = np.lexsort((docs, gram)), 1
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = gram[left][1:] != gram[left][:-1]
        first = np.nonzero(new)[0]
        rank = np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left))))
        chosen = left[rank < share]
        index = fm.Index(symbols[places(starts[chosen], lens[chosen])], lens[chosen], docs[chosen], sigma, WINDOW)
        # All that is open is streamed; alone in the first index, a stretch need not be looked for in itself.
        stream = left[rank >= share] if share == 1 else left
        if share == 1:
            at = places(out_at[chosen], windows[chosen])
            out[at], unsolved[at] = np.repeat(docs[chosen], windows[chosen]), False
        matched, least = index.matching(symbols[places(starts[stream], lens[stream])], lens[stream])
        at = places(out_at[stream], windows[stream])
        begin = places(np.cumsum(lens[stream]) - lens[stream], windows[stream])
        found = (matched[begin] == WINDOW) & unsolved[at]
        out[at[found]], unsolved[at[found]] = least[begin[found]], False
        some = np.zeros(len(lens), bool)
        some[np.repeat(np.arange(len(lens)), windows)[unsolved]] = True
        left, share = left[some[left]], share * 4
    return out


def suffix_solver(words: np.ndarray, lens: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The same by a sparse suffix array: the suffixes at the minimisers in order, neighbours' common prefixes, and
    for each number of words a that a window starts before the minimiser, the runs of neighbours that share the
    WINDOW - a words to the right, split by the a words to the left."""
    n, starts = len(lens), np.concatenate([[0], np.cumsum(lens)])
    symbols = np.unique(words, return_inverse=True)[1] + 1
    right, left = np.zeros((n, WINDOW), ">u4"), np.zeros((n, SPAN - 1), np.int32)
    for j in range(WINDOW):
        have = offsets + j < lens
        right[have, j] = symbols[starts[:-1][have] + offsets[have] + j]
    before = np.zeros(n, np.int64)
    for j in range(SPAN - 1):  # the numbers of the distinct j + 1 words to the left
        have = offsets > j
        word = np.zeros(n, np.int64)
        word[have] = symbols[starts[:-1][have] + offsets[have] - 1 - j]
        before = np.unique(before * (len(words) + 2) + word, return_inverse=True)[1]
        left[:, j] = before
    order = np.argsort(np.ascontiguousarray(right).view(f"V{4 * WINDOW}").reshape(-1), kind="stable")
    near = right[order]
    differs = near[1:] != near[:-1]
    common = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), WINDOW)]) if n else np.zeros(0, np.int64)
    windows = lens - WINDOW + 1
    out_at = np.concatenate([[0], np.cumsum(windows)])
    out = np.full(out_at[-1], np.iinfo(np.int64).max)
    for a in range(SPAN):
        run = np.cumsum(common < WINDOW - a)
        # Stretches with a window that starts a words before the minimiser.
        have = (offsets[order] >= a) & (offsets[order] - a < windows[order])
        if not have.any():
            continue
        member, run = order[have], run[have]
        side = left[member, a - 1] if a else np.zeros(len(member), np.int32)
        split = np.lexsort((side, run))
        new = np.ones(len(split), bool)
        new[1:] = (run[split][1:] != run[split][:-1]) | (side[split][1:] != side[split][:-1])
        group = np.cumsum(new) - 1
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, docs[member[split]])
        out[out_at[member[split]] + offsets[member[split]] - a] = least[group]
    return out


def answered(rows: pd.DataFrame, solver: Callable) -> pd.DataFrame:
    """The solver's answers to a shard's stretches, for the blocks that sent them. Stretches that several blocks sent
    are one."""
    rows = rows.sort_values("block")
    lens = [unpack(x, np.int32).astype(np.int64) for x in rows["lens"]]
    words = np.concatenate([unpack(w, np.uint64)[unpack(i, np.int32)] for w, i in zip(rows["words"], rows["ids"], strict=True)])
    length, offset, doc = np.concatenate(lens), np.concatenate([unpack(x, np.int32) for x in rows["offsets"]]).astype(np.int64), np.concatenate([unpack(d, np.int64) for d in rows["docs"]])
    start = np.concatenate([[0], np.cumsum(length)])[:-1]
    one, two = Rolling(words).at(start, length), Rolling(mix(words ^ np.uint64(0xD1B54A32D192ED03))).at(start, length)
    order = np.lexsort((offset, length, two, one))
    new = np.ones(len(order), bool)
    for x in (one, two, length, offset):
        new[1:] &= x[order][1:] == x[order][:-1]
    new[1:] = ~new[1:]
    slot = np.empty(len(order), np.int64)
    slot[order] = np.cumsum(new) - 1
    at = order[new]
    least = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(least, slot, doc)
    found = solver(words[places(start[at], length[at])], length[at], offset[at], least)
    out_at = np.concatenate([[0], np.cumsum(length[at] - WINDOW + 1)])[:-1]
    every = found[places(out_at[slot], length - WINDOW + 1)]
    return pd.DataFrame({"kind": 1, "block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "answer": _cut(every, [int((x - WINDOW + 1).sum()) for x in lens])})


class Found:
    """For each candidate window of a block the smallest doc_id in which it starts; repeated words and documents."""

    def __init__(self, b: Block, answers: pd.DataFrame, buckets: int):
        c = Candidates(b, answers, buckets)
        reply = joined(answers, 1, "answer", np.int64)
        at = np.concatenate([[0], np.cumsum(c.length - WINDOW + 1)])[c.of]
        least = reply[places(at, c.count)] if len(c.count) else np.zeros(0, np.int64)
        doc = c.windows.doc[c.start] if len(c.start) else np.zeros(0, np.int64)
        again = least < b.doc_ids[doc]
        self.start, self.least, self.doc = c.start[again], least[again], doc[again]
        edge = np.zeros(len(b.ids) + 1, np.int64)
        np.add.at(edge, self.start, 1)
        np.add.at(edge, self.start + WINDOW, -1)
        self.repeated = np.cumsum(edge)[:-1] > 0


def repeats(docs: DataFrame, solver: Callable, result: Callable[[Block, Found], pd.DataFrame], schema: str, buckets_of: int = 1_000_000) -> DataFrame:
    """result's rows for every block of documents, given the block's repeated windows."""
    parts = blocks(docs)
    buckets = bucket_count(parts, buckets_of)
    asks = of_blocks(parts, lambda b: asked(b, buckets), ASK)
    first = staged(asks.groupBy("kind", "bucket").applyInPandas(shared, REPLY), "minimisers")
    again = with_replies(parts, first, lambda b, a: asked_again(b, a, buckets), ASK)
    flags = first.unionByName(staged(again.groupBy("kind", "bucket").applyInPandas(shared, REPLY), "windows"))
    out = with_replies(parts, flags, lambda b, a: sent(b, a, buckets), SENT)
    answers = out.groupBy("bucket").applyInPandas(lambda rows: answered(rows, solver), REPLY)
    return with_replies(parts, flags.unionByName(answers), lambda b, a: result(b, Found(b, a, buckets)), schema)


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept(b: Block, f: Found) -> pd.DataFrame:
    words, rows = np.array(b.words, object), []
    for i in range(len(b.lens)):
        span = slice(b.starts[i], b.starts[i + 1])
        keep = ~f.repeated[span]
        text = " ".join(words[b.ids[span][keep]])
        rows.append((int(b.lens[i]), int(len(keep) - keep.sum()), hashlib.sha256(text.encode()).hexdigest()))
    out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
    out.insert(0, "doc_id", ids_out(b.doc_ids, b.has_id))
    return out


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return staged(repeats(table(spark, sf_dir, "documents"), fm_solver, kept, REMOVED), "kept", keep=True)


SPANS = "doc_id long, n_words long, n_repeated long, n_spans long, spans array<struct<start:long,length:long,first_doc_id:long>>"


def spans(b: Block, f: Found) -> pd.DataFrame:
    """Repeated stretches of each document, in words, with the smallest doc_id that one of their windows starts in."""
    edge = np.diff(np.concatenate([[0], f.repeated.astype(np.int8), [0]]))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    # A stretch that runs on into the next document is two.
    cuts = b.starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(f.repeated))]
    cuts = np.unique(cuts[f.repeated[cuts] & f.repeated[cuts - 1]]) if len(cuts) else cuts
    begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
    least = np.full(len(begin), np.iinfo(np.int64).max)
    np.minimum.at(least, np.searchsorted(begin, f.start, side="right") - 1, f.least)
    doc = np.searchsorted(b.starts, begin, side="right") - 1
    found: list[list[dict]] = [[] for _ in b.lens]
    for s, e, d, first in zip(begin, end, doc, least, strict=True):
        found[d].append({"start": int(s - b.starts[d]), "length": int(e - s), "first_doc_id": int(first)})
    total = [sum(x["length"] for x in one) for one in found]
    return pd.DataFrame({"doc_id": ids_out(b.doc_ids, b.has_id), "n_words": b.lens, "n_repeated": total, "n_spans": list(map(len, found)), "spans": found})


def op5_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's repeated stretches, listed as start:length:smallest id."""
    with scratch(spark):
        found = repeats(table(spark, sf_dir, "documents"), suffix_solver, spans, SPANS)
        listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["length"], s["first_doc_id"])), ";")
        return staged(found.withColumn("spans", listed), "spans", keep=True)


CUT = "doc_id long, was long, kept string, n_removed long"


def cleaned(docs: DataFrame, solver: Callable = fm_solver) -> DataFrame:
    """The documents with repeated words removed (kept words joined by one space; texts without any stay as they are)
    and the columns they came with; n_chars, if there, follows the text. Documents with nothing left are dropped."""

    def texts(b: Block, f: Found) -> pd.DataFrame:
        words, rows = np.array(b.words, object), []
        for i in range(len(b.lens)):
            span = slice(b.starts[i], b.starts[i + 1])
            gone = f.repeated[span]
            if gone.any():
                whole = xxhash.xxh64_intdigest(" ".join(words[b.ids[span]]).encode("utf-8", "surrogatepass"), 42)
                rows.append((whole - (1 << 64) if whole >> 63 else whole, " ".join(words[b.ids[span][~gone]]), int(gone.sum()), b.doc_ids[i], b.has_id[i]))
        out = pd.DataFrame(rows, columns=["was", "kept", "n_removed", "doc_id", "has_id"])
        out["doc_id"] = ids_out(out["doc_id"].to_numpy(np.int64), out["has_id"].to_numpy(bool))
        return out[["doc_id", "was", "kept", "n_removed"]]

    with scratch(docs.sparkSession):
        changed = staged(repeats(docs, solver, texts, CUT), "changed", keep=True)
    pairs = changed.select("doc_id", F.col("was").alias("words")).distinct()
    id_, was, kept = (fresh(docs, f"{c}_of_change") for c in ("doc_id", "was", "kept"))
    one = changed.groupBy(F.col("doc_id").alias(id_), F.col("was").alias(was)).agg(F.min("kept").alias(kept))
    touched = with_pairs(docs, pairs, "left_semi")  # only these texts move
    cut = touched.join(one, touched["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (words_hash(touched["text"]) == F.col(was))).where(F.col(kept) != "")
    columns = [F.col(kept).alias(c) if c == "text" else F.length(kept).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return with_pairs(docs, pairs, "left_anti").unionByName(cut.select(*columns))

"""Blocks of tokenised documents, and the exchange by which blocks ask the whole corpus about their keys.

A block is a bounded stretch of one input partition (about a million words): the documents' ids, lengths, word
numbers, and the block's own vocabulary, most frequent word first. A block sends each distinct key once to the bucket
that owns the key's range and gets one answer back for it, in the order sent. A key that occurs in a third of all rows
is thus one entry per block, nowhere a group of rows.

Null ids are ordered as NO_ID, the largest long, and come back as nulls; null texts have no words. The table of blocks
is bucketed by block, so that an exchange moves keys and answers only.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bucketed, keyed_texts, pack, squeeze, unpack, unsqueeze, worker_cache

WORDS_A_BLOCK, DOCS_A_BLOCK = 1_000_000, 100_000
NO_ID = np.iinfo(np.int64).max
BLOCK = "block long, n_words long, n_docs long, has_id binary, doc_ids binary, lens binary, ids binary, words binary"
_RUNS = re.compile(WORD)
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """The words of a text; str.split() does it where the text has no other white space it would split at."""
    return _RUNS.findall(text) if _ODD_SPACE.search(text) else text.split()


class Block:
    """The unpacked arrays of one block."""

    def __init__(self, row):
        self.block = int(row.block)
        self.has_id = unpack(row.has_id, np.bool_)
        self.doc_ids = unpack(row.doc_ids, np.int64)
        self.lens = unpack(row.lens, np.int32).astype(np.int64)
        self.ids = unpack(row.ids, np.int32)
        raw = unsqueeze(row.words).decode()
        self.words = raw.split("\n") if raw else []
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])

    def docs(self) -> np.ndarray:
        """For each word the place of its document in the block."""
        return np.repeat(np.arange(len(self.lens)), self.lens)


def hashes(words: list[str]) -> np.ndarray:
    f = xxhash.xxh64_intdigest
    return np.fromiter((f(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads them over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(docs: DataFrame) -> DataFrame:
    """The staged blocks of whole documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("blocks")
        part, seq = TaskContext.get().partitionId(), 0
        has, ids, lens, flat = [], [], [], array("i")
        seen: defaultdict = defaultdict()
        seen.default_factory = seen.__len__

        def row() -> pd.DataFrame:
            numbers = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(numbers, minlength=len(seen)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            names = list(seen)
            return pd.DataFrame([{"block": (part << 20) + seq, "n_words": len(numbers), "n_docs": len(ids), "has_id": pack(np.array(has, np.bool_)), "doc_ids": pack(np.array(ids, np.int64)), "lens": pack(np.array(lens, np.int32)), "ids": pack(rank[numbers]), "words": squeeze("\n".join([names[i] for i in order]).encode("utf-8", "surrogatepass"))}])

        for b in batches:
            for known, doc_id, text in zip(b["has_id"].tolist(), b["doc_id"].tolist(), b["text"], strict=True):
                words = words_of(text)
                has.append(known)
                ids.append(doc_id if known else NO_ID)
                lens.append(len(words))
                flat.extend(map(seen.__getitem__, words))
                if len(flat) >= WORDS_A_BLOCK or len(ids) >= DOCS_A_BLOCK:
                    yield row()
                    has, ids, lens, flat, seq = [], [], [], array("i"), seq + 1
                    seen.clear()
        if ids:
            yield row()

    return bucketed(keyed_texts(docs).mapInPandas(run, BLOCK), "blocks", "block")


def bucket_count(block_table: DataFrame, words_each: int = 1_000_000) -> int:
    """So many buckets that each holds about as many words whatever the size of the corpus."""
    total = block_table.agg(F.sum("n_words")).first()[0] or 0
    return max(16, -(-total // words_each))


def dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets' ranges in sorted 64-bit keys: bucket i has keys[bounds[i]:bounds[i + 1]]."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def of_blocks(block_table: DataFrame, f: Callable[[Block], list[dict]], schema: str) -> DataFrame:
    """f's rows for each block, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("blocks")
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for row in b.itertuples(index=False):
                yield pd.DataFrame(f(Block(row)), columns=names)

    return block_table.mapInPandas(run, schema)


def with_replies(block_table: DataFrame, replies: DataFrame, f: Callable[[Block, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of each block and the replies addressed to it, in the order of their buckets."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(block):
            return pd.DataFrame(columns=names)
        return f(Block(next(block.itertuples(index=False))), answers.sort_values(["kind", "bucket"], kind="stable"))

    return block_table.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)


def joined(answers: pd.DataFrame, kind: int, column: str, dtype) -> np.ndarray:
    found = [unpack(x, dtype) for x in answers.loc[answers["kind"] == kind, column]]
    return np.concatenate([*found, np.zeros(0, dtype)])


def ids_out(values, has: np.ndarray) -> pd.Series:
    """Ids, null where ``has`` is false."""
    return pd.Series(pd.arrays.IntegerArray(np.asarray(values, np.int64), ~np.asarray(has, bool)))

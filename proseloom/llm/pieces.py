"""Operator 9: SentencePiece encoding and decoding with an Aho-Corasick automaton and dynamic programming.

The automaton over all pieces reads a text once. At each position it follows the output links to every piece that ends
there and relaxes the best way to reach it:

* unigram models: the best sum of scores (Viterbi). A character without a piece of its own costs the lowest score minus
  10 and is spelt in byte pieces. Ties keep the longer last piece.
* BPE models: their scores are merge ranks, which don't add up. A way is right exactly if merging would leave each two
  neighbouring pieces apart, which their merge trees tell (`Merges.apart`); a position has just one such last piece.
  Pieces that are nothing but space marks share the worst rank of all, so what a run of marks becomes is decided after
  all else, from the left: the pass leaves them single, and one rule joins runs of any length (`Pieces.run`).

Either way the ids are those of the library for the same model file (tests hold them together). Normalisation is the
model's. Where no piece crosses from a character into a space mark, as in the given file, words met before are taken
from a bounded store. ``lossless`` spells mark characters (U+2581) of the text in bytes, so that decoding gives every text
back; the library's way they come back as spaces.

Nulls and empty texts: no pieces; null ids decode to a null text. Repeated rows are encoded again. An empty table gives
an empty result. Extra columns are ignored. Models that are neither kind, lack byte pieces or hold user-defined symbols
are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, table, with_nulls, worker_cache

MARK = "▁"
UNIGRAM, BPE = 1, 2
PENALTY = 10.0


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            x = raw[at]
            at, n, shift = at + 1, n | (x & 127) << shift, shift + 7
            if x < 128:
                return n

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, raw[at : at + size]
        at += size


class Merges:
    """Merge trees of the pieces of a BPE model. Numbers stand for pieces; characters without one get further numbers."""

    def __init__(self, rank: dict[str, int], number: dict[str, int]):
        self.number = dict(number)
        for piece in rank:
            for c in piece:
                self.number.setdefault(c, len(self.number) + 1_000_000)
        self.rank: dict[int, int] = {n: -1 for p, n in self.number.items() if len(p) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.seen: dict[int, bool] = {}  # by both numbers, 22 bits each
        for piece in sorted((p for p in rank if len(p) > 1), key=rank.__getitem__):
            own = self.number[piece]
            for cut in range(1, len(piece)):
                a, b = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if a in self.rank and b in self.rank and self._stay(a, b):
                    self.halves[own] = a, b
                    self.pair[a, b] = self.rank[own] = rank[piece]
                    break

    def _stay(self, x: int, y: int) -> bool:
        """Down the right edge of x's tree and the left edge of y's, from what was merged last to the characters: no two
        that lie side by side at a time are merged before either is merged into its own tree."""
        rank, pair, halves = self.rank, self.pair, self.halves
        into_x = into_y = float("inf")
        while True:
            m = pair.get((x, y))
            if m is not None and m < into_x and m <= into_y:
                return False
            if rank[x] > rank[y]:
                into_x, x = rank[x], halves[x][1]
            elif rank[y] >= 0:
                into_y, y = rank[y], halves[y][0]
            else:
                return True

    def apart(self, a: int, b: int) -> bool:
        """Whether the pieces a and b, side by side, are what merging leaves of their text."""
        found = self.seen.get(a << 22 | b)
        if found is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            found = self.seen[a << 22 | b] = self._stay(a, b)
        return found


class Pieces:
    def __init__(self, path: str | None = None, keep: int = 400_000, proto: bytes | None = None):
        import ahocorasick
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
        parts = dict(fields(sp.serialized_model_proto()))
        self.kind = dict(fields(parts[2])).get(3, UNIGRAM)
        rules = dict(fields(parts[3]))
        #: Only a space in front and marks for spaces: no need to ask the library.
        self.simple = not rules.get(2) and rules.get(3, 1) == 1 and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are known")
        self.keep, self.known, self.bytes = keep, {}, {}
        self.text: list[bytes] = []
        self.splits, score, number = True, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(MARK, " ").encode())
                number[piece], score[piece] = i, sp.get_score(i)
                self.splits &= MARK not in piece.lstrip(MARK)
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces, so not every text could be decoded")
        if any(kind == 4 for kind in (dict(fields(v)).get(3) for f, v in fields(sp.serialized_model_proto()) if f == 1)):
            raise ValueError("the model has user-defined symbols")
        self.automaton = ahocorasick.Automaton()
        self.runs: dict[int, int] = {}
        if self.kind == BPE:
            rank = {p: -s for p, s in score.items()}
            runs = [p for p in rank if len(p) > 1 and not p.strip(MARK)]
            if runs:
                if {rank.pop(p) for p in runs} != {max(-s for s in score.values())} or MARK not in rank or any(p.startswith(MARK + MARK) for p in rank):
                    raise ValueError("runs of space marks are no pieces of their own, worst rank")
                self.runs = {len(p): number[p] for p in runs} | {1: number[MARK]}
            self.merges = Merges(rank, {p: n for p, n in number.items() if p in rank})
            for piece, n in self.merges.number.items():
                if n in self.merges.rank:
                    self.automaton.add_word(piece, (len(piece), n))
        else:
            for piece, n in number.items():
                self.automaton.add_word(piece, (len(piece), n, score[piece]))
        self.unknown = min(score.values(), default=0.0) - PENALTY
        self.automaton.make_automaton()
        self.size = sp.get_piece_size()
        #: A word with the marks before it.
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.splits else re.compile("(?s).+")

    def _spelt(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]

    def _path(self, text: str, back: list) -> list[int]:
        path, n = [], len(text)
        while n:
            start, i = back[n]
            path += [i] if 0 <= i < self.size else self._spelt(text[start:n])[::-1]
            n = start
        return path[::-1]

    def viterbi(self, text: str) -> list[int]:
        """The path of the highest score; text has marks for spaces."""
        n = len(text)
        score = [0.0] + [float("-inf")] * n
        back: list = [None] * (n + 1)
        at = 0  # positions up to here are final

        def settle(to: int) -> None:
            """Characters at whose place no piece of one character starts may be unknown."""
            nonlocal at
            while at < to:
                at += 1
                if not single[at - 1] and score[at - 1] + self.unknown > score[at]:
                    score[at], back[at] = score[at - 1] + self.unknown, (at - 1, -1)

        single = bytearray(n)
        for end, (length, i, gain) in self.automaton.iter(text):
            settle(end)
            start = end + 1 - length
            if length == 1:
                single[end] = 1
            new = score[start] + gain
            if new > score[end + 1]:
                score[end + 1], back[end + 1] = new, (start, i)
        settle(n)
        return self._path(text, back)

    def merged(self, text: str) -> list[int]:
        """What merging leaves of a text with marks for spaces."""
        n = len(text)
        #: The piece that ends at a position (None: not reached, -1: the start or an unknown character) and where it starts.
        last: list = [None] * (n + 1)
        back = [0] * (n + 1)
        last[0], at = -1, 0  # positions up to ``at`` are final
        seen, apart = self.merges.seen, self.merges.apart
        for end, (length, i) in self.automaton.iter(text):
            if last[end + 1] is not None:
                continue
            while at < end:
                at += 1
                if last[at] is None and last[at - 1] is not None:
                    last[at], back[at] = -1, at - 1
            start = end + 1 - length
            left = last[start]
            if left is None:
                continue
            if left >= 0:
                stay = seen.get(left << 22 | i)
                if not (apart(left, i) if stay is None else stay):
                    continue
            last[end + 1], back[end + 1] = i, start
        while at < n:
            at += 1
            if last[at] is None and last[at - 1] is not None:
                last[at], back[at] = -1, at - 1
        path, end = [], n
        while end:
            i, start = last[end], back[end]
            path += [i] if 0 <= i < self.size else self._spelt(text[start:end])[::-1]
            end = start
        path.reverse()
        if not self.runs or MARK + MARK not in text:
            return path
        return [i for one, same in groupby(path, self.runs[1].__eq__) for i in (self.run(sum(1 for _ in same)) if one else same)]

    def run(self, marks: int) -> list[int]:
        """The pieces of a run of marks: of two neighbours that make a piece the leftmost are joined first."""
        lens: list[int] = []
        for _ in range(marks):
            lens.append(1)
            while len(lens) > 1 and lens[-2] + lens[-1] in self.runs:
                lens[-2:] = [lens[-2] + lens[-1]]
        return [self.runs[n] for n in lens]

    def _ids(self, word: str) -> bytes:
        ids = self.merged(word) if self.kind == BPE else self.viterbi(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str, lossless: bool = False) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if lossless and not self.simple:
            raise ValueError("the model's normalisation changes texts")
        if lossless and MARK in text:
            runs = (" " + text).split(MARK)
            spelt = np.array(self._spelt(MARK), "<u4").tobytes()
            return spelt.join(self._words(r.replace(" ", MARK)) for r in runs)
        return self._words((" " + text).replace(" ", MARK) if self.simple else self.library.normalize(text))

    def _words(self, text: str) -> bytes:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        out = []
        for w in self.words.findall(text):
            if (got := known.get(w)) is None:
                got = known[w] = self._ids(w)
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def pieces(path: str | None) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    read = worker_cache("pieces")
    if path not in read:
        read[path] = Pieces(path)
    return read[path]


def encode(docs: DataFrame, path: str | None = None, lossless: bool = False) -> DataFrame:
    """doc_id, ids: the encoded texts as an array of int."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                some = b.iloc[at : at + 512]
                yield some[["has_id", "doc_id"]].assign(ids=[np.frombuffer(pieces(path).encode(t, lossless), "<i4") for t in some["text"]])

    return with_nulls(keyed_texts(docs).mapInPandas(run, "has_id boolean, doc_id long, ids array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["has_id", "doc_id"]].assign(text=[None if i is None else pieces(path).decode(np.asarray(i, "<u4").tobytes()) for i in b["ids"]])

    keyed = encoded.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "ids")
    return with_nulls(keyed.mapInPandas(run, "has_id boolean, doc_id long, text string"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, exact: each text encoded and decoded again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        fallback = np.array(sorted(p.bytes.values()))
        for b in batches:
            rows = []
            for has, doc_id, text in zip(b["has_id"].tolist(), b["doc_id"].tolist(), b["text"], strict=True):
                ids = p.encode(text)
                back, some = p.decode(ids), np.frombuffer(ids, "<u4")
                rows.append((has, doc_id, len(some), int(((some >= fallback[0]) & (some <= fallback[-1])).sum()), zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            yield pd.DataFrame(rows, columns=["has_id", "doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "exact"])

    return with_nulls(keyed_texts(docs).mapInPandas(run, "has_id boolean, doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

"""Operator 8: bounded-space online packing of token documents into sequences of 2,048.

Every partition keeps a fixed number of open windows. A document is cut into full windows plus a tail; the tail goes
into the open window it fits best. If none fits, the fullest window is filled up with the head of the tail and emitted,
and the rest is placed again, so only windows that are left open at the end carry padding. These leftovers are merged,
by groups of partitions: they are split again into pieces and placed by the same rule. Groups have a fixed number of
partitions, hence a bounded number of windows, and end with one padded sequence each.

A document that would fit a window whole stays whole unless no open window has room for it.

Nulls and empty texts: the end id alone. A null doc_id stays null. Repeated rows are packed again. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, staged, table, with_nulls, worker_cache

LENGTH, OPEN, END, GROUP = 2048, 64, 1, 16
PIECE = "has_id boolean, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: str.split() also splits at U+001C to U+001F, which are no white space to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# What a tokenizer file must say of white space and splitting for words to be encoded one by one.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words whose parts that rule gives can be told without Unicode tables: printable ASCII and Latin-1 letters.
_PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Kept(dict):
    """Values made once for each key."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


class Coder:
    """Ids of a text by the tokenizer file. Where the file's rules drop white space and split words by the rule above,
    words are encoded one by one and kept up to a bound; new words are put together from their parts, which go to the
    file's model without its rules. Any other file encodes whole texts."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            (rules.get("normalizer") or {}).get("normalizers") == _NORMAL and steps[0].get("pattern") == {"Regex": _SPLIT} and rules["model"].get("type") == "BPE"
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True) and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("use_regex")
        )
        self.special = [t["content"] for t in rules.get("added_tokens") or []]
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: spelt.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.model = self.tokenizer.model
        self.words, self.parts = Kept(self._word), Kept(self._part)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<" in word and any(t in word for t in self.special):
            return self._whole([word])[0]
        parts = _PARTS.findall(word.lower())
        return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self._whole(texts)
        for kept in (self.words, self.parts):
            if len(kept) > self.keep:
                kept.clear()
        known = self.words.__getitem__
        return [b"".join(map(known, _SPACE.split(t) if _ODD.search(t) else t.split())) for t in texts]


def coder(path: str) -> Coder:
    coders = worker_cache("packing")
    if path not in coders:
        coders[path] = Coder(path)
    return coders[path]


class Windows:
    """The open windows of one partition: room left, best fit, the fullest."""

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next = size, limit, first_id
        self.used: list[int] = []
        self.ids: list[int] = []
        self.done: list[tuple[int, int]] = []

    def _open(self) -> int:
        self.used.append(0)
        self.ids.append(self.next)
        self.next += 1
        return len(self.used) - 1

    def _close(self, w: int) -> None:
        self.done.append((self.ids[w], self.used[w]))
        for column in (self.used, self.ids):
            column[w] = column[-1]
            column.pop()

    def place(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Yields (sequence_id, offset, length) of the cuts of a piece of n ids, in order."""
        while n >= self.size:
            yield self.next, 0, self.size
            self.next += 1
            n -= self.size
        while n:
            fit = max((i for i in range(len(self.used)) if self.used[i] + n <= self.size), key=self.used.__getitem__, default=-1)
            if fit < 0 and len(self.used) < self.limit:
                fit = self._open()
            take = n
            if fit < 0:
                fit = max(range(len(self.used)), key=self.used.__getitem__)
                take = self.size - self.used[fit]
            yield self.ids[fit], self.used[fit], take
            self.used[fit] += take
            n -= take
            if self.used[fit] == self.size:
                self._close(fit)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, windows: int = OPEN, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    tail = np.array([end], "<u4").tobytes()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        w = Windows(length, windows, part << 40)
        held: dict[int, list[tuple]] = {}  # pieces in windows that are still open
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                out = []
                for has, doc_id, ids in zip(some["has_id"].tolist(), some["doc_id"].tolist(), coder(path).encode(some["text"].tolist()), strict=True):
                    ids += tail
                    _put(w, held, out, (has, doc_id, 0, len(ids) // 4, ids))
                yield _frame(out, -1)
        yield _frame([r for rows in held.values() for r in rows], part // group, True)

    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        w = Windows(length, windows, (1 << 62) + (int(key[0]) << 40))
        held: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        for r in left.sort_values(["sequence_id", "offset"]).itertuples(index=False):  # a fixed order
            _put(w, held, out, (r.has_id, r.doc_id, r.start, r.doc_tokens, r.ids))
        # What is open now is joined end to end; only the last sequence is padded.
        seq, used = w.next, 0
        for has, doc_id, start, _, _, total, _, _, ids in (r for rows in held.values() for r in rows):
            at = 0
            while at < len(ids) // 4:
                n = min(length - used, len(ids) // 4 - at)
                cut = ids[4 * at : 4 * (at + n)]
                out.append((has, doc_id, start + at, n, zlib.crc32(cut), total, seq, used, cut))
                at, used = at + n, used + n
                if used == length:
                    seq, used = seq + 1, 0
        return _frame(out, -1)[["has_id", *COLUMNS]]

    pieces = staged(keyed_texts(docs).mapInPandas(first, PIECE + ", left int, ids binary"), "packed")
    merged = pieces.where("left >= 0").groupBy("left").applyInPandas(merge, PIECE)
    return with_nulls(pieces.where("left < 0").select("has_id", *COLUMNS).unionByName(merged))


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _put(w: Windows, held: dict[int, list[tuple]], out: list[tuple], piece: tuple) -> None:
    """Place a piece (has_id, doc_id, start, tokens of its document, ids); finished windows go to out."""
    has, doc_id, start, total, ids = piece
    count, at = len(ids) // 4, 0
    total = total if total else count
    for seq, offset, n in w.place(count):
        cut = ids[4 * at : 4 * (at + n)]
        row = (has, doc_id, start + at, n, zlib.crc32(cut), total, seq, offset, cut)
        at += n
        if n == w.size:
            out.append(row)
        else:
            held.setdefault(seq, []).append(row)
    for seq, _ in w.done:
        out += held.pop(seq)
    w.done.clear()


def _frame(rows: list[tuple], left: int, with_ids: bool = False) -> pd.DataFrame:
    out = pd.DataFrame([r[:8] for r in rows], columns=["has_id", *COLUMNS])
    out["left"] = left
    out["ids"] = [r[8] for r in rows] if with_ids else None
    return out


def op8_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

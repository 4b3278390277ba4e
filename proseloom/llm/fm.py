"""A compressed FM-index over words: the Burrows-Wheeler transform in a wavelet matrix of packed bits, common prefixes in
bytes, and a document mark for each run of equal windows. Backward search gives matching statistics.

All searches run for many texts at once, one lane each."""

from __future__ import annotations

import numpy as np

LANES = 20_000


class Bits:
    """A packed bit vector with ranks: one 64-bit word and one running count for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit i, and the ones before it."""
        w, shift = i >> 6, (i & 63).astype(np.uint64)
        word = self.words[w]
        return (word >> shift & np.uint64(1)).astype(bool), self.before[w] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the top bit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, current = [], sequence
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = current >> shift & 1 != 0
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            current = np.concatenate([current[~bit], current[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = c >> shift & 1 != 0
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def take(self, c: np.ndarray, i: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether symbol i is c, and if so where the matrix ends with it (``first``: where c's own begin there)."""
        same = np.ones(len(i), bool)
        for shift, bits, zeros in self.levels:
            one = c >> shift & 1 != 0
            bit, before = bits.at(i)
            same &= bit == one
            i = np.where(bit, zeros + before, i - before)
        return same, i - first

    def starts(self, symbols: int) -> np.ndarray:
        """Where each symbol's occurrences begin after the last level."""
        c = np.arange(symbols)
        at = np.zeros(symbols, np.int64)
        for shift, bits, zeros in self.levels:
            before = bits.ones(at)
            at = np.where(c >> shift & 1 != 0, zeros + before, at - before)
        return at


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes by their first ``depth`` symbols or more, by prefix doubling, and the ranks by 1, 2, 4, ... symbols."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
    ranks, order = [rank], np.argsort(rank, kind="stable")
    while step < depth:
        key = rank.astype(np.int64) * (n + 1)
        key[: max(0, n - step)] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int32)
        np.cumsum(key[order][1:] != key[order][:-1], out=new[1:])
        rank = np.empty(n, np.int32)
        rank[order] = new
        ranks.append(rank)
        step *= 2
        if n == 0 or new[-1] == n - 1:
            break
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], most: int) -> np.ndarray:
    """For each place of the suffix array the symbols its suffix shares with the one before, ``most`` at most; 0 first
    and after the last."""
    n = len(order)
    out = np.zeros(n + 1, np.uint8)
    if n > 1:
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        shared = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            i, j = a + shared, b + shared
            inside = (i < n) & (j < n)
            same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
            # A rank by 2^k symbols is shared by suffixes that end sooner only where they are one suffix.
            shared += np.where(same, 1 << k, 0)
        out[1:n] = np.minimum(shared, most)
    return out


class Index:
    """Over texts of symbols 0..symbols-1; each is closed by a separator of its own, below all symbols. ``marks``: a
    number for each text; ``length``: that of the windows which are looked for."""

    def __init__(self, texts: np.ndarray, lens: np.ndarray, marks: np.ndarray, symbols: int, length: int):
        count, self.length, self.symbols = len(lens), length, symbols
        size = len(texts) + count
        joined = np.empty(size, np.int32)
        closing = np.cumsum(lens) + np.arange(count)
        inside = np.ones(size, bool)
        inside[closing] = False
        joined[inside] = texts + 1
        joined[closing] = np.arange(-count, 0)  # each its own while suffixes are sorted
        order, ranks = sorted_suffixes(joined, length)
        self.size = size
        self.common = common_prefixes(order, ranks, length)
        del ranks
        joined[closing] = 0  # and one symbol for the transform
        before = joined[order - 1]
        sigma = symbols + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=sigma))])
        self.wavelet = WaveletMatrix(before, sigma)
        self.ends = self.wavelet.starts(sigma)
        self.least = self._least(np.repeat(marks, lens + 1)[order], length)
        # Runs of suffixes that share all but the last symbol of a window.
        bound = np.nonzero(self.common < length - 1)[0]
        bound = bound[bound < size]
        which = np.zeros(size, np.int32)
        which[bound[1:]] = 1
        self.wider = np.cumsum(which, dtype=np.int32)
        self.bounds = np.append(bound, size).astype(np.int32)
        self.deep: list[np.ndarray] = []

    def _least(self, marks: np.ndarray, length: int) -> np.ndarray:
        """The smallest mark in each run of suffixes that share ``length`` symbols, at the run's first place."""
        bound = np.nonzero(self.common[:-1] < length)[0]
        out = np.zeros(self.size, marks.dtype)
        if len(bound):
            out[bound] = np.minimum.reduceat(marks, bound)
        return out

    def widened(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` symbols of what the given intervals match."""
        if not self.deep:  # minima of 1, 2, 4, ... common prefixes
            self.deep.append(self.common)
            while 2 << len(self.deep) - 1 <= len(self.common):
                half = self.deep[-1]
                gap = 1 << len(self.deep) - 1
                self.deep.append(np.minimum(half[:-gap], half[gap:]))
        low, high = low.copy(), high.copy()
        for k in range(len(self.deep) - 1, -1, -1):
            m, width = self.deep[k], 1 << k
            at = low - width + 1
            low -= np.where((at >= 0) & (m[np.maximum(at, 0)] >= depth), width, 0)
            on = (high + width <= len(self.common)) & (m[np.minimum(high, len(m) - 1)] >= depth)
            high += np.where(on, width, 0)
        return low, high

    def back(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of c followed by what the given intervals match."""
        out_low, out_high = np.empty_like(low), np.empty_like(high)
        one = high - low == 1
        at, many = np.nonzero(one)[0], np.nonzero(~one)[0]
        same, place = self.wavelet.take(c[at], low[at], self.ends[c[at]])
        out_low[at] = self.first[c[at]] + place
        out_high[at] = out_low[at] + same
        both = self.wavelet.rank(np.concatenate([c[many], c[many]]), np.concatenate([low[many], high[many]]))
        start = self.first[c[many]]
        out_low[many], out_high[many] = start + both[: len(many)], start + both[len(many) :]
        return out_low, out_high

    def matching(self, texts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed texts (a symbol outside 0..symbols-1 matches nothing): for each place the
        length, up to the window's, of the longest match that begins there, and for whole windows the least mark among
        the indexed texts that hold it."""
        starts = np.cumsum(lens) - lens
        length, mark = np.zeros(len(texts), np.uint8), np.zeros(len(texts), self.least.dtype)
        for at in range(0, len(lens), LANES):
            self._lanes(texts, starts[at : at + LANES], lens[at : at + LANES], length, mark)
        return length, mark

    def _lanes(self, texts: np.ndarray, start: np.ndarray, lens: np.ndarray, length: np.ndarray, mark: np.ndarray) -> None:
        some = np.nonzero(lens)[0]
        place, begin = (start + lens - 1)[some], start[some]
        low, high = np.zeros(len(some), np.int64), np.full(len(some), self.size, np.int64)
        matched = np.zeros(len(some), np.int64)
        while len(place):
            c = texts[place]
            known = (c >= 0) & (c < self.symbols)
            c = np.where(known, c, 0) + 1
            # A match of full length drops its last symbol before it grows to the left.
            full = np.nonzero(matched == self.length)[0]
            if len(full):
                run = self.wider[low[full]]
                low[full], high[full] = self.bounds[run], self.bounds[run + 1]
                matched[full] = self.length - 1
            new_low, new_high = self.back(c, low, high)
            good = known & (new_low < new_high)
            grown = np.nonzero(good)[0]
            low[grown], high[grown] = new_low[grown], new_high[grown]
            matched[grown] += 1
            length[place[grown]] = matched[grown]
            whole = grown[matched[grown] == self.length]
            mark[place[whole]] = self.least[low[whole]]
            lost = np.nonzero(~good & known & (matched > 0))[0]
            if len(lost):  # the longest shorter match that has other symbols to its left
                depth = np.maximum(self.common[low[lost]], self.common[high[lost]]).astype(np.int64)
                a, b = self.widened(low[lost], high[lost], np.maximum(depth, 1))
                none = depth == 0
                low[lost], high[lost] = np.where(none, 0, a), np.where(none, self.size, b)
                matched[lost] = depth
            gone = np.nonzero(~known)[0]
            low[gone], high[gone], matched[gone] = 0, self.size, 0
            again = np.zeros(len(place), bool)
            again[lost] = True
            place = np.where(again, place, place - 1)
            on = place >= begin
            if not on.all():
                place, begin, low, high, matched = place[on], begin[on], low[on], high[on], matched[on]

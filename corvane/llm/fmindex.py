"""FM-index over a sequence of small integers: suffix order, wavelet matrix, backward search, sampled locate.

0 separates runs. Suffixes are compared up to their next separator and then by position, so a search never runs
over a separator; positions right behind separators are always sampled, so that locating never has to step over
one either.
"""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray, bits: int) -> np.ndarray:
    """Positions of ``seq`` in suffix order, by prefix doubling over packed first symbols."""
    n = seq.size
    width = max(1, 60 // bits)
    padded = np.concatenate((seq.astype(np.int64), np.zeros(width, dtype=np.int64)))
    key, live = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(width):
        part = padded[j : j + n]
        live &= part > 0
        key = (key << bits) | np.where(live, part, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.empty(n, dtype=bool)
    head[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=head[1:])
    ended = ~live[order]
    slot = np.arange(n)
    group = np.maximum.accumulate(np.where(head, slot, 0))
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = head[1:]
    open_ = ~ended & ~(head & last)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.where(open_, group, slot)
    slots = slot[open_]
    h = width
    while slots.size:
        at = order[slots]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + h, n - 1)]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        head = np.empty(slots.size, dtype=bool)
        head[0] = True
        np.not_equal(pair[1:], pair[:-1], out=head[1:])
        last = np.empty(slots.size, dtype=bool)
        last[-1] = True
        last[:-1] = head[1:]
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[~(head & last)]
        h *= 2
    return order


class WaveletMatrix:
    """Rank and access over integers below 2**bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, n = bits, seq.size
        self.ones = np.zeros((bits, n + 1), dtype=np.int32)
        self.zeros = np.zeros(bits, dtype=np.int64)
        cur = seq
        for level in range(bits):
            bit = (cur >> (bits - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, -1]
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        symbols = np.arange(1 << bits)
        self.start = self._walk(symbols, np.zeros(symbols.size, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.ones[level][at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before at."""
        return self._walk(symbol, at) - self.start[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places and how often each occurs before."""
        symbol = np.zeros(at.size, dtype=np.int64)
        for level in range(self.bits):
            ones = self.ones[level][at]
            bit = self.ones[level][at + 1] - ones
            symbol = (symbol << 1) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    """``seq``: integers from 1 to 2**bits - 1, with 0 between runs and at the end."""

    def __init__(self, seq: np.ndarray, bits: int, sample: int = 8):
        order = suffix_order(seq, bits)
        before = np.concatenate((seq[-1:], seq[:-1])).astype(np.int64)  # seq ends with 0
        self.wavelet = WaveletMatrix(before[order], bits)
        counts = np.bincount(seq, minlength=1 << bits)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.n = seq.size
        sampled = (order % sample == 0) | (before[order] == 0)
        self.sampled = sampled
        self.nth = np.concatenate(([0], np.cumsum(sampled)))
        self.places = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of ``phrases``."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            a, b = self.first[c] + self.wavelet.rank(c, lo[live]), self.first[c] + self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of these rows of the suffix order."""
        out, steps, todo, at = np.empty(rows.size, dtype=np.int64), 0, np.arange(rows.size), rows.astype(np.int64)
        while todo.size:
            done = self.sampled[at]
            out[todo[done]] = self.places[self.nth[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if todo.size:
                symbol, rank = self.wavelet.access_rank(at)
                at = self.first[symbol] + rank
            steps += 1
        return out

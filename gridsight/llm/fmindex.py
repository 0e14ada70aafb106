"""FM-index over word numbers: wavelet-tree ranks, backward search, sampled suffix positions.

Symbol 0 ends a text or stands for a word that no phrase has. Each 0 counts as a symbol of
its own, ordered by position: no phrase holds one, so this changes no search and lets
suffixes be compared no further than the next 0.
"""

from __future__ import annotations

import numpy as np

DEPTH = 8
EVERY = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes.

    Suffixes are radix-sorted by their first DEPTH symbols; the few that still agree
    without having met a 0 are ordered by doubling.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    order = np.flatnonzero(text)
    padded = np.concatenate([text, np.zeros(DEPTH, text.dtype)])
    heads = [text]
    for step in range(1, DEPTH):
        heads.append(np.where(heads[-1] != 0, padded[step:step + n], 0).astype(text.dtype))
    for head in reversed(heads):
        key = head[order]
        if key.dtype == np.uint16:
            order = order[np.argsort(key, kind="stable")]
        else:
            order = order[np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")]
            order = order[np.argsort((head[order] >> 16).astype(np.uint16), kind="stable")]
    if not len(order):
        return zeros
    open_ends = heads[-1][order] != 0
    same = np.zeros(len(order), bool)
    rows = np.flatnonzero(open_ends[1:] & open_ends[:-1]) + 1
    for head in heads:
        rows = rows[head[order[rows]] == head[order[rows - 1]]]
    same[rows] = True
    if len(rows):
        rank = np.empty(n, np.int64)
        rank[zeros] = np.arange(len(zeros))
        place = np.arange(len(order))
        group = np.maximum.accumulate(np.where(same, 0, place))
        rank[order] = group + len(zeros)
        tied = np.flatnonzero(same | np.append(same[1:], False))
        depth = DEPTH
        while len(tied):
            key = rank[order[tied]] * (n + 1) + rank[order[tied] + depth]
            by = np.argsort(key, kind="stable")
            order[tied], key = order[tied][by], key[by]
            again = np.append(False, key[1:] == key[:-1])
            group = np.maximum.accumulate(np.where(again, 0, tied))
            rank[order[tied]] = group + len(zeros)
            tied = tied[again | np.append(again[1:], False)]
            depth *= 2
    return np.concatenate([zeros, order])


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per binary digit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            ones = (sequence >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.levels.append((words, counts))
            self.zeros.append(len(ones) - int(ones.sum()))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        words, counts = level
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[block] + np.bitwise_count(words[block] & below)

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` ends up among equal symbols; differences of two are ranks."""
        for number, level in enumerate(self.levels):
            ones = self._ones(level, at)
            up = (symbols >> (self.bits - 1 - number) & 1).astype(bool)
            at = np.where(up, self.zeros[number] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and where the position ends up among equal symbols."""
        symbol = np.zeros(len(at), np.int64)
        for number, level in enumerate(self.levels):
            words, _ = level
            up = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(up, self.zeros[number] + ones, at - ones)
            symbol = symbol << 1 | up
        return symbol, at


class FMIndex:
    """Index of one shard. ``text`` begins and ends with 0 and holds symbols below ``size``."""

    def __init__(self, text: np.ndarray, size: int):
        order = suffix_order(text)
        before = text[order - 1]
        self.tree = WaveletMatrix(before, max(1, int(size - 1).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        every = np.arange(size)
        self.begin = self.smaller[:size] - self.tree.descend(every, np.zeros(size, np.int64))
        # A position after a 0 is always sampled: the walk towards the front stops there.
        self.sampled = (order % EVERY == 0) | (before == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases (rows of symbols, filled up with 0) the range of suffixes that begin with each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.zeros(len(phrases), np.int64)
        alive = np.arange(len(phrases))
        last = phrases[alive, lengths - 1]
        low[:], high[:] = self.smaller[last], self.smaller[last + 1]
        for step in range(1, int(lengths.max(initial=1))):
            alive = alive[(low[alive] < high[alive]) & (lengths[alive] > step)]
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - 1 - step]
            low[alive] = self.begin[symbol] + self.tree.descend(symbol, low[alive])
            high[alive] = self.begin[symbol] + self.tree.descend(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking to the nearest sampled one before."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol, at = self.tree.access(rows[walking])
            rows[walking] = self.begin[symbol] + at
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.place[rows]] + steps

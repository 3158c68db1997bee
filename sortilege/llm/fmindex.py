"""An FM-index of numbers, as numpy arrays: counts and places of phrases by backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: ones before a place, from counts of each 64 and the bits within."""

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int32)
        self.before -= np.bitwise_count(self.words)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet tree of numbers, level by level: each level sends zeros before ones, in their order."""

    def __init__(self, values: np.ndarray, depth: int) -> None:
        self.depth, self.levels, self.zeros = depth, [], []
        for k in range(depth - 1, -1, -1):
            flags = (values >> k & 1).astype(bool)
            self.levels.append(Bits(flags))
            zeros = values[~flags]
            self.zeros.append(len(zeros))
            values = np.concatenate([zeros, values[flags]])
        heads = np.flatnonzero(np.diff(values, prepend=-1))
        self.start = np.zeros(1 << depth, np.int64)  # of each number at the bottom
        self.start[values[heads]] = heads

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each value before its place."""
        bottom = at
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.ones(bottom)
            bottom = np.where(value >> (self.depth - 1 - k) & 1, zeros + ones, bottom - ones)
        return bottom - self.start[value]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and its rank there."""
        value, bottom = np.zeros(len(at), np.int64), at
        for level, zeros in zip(self.levels, self.zeros):
            ones, bit = level.ones(bottom), level.get(bottom)
            bottom = np.where(bit, zeros + ones, bottom - ones)
            value = value << 1 | bit
        return value, bottom - self.start[value]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of a text of numbers in the order of what follows; each 0 differs from every other, by its place.

    Doubles the length compared in each round, and sorts again only places that still tie.
    """
    n, ends = len(text), np.flatnonzero(text == 0)
    first = text.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    bits = int(first.max() + 1).bit_length()
    length = max(1, min(63 // bits, n))
    key = first.copy()
    for k in range(1, length):
        key <<= bits
        key[: n - k] |= first[k:]
    order = np.argsort(key)
    rank, head = np.empty(n, np.int64), _heads(key[order])
    rank[order] = head
    rows = _tied(head, np.arange(n))
    while len(rows):
        place = order[rows]
        key = rank[place] * n + rank[place + length]  # a place that ties has no 0 within the length compared
        by = np.argsort(key)
        place, key = place[by], key[by]
        order[rows] = place
        head = rows[_heads(key)]
        rank[place] = head
        rows = _tied(head, rows)
        length *= 2
    return order


def _heads(key: np.ndarray) -> np.ndarray:
    """For each row of a sorted key the first row that equals it."""
    return np.maximum.accumulate(np.where(np.diff(key, prepend=key[0] - 1) != 0, np.arange(len(key)), 0))


def _tied(head: np.ndarray, rows: np.ndarray) -> np.ndarray:
    same = head[1:] == head[:-1]
    return rows[np.r_[same, False] | np.r_[False, same]]


class FMIndex:
    """Of a text of numbers from 1 on, with a 0 behind each document.

    Rows are places in the order of what follows. `sample` keeps the places of rows
    whose place is a multiple of `every` or begins a document; others walk there.
    """

    def __init__(self, text: np.ndarray, every: int = 32) -> None:
        self.size = int(text.max()) + 1
        order = suffix_order(text)
        last = text[order - 1]  # the number before each row's place; row of place 0: the last, which is a 0
        self.tree = Wavelet(last, max(1, (self.size - 1).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        marked = (order % every == 0) | (last == 0)
        self.marked, self.sample = Bits(marked), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of each phrase, a row of numbers filled up with -1 on its left; (0, 0) where it does not occur."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        at = np.flatnonzero((phrases < self.size).all(1) & (phrases[:, -1] >= 0))
        high[at] = self.less[-1]
        for column in range(phrases.shape[1] - 1, -1, -1):
            at = at[phrases[at, column] >= 0]
            value = phrases[at, column]
            low[at], high[at] = self.less[value] + self.tree.rank(value, low[at]), self.less[value] + self.tree.rank(value, high[at])
            gone = low[at] >= high[at]
            low[at[gone]] = high[at[gone]] = 0
            at = at[~gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row."""
        place, steps = np.zeros(len(rows), np.int64), 0
        at, now = np.arange(len(rows)), rows
        while len(at):
            here = self.marked.get(now)
            place[at[here]] = self.sample[self.marked.ones(now[here])] + steps
            at, now = at[~here], now[~here]
            value, rank = self.tree.take(now)
            now, steps = self.less[value] + rank, steps + 1
        return place

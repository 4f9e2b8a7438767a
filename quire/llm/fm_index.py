"""A compressed full-text index over integer symbols: a BWT cut at a depth, in a wavelet matrix, searched backwards."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed words and the count of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels, row = [], symbols
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            row = np.concatenate([row[~ones], row[ones]])
        self.base = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, own in self.levels:
            ones = own.rank(at)
            at = np.where(symbol >> bit & 1, own.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.base[symbol]


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    key = first.astype(np.int64) * (int(second.max()) + 1) + second
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
    return rank


class FMIndex:
    """Over texts (arrays of symbols from 1 up) with weights, for patterns of up to ``depth`` symbols.

    Rows are sorted by their first ``depth`` symbols, which is all that patterns of that length can tell apart.
    """

    def __init__(self, symbols: np.ndarray, begins: np.ndarray, weights: np.ndarray, depth: int):
        """symbols: the texts one after the other; begins: where each begins, and the end; weights: one a text."""
        lengths = np.diff(begins)
        # One separator, 0, after each text; no pattern holds it.
        text = np.zeros(len(symbols) + len(lengths), np.int32)
        own = np.arange(len(symbols), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        text[own] = symbols
        n, self.alphabet, self.depth = len(text), int(symbols.max()) + 1 if len(symbols) else 1, depth
        shift = lambda r, by: np.concatenate([r[by:], np.zeros(min(by, n), r.dtype)])[:n]
        rank, span = text, 1
        while span * 2 <= depth:
            rank, span = _dense(rank, shift(rank, span)), span * 2
        full = _dense(rank, shift(rank, depth - span))
        part = _dense(rank, shift(rank, depth - 1 - span)) if depth - 1 >= span else None
        order = np.argsort(full, kind="stable").astype(np.int32)
        del rank, full
        self.bwt = WaveletMatrix(text[order - 1], self.alphabet)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.alphabet))])
        weight = np.zeros(n, np.int64)
        weight[own] = np.repeat(weights, lengths)
        self.weight_before = np.concatenate([[0], np.cumsum(weight[order])])
        if part is None:  # depth is a power of two
            rank = text
            span = 1
            while span * 2 <= depth - 1:
                rank, span = _dense(rank, shift(rank, span)), span * 2
            part = _dense(rank, shift(rank, depth - 1 - span)) if depth > 1 else np.zeros(n, np.int64)
        part = part[order]
        del order, weight, own
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).astype(np.int32)
        group = np.cumsum(np.concatenate([[False], part[1:] != part[:-1]]), dtype=np.int32)
        self.part_begin, self.part_end = edge[group], np.append(edge[1:], np.int32(n))[group]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of each pattern with one symbol put before it."""
        return self.first[symbol] + self.bwt.rank(symbol, low), self.first[symbol] + self.bwt.rank(symbol, high)

    def matches(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For every place of the given texts, the weight of the occurrences of the ``depth`` symbols that begin there.

        Zero where a text ends before. Matching statistics cut at the depth: the pattern loses its last symbol by
        widening its rows to all that share one symbol less, then gains one in front. All texts advance together.
        """
        lengths = np.diff(begins)
        out = np.zeros(len(symbols), np.int64)
        todo = np.argsort(-lengths, kind="stable")
        todo = todo[lengths[todo] >= self.depth]
        low, high = np.zeros(len(todo), np.int64), np.full(len(todo), len(self.weight_before) - 1)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            n = int(np.searchsorted(-lengths[todo], -back, "right"))  # those that are as long
            todo, low, high = todo[:n], low[:n], high[:n]
            if not n:
                break
            at = begins[todo + 1] - back
            symbol = symbols[at]
            low, high = self.step(symbol, low, high)
            if back >= self.depth:
                out[at] = self.weight_before[high] - self.weight_before[low]
                there = high > low
                row = np.where(there, low, 0)
                low, high = np.where(there, self.part_begin[row], low), np.where(there, self.part_end[row], high)
        return out

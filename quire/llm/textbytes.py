"""UTF-8 text columns as flat arrays: words, hashes of slices and chunks of bounded size, all with numpy.

A slice's hash is a polynomial over random 64-bit values of its bytes, modulo 2**64, then mixed. It comes from
prefix sums, so any number of slices of a chunk cost one pass over its bytes. Two different slices share a hash
with a chance of about 2**-60; the operators say where they rest on that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from quire.llm.mph import mix

#: Bytes of text handled at once; a longer document makes a chunk of its own. 8-byte temporaries are 8 times that.
CHUNK = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 77)
_pow: list[np.ndarray] = []

#: ASCII white space: the bytes 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: ASCII other than letters and digits.
NO_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if not _pow or len(_pow[0]) < n:
        n = max(n, CHUNK + 1)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _pow[:] = [np.cumprod(up), np.cumprod(down)]
    return _pow[0], _pow[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Of values[i] * base**i; values: uint64."""
    with np.errstate(over="ignore"):
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * _powers(len(values) + 1)[0][: len(values)], out=out[1:])
        return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start], 5)


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE[data])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and n + 1 offsets of a text or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most so many bytes together, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def text_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets within these bytes) of each chunk."""
    data, offsets = flat(column)
    for i, j in chunks(offsets, most):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the runs of bytes outside gap, by default white space, and each document's first word."""
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = ~gap[data]
    begins = inner[1:] & ~inner[:-1]
    ends = inner[:-1] & ~inner[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    cut = cut[inner[cut] & inner[cut + 1]]  # two documents that meet without white space
    begins[cut] = ends[cut] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all slices one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class TokenCache:
    """Ids of slices of text by their hash, in flat arrays; a slice that isn't remembered is encoded (again).

    ``encode(slices: list[bytes], hashes) -> list of id sequences`` does that work. A slice has two places, by two
    parts of its hash; a new one takes the free place or drives out what is there. ``bits`` bounds the places and
    ``pool`` the ids held; when the pool is full all is forgotten. Neither changes what comes out.
    """

    def __init__(self, encode, bits: int = 21, pool: int = 12_000_000):
        self.encode, self.mask = encode, np.uint64(2**bits - 1)
        self.keys, self.at, self.size = np.zeros(2**bits, np.uint64), np.zeros(2**bits, np.int32), np.zeros(2**bits, np.int32)
        self.pool, self.used = np.zeros(pool, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the slices, -1 for those not there."""
        a, b = (hashes & self.mask).astype(np.int64), (hashes >> np.uint64(32) & self.mask).astype(np.int64)
        out = np.where(self.keys[a] == hashes, a, -1)
        rest = np.flatnonzero(out < 0)
        out[rest] = np.where(self.keys[b[rest]] == hashes[rest], b[rest], -1)
        return out

    def ids(self, data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices in turn, and how many each has."""
        hashes = slice_hashes(sums, start, end)
        place = self._find(hashes)
        known = place >= 0
        lengths, begins, pool = np.where(known, self.size[place], 0), np.where(known, self.at[place], 0), self.pool
        miss = np.flatnonzero(~known)
        if len(miss):
            new, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            raw, some = data.tobytes(), miss[first]
            found = self.encode([raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())], new)
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            flat_ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
            if self.used + len(flat_ids) > len(pool):
                kept = ragged(begins[known], lengths[known])  # what this chunk needs moves to a pool of its own
                pool = np.concatenate([pool[kept], flat_ids])
                begins[known] = np.cumsum(lengths[known]) - lengths[known]
                base, self.used = len(kept), 0
                self.keys[:] = 0
            else:
                base = self.used
                pool[base : base + len(flat_ids)] = flat_ids
                self.used += len(flat_ids)
                a, b = (new & self.mask).astype(np.int64), (new >> np.uint64(32) & self.mask).astype(np.int64)
                to = np.where((self.keys[a] != 0) & (self.keys[b] == 0), b, a)
                self.keys[to] = new  # of two in one place the last wins, in each of the three arrays
                self.at[to] = base + np.cumsum(sizes) - sizes
                self.size[to] = sizes
            begins[miss], lengths[miss] = (base + np.cumsum(sizes) - sizes)[inverse], sizes[inverse]
        return pool[ragged(begins, lengths)], lengths

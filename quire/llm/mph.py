"""Minimal perfect hash over distinct 64-bit keys, by levels of bitmaps, built and probed with numpy.

At each level the keys left hash into a bitmap of ``GAMMA`` bits a key; keys alone on their bit stay there, the
others go to the next level. A key's slot is the number of set bits before its own: about three bits a key in all.
A key outside the set gets -1 or the slot of another key, so callers store fingerprints beside the slots.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed + 1) * _STEP % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        """sizes: words of 64 bits of each level; bits: all levels' words."""
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        self.n = int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> "MinimalPerfectHash":
        left, sizes, parts = np.asarray(keys, np.uint64), [], []
        while len(left):
            words = max(1, int(len(left) * GAMMA) // 64 + 1)
            at = mix(left, len(sizes)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            if len(sizes) > 60:
                raise ValueError("the keys are not distinct")
            sizes.append(words)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at.astype(np.int64)]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, words in enumerate(self.sizes):
            if not len(left):
                break
            at = mix(keys[left], level) % np.uint64(words * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            own = self.bits[word]
            there = (own >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[there]] = (self.before[word] + below)[there]
            left, base = left[~there], base + words
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<q{len(self.sizes)}q", len(self.sizes), *self.sizes) + self.bits.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "MinimalPerfectHash":
        (levels,) = struct.unpack_from("<q", raw)
        sizes = list(struct.unpack_from(f"<{levels}q", raw, 8))
        return cls(sizes, np.frombuffer(raw, "<u8", sum(sizes), 8 + 8 * levels))

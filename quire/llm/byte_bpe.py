"""Byte-level BPE encoding and decoding (operator 10).

Two tiers. Tier one: a minimal perfect hash over the vocabulary, with the keys as fingerprints, resolves a whole
pre-token that is itself a token. Tier two: other pre-tokens merge over linked bytes with a heap of ranked pairs.
Texts are cut into pre-tokens with array operations on character classes, as the pattern of the rank files would.

Cases: a null or empty text has no ids; text is whole, however long; rows stand alone, so repeated rows, ties,
empty tables and further columns change nothing. A pre-token is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm import staging
from quire.llm.mph import MinimalPerfectHash
from quire.llm.textbytes import TokenCache, byte_sums, slice_hashes, text_chunks

# Fixed value: the pattern that the array operations below follow, and no other.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, BLANK, OTHER = range(4)
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                if b - a + 1 == len(m[0]):
                    table[a : b + 1] = kind
                else:  # over the gap of the surrogates
                    table[[ord(c) for c in m[0]]] = kind
        _classes.append(table)
    return _classes[0]


def points_at(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The characters of valid UTF-8 that begin at these bytes."""
    points = data[starts].astype(np.int64)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        lead, at = points[wide], starts[wide]
        follow = np.stack([data[np.minimum(at + k, len(data) - 1)] for k in (1, 2, 3)]).astype(np.int64) & 0x3F
        two = (lead & 0x1F) << 6 | follow[0]
        three = (lead & 0x0F) << 12 | follow[0] << 6 | follow[1]
        four = (lead & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]
        points[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return points


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of valid UTF-8: the first byte of each character, and the characters."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return starts, points_at(data, starts)


def pre_token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all pre-tokens, which cover the text without gaps. offsets: of the documents, in bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, points = code_points(data)
    n = len(at)
    kind = class_table()[points]
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    first = np.searchsorted(at, offsets[:-1])
    first = first[first < n]
    opens = np.zeros(n + 1, bool)  # a document begins here, or the text ends
    opens[first] = opens[n] = True
    edge[first] = True
    run = np.flatnonzero(edge)
    stop = np.append(run[1:], n)
    blank = kind[run] == BLANK
    mark = np.zeros(n + 1, bool)
    # White space before other text gives its last character to what follows if that is a space, else leaves it alone.
    followed = blank & ~opens[stop]
    lends = followed & (points[stop - 1] == 0x20)
    mark[run] = True
    mark[(stop - 1)[followed]] = True
    mark[stop[lends]] = False
    # An apostrophe alone, with no space lent to it, takes s, t, m, d, re, ve or ll from the letters after it.
    lent = np.concatenate([[False], lends[:-1]])
    bare = np.flatnonzero((points[run] == 0x27) & (stop - run == 1) & ~lent & ~opens[stop])
    if len(bare):
        p = run[bare] + 1
        padded = np.append(points, [0, 0])
        room = (stop[np.minimum(bare + 1, len(run) - 1)] - p) >= 2
        c, d = padded[p], np.where(room, padded[p + 1], 0)
        one = np.isin(c, [ord(x) for x in "stmd"])
        two = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
        mark[p[one | two]] = False
        mark[(p + 1)[one]] = True
        mark[(p + 2)[two]] = True
    return at[mark[:n]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank, leftmost first, joins until no pair has a rank."""
    n, get = len(piece), ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    # A heap entry packs rank, first byte and end of the joined pair; end[i] is 0 once i is inside another piece.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 64 | i << 32 | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, stop = top >> 32 & 0xFFFFFFFF, top & 0xFFFFFFFF
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has joined another since
        end[j], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, r << 64 | i << 32 | end[stop])
        if (k := before[i]) >= 0 and (r := get(piece[k:stop])) is not None:
            heappush(heap, r << 64 | k << 32 | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBPE:
    """An encoder and decoder for one rank file; its cache bounds memory only."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        keys = slice_hashes(byte_sums(raw), ends - [len(t) for t in tokens], ends)
        self.index = MinimalPerfectHash.build(keys)
        slots = self.index.slots(keys)
        self.fingerprints, self.token_ids = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
        self.fingerprints[slots], self.token_ids[slots] = keys, list(ranks.values())
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.cache = TokenCache(self._encode_new)

    def _encode_new(self, pieces: list[bytes], hashes: np.ndarray) -> list:
        slots = self.index.slots(hashes)
        whole = (slots >= 0) & (self.fingerprints[slots] == hashes)
        return [(t,) if w else merge(p, self.ranks) for p, w, t in zip(pieces, whole.tolist(), self.token_ids[slots].tolist())]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order."""
        for i, j, data, offsets in text_chunks(column):
            start = pre_token_starts(data, offsets)
            ids, lengths = self.cache.ids(data, byte_sums(data), start, np.append(start[1:], len(data)))
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(start, offsets)]
            for k in range(j - i):
                yield ids[ends[k] : ends[k + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_encoders: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """One for each worker process and rank file."""
    if path not in _encoders:
        _encoders[path] = ByteBPE(read_ranks(path))
    return _encoders[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False, pattern: str = PATTERN) -> DataFrame:
    """key, n_tokens, and the ids (little-endian unsigned 32-bit, binary) with the text decoded from them.

    digests: the SHA-256 of ids and decoded bytes in their place, as ids_sha256 and decoded_sha256.
    path: a rank file, found under the same path on every machine. pattern: the one that goes with it; any but PATTERN
    is refused, as texts would be cut otherwise.
    """
    if pattern != PATTERN:
        raise ValueError("pre-tokens are cut for one pattern only")
    staging.reachable(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches):
        bpe = encoder(path)
        for batch in staging.pieces(batches):
            out = ([], [], [])
            for ids in bpe.encode(batch.column(1)):
                raw, back = ids.astype("<u4").tobytes(), bpe.decode(ids)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(raw).hexdigest() if digests else raw)
                out[2].append(hashlib.sha256(back).hexdigest() if digests else back)
            t = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], t), pa.array(out[2], t)], [key, "n_tokens", *names])

    t = "string" if digests else "binary"
    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, {names[0]} {t}, {names[1]} {t}")

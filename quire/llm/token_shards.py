"""Token-ID output in binary shards with constant-time keyed access (operator 4).

A shard is two files. ``.ids``: the raw ids of its documents one after the other, 2 bytes each where the vocabulary
allows it, else 4. ``.idx``: a minimal perfect hash over the document keys whose slots hold the key's fingerprint
and the document's position; by position, the key and the offset of its ids. Documents are dealt to shards by ranges
of their key, ascending, so the shards in turn hold all documents in order.

The index key is (doc_id, how many rows of the same doc_id came before), so repeated rows keep an entry each. The number
of shards follows the bytes of text; ranges are of the key and a hash of the text, so that many texts of one doc_id, or
of none, spread over shards. The manifest says where each shard begins and how many rows of its first key lie in earlier
ones, by which Shards finds the shard of any key.

Cases: a null or empty text has the end id alone; a null doc_id sorts first and is found as key None; no documents
give no shards; texts are whole; further columns are ignored. Words are known by a 64-bit hash when ids are reused.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.byte_bpe import LETTER, class_table, points_at
from quire.llm.mph import MinimalPerfectHash, mix
from quire.llm.textbytes import TokenCache, byte_sums, text_chunks, word_spans

MAGIC = b"QTSHARD1"
_HEAD = "<8sBqqq"
# The normaliser and the pattern for which the words of a text can be lower-cased and encoded apart.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Bytes of text that a shard is meant to hold.
SHARD_BYTES = 256 << 20
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """The tokenizers library over words: ids of a text are those of its runs between ASCII white space.

    That holds for tokenizers whose pattern drops white space and never matches across it; a file with another normaliser,
    pattern or special tokens than those known is refused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        special = [t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"]]
        if (spec["normalizer"] or {}).get("normalizers") != NORMALIZERS or steps[0] != SPLIT or spec["post_processor"] or not all(special):
            raise ValueError(f"{path}: words of its texts can't be encoded apart")
        self.cache = TokenCache(self._encode_new)

    def _encode_new(self, words: list[bytes], _hashes: np.ndarray) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode(self, column: pa.Array):
        for i, j, data, offsets in text_chunks(column):
            raw = data.tobytes()
            if b"<|" not in raw:  # else a special token's name in capitals would become one
                data = np.frombuffer(raw.lower(), np.uint8)
            start, end, first = word_spans(data, offsets)
            cuts = punctuation_edges(data)
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
            ids, lengths = self.cache.ids(data, byte_sums(data), start, end)
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(start, offsets)]
            for k in range(j - i):
                yield ids[ends[k] : ends[k + 1]]


def punctuation_edges(data: np.ndarray) -> np.ndarray:
    """Where a run of .,;:!? meets a letter inside a word, the run having a letter or white space on either side.

    No token reaches over such a place and no character composes over it, so words can be cut there and recur more.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    edge = np.diff(_MARK[data].view(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the runs
    left = a - 1
    for _ in range(3):  # to the first byte of the character before
        left = np.where((left > 0) & ((data[left] & 0xC0) == 0x80), left - 1, left)
    open_a, open_b = a == 0, b == len(data)
    before, after = points_at(data, np.maximum(left, 0)), points_at(data, np.minimum(b, len(data) - 1))
    # Small I-dot-above has a letter and a mark, the only letter of which that is so.
    letters = [(class_table()[p] == LETTER) & (p != 0x130) & ~at_edge for p, at_edge in ((before, open_a), (after, open_b))]
    blanks = [at_edge | (p == 0x20) | (p >= 9) & (p <= 13) for p, at_edge in ((before, open_a), (after, open_b))]
    fine = (letters[0] | blanks[0]) & (letters[1] | blanks[1])
    return np.concatenate([a[fine & letters[0]], b[fine & letters[1]]])


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def key_hash(keys: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """Distinct for distinct (key, copy) as far as 64 bits go; the fingerprint is a second hash of the same."""
    return mix(mix(keys.view(np.uint64), 1) ^ mix(copy.astype(np.uint64), 2) ^ null.astype(np.uint64), 3)


def fingerprint(keys: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return (mix(mix(keys.view(np.uint64), 11) + copy.astype(np.uint64) + null.astype(np.uint64), 12) >> np.uint64(32)).astype(np.uint32)


def index_bytes(width: int, keys: np.ndarray, null: np.ndarray, offsets: np.ndarray) -> bytes:
    """keys, null: of the documents in order; offsets: n + 1, in ids."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
    at = np.arange(len(keys))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    hashes = key_hash(keys, null, copy)
    mph = MinimalPerfectHash.build(hashes)
    slots = mph.slots(hashes)
    prints, place = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slots], place[slots] = fingerprint(keys, null, copy), at
    raw = mph.to_bytes()
    parts = [prints, place, keys.astype("<i8"), null.astype(np.uint8), copy.astype("<u4"), offsets.astype("<i8")]
    return struct.pack(_HEAD, MAGIC, width, len(keys), len(raw), int(offsets[-1])) + raw + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads one shard; the payload is read by ranges, so a lookup costs one range of one file."""

    def __init__(self, path: str):
        self.fs, name = fs.FileSystem.from_uri(path)
        with self.fs.open_input_stream(f"{name}.idx") as f:
            raw = f.read()
        magic, self.width, n, size, self.total = struct.unpack_from(_HEAD, raw)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        at = struct.calcsize(_HEAD)
        self.mph, at, self.n = MinimalPerfectHash.from_bytes(raw[at : at + size]), at + size, n
        for name_, kind, count in (("prints", "<u4", n), ("place", "<u4", n), ("keys", "<i8", n), ("null", "u1", n), ("copy", "<u4", n), ("offsets", "<i8", n + 1)):
            setattr(self, name_, np.frombuffer(raw, kind, count, at))
            at += np.dtype(kind).itemsize * count
        self.payload = self.fs.open_input_file(f"{name}.ids")

    def find(self, keys: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """Positions of the keys, -1 for those that the shard doesn't hold."""
        slots = self.mph.slots(key_hash(keys, null, copy))
        if not self.n:
            return np.full(len(keys), -1)
        return np.where((slots >= 0) & (self.prints[slots] == fingerprint(keys, null, copy)), self.place[slots].astype(np.int64), -1)

    def ids(self, place: int) -> np.ndarray:
        a, b = int(self.offsets[place]), int(self.offsets[place + 1])
        return np.frombuffer(self.payload.read_at((b - a) * self.width, a * self.width), f"<u{self.width}").astype(np.uint32)

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document, by its key."""
        place = int(self.find(np.array([key or 0], np.int64), np.array([key is None]), np.array([copy]))[0])
        return None if place < 0 else self.ids(place)


class Shards:
    """All shards of a manifest: the ids of any document by its key, from one range of one file."""

    def __init__(self, out: str):
        store, base = fs.FileSystem.from_uri(out)
        with store.open_input_stream(f"{base}/manifest.json") as f:
            self.entries = json.loads(f.read())
        self.firsts = [self._order(e["first"]) for e in self.entries]
        self.opened: dict[int, Shard] = {}

    @staticmethod
    def _order(key: int | None) -> tuple[bool, int]:
        return key is not None, key or 0

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        i = bisect_right(self.firsts, self._order(key)) - 1
        own = lambda: self.firsts[i] == self._order(key)
        while i > 0 and own() and copy < self.entries[i]["base"]:
            i -= 1
        if i < 0:
            return None
        if i not in self.opened:
            self.opened[i] = Shard(self.entries[i]["path"])
        return self.opened[i].get(key, copy - self.entries[i]["base"] * own())


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", shards: int | None = None) -> list[dict]:
    """Encodes and writes all documents below the URI out, a shared folder; returns one entry for each shard, in order.

    Each entry has path, n_docs, n_tokens, start (ids in the shards before it), first (its first key) and base (rows of
    that key in the shards before it); they also go to manifest.json. A task writes files of its own name, so that a
    repeated one disturbs nothing; the manifest names those that count.
    """
    spark = docs.sparkSession
    staging.reachable(spark)
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    shards = shards or staging.parts(spark, rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0, SHARD_BYTES)

    def run(batches):
        part, name = TaskContext.get().partitionId(), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        store, base = fs.FileSystem.from_uri(out)
        words, keys, null, lengths, sink = encoder(tokenizer), [], [], [], None
        tail = [] if end_id is None else [end_id]
        width = 2 if max([words.tokenizer.get_vocab_size(), *tail]) <= 2**16 else 4
        for batch in staging.pieces(batches):
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}.ids")
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            for ids in words.encode(batch.column(2)):
                raw = np.concatenate([ids, tail]).astype(f"<u{width}")
                sink.write(raw.tobytes())
                lengths.append(len(raw))
        if sink is not None:
            sink.close()
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            key_, none = np.concatenate(keys), np.concatenate(null)
            with store.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(index_bytes(width, key_, none, offsets))
            of = lambda i: None if none[i] else int(key_[i])
            last = int(((key_ == key_[-1]) & (none == none[-1])).sum())
            row = ([part], [name], [len(lengths)], [int(offsets[-1])], [of(0)], [of(-1)], [last])
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["shard", "name", "n_docs", "n_tokens", "first", "last", "n_last"])

    # With a number of its own each row has a range to go to, so that rows of one key and text, however many, are spread.
    order = [F.col("k").asc_nulls_first(), F.col("h"), F.col("n")]
    numbered = rows.select("k", F.xxhash64("t").alias("h"), "t", F.monotonically_increasing_id().alias("n"))
    ranged = numbered.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = sorted(ranged.mapInArrow(run, "shard long, name string, n_docs long, n_tokens long, first long, last long, n_last long").collect())  # one row a shard
    entries, start, before = [], 0, (False, None, 0)
    for r in made:
        base = before[2] if before[:2] == (True, r.first) else 0
        entries.append({"path": f"{out}/{r.name}", "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": start, "first": r.first, "base": base})
        start += r.n_tokens
        before = (True, r.last, r.n_last + (base if r.last == r.first else 0))
    store, base = fs.FileSystem.from_uri(out)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(entries).encode())
    return entries


def read(spark: SparkSession, entries: list[dict], key: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row for each document of the shards: key, start, n_tokens and its ids (little-endian 32-bit, binary).

    Every document is looked up by its key. digests: in place of the ids their CRC-32, as ids_crc32.
    """
    staging.reachable(spark)
    value = "ids_crc32 long" if digests else "ids binary"
    listed = spark.createDataFrame([(i, e["path"], e["start"]) for i, e in enumerate(entries)], "i long, path string, start long")

    def run(batches):
        for batch in staging.pieces(batches):
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                place = shard.find(shard.keys, shard.null != 0, shard.copy)
                if (place != np.arange(shard.n)).any():
                    raise ValueError(f"{path}: the index doesn't give back its keys")
                for a in range(0, shard.n, 2000):
                    some = place[a : a + 2000]
                    raw = [shard.ids(p).astype("<u4").tobytes() for p in some.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.keys[some], pa.int64(), mask=shard.null[some] != 0), pa.array(base + shard.offsets[some]), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw] if digests else raw, pa.int64() if digests else pa.binary())],
                        [key, "start", "n_tokens", value.split()[0]],
                    )

    spread = listed.repartition(max(1, len(entries)), "i").select("path", "start")
    return spread.mapInArrow(run, f"`{key}` long, start long, n_tokens long, {value}")

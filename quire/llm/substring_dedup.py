"""Substring deduplication with a compressed FM-index per shard (operator 9).

A window is ``width`` consecutive words. Its anchor is the smallest hash of the k-word runs inside it, so equal windows
have equal anchors and meet in the shard of that anchor. Only anchors that occur twice in the corpus are followed up.
Consecutive windows of one anchor make a segment; a shard builds an FM-index over its different segments and searches
all of them backwards, which gives each window the number of its occurrences.

Texts are written once, beside the anchors of each block: a run of rows of one task, of ``BLOCK_BYTES`` or the rest. They
are never shuffled. A block tells a shard of each different thing once, with its count, and gets one answer, written to
the file of the block's bucket in the shared place, which is sorted by block; so copies fold before they move. Later
passes stream the written texts and fetch the answers of the block they come to, of whose file they read the row groups
that hold it. A bucket is for ``HANDED_BYTES`` of texts, so files follow the input and no folder is a block's own.

An anchor that occurs ``HOT`` times or more has its windows counted by their own hash first, dealt by that hash. Those
that recur go on one by one, each to the shard of its own hash: however many windows stand around one run of words, no
shard has them all. The numbers of blocks and shards follow the input.

Anchors and hot windows are known by 64-bit hashes, which only choose what is followed up. What is removed rests on
words: a shard compares segments and words byte by byte, and a block finds the answer to a segment by 128 bits of hash
of its words.

Cases: a null or empty text has no words; texts shorter than a window lose nothing; repeated rows and rows of one
doc_id are documents of their own, each row with its own answer; a null doc_id is kept; texts are whole; other columns
are ignored by the digests and dropped otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.fm_index import FMIndex
from quire.llm.mph import mix
from quire.llm.textbytes import byte_sums, prefix_sums, ragged, slice_hashes, text_chunks, word_spans

WIDTH, RUN, HOT = 35, 8, 1000
#: Bytes of text of a block and for each index, anchors of a shard, and bytes of segments that a worker gathers at once.
BLOCK_BYTES, INDEX_BYTES, SHARD_ANCHORS, GATHER = 64 << 20, 4 << 20, 4_000_000, 16 << 20
#: Bytes of text to whose blocks one file holds what they are given, and of a row group of it.
HANDED_BYTES, HANDED_GROUP = 1 << 30, 1 << 20
#: Partitions of a shuffle at the utmost; beyond it a task works on several shards, one after the other.
MOST_PARTS = 10_000
#: What a block is given: hashes of anchors, of hot windows, and answers to segments.
ANCHORS, KEPT, ANSWER = 0, 1, 2
_TOLD = "shard long, block long, a binary, b binary"
_GIVEN = "block long, kind int, a binary, b binary, c binary"


def _slide(values: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of ``size`` values."""
    out, span = values, 1
    while span * 2 <= size:
        out, span = best(out[:-span], out[span:]), span * 2
    rest = size - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_name(least: np.ndarray) -> np.ndarray:
    """What an anchor is known by: smallest hashes crowd at the lower end, and shards are ranges of what is spread evenly."""
    return mix(least, 9)


class Words:
    """The words of a chunk of documents with the hashes of their windows and anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, run: int):
        self.data, self.width = data, width
        self.start, self.end, self.first = word_spans(data, offsets)
        n = len(self.start)
        self.sums = prefix_sums(slice_hashes(byte_sums(data), self.start, self.end))
        at = np.arange(max(0, n - width + 1))
        self.valid = self.first[np.searchsorted(self.first, at, "right")] >= at + width if len(at) else np.zeros(0, bool)
        runs = np.arange(max(0, n - run + 1))
        self.runs = slice_hashes(self.sums, runs, runs + run)
        self.least = _slide(self.runs, width - run + 1, np.minimum) if len(at) else np.zeros(0, np.uint64)
        self.anchor = anchor_name(self.least)

    def anchors(self) -> np.ndarray:
        """Places of the runs that are the anchor of a window they stand in; equal runs of one window all count."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        side = self.width - (len(self.start) - len(self.runs) + 1)  # windows that hold a run, less one
        wide = np.concatenate([np.zeros(side, np.uint64), np.where(self.valid, self.least, 0), np.zeros(side, np.uint64)])
        return np.flatnonzero((_slide(wide, side + 1, np.maximum) == self.runs) & (self.runs > 0))

    def windows(self, at: np.ndarray) -> np.ndarray:
        return slice_hashes(self.sums, at, at + self.width)

    def segments(self, cold: np.ndarray, hot: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run of windows to follow up that have one anchor, and the hash it is dealt by.

        A window of a hot anchor is a run of its own and goes by its own hash, any other run by its anchor.
        """
        key = self.anchor.copy()
        follow, alone = self.valid & _among(self.anchor, cold), np.zeros(len(key), bool)
        if len(hot):
            some = np.flatnonzero(self.valid & _among(self.anchor, hot))
            windows = self.windows(some)
            follow[some], alone[some], key[some] = _among(windows, kept), True, windows
        at = np.flatnonzero(follow)
        if not len(at):
            return at, at, key[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (self.anchor[at[1:]] != self.anchor[at[:-1]]) | alone[at[1:]]
        return at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1], key[at[new]]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """known: sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _cuts(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys; a shard is a range of them."""
    bounds = np.array([i * 2**64 // shards for i in range(1, shards)], np.uint64)
    ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [(s, a, b) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]


def _tell(block: int, shards: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """keys: sorted and different."""
    counts = np.minimum(counts, 2**32 - 1).astype("<u4")
    return [(s, block, keys[a:b].tobytes(), counts[a:b].tobytes()) for s, a, b in _cuts(keys, shards)]


def _by_shard(told: DataFrame, shards: int, work: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """work over the rows (block, a, b) of each shard, which one task has whole, one shard after the other."""
    parts = min(shards, MOST_PARTS)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and held:
                    yield _rows(_GIVEN, work(held))
                    held = []
                now = shard
                held.append(tuple(row))
        if held:
            yield _rows(_GIVEN, work(held))

    run.__name__ = work.__name__  # for the plan
    dealt = told.repartitionById(parts, F.floor(F.col("shard") * F.lit(parts) / F.lit(shards)).cast("int"))
    return (dealt if parts == shards else dealt.sortWithinPartitions("shard")).mapInArrow(run, _GIVEN)


def _recurring(kind: int, hot: int | None):
    """What a shard answers to counted hashes: for each block those that occur twice, and the hot ones apart."""

    def recurring(rows: list[tuple]) -> list[tuple]:
        keys = [np.frombuffer(a, "<u8") for _, a, _ in rows]
        counts = np.concatenate([np.frombuffer(b, "<u4") for _, _, b in rows]).astype(np.int64)
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts, len(every))[inverse]
        ends = np.cumsum([len(k) for k in keys])
        out = []
        for (block, _, _), own, a, b in zip(rows, keys, [0, *ends[:-1]], ends):
            cold = own[(total[a:b] >= 2) & (total[a:b] < (hot or np.inf))]
            warm = own[total[a:b] >= hot] if hot else cold[:0]
            if len(cold) or len(warm):
                out.append((block, kind, cold.tobytes(), warm.tobytes(), b""))
        return out

    recurring.__name__ = "recurring_anchors" if kind == ANCHORS else "recurring_windows"
    return recurring


def _compress(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _name(segment: bytes) -> bytes:
    return xxhash.xxh3_128_digest(segment)


def _index_shard(width: int):
    """Builds the shard's FM-index over its different segments and searches them all in it."""

    def index_shard(rows: list[tuple]) -> list[tuple]:
        different: dict[bytes, int] = {}
        code = [np.array([different.setdefault(t, len(different)) for t in _expand(a).split(b"\n")], np.int64) for _, a, _ in rows]
        counts = np.concatenate([np.frombuffer(b, "<u4") for _, _, b in rows]).astype(np.int64)
        texts = list(different)
        words = pc.split_pattern(pa.array(texts, pa.large_binary()), b" ")
        own = words.values.dictionary_encode().indices.to_numpy().astype(np.int32) + 1  # equal words by their bytes
        begins = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)
        lengths = np.diff(begins)
        del words, different
        index = FMIndex(own, begins, np.bincount(np.concatenate(code), counts, len(texts)).astype(np.int64), width)
        repeated = index.matches(own, begins) >= 2
        some = np.add.reduceat(repeated, begins[:-1]) > 0
        out = []
        for (block, _, _), mine in zip(rows, code):
            mine = mine[some[mine]]
            if len(mine):
                bits = repeated[ragged(begins[mine], lengths[mine] - width + 1)]
                out.append((block, ANSWER, b"".join(_name(texts[i]) for i in mine.tolist()), (lengths[mine] - width + 1).astype("<u4").tobytes(), np.packbits(bits).tobytes()))
        return out

    return index_shard


def _bucket(block, buckets: int):
    """Of a block's number, which has its task in the upper bits; for a Column or an int."""
    if isinstance(block, int):
        return ((block >> 24) * 31 + (block & 0xFFFFFF)) % buckets
    return F.pmod(F.shiftright(block, 24) * 31 + block.bitwiseAND(F.lit(0xFFFFFF)), F.lit(buckets)).cast("int")


def _handed(given: DataFrame, name: str, buckets: int) -> str:
    """Writes what blocks are given, a file a bucket, sorted by block, to a folder in the shared place."""
    path = staging.new_dir(given.sparkSession, name)
    dealt = given.withColumn("bucket", _bucket(F.col("block"), buckets)).repartition(min(buckets, MOST_PARTS), "bucket").sortWithinPartitions("bucket", "block")
    dealt.write.option("parquet.block.size", str(HANDED_GROUP)).partitionBy("bucket").parquet(path)
    return path


class Given:
    """What a block was given, read from the files of its bucket: of each the row groups that may hold the block."""

    def __init__(self, paths: list[str], block: int, buckets: int):
        rows: list[dict] = []
        for path in paths:
            store, base = fs.FileSystem.from_uri(path)
            for info in store.get_file_info(fs.FileSelector(f"{base}/bucket={_bucket(block, buckets)}", allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    with store.open_input_file(info.path) as f:
                        rows += pq.read_table(f, columns=["kind", "a", "b", "c"], filters=[("block", "==", block)], partitioning=None).to_pylist()
        joined = lambda kind, column: np.sort(np.frombuffer(b"".join(r[column] for r in rows if r["kind"] == kind), "<u8"))
        self.cold, self.warm, self.kept = joined(ANCHORS, "a"), joined(ANCHORS, "b"), joined(KEPT, "a")
        answers = [r for r in rows if r["kind"] == ANSWER]
        names = b"".join(r["a"] for r in answers)
        self.at = {names[i : i + 16]: i // 16 for i in range(0, len(names), 16)}
        sizes = [np.frombuffer(r["b"], "<u4").astype(np.int64) for r in answers]
        self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bits = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(r["c"], np.uint8), count=int(x.sum())) for r, x in zip(answers, sizes))])


def _by_block(batches, paths: list[str], buckets: int) -> Iterator[tuple[int, Given | None, pa.RecordBatch]]:
    """(block, what it was given, rows) of the written texts; given: only where a block begins."""
    now = None
    for batch in staging.pieces(batches):
        block = batch.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(edge[:-1], edge[1:]):
            new = now is None or int(block[a]) != now
            now = int(block[a])
            yield now, Given(paths, now, buckets) if new else None, batch.slice(a, b - a)


def _written(docs: DataFrame, key: str, text: str, width: int, run: int) -> DataFrame:
    """(block, id, text, n, size, a, b), a table: the rows, then a row for each block with its anchors (a) and how often
    each occurs (b), their number (n) and the bytes of its texts."""
    kind, block_bytes = docs.schema[key].dataType, BLOCK_BYTES

    def scan(batches):
        base, number, size, found = TaskContext.get().partitionId() << 24, 0, 0, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

        def fold():
            keys, counts = (np.concatenate(x) for x in zip(*found))
            keys, at = np.unique(keys, return_inverse=True)
            found[:] = [(keys, np.bincount(at, counts, len(keys)).astype(np.int64))]

        def close():
            fold()
            keys, counts = found[0]
            row = [[base + number], [None], [None], [len(keys)], [size], [keys.tobytes()], [np.minimum(counts, 2**32 - 1).astype("<u4").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        names, kinds = ["block", "id", "text", "n", "size", "a", "b"], None
        for batch in staging.pieces(batches):
            kinds = [pa.int64(), batch.column(0).type, batch.column(1).type, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            rows = batch.num_rows
            empty = [pa.nulls(rows, k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, base + number)), batch.column(0), batch.column(1), *empty], names)
            for _, _, data, offsets in text_chunks(batch.column(1)):
                own = Words(data, offsets, width, run)
                at = anchor_name(own.runs[own.anchors()])
                found.append((at, np.ones(len(at), np.int64)))
                size += len(data)
            if len(found) > 64:
                fold()
            if size >= block_bytes:
                yield close()
                number, size, found[:] = number + 1, 0, found[:0] + [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        if kinds and (size or number == 0):
            yield close()

    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    return staging.table(rows.mapInArrow(scan, f"block long, id {kind.simpleString()}, text string, n long, size long, a binary, b binary"), "texts")


def remove_repeats(docs: DataFrame, width: int = WIDTH, run: int = RUN, hot: int = HOT, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """key, n_words, n_removed and the text of the words that stay, joined by one space, as kept.

    A word goes if a window over it occurs at another place too, in the same document or another. digests: the kept
    text's SHA-256 as kept_sha256 in its place.
    """
    if not 1 <= run <= width:
        raise ValueError("an anchor has to fit into a window")
    spark = docs.sparkSession
    staging.reachable(spark)
    written = _written(docs, key, text, width, run)
    texts, packs = written.filter("a is null").select("block", "id", "text"), written.filter("a is not null")
    total = packs.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    shards, indexes = staging.parts(spark, total.n or 0, SHARD_ANCHORS), staging.parts(spark, total.size or 0, INDEX_BYTES)
    buckets = staging.parts(spark, total.size or 0, HANDED_BYTES)

    def tell_anchors(batches):
        for batch in batches:
            for block, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                yield _rows(_TOLD, _tell(block, shards, np.frombuffer(a, "<u8"), np.frombuffer(b, "<u4")))

    def tell_windows(batches):
        found, warm, of = [np.zeros(0, np.uint64)], np.zeros(0, np.uint64), None

        def told():
            every = np.concatenate(found)
            found[:] = [every[:0]]
            return _rows(_TOLD, _tell(of, shards, *np.unique(every, return_counts=True)) if len(every) else [])

        for block, given, rows in _by_block(batches, [anchors], buckets):
            if given or sum(map(len, found)) > GATHER // 8:
                yield told()
            of, warm = block, given.warm if given else warm
            for _, _, data, offsets in text_chunks(rows.column(2)) if len(warm) else ():
                own = Words(data, offsets, width, run)
                found.append(own.windows(np.flatnonzero(own.valid & _among(own.anchor, warm))))
        yield told()

    def segments_of(own: Words, given: Given) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """First windows, the hashes that segments are dealt by, and their words joined by one space."""
        a, b, dealt = own.segments(given.cold, given.warm, given.kept)
        raw = own.data.tobytes()
        return a, dealt, [b" ".join(raw[x:y].split()) for x, y in zip(own.start[a].tolist(), own.end[b + width - 1].tolist())]

    def tell_segments(batches):
        gathered: dict[bytes, list[int]] = {}
        of, now, size = None, None, 0

        def told():
            names = sorted(gathered, key=lambda t: gathered[t][0])
            keys, counts = np.array([gathered[t][0] for t in names], np.uint64), np.array([gathered[t][1] for t in names], "<u4")
            gathered.clear()
            return _rows(_TOLD, [(s, of, _compress(b"\n".join(names[a:b])), counts[a:b].tobytes()) for s, a, b in _cuts(keys, indexes)])

        for block, given, rows in _by_block(batches, paths, buckets):
            if given:
                yield told()
                of, now, size = block, given, 0
            for _, _, data, offsets in text_chunks(rows.column(2)) if len(now.cold) or len(now.kept) else ():
                own = Words(data, offsets, width, run)
                _, dealt, found = segments_of(own, now)
                for by, t in zip(dealt.tolist(), found):
                    if t in gathered:
                        gathered[t][1] += 1
                    else:
                        gathered[t] = [by, 1]
                        size += len(t)
                if size > GATHER:
                    yield told()
                    size = 0
        yield told()

    kind = docs.schema[key].dataType.simpleString()
    value = "kept_sha256" if digests else "kept"

    def finish(batches):
        now = None
        for _, given, rows in _by_block(batches, [*paths, answers], buckets):
            now = given or now
            totals, gone_counts, out = [], [], []
            for i, j, data, offsets in text_chunks(rows.column(2)):
                own = Words(data, offsets, width, run)
                gone = np.zeros(len(own.start), bool)
                if now.at:
                    a, _, found = segments_of(own, now)
                    at = np.array([now.at.get(_name(t), -1) for t in found], np.int64)
                    a, at = a[at >= 0], at[at >= 0]
                    windows = ragged(a, now.sizes[at])[now.bits[ragged(now.begins[at], now.sizes[at])] == 1]
                    cover = np.zeros(len(gone) + 1, np.int64)
                    np.add.at(cover, windows, 1)
                    np.add.at(cover, windows + width, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                raw, first = data.tobytes(), own.first.tolist()
                for d in range(j - i):
                    x, y = first[d], first[d + 1]
                    lost = gone[x:y]
                    words = raw[offsets[d] : offsets[d + 1]].split()
                    if lost.any():
                        words = [w for w, g in zip(words, lost.tolist()) if not g]
                    totals.append(y - x)
                    gone_counts.append(int(lost.sum()))
                    text_ = b" ".join(words)
                    out.append(hashlib.sha256(text_).hexdigest() if digests else text_.decode())
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(totals, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(out, pa.string())], [key, "n_words", "n_removed", value])

    told = packs.select("block", "a", "b").mapInArrow(tell_anchors, _TOLD)
    anchors = _handed(_by_shard(told, shards, _recurring(ANCHORS, hot)), "recurring", buckets)
    paths = [anchors]
    if _any_hot(spark, anchors):
        paths.append(_handed(_by_shard(texts.mapInArrow(tell_windows, _TOLD), shards, _recurring(KEPT, None)), "hot-windows", buckets))
    answers = _handed(_by_shard(texts.mapInArrow(tell_segments, _TOLD), indexes, _index_shard(width)), "answers", buckets)
    return texts.mapInArrow(finish, f"`{key}` {kind}, n_words long, n_removed long, {value} string")


def _any_hot(spark, path: str) -> bool:
    return spark.read.schema("kind int, a binary, b binary, c binary").parquet(path).filter(F.length("b") > 0).limit(1).count() > 0

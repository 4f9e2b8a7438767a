"""Ranked lexical search over a two-level quantised index (operator 13).

The index is dealt to shards of documents (``SHARD_DOCS``, ``SHARD_BYTES``), made where the texts are read: a row for each
shard and term holds the shard's documents that have the term, how often, and their lengths, as flat arrays. With the
lengths of all documents known, every occurrence's impact (below a million) becomes a byte, rounded up: the first level.
The byte times ``STEP`` is no less than the impact, and the byte before it no more, so bytes give both an upper and a
lower bound of a document's score for an item. A search goes like this:

1. terms of the items find their rows of the first level (by broadcast, in blocks of items of a measured size);
2. a few shards (``PROBE``) give each item the k-th highest lower bound among their documents: whatever documents they
   hold, no document whose upper bound is less than that is among the k best;
3. every shard adds up its bytes, item by item, and lets go the documents whose upper bound reaches that and the k-th
   lower bound of the shard itself;
4. of these, every document whose upper bound reaches the k-th lower bound of all is scored exactly, in whole numbers,
   from the second level (occurrences and lengths).

Nothing is dropped but by bounds, so results are those of scoring all. A shard's task holds its own arrays and one
item's sums; what shards let go is about k rows an item, or as many as tie with the k-th (copies). Ranks are windows over
those, of which each partition sends k an item at most.

Weights and impacts are whole numbers by the formulas of ``search``; products that might not fit 64 bits (the length
times the number of documents) are done in Python, once for each different length.

Cases: null and empty texts have no terms and match nothing; a null id is an id, the last among equal scores; rows of one
id are ranked each, ties in the order of the index; each row of items is an item of its own, with or without an id;
an item without terms has no results; terms are compared whole, however long; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm import staging
from quire.llm.importance import words_of
from quire.plans.cut import numbered

#: Maximal runs of ASCII letters, digits and all beyond ASCII, in bytes whose A-Z are lower-cased; and what separates them.
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: A shard ends with the document that reaches one of these; numbers of documents within a shard take 16 bits.
SHARD_DOCS, SHARD_BYTES = 8192, 32 << 20
#: A long text is cut into pieces of so many bytes, at gaps.
PIECE = 1 << 20
#: Impacts per step of a byte: 255 of them are a million, which no impact reaches.
STEP = 3922
#: Saturation and length normalisation, in hundredths where whole numbers are needed.
PROBE = 64
#: Bytes of terms and weights that are broadcast at once, and of a term beside its text.
SET_BYTES, ENTRY = 16 << 20, 64

_POSTED = "shard long, term string, docs binary, tfs binary, lens binary, holding long, total long"


@dataclass
class Index:
    """exact: (shard, term, docs, tfs, lens, holding, total, ids); quantised: (shard, term, docs, impacts); n documents with terms, which have ``length`` terms."""

    exact: DataFrame
    quantised: DataFrame
    n: int
    length: int


class _Shard:
    def __init__(self) -> None:
        self.codes: dict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list[pa.Array] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        data, at, found = text.lower(), 0, []  # bytes.lower() changes A-Z alone
        while at < len(data):
            gap = GAP.search(data, at + PIECE)
            end = gap.start() if gap else len(data)
            terms = TERM.findall(data, at, end)
            found.append(np.fromiter(map(self.codes.__getitem__, terms), np.uint32, len(terms)))
            at = end
        self.found.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint32),) * 2)
        self.size += len(data)

    def full(self) -> bool:
        return len(self.found) >= SHARD_DOCS or self.size >= SHARD_BYTES

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        counts = np.array([len(c) for c, _ in self.found], np.int64)
        lens = np.array([int(n.sum()) for _, n in self.found], np.uint32)
        ids = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.concat_arrays(self.ids))
        head = [[number], [None], [None], [None], [lens.tobytes()], [int((lens > 0).sum())], [int(lens.sum(dtype=np.int64))], ids]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(head, schema)], schema=schema)
        code = np.concatenate([c for c, _ in self.found])
        order = np.argsort(code, kind="stable")
        doc = np.repeat(np.arange(len(counts), dtype=np.uint16), counts)[order]
        tf = np.concatenate([n for _, n in self.found]).astype(np.uint32)[order]
        starts = np.searchsorted(code[order], np.arange(len(self.codes) + 1))
        names = pa.array([t.decode() for t in self.codes], pa.string())
        for a in range(0, len(names), 20_000):
            b = min(a + 20_000, len(names))
            cut, s = slice(starts[a], starts[b]), starts[a : b + 1] - starts[a]
            nothing = lambda t: pa.nulls(b - a, t)  # noqa: B023, E731
            columns = [pa.array(np.full(b - a, number)), names[a:b], _packed(doc[cut], s), _packed(tf[cut], s), _packed(lens[doc[cut]], s)]
            yield pa.RecordBatch.from_arrays([*columns, *[nothing(f.type) for f in list(schema)[5:]]], schema=schema)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """values as one binary for each of the stretches between starts."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a binary column that has no nulls, one after the other."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.empty(0, kind)


def impacts(tf: np.ndarray, lens: np.ndarray, n: int, total: int, b: int) -> np.ndarray:
    """Whole numbers below a million: 10**9 tf div (1000 tf + 8 m), m = 100 - b + b * length * n div total."""
    different, place = np.unique(lens, return_inverse=True)
    m = np.array([100 - b + (b * int(x) * n) // total for x in different], np.int64)[place]
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", b: int = 75) -> Index:
    """The index of all rows of docs, written to the shared folder; b: how much length counts, in hundredths."""
    spark = docs.sparkSession
    staging.reachable(spark)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("tfs", pa.binary()), ("lens", pa.binary()), ("holding", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(to_arrow_type(kind)))])

    def shards(batches):
        first, held, done = TaskContext.get().partitionId() << 32, _Shard(), 0
        for batch in staging.pieces(batches):
            at = 0
            for i, body in enumerate(batch.column(1)):
                held.add(body.as_py())
                if held.full():
                    held.ids.append(batch.column(0)[at : i + 1])
                    yield from held.rows(first + done, schema)
                    held, done, at = _Shard(), done + 1, i + 1
            held.ids.append(batch.column(0)[at:])
        if held.found:
            yield from held.rows(first + done, schema)

    exact = staging.table(rows.mapInArrow(shards, f"{_POSTED}, ids array<{kind.simpleString()}>"), "postings")
    of_all = exact.filter("term IS NULL").agg(F.coalesce(F.sum("holding"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("length")).first()
    n, length = int(of_all.n), int(of_all.length)

    def bytes_of(batches):
        for batch in batches:
            impact = impacts(_flat(batch.column(3), "<u4"), _flat(batch.column(4), "<u4"), n, length, b)
            starts = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(2)).to_numpy() // 2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _packed((-(-impact // STEP)).astype(np.uint8), starts)], ["shard", "term", "docs", "impacts"])

    posted = exact.filter("term IS NOT NULL").select("shard", "term", "docs", "tfs", "lens")
    return Index(exact, staging.table(posted.mapInArrow(bytes_of, "shard long, term string, docs binary, impacts binary"), "quantised"), n, length)


def _asked(items: DataFrame, item: str, text: str, index: Index, set_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(no, item_id), written, and (block, term, bytes, asks: array of (item, weight)), written; weight times its repeats."""
    own = items.select(F.monotonically_increasing_id().alias("no"), F.col(f"`{item}`").alias("item_id"), words_of(F.col(f"`{text}`").cast("string")).alias("w"))
    own = staging.table(own, "items")
    terms = own.select("no", F.explode("w").alias("term")).groupBy("no", "term").agg(F.count("*").alias("times"))
    terms = staging.table(terms, "terms")
    sizes = terms.groupBy("no").agg(F.sum(F.octet_length("term") + ENTRY).alias("bytes"))
    blocks = numbered(sizes, "no", name="before", size=F.col("bytes")).select("no", F.floor(F.col("before") / set_bytes).alias("block"))
    held = index.quantised.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * index.n + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighed = terms.join(held.withColumn("weight", weight).filter("weight > 0"), "term").join(blocks, "no")
    asks = weighed.groupBy("block", "term").agg(F.collect_list(F.struct(F.col("no").alias("item"), (F.col("weight") * F.col("times")).alias("weight"))).alias("asks"))
    return own.select("no", "item_id"), staging.table(asks, "asked")


def _by_item(asks: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each item its terms in a shard, as (row, weight)."""
    flat = pc.list_flatten(asks)
    rows, items, weights = pc.list_parent_indices(asks).to_numpy(), flat.field("item").to_numpy(), flat.field("weight").to_numpy()
    order = np.argsort(items, kind="stable")
    cuts = np.flatnonzero(np.diff(items[order], prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(order)]):
        yield int(items[order[a]]), list(zip(rows[order[a:z]].tolist(), weights[order[a:z]].tolist()))


def _bounds(rows: DataFrame, k: int) -> DataFrame:
    """rows (shard, docs, impacts, asks, floor: array of (item, bound)) -> (item, shard, doc, upper, lower) of what may be among the k best."""
    schema = pa.schema([("item", pa.int64()), ("shard", pa.int64()), ("doc", pa.int32()), ("upper", pa.int64()), ("lower", pa.int64())])

    def bounds(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs = [np.frombuffer(x, "<u2") for x in table["docs"].to_pylist()]
        marks = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table["impacts"].to_pylist()]
        out = []
        for item, terms in _by_item(table["asks"].combine_chunks()):
            size = max(int(docs[r][-1]) for r, _ in terms) + 1
            upper, lower = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for r, weight in terms:
                upper[docs[r]] += weight * STEP * marks[r]
                lower[docs[r]] += weight * STEP * np.maximum(marks[r] - 1, 0)
            at = np.flatnonzero(upper)
            if len(at) > k:
                at = at[upper[at] >= np.partition(lower[at], len(at) - k)[len(at) - k]]
            out.append((np.full(len(at), item), at, upper[at], lower[at]))
        if not out:
            return schema.empty_table()
        item, doc, upper, lower = (np.concatenate(x) for x in zip(*out))
        shard = np.full(len(doc), table["shard"][0].as_py())
        return pa.table([item, shard, doc.astype(np.int32), upper, lower], schema=schema)

    return rows.groupBy("shard").applyInArrow(bounds, "item long, shard long, doc int, upper long, lower long")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(item, least): the k-th highest lower bound of each item that has so many."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))
    return found.select("item", "lower", place.alias("place")).filter(F.col("place") <= k).filter(F.col("place") == k).select("item", F.col("lower").alias("least"))


def _exact(found: DataFrame, rows: DataFrame, index: Index, b: int, key: str) -> DataFrame:
    """(item, shard, doc, id, score) of found (item, shard, doc), from rows (shard, docs, tfs, lens, asks, ids)."""
    n, length = index.n, index.length

    def score(wanted: pa.Table, posted: pa.Table) -> pa.Table:
        wanted, posted = wanted.combine_chunks(), posted.combine_chunks()
        heads = posted.filter(pc.is_valid(posted["ids"]))
        kind = heads.schema.field("ids").type.value_type
        schema = pa.schema([("item", pa.int64()), ("shard", pa.int64()), ("doc", pa.int32()), ("id", kind), ("score", pa.int64())])
        if not wanted.num_rows:
            return schema.empty_table()
        posted = posted.filter(pc.is_null(posted["ids"])).combine_chunks()
        columns = [posted[c].to_pylist() for c in ("docs", "tfs", "lens")]
        terms = dict(_by_item(posted["asks"].combine_chunks()))
        wanted = wanted.sort_by([("item", "ascending"), ("doc", "ascending")])
        items, docs = wanted["item"].to_numpy(), wanted["doc"].to_numpy()
        total = np.zeros(len(docs), np.int64)
        cuts = np.flatnonzero(np.diff(items, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(items)]):
            for r, weight in terms[int(items[a])]:
                here = np.frombuffer(columns[0][r], "<u2")
                at = np.minimum(np.searchsorted(here, docs[a:z]), len(here) - 1)
                hit = np.flatnonzero(here[at] == docs[a:z])
                tf, lens = (np.frombuffer(columns[c][r], "<u4")[at[hit]] for c in (1, 2))
                total[a + hit] += weight * impacts(tf, lens, n, length, b)
        ids = pc.list_flatten(heads["ids"].combine_chunks()).take(pa.array(docs))
        return pa.table([items, wanted["shard"], docs, ids, total], schema=schema)

    out = f"item long, shard long, doc int, id {key}, score long"
    return found.select("item", "shard", "doc").groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(score, out)


def search(index: Index, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text", b: int = 75, set_bytes: int = SET_BYTES, probe: int = PROBE) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k highest scores above 0, equal ones by ascending doc_id.

    A term in df of n documents weighs floor(1000 ln((2n + 2) / (2 df + 1))); a score adds weight times impact over an
    item's terms, repeats included. b as the index was built with.
    """
    staging.reachable(items.sparkSession)
    key = index.exact.schema["ids"].dataType.elementType.simpleString()
    names, asked = _asked(items, item, text, index, set_bytes)
    heads = index.exact.filter("ids IS NOT NULL")
    chosen = heads.select("shard").orderBy(F.xxhash64("shard"), "shard").limit(probe)
    scored = None
    sizes = asked.groupBy("block").agg(F.sum(F.octet_length("term") + F.size("asks") * 16 + ENTRY).alias("bytes")).orderBy("block").collect()
    for block in sizes:
        own = asked.filter(F.col("block") == block.block).select("term", "asks")
        own = F.broadcast(own) if block.bytes <= 4 * set_bytes else own
        first = index.quantised.join(own, "term")
        floor = staging.table(_kth(_bounds(first.join(F.broadcast(chosen), "shard", "left_semi"), k), k), "floor")
        found = _bounds(first, k).join(floor, "item", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least")
        found = staging.table(found, "bounds")
        found = found.join(_kth(found, k), "item", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
        posted = index.exact.join(own, "term").select("shard", "docs", "tfs", "lens", "asks", F.lit(None).cast(f"array<{key}>").alias("ids"))
        tops = heads.select("shard", *[F.lit(None).cast(t).alias(c) for c, t in (("docs", "binary"), ("tfs", "binary"), ("lens", "binary"))], F.lit(None).cast(own.schema["asks"].dataType).alias("asks"), "ids")
        part = staging.table(_exact(found, posted.unionByName(tops), index, b, key), "scores")
        scored = part if scored is None else scored.unionAll(part)
    if scored is None:
        return names.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(key).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "shard", "doc"))
    best = scored.filter("score > 0").withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(names, best["item"] == names["no"]).select("item_id", "rank", F.col("id").alias("doc_id"), "score")

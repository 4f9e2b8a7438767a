"""Line deduplication across documents (operator 7).

A sharded minimal perfect hash over the distinct line hashes that documents share indexes compact arrays: the
fingerprint, the count of documents and the first document of each line. Documents probe the arrays; lines are never
joined. Rows are dealt to blocks by a hash of id and text, so a line of any frequency sends one entry from each block to
its shard and gets one answer back, whatever the number of documents that hold it. The number of blocks and shards
follows the number of lines.

Lines are known by 128 bits of hash, all of which are the fingerprint. The perfect hash takes 64 bits mixed from them;
lines that tie there go to a list beside the arrays, so that none is lost.

Cases: a null or empty text is one empty line; rows of the same doc_id are one document, so a line that only they
hold stays; a null doc_id counts as one document before all others; lines in the first document holding them stay, all
of them; texts are whole; no documents give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.columns import own as col
from quire.llm.mph import MinimalPerfectHash, mix

BLANKS = " \t\n\x0b\x0c\r"
LEAST = 10
#: Lines that a block or a shard is meant to hold.
BLOCK_LINES = 2_000_000
#: What a block tells a shard of a line, and what a shard answers. first, last: of the documents that hold it; count: of
#: these, added up over blocks (a document whose rows lie in several blocks counts in each).
TOLD = np.dtype([("hash", "<u8"), ("print", "<u8"), ("first", "<i8"), ("last", "<i8"), ("count", "<i8")])
NAME = np.dtype([("hash", "<u8"), ("print", "<u8")])
NULL_ID = -(2**63)
_SEEN = 50_000


def line_keys(text: str | None, least: int = LEAST) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text and the hash of each key, None for keys too short to count."""
    lines = (text or "").split("\n")
    keys = [line.strip(BLANKS) for line in lines]
    return lines, [xxhash.xxh3_128_digest(k.encode().lower()) if len(k) >= least else None for k in keys]


def _schema(*fields: str) -> str:
    kinds = {"block": "int", "shard": "int", "doc_id": "long", "h": "long", "n": "int"}
    return ", ".join(f"{f} {kinds.get(f, 'binary')}" for f in fields)


def _batch(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    pairs = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, pairs)], [n for n, _ in pairs])


def merged(told: np.ndarray) -> np.ndarray:
    """One entry for each line: its first and last document and its count, over entries of several blocks."""
    told = told[np.lexsort((told["print"], told["hash"]))]
    new = np.ones(len(told), bool)
    new[1:] = (told["hash"][1:] != told["hash"][:-1]) | (told["print"][1:] != told["print"][:-1])
    out = told[new].copy()
    if len(told):
        at = np.flatnonzero(new)
        for name, of in (("first", np.minimum), ("last", np.maximum), ("count", np.add)):
            out[name] = of.reduceat(told[name], at)
    return out


def _row_hash(key: str, text: str):
    return F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), F.col(text))


def hashed_lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc_id, h, n, lines): the distinct 16-byte line hashes of each row that has any; h: a hash of id and text.

    Rows of one id and text add nothing, so a worker leaves out those that it remembers.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in staging.pieces(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for k, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, h) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add((k, h))
                if own := {x for x in line_keys(t, least)[1] if x}:
                    for column, value in zip(out, (k, h, len(own), b"".join(own))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "h", "n", "lines"])

    k = F.coalesce(col(key).cast("long"), F.lit(NULL_ID))
    rows = docs.select(k.alias("doc_id"), col(text).cast("string").alias("text"))
    return rows.select("doc_id", _row_hash("doc_id", "text").alias("h"), "text").mapInArrow(run, _schema("doc_id", "h", "n", "lines"))


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit names of all lines of a block's rows, and the row of each."""
    raw = rows.column("lines").to_pylist()
    return np.frombuffer(b"".join(raw), NAME), np.repeat(np.arange(len(raw)), [len(r) // 16 for r in raw])


def told_by_blocks(lines: DataFrame, shards: int) -> DataFrame:
    """(block, shard, told): the lines of a block for each shard, each line once."""
    schema = _schema("block", "shard", "told")

    def run(rows: pa.Table) -> pa.Table:
        names, row = _entries(rows)
        each = np.zeros(len(names), TOLD)
        each["hash"], each["print"], each["count"] = names["hash"], names["print"], 1
        each["first"] = each["last"] = rows.column("doc_id").to_numpy()[row]
        own = merged(np.unique(each))  # rows of one doc_id are one document
        shard = (own["hash"] % np.uint64(shards)).astype(np.int64)
        own = own[np.argsort(shard, kind="stable")]
        ends = np.cumsum(np.bincount(shard, minlength=shards))
        parts = [(s, own[a:b].tobytes()) for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if b > a]
        block = rows.column("block")[0].as_py()
        return _batch(schema, [[block] * len(parts), [s for s, _ in parts], [p for _, p in parts]])

    return lines.groupBy("block").applyInArrow(run, schema)


class Index:
    """The lines of a shard that two documents hold or more."""

    def __init__(self, mph: MinimalPerfectHash, slots: np.ndarray, rest: np.ndarray):
        """slots: entries by the slots of the perfect hash; rest: those whose key another entry has, sorted by name."""
        self.mph, self.at, self.rest = mph, slots, rest

    @staticmethod
    def keys(entries: np.ndarray) -> np.ndarray:
        """64 bits mixed from all 128."""
        return mix(entries["hash"] ^ mix(entries["print"], 1), 2)

    @classmethod
    def build(cls, entries: np.ndarray, keys: np.ndarray | None = None) -> "Index":
        """entries: different ones, sorted by name. keys: Index.keys but in tests."""
        keys = cls.keys(entries) if keys is None else keys
        one = np.unique(keys, return_index=True)[1]
        alone = np.zeros(len(entries), bool)
        alone[one] = True
        mph = MinimalPerfectHash.build(keys[one])
        held = np.zeros(len(one), TOLD)
        held[mph.slots(keys[one])] = entries[one]
        return cls(mph, held, entries[~alone])

    def first(self, asked: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which of the entries asked for are held, and their first documents."""
        slots = self.mph.slots(self.keys(asked) if keys is None else keys)
        there, first = np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        for at, found in ((np.flatnonzero(slots >= 0), lambda x: self.at[slots[x]]), (np.arange(len(asked) if len(self.rest) else 0), self._in_rest(asked))):
            own = found(at)
            same = (own["hash"] == asked["hash"][at]) & (own["print"] == asked["print"][at])
            there[at[same]], first[at[same]] = True, own["first"][same]
        return there, first

    def _in_rest(self, asked: np.ndarray):
        names = lambda x: x[["hash", "print"]].astype(NAME)
        return lambda at: self.rest[np.minimum(np.searchsorted(names(self.rest), names(asked[at])), len(self.rest) - 1)]

    def to_row(self) -> list[bytes]:
        """mph, hashes, prints, counts, firsts, rest."""
        own = self.at
        return [self.mph.to_bytes(), own["hash"].tobytes(), own["print"].tobytes(), np.minimum(own["count"], 2**32 - 1).astype("<u4").tobytes(), own["first"].tobytes(), self.rest.tobytes()]

    @classmethod
    def from_row(cls, mph: bytes, hashes: bytes, prints: bytes, counts: bytes, firsts: bytes, rest: bytes) -> "Index":
        own = np.zeros(len(hashes) // 8, TOLD)
        own["hash"], own["print"], own["count"], own["first"] = (np.frombuffer(x, k) for x, k in ((hashes, "<u8"), (prints, "<u8"), (counts, "<u4"), (firsts, "<i8")))
        return cls(MinimalPerfectHash.from_bytes(mph), own, np.frombuffer(rest, TOLD))


_INDEX = ("mph", "hashes", "prints", "counts", "firsts", "rest")


def build_index(told: DataFrame) -> DataFrame:
    """(shard, mph, hashes, prints, counts, firsts, rest): arrays by the slots of a perfect hash over lines of two documents or more."""
    schema = _schema("shard", *_INDEX)

    def run(rows: pa.Table) -> pa.Table:
        every = merged(np.concatenate([np.frombuffer(r, TOLD) for r in rows.column("told").to_pylist()]))
        index = Index.build(every[every["first"] < every["last"]])
        return _batch(schema, [[rows.column("shard")[0].as_py()], *([x] for x in index.to_row())])

    return told.groupBy("shard").applyInArrow(run, schema)


def probe(told: DataFrame, index: DataFrame) -> DataFrame:
    """(block, held): of the lines a block asked for, those that the index has, with their first document."""
    schema = _schema("block", "held")

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(shard):
            return _batch(schema, [[], []])
        own_index = Index.from_row(*(shard.column(c)[0].as_py() for c in _INDEX))
        blocks, out = [], []
        for block, raw in zip(asked.column("block").to_pylist(), asked.column("told").to_pylist()):
            own = np.frombuffer(raw, TOLD)
            there, first = own_index.first(own)
            if there.any():
                own = own[there].copy()
                own["first"] = first[there]
                blocks.append(block)
                out.append(own.tobytes())
        return _batch(schema, [blocks, out])

    return told.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, schema)


def repeats(lines: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, h, lines): the line hashes that the rows of that id and hash have to drop."""
    schema = _schema("doc_id", "h", "lines")

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows) or not len(answers):
            return _batch(schema, [[], [], []])
        known = np.concatenate([np.frombuffer(r, TOLD) for r in answers.column("held").to_pylist()])
        names, row = _entries(rows)
        every, code = np.unique(np.concatenate([known[["hash", "print"]].astype(NAME), names]), return_inverse=True)
        first, there = np.zeros(len(every), np.int64), np.zeros(len(every), bool)
        first[code[: len(known)]], there[code[: len(known)]] = known["first"], True
        ids, hs = rows.column("doc_id").to_numpy(), rows.column("h").to_numpy()
        code = code[len(known) :]
        drop = there[code] & (first[code] != ids[row])
        pairs, which = np.unique(np.stack([ids, hs], 1), axis=0, return_inverse=True)  # rows of one id and text
        owner, gone = which.ravel()[row[drop]], names[drop]
        order = np.argsort(owner, kind="stable")
        owner, starts = np.unique(owner[order], return_index=True)
        parts = [p.tobytes() for p in np.split(gone[order], starts[1:])] if len(owner) else []
        return _batch(schema, [pairs[owner, 0].tolist(), pairs[owner, 1].tolist(), parts])

    return lines.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(run, schema)


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, digests: bool = False, counts: bool = True) -> DataFrame:
    """All columns of docs with the text less its repeated lines, and n_lines and n_dropped (without counts: not these).

    Columns of docs that have the names of what is added give way to it.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``least`` code
    points that two documents hold lose their lines everywhere but in the smallest key (doc_id) holding them.
    digests: key, n_lines, n_dropped and kept_sha256 instead.
    """
    spark = docs.sparkSession
    staging.reachable(spark)
    lines = staging.table(hashed_lines(docs, key, text, least), "lines")
    blocks = staging.parts(spark, lines.agg(F.sum("n")).first()[0] or 0, BLOCK_LINES)
    lines = lines.select(F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "h", "lines")
    told = staging.table(told_by_blocks(lines, blocks), "told")
    index = staging.table(build_index(told), "line-index")
    drops = repeats(lines, probe(told, index)).select(F.col("doc_id").alias("_drop_id"), F.col("h").alias("_drop_h"), F.col("lines").alias("_drops"))
    kept = [col(c) for c in (docs.columns if not digests else [key])]
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(kept)], col(text).cast("string").alias("_text"), F.coalesce(col(key).cast("long"), F.lit(NULL_ID)).alias("_id"))
    rows = rows.withColumn("_h", _row_hash("_id", "_text"))
    joined = rows.join(drops, (F.col("_id") == F.col("_drop_id")) & (F.col("_h") == F.col("_drop_h")), "left").drop("_id", "_drop_id", "_h", "_drop_h")
    names = [key] if digests else docs.columns
    place = names.index(text) if text in names else -1
    fields = [docs.schema[c] for c in names]
    out = ", ".join(f"`c{i}` {f.dataType.simpleString() if i != place else 'string'}" for i, f in enumerate(fields)) + ", n_lines long, n_dropped long" + ", kept_sha256 string" * digests

    def run(batches):
        for batch in staging.pieces(batches):
            width = batch.num_columns - 2
            columns, counts, dropped, texts = [batch.column(i) for i in range(width)], [], [], []
            for t, raw in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()):
                if raw is None:
                    counts.append((t or "").count("\n") + 1)
                    dropped.append(0)
                    texts.append(t or "")
                    continue
                gone = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                own, hashes = line_keys(t, least)
                stay = [line for line, h in zip(own, hashes) if h not in gone]
                counts.append(len(own))
                dropped.append(len(own) - len(stay))
                texts.append("\n".join(stay))
            tail = [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            if digests:
                tail.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]))
            elif place >= 0:
                columns[place] = pa.array(texts, pa.string())
            names_ = [*(f"c{i}" for i in range(width)), "n_lines", "n_dropped", *["kept_sha256"] * digests]
            yield pa.RecordBatch.from_arrays([*columns, *tail], names_)

    made = joined.mapInArrow(run, out)
    if not counts:
        return made.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
    tail = ["n_lines", "n_dropped", *["kept_sha256"] * digests]
    stay = [i for i, c in enumerate(names) if c not in tail]
    return made.select(*[f"c{i}" for i in stay], *tail).toDF(*[names[i] for i in stay], *tail)

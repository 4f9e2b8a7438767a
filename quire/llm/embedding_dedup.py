"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors (operator 8).

A unit vector x is rotated at random and kept as the signs of its coordinates, c = sign(Rx) / sqrt(d), with the factor
f = <c, Rx>. For any unit y, <c, Ry> / f estimates <x, y> without bias, off by at most e = EPSILON * sqrt((1 - f*f) /
(f*f * (d - 1))) but for a chance that falls with exp(-EPSILON**2). Ry is kept at four bits a coordinate, rounded with a
random dither, which leaves the estimate unbiased and adds EPSILON * step / (sqrt(2) * f) to e. A pair is computed
exactly, in double precision, only if estimate + e reaches the threshold; what is then below it is no link.

Codes, factors and the hash keys below are computed once, into a table. Pairs are looked for in hash tables keyed by k
sign bits of further random rotations, within a label. k follows the number n of different vectors of the largest label,
and the number of tables makes a pair at the threshold miss all of them with a chance of ``MISS``. A pair counts in the
first table in which it meets. The codes alone travel to the lists of all tables; a vector follows only to those lists in
which the bounds let a pair of its pass. Equal vectors fold into one with a count beforehand. Lists of over ``TILE``
vectors are split into tiles, pairs of blocks, that different tasks work on; each task works through its lists one after
the other and gives out sums of links and a spanning forest, never the pairs.

Cases: a null label, a null, empty or zero vector, and one with null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows, rows of one vec_id and rows without one are vectors of their own; component_id
is the smallest vec_id that is there, and null where a component has none - of such a component one row is kept; no rows
give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quire.llm import staging
from quire.llm.components import components, forest
from quire.llm.mph import mix

THRESHOLD, EPSILON, MISS, TILE, SEED = 0.98, 4.0, 1e-4, 4096, 20240229
#: Postings that a task is meant to work through, and how many it holds at once, but for one list.
TASK_ROWS, HELD = 500_000, 8192
#: A list's number has the table in its lowest bits.
_TABLE_BITS = 10
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, number: int) -> np.ndarray:
    """A random rotation of d dimensions, the same for a number everywhere."""
    if (d, number) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).standard_normal((d, d)))
        _rotations[d, number] = q * np.sign(np.diag(r))
    return _rotations[d, number]


def dither(d: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).random(d)


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Sign bits of a key and number of tables for n vectors."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 2)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def table_signs(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables, bits): the signs that make up the key of each vector in each table."""
    d = units.shape[1]
    turns = -(-bits * tables // d)
    signs = np.concatenate([units @ rotation(d, 1 + t).T > 0 for t in range(turns)], axis=1)[:, : bits * tables]
    return signs.reshape(len(units), tables, bits)


def table_keys(signs: np.ndarray) -> np.ndarray:
    """(vectors, tables)"""
    return signs @ (np.uint64(1) << np.arange(signs.shape[2], dtype=np.uint64))


def record(d: int, bits: int, tables: int) -> np.dtype:
    """What is stored and sent of a vector of d components."""
    return np.dtype([
        ("d", "<i4"), ("n", "<i8"), ("id", "<i8"), ("factor", "<f4"), ("low", "<f4"), ("step", "<f4"),
        ("code", "u1", -(-d // 8)), ("fine", "u1", -(-d // 2)), ("keys", "u1", -(-bits * tables // 8)),
    ])


def encoded(units: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The records of unit vectors, and their keys in each table."""
    d = units.shape[1]
    out, signs = np.zeros(len(units), record(d, bits, tables)), table_signs(units, bits, tables)
    rotated = units @ rotation(d, 0).T
    out["d"], out["n"], out["id"] = d, counts, ids
    out["code"] = np.packbits(rotated >= 0, axis=1)
    out["factor"] = np.abs(rotated).sum(axis=1) / math.sqrt(d)
    out["low"] = rotated.min(axis=1)
    out["step"] = np.maximum((rotated.max(axis=1) - out["low"]) / 14, 1e-9) * (1 + 1e-6)
    level = np.clip(np.floor((rotated - out["low"][:, None].astype(np.float64)) / out["step"][:, None] + dither(d)), 0, 15).astype(np.uint8)
    padded = np.concatenate([level, np.zeros((len(units), d % 2), np.uint8)], axis=1)
    out["fine"] = padded[:, ::2] << 4 | padded[:, 1::2]
    out["keys"] = np.packbits(signs.reshape(len(units), -1), axis=1)
    return out, table_keys(signs)


class Codes:
    """Signs, correction factors and error bounds, from stored records of one length."""

    def __init__(self, rec: np.ndarray, bits: int, tables: int, epsilon: float = EPSILON):
        d = int(rec["d"][0]) if len(rec) else 1
        self.signs = np.unpackbits(rec["code"], axis=1, count=d).astype(np.float32) * 2 - 1
        level = np.stack([rec["fine"] >> 4, rec["fine"] & 15], axis=2).reshape(len(rec), -1)[:, :d]
        self.rotated = rec["low"][:, None] + rec["step"][:, None] * level.astype(np.float32)
        factor = rec["factor"].astype(np.float64)
        self.scale = 1 / (math.sqrt(d) * factor)
        spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor
        self.error = epsilon * spread / math.sqrt(d - 1) + 1e-5 if d > 1 else np.full(len(rec), np.inf)
        self.blur, self.factor = epsilon * rec["step"].astype(np.float64) / math.sqrt(2), factor
        self.keys = table_keys(np.unpackbits(rec["keys"], axis=1, count=bits * tables).reshape(len(rec), tables, bits).astype(bool))

    def upper(self, i: slice, j: slice) -> np.ndarray:
        """Upper confidence bounds of the inner products of two ranges of vectors."""
        return (self.signs[i] @ self.rotated[j].T) * self.scale[i, None] + self.error[i, None] + self.blur[None, j] / self.factor[i, None]

    def upper_of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same of pairs."""
        return np.einsum("nd,nd->n", self.signs[i], self.rotated[j]) * self.scale[i] + self.error[i] + self.blur[j] / self.factor[i]


def passing(bucket: np.ndarray, side: np.ndarray, codes: Codes, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within each bucket, a sorted column, whose bounds reach the threshold and that meet here first.

    side: pairs need two of them, -1 any.
    """
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    sizes = np.diff(edge)
    table = bucket & (2**_TABLE_BITS - 1)

    def some(i, j):
        fine = (side[i] < 0) | (side[i] != side[j])
        i, j = i[fine], j[fine]
        first = (codes.keys[i] == codes.keys[j]).argmax(axis=1) == table[i]
        return i[first], j[first]

    short = sizes <= 32
    for step in range(1, 32):  # short lists, all at once
        begin, size = edge[:-1][short & (sizes > step)], sizes[short & (sizes > step)]
        if not len(begin):
            break
        i = np.arange(int((size - step).sum())) + np.repeat(begin - (np.cumsum(size - step) - (size - step)), size - step)
        for a in range(0, len(i), 50_000):
            x, y = i[a : a + 50_000], i[a : a + 50_000] + step
            fine = codes.upper_of(x, y) >= threshold
            yield some(x[fine], y[fine])
    for k in np.flatnonzero(~short).tolist():
        low, high = int(edge[k]), int(edge[k + 1])
        for a in range(low, high, 256):
            x, y = np.nonzero(codes.upper(slice(a, min(a + 256, high)), slice(a, high)) >= threshold)
            x, y = x + a, y + a
            yield some(x[x < y], y[x < y])


def _lists(batches, columns: int) -> Iterator[list[list]]:
    """Rows of a partition sorted by bucket, the first column, in portions of whole lists; lists of one are left out."""
    held: list[list] = [[] for _ in range(columns)]
    for batch in batches:
        for column, own in zip(held, batch.columns):
            column += own.to_pylist()
        if len(held[0]) >= HELD and held[0][0] != held[0][-1]:
            cut = held[0].index(held[0][-1])  # the last list may go on
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held[0]:
        yield held


def _several(portion: list[list]) -> list[list]:
    """Without lists of one."""
    bucket = np.array(portion[0], np.int64)
    same = bucket[1:] == bucket[:-1]
    more = np.flatnonzero(np.append(same, False) | np.append(False, same))
    return [[c[i] for i in more.tolist()] for c in portion]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    n_links counts the other vectors of cosine ``threshold`` or more under the same label; component_id is the smallest
    vec_id that links reach, itself included; kept marks the rows that are that vector.
    """
    spark = vectors.sparkSession
    staging.reachable(spark)
    kind = np.dtype("<f4") if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else np.dtype("<f8")

    def pack(batches):
        for batch in staging.pieces(batches):
            out = []
            for values, named in zip(batch.column(2), batch.column(3).is_valid().to_pylist()):
                raw = None
                if named and values.is_valid and len(values.values) and not values.values.null_count:
                    own = values.values.to_numpy(zero_copy_only=False).astype(kind)
                    wide = own.astype(np.float64)
                    # The largest component scales first, so that the squares can neither overflow nor vanish.
                    if np.isfinite(wide).all() and np.abs(wide).max() > 0:
                        raw = own.tobytes()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], ["row", "id", "label", "v"])

    name = vectors.schema[label].dataType.simpleString()
    own = vectors.select(F.monotonically_increasing_id().alias("row"), vectors[key].cast("long").alias("id"), vectors[vector].alias("v"), vectors[label].alias("label"))
    rows = staging.table(own.mapInArrow(pack, f"row long, id long, label {name}, v binary"), "rows")
    folded = rows.filter("v is not null").groupBy("label", "v").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.count("*").alias("n"))
    # A class of equal vectors is known by its first row.
    classes = staging.table(folded.select("row", "label", "v", "least", "n"), "vectors")
    total = classes.count()
    bits, tables = tables_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, threshold)

    def units_of(raw: list[bytes]) -> np.ndarray:
        own = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
        own = own / np.abs(own).max(axis=1, keepdims=True)
        return own / np.sqrt(np.einsum("nd,nd->n", own, own))[:, None]

    def by_length(raw: list[bytes]):
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes).tolist():
            yield size, np.flatnonzero(sizes == size)

    def encode(batches):
        for batch in staging.pieces(batches):
            raw, place = batch.column(2).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            ids, counts = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for size, at in by_length(raw):
                rec, keys = encoded(units_of([raw[i] for i in at]), ids[at], counts[at], bits, tables)
                own = mix(place[at] ^ np.uint64(size), 99)[:, None]
                number = np.stack([mix(keys[:, t], t) for t in range(tables)], 1) ^ own
                bucket = (number << np.uint64(_TABLE_BITS) | np.arange(tables, dtype=np.uint64)).view(np.int64)
                width = rec.itemsize
                packed = rec.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(bucket), pa.list_(pa.int64())), pa.array([packed[i : i + width] for i in range(0, len(packed), width)], pa.binary())], ["buckets", "p"])

    hashed = classes.select("row", F.xxhash64("label").alias("place"), "v", "n")
    codes = staging.table(hashed.mapInArrow(encode, "buckets array<long>, p binary"), "codes")
    posted = codes.select(F.explode("buckets").alias("bucket"), F.lit(-1).alias("side"), "p")
    sizes = staging.table(codes.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().filter(F.col("count") > tile), "lists")
    if sizes.limit(1).count():
        half = F.ceil(F.col("count") / F.lit(tile // 2)).cast("int")
        split = posted.join(sizes, "bucket", "left").withColumn("of", F.coalesce(half, F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("p"), F.col("of")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        table = F.col("bucket").bitwiseAND(F.lit(2**_TABLE_BITS - 1))
        tile_of = F.shiftleft(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")), _TABLE_BITS).bitwiseOR(table)
        whole = F.col("of") == 1
        posted = split.select(F.when(whole, F.col("bucket")).otherwise(tile_of).alias("bucket"), F.when(whole | (F.col("mine") == F.col("other")), F.lit(-1)).otherwise(F.col("mine")).alias("side"), "p")
    parts = staging.parts(spark, total * tables, TASK_ROWS)

    def portions(batches, columns: int):
        """Lists of two or more, as (bucket, side, records, other columns), the records of one length."""
        for portion in _lists(batches, columns):
            bucket, side, p, *more = _several(portion)
            for size, at in by_length(p) if p else ():
                d = int.from_bytes(p[at[0]][:4], "little")
                rec = np.frombuffer(b"".join(p[i] for i in at), record(d, bits, tables))
                yield np.array(bucket, np.int64)[at], np.array(side, np.int64)[at], rec, [[c[i] for i in at] for c in more]

    def want(batches):
        for bucket, side, rec, _ in portions(batches, 3):
            asked = np.zeros(len(rec), bool)
            for i, j in passing(bucket, side, Codes(rec, bits, tables), threshold):
                asked[i] = asked[j] = True
            at = np.flatnonzero(asked)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(side[at].astype(np.int32)), pa.array(rec["id"][at]), pa.array([rec[i].tobytes() for i in at.tolist()], pa.binary())], ["bucket", "side", "row", "p"])

    def link(batches):
        for bucket, side, rec, (raw,) in portions(batches, 4):
            units, ids, count = units_of(raw), rec["id"].astype(np.int64), rec["n"].astype(np.int64)
            weight, pairs = np.zeros(len(rec), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, j in passing(bucket, side, Codes(rec, bits, tables), threshold):
                for a in range(0, len(i), 50_000):
                    x, y = i[a : a + 50_000], j[a : a + 50_000]
                    exact = np.einsum("nd,nd->n", units[x], units[y]) >= threshold
                    x, y = x[exact], y[exact]
                    np.add.at(weight, x, count[y])
                    np.add.at(weight, y, count[x])
                    pairs.append(forest(ids[x], ids[y]))
            linked, inverse = np.unique(ids, return_inverse=True)
            sums = np.bincount(inverse, weight, len(linked)).astype(np.int64)
            linked, sums = linked[sums > 0], sums[sums > 0]
            a, b = forest(*(np.concatenate(x) for x in zip(*pairs)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([linked, a])), pa.array([None] * len(linked) + b.tolist(), pa.int64()), pa.array(np.concatenate([sums, np.zeros(len(a), np.int64)]))], ["a", "b", "w"])

    dealt = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket")
    wanted = staging.table(dealt(posted).mapInArrow(want, "bucket long, side int, row long, p binary"), "wanted")
    near = wanted.join(classes.select("row", "v"), "row").select("bucket", "side", "p", "v")
    met = staging.table(dealt(near).mapInArrow(link, "a long, b long, w long"), "links")
    sums = met.filter("b is null").groupBy(F.col("a").alias("row")).agg(F.sum("w").alias("w"))
    group = components(met.filter("b is not null").select("a", "b")).toDF("row", "group")
    named = classes.join(sums, "row", "left").join(group, "row", "left").select("label", "v", "least", "row", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("group", "row").alias("group"))
    named = staging.table(named, "named")
    # A table of its own, so that the join on a hot group is a plain one, which adaptive execution splits.
    least = staging.table(named.groupBy("group").agg(F.min("least").alias("component"), F.min("row").alias("first")), "groups")
    named = named.join(least, "group").select(F.col("label").alias("l"), F.col("v").alias("u"), "n_links", "component", "first")
    out = rows.join(named, (rows["label"] == named["l"]) & (rows["v"] == named["u"]), "left")
    component = F.when(F.col("l").isNull(), F.col("id")).otherwise(F.col("component"))
    # Without any vec_id in the component, its first row stands for it.
    kept = F.coalesce(F.col("id") == component, component.isNull() & (F.col("row") == F.coalesce("first", "row")))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept"))

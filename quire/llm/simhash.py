"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 6).

A fingerprint has 64 bits, each set if over half of the document's shingle hashes (XXH64, seed 42) have it set. Two
fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes. The index posts every different
fingerprint under groups of 4 (position, byte) entries, chosen so that any 5 positions hold a group whole: no pair
can be missed, and lists stay short where those of a single byte would hold a 256th of everything. The tally of a pair,
its number of equal positional bytes over all eight, is taken where it meets; pairs of 5 and more are retained, and of
these alone the differing bits are counted. Each posting list gives out the edges of a spanning forest, never all pairs.

Documents of a given Jaccard similarity (0.8 over five-word shingles in the pipeline) differ in 10 and more of the 64
bits, so that no number of equal bytes is guaranteed. similar() therefore looks for candidates by a signature of 96
positional bytes too: byte i stems from the smallest of the shingle hashes under the i-th permutation, and two documents
share it with a chance of their similarity. The same index serves: postings under groups of 4 (position, byte) entries,
the tally of equal bytes of each pair that meets, and a minimum that the tally has to reach. A pair of similarity 0.8
misses all 14 groups with a chance of 0.0006, and the tally's minimum of 62 with one of 0.0001.

Neither tally nor fingerprint is a verdict. Their links only say which documents to bring together; within each group
of these the Jaccard similarity of the shingle sets is computed, and only a pair that reaches it is linked. Groups of up
to BLOCK compare all their pairs. Larger ones are dealt to blocks: first a few members are compared with all, then those
outside the largest component found. Rows inside it are connected already, so no link is lost; the cost is that of the
rows outside times the group.

Copies fold into one fingerprint before anything is indexed. Cases: a text without words (null, empty) has the
fingerprint 0, linked like any other; a text of fewer words than a shingle is one shingle; repeated rows, rows of one
doc_id and rows without one are documents of their own; a component is named by the smallest doc_id that is there, null
without any; no rows give no rows; further columns are passed on by one_of_each() and ignored by the others, whatever
their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.columns import own as col
from quire.llm.components import components, forest
from quire.llm.mph import mix

SEED, BITS, BYTES = 42, 64, 8
#: Of signatures: bytes, and groups of how many bytes.
SIGNATURE, GROUPS, SIZE = 96, 14, 4
#: Postings that a task is meant to go through.
POSTINGS = 1_000_000
#: Members of a posting list that may all be compared.
LONG = 512
#: By how much the tally of a candidate may fall short of the similarity asked for: four standard deviations at 0.8.
SLACK = 0.16
#: Of verification: members of a block, and how many members of a larger group are compared with all first.
BLOCK, PIVOTS = 256, 8
_TURNS = np.random.default_rng(20240317).integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_digests(text: str | None, words: int) -> bytes:
    """The 8-byte big-endian XXH64 of every shingle of a text, repeats included."""
    own = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not own:
        return b""
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(own))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist())])


def signature(digests: bytes) -> bytes:
    """Zeros for a text without words."""
    hashes = np.frombuffer(digests, ">u8").astype(np.uint64)
    if not len(hashes):
        return bytes(SIGNATURE)
    with np.errstate(over="ignore"):
        least = np.min([(hashes[i : i + 1024, None] * _TURNS).min(axis=0) for i in range(0, len(hashes), 1024)], axis=0)
    return mix(least, 7).astype(np.uint8).tobytes()


def fingerprint(text: str | None, words: int = 3) -> int:
    """As an unsigned number."""
    return majority(shingle_digests(text, words))


def majority(digests: bytes) -> int:
    raw = np.frombuffer(digests, np.uint8).reshape(-1, BYTES)
    if not len(raw):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(raw), 8192):
        ones += np.unpackbits(raw[i : i + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    staging.reachable(docs.sparkSession)

    def run(batches):
        for batch in staging.pieces(batches):
            own = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def posting_groups(total: int = BYTES, agree: int = 5, size: int = 4) -> list[tuple[int, ...]]:
    """Groups of ``size`` positions such that any ``agree`` positions of ``total`` hold one, chosen greedily."""
    left, groups = set(combinations(range(total), agree)), []
    while left:
        best = max(combinations(range(total), size), key=lambda g: (sum(set(g) <= set(x) for x in left), tuple(-i for i in g)))
        groups.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return groups


def _near(x: np.ndarray, distance: int) -> tuple[np.ndarray, ...]:
    """The places of near pairs among XORed ones: the tally of equal positional bytes retains pairs, bits decide on these."""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=-1)
    retained = np.nonzero(tally >= BYTES - distance)
    fine = np.bitwise_count(x[retained]) <= distance
    return tuple(at[fine] for at in retained)


def _list_edges(own: np.ndarray, distance: int, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within one long posting list of different sorted fingerprints; free: bits its entries leave open."""
    a, b = [], []
    near = sum(1 for k in range(distance + 1) for _ in combinations(range(free.bit_count()), k))
    if len(own) <= near:
        for i in range(0, len(own), 128):
            x, y = _near(own[i : i + 128, None] ^ own[None, i:], distance)
            a.append(own[i + x])
            b.append(own[i + y])
    else:  # more members than neighbours each can have: look the neighbours up
        open_bits = [np.uint64(1 << i) for i in range(BITS) if free >> i & 1]
        for k in range(1, distance + 1):
            for bits in combinations(open_bits, k):
                other = own ^ np.bitwise_xor.reduce(np.array(bits, np.uint64))
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hit = (own[at] == other) & (own < other)
                a.append(own[hit])
                b.append(other[hit])
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, distance: int = 3, total: int = 0) -> DataFrame:
    """(a, b): edges between different fingerprints that give the same components as all near pairs. fps: one column.

    total: about how many there are, which decides on the number of tasks. A task goes through its lists one after the other.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the posting groups hold for distances up to 3")
    spark = fps.sparkSession
    staging.reachable(spark)
    groups = posting_groups()
    masks = [sum(0xFF << 8 * i for i in g) for g in groups]

    def post(batches):
        for batch in staging.pieces(batches):
            own = batch.column(0).to_numpy().view(np.uint64)
            for g, positions in enumerate(groups):
                raw = own.astype("<u8").view(np.uint8).reshape(-1, BYTES)[:, list(positions)]
                key = np.ascontiguousarray(raw).view("<u4").ravel().astype(np.int64) | np.int64(g << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["key", "fp"])

    def meet(batches):
        for portion in staging.whole_runs(batches, 200_000):
            yield joined(portion.column(0).to_numpy(), portion.column(1).to_numpy().view(np.uint64))

    def joined(key, own):
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(edge)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for step in range(1, 32):  # short lists, all at once
            begin, size = edge[:-1][(sizes > step) & (sizes <= 32)], sizes[(sizes > step) & (sizes <= 32)]
            if not len(begin):
                break
            i = np.arange(int((size - step).sum())) + np.repeat(begin - (np.cumsum(size - step) - (size - step)), size - step)
            (hit,) = _near(own[i] ^ own[i + step], distance)
            a.append(own[i[hit]])
            b.append(own[i[hit] + step])
        for k in np.flatnonzero(sizes > 32).tolist():
            x, y = _list_edges(own[edge[k] : edge[k + 1]], distance, ~masks[int(key[edge[k]]) >> 32] & (2**64 - 1))
            x, y = forest(x.view(np.int64), y.view(np.int64))
            a.append(x.view(np.uint64))
            b.append(y.view(np.uint64))
        x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    posted = fps.toDF("fp").mapInArrow(post, "key long, fp long")
    return posted.repartition(staging.parts(spark, total * len(groups), POSTINGS), "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def _signature_edges(own: np.ndarray, agree: int, left: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows that agree in so many bytes, enough to connect all that do.

    Some rows are compared with all; what they leave outside the largest component goes on. Rows inside it are connected
    already, so no link is lost, and a large group of copies costs a few comparisons each. In a list of up to LONG the
    rows outside are compared with all. A longer one is dealt again by each of the groups of bytes ``left``, as a pair at
    the similarity asked for shares a few of them (0.000005 miss all 23), so many small groups in one list stay cheap.
    """
    a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(own)

    def compare(rows: np.ndarray, among: np.ndarray) -> None:
        for i in range(0, len(rows), 16):
            x, y = np.nonzero((own[rows[i : i + 16], None] == own[among][None]).sum(axis=2) >= agree)
            x, y = rows[i : i + 16][x], among[y]
            a.append(x[x != y])
            b.append(y[x != y])

    everything = np.arange(n)
    compare(np.unique(np.linspace(0, n - 1, 16).astype(np.int64)), everything)
    nodes, roots = forest(np.concatenate(a), np.concatenate(b))
    root = np.arange(n)
    root[nodes] = roots
    outside = root != np.bincount(root).argmax()
    if n <= LONG or not left:
        compare(np.flatnonzero(outside), everything)
        return np.concatenate(a), np.concatenate(b)
    for k, g in enumerate(left):
        key = np.ascontiguousarray(own[:, g * SIZE : (g + 1) * SIZE]).view("<u4").ravel()
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) < 2 or not outside[part].any():
                continue
            if len(part) <= LONG:
                compare(part[outside[part]], part)
            else:  # a pair that shares an earlier group has been met there
                x, y = _signature_edges(own[part], agree, left[k + 1 :])
                a.append(part[x])
                b.append(part[y])
    return np.concatenate(a), np.concatenate(b)


def signature_links(signed: DataFrame, similarity: float, total: int = 0) -> DataFrame:
    """(a, b): edges that connect the nodes whose signatures agree. signed: (node, sig), different signatures, about ``total``."""
    least = similarity - SLACK
    agree = int(np.ceil(SIGNATURE * (least + (1 - least) / 256)))

    def post(batches):
        for batch in staging.pieces(batches):
            if batch.num_rows:
                own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
                for g in range(GROUPS):
                    key = np.ascontiguousarray(own[:, g * SIZE : (g + 1) * SIZE]).view("<u4").ravel().astype(np.int64) | np.int64(g << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1)], ["key", "node", "sig"])

    def meet(batches):
        for portion in staging.whole_runs(batches, 20_000):
            yield joined(portion)

    def joined(rows):
        key, node = rows.column("key").to_numpy(), rows.column("node").to_numpy()
        order = np.lexsort((node, key))
        edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
        sizes = np.diff(edge)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        of = rows.column("sig").combine_chunks()

        def bytes_of(at: np.ndarray) -> np.ndarray:
            return np.frombuffer(b"".join(of.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, SIGNATURE)

        for step in range(1, 16):  # short lists, all at once
            begin, size = edge[:-1][(sizes > step) & (sizes <= 16)], sizes[(sizes > step) & (sizes <= 16)]
            i = np.arange(int((size - step).sum())) + np.repeat(begin - (np.cumsum(size - step) - (size - step)), size - step)
            for at in range(0, len(i), 20_000):
                x, y = order[i[at : at + 20_000]], order[i[at : at + 20_000] + step]
                hit = (bytes_of(x) == bytes_of(y)).sum(axis=1) >= agree
                a.append(node[x[hit]])
                b.append(node[y[hit]])
        for k in np.flatnonzero(sizes > 16).tolist():
            at = order[edge[k] : edge[k + 1]]
            posted_by = int(key[at[0]]) >> 32
            x, y = _signature_edges(bytes_of(at), agree, tuple(g for g in range(SIGNATURE // SIZE) if g != posted_by))
            x, y = forest(node[at[x]], node[at[y]])
            a.append(x)
            b.append(y)
        x, y = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    parts = staging.parts(signed.sparkSession, total * GROUPS, POSTINGS)
    posted = signed.select("node", "sig").mapInArrow(post, "key long, node long, sig binary")
    return posted.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def shingle_set(digests: bytes) -> bytes:
    """The different hashes in order, 8 bytes each."""
    return np.unique(np.frombuffer(digests, ">u8").astype("<u8")).tobytes()


def _set_edges(sets: list[bytes], lead: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a leading set and another whose Jaccard similarity is at least the given one."""
    own = [np.frombuffer(x, "<u8") for x in sets]
    sizes = np.array([len(x) for x in own])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, code = np.unique(np.concatenate(own), return_inverse=True)
    held = np.zeros(len(code), np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(lead).tolist():
        mine = code[begins[i] : ends[i]]
        held[mine] = 1
        upto = np.concatenate([[0], np.cumsum(held[code])])
        held[mine] = 0
        both = upto[ends] - upto[begins]
        either = sizes + sizes[i] - both
        at = np.flatnonzero(np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity)
        at = at[(at > i) | ~lead[at]]
        a.append(np.full(len(at), i))
        b.append(at)
    return np.concatenate(a), np.concatenate(b)


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): edges between the leading rows of each unit and its other rows. rows: (unit, lead, node, set)."""

    def run(batches):
        def edges(lead: list[bool], node: list[int], sets: list[bytes]) -> pa.RecordBatch:
            x, y = _set_edges(sets, np.array(lead, bool), similarity)
            of = np.array(node, np.int64)
            x, y = forest(of[x], of[y])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        unit, held = None, ([], [], [])
        for batch in staging.pieces(batches):
            for u, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit and held[0]:
                    yield edges(*held)
                    held = ([], [], [])
                unit = u
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield edges(*held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("unit", "lead", "node", "set").repartition(parts, "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "a long, b long")


def verified(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): edges that connect the nodes of each group as its pairs of that similarity do.

    sets: (group, size, node, set), a written table. Two units of one hash only compare more pairs than they need.
    """
    unit = lambda block: F.xxhash64("group", block).alias("unit")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    small, large = sets.filter(F.col("size") <= BLOCK), sets.filter(F.col("size") > BLOCK)
    alone = small.select(unit(F.lit(0)), F.lit(True).alias("lead"), "node", "set")
    if not large.limit(1).count():
        return _compared(alone, similarity)
    dealt = large.select(unit(F.pmod(F.xxhash64("node", "set"), blocks).cast("int")), F.lit(False).alias("lead"), "node", "set")
    everywhere = lambda rows: rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(unit(F.col("block")), F.lit(True).alias("lead"), "node", "set")
    few = large.groupBy("group").agg(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).getField("node") for i in range(PIVOTS)]).alias("of"))
    few = few.select("group", F.explode(F.array_distinct("of")).alias("node"))
    first = staging.table(_compared(alone.unionAll(dealt).unionAll(everywhere(large.join(few, ["group", "node"], "left_semi"))), similarity), "verified")
    piece = large.select("group", "node").distinct().join(components(first).toDF("node", "piece"), "node", "left").select("group", "node", F.coalesce("piece", "node").alias("piece"))
    piece = staging.table(piece, "pieces")
    most = piece.groupBy("group", "piece").count().groupBy("group").agg(F.max_by("piece", F.struct("count", "piece")).alias("most"))
    outside = piece.join(most, "group").filter("piece <> most").select("group", "node")
    return first.unionAll(_compared(dealt.unionAll(everywhere(large.join(outside, ["group", "node"], "left_semi"))), similarity))


def _alike(table: DataFrame, words: int, similarity: float, distance: int) -> DataFrame:
    """(row, component), every row of a written table (row, text, ...): the smallest row that links reach."""

    def run(batches):
        for batch in staging.pieces(batches):
            every = [shingle_digests(t, words) for t in batch.column(1).to_pylist()]
            own = np.array([majority(d) for d in every], np.uint64)
            sets = [xxhash.xxh128_digest(shingle_set(d)) for d in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64)), pa.array([signature(d) for d in every], pa.binary()), pa.array(sets, pa.binary())], ["row", "fp", "sig", "same"])

    def whole(batches):
        for batch in staging.pieces(batches):
            sets = [shingle_set(shingle_digests(t, words)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["group", "size", "node", "set"])

    own = staging.table(table.select("row", "text").mapInArrow(run, "row long, fp long, sig binary, same binary"), "signatures")
    # Rows of one set of shingles are one node: their smallest row. Copies fold into one before any join, so the joins
    # that find the candidates have no hot key.
    pairs = staging.table(own.groupBy("fp", "sig", "same").agg(F.min("row").alias("least")), "pairs")
    signed = pairs.groupBy("sig").agg(F.min("least").alias("node"))
    printed = pairs.groupBy("fp").agg(F.min("least").alias("node"))
    total = pairs.count()
    near = links(printed.select("fp"), distance, total)
    near = near.join(printed.toDF("a", "x"), "a").join(printed.toDF("b", "y"), "b").select("x", "y")
    both = pairs.join(printed.toDF("fp", "x"), "fp").join(signed.toDF("sig", "y"), "sig").select("x", "y")
    named = components(near.unionAll(signature_links(signed, similarity, total)).unionAll(both.filter("x <> y").distinct())).toDF("node", "group")
    of = staging.table(signed.join(named, "node", "left").select("sig", F.coalesce("group", "node").alias("group")), "candidates")
    classes = staging.table(pairs.groupBy("sig", "same").agg(F.min("least").alias("node")).join(of, "sig").select("same", "node", "group"), "classes")
    sizes = classes.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1")
    wanted = staging.table(classes.select("group", "node").distinct().join(sizes, "group").select("group", "size", "node"), "wanted")
    texts = table.select("row", "text").join(wanted, F.col("row") == F.col("node")).select("group", "size", "node", "text")
    sets = staging.table(texts.mapInArrow(whole, "group long, size long, node long, set binary"), "sets")
    linked = components(verified(sets, similarity)).toDF("node", "component")
    # A written table, so that the join that names every row is a plain one, which adaptive execution splits.
    of = staging.table(classes.join(linked, "node", "left").select("same", F.coalesce("component", "node").alias("component")), "named")
    return own.select("row", "same").join(of, "same").select("row", "component")


def _numbered(docs: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    """(row, id, text, c0, c1, ... as columns), written: a number of its own for each row, whatever its id."""
    kept = [col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    return staging.table(docs.select(F.monotonically_increasing_id().alias("row"), col(key).alias("id"), col(text).cast("string").alias("text"), *kept), "rows")


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id), a row for each row of docs; linked are documents of that Jaccard similarity or more."""
    staging.reachable(docs.sparkSession)
    table = _numbered(docs, [], key, text)
    found = staging.table(_alike(table, words, similarity, distance).join(table.select("row", "id"), "row"), "alike")
    least = staging.table(found.groupBy("component").agg(F.min("id").alias("least")), "least")
    return found.join(least, "component").select(F.col("id").alias(key), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest key that is there, of several the first."""
    staging.reachable(docs.sparkSession)
    table = _numbered(docs, docs.columns, key, text)
    found = staging.table(_alike(table, words, similarity, distance).join(table.select("row", "id"), "row"), "alike")
    best = staging.table(found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).getField("row").alias("best")), "best")
    gone = staging.table(found.join(best, "component").filter("row <> best").select("row"), "gone")
    return table.join(gone, "row", "left_anti").select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    component_id: the smallest doc_id that links reach, itself included.
    """
    own = staging.table(fingerprints(docs, words, key, text), "fingerprints")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    different = staging.table(own.select("fp").distinct(), "different")
    group = components(links(different, distance, different.count())).toDF("fp", "group")
    grouped = first.join(group, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), "first")
    grouped = staging.table(grouped, "grouped")
    least = staging.table(grouped.groupBy("group").agg(F.min("first").alias("component")), "least")  # so that joins on a hot group are split
    named = grouped.join(least, "group").select(F.col("fp").alias("f"), "component")
    out = own.join(named, own["fp"] == named["f"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

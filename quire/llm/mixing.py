"""Mixing sources to target weights by systematic sampling (operator 12).

Targets: sources share the words of all by weight, but none gets over ``most`` times its own; what is above goes to the
others by weight until none is above. That level is found by one sort of the sources: those with the smallest cap for
their weight are capped, up to the first whose share of the rest is within its cap.

Sampling: all documents of a source expect the same number of copies, target / size of the source, so the prefix sum of
that at the i-th document is i times it. With one random offset a source, a document is emitted once for each whole
number that its step crosses. Documents stand in order of their size, largest first: the sum of what is emitted is then
off its target by less than the largest document, as the errors of neighbours cancel out. The places come from a range
sort of all rows and one offset a partition (``cut.numbered``), so a source that holds a third of the rows is spread like
any other rows; a source's first place is the count of all sources before it. Sources travel to the rows by broadcast
while they are counted to be at most ``FEW``, else by a plain join that adaptive execution splits.

Cases: a null text has size 0; documents of size 0 are emitted as others are and add no words; a null source is a source,
the last; rows of one id are rows of their own, ordered by their text's hash; a source of size 0, and all sources of an
empty table, get nothing; the offset hangs on seed and source alone, and the order on ids and texts, so reruns agree, however
the input is split; further columns are passed on by mix(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.plans.cut import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Sources of at most 200 bytes or so are broadcast up to this number.
FEW = 100_000


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with source_no from 1 by code point, null last, weight (in turn) and target, a double."""
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = numbered(sizes, F.asc_nulls_last("source"), name="source_no")
    placed = placed.withColumn("weight", F.get(turn, ((F.col("source_no") - 1) % len(weights)).cast("int")))
    placed = staging.table(placed.withColumn("cap", F.col("source_size") * most), "sources")
    total = placed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    if not total.n:
        return placed.withColumn("target", F.lit(0.0)).drop("cap")
    by_cap = numbered(placed.withColumn("ratio", F.col("cap") / F.col("weight")), "ratio", "source_no", name="capped", size=F.col("cap"))
    # Weights before a row, in the same order: whole numbers of a millionth, so that their sums are exact.
    by_cap = numbered(by_cap, "ratio", "source_no", name="spent", size=F.round(F.col("weight") * 1_000_000))
    level = (F.lit(float(total.words)) - F.col("capped")) / (F.lit(float(total.weight)) - F.col("spent") / 1_000_000)
    found = by_cap.withColumn("level", level).filter(F.col("level") <= F.col("ratio")).agg(F.min_by("level", F.struct("ratio", "source_no")).alias("level")).first()
    return placed.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(found.level or 0.0) * F.col("weight"))).drop("cap")


def _share(text: Column, seed: int) -> Column:
    """A number between 0 and 1 from a text."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(text, F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _planned(docs: DataFrame, columns: list[str], key: str, source: str, text: str, weights: Sequence[float], most: int, seed: int, few: int) -> tuple[DataFrame, DataFrame]:
    """(row, c0, c1, ... as columns), written, and (row, doc_id, size, source, source_size, target, copies)."""
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{key}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(body).alias("h"),
    )
    table = staging.table(rows, "sized")
    sizes = staging.table(table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sizes")
    goal = numbered(targets(sizes, weights, most), "source_no", name="before", size=F.col("n"))
    goal = staging.table(goal.withColumn("offset", _share(F.col("source"), seed)).withColumnRenamed("source", "s"), "targets")
    placed = numbered(table.select("row", "doc_id", "source", "size", "h"), F.asc_nulls_last("source"), F.desc("size"), F.asc_nulls_last("doc_id"), "h", "row", name="place")
    each = placed.join(F.broadcast(goal) if goal.count() <= few else goal, F.col("source").eqNullSafe(F.col("s")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("place") - F.col("before")
    crossed = F.floor(step * at + F.col("offset")) - F.floor(step * (at - 1) + F.col("offset"))
    return table, each.select("row", "doc_id", "size", "source", "source_size", "target", crossed.alias("copies"))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 42, few: int = FEW) -> DataFrame:
    """One row for each row of docs: doc_id, size, source, source_size, target (of its source), copies, taken (words, repeats counted)."""
    planned = _planned(docs, [], key, source, text, weights, most, seed, few)[1]
    return planned.drop("row").withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 42, few: int = FEW) -> DataFrame:
    """The rows of docs, each as often as the mix emits it."""
    table, planned = _planned(docs, docs.columns, key, source, text, weights, most, seed, few)
    copies = planned.filter(F.col("copies") > 0).select("row", "copies")
    out = table.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)

"""Names in texts, and pairs of names that stand together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.cut import cut
from quire.plans.workers import reach

#: Bytes of names that one automaton holds, at so many a name beside its text.
SET_BYTES, ENTRY = 32 << 20, 64
#: Sessions of one set of a name, about.
BLOCK = 1 << 15

_automata: dict[int, tuple] = {}


def _automaton(names: list[str]):
    """Built once a worker for each broadcast, which is held with it, so that no other list has its id."""
    if id(names) not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(name, name)
        made.make_automaton()
        _automata.clear()
        _automata[id(names)] = names, made
    return _automata[id(names)][1]


def contained(names: DataFrame, texts: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """(id, name): names that a text holds, anywhere and as they are spelled. names: (name); texts: (id, body), ids differ.

    The names go into an automaton that finds all of them in one run over a text, so texts are never shuffled. It is
    broadcast, its size measured; names beyond that make further passes. Counts the names when it is called.
    """
    spark = texts.sparkSession
    reach(spark)
    known = cut(names.select("name").filter("name <> ''").distinct())
    size = known.agg(F.sum(F.octet_length("name") + ENTRY)).first()[0] or 0
    passes = max(1, -(-size // set_bytes))
    kind = texts.schema["id"].dataType.simpleString()
    rows, out = texts.select("id", F.coalesce("body", F.lit("")).alias("body")), None
    for k in range(passes):
        part = known.filter(F.pmod(F.xxhash64("name"), F.lit(passes)) == k)
        held = spark.sparkContext.broadcast([r.name for r in part.collect()])  # a pass's bytes at most

        def search(batches, held=held):
            for batch in batches:
                if not held.value:
                    continue
                found, at = _automaton(held.value), [[], []]
                for i, body in enumerate(batch.column(1)):
                    own = {name for _, name in found.iter(body.as_py())}
                    at[0] += [i] * len(own)
                    at[1] += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[0], pa.int64())), pa.array(at[1], pa.string())], ["id", "name"])

        met = rows.mapInArrow(search, f"id {kind}, name string")
        out = met if out is None else out.unionAll(met)
    return out


def together(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The different pairs (a, b) that some session has both of. seen: (name, session).

    A name's sessions are kept as sets, one for each block of them that a hash deals; there are as many blocks as keep the
    longest list below ``BLOCK`` a set, about. A pair meets its names' sets block by block, so what is made on the way
    follows pairs and mentions and not the pairs times the sessions of a name.
    """
    own = cut(pairs.select("a", "b").distinct())
    named = seen.join(own.select(F.col("a").alias("name")).union(own.select("b")).distinct(), "name", "left_semi").select("name", "session")
    longest = named.groupBy("name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    dealt = named.withColumn("block", F.pmod(F.xxhash64("session"), F.lit(-(-longest // BLOCK) or 1)))
    sets = dealt.groupBy("name", "block").agg(F.collect_set("session").alias("sessions"))
    left, right = sets.select(F.col("name").alias("a"), "block", F.col("sessions").alias("x")), sets.select(F.col("name").alias("b"), "block", F.col("sessions").alias("y"))
    return own.join(left, "a").join(right, ["b", "block"]).filter(F.arrays_overlap("x", "y")).select("a", "b").distinct()

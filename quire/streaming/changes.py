"""Changes of notes as a stream: the last event of a path wins, and only what a change affects is made anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths

SCHEMA = "path string, op string, seq long, content string"


def read_changes(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """A stream of JSON files of (path, op, seq, content); op: add, change or delete."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(folder)


def coalesced(events: DataFrame) -> DataFrame:
    """One event a path, that of the largest seq."""
    return events.groupBy("path").agg(F.max(F.struct("seq", "op", "content")).alias("e")).select("path", "e.op", "e.seq", "e.content")


def applied(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state (path, seq, content) after the events: upserts and deletes; an event older than the state does nothing."""
    last = coalesced(events).select(F.col("path").alias("p"), "op", F.col("seq").alias("s"), F.col("content").alias("c"))
    both = state.join(last, state["path"] == last["p"], "full")
    newer = F.col("p").isNotNull() & (F.col("path").isNull() | (F.col("s") > F.col("seq")))
    out = both.select(F.coalesce("path", "p").alias("path"), F.when(newer, F.col("s")).otherwise(F.col("seq")).alias("seq"), F.when(newer, F.col("c")).otherwise(F.col("content")).alias("content"), (newer & (F.col("op") == "delete")).alias("gone"))
    return out.filter(~F.coalesce("gone", F.lit(False))).drop("gone")


def latest(events: DataFrame) -> DataFrame:
    """(path, op, seq, content): the change that each path's state has undergone, from a stream of events, kept per path.

    The state is the largest seq, whether the note is there, and its content; an event that isn't newer says nothing, so
    repeated and late ones are harmless. Deleted paths keep their seq, against events that come late.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        seq, changed = (state.get[0], None) if state.exists else (-(2**63), None)
        for frame in frames:
            row = frame.loc[frame["seq"].idxmax()]
            if int(row["seq"]) > seq:
                seq, changed = int(row["seq"]), row
        if changed is not None:
            gone = changed["op"] == "delete"
            state.update((seq, not gone, None if gone else changed["content"]))
            yield pd.DataFrame({"path": [key[0]], "op": [changed["op"]], "seq": [seq], "content": [None if gone else changed["content"]]})

    return events.groupBy("path").applyInPandasWithState(run, "path string, op string, seq long, content string", "seq long, there boolean, content string", "append", GroupStateTimeout.NoTimeout)


def affected_folders(events: DataFrame) -> DataFrame:
    """(folder) above any changed path, and the root."""
    slug = paths.slugify_path(F.col("path"))
    return events.select(F.explode(F.concat(F.array(F.lit("")), paths.folders(slug))).alias("folder")).distinct()


def affected_tags(changed: DataFrame) -> DataFrame:
    """(tag): of the changed notes (tags), with all above them, and the index of tags."""
    every = F.flatten(F.transform("tags", paths.prefixes))
    return changed.select(F.explode(F.concat(F.array(F.lit("index")), every)).alias("tag")).distinct()


def affected_pages(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(slug): the changed pages (slug) and those they link to, whose backlinks change."""
    return changed.select("slug").union(edges.join(changed.select(F.col("slug").alias("src")), "src", "left_semi").select("dst")).distinct()


def partial(published: DataFrame, changed: DataFrame, emitters: dict[str, Callable[[DataFrame], DataFrame]], whole: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What each emitter makes of the changed pages (slug) alone; those named in ``whole`` depend on all pages and make all anew."""
    some = published.join(changed.select("slug").distinct(), "slug", "left_semi")
    return {name: f(published if name in whole else some) for name, f in emitters.items()}


def needs_rebuild(events: DataFrame, sources: tuple[str, ...] = (".ts", ".tsx", ".py", ".json", ".yaml")) -> bool:
    """Whether a change is one of the program and not of notes, so that everything has to be made anew."""
    path = F.col("path")
    found = F.lit(False)
    for ext in sources:
        found = found | path.endswith(ext)
    return events.filter(found).limit(1).count() > 0


def run(events: DataFrame, checkpoint: str, emit: Callable[[DataFrame, int], None]):
    """Starts the stream; emit gets the coalesced events of each batch, one batch after the other."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: emit(coalesced(df), n)).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, by, n) by event time; on streams, events later than ``late`` are left out."""
    own = events.withColumn(time, F.col(time).cast("timestamp"))
    own = own.withWatermark(time, late) if own.isStreaming else own
    return own.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")

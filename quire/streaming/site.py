"""A site that follows its notes: what a watched folder tells of is applied to the notes, and only what it touches is made anew."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths
from quire.plans.cut import cut
from quire.plans.pipeline import Build
from quire.sources.sinks import current, publish, published
from quire.sources.watch import watch
from quire.streaming import changes

NOTES = "path string, seq long, content string"


def _versions(folder: str) -> list[int]:
    store, base = fs.FileSystem.from_uri(folder)
    return sorted(int(f.base_name) for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.isdigit())


def update(spark: SparkSession, events: DataFrame, batch: int, build: Build, root: str, state: str, whole: tuple[str, ...] = ()) -> int | None:
    """Applies one batch of changes (path, op, seq, content) and publishes; the new generation, None without changes.

    The notes are kept in ``state``, a version a batch made from the one before it, so a batch that is repeated gives the
    same. Emitters named in ``whole`` depend on all notes and are run over all; of the others only the changed pages are
    run, and what they made of other pages is carried over. Such an emitter gives with each output the page it is made of
    as ``source`` (its slug by default); what was made of a page that is gone or changed is not carried over.
    """
    last = cut(changes.coalesced(events))
    if not last.limit(1).count():
        return None
    folder = f"{state.rstrip('/')}/notes"
    before = [v for v in _versions(folder) if v < batch]
    notes = spark.read.schema(NOTES).parquet(f"{folder}/{before[-1]}") if before else spark.createDataFrame([], NOTES)
    changes.applied(notes, last).select("path", "seq", "content").write.mode("overwrite").parquet(f"{folder}/{batch}")
    notes = spark.read.schema(NOTES).parquet(f"{folder}/{batch}")
    pages = cut(build.published(build.parse(notes.select("path", F.col("content").alias("raw")))))
    touched = cut(last.select(paths.slugify_path(F.col("path")).alias("slug")).distinct())
    outputs = None
    for name, rows in changes.partial(pages, touched, build.emitters, whole).items():
        source = F.col("source") if "source" in rows.columns else F.col("slug")
        own = rows.select("slug", "ext", "content", F.lit(name).alias("emitter"), source.alias("source"))
        outputs = own if outputs is None else outputs.unionByName(own)
    kept = None
    if current(spark, root):
        old = published(spark, root).filter(~F.col("emitter").isin(*whole)) if whole else published(spark, root)
        kept = old.join(touched, old["source"] == touched["slug"], "left_anti")
    generation = publish(outputs, root, kept)
    store, base = fs.FileSystem.from_uri(folder)
    for v in before[:-1]:
        store.delete_dir(f"{base}/{v}")
    return generation


def follow(spark: SparkSession, folder: str, root: str, build: Build, state: str, whole: tuple[str, ...] = (), ignore: tuple[str, ...] = (), once: bool = False, every: str = "1 second"):
    """Starts the stream that keeps the site at root as the notes below folder are; batches come one after the other.

    state: a folder of its own, with listings, notes and checkpoint. once: ends when what is there now has been applied.
    """
    events = watch(spark, folder, f"{state}/listings", ignore=ignore)
    writer = events.writeStream.option("checkpointLocation", f"{state}/checkpoint").foreachBatch(lambda df, n: update(spark, df, n, build, root, state, whole))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

"""Tables and folders in the place the cluster shares, to cut lineage and to pass data between jobs.

The place is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests on a local master) a
temporary folder of this machine is used.

Results are lazy and read what was staged for them, so a staged table stays while anything can read it: its files go
once no DataFrame, query or view refers to it any more, which the JVM's garbage collector tells (as it tells Spark's own
cleaner of checkpoints), when the next table is staged. Whoever writes a result at once can say so earlier: what is
staged within ``scope(spark)`` by this thread goes at its end. ``clear(spark)`` removes all. Folders of other files
(``new_dir``) stay until one of the latter two.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.plans.workers import reach

#: Each staged folder with the application it is of and the JVM's weak reference to the file listing that all plans over
#: its table share, if it is a table.
_staged: dict[str, tuple[str, object] | None] = {}
_lock = threading.RLock()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_local: list[str] = []

#: What a Python worker handles at once; texts may be long, and what is made of them many times their size.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in the session, or a temporary one on a local master that names none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    with _lock:
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="quire-"))
    return f"file://{_local[0]}"


def new_dir(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared place, which belongs to the scope that this thread is in, if any."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    with _lock:
        _staged[path] = None
    if (own := _scope.get()) is not None:
        own.append(path)
    return path


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    listing = out._jdf.queryExecution().analyzed().relation().location()
    with _lock:
        _staged[path] = spark.sparkContext.applicationId, spark.sparkContext._jvm.java.lang.ref.WeakReference(listing)
    return out


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared place and reads it back: a written table that outlives executors."""
    spark = df.sparkSession
    sweep(spark)
    path = new_dir(spark, name)
    df.write.parquet(path)
    return _read(spark, path, df.schema)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        with _lock:
            there = _staged.pop(p, "gone") != "gone"
        if there:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Removes the tables of this application that nothing refers to any more."""
    own = spark.sparkContext.applicationId
    with _lock:
        tables = [(p, held[1]) for p, held in _staged.items() if held is not None and held[0] == own]
    remove(spark, [p for p, ref in tables if ref.get() is None])


def clear(spark: SparkSession) -> None:
    """Removes all that this session has staged; results that still read it must have been written before."""
    remove(spark, staged())


def staged() -> list[str]:
    with _lock:
        return list(_staged)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """What this thread stages within goes at the end, whether read or not; scopes of other threads are their own."""
    token = _scope.set(own := [])
    try:
        yield own
    finally:
        _scope.reset(token)
        remove(spark, own)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """The rows of make() as a written table, and its folder; what was staged for them is gone."""
    path = new_dir(spark, name)
    with scope(spark):
        df = make()
        df.write.parquet(path)
    return _read(spark, path, df.schema), path


def reachable(spark: SparkSession) -> None:
    """Every operator that runs Python begins with it; no setting of the session is touched."""
    reach(spark)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to so many rows and bytes, a row being the least; the JVM sends up to 64 MB or 10,000 rows at once.

    What an operator makes of a piece is many times the piece, so this and not the JVM's batch bounds a worker's memory.
    """
    for batch in batches:
        todo = [batch.slice(at, BATCH_ROWS) for at in range(0, batch.num_rows, BATCH_ROWS)][::-1]
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > BATCH_BYTES:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def whole_runs(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """A partition sorted by its first column, an integer, in portions that end where that changes, of so many rows if there are."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1], "left"))
            if end:  # the last run may go on
                yield table.slice(0, end)
                held = table.slice(end).combine_chunks().to_batches()
                n -= end
    if n:
        yield pa.Table.from_batches(held)


def parts(spark: SparkSession, total: int, each: int) -> int:
    """In how many parts to deal ``total`` of something: by its amount, and at least as many as the session shuffles to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each))

"""Cuts the lineage of iterative plans: a reliable checkpoint in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the place that the cluster shares; only a local session without one gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint(); only a local session without spark.checkpoint.dir gets a temporary folder for it."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint()


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", size: Column | None = None) -> DataFrame:
    """df sorted, with the place of each row from 1, running on through ties; size: the sum of it before each row instead.

    A global sort, checkpointed, then the sums of its partitions, a row each; no task sees more than a partition.
    """
    done = cut(df.orderBy(*order).withColumn("_size", F.lit(1).cast("long") if size is None else size.cast("long")))
    # Over a checkpoint the number has the partition in its upper bits and the row within it in the lower.
    marked = done.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    parts = marked.groupBy("_part").agg(F.sum("_size").alias("_all")).orderBy("_part").collect()  # one row a partition
    total, before = 0, []
    for r in parts:
        before.append((r["_part"], total))
        total += r["_all"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    if size is None:
        out = marked.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(2**33 - 1)) + 1)
    else:
        own = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        out = marked.withColumn("_own", F.coalesce(F.sum("_size").over(own), F.lit(0))).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_own")
    return out.drop("_id", "_part", "_before", "_size")


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], **values: Column) -> DataFrame:
    """df with the last value that isn't null at or before each row, by ``order``, among the rows of the same ``by``.

    A segmented scan: a range sort, checkpointed, cuts the rows into stretches; each carries on within itself, and gets
    what is open where it begins from one row a stretch, so that a file of any length is worked on by many tasks. Values
    should be small, as numbers of lines are.
    """
    names = list(values)
    done = cut(df.withColumns(values).orderBy(*by, *order))
    marked = done.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    key = F.struct(F.lit(0).alias("_"), *by)
    last = marked.groupBy("_part", key.alias("_by")).agg(F.max("_id").alias("_end"), *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_id"))).alias(n) for n in names])
    ends = last.groupBy("_part").agg(F.max_by(F.struct("_by", *names), "_end").alias("e")).select("_part", "e.*").orderBy("_part").collect()  # one row a partition
    opened, open_by, held = [], None, [None] * len(names)
    for r in ends:
        opened.append((r["_part"], open_by, *held))
        held = [r[n] if r[n] is not None else h for n, h in zip(names, held)] if r["_by"] == open_by else [r[n] for n in names]
        open_by = r["_by"]
    kinds = last.schema
    schema = StructType([StructField("_part", LongType()), StructField("_open", kinds["_by"].dataType), *[StructField(f"_o{i}", kinds[n].dataType) for i, n in enumerate(names)]])
    offsets = df.sparkSession.createDataFrame(opened, schema)
    own = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumns({n: F.last(n, ignorenulls=True).over(own) for n in names}).join(F.broadcast(offsets), "_part")
    full = inside.withColumns({n: F.coalesce(n, F.when(key.eqNullSafe(F.col("_open")), F.col(f"_o{i}"))) for i, n in enumerate(names)})
    return full.drop("_id", "_part", "_open", *[f"_o{i}" for i in range(len(names))])

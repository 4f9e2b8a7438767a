"""Connected components of a graph of integer nodes, labelled by their smallest node.

Each partition first reduces its edges to a spanning forest. Then, round by round: every node hooks onto its smallest
neighbour, pointers are followed to their ends, and edges move to those ends, which at least halves the nodes that
still have edges. A graph that has come down to ``FINISH`` edges ends in one task; that is a bound, not a cap, as
larger ones go on by rounds. Every round is a written table, so a lost executor costs a part of one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import staging

#: Edges that one task may join up: 16 bytes each.
FINISH = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the smallest of its component, and that smallest node."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _reduced(edges: DataFrame) -> DataFrame:
    """The edges of each partition's spanning forest, as stars around its roots."""

    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > 500_000:
                a, b = forest(a, b)
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component) for every node with an edge to another. edges: the first two columns, no nulls.

    Repeated edges and loops change nothing; no edges give no rows.
    """
    staging.reachable(edges.sparkSession)
    plain = edges.toDF("a", "b").select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    left = staging.table(_reduced(plain), "edges")
    labels: DataFrame | None = None
    while (n := left.count()) > finish:
        parent = left.groupBy("a").agg(F.min("b").alias("p")).unionAll(left.groupBy("b").agg(F.min("a").alias("p")))
        parent = staging.table(parent.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("p")).alias("p")), "parents")
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            new = staging.table(parent.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")), "parents")
            moved, parent = new.filter("moved").limit(1).count(), new.select("v", "p")
            if not moved:
                break
        ends = left.join(parent.toDF("a", "x"), "a").join(parent.toDF("b", "y"), "b").select("x", "y").filter("x <> y")
        left = staging.table(_reduced(ends.distinct()), "edges")
        labels = parent if labels is None else labels.join(parent.toDF("p", "q"), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        labels = staging.table(labels, "labels")
    last = _reduced(left.repartition(1)) if n else left
    if labels is None:
        both = last.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return both.unionAll(both.select(F.col("component").alias("node"), "component").distinct())
    moved = labels.join(last.toDF("p", "q"), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    return moved.toDF("node", "component")

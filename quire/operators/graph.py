"""Graphs of notes and places: degrees, neighbourhoods, labelled routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def note_graph(edges: DataFrame, tags: DataFrame, slugs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, kind): links between pages that exist, and pages' tags as nodes. tags: (slug, tag)."""
    from quire.operators.links import valid

    tagged = tags.filter(~F.col("tag").isin(*without)) if without else tags
    return valid(edges, slugs).select("src", "dst", F.lit("link").alias("kind")).union(tagged.select("slug", F.concat(F.lit("tags/"), F.col("tag")), F.lit("tag"))).distinct()


def summary(edges: DataFrame) -> DataFrame:
    """(edges, nodes, self_loops) of edges (a, b)."""
    ends = edges.select("a", "b", F.posexplode(F.array("a", "b")).alias("at", "n"))
    return ends.agg(F.count_if(F.col("at") == 0).alias("edges"), F.count_distinct("n").alias("nodes"), F.count_if((F.col("at") == 0) & (F.col("a") == F.col("b"))).alias("self_loops"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree, radius); radius: 2 + the root of the links that touch it."""
    one = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")
    out = edges.select(one).select("x.*").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree")).withColumn("radius", 2 + F.sqrt("degree"))


def top_degrees(edges: DataFrame, n: int = 20) -> DataFrame:
    return degrees(edges).orderBy(F.col("degree").desc(), "node").limit(n)


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, distance): nodes within so many undirected steps of the start nodes; -1: all that can be reached.

    A loop of joins over the frontier alone; each step looks the frontier up at both ends of the edges, which are written
    once where more than a step is taken, and drops what an earlier one has found, so cycles end.
    """
    from quire.plans.cut import cut

    own = edges.select("a", "b") if depth in (0, 1) else cut(edges.select("a", "b"))
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    front, d = seen, 0
    while d != depth:
        d += 1
        at = front.select("node")
        ends = own.join(at, own["a"] == at["node"], "left_semi").select(F.col("b").alias("node")).union(own.join(at, own["b"] == at["node"], "left_semi").select(F.col("a").alias("node")))
        front = ends.distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        if depth < 0 or d % 4 == 0:
            front = cut(front)
            seen = cut(seen.unionByName(front))
            if not front.limit(1).count():
                break
        else:
            seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node)."""
    left, right = nodes.select(F.col("node").alias("a")), nodes.select(F.col("node").alias("b"))
    return edges.join(left, "a", "left_semi").join(right, "b", "left_semi").select("a", "b")


def routes(edges: DataFrame, labels: int = 2) -> DataFrame:
    """(a, b, label): directed pairs of places without loops, each with its smallest labels. edges: (a, b, label)."""
    some = F.slice(F.array_sort(F.collect_set(F.nullif("label", F.lit("")))), 1, labels)
    return edges.filter("a <> b").groupBy("a", "b").agg(F.array_join(some, " | ").alias("label"))


def phrases(edges: DataFrame, pattern: str) -> DataFrame:
    """(phrase): what the suffixes of routes state by a pattern's group, each once. edges: (suffix)."""
    found = F.explode(F.regexp_extract_all("suffix", F.lit(pattern), F.lit(1))).alias("raw")
    return edges.select(found).select(F.trim("raw").alias("phrase")).filter("phrase <> ''").distinct()


# How routes state what they pass and how.
VIA, METHOD = r"(?i)\[via\s+([^\]]+)\]", r"(?i)\[method:\s*([^\]]+)\]"


def sanity(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """(kind, phrases, rejected): how many phrases of each kind there are, and how many of these no one accepts.

    accepted: (kind, phrase); kind: via or method.
    """
    every = phrases(edges, VIA).withColumn("kind", F.lit("via")).unionByName(phrases(edges, METHOD).withColumn("kind", F.lit("method")))
    good = accepted.select("kind", "phrase").distinct().withColumn("_good", F.lit(True))
    return every.join(good, ["kind", "phrase"], "left").groupBy("kind").agg(F.count("*").alias("phrases"), F.count_if(F.col("_good").isNull()).alias("rejected"))


def label_counts(edges: DataFrame) -> DataFrame:
    """(label, n): how many routes state each label."""
    return edges.groupBy("label").agg(F.count("*").alias("n"))

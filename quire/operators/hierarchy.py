"""Tags and folders as hierarchies: roll-ups by path prefix, listings, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import paths


def tag_rollup(notes: DataFrame) -> DataFrame:
    """(tag, n): notes of each tag and of all tags below it. notes: (slug, tags)."""
    every = F.explode(F.array_distinct(F.flatten(F.transform("tags", paths.prefixes)))).alias("tag")
    return notes.select("slug", every).groupBy("tag").agg(F.count_distinct("slug").alias("n"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """(folder, n, and the newest of each date): files below each folder, however deep. files: (slug, created, modified, published)."""
    rows = files.select("created", "modified", "published", F.explode(paths.folders(F.col("slug"))).alias("folder")).filter(~F.col("folder").isin(".", "tags"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("created", "modified", "published")])


def children(files: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """(folder, child, is_folder, n, dates): what stands right in each folder; sub-folders stand for all below them.

    dates: columns of files, of which a file has its own and a sub-folder each one's newest among the files right in it.
    """
    depth = F.size(F.split("slug", "/"))
    prefix = F.posexplode(F.concat(F.array(F.lit("")), paths.folders(F.col("slug")))).alias("at", "folder")
    rows = files.select("slug", *dates, depth.alias("depth"), prefix)
    child, left = F.element_at(F.split("slug", "/"), F.col("at") + 1), F.col("depth") - 1 - F.col("at")
    newest = [F.max(F.when(F.col("left") <= 1, F.col(c))).alias(c) for c in dates]
    return rows.select("folder", *dates, child.alias("child"), left.alias("left"), (left > 0).alias("is_folder")).groupBy("folder", "child", "is_folder").agg(F.count("*").alias("n"), *newest)


def closure(files: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth): each file below each of its folders, depth in steps."""
    rows = files.select("slug", F.size(F.split("slug", "/")).alias("d"), F.posexplode(paths.folders(F.col("slug"))).alias("at", "ancestor"))
    return rows.select("ancestor", F.col("slug").alias("descendant"), (F.col("d") - 1 - F.col("at")).alias("depth"))


def breadcrumbs(files: DataFrame) -> DataFrame:
    """(slug, position, crumb): the way from the root to each page."""
    return files.select("slug", F.posexplode(paths.prefixes(F.col("slug"))).alias("position", "crumb"))


def numeric_key(name: Column) -> Column:
    """For sorting: runs of digits by their value, however long, case and accents aside."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    padded = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))
    joined = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), padded(p)).otherwise(p)), "")
    return F.collate(joined, "UNICODE_CI_AI")


def explorer(listing: DataFrame, keep: Column | None = None, shown: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """children() in display order within each folder: folders first, then names by number and letter.

    keep, shown and order stand for the steps filter, map and sort: which rows, what name they show, in what order.
    """
    rows = listing.filter(keep) if keep is not None else listing.filter("child <> 'tags'")
    rows = rows.withColumn("shown", shown if shown is not None else F.col("child"))
    by = order if order is not None else [F.col("is_folder").desc(), numeric_key(F.col("shown"))]
    out = rows.withColumn("position", F.row_number().over(Window.partitionBy("folder").orderBy(*by, "child")))
    return out if shown is not None else out.drop("shown")


def find(listing: DataFrame, path: str) -> DataFrame:
    """The rows of children() below a folder given by its path, '' for the root, however deep."""
    return listing if not path else listing.filter((F.col("folder") == path) | F.col("folder").startswith(path + "/"))


def folder_pages(files: DataFrame) -> DataFrame:
    """(slug, title): a page for each folder that has files below it."""
    every = files.select(F.explode(paths.folders(F.col("slug"))).alias("folder")).filter(~F.col("folder").isin(".", "tags")).distinct()
    return every.select(F.concat("folder", F.lit("/index")).alias("slug"), F.element_at(F.split("folder", "/"), -1).alias("title"))


def tag_pages(notes: DataFrame) -> DataFrame:
    """(slug, title): a page for each tag and those above it, and the index of tags."""
    every = notes.select(F.explode(F.flatten(F.transform("tags", paths.prefixes))).alias("tag")).distinct()
    index = notes.sparkSession.createDataFrame([("index",)], "tag string")
    return every.unionAll(index).select(F.concat(F.lit("tags/"), F.col("tag")).alias("slug"), F.col("tag").alias("title"))


def newest_by_tag(notes: DataFrame, limit: int = 10) -> DataFrame:
    """(tag, slug, position): the first notes of each tag: dated ones first, newest first, then by title."""
    # Without outer, Spark would ask the size of the tags before all else, and so parse notes once more where they are read.
    rows = notes.select("slug", "title", "modified", F.explode_outer("tags").alias("tag")).filter("tag is not null")
    order = Window.partitionBy("tag").orderBy(F.col("modified").desc_nulls_last(), F.lower("title"), "slug")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("tag", "slug", "position")


def with_overrides(default: DataFrame, authored: DataFrame, column: str) -> DataFrame:
    """default rows (slug, column) whose value an authored row of the same slug replaces."""
    own = authored.select(F.col("slug").alias("_s"), F.col(column).alias("_v"))
    return default.join(own, default["slug"] == own["_s"], "left").withColumn(column, F.coalesce("_v", column)).drop("_s", "_v")

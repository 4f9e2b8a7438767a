"""Windows over lines, paragraphs and sorted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context(lines: DataFrame, by: str, no: str, line: str, before: int = 4, after: int = 4) -> DataFrame:
    """Adds ``context``: the lines around each, clipped at the ends."""
    w = Window.partitionBy(by).orderBy(no).rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list(line).over(w), "\n"))


def context_of(parts: Column, at: Column, before: int = 1, after: int = 1) -> Column:
    """The same over an array, where a whole text is one row: no shuffle. at: from 0."""
    low = F.greatest(at - before, F.lit(0))
    return F.slice(parts, low + 1, F.least(at + after + 1, F.size(parts)) - low)


def hit_windows(rows: DataFrame, parts: str, pattern: str, screen: str | None = None, around: int = 1) -> DataFrame:
    """(…, at, window) for each paragraph that matches; screen: what the window has to match too. Overlaps stay apart."""
    hits = rows.select("*", F.posexplode(parts).alias("at", "part")).filter(F.col("part").rlike(pattern))
    out = hits.withColumn("window", F.array_join(context_of(F.col(parts), F.col("at"), around, around), "\n\n")).drop("part", parts)
    return out.filter(F.col("window").rlike(screen)) if screen else out


def heading_ranges(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """Adds ``until``: the next heading's position that is no deeper, null at the end. headings: (slug, at, depth).

    One pass over a page's headings, last first, that carries the nearest heading of each depth; depths below
    ``deepest``, which Markdown does not have, would count as that.
    """
    after = Window.partitionBy("slug").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    depth = F.least(F.col("depth").cast("int"), F.lit(deepest))
    nearest = F.array(*[F.last(F.when(depth <= d, F.col("at")), ignorenulls=True).over(after) for d in range(1, deepest + 1)])
    return headings.withColumn("until", F.element_at(nearest, F.greatest(depth, F.lit(1))))


def page(rows: DataFrame, by: str, start: int, limit: int) -> DataFrame:
    """Rows start to start + limit in the order of a column, from 0."""
    return rows.orderBy(by).offset(start).limit(limit)

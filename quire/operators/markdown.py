"""Structure of Markdown texts: headings, tables of contents, anchors, callouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import paths, text

# Other names of callout kinds.
CALLOUTS = {
    "summary": "abstract", "tldr": "abstract", "hint": "tip", "important": "tip", "check": "success", "done": "success",
    "help": "question", "faq": "question", "attention": "warning", "caution": "warning", "missing": "failure",
    "fail": "failure", "error": "danger", "cite": "quote",
}


def headings(raw: Column) -> Column:
    """Array of (depth, text) of the # headings outside code fences."""
    plain = F.regexp_replace(raw, r"(?s)```.*?```", "")
    marks = F.regexp_extract_all(plain, F.lit(r"(?m)^(#{1,6}) +(.+?)\s*#*\s*$"), F.lit(1))
    names = F.regexp_extract_all(plain, F.lit(r"(?m)^(#{1,6}) +(.+?)\s*#*\s*$"), F.lit(2))
    return F.transform(F.arrays_zip(marks.alias("a"), names.alias("b")), lambda x: F.struct(F.length(x.a).alias("depth"), F.trim(x.b).alias("text")))


def table_of_contents(raw: Column, deepest: int = 3, least: int = 1) -> Column:
    """Array of (depth from 0, text, slug) if there are more than ``least`` headings, else an empty one."""
    own = F.filter(headings(raw), lambda h: h.depth <= deepest)
    low = F.array_min(F.transform(own, lambda h: h.depth))
    toc = F.transform(own, lambda h: F.struct((h.depth - low).alias("depth"), h.text.alias("text"), paths.slug_anchor(h.text).alias("slug")))
    return F.when(F.size(own) > least, toc).otherwise(F.filter(toc, lambda h: F.lit(False)))


def heading_text(body: Column, slug: Column) -> Column:
    """From the first heading of that slug to the next that is no deeper; null where there is none."""
    lines = F.split(body, r"\r?\n")
    mark = lambda x: F.regexp_extract(x, r"^(#{1,6}) +(.+?)\s*#*\s*$", 1)
    name = lambda x: paths.slug_anchor(F.trim(F.regexp_extract(x, r"^(#{1,6}) +(.+?)\s*#*\s*$", 2)))
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.length(mark(x)).alias("depth"), name(x).alias("slug"))), lambda h: h.depth > 0)
    start = F.get(F.filter(heads, lambda h: h.slug == slug), F.lit(0))
    stop = F.get(F.filter(heads, lambda h: (h.at > start.at) & (h.depth <= start.depth)), F.lit(0))
    until = F.coalesce(stop.at, F.size(lines))
    return F.when(start.isNotNull(), F.regexp_replace(F.array_join(F.slice(lines, start.at + 1, until - start.at), "\n"), r"\s+\z", ""))


def citations(raw: Column) -> Column:
    """The different keys that a text cites, [@key] or [@a; @b], in order."""
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(r"(?<=[\[;\s])@([A-Za-z0-9_:.#$%&\-+?<>~/]*[A-Za-z0-9_])(?=[^\[\]]*\])"), F.lit(1)))


def hard_breaks(raw: Column) -> Column:
    """Line ends within paragraphs as breaks."""
    return F.regexp_replace(raw, r"(?<=\S)[ \t]*\n(?=[^\n])", "  \n")


def blocks(notes: DataFrame) -> DataFrame:
    """(slug, block_id, line) of the lines that end in an anchor."""
    lines = notes.select("slug", F.explode(F.split("body", r"\r?\n")).alias("line"))
    return lines.select("slug", text.block_id(F.col("line")).alias("block_id"), F.regexp_replace("line", r"\s\^[A-Za-z0-9_\-]+\s*$", "").alias("line")).filter("block_id is not null")


def callouts(notes: DataFrame) -> DataFrame:
    """(slug, kind, n) of the callouts."""
    lines = notes.select("slug", F.explode(F.split("body", r"\r?\n")).alias("line"))
    return lines.select("slug", text.callout_kind(F.col("line"), CALLOUTS).alias("kind")).filter("kind is not null").groupBy("slug", "kind").agg(F.count("*").alias("n"))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))

"""Links between notes: resolution, broken ones, backlinks, transclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import paths
from quire.plans.cut import cut
from quire.plans.workers import reach


def outgoing(notes: DataFrame) -> DataFrame:
    """(src, dst): the different simple slugs that each note links to."""
    target = F.explode_outer("links").alias("t")  # outer, as what is parsed would be parsed once more to ask its size; null is no link
    return notes.select(F.col("slug").alias("src"), target).filter(paths.is_internal(F.col("t"))).select("src", paths.simplify_slug(paths.slugify_path(paths.link_path(F.col("t")))).alias("dst")).distinct()


def broken(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (path, target) that no file answers: by path, by path with .md, or by bare name. files: (path)."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    known = files.select(F.col("path").alias("k")).union(files.select(F.regexp_replace("path", r"\.md$", ""))).union(files.select(name)).distinct()
    own = links.filter(~F.col("target").rlike("^https?://") & ~F.col("target").startswith("#"))
    return own.join(known, own["target"] == known["k"], "left_anti")


def shortest(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """Adds ``slug`` to links (src, target): the only page of that file name, else the target as an absolute path."""
    by_name = slugs.groupBy(F.element_at(F.split("slug", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.min("slug").alias("only"))
    return links.join(by_name, F.col("target") == F.col("name"), "left").withColumn("slug", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("target"))).drop("name", "n", "only")


def resolve(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``path`` to targets (target): the file of that path, else the smallest path of that bare name."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    keys = files.select(F.regexp_replace("path", r"\.md$", "").alias("k"), F.lit(0).alias("o"), "path").union(files.select(name, F.lit(1), "path"))
    best = keys.groupBy("k").agg(F.min(F.struct("o", "path")).alias("b")).select("k", "b.path")
    return targets.join(best, targets["target"] == best["k"], "left").drop("k")


def backlinks(edges: DataFrame) -> DataFrame:
    """(dst, n, sources): who links to each page."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("n"), F.sort_array(F.collect_set("src")).alias("sources"))


def valid(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """Edges to pages that exist."""
    return edges.join(slugs.select(F.col("slug").alias("dst")).distinct(), "dst", "left_semi")


def rewritten_hrefs(notes: DataFrame, slugs: DataFrame) -> DataFrame:
    """(src, target, href): each internal link of each note with the relative address it is rewritten to.

    The target is the only page of that file name, else the path as it stands, as seen from the page.
    """
    own = notes.select(F.col("slug").alias("src"), F.explode("links").alias("raw")).filter(paths.is_internal(F.col("raw"))).distinct()
    plain = own.withColumn("target", paths.slugify_path(paths.link_path(F.col("raw")))).withColumn("anchor", paths.link_anchor(F.col("raw")))
    found = shortest(plain, slugs)
    return found.select("src", F.col("raw").alias("target"), F.concat(paths.resolve_relative(F.col("src"), F.col("slug")), "anchor").alias("href"))


def transclusion_texts(embeds: DataFrame, notes: DataFrame) -> DataFrame:
    """(page, target, anchor, text): what each embed brings in - a block, a heading's range or the whole page.

    embeds: (page, target, anchor), anchor as #^block, #heading or empty; notes: (slug, body). Null where the page holds
    no such block or heading; embeds of pages that aren't there are left out.
    """
    from quire.functions import text
    from quire.operators import markdown

    own = notes.select(F.col("slug").alias("_slug"), "body")
    found = F.when(F.col("anchor").startswith("#^"), text.block_text(F.col("body"), F.substring("anchor", F.lit(3), F.length("anchor"))))
    found = found.when(F.col("anchor").startswith("#"), markdown.heading_text(F.col("body"), F.substring("anchor", F.lit(2), F.length("anchor")))).otherwise(F.col("body"))
    return embeds.join(own, embeds["target"] == own["_slug"]).select("page", "target", "anchor", found.alias("text"))


def transcluded(embeds: DataFrame, blocks: DataFrame, depth: int | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(page, path, depth): pages whose text an embed brings in, directly or through others, each once.

    embeds: (page, target). A page that is reached again is not entered again, which breaks cycles. Without a depth the
    loop goes on until nothing new is found. pages: (page), those to begin with, all by default.
    """
    parts = int(embeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = embeds if pages is None else embeds.join(pages.select("page").distinct(), "page", "left_semi")
    seen = cut(first.select("page", F.col("target").alias("path"), F.lit(1).alias("depth")).distinct())
    front, d = seen, 1
    step = embeds.select(F.col("page").alias("path"), F.col("target").alias("next"))
    while d != depth:
        d += 1
        front = front.join(step, "path").select("page", F.col("next").alias("path")).distinct().filter("page <> path")
        front = front.join(seen, ["page", "path"], "left_anti").withColumn("depth", F.lit(d))
        # Each round is cut: it reads the one before twice, so that plans of several rounds would double with each.
        front = cut(front)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        if d % 4 == 0:
            seen = cut(seen.coalesce(parts))
    return seen.join(blocks.select("path").distinct(), "path", "left_semi")


#: An embed: target, anchor, what it shows.
EMBED = r"!\[\[([^\[\]|#]*)(#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]"


def _inner(body: Column) -> Column:
    """Array of (raw, target, anchor) of the embeds of a text; anchors are #^block, or # and the heading's slug."""
    part = lambda k: F.regexp_extract_all(body, F.lit(EMBED), F.lit(k))
    anchor = lambda a: F.when(a.startswith("#^") | (a == ""), a).otherwise(F.concat(F.lit("#"), paths.slug_anchor(F.trim(F.substring(a, F.lit(2), F.length(a))))))
    target = lambda t: F.when(F.trim(t) == "", "").otherwise(paths.slugify_path(F.trim(t)))
    return F.transform(F.arrays_zip(part(0).alias("r"), part(1).alias("t"), part(2).alias("a")), lambda x: F.struct(x.r.alias("raw"), target(x.t).alias("target"), anchor(x.a).alias("anchor")))


def expanded(notes: DataFrame) -> DataFrame:
    """(slug, text): pages with embeds, each embed replaced by what it brings in, and the embeds of that in turn.

    notes: (slug, body). Within a page every other page is brought in once, at its first place in reading order; further
    embeds of it, and of the page itself, become a line that says so, which ends cycles. Embeds of what isn't there stay.

    Every different (page, anchor) that is embedded anywhere has its text cut out once. Which of them a page reaches is
    found in rounds over the graph of embeds; then their texts meet in one group a page, as large as the page's own result
    can get, and are put together there.
    """
    import pyarrow as pa

    reach(notes.sparkSession)
    own = cut(notes.select("slug", "body", _inner(F.col("body")).alias("inner")).filter(F.size("inner") > 0))
    asked = own.select(F.explode("inner").alias("e")).select(F.col("e.target").alias("target"), F.col("e.anchor").alias("anchor")).filter("target <> ''").distinct()
    found = transclusion_texts(asked.withColumn("page", F.lit("")), notes).filter("text IS NOT NULL")
    units = found.select(F.concat("target", "anchor").alias("unit"), "text").union(own.select("slug", "body")).dropDuplicates(["unit"])
    units = cut(units.select("unit", F.split("text", EMBED, -1).alias("plain"), _inner(F.col("text")).alias("inner")))
    edges = units.select(F.col("unit").alias("page"), F.explode("inner").alias("e")).select("page", F.concat("e.target", "e.anchor").alias("target")).distinct()
    pages = own.select(F.col("slug").alias("page"))
    reached = transcluded(edges, units.select(F.col("unit").alias("path")), pages=pages).select("page", "path")
    every = reached.union(pages.select("page", F.col("page").alias("path"))).distinct().join(units, F.col("path") == F.col("unit")).select("page", "unit", "plain", "inner")
    schema = pa.schema([("slug", pa.string()), ("text", pa.string())])

    def assemble(table: pa.Table) -> pa.Table:
        page = table["page"][0].as_py()
        texts = dict(zip(table["unit"].to_pylist(), zip(table["plain"].to_pylist(), table["inner"].to_pylist())))
        out, met, todo = [], {page}, [(texts[page], 0)]
        while todo:
            (plain, inner), at = todo.pop()
            out.append(plain[at])
            if at == len(inner):
                continue
            todo.append(((plain, inner), at + 1))
            target = inner[at]["target"] or page
            if target in met:
                out.append(f"Circular transclusion detected: {target}")
            elif (more := texts.get(target + inner[at]["anchor"])) is None:
                met.add(target)
                out.append(inner[at]["raw"])
            else:
                met.add(target)
                todo.append((more, 0))
        return pa.table([[page], ["".join(out)]], schema=schema)

    return every.groupBy("page").applyInArrow(assemble, "slug string, text string")

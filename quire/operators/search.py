"""Full-text search: an inverted index, queries by prefix, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields in order of precedence.
FIELDS = ("title", "content", "tags")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def index(pages: DataFrame, key: str = "slug") -> DataFrame:
    """(key, field, token), each once; a prefix of a token finds it. pages: (key, title, content, tags)."""
    field = lambda f, c: F.transform(c, lambda t: F.struct(F.lit(f).alias("field"), t.alias("token")))
    every = F.concat(field("title", tokens(F.col("title"))), field("content", tokens(F.col("content"))), field("tags", F.transform("tags", F.lower)))
    return pages.select(key, F.explode(every).alias("x")).select(key, "x.field", "x.token")


def prefix_index(indexed: DataFrame, key: str = "slug") -> DataFrame:
    """(prefix, key, field), each once: every beginning of every token, so that a word of a query is found by equality.

    Written by ``prefix`` (partitioned, sorted or bucketed) a query reads what it asks for, and not the index.
    """
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substring("token", F.lit(1), n))).alias("prefix")
    return indexed.filter("token <> ''").select(key, "field", each).select("prefix", key, "field").distinct()


#: Keys of one posting block.
POSTINGS = 4096


def store_index(indexed: DataFrame, path: str, parts: int = 200, key: str = "slug", postings: int = POSTINGS) -> None:
    """Writes index() as a sorted dictionary with posting blocks: (token, field, block, keys), a row for up to about ``postings`` keys.

    Files hold ranges of tokens, sorted and without a dictionary of their own, in Parquet's encoding that stores of each
    token only what differs from the one before it. A prefix is a range of tokens, so a query reads the blocks of the
    files whose bounds it falls between. Tokens that many pages hold have several blocks, which no task puts together.
    """
    own = indexed.select("token", "field", key).filter("token <> ''").distinct()
    counts = own.groupBy("token", "field").agg(F.ceil(F.count("*") / postings).alias("blocks"))
    dealt = own.join(counts, ["token", "field"]).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("token", "field", "block").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    order = ["token", "field", "block"]
    writer = blocks.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite")
    writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", str(16 << 20)).parquet(path)


def stored_index(spark: SparkSession, path: str, key: str = "slug") -> DataFrame:
    """What store_index() wrote as index() gives it, for query()."""
    return spark.read.parquet(path).select("token", "field", F.explode("keys").alias(key))


def query(indexed: DataFrame, text: str, limit: int = 8, key: str = "slug") -> DataFrame:
    """(key, field_rank): pages in one of whose fields all words of the query begin a token, best field first.

    indexed: index() or prefix_index(); over the latter words are compared by equality.
    """
    words = list(dict.fromkeys(text.lower().split()))
    if not words:
        return indexed.select(key, F.lit(0).cast("long").alias("field_rank")).limit(0)
    rank = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))
    if "prefix" in indexed.columns:
        rows, hit = indexed.filter(F.col("prefix").isin(words)), [F.max((F.col("prefix") == w).cast("int")) for w in words]
    else:
        # Each condition by itself, as scans know them: over a stored index they choose the blocks that are read.
        rows, hit = indexed.filter(reduce(lambda a, b: a | b, [F.col("token").startswith(w) for w in words])), [F.max(F.col("token").startswith(w).cast("int")) for w in words]
    every = rows.groupBy(key, rank.alias("field_rank")).agg(*[h.alias(f"h{i}") for i, h in enumerate(hit)])
    full = every.filter(" AND ".join(f"h{i} = 1" for i in range(len(hit))))
    return full.groupBy(key).agg(F.min("field_rank").alias("field_rank")).orderBy("field_rank", key).limit(limit)


def tag_marks(tags: Column, term: str, limit: int = 5) -> Column:
    """The first tags of a result as list items, those that hold the term marked."""
    item = lambda t: F.when(F.lower(t).contains(term.lower()), F.concat(F.lit('<li><p class="match-tag">#'), t, F.lit("</p></li>"))).otherwise(F.concat(F.lit("<li><p>#"), t, F.lit("</p></li>")))
    return F.slice(F.transform(tags, item), 1, limit)


def tag_query(pages: DataFrame, tag: str, text: str = "", limit: int = 8, key: str = "slug") -> DataFrame:
    """Pages with a tag that begins so, and whose title or content has all words of the text."""
    own = pages.filter(F.exists("tags", lambda t: F.lower(t).startswith(tag.lower())))
    if text.split():
        own = own.join(_having(index(own, key).filter("field <> 'tags'"), text, key), key, "left_semi")
    return own.orderBy(key).limit(limit).select(key)


def _having(indexed: DataFrame, text: str, key: str) -> DataFrame:
    """(key): all pages, in whatever number, in one of whose fields all words begin a token."""
    words = list(dict.fromkeys(text.lower().split()))
    every = indexed.groupBy(key, "field").agg(*[F.max(F.col("token").startswith(w)).alias(f"h{i}") for i, w in enumerate(words)])
    return every.filter(" AND ".join(f"h{i}" for i in range(len(words)))).select(key).distinct()


def snippets(pages: DataFrame, term: str, width: int = 30, key: str = "slug") -> DataFrame:
    """(key, start, hits): the window of so many tokens with most hits of the query's words, the last of equals."""
    words = [w for w in term.lower().split() if w]
    at = pages.select(key, F.posexplode(F.split("content", r"\s+")).alias("at", "token"))
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.lower("token").startswith(w)).cast("int")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(0, width - 1)
    counted = at.withColumn("hits", F.sum(hit).over(w))
    return counted.groupBy(key).agg(F.max(F.struct("hits", "at")).alias("b")).select(key, F.col("b.at").alias("start"), F.col("b.hits").alias("hits"))


def highlighted(text: Column, term: str) -> Column:
    import re

    words = sorted(set(term.split()), key=lambda w: (-len(w), w))
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, words)) + ")", '<span class="highlight">$1</span>') if words else text

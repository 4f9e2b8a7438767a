"""Benchmark decontamination with DataFrame functions only (operator 2).

The windows of a benchmark item are its runs of ``n`` consecutive words, or all its words if there are fewer. Any
window of n words holds a whole aligned block of b = (n + 1) // 2 words of the document it stands in - a block that
begins at a multiple of b. So the scan hashes a document's aligned blocks only, a b-th of its positions, and looks
them up in the set of the benchmark's b-grams; windows around a block that hits are then compared word for word.

The set is broadcast to the scan as a hash relation of 8-byte hashes, in passes by ranges of the hash: as many as keep
each pass below ``SET_BYTES``, which is measured. A first pass over the texts writes the hashes of their blocks (about a
quarter of the text) beside them under a number for each row, so a pass reads hashes alone, and what follows goes by
that number: no key, text or null is met by two rows. Only rows with a hit have their words compared. The windows are
broadcast too where their measured bytes allow it, else joined.

hits() and decontaminate() write these tables and count the benchmark as they are called, before their result is read.

Cases: a null text or item has no words; an empty benchmark hits nothing; equal items hit together; rows of documents
stand alone, so repeated rows repeat the answer and a null doc_id says nothing of other rows; a null item_id is left out
of the item list; texts are whole; further columns are passed on by decontaminate() and ignored by hits(), whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.columns import own as col

#: What separates words once A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bytes of hashes, at ENTRY each in a hash relation, or of windows that are broadcast at once.
SET_BYTES, ENTRY = 64 << 20, 32


def words_of(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased already."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def lower_az(text: Column) -> Column:
    """A-Z alone; dear on long texts, as it goes by characters."""
    return F.translate(text, *AZ)


def item_windows(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """(item_id, words): the different windows of each item, each an array of words."""
    words = words_of(lower_az(benchmark[text].cast("string")))
    rows = benchmark.select(benchmark[item].cast("string").alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(n - 1), F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("words")).distinct()


def folded(text: Column) -> Column:
    """Lower case by characters alone, so that words equal but for A-Z are equal in it whatever stands around them.

    The only character that lower() changes by its surroundings, the final sigma, is put aside first.
    """
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def _blocks(windows: DataFrame, length: int) -> DataFrame:
    """(h): hashes of the b-grams that can be the first aligned block inside a window of this length."""
    b = (length + 1) // 2
    own = windows.filter(F.size("words") == length).select(F.transform("words", folded).alias("w"))
    return own.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(length - b + 1)), lambda i: F.xxhash64(F.slice("w", i, b)))).alias("h")).distinct()


def _hashes(b: int) -> Column:
    """Of the aligned blocks of the array w, in order."""
    whole = F.floor(F.size("w") / b).cast("int")
    places = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda q: F.xxhash64(F.slice("w", q * b + 1, b)))


def scanned(docs: DataFrame, columns: list[str], text: str, lengths: list[int]) -> DataFrame:
    """(row, c0, c1, ... as columns, text, n_words, h<length> ...), written: the hashes of each row's blocks."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[col(c).alias(f"c{i}") for i, c in enumerate(columns)], col(text).cast("string").alias("text"))
    # Named more than once, w stays a column of its own; else the optimizer would split the text anew for each use.
    rows = rows.withColumn("w", words_of(folded(F.col("text")))).withColumn("n_words", F.size("w").cast("long"))
    return staging.table(rows.withColumns({f"h{x}": _hashes((x + 1) // 2) for x in lengths}).drop("w"), "scanned")


def near(table: DataFrame, windows: DataFrame, lengths: list[int], set_bytes: int) -> DataFrame:
    """(row, places), written: the places (start, length) where windows may stand, of the rows that have any."""
    found = []
    for length in lengths:
        b, blocks = (length + 1) // 2, staging.table(_blocks(windows, length), "grams")
        passes = max(1, -(-blocks.count() * ENTRY // set_bytes))
        each = table.select("row", F.posexplode(f"h{length}").alias("q", "h"))
        for k in range(passes):
            part = blocks.filter(F.pmod("h", F.lit(passes)) == k) if passes > 1 else blocks
            hit = each.join(F.broadcast(part), "h", "left_semi")
            # The windows whose first aligned block is q.
            starts = F.sequence(F.greatest(F.col("q") * b - (b - 1), F.lit(0)), F.col("q") * b)
            found.append(hit.select("row", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length")))).alias("p")))
    every = reduce(DataFrame.unionAll, found)
    return staging.table(every.groupBy("row").agg(F.array_sort(F.collect_set("p")).alias("places")), "near")


def _found(docs: DataFrame, columns: list[str], benchmark: DataFrame, n: int, text: str, item: str, item_text: str, set_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The table of scanned(), and (row, start, length, item_id) of every window that occurs."""
    windows = staging.table(item_windows(benchmark, n, item, item_text), "windows")
    # At most n lengths, and one number.
    sizes = windows.groupBy(F.size("words").alias("length")).agg(F.sum(F.length(F.array_join("words", " ")) + 40 + F.size("words") * 16).alias("bytes")).orderBy("length").collect()
    lengths = [r.length for r in sizes]
    table = scanned(docs, columns, text, lengths)
    if not lengths:
        return table, table.select("row", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("item_id")).limit(0)
    places = near(table, windows, lengths, set_bytes)
    own = table.select("row", "text").join(places, "row").select("row", "places", words_of(lower_az(F.col("text"))).alias("w"))
    cut = F.filter(F.transform("places", lambda p: F.struct(p.start.alias("start"), p.length.alias("length"), F.slice("w", p.start + 1, p.length).alias("words"))), lambda p: F.size(p.words) == p.length)
    # explode() would have a filter inferred that splits the text anew for each place, hence the outer one.
    each = own.select("row", F.explode_outer(F.when(F.size("w") > 0, cut)).alias("p")).select("row", "p.*")
    few = sum(r.bytes for r in sizes) <= set_bytes
    return table, each.join(F.broadcast(windows) if few else windows, "words").select("row", "start", "length", "item_id")


def _union_length(spans: Column) -> Column:
    """Words covered by an array of structs (start, length), sorted by start."""
    step = lambda acc, s: F.struct(
        (acc.total + F.greatest(s.start + s.length - F.greatest(acc.upto, s.start), F.lit(0))).cast("long").alias("total"),
        F.greatest(acc.upto, s.start + s.length).alias("upto"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto")), step, lambda acc: acc.total)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items (item_ids as sorted strings), spans, contaminated.

    spans: the covered places as an array of (start, length) in words, as they occur, sorted, each once.
    """
    table, found = _found(docs, [key], benchmark, n, text, item, item_text, set_bytes)
    per = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    per = per.withColumn("n_hit", _union_length(F.col("spans")))
    all_rows = table.select("row", F.col("c0").alias("doc_id"), "n_words").join(per, "row", "left")
    no_spans, no_items = F.array().cast("array<struct<start:int,length:int>>"), F.array().cast("array<string>")
    out = all_rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", no_items).alias("items"), F.coalesce("spans", no_spans).alias("spans"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """docs without the rows that any window of the benchmark occurs in; every row is judged by its own text."""
    table, found = _found(docs, docs.columns, benchmark, n, text, item, item_text, set_bytes)
    # A written table, so that its size is known: while it is small, the texts need no shuffle.
    gone = staging.table(found.select("row").distinct(), "contaminated")
    left = table.join(gone, "row", "left_anti")
    return left.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)

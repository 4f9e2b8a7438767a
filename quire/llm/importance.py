"""Importance resampling towards a target's distribution (operator 11), with DataFrame functions only.

A text's features are its runs of 1 to ``most`` consecutive words, hashed to buckets by crc32. One pass over the texts
writes the buckets of each row's features as an array of small numbers. The arrays are exploded twice: once for the
counts of the buckets, which combine before their shuffle to at most as many rows a task as there are buckets, and once
to meet the gains. The gain table has a row for each bucket, a constant of the program, so it is broadcast whatever the
input; a row's gains are summed where they are read. Rows are drawn by score, to which a Gumbel value from a hash of the
id is added: the highest ones of such scores are a sample without replacement in proportion to exp(weight / 1000). The
ranks come from a range sort and one offset a partition (``cut.numbered``).

Cases: a null or empty text has no words, no features and weight 0, and is never drawn; a null id hashes like an empty
one and comes last among ties; rows of one id share its random value, are judged each by its own text and tie in the order
of their texts' hashes; with an empty target all gains come from the documents alone; further columns are passed on by
sample() and ignored by scored(), whatever their names. A share draws floor(share * eligible / 100) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.decontaminate import AZ
from quire.plans.cut import numbered

BUCKETS, MOST = 10_000, 3
#: What separates words: ASCII other than letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text as they stand, A-Z lower-cased; only words that have an upper case are translated."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")
    return F.transform(words, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, *AZ)))


def _features(words: Column, most: int, buckets: int) -> Column:
    """The bucket of every run of 1 to most words."""

    def runs(word: Column, at: Column) -> Column:
        grams, gram = [word], word
        for k in range(1, most):
            gram = F.concat(gram, F.lit(" "), F.get(words, at + k))  # null beyond the end
            grams.append(gram)
        return F.array(*[(F.crc32(g.cast("binary")) % buckets).cast("smallint" if buckets <= 2**15 else "int") for g in grams])

    return F.array_compact(F.flatten(F.transform(words, runs)))


def hashed(df: DataFrame, columns: list[str], text: str, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(row, c0, c1, ... as columns, h, n_words, features), written: the buckets of each row's features, repeats included."""
    body = F.col(f"`{text}`").cast("string")
    rows = df.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.xxhash64(body).alias("h"), body.alias("text"))
    rows = rows.withColumn("w", words_of(F.col("text"))).withColumn("n_words", F.size("w").cast("long"))
    return staging.table(rows.withColumn("features", _features(F.col("w"), most, buckets)).drop("text", "w"), "features")


def bucket_counts(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.explode("features").alias("bucket")).select(F.col("bucket").cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), written, a row for each bucket: 1000 times the log of its smoothed share in target over that in own."""
    every = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_counts(own, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = staging.table(both, "buckets")
    total = both.agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(F.lit(1000.0) * F.log((t + 1) * F.lit(total.s + buckets) / ((s + 1) * F.lit(total.t + buckets))))
    return both.select("bucket", gain.alias("gain"))


def _scored(docs: DataFrame, columns: list[str], target: DataFrame, key: str, text: str, target_text: str, most: int, buckets: int, seed: int) -> DataFrame:
    """A row for each of docs, written: row, c0, c1, ..., k as key, h, n_words, n_features, weight, score."""
    table = hashed(docs, [*columns, key], text, most, buckets)
    names = [f"c{i}" for i in range(len(columns))]
    gain = gains(table, hashed(target, [], target_text, most, buckets), buckets)
    one = table.select("row", F.explode("features").alias("b")).join(F.broadcast(gain), F.col("b").cast("int") == F.col("bucket"))
    weights = one.groupBy("row").agg(F.sum("gain").alias("weight"))
    all_rows = table.select("row", *names, F.col(f"c{len(columns)}").alias("k"), "h", "n_words", F.size("features").cast("long").alias("n_features"))
    out = all_rows.join(weights, "row", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return staging.table(out.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share)))), "scored")


def _ranks(table: DataFrame, least: int, share: int) -> DataFrame:
    """(row, rank) of the rows that are drawn."""
    eligible = table.filter(F.col("n_words") >= least)
    drawn = share * eligible.count() // 100
    placed = numbered(eligible.select("row", "score", "k", "h"), F.desc("score"), F.asc_nulls_last("k"), "h", "row")
    return placed.filter(F.col("rank") <= drawn).select("row", "rank")


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", least: int = 20, share: int = 5, most: int = MOST, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank from 1 of those that are drawn (else null), n_words.

    Drawn are share per cent of the rows of at least ``least`` words, the highest scores.
    """
    table = _scored(docs, [], target, key, text, target_text, most, buckets, seed)
    return table.join(_ranks(table, least, share), "row", "left").select(F.col("k").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


def sample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", least: int = 20, share: int = 5, most: int = MOST, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """The rows of docs that are drawn, all columns."""
    table = _scored(docs, docs.columns, target, key, text, target_text, most, buckets, seed)
    left = table.join(_ranks(table, least, share), "row", "left_semi")
    return left.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)

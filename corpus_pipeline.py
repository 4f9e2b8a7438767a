"""The training-data pipeline: five stages over documents, each written as Parquet and read back as the next one's input.

What the stages drop: documents that score as toxic; lines that another document holds; all but one of a group of
similar documents; documents that hold a passage of the benchmark. The last stage encodes what is left as token ids.
Every stage takes null and empty texts, repeated rows and columns beyond those of documents, whatever their names; all
but the last pass these on. A stage's result is lazy; what it reads stays while it can be read (see ``staging``). run()
writes each result and removes at once what was staged for it, and the one before; runs in several threads are apart.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontaminate, folds, line_dedup, simhash, staging, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a classifier that learns from the labelled ones outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, train=~folds.held_out(F.col("doc_id"), 5, 0)))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that stand in a document of a smaller doc_id too."""
    return line_dedup.drop_lines(docs, counts=False)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of a similarity of 0.8 or more over five-word shingles, that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs, each judged by its own text."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True, pattern=public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", remove_toxic),
    ("line-dedup", remove_lines),
    ("simhash-near-dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("byte-bpe", encode),
]

#: A trained classifier and token ids are beyond SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = staging.settled(spark, lambda f=stage, read=docs: f(spark, read, sf_dir), name)
        staging.remove(spark, [before] if before else [])
        before = path
    return docs

"""One query for each operator of this subpackage, over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import quality, staging
    from quire.llm.folds import held_out

    measured = staging.table(quality.measure(read(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(measured, read(spark, sf_dir, "labels"), train=~held_out(F.col("doc_id"), 4, 2))
    return quality.score(measured, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import decontaminate

    found = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import licences

    return licences.scan(read(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import staging, token_shards

    entries = token_shards.write(read(spark, sf_dir, "documents"), staging.new_dir(spark, "shards"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_shards.read(spark, entries, digests=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import toxicity
    from quire.llm.folds import held_out

    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train=~held_out(F.col("doc_id"), 5, 0))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import simhash

    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import line_dedup

    return line_dedup.drop_lines(read(spark, sf_dir, "documents"), digests=True)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import embedding_dedup

    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def linked_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 where there are links: every vector with a longer one of its direction and one whose components lean a little."""
    from quire.llm import embedding_dedup

    v, k = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    longer = v.select((k + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(3.0).cast("float")).alias("embedding"), "label")
    leaning = v.select((k + 2_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: x * (F.lit(1.0) + (i % 3 - 1) * F.lit(0.125)).cast("float")).alias("embedding"), "label")
    return embedding_dedup.near_duplicates(v.unionAll(longer).unionAll(leaning))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import substring_dedup

    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), digests=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import byte_bpe

    return byte_bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True, pattern=public_tokenizers.PATTERN)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import importance

    return importance.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import mixing

    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import ranked

    return ranked.search(ranked.build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality, op2_decontaminate, op3_licences, op4_token_shards, op5_toxicity, op6_simhash, op7_line_dedup, op8_embedding_dedup, op9_substring_dedup, op10_byte_bpe,
        op11_importance_resampling, op12_source_mixing, op13_ranked_search, linked_embeddings,
    )
}

#: Upper and lower case of A-Z alone, for translate().
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2_SQL = f"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM benchmark
), win AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g FROM item, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0
), size AS (SELECT DISTINCT len(g) AS n FROM win
), place AS (
    SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM doc, size, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n
), occ AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON p.g = win.g
), hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM occ, unnest(generate_series(i, i + n - 1)) AS t(j) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
       sha256(coalesce(s.k, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items s ON d.doc_id = s.doc_id
"""


def op3_sql() -> str:
    """The index of the operator as VALUES; the rest is counting."""
    from quire.llm.licences import SHARE, build_index

    templates, entries = build_index()
    posted = ", ".join(f"('{e.word}', {e.template}, {e.position}, {int(e.mandatory)})" for e in entries)
    names = ", ".join(f"({i}, '{t.label}', {t.base}, {t.entries}, {t.mandatory})" for i, t in enumerate(templates))
    return f"""
WITH posted(word, template, position, must) AS (VALUES {posted}), names(template, label, base, entries, mandatory) AS (VALUES {names}),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents
), word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM doc
), tally AS (
    SELECT doc_id, template, pos - position AS start, count(*) AS agree, sum(must) AS must FROM word JOIN posted USING (word) GROUP BY ALL
), fit AS (SELECT * FROM tally JOIN names USING (template) WHERE must = mandatory AND agree >= entries * {SHARE}
), per AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
           max(agree / entries) AS score FROM fit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM doc d LEFT JOIN per p ON d.doc_id = p.doc_id
"""


OP7_SQL = f"""
WITH line AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_AZ}) AS key FROM line
), shared AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: All pairs; what links here are whole groups, so the smallest of a vector's links names its component.
LINKED_SQL = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
    UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: CAST(x * CAST(3 AS FLOAT) AS DOUBLE)), label FROM embeddings
    UNION ALL SELECT vec_id + 2000000, list_transform(embedding, lambda x, i: CAST(x * CAST(1 + ((i - 1) % 3 - 1) * 0.125 AS FLOAT) AS DOUBLE)), label FROM embeddings
), pair AS (SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98)
SELECT v.vec_id, count(other) AS n_links, least(v.vec_id, coalesce(min(other), v.vec_id)) AS component_id, v.vec_id < coalesce(min(other), v.vec_id + 1) AS kept
FROM v LEFT JOIN pair ON v.vec_id = pair.vec_id GROUP BY v.vec_id
"""

#: crc32 of a text's bytes by its table: a byte at a time, over each different run of words once.
OP11_SQL = f"""
WITH crc AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)
    )
), text AS (
    SELECT true AS own, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents
    UNION ALL SELECT false, 0, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) FROM benchmark
), gram AS (
    SELECT own, id, array_to_string(list_slice(w, i, i + n), ' ') AS g FROM text, unnest(generate_series(1, len(w))) AS a(i), (VALUES (0), (1), (2)) AS b(n) WHERE i + n <= len(w)
), hexed AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM gram)
), bucket AS (
    SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
                              lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) % 10000 AS b FROM hexed, crc
), feature AS (SELECT own, id, b FROM gram JOIN bucket USING (g)
), tally AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM feature GROUP BY b
), total AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM tally
), gain AS (
    SELECT b, CAST(floor(1000.0::DOUBLE * ln((tally.t::DOUBLE + 1) * (total.s + 10000) / ((tally.s::DOUBLE + 1) * (total.t + 10000)))) AS BIGINT) AS gain FROM tally, total
), weighed AS (SELECT id, sum(gain) AS weight FROM feature JOIN gain USING (b) WHERE own GROUP BY id
), scored AS (
    SELECT d.id AS doc_id, len(d.w) AS n_words, CASE WHEN len(d.w) < 2 THEN len(d.w) ELSE 3 * len(d.w) - 3 END AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || sha256('42:' || d.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM text d LEFT JOIN weighed USING (id) WHERE d.own
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

OP12_SQL = r"""
WITH doc AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM doc GROUP BY source
), capped AS (
    SELECT *, (3 * source_size)::DOUBLE / weight AS ratio,
           (sum(source_size) OVER ())::DOUBLE - (coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE AS words,
           (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS weights
    FROM source WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT arg_min(words / weights, ratio) AS level FROM capped WHERE words / weights <= ratio
), goal AS (
    SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target,
           (CAST('0x' || sha256('42:' || coalesce(source, ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS o FROM capped, level
), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) AS i FROM doc
), stepped AS (
    SELECT p.*, source_size, target, o, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
), crossed AS (SELECT *, CAST(floor(r * i + o) - floor(r * (i - 1) + o) AS BIGINT) AS copies FROM stepped)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM crossed
"""

OP13_SQL = f"""
WITH doc AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD})) AS term FROM documents
), posting AS (SELECT doc_id, term, count(*) AS tf FROM doc GROUP BY ALL
), size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY doc_id
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size
), norm AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM size, total
), item AS (
    SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD})) AS term FROM benchmark) GROUP BY ALL
), weight AS (
    SELECT term, CAST(floor(1000.0::DOUBLE * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM posting, total GROUP BY term
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM item JOIN weight USING (term) JOIN posting USING (term) JOIN norm USING (doc_id) GROUP BY ALL
), placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""

#: DuckDB SQL, where SQL expresses the operator.
ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL, "op3_licences": op3_sql(), "op7_line_dedup": OP7_SQL,
    "op11_importance_resampling": OP11_SQL, "op12_source_mixing": OP12_SQL, "op13_ranked_search": OP13_SQL, "linked_embeddings": LINKED_SQL,
}

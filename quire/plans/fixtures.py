"""Notes and the like made from the plain tables, the same in Spark and in SQL, to run the operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Kinds that callouts of notes have in turn.
CALLOUT_KINDS = ("hint", "caution", "own", "faq", "note", "error", "tldr")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw): regions, nations that link to each other, customers that link to their nation."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    region = r.select(F.format_string("region/%s.md", "r_name").alias("path"), F.format_string("---\ntitle: %s\ntags: [geo/region]\n---\n# %s\n\nA region. ^top", "r_name", "r_name").alias("raw"))
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    kind = F.element_at(F.array(*map(F.lit, CALLOUT_KINDS)), F.col("n_nationkey") % len(CALLOUT_KINDS) + 1)
    part = F.when(F.col("n_nationkey") % 2 == 1, F.format_string("\n### Part %d\n\nText %d ^b%d\n", "n_nationkey", "n_nationkey", "n_nationkey")).otherwise("")
    nation = named.select(
        F.format_string("nation/%s.md", "n_name"),
        F.format_string(
            "---\ntitle: %s\ntags:\n  - geo/nation\n  - region/%s\naliases: [Nation %d]\ndate: 2024-01-%02d\n---\nLies in [[%s]]. #land\n\n## Relationships\n\n- [[nation/NATION_%d|neighbour]]\n- [[Missing %d]]\n\n## Notes\n\n> [!%s] Fine\n%s",
            "n_name", "r_name", "n_nationkey", F.col("n_nationkey") + 1, "r_name", (F.col("n_nationkey") + 1) % 25, "n_nationkey", kind, part,
        ),
    )
    stub = F.when(F.col("c_custkey") % 5 == 0, "\n- TODO").otherwise("")
    customer = c.select(
        F.format_string("customer/c%d.md", "c_custkey"),
        F.concat(
            F.format_string("---\ntitle: %s\ndraft: %s\ntag: segment/%s\n---\nLives in [[NATION_%d]] near [[nation/NATION_%d|home]].", "c_name", F.when(F.col("c_custkey") % 7 == 0, "true").otherwise("false"), F.lower("c_mktsegment"), "c_nationkey", "c_nationkey"), stub
        ),
    )
    return region.union(nation).union(customer)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.notes import parse_notes

    return parse_notes(notes(spark, sf_dir), F.lit("2024-06-01").cast("timestamp"))


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body) of the benchmark's items and of conversations' turns."""
    b, c = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "conversations")
    return b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("body")).union(c.select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text"))


#: What notes() and parsed() hold, straight from the tables.
NOTES_SQL = """
note AS (
    SELECT 'region/' || r_name || '.md' AS path, 'region' AS folder, 'region/' || replace(r_name, ' ', '-') AS slug, r_name AS title, ['geo/region'] AS tags, CAST([] AS VARCHAR[]) AS aliases,
           false AS draft, TIMESTAMP '2024-06-01' AS modified, CAST([] AS VARCHAR[]) AS links, false AS stub FROM region
    UNION ALL
    SELECT 'nation/' || n_name || '.md', 'nation', 'nation/' || n_name, n_name, ['geo/nation', 'region/' || replace(r_name, ' ', '-'), 'land'], ['Nation ' || n_nationkey],
           false, CAST(DATE '2024-01-01' + n_nationkey AS TIMESTAMP), [r_name, 'nation/NATION_' || ((n_nationkey + 1) % 25), 'Missing ' || n_nationkey], false
    FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 'customer/c' || c_custkey || '.md', 'customer', 'customer/c' || c_custkey, c_name, ['segment/' || lower(c_mktsegment)], CAST([] AS VARCHAR[]),
           c_custkey % 7 = 0, TIMESTAMP '2024-06-01', ['NATION_' || c_nationkey, 'nation/NATION_' || c_nationkey], c_custkey % 5 = 0 FROM customer
)"""
#: The bodies of the notes, links reduced to what they show.
FLAT_SQL = """
flat AS (
    SELECT 'region' AS folder, 'region/' || r_name || '.md' AS path, '# ' || r_name || chr(10) || chr(10) || 'A region. ^top' AS text FROM region
    UNION ALL
    SELECT 'nation', 'nation/' || n_name || '.md', 'Lies in ' || r_name || '. #land' || chr(10) || chr(10) || '## Relationships' || chr(10) || chr(10) || '- neighbour' || chr(10) || '- Missing ' || n_nationkey
           || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || '> [!' || ['hint', 'caution', 'own', 'faq', 'note', 'error', 'tldr'][n_nationkey % 7 + 1] || '] Fine'
           || CASE WHEN n_nationkey % 2 = 1 THEN chr(10) || chr(10) || '### Part ' || n_nationkey || chr(10) || chr(10) || 'Text ' || n_nationkey || ' ^b' || n_nationkey ELSE '' END
    FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 'customer', 'customer/c' || c_custkey || '.md', 'Lives in NATION_' || c_nationkey || ' near home.' || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || '- TODO' ELSE '' END FROM customer
)"""
TEXT_SQL = "body AS (SELECT 'b' || item_id AS id, text AS body FROM benchmark UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations)"

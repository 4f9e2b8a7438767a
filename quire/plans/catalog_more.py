"""More queries over the plain tables: sources, reports, pages, outputs and the pieces of notes, each with its SQL.

Inputs vary by row, so that each branch of an operator is run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import curation, paths, text
from quire.operators import entities, graph, hierarchy, links, markdown, search, windows
from quire.plans.fixtures import NOTES_SQL, parsed, read
from quire.sources import notes, reports, sinks
from quire.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Front matter


def _forms(spark, d) -> DataFrame:
    """Parts as notes in five notations of front matter, by their number; some begin with blank lines."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    name, n = F.col("p_name"), k.cast("string")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("\n \t\n---\ntitle: "), name, F.lit("\naliases: [A"), n, F.lit(', "B'), n, F.lit('"]\npermalink: p/'), n, F.lit("\n---\n\n text \n")))
        .when(k % 5 == 1, F.concat(F.lit('+++\ntitle = "'), name, F.lit('"\ntags = ["x", "y z"]\n+++\ntext')))
        .when(k % 5 == 2, F.concat(F.lit("---\n---\n# "), name, F.lit("\ntext")))
        .when(k % 5 == 3, F.concat(F.lit("---\naliases:\n  - A"), n, F.lit("\n# note\n- 'B'\ntag: x\naliases:\n  - C"), n, F.lit("\n---\ntext")))
        .otherwise(F.concat(name, F.lit(" ---\nno: block\n---\n")))
    )
    return p.select(k, "p_name", F.format_string("parts/p%d.md", k).alias("path"), raw.alias("raw"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE 'p' || p_partkey END AS title,
    CASE p_partkey % 5 WHEN 0 THEN 'A' || p_partkey || '|B' || p_partkey || '|p/' || p_partkey WHEN 3 THEN 'A' || p_partkey ELSE '' END AS aliases,
    CASE p_partkey % 5 WHEN 1 THEN 'x|y-z' WHEN 3 THEN 'x' ELSE '' END AS tags,
    CASE p_partkey % 5 WHEN 2 THEN '# ' || p_name || chr(10) || 'text' WHEN 4 THEN p_name || ' ---' || chr(10) || 'no: block' || chr(10) || '---' ELSE 'text' END AS body FROM part""")
def front_matter_forms(spark, d):
    join = lambda c: F.array_join(c, "|").alias(c)
    return notes.parse_notes(_forms(spark, d)).select(F.substring("path", 8, 100).alias("f"), "title", join("aliases"), join("tags"), "body").select(F.regexp_extract("f", r"(\d+)", 1).cast("long").alias("p_partkey"), "title", "aliases", "tags", "body")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN 'A' || p_partkey || '|''B''|C' || p_partkey ELSE '' END AS aliases, CASE WHEN p_partkey % 5 = 3 THEN 'A' || p_partkey ELSE '' END AS indented FROM part WHERE p_partkey % 5 <> 0""")
def listed_aliases(spark, d):
    rows = _forms(spark, d).filter("p_partkey % 5 <> 0")
    own = rows.select("p_partkey", notes.listed_fields(F.col("raw")).alias("f"), notes.indented_list(notes.front_matter(F.col("raw")), "aliases").alias("i"))
    return own.select("p_partkey", F.array_join("f.aliases", "|").alias("aliases"), F.array_join("i", "|").alias("indented"))


@query(f"WITH {NOTES_SQL}, n AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS stem, aliases FROM note), e AS (SELECT lower(stem) AS name, stem AS canonical, 0 AS o, path FROM n UNION ALL SELECT lower(unnest(aliases)), stem, 1, path FROM n) SELECT name, canonical FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o DESC, path DESC) AS r FROM e) WHERE r = 1")
def place_names(spark, d):
    return notes.place_names(parsed(spark, d))


@query("SELECT 'u/' || user_id || '.md' AS path, max(date_trunc('second', ts)) AS modified FROM events GROUP BY user_id")
def git_dates(spark, d):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    commits = read(spark, d, "events").select(F.concat(stamp, F.lit("\n\n"), F.format_string("u/%d.md", "user_id"), F.lit("\n")).alias("value"))
    return notes.git_dates(commits).withColumn("modified", F.col("modified").cast("timestamp_ntz"))


@query("""WITH p AS (SELECT p_partkey, ['src/a' || p_partkey || '.log', 'build/x/' || p_partkey, 'keep/a.log', 'docs/p' || p_partkey || '.md', 'src/build/y.md', 'docs/tmp'][p_partkey % 6 + 1] AS path FROM part)
SELECT p_partkey, path = 'keep/a.log' OR path LIKE 'docs/%' OR path = 'src/build/y.md' AS kept FROM p""")
def ignore_rules(spark, d):
    k = F.col("p_partkey")
    forms = F.array(F.format_string("src/a%d.log", k), F.format_string("build/x/%d", k), F.lit("keep/a.log"), F.format_string("docs/p%d.md", k), F.lit("src/build/y.md"), F.lit("docs/tmp"))
    path = F.element_at(forms, (k % 6 + 1).cast("int"))
    return read(spark, d, "part").select(k, notes.not_ignored(path, ["# rules", "", "*.log", "!keep/a.log", "/build", "docs/tmp/"]).alias("kept"))


# Paths: the cases of the path functions

@query("SELECT p_partkey, p_brand || '/' || p_type AS raw, replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '-') || '/' || p_partkey AS slug, '../..' AS root, replace(p_brand, '#', '') || '|' || replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '-') AS folders, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '#part-' || p_partkey END AS anchor FROM part")
def path_functions(spark, d):
    raw = F.concat_ws("/", "p_brand", "p_type")
    slug = paths.slugify_path(F.concat(raw, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")))
    link = F.when(F.col("p_partkey") % 2 == 0, slug).otherwise(F.concat(slug, F.lit("#Part "), F.col("p_partkey").cast("string")))
    return read(spark, d, "part").select("p_partkey", raw.alias("raw"), slug.alias("slug"), paths.root_of(slug).alias("root"), F.array_join(paths.folders(slug), "|").alias("folders"), paths.link_anchor(link).alias("anchor"))


@query(f"WITH {NOTES_SQL}, l AS (SELECT DISTINCT slug AS src, unnest(links) AS target FROM note), f AS (SELECT regexp_extract(slug, '[^/]*$') AS name, count(*) AS n, min(slug) AS sole FROM note GROUP BY 1) SELECT src, target, '../' || CASE WHEN n = 1 THEN sole ELSE replace(target, ' ', '-') END AS href FROM l LEFT JOIN f ON replace(target, ' ', '-') = name")
def rewritten_hrefs(spark, d):
    p = parsed(spark, d)
    return links.rewritten_hrefs(p, p.select("slug"))


# Pieces of notes


def _part_notes(spark, d) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("Intro\n\n# Top\n\nfirst\n\n## Sub "), k, F.lit("\n\nsecond "), F.col("p_name"), F.lit("\n\n- item one\n- item "), k, F.lit(" ^i"), k, F.lit("\n\n### Deep\n\nthird\n\n## Last\n\nfourth"))
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit("p/"), k).alias("slug"), body.alias("body"))


@query("""SELECT p_partkey, ['## Sub ' || p_partkey || chr(10) || chr(10) || 'second ' || p_name || chr(10) || chr(10) || '- item one' || chr(10) || '- item ' || p_partkey || ' ^i' || p_partkey || chr(10) || chr(10) || '### Deep' || chr(10) || chr(10) || 'third',
    '- item ' || p_partkey, '### Deep' || chr(10) || chr(10) || 'third', NULL][p_partkey % 4 + 1] AS text FROM part""")
def transclusion_texts(spark, d):
    own, k = _part_notes(spark, d), F.col("p_partkey")
    anchor = F.when(k % 4 == 0, F.format_string("#sub-%d", k)).when(k % 4 == 1, F.format_string("#^i%d", k)).when(k % 4 == 2, "#deep").otherwise("#missing")
    embeds = own.select(F.lit("page").alias("page"), F.col("slug").alias("target"), anchor.alias("anchor"))
    found = links.transclusion_texts(embeds, own.select("slug", "body"))
    return found.select(F.substring("target", 3, 20).cast("long").alias("p_partkey"), "text")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/b|deep-' || p_partkey WHEN 1 THEN chr(127922) || 'dice' ELSE '' END AS tags,
    CASE p_partkey % 4 WHEN 0 THEN 'https://www.youtube.com/embed/dQw4w9WgXcQ' WHEN 1 THEN 'https://www.youtube.com/embed/dQw4w9WgXcQ?list=L' || p_partkey WHEN 2 THEN 'https://www.youtube.com/embed/videoseries?list=L' || p_partkey END AS embed,
    CASE p_partkey % 2 WHEN 0 THEN 'a b' ELSE 'b' END AS classes, ['1f3b2', '1f468-200d-1f469'][p_partkey % 2 + 1] AS code FROM part""")
def marks_and_embeds(spark, d):
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, F.format_string("x #a/b y#no #deep-%d #12/3", k)).when(k % 3 == 1, "#\U0001f3b2dice").otherwise("no # tag")
    url = F.when(k % 4 == 0, "https://youtu.be/dQw4w9WgXcQ").when(k % 4 == 1, F.format_string("https://www.youtube.com/watch?v=dQw4w9WgXcQ&list=L%d", k)).when(k % 4 == 2, F.format_string("https://www.youtube.com/playlist?list=L%d", k)).otherwise("https://example.org/x")
    face = F.when(k % 2 == 0, "\U0001f3b2").otherwise("\U0001f468‍\U0001f469️")
    return read(spark, d, "part").select(k, F.array_join(text.inline_tags(body), "|").alias("tags"), text.youtube_embed(url).alias("embed"), text.class_names(F.when(k % 2 == 0, "a").otherwise(""), F.lit("b"), F.lit(None).cast("string")).alias("classes"), text.emoji_code(face).alias("code"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey || '|b:2' ELSE '' END AS cited, 'one  ' || chr(10) || p_name || chr(10) || chr(10) || 'two' AS broken FROM part")
def citations_and_breaks(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.format_string("so [@a%d; @b:2, p. 3] and [@a%d]", k, k)).otherwise("mail me@example.org [x]")
    return read(spark, d, "part").select(k, F.array_join(markdown.citations(raw), "|").alias("cited"), markdown.hard_breaks(F.concat(F.lit("one\n"), F.col("p_name"), F.lit("\n\ntwo"))).alias("broken"))


@query("SELECT 'part' || p_partkey AS key, 'book' AS type, unnest(['title', 'year', 'note']) AS field, unnest([p_name, CAST(1900 + p_size AS VARCHAR), 'a {b} c']) AS value FROM part")
def bibliography(spark, d):
    raw = F.concat(F.lit("@Book{part"), F.col("p_partkey").cast("string"), F.lit(",\n  Title = {"), F.col("p_name"), F.lit('},\n  year = '), (1900 + F.col("p_size")).cast("string"), F.lit(',\n  note = {a {b} c}\n}\n'))
    return reports.bibliography(read(spark, d, "part").select(raw.alias("value")))


# Reports (K9-K13, A5-A9, A15, S9-S15, P6, P7, P24, W2-W4)


def _coverage(spark, d) -> DataFrame:
    """Customers as entities, orders as files, by what lines say of them: links for shipped orders, text for others."""
    o = read(spark, d, "orders")
    m = o.select(F.format_string("C%d", "o_custkey").alias("canonical"), F.format_string("c/%d", "o_custkey").alias("own_path"), F.format_string("o/%d", F.col("o_orderkey") % 97).alias("path"), (F.col("o_orderkey") % 97 < 40).alias("session"), (F.col("o_orderstatus") == "F").alias("is_link"), (F.col("o_orderkey") % 3 + 1).alias("n"))
    stub = read(spark, d, "customer").select(F.format_string("C%d", "c_custkey").alias("canonical"), (F.col("c_custkey") % 4 == 0).alias("stub"))
    return entities.coverage(m).join(stub, "canonical")


_COVERAGE_SQL = """m AS (SELECT 'C' || o_custkey AS canonical, o_orderkey % 97 AS path, o_orderkey % 97 < 40 AS session, o_orderstatus = 'F' AS is_link, o_orderkey % 3 + 1 AS n, o_custkey % 4 = 0 AS stub FROM orders
), c AS (SELECT canonical, stub, coalesce(CAST(sum(n) FILTER (is_link) AS BIGINT), 0) AS lm, coalesce(CAST(sum(n) FILTER (NOT is_link) AS BIGINT), 0) AS tm, count(DISTINCT path) FILTER (session) AS s, count(DISTINCT path) FILTER (session AND is_link) AS ls FROM m GROUP BY canonical, stub)"""


def _punch(which: str, sql: str):
    def run(spark, d):
        ignored = spark.createDataFrame([("c7",), ("c11",)], "name string")
        return entities.punch_list(_coverage(spark, d), which, ignored).select("rank", "canonical", "link_mentions", "text_mentions", "sessions")

    run.__name__ = f"punch_{which}"
    query(f"WITH {_COVERAGE_SQL} SELECT row_number() OVER (ORDER BY {sql}, canonical) AS rank, canonical, lm AS link_mentions, tm AS text_mentions, s AS sessions FROM c WHERE canonical NOT IN ('C7', 'C11') AND " + {
        "all": "lm + tm > 0", "links": "lm > 0", "stubs": "stub AND lm + tm > 0", "stub_links": "stub AND lm > 0", "sessions": "s > 0 ORDER BY rank LIMIT 500", "high_value": "NOT stub AND s > 0 ORDER BY rank LIMIT 200",
    }[which])(run)


for _which, _sql in (("all", "lm + tm DESC"), ("links", "lm DESC"), ("stubs", "lm + tm DESC"), ("stub_links", "lm DESC"), ("sessions", "s DESC, ls DESC, lm DESC, tm DESC"), ("high_value", "s DESC, ls DESC, lm DESC, tm DESC")):
    _punch(_which, _sql)


@query("SELECT 'C' || o_custkey AS canonical, string_agg(o_orderkey || ':' || CASE WHEN o_orderstatus = 'F' THEN 'link' ELSE 'text' END, ',' ORDER BY 'o/' || o_orderkey, o_orderkey) AS mentions FROM orders GROUP BY o_custkey")
def mention_lists(spark, d):
    m = read(spark, d, "orders").select(F.format_string("C%d", "o_custkey").alias("canonical"), F.format_string("o/%d", "o_orderkey").alias("path"), F.col("o_orderkey").alias("no"), (F.col("o_orderstatus") == "F").alias("is_link"), F.lit("x").alias("shown"))
    return entities.mention_index(m).select("canonical", F.array_join(F.transform("mentions", lambda x: F.concat_ws(":", x.no.cast("string"), x.type)), ",").alias("mentions"))


def _lines(spark, d) -> DataFrame:
    """Routes between nations as report lines, one a supplier; every seventh has an end that isn't linked."""
    k = F.col("s_suppkey")
    suffix = F.when(k % 3 == 0, F.format_string(" [via gate %d]", k % 11)).when(k % 3 == 1, F.format_string(" [method: stairs %d] [feature: x]", k % 5)).otherwise(" [feature: old door]")
    ends = F.when(k % 7 == 0, F.format_string("- [[N%d]] -> nowhere", "s_nationkey")).otherwise(F.format_string("- [[N%d]] -> [[N%d]]", "s_nationkey", k % 25))
    return read(spark, d, "supplier").select(F.format_string("N%d", "s_nationkey").alias("place"), k.alias("no"), F.concat(F.lit("  "), ends, suffix).alias("value"))


@query("""SELECT 'via' AS kind, count(DISTINCT s_suppkey % 11) AS phrases, count(DISTINCT s_suppkey % 11) FILTER (s_suppkey % 11 % 2 = 1) AS rejected FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0
UNION ALL SELECT 'method', count(DISTINCT s_suppkey % 5), count(DISTINCT s_suppkey % 5) FILTER (s_suppkey % 5 > 2) FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 7 <> 0""")
def route_phrases(spark, d):
    good = spark.createDataFrame([("via", f"gate {i}") for i in range(0, 12, 2)] + [("method", f"stairs {i}") for i in range(3)], "kind string, phrase string")
    return graph.sanity(reports.edges(_lines(spark, d)), good)


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN 'via gate ' || s_suppkey % 11 WHEN 1 THEN 'stairs ' || s_suppkey % 5 ELSE 'old door' END AS label, count(*) AS n FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 1")
def label_counts(spark, d):
    return graph.label_counts(reports.edges(_lines(spark, d)))


@query("SELECT 'N' || s_nationkey AS place, count(*) + 1 AS lines FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY s_nationkey")
def edge_report(spark, d):
    return reports.edge_report(_lines(spark, d)).groupBy("place").agg(F.count("*").alias("lines"))


@query("SELECT '# Routes' || chr(10) || chr(10) || '```mermaid' AS line, CAST(1 AS BIGINT) AS n UNION ALL SELECT '```', 1 UNION ALL SELECT '  N' || k, 1 FROM (SELECT DISTINCT s_nationkey AS k FROM supplier)")
def fenced_graph(spark, d):
    own = read(spark, d, "supplier").select(F.format_string("  N%d", "s_nationkey").alias("line")).distinct()
    return sinks.fenced(own, "Routes").groupBy("line").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT conv_id, turn, role FROM conversations), h AS (SELECT *, turn % 3 = 1 AS is_date, turn % 3 = 2 AS is_head FROM l), s AS (SELECT *, max(CASE WHEN is_date THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM h), b AS (SELECT DISTINCT conv_id, coalesce(before, turn) AS start FROM s WHERE is_head AND turn <= 11), p AS (SELECT l.conv_id, l.turn, (SELECT count(*) FROM b WHERE b.conv_id = l.conv_id AND b.start <= l.turn) AS part FROM l) SELECT conv_id, part, count(*) AS lines FROM p WHERE part > 0 GROUP BY ALL")
def recaps(spark, d):
    t = F.col("turn")
    value = F.when(t % 3 == 1, F.format_string("2024-01-%02d", t)).when(t % 3 == 2, F.when(t % 2 == 0, F.format_string("Log Session %db: x", t)).otherwise(F.format_string("Log Sessions %da and %d: y", t - 1, t))).otherwise("text")
    rows = read(spark, d, "conversations").select("conv_id", t.alias("no"), value.alias("value"))
    found = reports.split_recaps(rows, (r"^Log Sessions (\d+[a-z]?) and (\d+):\s*(.+)$", r"^Log Session (\d+)([a-z]?):\s*(.+)$"), up_to=11, by=("conv_id",))
    return found.select("conv_id", "part", F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("SELECT conv_id, turn AS no, 'w' || turn AS name FROM conversations WHERE turn % 2 = 0")
def audited_names(spark, d):
    t = F.col("turn")
    value = F.when(t % 2 == 0, F.format_string("did [[vault/npcs/x%d.md|w%d]] and [[items/y.md|z]]", t, t)).otherwise("nothing")
    c = read(spark, d, "conversations").select("conv_id", t.alias("no"), value.alias("value"))
    own = reports.completed(c.select((F.col("conv_id") * 1000 + F.col("no")).alias("no"), F.regexp_replace("value", r"\|w", F.concat(F.lit("|"), F.col("conv_id").cast("string"), F.lit("_w"))).alias("value")))
    return own.select(F.split("name", "_")[0].cast("long").alias("conv_id"), (F.col("at.no") % 1000).alias("no"), F.split("name", "_")[1].alias("name"))


@query("SELECT 'M' || p_partkey AS model FROM part WHERE p_partkey % 3 > 0")
def chat_models(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.format_string("text-EMBED-%d", "p_partkey")).otherwise(F.format_string("M%d", "p_partkey"))
    return reports.models(read(spark, d, "part").select(F.to_json(F.struct(F.array(F.struct(name.alias("id"))).alias("data"))).alias("value")))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 OR p_size % 5 = 0")
def screened_rows(spark, d):
    def client(prompt: str) -> str:
        size = int(prompt)
        if size % 5 == 0:
            raise OSError("no answer")
        return "yes, it is" if size % 2 == 0 else "no"

    rows = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("prompt"))
    return reports.screened(rows, client).select("p_partkey")


@query("SELECT count(*) AS candidates, count(*) FILTER (EXISTS (SELECT 1 FROM customer WHERE lower(c_name) = lower(name))) AS existing, count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer WHERE lower(c_name) = lower(name))) AS missing FROM (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'No ' || c_name ELSE upper(c_name) END AS name FROM customer)")
def resolution_counts(spark, d):
    c = read(spark, d, "customer")
    names = entities.name_table(c.select(F.lit("npcs").alias("kind"), F.col("c_name").alias("canonical"), F.col("c_name").alias("path"), F.array().cast("array<string>").alias("aliases")))
    return entities.resolution_counts(c.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("No "), "c_name")).otherwise(F.upper("c_name")).alias("candidate")), names)


@query("SELECT c_custkey, lower(c_name) AS canonical FROM customer")
def resolved_entities(spark, d):
    c = read(spark, d, "customer")
    names = entities.name_table(c.select(F.lit("npcs").alias("kind"), F.lower("c_name").alias("canonical"), F.col("c_name").alias("path"), F.array(F.concat(F.lit("The "), F.col("c_name"))).alias("aliases")))
    return entities.resolve(c.select("c_custkey", F.concat(F.lit("  [[THE   "), "c_name", F.lit("]]")).alias("candidate")), names).select("c_custkey", "canonical")


@query("SELECT p_name AS title, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS sessions FROM part GROUP BY p_name")
def appearances(spark, d):
    return entities.appearances(read(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("session"))).select("title", F.array_join("sessions", "|").alias("sessions"))


@query("SELECT p_type AS folder, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1 AND NOT (p_type = 'SMALL' AND bool_or(p_name LIKE 'red%'))")
def meant_duplicates(spark, d):
    rows = read(spark, d, "part").select(F.col("p_type").alias("folder"), F.col("p_name").alias("title"))
    return entities.duplicates(rows, (F.col("folder") == "SMALL") & F.col("title").startswith("red")).select("folder", "key", "n")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN true WHEN p_name LIKE '% %' AND p_partkey % 4 = 1 THEN true WHEN p_partkey % 4 = 2 THEN false WHEN p_partkey % 4 = 3 THEN true ELSE false END AS is_unique FROM part")
def unique_items(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    shown = F.when(k % 4 == 1, F.initcap(name)).when(k % 4 == 2, "gold coins").when(k % 4 == 3, F.concat(F.lit("ring of "), name)).otherwise(name)
    return read(spark, d, "part").select(k, curation.is_unique_item(shown, k % 4 == 0, ("gold coins",), (r"^ring of",)).alias("is_unique"))


@query("SELECT p_partkey, 'Bob ' || p_partkey AS name FROM part")
def significant_names(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.format_string("- Bob %d, a smith", k)).when(k % 3 == 1, F.format_string("- [[npcs/B.md|Bob %d]], old", k)).otherwise(F.format_string(" - Ann / Bob %d", k))
    return read(spark, d, "part").select(k, curation.significant_name(line).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Order of Thoth' WHEN 1 THEN 'friend of [[npcs/Thoth.md|Thoth]]' ELSE 'hall of Thoth, [[npcs/Thoth.md|T]]' END AS body, CASE p_partkey % 3 WHEN 0 THEN 'a [[factions/Dwarves|Dwarven]] smith' WHEN 1 THEN '[[x]] dwarven' ELSE 'none' END AS linked, CASE p_partkey % 3 WHEN 0 THEN 'Session 8b - The End' WHEN 1 THEN 'Session 12' ELSE 'Log 3' END AS title FROM part")
def demoted_links(spark, d):
    k = F.col("p_partkey")
    pick = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    body = pick("Order of [[npcs/Thoth.md|Thoth]]", "friend of [[npcs/Thoth.md|Thoth]]", "hall of [[npcs/Thoth.md|Th.]], [[npcs/Thoth.md|T]]")
    line = pick("a Dwarven smith", "[[x]] dwarven", "none")
    return read(spark, d, "part").select(k, curation.demote(body, "Thoth").alias("body"), curation.linkify_first(line, {"dwarven": "factions/Dwarves", "dwarf": "factions/Dwarves"}).alias("linked"), curation.session_title(pick("session 8B: The End ", "SESSION 12", "Log 3")).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Item' ELSE 'NPC' END AS kind FROM part WHERE p_partkey % 3 = 1 OR p_partkey % 3 = 0 AND p_size > 10")
def kinds_and_modes(spark, d):
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k, "p_size", F.when(k % 3 == 0, "Item").when(k % 3 == 1, "NPC").otherwise("Faction").alias("kind"))
    return curation.of_kinds(rows, ("Item", "NPC"), "unique", F.col("p_size") > 10).select("p_partkey", "kind")


@query("SELECT item_id, CAST(i - 1 AS INT) AS at FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), unnest(generate_series(1, len(w))) t(i) WHERE regexp_matches(w[i], '^th') AND regexp_matches(array_to_string(list_slice(w, greatest(i - 1, 1), i + 1), ' '), 'e')")
def hit_windows(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("parts"))
    return windows.hit_windows(rows, "parts", "^th", "e").select("item_id", "at")


# Pages and outputs


@query(f"WITH {NOTES_SQL}, t AS (SELECT unnest(tags) AS tag FROM note), p AS (SELECT tag FROM t UNION SELECT split_part(tag, '/', 1) FROM t UNION SELECT 'index') SELECT 'tags/' || tag AS slug, tag AS title FROM p UNION ALL SELECT DISTINCT folder || '/index', folder FROM note")
def listing_pages(spark, d):
    p = parsed(spark, d)
    return hierarchy.tag_pages(p).unionAll(hierarchy.folder_pages(p))


@query(f"WITH {NOTES_SQL} SELECT DISTINCT folder || '/index' AS slug, CASE folder WHEN 'nation' THEN 'All nations' ELSE folder END AS title FROM note")
def overridden_pages(spark, d):
    authored = spark.createDataFrame([("nation/index", "All nations"), ("other", "x")], "slug string, title string")
    return hierarchy.with_overrides(hierarchy.folder_pages(parsed(spark, d)), authored, "title")


@query(f"WITH {NOTES_SQL} SELECT slug, title, array_to_string(tags, '|') AS tags, len(links) AS n_links FROM note WHERE folder <> 'region'")
def content_index(spark, d):
    p = parsed(spark, d).withColumn("body", F.when(F.col("folder") != "region", F.col("body")))
    return sinks.content_index(p, empty=False).select("slug", "title", F.array_join("tags", "|").alias("tags"), F.size("links").cast("long").alias("n_links"))


@query(f"WITH {NOTES_SQL} SELECT '' AS folder, folder AS child, true AS is_folder, count(*) AS n, max(modified) AS modified FROM note GROUP BY folder UNION ALL SELECT folder, regexp_extract(slug, '[^/]*$'), false, 1, modified FROM note")
def dated_children(spark, d):
    return hierarchy.children(parsed(spark, d), ("modified",)).withColumn("modified", F.col("modified").cast("timestamp_ntz"))


@query("WITH s AS (SELECT DISTINCT lower(p_type) AS folder, replace(p_brand, '#', '') AS child FROM part WHERE p_type <> 'SMALL') SELECT folder, child, row_number() OVER (PARTITION BY folder ORDER BY CAST(replace(child, 'Brand', '') AS INT) DESC) AS position FROM s")
def explorer_hooks(spark, d):
    slug = paths.slugify_path(F.concat_ws("/", F.lower("p_type"), "p_brand", F.format_string("p%d.md", "p_partkey")))
    listing = hierarchy.children(read(spark, d, "part").select(slug.alias("slug"))).filter("is_folder and folder <> ''")
    out = hierarchy.explorer(listing, keep=F.col("folder") != "small", shown=F.regexp_replace("child", "^Brand", ""), order=[F.col("shown").cast("int").desc()])
    return out.select("folder", "child", "position")


@query("SELECT ['Äb' || p_partkey, 'ab00' || p_partkey, 'AB' || p_partkey || 'x', 'é' || p_partkey, 'F0' || p_partkey][p_partkey % 5 + 1] AS name, row_number() OVER (ORDER BY greatest(p_partkey % 5, 2), p_partkey) AS position FROM part")
def folded_order(spark, d):
    k = F.col("p_partkey")
    forms = [F.format_string(f, k) for f in ("Äb%d", "ab00%d", "AB%dx", "é%d", "F0%d")]
    names = read(spark, d, "part").select(F.lit("").alias("folder"), F.element_at(F.array(*forms), (k % 5 + 1).cast("int")).alias("child"), F.lit(False).alias("is_folder"), F.lit(1).alias("n"))
    return hierarchy.explorer(names).select(F.col("child").alias("name"), "position")


@query("SELECT slug, n FROM (SELECT lower(p_type) AS slug, count(*) AS n FROM part WHERE p_type = 'SMALL' GROUP BY 1)")
def found_folder(spark, d):
    slug = paths.slugify_path(F.concat_ws("/", F.lower("p_type"), "p_brand", F.format_string("p%d.md", "p_partkey")))
    below = hierarchy.find(hierarchy.children(read(spark, d, "part").select(slug.alias("slug"))), "small").filter("not is_folder")
    return below.groupBy(F.split("folder", "/")[0].alias("slug")).agg(F.count("*").alias("n"))


@query(f"WITH {NOTES_SQL} SELECT slug, folder = 'nation' AS visited FROM note")
def visited_pages(spark, d):
    from quire.plans.pipeline import visited

    p = parsed(spark, d).select("slug", "folder")
    return visited(p.select("slug"), p.filter("folder = 'nation'").select("slug").union(p.select(F.lit("gone"))))


@query(f"WITH {NOTES_SQL} SELECT slug, title FROM note WHERE folder = 'nation' ORDER BY modified DESC, lower(title), slug LIMIT 3")
def recent_notes(spark, d):
    return sinks.feed(parsed(spark, d), 3, F.col("folder") == "nation").select("slug", "title")


@query("""SELECT ['npcs', 'locations', 'factions', 'items'][p_partkey % 4 + 1] || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'A-' ELSE 'B -' END || p_partkey || '.md' AS path,
    '  - ' || ['npc', 'location', 'faction', 'item'][p_partkey % 4 + 1] AS tag, '- [[sessions/s1.md|s1]]|- [[sessions/s' || (2 + p_size % 5) || '.md|s' || (2 + p_size % 5) || ']]' AS seen FROM part WHERE p_partkey % 8 <> 0""")
def stub_pages(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.format_string("A/%d", k)).otherwise(F.format_string("B:%d", k))
    kind = F.element_at(F.array(*map(F.lit, ("NPC", "Location", "Faction", "Item"))), (k % 4 + 1).cast("int"))
    wanted = read(spark, d, "part").select(k, kind.alias("kind"), name.alias("name"), F.array(F.format_string("s%d.md", 2 + F.col("p_size") % 5), F.lit("s1.md"), F.lit("s1.md")).alias("seen"))
    there = wanted.filter("p_partkey % 8 = 0").select(F.concat(F.lit("npcs/"), text.stub_name(F.col("name")), F.lit(".md")).alias("path"))
    lines = F.split("content", "\n")
    return sinks.stubs(wanted, there).select("path", lines[3].alias("tag"), F.array_join(F.slice(lines, 13, 2), "|").alias("seen"))


@query("""SELECT p_partkey, ['t: not found', '[[t|t]]: no reply', '[[t|t]]; YES; NO; YES', '[[t|t]]; NO; YES; YES'][p_partkey % 4 + 1] AS line,
    ['repair [[t|t]]', 'review [[t|t]]', 'merge [[t|t]]; pull a' || p_partkey || ', b', 'check [[t|t]]'][p_partkey % 4 + 1] AS todo FROM part""")
def link_verdicts(spark, d):
    k = F.col("p_partkey")
    reply = F.when(k % 4 == 1, "broken {").when(k % 4 == 2, F.format_string('{"references_present": "yes", "should_exist": "No.", "data_match": "YES", "info_to_pull": ["a%d", "b"]}', k)).when(k % 4 == 3, '{"references_present": "no", "should_exist": "yes", "data_match": "yes"}')
    reply = F.when(k % 4 == 2, F.regexp_replace(reply, "No\\.", "no")).otherwise(reply)
    rows = read(spark, d, "part").select(F.format_string("%d", k).alias("subject"), F.lit("t").alias("target"), F.lit("t").alias("label"), (k % 4 != 0).alias("found"), reply.alias("reply"))
    return sinks.verdict_lines(rows).select(F.col("subject").cast("long").alias("p_partkey"), "line", "todo")


# Search and changes (Q1, Q7, T12, ST4, ST5, ST8)


@query("WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS token FROM benchmark) SELECT prefix, count(DISTINCT item_id) AS n FROM (SELECT item_id, token[:i] AS prefix FROM t, unnest(generate_series(1, length(token))) u(i)) GROUP BY prefix")
def prefix_index(spark, d):
    pages = read(spark, d, "benchmark").select("item_id", F.lit("").alias("title"), F.col("text").alias("content"), F.array().cast("array<string>").alias("tags"))
    return search.prefix_index(search.index(pages, "item_id"), "item_id").groupBy("prefix").agg(F.count_distinct("item_id").alias("n"))


@query("WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, CAST(2 AS BIGINT) AS field_rank FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'a'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'se'))) > 0 ORDER BY item_id LIMIT 8")
def prefix_query(spark, d):
    pages = read(spark, d, "benchmark").select("item_id", F.lit("title").alias("title"), F.col("text").alias("content"), F.array().cast("array<string>").alias("tags"))
    return search.query(search.prefix_index(search.index(pages, "item_id"), "item_id"), "a SE a", key="item_id")


@query("SELECT p_partkey, len(l) AS shown, list_aggregate(list_filter(l, lambda x: x LIKE '%a%'), 'string_agg', '|') AS marked FROM (SELECT p_partkey, list_transform(string_split(p_name || ' x1 x2 x3 a4 x5', ' '), lambda x: x)[:5] AS l FROM part)")
def marked_tags(spark, d):
    marked = search.tag_marks(F.split(F.concat("p_name", F.lit(" x1 x2 x3 a4 x5")), " "), "A")
    hit = F.filter(marked, lambda x: x.contains("match-tag"))
    names = F.transform(hit, lambda x: F.regexp_extract(x, "#([^<]*)<", 1))
    return read(spark, d, "part").select("p_partkey", F.size(marked).cast("long").alias("shown"), F.nullif(F.array_join(names, "|"), F.lit("")).alias("marked"))


@query(f"WITH {NOTES_SQL} SELECT 'pages' AS emitter, count(*) AS n FROM note WHERE folder = 'nation' UNION ALL SELECT 'map', count(*) FROM note")
def partial_outputs(spark, d):
    p = parsed(spark, d)
    out = changes.partial(p, p.filter("folder = 'nation'").select("slug"), {"pages": sinks.content_pages, "map": lambda x: sinks.sitemap(x, "example.org")}, whole=("map",))
    return out["pages"].agg(F.lit("pages").alias("emitter"), F.count("*").alias("n")).unionAll(out["map"].agg(F.lit("map").alias("emitter"), F.count("*").alias("n")))

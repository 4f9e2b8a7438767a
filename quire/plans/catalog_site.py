"""Queries over whole sites: folders that are watched, ignore files, nested embeds, stored indexes, generations, code in notes.

Files are written from the tables to the shared folder first, so the work follows the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import cooccurrence, entities, links, search
from quire.plans import pipeline
from quire.plans.cut import shared_folder
from quire.plans.fixtures import FLAT_SQL, NOTES_SQL, notes as note_files, parsed, read
from quire.sources import notes, reports, sinks, watch
from quire.streaming import expiring, site

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Ignore files of the tree (S1): the root leaves out logs and a folder "tmp" of any depth, but not tmp of one brand's
# own; a brand's file takes logs back, and "x" folders out.
@query(r"""WITH p AS (SELECT p_partkey, replace(p_brand, '#', '') AS b, ['/a' || p_partkey || '.log', '/tmp/' || p_partkey || '.md', '/x/y/' || p_partkey || '.md', '/d/q?' || p_partkey || '.md', '/d/e/keep.log', '/plain.md'][p_partkey % 6 + 1] AS rest, p_size FROM part)
SELECT p_partkey, b || rest AS path FROM p WHERE CASE p_partkey % 6 WHEN 0 THEN b = 'Brand1' WHEN 1 THEN false WHEN 2 THEN b <> 'Brand1' WHEN 3 THEN true WHEN 4 THEN true ELSE b <> 'Brand2' END""")
def nested_ignore_rules(spark, d):
    k = F.col("p_partkey")
    forms = F.array(F.format_string("/a%d.log", k), F.format_string("/tmp/%d.md", k), F.format_string("/x/y/%d.md", k), F.format_string("/d/q?%d.md", k), F.lit("/d/e/keep.log"), F.lit("/plain.md"))
    own = read(spark, d, "part").select(k, F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.element_at(forms, (k % 6 + 1).cast("int"))).alias("path"))
    files = [(".gitignore", "# logs\n*.log\n!keep.log\ntmp/\n/plain.md\nd/*.txt\n"), ("Brand1/.gitignore", "!*.log\nx/\n!tmp/keep.md\n"), ("Brand2/.gitignore", "/plain.md\n**/e/none.log\n")]
    return notes.kept_by_tree(own, spark.createDataFrame(files, "path string, raw string")).select("p_partkey", "path")


# Embeds in embeds (J15): each nation's page brings in its own section, which brings in a block and the next nation, and
# so on around five of them; the last one comes back to the first.
@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_name AS name FROM nation),
r AS (SELECT k AS root, 0 AS i, '' AS text FROM n UNION ALL
      SELECT r.root, i + 1, text || n.name || ' S' || n.k || ' block ' || n.k || ' Circular transclusion detected: n/' || n.k || ' / ' FROM r JOIN n ON n.k = r.root - r.root % 5 + (r.root + r.i) % 5 WHERE r.i < 5)
SELECT 'n/' || root AS slug, text || 'Circular transclusion detected: n/' || root || repeat(' end', i) AS text FROM r WHERE i = 5""")
def expanded_embeds(spark, d):
    n = read(spark, d, "nation")
    k = F.col("n_nationkey")
    page = n.select(F.format_string("n/%d", k).alias("slug"), F.concat("n_name", F.format_string(" ![[s/%d#My Part|as]] end", k)).alias("body"))
    section = n.select(F.format_string("s/%d", k), F.format_string("before\n\n# Top\n\n## My Part\n\nS%d ![[t/%d#^b]] / ![[n/%d]]\n\n## After\n\nnever", k, k, k - k % 5 + (k + 1) % 5))
    block = n.select(F.format_string("t/%d", k), F.format_string("no\n\nblock %d ![[n/%d]] ^b\n\nno", k, k))
    out = links.expanded(page.union(section).union(block)).filter(F.col("slug").startswith("n/"))
    return out.select("slug", F.regexp_replace("text", r"## My Part\n\n", "").alias("text"))


# Code in notes (M5): tags, links, marks and arrows count outside fences and inline code only.
@query("""SELECT p_partkey, 'out' || p_partkey || '|b' AS tags, 'real ' || p_name AS links, 'x <mark>m</mark> → `==c==` -' AS line FROM part""")
def code_in_notes(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.format_string("#out%d [[", k), F.lit("real "), "p_name", F.lit("]] `#in [[no]]` #b\n\n```md\n#fenced [[none]]\n```\n~~~\n[[nor this]]\n```\n~~~\ntext ``a ` #in2`` end\n\n    ```\n#last [[never]]"))
    own = notes.parse_notes(read(spark, d, "part").select(k, F.format_string("p%d.md", k).alias("path"), raw.alias("raw")))
    line = text.outside_code(F.lit("x ==m== -> `==c==` -"), lambda c: text.arrows(text.mark_highlights(c)))
    return own.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("p_partkey"), F.array_join("tags", "|").alias("tags"), F.array_join("links", "|").alias("links"), line.alias("line"))


# A stored index (Q1): the words of items, asked for by the beginnings of two.
@query("WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, CAST(2 AS BIGINT) AS field_rank FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'd'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'la'))) > 0 ORDER BY item_id LIMIT 8")
def stored_index_query(spark, d):
    pages = read(spark, d, "benchmark").select("item_id", F.lit("none").alias("title"), F.col("text").alias("content"), F.array().cast("array<string>").alias("tags"))
    where = shared_folder(spark, "index")
    search.store_index(search.index(pages, "item_id"), where, parts=8, key="item_id", postings=8)
    return search.query(search.stored_index(spark, where, "item_id"), "la d", key="item_id")


@query("WITH t AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS token, item_id FROM benchmark) SELECT token, count(*) AS n FROM t GROUP BY token")
def stored_postings(spark, d):
    pages = read(spark, d, "benchmark").select("item_id", F.lit("").alias("title"), F.col("text").alias("content"), F.array().cast("array<string>").alias("tags"))
    where = shared_folder(spark, "index")
    search.store_index(search.index(pages, "item_id"), where, parts=8, key="item_id", postings=8)
    return spark.read.parquet(where).groupBy("token").agg(F.sum(F.size("keys")).alias("n"))


# Generations of a site (K1, ST5, S2): notes are published, some change, some go; what a copy elsewhere has to do.
@query("""SELECT 'nation/' || n_name || '.html' AS path, CASE n_nationkey % 4 WHEN 0 THEN 'delete' ELSE 'change' END AS op, CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE sha256('new ' || n_name) END AS sha256 FROM nation WHERE n_nationkey % 4 IN (0, 1)
UNION ALL SELECT 'region/' || r_name || '.html', 'add', sha256(r_name) FROM region""")
def published_site(spark, d):
    n, root = read(spark, d, "nation"), shared_folder(spark, "site")
    page = lambda c: n.select(F.concat(F.lit("nation/"), "n_name").alias("slug"), F.lit(".html").alias("ext"), c.alias("content"))
    k = F.col("n_nationkey")
    first = sinks.publish(page(F.col("n_name")), root)
    more = read(spark, d, "region").select(F.concat(F.lit("region/"), "r_name"), F.lit(".html"), "r_name")
    new = n.filter(k % 4 != 0).select(F.concat(F.lit("nation/"), "n_name").alias("slug"), F.lit(".html").alias("ext"), F.when(k % 4 == 1, F.concat(F.lit("new "), "n_name")).otherwise(F.col("n_name")).alias("content"))
    sinks.publish(new.union(more), root)
    after = sinks.published(spark, root)
    return sinks.generation_changes(sinks.published(spark, root, first), after).join(after.select("path", "sha256"), "path", "left")


# Counts of the job that writes.
@query(f"WITH {NOTES_SQL} SELECT count(*) AS parsed, count(*) FILTER (draft) AS dropped, count(*) FILTER (NOT draft) AS files, CAST(1 AS BIGINT) AS generation FROM note")
def observed_build(spark, d):
    root = shared_folder(spark, "site")
    build = pipeline.Build(emitters={"pages": lambda p: p.select("slug", F.lit(".html").alias("ext"), F.col("body").alias("content"))})
    counts = build.run(note_files(spark, d), root)
    files = sinks.published(spark, root).agg(F.count("*").alias("files"))
    return files.select(F.lit(counts["parsed"]).cast("long").alias("parsed"), F.lit(counts["dropped"]).cast("long").alias("dropped"), "files", F.lit(counts["generation"]).cast("long").alias("generation"))


# An emitter that yields files as it goes.
@query("""WITH p AS (SELECT p_type AS folder, p_type || '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS slug, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) // 100 + 1 AS k FROM part)
SELECT folder || '/index-' || k AS slug, '.html' AS ext, string_agg(slug, chr(10) ORDER BY slug) AS content FROM p GROUP BY folder, k""")
def listing_files(spark, d):
    pages = read(spark, d, "part").select(F.col("p_type").alias("folder"), F.concat("p_type", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("slug"))
    return pipeline.listings(pages)


# A folder that is watched (ST1, K18): nations are written as notes; then some change, some go, regions come.
@query("""SELECT 'nation/' || n_name || '.md' AS path, 'add' AS op, CAST(1 AS BIGINT) AS seq, n_name AS content FROM nation
UNION ALL SELECT 'nation/' || n_name || '.md', CASE n_nationkey % 3 WHEN 0 THEN 'delete' ELSE 'change' END, 2, CASE n_nationkey % 3 WHEN 0 THEN NULL ELSE n_name || ' anew' END FROM nation WHERE n_nationkey % 3 < 2
UNION ALL SELECT 'region/' || r_name || '.md', 'add', 2, r_name FROM region""")
def watched_folder(spark, d):
    root = shared_folder(spark, "watched")
    n, r, k = read(spark, d, "nation"), read(spark, d, "region"), F.col("n_nationkey")
    page = lambda rows, kind, name, content: rows.select(F.concat(F.lit(f"{kind}/"), name).alias("slug"), F.lit(".md").alias("ext"), content.alias("content"))

    def step() -> None:
        stream = watch.watch(spark, f"{root}/notes", f"{root}/state", files=10)
        stream.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    sinks.write_files(page(n, "nation", "n_name", F.col("n_name")), f"{root}/notes").count()
    step()
    sinks.write_files(page(n.filter(k % 3 == 1), "nation", "n_name", F.concat("n_name", F.lit(" anew"))).unionAll(page(r, "region", "r_name", F.col("r_name"))), f"{root}/notes").count()
    sinks.remove_files(page(n.filter(k % 3 == 0), "nation", "n_name", F.lit("")), f"{root}/notes").count()
    step()
    return spark.read.schema(watch.SCHEMA).parquet(f"{root}/events")


# Files that are read back.
@query(f"WITH {NOTES_SQL} SELECT path, title, array_to_string(links, '|') AS links, true AS dated FROM note")
def notes_of_files(spark, d):
    root = shared_folder(spark, "notes")
    own = notes.dealt(note_files(spark, d))
    sinks.write_files(own.select(F.regexp_replace("path", r"\.md$", "").alias("slug"), F.lit(".md").alias("ext"), F.col("raw").alias("content")), root).count()
    found = notes.read_notes(spark, root).withColumnRenamed("modified", "file")
    return notes.parse_notes(found, keep=("file",)).select("path", "title", F.array_join("links", "|").alias("links"), F.col("file").isNotNull().alias("dated"))


@query("SELECT DISTINCT p_type AS list, lower(p_brand) AS word FROM part")
def word_lists_of_files(spark, d):
    root = shared_folder(spark, "lists")
    lists = read(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("words"))
    sinks.write_files(lists.select(F.replace("p_type", F.lit(" "), F.lit("_")).alias("slug"), F.lit(".json").alias("ext"), F.to_json(F.create_map("p_type", "words")).alias("content")), root).count()
    return reports.read_word_lists(spark, root)


@query("SELECT lower(c_name) AS name, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1")
def ignored_names_of_files(spark, d):
    root, k = shared_folder(spark, "ignored"), F.col("c_custkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("# "), "c_name")).when(k % 3 == 1, F.concat(F.lit("  "), "c_name")).otherwise(F.concat("c_name", F.lit(" ")))
    read(spark, d, "customer").select(line.alias("value")).write.text(root)
    return reports.read_ignore_list(spark, root).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'again' FROM orders WHERE o_orderkey % 2 = 0")
def logged_rows(spark, d):
    root, o = shared_folder(spark, "log"), read(spark, d, "orders")
    sinks.append_log(o.select("o_orderkey", "o_orderstatus"), root)
    sinks.append_log(o.filter(F.col("o_orderkey") % 2 == 0).select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("again").alias("o_orderstatus")), root)
    return reports.read_log(spark, root, "o_orderkey long, o_orderstatus string")


# Newest session first.
@query("SELECT p_type AS title, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand DESC) AS sessions FROM part GROUP BY p_type")
def appearances_newest_first(spark, d):
    own = entities.appearances(read(spark, d, "part").select(F.col("p_type").alias("title"), F.col("p_brand").alias("session")), newest_first=True)
    return own.select("title", F.array_join("sessions", "|").alias("sessions"))


# Words of the benchmark as names in whole texts of conversations, by automaton.
@query("WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS name FROM benchmark) SELECT name, count(*) AS n FROM n JOIN (SELECT text FROM conversations) c ON contains(c.text, n.name) GROUP BY name")
def names_in_texts(spark, d):
    names = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("name"))
    texts = read(spark, d, "conversations").select(F.monotonically_increasing_id().alias("id"), F.col("text").alias("body"))
    return cooccurrence.contained(names, texts).groupBy("name").agg(F.count("*").alias("n"))


# The text of each part (S10, W4): a conversation's turns as lines; every fourth one is a header, after its date.
@query("""WITH l AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN '2024-01-' || lpad(CAST(turn AS VARCHAR), 2, '0') WHEN 2 THEN 'Session ' || turn || ': ' || role ELSE replace(replace(text, chr(10), ' '), chr(13), ' ') END AS value FROM conversations),
h AS (SELECT conv_id, turn AS head, (SELECT max(turn) FROM l d WHERE d.conv_id = l.conv_id AND d.turn < l.turn AND d.turn % 4 = 1 AND NOT EXISTS (SELECT 1 FROM l e WHERE e.conv_id = l.conv_id AND e.turn % 4 = 2 AND e.turn > d.turn AND e.turn < l.turn)) AS dated FROM l WHERE turn % 4 = 2),
s AS (SELECT conv_id, coalesce(dated, head) AS start, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(dated, head)) AS part, lead(coalesce(dated, head)) OVER (PARTITION BY conv_id ORDER BY coalesce(dated, head)) AS stop FROM h)
SELECT conv_id, CAST(part AS INTEGER) AS part, string_agg(value, chr(10) ORDER BY turn) AS text FROM s JOIN l USING (conv_id) WHERE turn >= start AND (stop IS NULL OR turn < stop) GROUP BY conv_id, part""")
def recap_texts(spark, d):
    t = F.col("turn")
    value = F.when(t % 4 == 1, F.format_string("2024-01-%02d", t)).when(t % 4 == 2, F.concat(F.format_string("Session %d: ", t), "role")).otherwise(F.translate("text", "\n\r", "  "))
    rows = read(spark, d, "conversations").select("conv_id", t.alias("no"), value.alias("value"))
    return reports.split_recaps(rows, (r"^Session (\d+): (.*)$",), by=("conv_id",)).select("conv_id", "part", "text")


# Reports by their text.
@query("""WITH r AS (SELECT 'N' || s_nationkey AS place, s_suppkey, '- [[N' || s_nationkey || ']] -> [[N' || s_suppkey % 25 || ']]' || CASE s_suppkey % 3 WHEN 0 THEN ' [via gate]' ELSE '' END AS line FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT place, CAST(row_number() OVER (PARTITION BY place ORDER BY s_suppkey) AS INTEGER) AS position, line FROM r UNION ALL SELECT DISTINCT place, 0, '## ' || place FROM r""")
def edge_report_lines(spark, d):
    k = F.col("s_suppkey")
    ends = F.when(k % 7 == 0, F.format_string("- [[N%d]] -> nowhere", "s_nationkey")).otherwise(F.format_string("- [[N%d]] -> [[N%d]]", "s_nationkey", k % 25))
    rows = read(spark, d, "supplier").select(F.format_string("N%d", "s_nationkey").alias("place"), k.alias("no"), F.concat(F.lit("  "), ends, F.when(k % 3 == 0, " [via gate]").otherwise("")).alias("value"))
    return reports.edge_report(rows)


@query("SELECT string_agg(line, chr(10) ORDER BY o, line) AS note FROM (SELECT 0 AS o, '# Routes' || chr(10) || chr(10) || '```mermaid' AS line UNION ALL SELECT DISTINCT 1, '  N' || s_nationkey FROM supplier UNION ALL SELECT 2, '```')")
def fenced_note(spark, d):
    own = read(spark, d, "supplier").select(F.format_string("  N%d", "s_nationkey").alias("line")).distinct()
    return sinks.fenced(own, "Routes").coalesce(1).agg(F.array_join(F.collect_list("line"), "\n").alias("note"))


@query(f"WITH {FLAT_SQL} SELECT path, text FROM flat")
def content_page_texts(spark, d):
    return sinks.content_pages(parsed(spark, d)).select("path", text.unlink(F.col("body")).alias("text"))


# What upserts do elsewhere (K16): customers that have orders are known there.
@query("SELECT c_name AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'update' ELSE 'create' END AS op, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'r' || c_custkey || '/' || length(c_name) ELSE 'new ' || c_name END AS remote FROM customer")
def uploaded(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    plan = sinks.upserts(c, o, "c_custkey").withColumn("remote", F.when(F.col("op") == "update", F.format_string("r%d", "c_custkey")))
    return sinks.upload(plan.withColumn("name", F.col("c_name")).withColumn("content", F.col("c_name")), lambda op, remote, name, content: f"{remote}/{len(content)}" if op == "update" else f"new {name}")


# Notes as a stream with state that lets go of deleted ones (ST4): of each user's events the ones that are news.
@query("""WITH e AS (SELECT 'u/' || user_id || '.md' AS path, CASE event_type WHEN 'error' THEN 'delete' ELSE 'change' END AS op, event_id AS seq, event_type AS content FROM events)
SELECT path, arg_max(op, seq) AS op, max(seq) AS seq, CASE WHEN arg_max(op, seq) = 'delete' THEN NULL ELSE arg_max(content, seq) END AS content FROM e GROUP BY path""")
def note_states(spark, d):
    own, root = spark.newSession(), shared_folder(spark, "states")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", expiring.PROVIDER)
    gone = F.col("event_type") == "error"
    events = read(spark, d, "events").select(F.format_string("u/%d.md", "user_id").alias("path"), F.when(gone, "delete").otherwise("change").alias("op"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), F.col("ts").cast("timestamp").alias("at"))
    events.write.parquet(f"{root}/in")
    stream = own.readStream.schema(events.schema).parquet(f"{root}/in")
    expiring.latest(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(expiring.OUT).parquet(f"{root}/out")


# A site that follows its notes (ST1-ST7, K1): nations are notes that link their region; in a second batch some change,
# some go. The files that a reader sees at last.
@query("""SELECT 'nation/' || n_name || '.md' AS path, sha256(CASE n_nationkey % 3 WHEN 1 THEN n_name || ' anew' ELSE n_name || ' of old' END) AS sha256, 'pages' AS emitter FROM nation WHERE n_nationkey % 3 > 0
UNION ALL SELECT 'count.txt', sha256(CAST(count(*) AS VARCHAR)), 'count' FROM nation WHERE n_nationkey % 3 > 0""")
def followed_site(spark, d):
    root, k = shared_folder(spark, "followed"), F.col("n_nationkey")
    n = read(spark, d, "nation").select(F.concat(F.lit("nation/"), "n_name").alias("slug"), F.lit(".md").alias("ext"), k, "n_name")
    build = pipeline.Build(emitters={
        "pages": lambda p: p.select("slug", F.lit(".md").alias("ext"), F.col("body").alias("content")),
        "count": lambda p: p.agg(F.lit("count").alias("slug"), F.lit(".txt").alias("ext"), F.count("*").cast("string").alias("content")),
    })
    step = lambda: site.follow(spark, f"{root}/notes", f"{root}/site", build, f"{root}/state", ("count",), once=True).awaitTermination()
    sinks.write_files(n.withColumn("content", F.concat("n_name", F.lit(" of old"))), f"{root}/notes").count()
    step()
    sinks.write_files(n.filter(k % 3 == 1).withColumn("content", F.concat("n_name", F.lit(" anew"))), f"{root}/notes").count()
    sinks.remove_files(n.filter(k % 3 == 0), f"{root}/notes").count()
    step()
    return sinks.published(spark, f"{root}/site").select("path", "sha256", "emitter")


# Pieces of notes that no other query asks for (P2, P14, F17, F21, F25, F30, F38, ST8, A11, S19)


@query("SELECT p_partkey, 'p' || p_partkey AS slug FROM part WHERE p_size % 3 = 0 AND p_size % 2 = 1")
def explicitly_published(spark, d):
    size = F.col("p_size")
    raw = F.concat(F.lit("---\npublish: "), F.when(size % 3 == 0, "true").when(size % 3 == 1, "false").otherwise("maybe"), F.lit("\ndraft: "), F.when(size % 2 == 0, "true").otherwise("false"), F.lit("\n---\ntext"))
    build = pipeline.Build(filters=[pipeline.remove_drafts(), pipeline.explicit_publish()])
    out = build.published(build.parse(read(spark, d, "part").select(F.format_string("p%d.md", "p_partkey").alias("path"), raw.alias("raw"))))
    return out.select(F.substring("slug", 2, 20).cast("long").alias("p_partkey"), "slug")


@query("SELECT p_partkey, p_partkey % 4 IN (1, 2) AS unbalanced FROM part")
def unbalanced_lines(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, "a [[b]] [[c|d]]").when(k % 4 == 1, "a [[b]] [[c").when(k % 4 == 2, "[b]] x").otherwise("none")
    return read(spark, d, "part").select(k, text.unbalanced(line).alias("unbalanced"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS embed, p_name AS target, CASE p_partkey % 3 WHEN 0 THEN '' ELSE '#Part ' || p_partkey END AS heading, CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'as ' || p_partkey END AS alias,
    'x <mark>' || p_name || '</mark> =y= ==' AS marked FROM part""")
def links_and_marks(spark, d):
    k = F.col("p_partkey")
    link = F.concat(F.when(k % 2 == 0, "!").otherwise(""), F.lit("[["), "p_name", F.when(k % 3 == 0, "").otherwise(F.format_string("#Part %d", k)), F.when(k % 5 == 0, "").otherwise(F.format_string("|as %d", k)), F.lit("]]"))
    marked = text.mark_highlights(F.concat(F.lit("x =="), "p_name", F.lit("== =y= ==")))
    return read(spark, d, "part").select(k, F.explode(text.full_links(F.concat(F.lit("see "), link, F.lit(" so")))).alias("l"), marked.alias("marked")).select("p_partkey", "l.*", "marked")


@query("SELECT c_custkey, c_mktsegment[1] || lower(c_mktsegment[2:]) || ' Of Names|One Two Three Four Five|Six' AS names FROM customer")
def proper_nouns(spark, d):
    body = F.concat(F.lit("the "), F.initcap(F.lower("c_mktsegment")), F.lit(" Of Names, The and Al; One Two Three Four Five Six\n```\nNot Here\n```\nSix"))
    return read(spark, d, "customer").select("c_custkey", F.array_join(text.proper_names(body), "|").alias("names"))


@query("SELECT p_partkey, 'x [[a' || p_partkey || ' deep b|c]] y [[' || p_name || ']]' AS text FROM part")
def repaired_links(spark, d):
    from quire.functions.rewrite import repair_nested

    nested = F.concat(F.format_string("x [[a%d [[q|[[r|deep]]]] b|c]] y [[", "p_partkey"), "p_name", F.lit("]]"))
    return read(spark, d, "part").select("p_partkey", repair_nested(nested).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN ['NPC', 'Item'][p_partkey % 3 + 1] END AS kind, CASE WHEN p_partkey % 3 < 2 THEN p_name || '|' || p_brand END AS names FROM part")
def group_lines(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("- NPC: "), "p_name", F.lit(" ;; "), "p_brand", F.lit(";"))).when(k % 3 == 1, F.concat(F.lit("Item :"), "p_name", F.lit(";"), "p_brand")).otherwise(F.col("p_name"))
    own = read(spark, d, "part").select(k, text.group_line(line).alias("g"))
    return own.select("p_partkey", "g.kind", F.array_join("g.names", "|").alias("names"))


@query("""WITH f AS (SELECT o_orderpriority || '/' || o_orderstatus AS deep, o_orderpriority AS top, CAST(o_orderdate AS DATE) AS o, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS m, CAST(o_orderdate AS DATE) - CAST(o_custkey % 70 AS INTEGER) AS p FROM orders)
SELECT replace(folder, ' ', '-') AS folder, count(*) AS n, CAST(max(o) AS TIMESTAMP) AS created, CAST(max(m) AS TIMESTAMP) AS modified, CAST(max(p) AS TIMESTAMP) AS published FROM (SELECT deep AS folder, o, m, p FROM f UNION ALL SELECT top, o, m, p FROM f) GROUP BY folder""")
def folder_dates(spark, d):
    from quire.functions import paths
    from quire.operators import hierarchy

    o = read(spark, d, "orders")
    slug = paths.slugify_path(F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.format_string("%d.md", "o_orderkey")))
    day = F.col("o_orderdate").cast("date")
    moment = lambda c: c.cast("timestamp_ntz")
    own = o.select(slug.alias("slug"), moment(day).alias("created"), moment(F.date_add(day, (F.col("o_orderkey") % 90).cast("int"))).alias("modified"), moment(F.date_sub(day, (F.col("o_custkey") % 70).cast("int"))).alias("published"))
    return hierarchy.folder_rollup(own)


# Filters of routes as files (S19): two lists in one object, lower case; a file that can't be read gives nothing.
@query("SELECT 'via' AS list, 'gate ' || k AS word FROM range(0, 11, 2) t(k) UNION ALL SELECT DISTINCT 'type', lower(p_type) FROM part")
def reject_filters(spark, d):
    root = shared_folder(spark, "filters")
    types = read(spark, d, "part").agg(F.to_json(F.struct(F.expr("transform(sequence(0, 10, 2), x -> concat('Gate ', x))").alias("via"), F.sort_array(F.collect_set("p_type")).alias("type"))).alias("content"))
    sinks.write_files(types.select(F.lit("filters").alias("slug"), F.lit(".json").alias("ext"), "content").unionAll(types.select(F.lit("broken"), F.lit(".json"), F.substring("content", 1, 20))), root).count()
    return reports.read_word_lists(spark, root)


# The whole dialect of notes (M5), text to text.
@query("""SELECT p_partkey, 'a  [[' || p_name || '#my-part-' || p_partkey || '|My *Part* ' || p_partkey || ']] → <mark>x</mark>' || chr(10) || '> [!note] Title' || chr(10) || '> ' || chr(10) || '> more' || chr(10)
    || CASE p_partkey % 2 WHEN 0 THEN '![[P#^b1|^b1]]' ELSE '[[P|shown]] [[#top|top]]' END || chr(10) || '| [[a\\|b]] | `->` |' AS text FROM part""".replace("\\\\", "\\"))
def dialect_of_notes(spark, d):
    from quire.functions import curation

    k = F.col("p_partkey")
    body = F.concat(
        F.lit("a %%gone [[no]]%% [["), "p_name", F.format_string("#My *Part* %d", k), F.lit("]] -> ==x==\n> [!note] Title\n> more\n"),
        F.when(k % 2 == 0, "![[P#^b1]]").otherwise("[[P|shown]] [[#top]]"), F.lit("\n| [[a|b]] | `->` |"),
    )
    return read(spark, d, "part").select(k, curation.from_obsidian(body).alias("text"))

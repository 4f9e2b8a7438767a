"""What goes out: indexes, feeds, redirects, exports, and stubs that aren't there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths, text
from quire.plans.cut import numbered
from quire.plans.workers import reach


def content_index(notes: DataFrame, empty: bool = True) -> DataFrame:
    """(slug, title, links, tags, content), one row a slug: what searches and graphs read; empty: pages without text too."""
    rows = notes if empty else notes.filter(F.coalesce("body", F.lit("")) != "")
    return rows.select("slug", "title", F.transform("links", lambda x: paths.simplify_slug(paths.slugify_path(x))).alias("links"), "tags", F.col("body").alias("content"))


def sitemap(notes: DataFrame, base: str) -> DataFrame:
    """(slug, xml): one element for each page."""
    loc = F.concat(F.lit(f"https://{base}/"), F.replace(F.replace(F.url_encode(paths.simplify_slug(F.col("slug"))), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))
    return notes.select("slug", F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("</lastmod></url>")).alias("xml"))


def feed(notes: DataFrame, limit: int = 10, keep: Column | None = None) -> DataFrame:
    """The newest notes, of those to keep: by date downwards, the undated last, then by title; a limit is what a feed is."""
    notes = notes if keep is None else notes.filter(keep)
    item = F.concat(F.lit("<item><title>"), text.escape_html(F.col("title")), F.lit("</title><guid>"), F.col("slug"), F.lit("</guid></item>"))
    return notes.orderBy(F.col("modified").desc_nulls_last(), F.lower("title"), "slug").limit(limit).select("slug", "title", "modified", item.alias("xml"))


def redirects(notes: DataFrame) -> DataFrame:
    """(from_slug, to_slug) for each alias of each note."""
    alias = F.explode("aliases").alias("alias")
    return notes.select("slug", alias).select(paths.slugify_path(F.col("alias")).alias("from_slug"), F.col("slug").alias("to_slug")).filter("from_slug <> to_slug").distinct()


def content_pages(notes: DataFrame) -> DataFrame:
    """Pages of their own: no folder index, no tag page."""
    return notes.filter(~F.col("slug").endswith("/index") & ~F.col("slug").startswith("tags/"))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes a file for each row (slug, ext, content) below the URI root; (path, bytes) of what was written, once it is read.

    Folders are made, files replaced; a task that is repeated writes the same files again. Nulls are empty.
    """
    import pyarrow as pa
    from pyarrow import fs

    reach(rows.sparkSession)

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            names, sizes = [], []
            for slug, ext, content in zip(*(c.to_pylist() for c in batch.columns)):
                path, raw = f"{slug}{ext or ''}", (content or "").encode() if not isinstance(content, bytes) else content
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(raw)
                names.append(path)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return rows.select("slug", "ext", "content").mapInArrow(run, "path string, bytes long")


def remove_files(rows: DataFrame, root: str) -> DataFrame:
    """Removes the files of rows (slug, ext) below the URI root; (path) of what was there, once it is read."""
    import pyarrow as pa
    from pyarrow import fs

    reach(rows.sparkSession)

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            names = [f"{slug}{ext or ''}" for slug, ext in zip(*(c.to_pylist() for c in batch.columns))]
            there = [n for n in names if store.get_file_info(f"{base}/{n}").type == fs.FileType.File]
            for n in there:
                store.delete_file(f"{base}/{n}")
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], ["path"])

    return rows.select("slug", "ext").mapInArrow(run, "path string")


def publish(outputs: DataFrame, root: str, kept: DataFrame | None = None) -> int:
    """Publishes (slug, ext, content) as a new generation of the site at the URI root; its number.

    Outputs may say which ``emitter`` made them of which page (``source``, a slug). kept: rows of published() that are
    carried over as they are.

    A file is stored once by the hash of its content, below ``objects``; the manifest of a generation says which object
    stands for which path. Readers follow ``CURRENT``, one line that is replaced at the end. So whatever fails on the way,
    also in a task that is repeated, leaves the last generation whole; unchanged files are shared, and pages that are no
    longer made are not in the new manifest. Two outputs of one path are an error. One publisher at a time.
    """
    import hashlib
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    spark = outputs.sparkSession
    reach(spark)

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            rows = []
            for slug, ext, content, *made_by in zip(*(c.to_pylist() for c in batch.columns)):
                raw = content if isinstance(content, bytes) else (content or "").encode()
                sha = hashlib.sha256(raw).hexdigest()
                folder = f"{base}/objects/{sha[:2]}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                if store.get_file_info(f"{folder}/{sha}").type == fs.FileType.NotFound:
                    temporary = f"{folder}/{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(temporary, compression=None) as f:
                        f.write(raw)
                    store.move(temporary, f"{folder}/{sha}")
                rows.append((f"{slug}{ext or ''}", sha, len(raw), *made_by))
            columns, kinds = list(zip(*rows)) or [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "sha256", "bytes", "emitter", "source"])

    number = (current(spark, root) or 0) + 1
    folder = f"{root.rstrip('/')}/generations/{number}"
    made_by = [F.col(c) if c in outputs.columns else F.lit(None).cast("string").alias(c) for c in ("emitter", "source")]
    manifest = outputs.select("slug", "ext", "content", *made_by).mapInArrow(run, "path string, sha256 string, bytes long, emitter string, source string")
    manifest = manifest if kept is None else manifest.unionByName(kept.select(*manifest.columns))
    manifest.write.mode("overwrite").parquet(folder)
    twice = spark.read.parquet(folder).groupBy("path").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several outputs of one path: {', '.join(r.path for r in twice)}")
    store, base = fs.FileSystem.from_uri(root)
    with store.open_output_stream(f"{base}/CURRENT.tmp", compression=None) as f:
        f.write(str(number).encode())
    store.move(f"{base}/CURRENT.tmp", f"{base}/CURRENT")
    return number


def current(spark: SparkSession, root: str) -> int | None:
    """The number of the generation that readers see."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    if store.get_file_info(f"{base}/CURRENT").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{base}/CURRENT", compression=None) as f:
        return int(f.read())


def published(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    """(path, sha256, bytes, emitter, source, file): the files of a generation, by default the current one, and where their content is."""
    number = current(spark, root) if generation is None else generation
    rows = spark.read.parquet(f"{root.rstrip('/')}/generations/{number}")
    return rows.withColumn("file", F.concat(F.lit(f"{root.rstrip('/')}/objects/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256"))


def generation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op): what came, changed or went between two of published(); for a copy of the site elsewhere."""
    old, new = before.select("path", F.col("sha256").alias("x")), after.select("path", F.col("sha256").alias("y"))
    op = F.when(F.col("x").isNull(), "add").when(F.col("y").isNull(), "delete").otherwise("change")
    return old.join(new, "path", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("path", op.alias("op"))


def copy_files(files: DataFrame, root: str, keep: Column | None = None) -> DataFrame:
    """The same for assets: binaryFile rows (path, content), all but notes, their paths slugged."""
    rows = files.filter(~F.col("path").endswith(".md") if keep is None else keep)
    return write_files(rows.select(paths.slugify_path(F.col("path")).alias("slug"), F.lit("").alias("ext"), "content"), root)


def removed_files(events: DataFrame) -> DataFrame:
    """(path): assets that changes delete, as they are named in the output. events: coalesced (path, op)."""
    return events.filter((F.col("op") == "delete") & ~F.col("path").endswith(".md")).select(paths.slugify_path(F.col("path")).alias("path"))


def site_files(base_url: str, title: str, spark) -> DataFrame:
    """(slug, ext, content) of the files that stand beside the pages: the domain's name and the page for what isn't there."""
    page = f"<html><head><title>404 - {title}</title></head><body><h1>404</h1></body></html>"
    return spark.createDataFrame([("CNAME", "", base_url.split("/")[0]), ("404", ".html", page)], "slug string, ext string, content string")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def flattened(notes: DataFrame) -> DataFrame:
    """(folder, position, path, text): the notes of each folder by path, links reduced to what they show, numbered from 1.

    A folder's text is these in turn, a blank line between; no folder is ever in one cell or one task.
    """
    rows = numbered(notes.select("folder", "path", text.unlink(F.col("body")).alias("text")), "folder", "path", name="_at")
    first = rows.groupBy("folder").agg(F.min("_at").alias("_first"))
    return rows.join(first, "folder").select("folder", (F.col("_at") - F.col("_first") + 1).alias("position"), "path", "text")


def merge_smallest(exports: DataFrame, most: int = 10) -> DataFrame:
    """(output, part, folder, position, text): the two smallest folders as one output if there are more than ``most``.

    exports: (folder, position, text), as flattened() gives them. A folder's size is that of its text with blank lines.
    """
    sizes = exports.groupBy("folder").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("size"))
    small = sizes.orderBy("size", "folder").limit(2).agg(F.array_sort(F.collect_list(F.struct("size", "folder"))).alias("s"))  # two rows
    merged = small.join(sizes.agg(F.count("*").alias("n"))).filter(F.col("n") > most)
    names = F.transform("s", lambda x: x.folder)
    named = merged.select(F.array_join(names, "+").alias("output"), F.posexplode(names).alias("part", "_f"))
    out = exports.join(F.broadcast(named), exports["folder"] == F.col("_f"), "left")
    return out.select(F.coalesce("output", "folder").alias("output"), F.coalesce("part", F.lit(0)).alias("part"), "folder", "position", "text")


def write_exports(exports: DataFrame, path: str, parts: int = 200) -> None:
    """Writes merge_smallest() as text, a folder for each output, whose files in the order of their names are its text."""
    order = ["output", "part", "position"]
    exports.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("output", "text").write.partitionBy("output").option("lineSep", "\n\n").text(path)


def stubs(wanted: DataFrame, there: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(path, content): the pages of names that have none. wanted: (kind, name, seen), seen: the sessions it appears in.

    there: (path). kinds: kind to folder. Slashes in names become hyphens, what file systems refuse goes.
    """
    folders = kinds or {"NPC": "npcs", "Location": "locations", "Faction": "factions", "Item": "items"}
    table = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    one = F.create_map(*[F.lit(x) for k, f in folders.items() for x in (k, {"pcs": "pc"}.get(f, f[:-1]))])
    kind = F.col("kind")
    head = F.concat(F.lit('---\ntitle: "'), "name", F.lit('"\ntags:\n  - '), one[kind], F.lit("\naliases:\n---\n# "), "name", F.lit("\n\n## Summary\n- TODO: Short description.\n\n## Appears In\n"))
    seen = F.array_join(F.transform(F.array_sort(F.array_distinct("seen")), lambda s: F.concat(F.lit("- [[sessions/"), s, F.lit("|"), F.regexp_replace(s, r"\.md$", ""), F.lit("]]\n"))), "")
    rows = wanted.filter(table[kind].isNotNull()).select(F.concat(table[kind], F.lit("/"), text.stub_name(F.col("name")), F.lit(".md")).alias("path"), F.concat(head, seen).alias("content"))
    return missing(rows, there, "path")


def verdict_lines(verdicts: DataFrame) -> DataFrame:
    """(subject, target, line, todo): what a report says of each judged link, and what is to be done, null for nothing.

    verdicts: (subject, target, label, found, reply), reply a JSON text or null where there is none.
    """
    said = F.from_json("reply", "references_present string, should_exist string, data_match string, info_to_pull array<string>, reasons string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    link = F.concat(F.lit("[["), "target", F.lit("|"), "label", F.lit("]]"))
    no = lambda f: F.upper(F.coalesce(F.col(f"s.{f}"), F.lit(""))).startswith("NO")
    word = lambda f: F.upper(F.coalesce(F.col(f"s.{f}"), F.lit("")))
    rows = verdicts.withColumn("s", said)
    failed = F.col("reply").isNull() | F.col("s._bad").isNotNull()
    line = F.when(~F.col("found"), F.concat("label", F.lit(": not found"))).when(failed, F.concat(link, F.lit(": no reply"))).otherwise(F.concat_ws("; ", link, word("references_present"), word("should_exist"), word("data_match")))
    todo = F.when(~F.col("found"), F.concat(F.lit("repair "), link)).when(failed, F.concat(F.lit("review "), link))
    todo = todo.otherwise(F.nullif(F.concat_ws("; ", F.when(no("references_present"), F.concat(F.lit("check "), link)), F.when(no("should_exist"), F.concat(F.lit("merge "), link)), F.when(no("data_match"), F.concat(F.lit("reconcile "), link)), F.when(F.size(F.coalesce("s.info_to_pull", F.array().cast("array<string>"))) > 0, F.concat(F.lit("pull "), F.array_join(F.slice("s.info_to_pull", 1, 3), ", ")))), F.lit("")))
    return rows.select("subject", "target", line.alias("line"), todo.alias("todo"))


def with_todos(notes: DataFrame, todos: DataFrame) -> DataFrame:
    """notes (path, body) that have todos, with these under a heading at the end. todos: (path, todo)."""
    listed = todos.filter("todo is not null").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("todo")), lambda t: F.concat(F.lit("- "), t)), "\n").alias("_todos"))
    mark = F.when(F.col("body").contains("\n## TODO"), F.lit("\n")).otherwise("\n\n## TODOs\n")
    return notes.join(listed, "path").withColumn("body", F.concat("body", mark, "_todos", F.lit("\n"))).drop("_todos")


def fenced(lines: DataFrame, title: str, language: str = "mermaid") -> DataFrame:
    """(line): a listing (line), in the order it has, as a note with a title and a fenced block."""
    order = lambda at, values: lines.sparkSession.createDataFrame([(at, v) for v in values], "_o int, line string")
    head, tail = order(0, [f"# {title}\n\n```{language}"]), order(2, ["```"])
    own = numbered(lines.withColumn("_o", F.lit(1)), "_o", "line", name="_at").select("_o", "_at", "line")
    return head.select("_o", F.lit(0).alias("_at"), "line").unionAll(own).unionAll(tail.select("_o", F.lit(0).alias("_at"), "line")).orderBy("_o", "_at").select("line")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows to be created: insert if not there."""
    return wanted.join(there.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def upserts(new: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Adds ``op``: update for keys that are there, create for others; nothing is ever deleted."""
    known = there.select(F.col(key).alias("_k")).distinct()
    return new.join(known, new[key] == known["_k"], "left").withColumn("op", F.when(F.col("_k").isNull(), "create").otherwise("update")).drop("_k")


def upload(plan: DataFrame, client, at_once: int = 8) -> DataFrame:
    """Carries out upserts(): adds ``remote`` = client(op, remote, name, content), the id that the other side has for it.

    plan: (name, content, remote, op), remote null where there is none yet. The client is a function that runs on executors
    and may be called again for a row if a task is repeated, so a create has to find what it made before by its name.
    A task has at most ``at_once`` calls under way; an error ends the job, and nothing is ever deleted.
    """
    from concurrent.futures import ThreadPoolExecutor

    import pyarrow as pa

    reach(plan.sparkSession)

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                names, contents, remotes, ops = (c.to_pylist() for c in batch.columns)
                ids = list(pool.map(client, ops, remotes, names, contents))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(ids, pa.string())], ["name", "op", "remote"])

    return plan.select("name", "content", "remote", "op").mapInArrow(run, "name string, op string, remote string")


def rewritten(rows: DataFrame, column: str, new: Column) -> DataFrame:
    """Only the rows that a rewrite changes, with the new value."""
    return rows.withColumn("_new", new).filter(~F.col("_new").eqNullSafe(F.col(column))).withColumn(column, F.col("_new")).drop("_new")


def mermaid(edges: DataFrame) -> DataFrame:
    """(line): a graph's lines: nodes, then labelled edges, each sorted. edges: (a, b, label)."""
    ends = edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct()
    node = ends.select(F.lit(0).alias("o"), F.concat(F.lit("  "), text.node_name(F.col("n")), F.lit('["'), F.col("n"), F.lit('"]')).alias("line"))
    arrow = F.when(F.col("label") == "", " --> ").otherwise(F.concat(F.lit(" -- "), F.col("label"), F.lit(" --> ")))
    edge = edges.select(F.lit(1).alias("o"), F.concat(F.lit("  "), text.node_name(F.col("a")), arrow, text.node_name(F.col("b"))).alias("line"))
    return node.union(edge).orderBy("o", "line").select("line")

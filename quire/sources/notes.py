"""Notes: Markdown files with front matter, as a DataFrame (path, raw), and what their front matter says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Front matter fields and the names they go by, the first that is there winning.
SYNONYMS = {
    "tags": ("tags", "tag"),
    "aliases": ("aliases", "alias"),
    "cssclasses": ("cssclasses", "cssclass"),
    "image": ("socialImage", "image", "cover"),
    "created": ("created", "date"),
    "modified": ("modified", "lastmod", "updated", "last-modified", "created", "date"),
    "published": ("published", "publishDate", "date"),
}
_BLOCK = r"(?s)\A---[ \t]*\r?\n(?:(.*?)\r?\n)??---[ \t]*(?:\r?\n|\z)"
_TOML = r"(?s)\A\+\+\+[ \t]*\r?\n(?:(.*?)\r?\n)??\+\+\+[ \t]*(?:\r?\n|\z)"


def read_notes(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, raw, modified) of all .md files below root; ignore: globs of paths to leave out, * within a segment.

    Files of no bytes hold nothing that Spark reads, so they are no notes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    path = F.element_at(F.split(F.col("path"), F.lit(r"\Q" + base + r"\E")), -1)
    out = files.select(path.alias("path"), F.col("content").cast("string").alias("raw"), F.col("modificationTime").alias("modified"))
    for p in map(pattern, ignore):
        out = out.filter(~F.col("path").rlike(f"(^|/){p}(/|$)"))
    return out


def pattern(glob: str) -> str:
    return glob.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")


def not_ignored(path: Column, rules: list[str]) -> Column:
    """Whether the lines of a .gitignore leave a path in: comments and blank lines say nothing, a slash before the end
    anchors a rule at the root, one at the end means folders, ! takes back what earlier rules leave out."""
    out = F.lit(True)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            back, rule = rule.startswith("!"), rule.lstrip("!")
            anchored, only_folders = "/" in rule.rstrip("/"), rule.endswith("/")
            found = path.rlike(("^" if anchored else "(^|/)") + pattern(rule.strip("/")) + ("/" if only_folders else "(/|$)"))
            out = F.when(found, F.lit(back)).otherwise(out)
    return out


def ignore_lines(files: DataFrame) -> DataFrame:
    """(folder, rules): the lines of ignore files (path, raw) as an array of (back, only_folders, pattern), in order.

    Patterns are regular expressions over paths as seen from the file's folder. Comments and blank lines say nothing; !
    takes back; a slash at the end means folders, one before it anchors the rule at the folder; ** crosses folders, * and ?
    stay within one; a backslash takes a character as it is.
    """
    lines = F.transform(F.split("raw", r"\r?\n"), lambda x: F.regexp_replace(x, r"(?<!\\)[ \t]+$", ""))
    own = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))

    def rule(x: Column) -> Column:
        back, plain = x.startswith("!"), F.regexp_replace(x, "^!", "")
        only, bare = plain.endswith("/"), F.regexp_replace(plain, "/$", "")
        p = F.regexp_replace(F.regexp_replace(bare, "^/", ""), r"\\(.)", "\x05$1")
        for pattern, mark in ((r"(^|/)\*\*/", "$1\x01"), (r"/\*\*$", "/\x02"), (r"(?<!\x05)\*+", "\x03"), (r"(?<!\x05)\?", "\x04"), (r"([.+^$(){}|])", r"\\$1"), (r"(?<!\x05)\[!", "[^")):
            p = F.regexp_replace(p, pattern, mark)
        for mark, pattern in (("\x05([^A-Za-z0-9])", r"\\$1"), ("\x05", ""), ("\x01", "(?:[^/]+/)*"), ("\x02", ".+"), ("\x03", "[^/]*"), ("\x04", "[^/]")):
            p = F.regexp_replace(p, mark, pattern)
        return F.struct(back.alias("back"), only.alias("only_folders"), F.concat(F.when(bare.contains("/"), "^").otherwise("^(?:.*/)?"), p, F.lit("$")).alias("pattern"))

    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    return files.select(folder.alias("folder"), F.transform(own, rule).alias("rules"))


def kept_by_tree(paths: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of paths (path, ...) that the ignore files (path, raw) of the tree leave in.

    Of all rules in the folders above a file or folder the last that fits holds, the nearest folder's coming last; what
    lies in a folder that is left out is left out, whatever is said further down. Every folder is judged once; it meets
    the rules by the folders above it, an equality.
    """
    rules = ignore_lines(files).groupBy("folder").agg(F.max("rules").alias("rules"))  # one file a folder
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda i: F.array_join(F.slice(F.split(p, "/"), F.lit(1), i), "/"))
    own = paths.select("path").distinct()
    entries = own.select("path", F.explode(above(F.col("path"))).alias("entry"))
    each = entries.select("entry", (F.col("entry") != F.col("path")).alias("is_folder")).distinct()
    seen = each.withColumn("folder", F.explode(F.concat(F.array(F.lit("")), F.slice(above(F.col("entry")), F.lit(1), F.size(F.split("entry", "/")) - 1))))
    met = seen.join(rules, "folder").withColumn("rest", F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substring("entry", F.length("folder") + 2, F.length("entry"))))
    fits = F.filter("rules", lambda r: F.rlike(F.col("rest"), r.pattern) & (F.col("is_folder") | ~r.only_folders))
    last = met.withColumn("fits", fits).filter(F.size("fits") > 0).groupBy("entry", "is_folder").agg(F.max_by(F.element_at("fits", -1), F.length("folder")).alias("last"))
    gone = last.filter("NOT last.back").select("entry", "is_folder")
    out = entries.withColumn("is_folder", F.col("entry") != F.col("path")).join(gone, ["entry", "is_folder"], "left_semi").select("path").distinct()
    return paths.join(out, "path", "left_anti")


def read_ignore_files(spark: SparkSession, root: str, name: str = ".gitignore") -> DataFrame:
    """(path, raw) of the ignore files below root, which Spark's readers hide; the driver lists the tree and reads them."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    found = [f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.base_name == name and f.type == fs.FileType.File]
    rows = []
    for path in found:
        with store.open_input_stream(path, compression=None) as f:
            rows.append((path[len(base) :].lstrip("/"), f.read().decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "path string, raw string")


def front_matter(raw: Column) -> Column:
    """The block between the lines of three hyphens at the top, or of three plus signs; empty where there is none.

    The latter is another notation, name = value; its lines are turned into those of the first.
    """
    toml = F.regexp_replace(F.regexp_extract(raw, _TOML, 1), r"(?m)^([A-Za-z0-9_\-]+)[ \t]*=[ \t]*", "$1: ")
    return F.when(raw.startswith("+++"), toml).otherwise(F.regexp_extract(raw, _BLOCK, 1))


def body(raw: Column) -> Column:
    from quire.functions import text

    return text.strip(F.when(raw.startswith("+++"), F.regexp_replace(raw, _TOML, "")).otherwise(F.regexp_replace(raw, _BLOCK, "")))


def listed_fields(raw: Column, most_lines: int = 400) -> Column:
    """(title, aliases) as the line-based reader has them, over the lines of the block, which has to end early.

    Every ``aliases:`` line opens a list; items add to it, blank lines and comments leave it open, others close it. The
    bound on lines is part of the format: a block that ends later is none.
    """
    lines = F.transform(F.split(raw, r"\r?\n"), lambda x: F.rtrim(x))
    marks = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "---", i)), lambda i: i.isNotNull() & (i < most_lines))
    own = F.when((F.size(marks) > 1) & (marks[0] == 0), F.slice(lines, F.lit(2), F.greatest(marks[1] - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    bare = lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', "")
    item = r"^\s*-[ \t]+(.+)$"

    def step(acc, x):
        name, inside = bare(F.regexp_extract(x, r"^title:(.*)$", 1)), acc.inside & x.rlike(item)
        return F.struct(
            F.when(x.startswith("title:") & (name != ""), name).otherwise(acc.title).alias("title"),
            F.when(inside, F.concat(acc.aliases, F.array(bare(F.regexp_extract(x, item, 1))))).otherwise(acc.aliases).alias("aliases"),
            F.when(x.rlike(r"^aliases:\s*$"), True).when(x.startswith("title:"), False).otherwise(acc.inside & (inside | (F.trim(x) == "") | F.ltrim(x).startswith("#"))).alias("inside"),
        )

    start = F.struct(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("inside"))
    return F.aggregate(own, start, step, lambda acc: F.struct(acc.title.alias("title"), acc.aliases.alias("aliases")))


def indented_list(block: Column, name: str) -> Column:
    """The items of a field whose lines begin with two blanks and a hyphen; others end it. Empty where there are none."""
    items = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\r?\n((?:  -[^\r\n]*(?:\r?\n|\z))+)", 1)
    lines = F.filter(F.split(items, r"\r?\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.regexp_replace(F.trim(F.substring(x, F.lit(4), F.length(x))), r"""^(["'])(.*)\1$""", "$2"))


def place_names(notes: DataFrame) -> DataFrame:
    """(name, canonical): each page by its file's name and by its aliases, lower case; an alias wins over a file's name.

    notes: (path, aliases). Of several pages that share a name in one way the last path wins.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    every = notes.select("path", stem.alias("canonical"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), stem.alias("name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(1).alias("rank"), a.alias("name"))))).alias("n"))
    return every.groupBy(F.lower("n.name").alias("name")).agg(F.max_by("canonical", F.struct("n.rank", "path")).alias("canonical"))


def git_dates(commits: DataFrame) -> DataFrame:
    """(path, modified): the newest commit of each file. commits: (value), each a date line and the lines of its files.

    That is ``git log --format=%x00%cI --name-only``, read as text with the zero character between records.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = commits.select(F.try_to_timestamp(lines[0]).alias("modified"), F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("path"))
    return rows.groupBy("path").agg(F.max("modified").alias("modified"))


def scalar(block: Column, name: str) -> Column:
    """A field of one line, unquoted; null where it isn't there or is empty."""
    found = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*([^\r\n]*)$", 1)
    return F.nullif(F.regexp_replace(F.trim(found), r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def listed(block: Column, name: str) -> Column:
    """A field as a list: [a, b], lines that begin with a hyphen, or a text with commas; null where it isn't there.

    Lenient, as front matter is often no valid YAML: items are taken as they stand, less quotes.
    """
    line = scalar(block, name)
    items = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[ \t]*[^\r\n]*(?:\r?\n|\z))+)", 1)
    dashed = F.transform(F.split(F.regexp_replace(items, r"\s+\z", ""), r"\r?\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]*", ""))
    inline = F.split(F.regexp_replace(line, r"^\[(.*)\]$", "$1"), ",")
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")), lambda x: x != "")
    return F.when(line.isNotNull(), clean(inline)).when(items != "", clean(dashed))


def title(block: Column, text: Column, path: Column) -> Column:
    """The field, else the first heading of the first level, else the file's name."""
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# +(.+)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    return F.coalesce(scalar(block, "title"), heading, stem)


def date_of(block: Column, field: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(scalar(block, n)) for n in SYNONYMS[field]])


def dated(notes: DataFrame, git: DataFrame | None = None) -> DataFrame:
    """notes (path, front, file, ...) with ``modified``: what the note states, else its last commit, else its file's date."""
    from quire.functions.curation import best_date

    if git is None:
        return notes.withColumn("modified", best_date(F.col("front"), F.lit(None).cast("timestamp"), F.col("file")))
    own = git.select(F.col("path").alias("_p"), F.col("modified").alias("_m"))
    return notes.join(own, notes["path"] == own["_p"], "left").withColumn("modified", best_date(F.col("front"), F.col("_m"), F.col("file"))).drop("_p", "_m")


def dealt(notes: DataFrame) -> DataFrame:
    """notes (path, ...) over as many tasks as shuffles or the cluster have: one small file may hold very many of them, and
    parsing costs far more than moving. The number is stated, as one that follows bytes would bring them together again."""
    spark = notes.sparkSession
    return notes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "path")


def parse_notes(notes: DataFrame, as_of: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, folder, slug, title, body, tags, aliases, permalink, draft, publish, created, modified, published, links).

    A permalink is an alias too. Tags and links in code are none. keep: further columns of notes that go along.

    Dates that are missing or unreadable fall back on one another and then on as_of, which is never the clock.
    """
    from quire.functions import paths, text

    raw = text.strip(F.col("raw"))
    out = dealt(notes).select("*", front_matter(raw).alias("_block"), body(raw).alias("body"))
    block = F.col("_block")
    first = lambda field: F.coalesce(*[listed(block, n) for n in SYNONYMS[field]], F.array().cast("array<string>"))
    tags = F.array_distinct(F.concat(F.transform(first("tags"), paths.slug_tag), F.transform(text.inline_tags(text.without_code(F.col("body"))), paths.slug_tag)))
    default = as_of if as_of is not None else F.lit(None).cast("timestamp")
    return out.select(
        "path",
        F.when(F.col("path").contains("/"), F.element_at(F.split("path", "/"), 1)).otherwise("").alias("folder"),
        paths.slugify_path(F.col("path")).alias("slug"),
        title(block, F.col("body"), F.col("path")).alias("title"),
        "body",
        tags.alias("tags"),
        F.array_compact(F.array_append(first("aliases"), scalar(block, "permalink"))).alias("aliases"),
        scalar(block, "permalink").alias("permalink"),
        F.coalesce(scalar(block, "draft") == "true", F.lit(False)).alias("draft"),
        F.coalesce(scalar(block, "publish") == "true", F.lit(False)).alias("publish"),
        F.coalesce(date_of(block, "created"), default).alias("created"),
        F.coalesce(date_of(block, "modified"), default).alias("modified"),
        F.coalesce(date_of(block, "published"), default).alias("published"),
        F.array_distinct(text.link_targets(text.without_code(F.col("body")))).alias("links"),
        *keep,
    )

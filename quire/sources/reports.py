"""Line-based inputs: route reports, recaps, word lists, logs of benchmarks, filter files."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.plans.cut import carried, cut, numbered

# Fixed value: the line format of routes.
EDGE = r"^- \[\[([^\]]+)\]\] -> \[\[([^\]]+)\]\](.*)$"


def edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """(a, b, suffix, label) of the lines that state a route; others are ignored."""
    line = F.trim(F.col(column))
    return lines.filter(line.rlike(EDGE)).select(
        *[c for c in lines.columns if c != column], F.regexp_extract(line, EDGE, 1).alias("a"), F.regexp_extract(line, EDGE, 2).alias("b"), F.regexp_extract(line, EDGE, 3).alias("suffix"), text.edge_label(F.regexp_extract(line, EDGE, 3)).alias("label")
    )


def read_ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): one a line, lower case; blank lines and those that begin with # are skipped."""
    name = F.lower(F.trim("value"))
    return spark.read.text(path).select(name.alias("name")).filter((F.col("name") != "") & ~F.col("name").startswith("#"))


def read_word_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list, word), lower case, of a JSON object of arrays; an unreadable file gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode_outer("m").alias("list", "words")).select("list", F.explode("words").alias("word")).select("list", F.lower("word").alias("word"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def recap_lines(lines: DataFrame, headers: tuple[str, ...], date: str = r"^\d{4}-\d{2}-\d{2}\r?$", up_to: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, part, no, value, date, header, numbers): numbered lines (by, no, value) with the part of their file they belong to.

    headers: patterns, the first that matches a line holds; the digits at the beginning of their groups but the last are
    the numbers of the part. up_to: parts of whose numbers all are at most that begin; the text of others stays with the
    part before them. A header's date line is the last one before it that no other header follows; without one it begins
    itself. Lines before the first part are left out. Files are told apart by ``by``; a file may be of any length, as
    what is open is carried over the tasks that share it (``cut.carried``).
    """
    kinds = [F.when(F.col("value").rlike(p), F.array(*[F.regexp_extract(F.regexp_extract("value", p, g), r"^(\d+)", 1).try_cast("int") for g in range(1, re.compile(p).groups)])) for p in headers]
    marks = lines.select(*by, "no", "value", F.coalesce(*[F.array_compact(k) for k in kinds]).alias("numbers"), F.col("value").rlike(date).alias("dated")).filter(F.col("numbers").isNotNull() | F.col("dated"))
    # What a header asks for stands between the dates up to its line and itself, which closes them for the next one.
    none = F.lit(None).cast("long")
    no = F.col("no").cast("long")
    events = F.filter(
        F.array(
            F.when(F.col("dated"), F.struct(F.lit(0).alias("o"), no.alias("v"))),
            F.when(F.col("numbers").isNotNull(), F.struct(F.lit(1).alias("o"), none.alias("v"))),
            F.when(F.col("numbers").isNotNull(), F.struct(F.lit(2).alias("o"), F.lit(-(2**62)).alias("v"))),
        ),
        lambda x: x.isNotNull(),
    )
    asked = carried(marks.withColumn("e", F.explode(events)), by, ("no", "e.o"), opened=F.col("e.v")).filter("e.o = 1")
    if up_to is not None:
        asked = asked.filter(F.forall("numbers", lambda n: n <= up_to))
    start = F.when(F.col("opened") > -(2**62), F.col("opened")).otherwise(no)
    parts = asked.groupBy(*by, start.alias("_start")).agg(F.min_by(F.struct("value", "numbers"), "no").alias("_h"))
    placed = numbered(parts, *by, "_start", name="_at")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))
    first = placed.groupBy(*by).agg(F.min("_at").alias("_first"))
    parts = cut(placed.alias("p").join(first.alias("f"), same("p", "f")).select("p.*", (F.col("_at") - F.col("_first") + 1).alias("part")))
    begins = lines.alias("l").join(parts.alias("s").select(*by, "_start"), same("l", "s") & (F.col("l.no") == F.col("s._start")), "left").select("l.*", "_start")
    held = carried(begins.withColumnRenamed("_start", "_begins"), by, ("no",), _start=F.col("_begins")).filter(F.col("_start").isNotNull())
    out = held.alias("l").join(parts.alias("s"), same("l", "s") & (F.col("l._start") == F.col("s._start")))
    return out.select(*[f"l.{c}" for c in by], F.col("part").cast("int").alias("part"), "l.no", "l.value", F.when(F.col("l.value").rlike(date), F.col("l.value")).alias("date"), F.col("_h.value").alias("header"), F.col("_h.numbers").alias("numbers"))


def split_recaps(lines: DataFrame, headers: tuple[str, ...], date: str = r"^\d{4}-\d{2}-\d{2}\r?$", up_to: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, part, date, header, numbers, text): the parts of recap_lines(), each as one text; a part is what is written as a file."""
    rows = recap_lines(lines, headers, date, up_to, by)
    return rows.groupBy(*by, "part").agg(
        F.min_by("date", F.when(F.col("date").isNotNull(), F.col("no"))).alias("date"), F.first("header").alias("header"), F.first("numbers").alias("numbers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "value"))), lambda x: x.value), "\n").alias("text"),
    )


def models(listing: DataFrame) -> DataFrame:
    """(model): those of a service's JSON listing (value) that can chat, as their names say; an unreadable one gives none."""
    ids = F.from_json("value", "data array<struct<id string>>").getField("data")
    return listing.select(F.explode(F.transform(ids, lambda m: m.id)).alias("model")).filter(~F.lower("model").contains("embed"))


def completed(log: DataFrame, folder: str = "npcs") -> DataFrame:
    """(name, at): the pages of a folder that an audit log's links name, once each, in order. log: (no, value)."""
    names = F.regexp_extract_all("value", F.lit(rf"\[\[(?:vault/)?{folder}/[^\]|]+\|([^\]]+)\]\]"), F.lit(1))
    return log.select("no", F.posexplode(names).alias("i", "name")).groupBy("name").agg(F.min(F.struct("no", "i")).alias("at"))


def bibliography(files: DataFrame) -> DataFrame:
    """(key, type, field, value) of BibTeX texts (value); values lose their braces or quotes, entries without fields are left out."""
    entry = r"(?s)@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\s*\}"
    part = lambda k: F.regexp_extract_all("value", F.lit(entry), F.lit(k))
    rows = files.select(F.explode(F.arrays_zip(part(1).alias("t"), part(2).alias("k"), part(3).alias("f"))).alias("e"))
    field = r"(?s)(\w+)\s*=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|\"[^\"]*\"|\w+)"
    own = lambda k: F.regexp_extract_all("e.f", F.lit(field), F.lit(k))
    each = rows.select(F.col("e.k").alias("key"), F.lower("e.t").alias("type"), F.explode(F.arrays_zip(own(1).alias("n"), own(2).alias("v"))).alias("x"))
    return each.select("key", "type", F.lower("x.n").alias("field"), F.regexp_replace("x.v", r'^[{"]|[}"]$', "").alias("value"))


def edge_report(routes: DataFrame) -> DataFrame:
    """(place, position, line): the lines that state a route with both ends linked, by the place they were found for.

    routes: (place, no, value); others are left out. The first position of a place is its heading.
    """
    line = F.trim("value")
    rows = routes.filter(line.rlike(EDGE)).select("place", line.alias("line"), F.row_number().over(Window.partitionBy("place").orderBy("no")).alias("position"))
    return rows.select("place", "position", "line").unionAll(rows.select("place").distinct().select("place", F.lit(0).alias("position"), F.concat(F.lit("## "), F.col("place")).alias("line")))


def section_lines(lines: DataFrame, by: list[str], order: str, header: str, column: str = "value") -> DataFrame:
    """Adds ``section``: the last header line at or before each line, within the columns ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(F.col(column).rlike(header), F.regexp_extract(column, header, 1)), ignorenulls=True).over(w))


def chat(rows: DataFrame, client, prompt: str = "prompt", on_error: str = "null", at_once: int = 8) -> DataFrame:
    """Adds ``reply`` = client(prompt), a function that runs on executors; on_error: null, accept (YES) or raise.

    A task has at most ``at_once`` requests under way.
    """
    import pandas as pd

    def one(p):
        try:
            return client(p)
        except Exception:
            if on_error == "raise":
                raise
            return "YES" if on_error == "accept" else None

    def run(frames):
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                frame["reply"] = pd.Series(list(pool.map(one, frame[prompt])), dtype=object, index=frame.index)
                yield frame

    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", reply string")


def screened(rows: DataFrame, client, prompt: str = "prompt", on_error: str = "accept") -> DataFrame:
    """The rows to whose prompt the reply begins with Y, or says YES anywhere where an error accepts."""
    said = F.upper(F.trim("reply"))
    yes = said.contains("YES") if on_error == "accept" else said.startswith("Y")
    return chat(rows, client, prompt, on_error).filter(yes).drop("reply")

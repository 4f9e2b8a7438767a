"""python -m quire build --directory NOTES --output SITE: reads notes, leaves out drafts, writes pages, index, feed and the rest.

python -m quire watch --directory NOTES --output SITE --state STATE: the same as generations of a site that follows its
notes, removals included, until it is stopped (--once: until it has caught up).
"""

from __future__ import annotations

import argparse


def arguments() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="quire")
    commands = ap.add_subparsers(dest="command", required=True)
    build, watch = commands.add_parser("build"), commands.add_parser("watch")
    for command in (build, watch):
        command.add_argument("-d", "--directory", required=True, help="URI of the folder of notes")
        command.add_argument("-o", "--output", required=command is watch, help="URI of the folder to write to")
        command.add_argument("--base", default="example.org")
        command.add_argument("--ignore", action="append", default=[], help="a glob of paths to leave out")
        command.add_argument("--concurrency", help="a Spark master, by default that of the environment")
        command.add_argument("-v", "--verbose", action="store_true")
    build.add_argument("--dry-run", action="store_true", help="count what would be published and write nothing")
    watch.add_argument("--state", required=True, help="URI of a folder for listings, notes and checkpoint")
    watch.add_argument("--once", action="store_true", help="end when the site has caught up")
    return ap


#: Emitters that depend on all notes.
WHOLE = ("feed", "site")


def emitters(spark, base: str) -> dict:
    from pyspark.sql import functions as F

    from quire.sources import sinks

    one = lambda df, slug, ext, column: df.agg(F.lit(slug).alias("slug"), F.lit(ext).alias("ext"), F.array_join(F.array_sort(F.collect_list(column)), "\n").alias("content"))
    return {
        "pages": lambda p: sinks.content_pages(p).select("slug", F.lit(".md").alias("ext"), F.col("body").alias("content")),
        "index": lambda p: sinks.content_index(p).select("slug", F.lit(".json").alias("ext"), F.to_json(F.struct("slug", "title", "links", "tags", "content")).alias("content")),
        "feed": lambda p: one(sinks.feed(p), "feed", ".xml", "xml"),
        "redirects": lambda p: sinks.redirects(p).select(F.col("from_slug").alias("slug"), F.lit(".html").alias("ext"), F.concat(F.lit('<meta http-equiv="refresh" content="0; url=/'), "to_slug", F.lit('">')).alias("content"), F.col("to_slug").alias("source")),
        "site": lambda p: sinks.site_files(base, "notes", spark),
    }


def main(argv: list[str] | None = None, spark=None) -> dict:
    from pyspark.sql import SparkSession

    from quire.plans.pipeline import Build
    from quire.sources import notes, sinks

    given = arguments().parse_args(argv)
    builder = SparkSession.builder.master(given.concurrency) if given.concurrency else SparkSession.builder
    spark = spark or builder.getOrCreate()
    build = Build(emitters=emitters(spark, given.base))
    if given.command == "watch":
        from quire.streaming.site import follow

        patterns = tuple(f"(^|/){notes.pattern(g)}(/|$)" for g in given.ignore)
        follow(spark, given.directory, given.output, build, given.state, WHOLE, patterns, given.once).awaitTermination()
        out = {"generation": sinks.current(spark, given.output)}
    else:
        raw = notes.kept_by_tree(notes.read_notes(spark, given.directory, tuple(given.ignore)), notes.read_ignore_files(spark, given.directory))
        parsed = build.parse(raw.select("path", "raw"))
        counts = build.dropped(parsed).first()
        out = {"parsed": counts.parsed, "dropped": counts.dropped}
        if given.output and not given.dry_run:
            out["written"] = {k: n for k, (n, _) in build.write(build.published(parsed), given.output).items()}
    if given.verbose:
        print(out)
    return out


if __name__ == "__main__":
    main()

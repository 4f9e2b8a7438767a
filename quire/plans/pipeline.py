"""A site build as a plan: transformers, filters and emitters over the table of notes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quire.functions import text
from quire.plans.cut import cut
from quire.plans.workers import reach

Transformer = Callable[[DataFrame], DataFrame]
Emitter = Callable[[DataFrame], DataFrame]


def remove_drafts() -> Column:
    return ~F.col("draft")


def explicit_publish() -> Column:
    return F.col("publish")


@dataclass
class Build:
    """text_transforms run on the raw text, transformers on the parsed notes; filters all have to hold.

    Emitters turn notes into outputs; only write() writes, so a dry run is to build and not to write.
    """

    text_transforms: list[Callable[[Column], Column]] = field(default_factory=lambda: [text.strip_comments])
    transformers: list[Transformer] = field(default_factory=list)
    filters: list[Column] = field(default_factory=lambda: [remove_drafts()])
    emitters: dict[str, Emitter] = field(default_factory=dict)

    def parse(self, notes: DataFrame, as_of: Column | None = None) -> DataFrame:
        from quire.sources.notes import parse_notes

        raw = reduce(lambda c, f: f(c), self.text_transforms, text.strip(F.col("raw")))
        return reduce(lambda df, f: f(df), self.transformers, parse_notes(notes.withColumn("raw", raw), as_of))

    def published(self, parsed: DataFrame) -> DataFrame:
        keep = reduce(lambda a, b: a & b, self.filters, F.lit(True))
        return parsed.filter(keep)

    def dropped(self, parsed: DataFrame) -> DataFrame:
        keep = reduce(lambda a, b: a & b, self.filters, F.lit(True))
        return parsed.agg(F.count("*").alias("parsed"), F.count_if(~keep).alias("dropped"))

    def observed(self, parsed: DataFrame) -> tuple[DataFrame, Observation]:
        """published(), and the counts ``parsed`` and ``dropped`` of the job that reads it, which needs no job of its own."""
        keep, counts = reduce(lambda a, b: a & b, self.filters, F.lit(True)), Observation()
        return parsed.observe(counts, F.count(F.lit(1)).alias("parsed"), F.count_if(~keep).alias("dropped")).filter(keep), counts

    def run(self, notes: DataFrame, root: str, as_of: Column | None = None) -> dict[str, float]:
        """Parses, filters, emits and publishes (``sinks.publish``); the counts and seconds of each phase.

        The notes that stay are written once, in the job that counts them; every emitter reads that.
        """
        from quire.sources.sinks import publish

        began = time.monotonic()
        kept, counts = self.observed(self.parse(notes, as_of))
        kept = cut(kept)
        filtered = time.monotonic()
        outputs = [rows.select("slug", "ext", "content").withColumn("emitter", F.lit(name)) for name, rows in self.emit(kept).items()]
        generation = publish(reduce(DataFrame.unionByName, outputs), root)
        return {**counts.get, "generation": generation, "filter_seconds": filtered - began, "emit_seconds": time.monotonic() - filtered}

    def write(self, published: DataFrame, root: str) -> dict[str, tuple[int, float]]:
        """Writes what each emitter gives (slug, ext, content) below a folder of its name; files and seconds of each."""
        from quire.sources.sinks import write_files

        out = {}
        for name, rows in self.emit(published).items():
            began = time.monotonic()
            n = write_files(rows, f"{root.rstrip('/')}/{name}").count()
            out[name] = (n, time.monotonic() - began)
        return out

    def emit(self, published: DataFrame) -> dict[str, DataFrame]:
        return {name: f(published) for name, f in self.emitters.items()}


#: Pages of one listing file.
LISTED = 100


@udtf(returnType="slug string, ext string, content string")
class _Listings:
    """The pages of a folder, which come in order, as files of ``LISTED`` names each, made as they are full."""

    def __init__(self):
        self.folder, self.names, self.number = "", [], 0

    def eval(self, row: Row):
        self.folder = row["folder"]
        self.names.append(row["slug"])
        if len(self.names) == LISTED:
            yield self._made()

    def terminate(self):
        if self.names:
            yield self._made()

    def _made(self):
        self.number += 1
        out = f"{self.folder}/index-{self.number}", ".html", "\n".join(self.names)
        self.names = []
        return out


def listings(pages: DataFrame) -> DataFrame:
    """(slug, ext, content): an emitter that yields files as it goes, a table function over pages (folder, slug) by folder."""
    reach(pages.sparkSession)
    return _Listings(pages.select("folder", "slug").asTable().partitionBy("folder").orderBy("slug"))


def slug_universe(parsed: DataFrame) -> DataFrame:
    """(slug): all pages and what their aliases are called."""
    from quire.functions import paths

    return parsed.select("slug").union(parsed.select(F.explode(F.transform("aliases", lambda a: paths.slugify_path(a))))).distinct()


def visited(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds ``visited`` to pages (slug): whether a reader's list (slug) has them."""
    own = seen.select(F.col("slug").alias("_s")).distinct().withColumn("visited", F.lit(True))
    return pages.join(own, pages["slug"] == F.col("_s"), "left").withColumn("visited", F.coalesce("visited", F.lit(False))).drop("_s")

"""Slugs, links and path prefixes of notes, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXT = r"\.[A-Za-z0-9]+$"


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, *p), pairs, text)


def strip_slashes(path: Column, prefix_only: bool = False) -> Column:
    """One slash less at either end."""
    return _replaced(path, ("^/", ""), *([] if prefix_only else [("/$", "")]))


def file_extension(path: Column) -> Column:
    """With its dot; null where there is none."""
    return F.nullif(F.regexp_extract(path, _EXT, 0), F.lit(""))


def ends_with(path: Column, suffix: str) -> Column:
    """Whether the path is this, or has it as its last segment."""
    return (path == suffix) | path.endswith("/" + suffix)


def trim_suffix(path: Column, suffix: str) -> Column:
    return F.when(ends_with(path, suffix), F.substring(path, F.lit(1), F.length(path) - len(suffix))).otherwise(path)


def sluggify(text: Column) -> Column:
    return _replaced(text, (r"\s", "-"), ("&", "-and-"), ("%", "-percent"), (r"[?#]", ""), ("/$", ""))


def slugify_path(path: Column, drop_extension: bool = False) -> Column:
    """A file's slug: .md and .html go, other extensions stay unless dropped; _index becomes index."""
    whole = strip_slashes(path)
    ext = F.regexp_extract(whole, _EXT, 0)
    kept = F.lit("") if drop_extension else F.when(ext.isin(".md", ".html"), "").otherwise(ext)
    return F.concat(F.regexp_replace(sluggify(F.regexp_replace(whole, _EXT, "")), "(^|/)_index$", "$1index"), kept)


def simplify_slug(slug: Column) -> Column:
    """Without a final index; the root is /."""
    short = strip_slashes(trim_suffix(slug, "index"), prefix_only=True)
    return F.when(short == "", "/").otherwise(short)


def slug_tag(tag: Column) -> Column:
    """Each segment of a tag slugged by itself."""
    return F.array_join(F.transform(F.split(tag, "/"), sluggify), "/")


def slug_anchor(anchor: Column) -> Column:
    """Lower case, punctuation dropped, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(anchor), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), " ", "-")


def link_path(link: Column) -> Column:
    return F.split(link, "#")[0]


def link_anchor(link: Column) -> Column:
    """With its #, slugged but for pdf files; empty where there is none."""
    raw = F.get(F.split(link, "#"), F.lit(1))
    slugged = F.when(link_path(link).endswith(".pdf"), raw).otherwise(slug_anchor(raw))
    return F.when(raw.isNull(), "").otherwise(F.concat(F.lit("#"), slugged))


def is_folder(path: Column) -> Column:
    return path.endswith("/") | ends_with(path, "index") | ends_with(path, "index.md") | ends_with(path, "index.html")


def root_of(slug: Column) -> Column:
    """The way from a page to the root: one .. for each parent, or a dot."""
    parents = F.size(F.filter(F.split(slug, "/"), lambda s: s != "")) - 1
    return F.when(parents <= 0, ".").otherwise(F.array_join(F.array_repeat(F.lit(".."), parents), "/"))


def join_segments(*parts: Column) -> Column:
    """With single slashes; a slash before the first or after the last part stays."""
    some = F.filter(F.array(*parts), lambda s: (s != "") & (s != "/"))
    joined = F.array_join(F.transform(some, lambda s: strip_slashes(s)), "/")
    lead = F.when(parts[0].startswith("/"), "/").otherwise("")
    trail = F.when(parts[-1].endswith("/"), "/").otherwise("")
    return F.concat(lead, joined, trail)


def resolve_relative(current: Column, target: Column) -> Column:
    return join_segments(root_of(current), simplify_slug(target))


def internal_link(link: Column) -> Column:
    """A relative URL: path slugged, index dropped, leading dots kept, a folder's slash and the anchor added."""
    decoded = F.try_url_decode(F.regexp_replace(link, r"\+", "%2B"))
    path, anchor = link_path(decoded), link_anchor(decoded)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    dots = F.array_join(F.filter(segments, lambda s: s.isin(".", "..")), "/")
    rest = F.array_join(F.filter(segments, lambda s: ~s.isin(".", "..")), "/")
    joined = join_segments(strip_slashes(dots), strip_slashes(simplify_slug(slugify_path(rest))))
    start = F.when(joined == "", ".").when(joined.startswith("."), joined).otherwise(F.concat(F.lit("./"), joined))
    return F.concat(start, F.when(is_folder(path), "/").otherwise(""), anchor)


def prefixes(path: Column) -> Column:
    """a/b/c: [a, a/b, a/b/c]."""
    segments = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))


def folders(path: Column) -> Column:
    """All folders above a file, nearest last; none for files of the root."""
    every = prefixes(path)
    return F.slice(every, F.lit(1), F.size(every) - 1)


def is_absolute_url(link: Column) -> Column:
    return link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")


def is_internal(link: Column) -> Column:
    """Neither a URL with a scheme nor an anchor of the same page."""
    return ~is_absolute_url(link) & ~link.startswith("#")


def is_relative_url(link: Column) -> Column:
    dotted = link.rlike(r"^\.{1,2}")
    return dotted & ~ends_with(link, "index") & ~F.coalesce(file_extension(link).isin(".md", ".html"), F.lit(False))


def is_file_path(path: Column) -> Column:
    return ~path.startswith(".") & file_extension(path).isNotNull()


def is_full_slug(slug: Column) -> Column:
    clear = ~slug.rlike(r"[ #?&]")
    return ~slug.rlike(r"^[./]") & ~slug.endswith("/") & clear


def is_simple_slug(slug: Column) -> Column:
    bounded = ~slug.startswith(".") & ~(slug.startswith("/") & (F.length(slug) > 1))
    return bounded & ~ends_with(slug, "index") & ~slug.rlike(r"[ #?&]")

"""Cleaning, normalising and cutting text, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syntax of links, tags, comments, highlights and anchors.
#: A wiki link: its target and, after a bar, what is shown.
WIKILINK = r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"
#: A link with heading and embed mark: embed, target, heading, alias.
FULL_LINK = r"(!?)\[\[([^\[\]|#]*)(#[^\[\]|]*)?(?:\|([^\[\]]*))?\]\]"
#: Pictographs, flags and the marks that join or vary them, as ranges: the class of emoji is none that Java's patterns know.
EMOJI = r"\x{200D}\x{20E3}\x{231A}-\x{23FF}\x{25AA}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{FE0F}\x{1F000}-\x{1FAFF}"
TAG = rf"(?:^|(?<=\s))#([\p{{L}}\p{{M}}\p{{N}}{EMOJI}\-_/]+)"


#: Where the name of a video stands in its address.
YOUTUBE = r"^.*(youtu.be/|v/|u/\w/|embed/|watch\?v=|&v=)([^#&?]*).*"


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, *p), pairs, text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_key(text: Column) -> Column:
    """For finding duplicates: lower case, no parentheses, letters and digits of ASCII alone."""
    return F.trim(_replaced(F.lower(text), (r"\([^)]*\)", ""), (r"[^a-z0-9]+", " ")))


def name_key(text: Column) -> Column:
    """For matching names: brackets, quotes, marks of Markdown dropped, spaces squeezed, lower case."""
    return F.lower(squeeze(F.regexp_replace(text, r"[\[\](){}:*`|\"'’“”]", "")))


#: Letters whose capital is written with several, and the one letter that stands for it alone; most have none.
_CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter, each one letter, as SQL engines have it that fold code points: ß becomes ẞ, not SS."""
    own = F.translate(text, "".join(_CAPITALS), "".join(_CAPITALS.values()))
    each = F.transform(F.split(own, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.array_join(each, "")


def lower_letters(text: Column) -> Column:
    """Lower case letter by letter: İ becomes i alone, and Σ is σ at the end of a word too."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def spaced_key(text: Column) -> Column:
    return squeeze(F.lower(text))


def link_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"^[\s\[\]]+|[\s\[\]]+$", ""))


def node_name(text: Column) -> Column:
    """A node's name in a graph listing: runs of other than letters and digits become _, an empty one X."""
    name = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "X").otherwise(name)


def file_name(text: Column) -> Column:
    """What file systems refuse becomes a hyphen."""
    return squeeze(F.regexp_replace(text, r'[\\/:*?"<>|]', " - "))


def stub_name(text: Column) -> Column:
    """The other rule: slashes and bars become hyphens, a colon a hyphen after a space."""
    return squeeze(_replaced(text, (r"[/|]", "-"), (":", " -")))


def safe_title(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _\-]", "")), " ", "_"), "_+", "_")


#: Fenced code, open to the end where nothing closes it, and inline code between equal runs of backticks.
CODE = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n(?:.*?^[ \t]*\1[`~]*[ \t]*$|.*)|(?<!`)(`+)(?!`)(?:(?!\n\s*\n).)+?(?<!`)\2(?!`)"


def without_code(text: Column) -> Column:
    """A blank in place of each piece of code, so that what is looked for in a text isn't found in its code."""
    return F.regexp_replace(text, CODE, " ")


def outside_code(text: Column, change: Callable[[Column], Column]) -> Column:
    """The text changed between its pieces of code, which stay as they are."""
    plain, code = F.split(text, CODE, -1), F.array_append(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), "")
    return F.array_join(F.transform(F.arrays_zip(plain.alias("plain"), code.alias("code")), lambda x: F.concat(change(x.plain), x.code)), "")


def each_match(text: Column, pattern: str, groups: int, change: Callable[..., Column]) -> Column:
    """Every match replaced by change(whole, group 1, ...); a group that takes no part is empty."""
    plain = F.split(text, pattern, -1).alias("plain")
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)]
    new = lambda x: F.when(x.g0.isNotNull(), change(*[F.coalesce(x[f"g{g}"], F.lit("")) for g in range(groups + 1)])).otherwise("")
    return F.array_join(F.transform(F.arrays_zip(plain, *parts), lambda x: F.concat(x.plain, new(x))), "")


def link_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1))


def link_displays(text: Column) -> Column:
    """What each link shows; empty for links without a bar."""
    return F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(2))


def full_links(text: Column) -> Column:
    """Array of (embed, target, heading, alias)."""
    part = lambda k: F.regexp_extract_all(text, F.lit(FULL_LINK), F.lit(k))
    return F.transform(
        F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")),
        lambda x: F.struct((x.a == "!").alias("embed"), F.trim(x.b).alias("target"), x.c.alias("heading"), x.d.alias("alias")),
    )


def inline_tags(text: Column) -> Column:
    """Tags of the text, in order and once each; a tag of digits and slashes alone is none."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda t: ~t.rlike(r"^[/\d]+$")))


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)%%.*?%%", "")


def mark_highlights(text: Column) -> Column:
    return F.regexp_replace(text, "==([^=]+)==", "<mark>$1</mark>")


def arrows(text: Column) -> Column:
    """Arrows of ASCII as single characters, the longest first."""
    return _replaced(text, ("<=>|<==>", "⇔"), ("=+>", "⇒"), ("<->|<-->", "↔"), ("-+>", "→"), ("<-+", "←"), ("<=+", "⇐"))


def unlink(text: Column) -> Column:
    """What links show in place of the links, none reaching beyond its own brackets."""
    return _replaced(text, (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]|]*)\]\]", "$1"))


def section(text: Column, title: str) -> Column:
    """The text from a heading of the second level to the next; empty where there is none."""
    return F.regexp_extract(text, rf"(?ms)^## {title}[ \t]*$(.*?)(?=^## |\z)", 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def is_stub(text: Column) -> Column:
    return text.rlike(r"(?m)^-\s*TODO")


def unbalanced(line: Column) -> Column:
    """Whether a line opens and closes unequally many links."""
    return F.regexp_count(line, F.lit(r"\[\[")) != F.regexp_count(line, F.lit(r"\]\]"))


def shorten_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(https?://)?(www\.)?([\w\-]+(?:\.[\w\-]+)+)(/[^\s]*)?", "$3$4")


def escape_html(text: Column) -> Column:
    return _replaced(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def unescape_html(text: Column) -> Column:
    return _replaced(text, ("&#039;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def reading_minutes(text: Column, words_a_minute: int = 200) -> Column:
    return F.ceil(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) / words_a_minute)


def description(text: Column, aim: int = 150, most: int = 300) -> Column:
    """The first sentence, then more while ``aim`` characters hold; over ``most`` it is cut and gets dots."""
    step = lambda acc, s: F.when(acc.done | ((acc.out != "") & ((s == "") | (F.length(acc.out) + 1 + F.length(s) > aim))), F.struct(acc.out.alias("out"), F.lit(True).alias("done"))).otherwise(
        F.struct(F.when(acc.out == "", s).otherwise(F.concat_ws(" ", acc.out, s)).alias("out"), F.lit(False).alias("done"))
    )
    short = F.aggregate(sentences(squeeze(text)), F.struct(F.lit("").alias("out"), F.lit(False).alias("done")), step, lambda acc: acc.out)
    return F.when(F.length(short) > most, F.concat(F.substring(short, 1, most), F.lit("..."))).otherwise(short)


def packed(parts: Column, most: int = 2400) -> Column:
    """Paragraphs joined by blank lines into pieces of at most so many characters, or of one paragraph."""
    fits = lambda acc, p: (acc.now != "") & (F.length(acc.now) + 2 + F.length(p) <= most)
    step = lambda acc, p: F.when(fits(acc, p), F.struct(acc.out.alias("out"), F.concat(acc.now, F.lit("\n\n"), p).alias("now"))).otherwise(
        F.struct(F.when(acc.now == "", acc.out).otherwise(F.concat(acc.out, F.array(acc.now))).alias("out"), p.alias("now"))
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc.now == "", acc.out).otherwise(F.concat(acc.out, F.array(acc.now))))


def chunks(text: Column, size: int = 2500) -> Column:
    """Consecutive pieces of so many characters; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def query_terms(query: Column) -> Column:
    """A query's words and its growing beginnings of several words, longest first."""
    words = F.split(F.trim(query), r"\s+")
    grown = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    every = F.array_distinct(F.concat(words, grown))
    return F.array_sort(every, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def proper_names(text: Column, least: int = 3, stop: tuple[str, ...] = ("The", "And", "But", "For", "With")) -> Column:
    """Runs of up to five capitalised words outside code, once each, in order."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", " ")
    found = F.regexp_extract_all(plain, F.lit(r"\b(\p{Lu}[\p{L}'’\-]+(?: \p{Lu}[\p{L}'’\-]+){0,4})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: (F.length(n) >= least) & ~n.isin(*stop)))


def media_kind(target: Column) -> Column:
    """What an embed shows, by the extension of its target."""
    ext = F.lower(F.regexp_extract(target, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext.isin("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp"), "image")
        .when(ext.isin("mp4", "webm", "ogv", "mov", "mkv"), "video")
        .when(ext.isin("mp3", "wav", "m4a", "ogg", "3gp", "flac"), "audio")
        .when(ext == "pdf", "document")
        .otherwise("page")
    )


def youtube_embed(url: Column) -> Column:
    """The embed address of a video, with its list, or of a list alone; null for other addresses."""
    video = F.regexp_extract(url, YOUTUBE, 2)
    playlist = F.nullif(F.regexp_extract(url, r"[?&]list=([^#?&]*)", 1), F.lit(""))
    base = F.lit("https://www.youtube.com/embed/")
    one = F.concat(base, video, F.coalesce(F.concat(F.lit("?list="), playlist), F.lit("")))
    return F.when(F.length(video) == 11, one).when(playlist.isNotNull(), F.concat(base, F.lit("videoseries?list="), playlist))


def class_names(*names: Column) -> Column:
    """The names that are there, apart by a space."""
    return F.concat_ws(" ", *[F.nullif(n, F.lit("")) for n in names])


def emoji_code(text: Column) -> Column:
    """The code points of a text in hexadecimal, joined by hyphens, without the mark that only asks for colour."""
    points = F.filter(F.transform(F.split(text, ""), lambda c: F.lower(F.hex(F.ascii(c)))), lambda h: (h != "0") & (h != "fe0f"))
    return F.array_join(points, "-")


def edge_label(suffix: Column) -> Column:
    """What a route says of itself: via and method, a feature only without either; 'if stated' dropped."""
    part = lambda p: F.trim(F.regexp_replace(F.regexp_extract(suffix, p, 1), r"(?i)\bif stated\b", ""))
    has = lambda p: suffix.rlike(p)
    via, method, feature = r"(?i)\[via\s+([^\]]+)\]", r"(?i)\[method:\s*([^\]]+)\]", r"(?i)\[feature:\s*([^\]]+)\]"
    bits = F.array(F.when(has(via), F.concat(F.lit("via "), part(via))), F.when(has(method), part(method)), F.when(has(feature) & ~has(via) & ~has(method), part(feature)))
    return F.array_join(F.array_compact(bits), "; ")


def callout_kind(line: Column, aliases: dict[str, str]) -> Column:
    """The kind of a quote block that begins with [!kind], by its canonical name; null for others."""
    raw = F.lower(F.regexp_extract(line, r"^>\s*\[!([\w\-]+)\|?[^\]]*\]", 1))
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return F.when(raw != "", F.coalesce(named[raw], raw) if named is not None else raw)


def block_text(body: Column, anchor: Column) -> Column:
    """The line or paragraph that the anchor ^id ends, without it; null where no block has it."""
    parts = F.split(body, r"\n\s*\n|\n(?=\s*[-*] )")
    own = F.filter(parts, lambda p: block_id(F.regexp_replace(p, r"\s+$", "")) == anchor)
    return F.when(F.size(own) > 0, strip(F.regexp_replace(own[0], r"\s\^[A-Za-z0-9_\-]+\s*$", "")))


def block_id(line: Column) -> Column:
    """The anchor ^id at the end of a block; null where there is none."""
    return F.nullif(F.regexp_extract(line, r"\s\^([A-Za-z0-9_\-]+)\s*\z", 1), F.lit(""))


def group_line(line: Column) -> Column:
    """'Kind: a; b' as a struct of kind and names; null for other lines."""
    kind = F.regexp_extract(line, r"^\s*[-*]?\s*(\w+)\s*:\s*(.+)$", 1)
    names = F.filter(F.transform(F.split(F.regexp_extract(line, r"^\s*[-*]?\s*(\w+)\s*:\s*(.+)$", 2), ";"), strip), lambda n: n != "")
    return F.when(kind != "", F.struct(kind.alias("kind"), names.alias("names")))

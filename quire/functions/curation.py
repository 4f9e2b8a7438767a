"""Judging candidate names and route labels, and rewriting links by mapping tables; word lists are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import paths, text

# Words that hint at a kind, quantifiers, connectors and the parts of quoted names that tell their kind.
LOCATION_HINTS = ("hall", "temple", "tower", "cavern", "forum", "well", "stair", "tomb", "inn", "library", "pyramid", "waterfall", "chasm", "shrine", "caves", "oracle")
ITEM_HINTS = ("ring", "spear", "gem", "circlet", "tablet", "cloak", "pin", "sack", "chair", "sword", "staff")
FACTION_HINTS = ("cult", "knights", "company", "band", "guild", "order", "empire", "brigade", "darlings")
QUANTIFIER = r"(?i)^(many|several|some|a couple|\d+\b|two|three|four|five|six|seven|eight|nine|ten)\b"
CONNECTOR = r"(?i)\b(connect|lead|via|through|across|toward|into|onto|to|from|down|up|entrance|exit|gate|basket|rappel|levitat|teleport|stair|hole)\b"
#: A quoted phrase in title case.
QUOTED_PHRASE = r'"([A-Z][A-Za-z]+(?:[ \-](?:of|the|and|[A-Z][A-Za-z.\-]+))*)"'
#: What stands before a deity's name in the name of a place or group.
HEADS = "Temple|Pyramid|Library|Forum|Glory|Catacombs|Chamber|Shrine|Sanctuary|Statue|Priory|Order|Monastery|Hall|Tower|Gate|Gates|Tomb|Stairs|Vault|Arena"
#: Words of direction that labels lose, and what stands between the steps of one.
DIRECTIONS = r"\b(north|south|east|west|up|down|top|bottom|base)\b"
STEPS = r"\bthen\b|\band\b|,| to | into | from | past | through | over | across "
QUOTED = {
    "Item": "Rug|Rugs|Chair|Rod|Wand|Pebble|Mirror|Scepter|Armor",
    "Location": "Hall|Temple|Library|Well|Cavern|Chasm|Pyramid|Palace|Court|Arena",
    "Faction": "Company|Brigade|Cult",
}


def _words(name: Column) -> Column:
    return F.split(F.lower(name), r"[^\p{L}\p{N}_]+")


def guess_kind(name: Column, default: str = "npc") -> Column:
    """By hint words: a location before an item before a faction."""
    has = lambda hints: F.arrays_overlap(_words(name), F.array(*map(F.lit, hints)))
    return F.when(has(LOCATION_HINTS), "location").when(has(ITEM_HINTS), "item").when(has(FACTION_HINTS), "faction").otherwise(default)


def is_unique_item(name: Column, exists: Column, commodities: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Known ones are; commodities aren't; else by pattern, or several words with a capital beyond the first."""
    later = F.exists(F.slice(F.split(F.trim(name), r"\s+"), F.lit(2), F.greatest(F.size(F.split(F.trim(name), r"\s+")), F.lit(1))), lambda w: w.rlike(r"^\p{Lu}"))
    fits = later
    for p in patterns:
        fits = fits | name.rlike(p)
    return F.when(exists, True).when(text.spaced_key(name).isin(*commodities) if commodities else F.lit(False), False).otherwise(fits)


def significant_name(line: Column) -> Column:
    """The name a list line states: before the comma, as shown, the last of several forms."""
    first = F.trim(F.split(F.regexp_replace(line, r"^[\-\s]+|[\-\s]+$", ""), ",")[0])
    shown = F.regexp_replace(first, r"^\[\[[^|]*\|(.*)\]\]$", "$1")
    return F.trim(F.element_at(F.split(shown, " / "), -1))


def is_specific(name: Column, generic: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> Column:
    """Not a quantity, a generic word, one with a generic part, or one with brackets or slashes; not empty."""
    low = F.lower(name)
    out = (name != "") & ~name.rlike(QUANTIFIER) & ~name.rlike(r"[\[\]/]")
    if generic:
        out = out & ~low.isin(*generic)
    for p in parts:
        out = out & ~low.contains(p)
    return out


def quoted_candidates(body: Column) -> Column:
    """Array of (name, kind) of quoted title-case phrases of up to eight words."""
    names = F.regexp_extract_all(body, F.lit(QUOTED_PHRASE), F.lit(1))
    kind = lambda n: F.when(n.rlike(QUOTED["Item"]), "Item").when(n.rlike(QUOTED["Location"]), "Location").when(n.rlike(QUOTED["Faction"]), "Faction").otherwise("NPC")
    return F.transform(F.array_distinct(F.filter(names, lambda n: F.size(F.split(n, " ")) <= 8)), lambda n: F.struct(n.alias("name"), kind(n).alias("kind")))


def states_a_way(window: Column) -> Column:
    """Whole words only, as the stems in the list end at a word's end."""
    return window.rlike(CONNECTOR)


def first_hop(line: Column) -> Column:
    """(a, b): the first two stations of a route A -> B -> C."""
    stops = F.transform(F.split(line, "->"), lambda s: F.regexp_replace(text.strip(s), r"^-\s*", ""))
    return F.when(F.size(stops) >= 2, F.struct(stops[0].alias("a"), stops[1].alias("b")))


def short_labels(label: Column, canon: dict[str, str], rejected: tuple[str, ...] = (), events: tuple[str, ...] = (), most: int = 2) -> Column:
    """A label's parts as canonical words: at most ``most`` of each phrase and of each part.

    canon: word or two-word name to canonical word. Rejected parts, those with a possessive or an event word, and
    phrases of over four words give nothing.
    """
    table = F.create_map(*[F.lit(x) for pair in canon.items() for x in pair])
    parts = F.filter(F.transform(F.split(label, r"[;|]"), lambda p: text.strip(p)), lambda p: p != "")
    plain = F.filter(parts, lambda p: ~F.lower(p).isin(*rejected) & ~p.rlike(r"\w'[sS]\b") & ~F.lower(p).rlike("|".join(events) or "(?!)"))

    def chunk(c):
        named = F.transform(F.split(text.strip(c), r"\s+"), lambda w: table[w])
        found = F.slice(F.array_distinct(F.array_compact(named)), 1, most)
        return F.when(table[text.strip(c)].isNotNull(), F.array(table[text.strip(c)])).when(F.size(F.split(text.strip(c), r"\s+")) > 4, F.array().cast("array<string>")).otherwise(found)

    def part(p):
        pieces = F.split(F.regexp_replace(F.lower(p), DIRECTIONS, ""), STEPS)
        return F.array_join(F.slice(F.array_distinct(F.flatten(F.transform(pieces, chunk))), 1, most), " / ")

    return F.array_join(F.filter(F.transform(plain, part), lambda p: p != ""), "; ")


def add_tag(raw: Column, tag: str) -> Column:
    """A tag more in the front matter, which is made if it isn't there; one that is there isn't added again."""
    block = raw.rlike(r"\A---[ \t]*\r?\n")
    has = raw.rlike(rf"(?m)^\s*-\s*\Q{tag}\E\s*$")
    listed = F.regexp_replace(raw, r"(?m)\A(---(?:\r?\n(?!---).*)*?\r?\ntags:[^\r\n]*)", f"$1\n  - {tag}")
    return (
        F.when(has, raw)
        .when(block & raw.rlike(r"(?m)^tags:"), listed)
        .when(block, F.regexp_replace(raw, r"\A---[ \t]*\r?\n", f"---\ntags:\n  - {tag}\n"))
        .otherwise(F.concat(F.lit(f"---\ntags:\n  - {tag}\n---\n\n"), raw))
    )


def escape_table_links(body: Column) -> Column:
    """Bars and headings of links inside table lines escaped, so that they don't end a cell."""
    lines = F.split(body, "\n")
    once = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\[\[[^\[\]|\\]*)\|", r"$1\\|"), r"(\[\[[^\[\]#\\]*)#", r"$1\\#")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s*\|.*\|\s*$"), once(x)).otherwise(x)), "\n")


#: The line that begins a callout.
CALLOUT_LINE = r"(?m)^(> *\[!\w+\|?.*?\][+-]?.*)$"


def plain_anchors(body: Column) -> Column:
    """Links whose headings may hold any syntax with the heading's slug, shown as they were spelled unless they say how."""

    def link(whole: Column, embed: Column, target: Column, heading: Column, alias: Column) -> Column:
        anchor = F.regexp_replace(F.trim(paths.link_anchor(F.concat(target, heading))), "^#+", "")
        mark = F.when(heading.startswith("#^"), "#^").otherwise("#")
        shown = F.when(alias != "", F.concat(F.lit("|"), alias)).when(heading != "", F.regexp_replace(heading, "^#", "|")).otherwise("")
        return F.concat(embed, F.lit("[["), F.trim(target), F.when(anchor != "", F.concat(mark, anchor)).otherwise(""), shown, F.lit("]]"))

    return text.each_match(body, text.FULL_LINK, 4, link)


def from_obsidian(body: Column) -> Column:
    """The dialect of notes as plain Markdown: comments go, a callout's title ends its line, links within tables are
    escaped, all others have slugs for headings; marks and arrows are set outside code."""
    out = F.regexp_replace(text.strip_comments(body), CALLOUT_LINE, "$1\n> ")
    return text.outside_code(escape_table_links(plain_anchors(out)), lambda c: text.arrows(text.mark_highlights(c)))


def from_hugo(body: Column) -> Column:
    """Cross references, heading ids, figures and shortcodes of one dialect as plain Markdown."""
    out = F.regexp_replace(body, r'\[([^\]]+)\]\(\{\{< relref "([^"]+)" >\}\}\)', "[$1]($2)")
    out = F.regexp_replace(out, r"(?m)^(.*) \{#[^}]*\}", "$1")
    out = F.regexp_replace(out, r"\{\{(.*?)\}\}", "$1")
    return F.regexp_replace(out, r'< ?figure src="([^"]*)" ?>', "![]($1)")


def from_roam(body: Column) -> Column:
    """Choices, tasks, quotes, highlights and italics of the other dialect."""
    out = F.regexp_replace(body, r"\{\{\[?\[?TODO\]?\]?\}\}", "[ ]")
    out = F.regexp_replace(out, r"\{\{\[?\[?DONE\]?\]?\}\}", "[x]")
    out = F.regexp_replace(out, r"\{\{or:([^|}]*)[^}]*\}\}", "$1")
    out = F.regexp_replace(out, r"\[\[>\]\]\s*(.*)", "> $1")
    return F.regexp_replace(F.regexp_replace(out, r"\^\^(.+?)\^\^", "==$1=="), r"__(.+?)__", "*$1*")


def session_number(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"(?i)^session (\d+)", 1), F.lit("")).cast("int")


def best_date(front: Column, git: Column, file: Column) -> Column:
    """The date a note states, else its last commit's, else its file's."""
    return F.coalesce(front, git, file)


def relink(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds ``new``: what stands in place of each link. links: (target, label); mapping: (target, action, to).

    action: location (link to that page), plain (no link) or redirect (link to that path, shown by its name); for a
    target with several the first of these holds. Links that nothing maps stay.
    """
    rank = F.array_position(F.array(*map(F.lit, ("location", "plain", "redirect"))), F.col("action"))
    best = mapping.groupBy("target").agg(F.min(F.struct(rank.alias("r"), "action", "to")).alias("m")).select(F.col("target").alias("_t"), "m.action", "m.to")
    shown = F.nullif("label", F.lit(""))
    name = F.regexp_replace(F.element_at(F.split("to", "/"), -1), r"\.md$", "")
    link = lambda page, label: F.when(label.isNull(), F.concat(F.lit("[["), page, F.lit("]]"))).otherwise(F.concat(F.lit("[["), page, F.lit("|"), label, F.lit("]]")))
    new = (
        F.when(F.col("action") == "location", link(F.col("to"), shown))
        .when(F.col("action") == "plain", F.coalesce(shown, F.col("to")))
        .when(F.col("action") == "redirect", link(F.col("to"), F.coalesce(shown, name)))
        .otherwise(link(F.col("target"), shown))
    )
    return links.join(best, links["target"] == best["_t"], "left").withColumn("new", new).drop("_t", "action", "to")


def canonical_ends(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges (a, b, …) with a and b as the pages of those names; text that names no page stays. names: (name, page)."""
    known = names.groupBy("name").agg(F.max("page").alias("page"))
    out = edges
    for end in ("a", "b"):
        key = F.trim(F.regexp_replace(text.link_key(F.col(end)), "^locations/", ""))
        own = known.select(F.col("name").alias(f"_n{end}"), F.col("page").alias(f"_p{end}"))
        out = out.join(own, key == F.col(f"_n{end}"), "left").withColumn(end, F.coalesce(F.col(f"_p{end}"), F.col(end))).drop(f"_n{end}", f"_p{end}")
    return out


def demote(body: Column, name: str, before: str = HEADS) -> Column:
    """Links to a page of that name become its plain name where one of these words and 'of' stand before them."""
    return F.regexp_replace(body, rf"(?i)\b({before}) of \[\[[^\[\]|]*\Q{name}\E(?:\.md)?\|[^\]]+\]\]", f"$1 of {name}")


def linkify_first(line: Column, names: dict[str, str]) -> Column:
    """The first word of a line without links that names a page's demonym becomes a link to that page, as it is spelled.

    names: demonym, in any case, to page; the longest that occurs is taken, and one link is made at most.
    """
    out = line
    for word in sorted(names, key=lambda w: (len(w), w)):  # the longest is asked last, so it decides
        pattern = rf"(?i)\b\Q{word}\E\b"
        out = F.when(line.rlike(pattern), F.concat(F.regexp_extract(line, rf"(?s)^(.*?){pattern}", 1), F.lit(f"[[{names[word]}|"), F.regexp_extract(line, rf"(?i)\b(\Q{word}\E)\b", 1), F.lit("]]"), F.regexp_extract(line, rf"(?s)^.*?{pattern}(.*)$", 1))).otherwise(out)
    return F.when(line.contains("[["), line).otherwise(out)


def session_title(title: Column) -> Column:
    """'Session 8B - the end', however spaced and spelled, as 'Session 8b - the end'."""
    number, rest = F.regexp_extract(title, r"(?i)^\s*session\s*(\d+[a-z]?)\s*[-:\u2013]*\s*(.*)$", 1), F.regexp_extract(title, r"(?i)^\s*session\s*(\d+[a-z]?)\s*[-:\u2013]*\s*(.*)$", 2)
    return F.when(number != "", F.concat(F.lit("Session "), F.lower(number), F.when(rest != "", F.concat(F.lit(" - "), F.rtrim(rest))).otherwise(""))).otherwise(title)


def of_kinds(candidates: DataFrame, kinds: tuple[str, ...] | None = None, items: str = "all", unique: Column | None = None) -> DataFrame:
    """Candidates (kind, ...) of those kinds; items: with 'unique' those of kind Item only where ``unique`` holds."""
    out = candidates.filter(F.col("kind").isin(*kinds)) if kinds else candidates
    return out.filter((F.col("kind") != "Item") | unique) if items == "unique" and unique is not None else out


def supported_in(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of names that stand together in a text, as they are spelled. texts: (id, body)."""
    from quire.operators.cooccurrence import contained, together

    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b"))
    return together(pairs, contained(names, texts).withColumnRenamed("id", "session"))

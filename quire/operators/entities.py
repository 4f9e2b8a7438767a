"""Entities and their names: lookup, mentions in notes, ranked reports, audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.fuzzy import can_reach, ratio
from quire.plans.cut import cut, numbered
from quire.plans.workers import reach

#: In what order kinds claim a name they share: the first wins, or with policy "last" the last.
FIRST_KINDS = ("npcs", "locations", "factions", "items")
LAST_KINDS = ("npcs", "locations", "factions", "items", "pcs")


def name_table(entities: DataFrame, policy: str = "first") -> DataFrame:
    """(name, canonical, kind), one row a normalised name. entities: (kind, canonical, path, aliases)."""
    kinds = FIRST_KINDS if policy == "first" else LAST_KINDS
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0)), F.lit(len(kinds) + 1))
    names = F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw")
    every = entities.select("kind", "canonical", "path", rank.alias("rank"), names).withColumn("name", text.name_key(F.col("raw"))).filter("name <> ''")
    best = F.min if policy == "first" else F.max
    # An aggregate with a combiner, where a window would sort every name's rows.
    return every.groupBy("name").agg(best(F.struct("rank", "path", "canonical", "kind")).alias("e")).select("name", "e.canonical", "e.kind")


def resolve(candidates: DataFrame, names: DataFrame, column: str = "candidate") -> DataFrame:
    """Adds ``canonical`` and ``kind`` of the entity of that name, null without one."""
    key = text.name_key(F.col(column))
    return candidates.withColumn("_key", key).join(names, F.col("_key") == F.col("name"), "left").drop("_key", "name")


def resolve_fuzzy(candidates: DataFrame, names: DataFrame, least: float = 0.9, column: str = "candidate") -> DataFrame:
    """(candidate, name, ratio): the most similar name of at least that ratio, the smallest of equals.

    Where the ratio lets two names differ in at most ``FEW`` letters, pairs come by equality of what is left of each when as
    many are left out; of names of one frame, numbered ones say, only those meet that are so near. The others come from a
    prefix filter over pairs of letters, the rarest first: what the ratio lets two names differ in can spoil only so many
    of them, so that one of the rarest few of each is shared; names of one frame that long share most of these. Lengths, the
    number of shared pairs of letters and the edit distance then end most pairs before Python. At a high ratio fewer letters
    may differ; so ratios go down in steps, and what one step has resolved, whose best name is then known, doesn't come to
    the next.
    """
    reach(candidates.sparkSession)
    left = cut(candidates.select(column).distinct().withColumn("key", text.name_key(F.col(column))).filter("key <> ''"))
    known = cut(names.select("name").filter("name <> ''").distinct())
    found = None
    for step in [s for s in (0.97, 0.94) if s > least] + [least]:
        best = cut(_nearest(left, known, step, column))
        found = best if found is None else found.unionAll(best)
        left = cut(left.join(best.select(column), column, "left_anti"))
        if left.isEmpty():
            break
    return found


def _grams(name: Column) -> Column:
    """The pairs of letters of a name, ends included, each with how often it stood before, so that all differ."""
    padded = F.concat(F.lit("\x01"), name, F.lit("\x02"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).cast("string")))


def _rarest(rows: DataFrame, by: str, counts: DataFrame, least: float) -> DataFrame:
    """(by, gram): the rarest grams of each row (by, grams), one more than a name of that ratio may lack.

    Of n characters a ratio r lets at most n (2 - 2r) / (2 - r) go, if nothing comes instead, and each takes two grams.
    """
    each = rows.select(by, F.explode("grams").alias("gram")).join(counts, "gram", "left")
    lists = each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    spoilt = F.floor((F.size("g") - 1) * F.lit(2 * (2 - 2 * least) / (2 - least)) + 1e-9).cast("int")
    return lists.select(by, F.explode(F.transform(F.slice("g", F.lit(1), spoilt + 1), lambda x: x.gram)).alias("gram"))


#: Letters that may differ where names meet by what is left without them.
FEW = 2


def _unmatched(letters: Column, least: float) -> Column:
    """How many letters two names may have that aren't matched; letters: of both together."""
    return F.floor(letters * (1 - least) + 1e-9).cast("int")


def _most_unmatched(name: Column, least: float) -> Column:
    """The same beside the longest name that reaches the ratio."""
    return _unmatched(F.length(name) + F.floor(F.length(name) * ((2 - least) / least) + 1e-6), least)


def _thinned(rows: DataFrame, by: str, least: float) -> DataFrame:
    """(by, left, gone): a hash of each name without each choice of ``gone`` letters, as many as may be unmatched, at most FEW."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    left, most = F.array(by), F.least(_most_unmatched(F.col(by), least), F.lit(FEW))
    out = rows.select(by, F.col(by).alias("left"), F.lit(0).alias("gone"))
    for gone in range(1, FEW + 1):
        left = F.array_distinct(F.flatten(F.transform(F.filter(left, lambda x: x != ""), without)))
        out = out.union(rows.filter(most >= gone).select(by, F.explode(left), F.lit(gone)))
    return out.withColumn("left", F.xxhash64("left"))


def _met(own: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(key, name): what comes to Python. own: (key); known: (name)."""
    unmatched = _unmatched(F.length("key") + F.length("name"), least)
    near = _thinned(own, "key", least).join(_thinned(known, "name", least).withColumnRenamed("gone", "_gone"), "left").filter(F.col("gone") + F.col("_gone") <= unmatched)
    more = lambda rows, by: rows.filter(_most_unmatched(F.col(by), least) > FEW).withColumn("grams", _grams(F.col(by)))
    long = cut(more(known, "name"))
    counts = cut(long.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    far = _rarest(more(own, "key"), "key", counts, least).join(_rarest(long, "name", counts, least), "gram")
    pairs = near.select("key", "name").union(far.select("key", "name")).filter(can_reach(F.col("key"), F.col("name"), least)).distinct()
    # What is left unmatched is at most inserted and deleted, which bounds the edit distance and the grams that differ.
    shared = F.size(F.array_intersect(_grams(F.col("key")), _grams(F.col("name"))))
    longest = F.greatest(F.length("key"), F.length("name"))
    return pairs.filter(shared >= longest + 1 - 2 * unmatched).filter(F.levenshtein("key", "name") <= unmatched)


def _nearest(own: DataFrame, known: DataFrame, least: float, column: str) -> DataFrame:
    """own: (column, key)."""
    met = _met(own.select("key").distinct(), known, least)
    scored = met.withColumn("ratio", ratio("key", "name")).filter(F.col("ratio") >= least)
    best = scored.groupBy("key").agg(F.max_by(F.struct("name", "ratio"), F.struct(F.col("ratio"), (-F.length("name")).alias("l"), F.col("name"))).alias("m"))
    return own.join(best, "key").select(column, "m.name", "m.ratio")


def link_mentions(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(path, no, canonical, target): links of numbered lines (path, no, line) whose target is an accepted name.

    names: (target, canonical), lower case; of several owners of a target the smallest canonical wins.
    """
    owner = names.groupBy("target").agg(F.min("canonical").alias("canonical"))
    links = lines.select("path", "no", F.explode(text.link_targets(F.col("line"))).alias("raw")).withColumn("target", F.lower(text.strip(F.col("raw"))))
    return links.join(owner, "target").select("path", "no", "canonical", "target")


#: First words that a plan may carry; beyond it every word of a line may begin a name.
FIRST_WORDS = 1000


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(line, r"([^\p{L}\p{N}_ ])", " $1 "), " +"), lambda w: w != "")


def text_mentions(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(path, no, canonical, alias, n): names in the lines outside links, between non-word characters.

    Runs of words meet the names by equality, so the cost follows the text and not its product with the names; runs have
    the lengths that the names have, however long, and begin with a first word of theirs where these are few. Every alias
    counts for itself. names: (alias, canonical), lower case. Counts the names when it is called.
    """
    known = names.select("alias", "canonical").distinct().withColumn("t", _tokens(F.col("alias"))).filter(F.size("t") > 0)
    lengths = sorted(r[0] for r in known.select(F.size("t")).distinct().collect())  # a handful of numbers
    first = [r[0] for r in known.select(F.col("t")[0]).distinct().limit(FIRST_WORDS + 1).collect()]
    plain = F.lower(F.regexp_replace("line", r"\[\[.*?\]\]", " . "))
    rows = lines.select("path", "no", _tokens(plain).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.size("w"))
    if len(first) <= FIRST_WORDS:
        starts = F.filter(starts, lambda i: F.element_at("w", i).isin(first))
    fits = lambda i: F.filter(F.array(*map(F.lit, lengths)), lambda k: i + k - 1 <= F.size("w"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(fits(i), lambda k: F.array_join(F.slice("w", i, k), " "))))
    keyed = known.select(F.array_join("t", " ").alias("run"), "alias", "canonical")
    return rows.select("path", "no", F.explode(runs).alias("run")).join(keyed, "run").groupBy("path", "no", "canonical", "alias").agg(F.count("*").alias("n"))


def coverage(mentions: DataFrame) -> DataFrame:
    """Counts by entity. mentions: (canonical, own_path, path, session, is_link, n); a mention on the own page doesn't count."""
    own = mentions.filter(~F.col("path").eqNullSafe(F.col("own_path")))
    when = lambda c, v: F.when(c, F.col(v))
    return own.groupBy("canonical").agg(
        F.coalesce(F.sum(when(F.col("is_link"), "n")), F.lit(0)).alias("link_mentions"),
        F.coalesce(F.sum(when(~F.col("is_link"), "n")), F.lit(0)).alias("text_mentions"),
        F.count_distinct("path").alias("files"),
        F.count_distinct(when(F.col("is_link"), "path")).alias("link_files"),
        F.count_distinct(when(F.col("session"), "path")).alias("sessions"),
        F.count_distinct(when(F.col("session") & F.col("is_link"), "path")).alias("link_sessions"),
    )


def _order(by: str) -> list[Column]:
    total = F.col("link_mentions") + F.col("text_mentions")
    first = {"mentions": [total.desc()], "links": [F.col("link_mentions").desc()], "sessions": [F.col(c).desc() for c in ("sessions", "link_sessions", "link_mentions", "text_mentions")]}
    return [*first[by], F.col("canonical").asc()]


def ranked(counts: DataFrame, by: str = "mentions", top: int | None = None) -> DataFrame:
    """Adds ``rank``, running on through ties. by mentions: the total, then the name; links: these alone; sessions: coverage first."""
    order = _order(by)
    return numbered(counts.orderBy(*order).limit(top) if top else counts, *order)


#: The ranked lists: what counts, in what order, how many, and whether of stubs alone (True) or of others alone (False).
PUNCH_LISTS = {
    "all": ("mentions", None, None), "links": ("links", None, None), "stubs": ("mentions", None, True),
    "stub_links": ("links", None, True), "sessions": ("sessions", 500, None), "high_value": ("sessions", 200, False),
}


def punch_list(counts: DataFrame, which: str, ignored: DataFrame | None = None) -> DataFrame:
    """One of PUNCH_LISTS, with its rank. counts: coverage() with canonical, stub; what has nothing to count is left out.

    ignored: (name), lower case.
    """
    by, top, stub = PUNCH_LISTS[which]
    some = {"mentions": F.col("link_mentions") + F.col("text_mentions"), "links": F.col("link_mentions"), "sessions": F.col("sessions")}[by]
    rows = counts.filter(some > 0)
    if stub is not None:
        rows = rows.filter(F.col("stub") == stub)
    if ignored is not None:
        rows = rows.join(ignored.select(F.col("name").alias("_i")), F.lower("canonical") == F.col("_i"), "left_anti")
    return ranked(rows, by, top)


def table_line(*cells: Column) -> Column:
    """A line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def mention_index(mentions: DataFrame) -> DataFrame:
    """(canonical, mentions): each entity's mentions as an array ordered by file and line, for a nested dump.

    mentions: (canonical, path, no, is_link, shown). An entity's list is one cell; ranked lists need none of it.
    """
    one = F.struct("path", "no", F.when(F.col("is_link"), "link").otherwise("text").alias("type"), "shown")
    return mentions.groupBy("canonical").agg(F.array_sort(F.collect_list(one)).alias("mentions"))


def unsupported(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs (a, b) that no session mentions together. seen: (name, session)."""
    from quire.operators.cooccurrence import together

    return pairs.join(together(pairs, seen), ["a", "b"], "left_anti")


#: Names of either side that one cell of a group's pairs has, about, cells of one task, and cells that one task makes sets for, about.
LEFT, RIGHT, CELLS, SPREAD = 1024, 4096, 4, 256
#: Names of a cell that one on the left goes without, up to which each pair is compared with them one by one.
GONE = 16


def _set(rows: DataFrame, name: str) -> Column:
    """The different values of a group, null among them, which collect_set leaves out."""
    null = F.array(F.lit(None).cast(rows.schema[name].dataType))
    return F.concat(F.collect_set(name), F.when(F.bool_or(F.col(name).isNull()), null).otherwise(F.slice(null, 1, 0)))


def unsupported_within(
    left: DataFrame, right: DataFrame, left_seen: DataFrame, right_seen: DataFrame,
    a_name: Callable[[Column], Column] = lambda a: a, b_name: Callable[[Column], Column] = lambda b: b,
) -> DataFrame:
    """The different pairs (a, b) of names of one group that no session mentions together.

    left: (a, group), right: (b, group), left_seen: (a, session), right_seen: (b, session); a_name and b_name: what comes
    out for an a and a b, where these are keys: another for each, and null for null only.

    For pairs that are too many to be written or shuffled: what is shuffled are names and mentions. What sessions hold of one
    group, a's with b's, gives each name on the left the set of those it goes without; so that cost follows the pairs of
    each session. A group's pairs are dealt to cells, some names on the left by a set of those on the right, and a task
    goes through some cells name by name. The pairs follow the product of a group's sides, and so does the time; so what can
    be done for a name or a cell isn't done for a pair: names are made before, and a pair is only compared with the few that
    its name on the left goes without. Where these are many or null is one, they are taken from the set by hash instead.
    Counts the groups when it is called.
    """
    left, right = (cut(rows.select(k, "group").filter("group is not null").distinct()) for rows, k in ((left, "a"), (right, "b")))
    mentioned = lambda seen, k, own: seen.select(F.col(k).alias("_k"), "session").join(own, F.col("_k").eqNullSafe(F.col(k))).select("session", "group", k)
    met = mentioned(left_seen, "a", left).join(mentioned(right_seen, "b", right), ["session", "group"])
    without = met.groupBy(F.col("group").alias("_g"), F.col("a").alias("_a")).agg(_set(right, "b").alias("without"))
    count = lambda own, n, most: own.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias(n))
    sizes = cut(count(left, "deals", LEFT).join(count(right, "sets", RIGHT), "group"))
    cells = sizes.agg(F.sum(F.col("deals").cast("long") * F.col("sets"))).first()[0] or 0
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    set_of = lambda b: F.pmod(F.xxhash64(b), F.col("sets")).cast("int")
    # Names are few bytes, which one task would take; what they make for the cells is the size of it.
    sets = right.join(sizes, "group").withColumn("set", set_of(F.col("b"))).repartition(-(-cells // SPREAD) or 1, "group", "set").groupBy("group", "set", "deals").agg(F.transform(_set(right, "b"), lambda b: b_name(b)).alias("all"))
    own = left.join(without, F.col("group").eqNullSafe(F.col("_g")) & F.col("a").eqNullSafe(F.col("_a")), "left").select("group", "a", "without")
    dealt = own.join(sizes, "group").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int")).withColumn("set", every("sets"))
    gone = F.transform(F.filter("without", lambda b: set_of(b) == F.col("set")), lambda b: b_name(b))
    many = (F.size("gone") > GONE) | F.exists("gone", lambda b: b.isNull())
    # A number of partitions that is stated stays, where one that follows bytes knows nothing of the pairs they make.
    keys, parts = ["group", "deal", "set"], -(-cells // CELLS) or 1
    dealt = dealt.select(*keys, a_name(F.col("a")).alias("a"), gone.alias("gone")).select(*keys, "a", F.when(~many & (F.size("gone") > 0), F.col("gone")).alias("few"), F.when(many, F.col("gone")).alias("many"))
    cell = dealt.repartition(parts, *keys).join(sets.withColumn("deal", every("deals")).select(*keys, "all").repartition(parts, *keys), keys)
    rest = F.when(F.col("many").isNull(), F.col("all")).otherwise(F.array_except("all", "many"))
    out = cell.select("a", "few", F.explode(rest).alias("b")).filter(~F.coalesce(F.array_contains("few", F.col("b")), F.lit(False))).select("a", "b")
    # Only names that stand in several groups on both sides can meet twice.
    several = lambda own, k: not own.groupBy(k).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return out.distinct() if several(left, "a") and several(right, "b") else out


def duplicates(entities: DataFrame, distinct_by_intent: Column | None = None) -> DataFrame:
    """(folder, key, names, n): entities of a folder that share a title key.

    distinct_by_intent: over (folder, title); a group that holds such a title is left out.
    """
    meant = F.lit(False) if distinct_by_intent is None else distinct_by_intent
    out = entities.groupBy("folder", text.title_key(F.col("title")).alias("key")).agg(F.sort_array(F.collect_set("title")).alias("names"), F.count("*").alias("n"), F.max(meant).alias("_meant"))
    return out.filter("n > 1 and not _meant").drop("_meant")


def appearances(mentions: DataFrame, newest_first: bool = False) -> DataFrame:
    """(title, sessions): the sessions in which each candidate appears, in order. mentions: (title, session)."""
    return mentions.groupBy("title").agg(F.sort_array(F.collect_set("session"), asc=not newest_first).alias("sessions"))


def distinct_in_order(rows: DataFrame, column: str, at: str) -> DataFrame:
    """(name, first): the different values of a column, case and blanks aside, with where each is first, by which they sort."""
    return rows.groupBy(text.spaced_key(F.col(column)).alias("name")).agg(F.min(at).alias("first"))


def shared(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(column): what both hold, once each; sessions of two entities, say."""
    return left.select(column).intersect(right.select(column))


def resolution_counts(candidates: DataFrame, names: DataFrame, column: str = "candidate") -> DataFrame:
    """(candidates, existing, missing) over the different candidates."""
    own = resolve(candidates.select(column).distinct(), names, column)
    return own.agg(F.count("*").alias("candidates"), F.count_if(F.col("canonical").isNotNull()).alias("existing"), F.count_if(F.col("canonical").isNull()).alias("missing"))


def screened(candidates: DataFrame, stops: DataFrame) -> DataFrame:
    """Candidates (kind, candidate) without those on the stop list of their kind. stops: (kind, word)."""
    return candidates.join(stops.select(F.col("kind").alias("_k"), F.col("word").alias("_w")), (F.col("kind") == F.col("_k")) & (text.spaced_key(F.col("candidate")) == F.col("_w")), "left_anti")

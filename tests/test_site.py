import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import cooccurrence, entities, links, search
from quire.plans import catalog, catalog_site, pipeline
from quire.plans.cut import carried
from quire.sources import notes, reports, sinks
from quire.sources.watch import differences, watch
from quire.streaming import expiring


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_a_watched_folder_tells_of_deletions_over_restarts(spark, tmp_path):
    root = tmp_path / "notes"
    (root / "a").mkdir(parents=True)
    put = lambda p, t: (root / p).write_text(t)

    def events():
        stream = watch(spark, f"file://{root}", f"file://{tmp_path}/state", ignore=["^drafts/"], files=1)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"), "seq", "path", "op", "content")

    put("a/x.md", "one"), put("y.md", "two"), put("z.txt", "no note")
    first = [(1, "a/x.md", "add", "one"), (1, "y.md", "add", "two")]
    assert events() == first
    (root / "y.md").unlink()
    (root / "drafts").mkdir()
    put("a/x.md", "changed"), put("new.md", "three"), put("drafts/d.md", "no")
    second = [*first, (2, "a/x.md", "change", "changed"), (2, "new.md", "add", "three"), (2, "y.md", "delete", None)]
    assert events() == second and events() == second
    put("y.md", "back")
    assert events() == [*second, (3, "y.md", "add", "back")]
    assert len(os.listdir(tmp_path / "state")) <= 2
    assert differences({"a": [1, 1], "b": [1, 1]}, {"b": [1, 2], "c": [0, 0]}) == [("a", "delete"), ("b", "change"), ("c", "add")]


def test_a_watch_may_begin_with_what_is_there(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "old.md").write_text("old")
    stream = watch(spark, f"file://{root}", f"file://{tmp_path}/state", existing=False).writeStream.format("memory").queryName("watched_later").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    stream.processAllAvailable()
    (root / "new.md").write_text("new")
    stream.processAllAvailable()
    stream.stop()
    assert rows(spark.table("watched_later"), "path", "op") == [("new.md", "add")]


def test_tombstones_go_once_nothing_can_be_late(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", expiring.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()

    def step(n, *events):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "op", "seq", "content"), e[:4]), at=f"2024-01-01T{e[4]}:00Z")) for e in events))
        stream = own.readStream.schema("path string, op string, seq long, content string, at timestamp").json(f"file://{tmp_path}/in")
        q = expiring.latest(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress[-1].stateOperators[0].numRowsTotal

    assert step(1, ("a", "add", 1, "x", "00:00"), ("b", "add", 2, "y", "00:00"), ("b", "change", 3, "z", "00:01")) == 2
    both = step(2, ("a", "delete", 5, None, "00:05"), ("b", "change", 1, "old", "00:05"))
    assert step(3, ("a", "add", 4, "late", "00:06")) == both  # still known to be late
    assert step(4, ("c", "add", 9, "w", "03:00")) == both  # c came and a's tombstone went
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "seq", "path", "op", "content")
    assert got == [(1, "a", "add", "x"), (3, "b", "change", "z"), (5, "a", "delete", None), (9, "c", "add", "w")]


def test_ignore_files_of_the_tree(spark):
    files = [(".gitignore", "# c\n*.log\n/build\ntmp/\n!keep.log\ndoc/**/x.md\n\\!odd\na?[!cd].md  \nlit\\*.md\n"), ("sub/.gitignore", "!*.log\r\n*.tmp\r\n/only.md\r\n"), ("sub/deep/.gitignore", "keep.tmp\n!other.tmp\n")]
    gone = ["a.log", "build/x", "x/tmp/y.md", "doc/x.md", "doc/a/b/x.md", "!odd", "a1b.md", "lit*.md", "sub/only.md", "sub/deep/keep.tmp", "sub/other.tmp", "build/keep.log"]
    kept = ["keep.log", "sub/build/x", "tmp", "a1d.md", "lita.md", "sub/z.log", "sub/q/only.md", "sub/deep/other.tmp", "plain.md", "xa1b.md"]
    paths = spark.createDataFrame([(p,) for p in gone + kept + kept[:1]], "path string")
    found = notes.kept_by_tree(paths, spark.createDataFrame(files, "path string, raw string"))
    assert sorted(r.path for r in found.collect()) == sorted(kept + kept[:1])
    assert notes.kept_by_tree(paths, spark.createDataFrame([], "path string, raw string")).count() == len(gone + kept) + 1


def test_embeds_are_filled_in_to_the_end(spark):
    pages = spark.createDataFrame([("a", "A ![[b]] and ![[c#^k]] then ![[b|shown]] ![[nowhere]] ![[a]] ![[#Here]]"), ("b", "B[![[c#Sec One]]]"), ("c", "# C\n\n## Sec One\n\nbody ![[d]]\n\n## Two\n\nblk ![[b]] ^k"), ("d", "D ![[a]] ![[e]]"), ("e", "E"), ("f", "![[c#^k]]![[c#none]]"), ("g", "none")], "slug string, body string")
    got = dict(rows(links.expanded(pages)))
    circular = lambda p: f"Circular transclusion detected: {p}"
    assert set(got) == {"a", "b", "c", "d", "f"}
    assert got["a"] == f"A B[## Sec One\n\nbody D {circular('a')} E] and {circular('c')} then {circular('b')} ![[nowhere]] {circular('a')} {circular('a')}"
    assert got["f"] == f"blk B[{circular('c')}]{circular('c')}"
    assert links.expanded(pages.limit(0)).count() == 0


def test_names_are_found_in_passes(spark):
    rng = random.Random(5)
    names = ["", "a", "ab", "aba", "Ünder", "no such name", *("".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(200))]
    texts = [None, "", "Ünder", *("".join(rng.choices("abcde ", k=rng.randint(0, 300))) for _ in range(60))]
    want = sorted({(i, n) for i, t in enumerate(texts) for n in names if n and n in (t or "")})
    known, own = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    for size in (32 << 20, 1500):
        found = cooccurrence.contained(known, own, set_bytes=size)
        assert sorted(map(tuple, found.collect())) == want and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert cooccurrence.contained(known.limit(0), own).count() == 0


@pytest.mark.parametrize("block", [4, 1 << 15])
def test_pairs_of_one_session(spark, monkeypatch, block):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    rng = random.Random(6)
    seen = [(f"n{min(int(rng.expovariate(0.3)), 30)}", rng.randint(0, 60)) for _ in range(300)] + [("hub", s) for s in range(60)] * 2
    pairs = sorted({(f"n{rng.randint(0, 32)}", f"n{rng.randint(0, 32)}") for _ in range(150)} | {("hub", f"n{i}") for i in range(33)} | {("hub", "hub")})
    held = {n: {s for m, s in seen if m == n} for n in {n for p in pairs for n in p}}
    want = sorted(p for p in pairs if held[p[0]] & held[p[1]])
    own, mentions = spark.createDataFrame(pairs + pairs[:5], "a string, b string"), spark.createDataFrame(seen, "name string, session int")
    assert rows(cooccurrence.together(own, mentions)) == want
    assert sorted(set(rows(entities.unsupported(own, mentions)))) == sorted(set(pairs) - set(want))


@pytest.mark.parametrize("side", [2, 4096])
def test_pairs_of_groups_without_a_session(spark, monkeypatch, side):
    monkeypatch.setattr(entities, "LEFT", side)
    monkeypatch.setattr(entities, "RIGHT", side)
    rng = random.Random(8)
    some = lambda n: rng.choice([None, *range(n)])
    left, right = [(some(20), some(4)) for _ in range(60)], [(some(25), some(4)) for _ in range(60)]
    left_seen, right_seen = [(some(20), some(30)) for _ in range(80)], [(some(25), some(30)) for _ in range(80)]
    held = {(a, b) for a, s in left_seen for b, t in right_seen if s == t is not None}
    want = {(a, b) for a, g in left for b, h in right if g == h is not None} - held
    made = [spark.createDataFrame(x, s) for x, s in ((left, "a int, group int"), (right, "b int, group int"), (left_seen, "a int, session int"), (right_seen, "b int, session int"))]
    assert sorted(map(repr, map(tuple, entities.unsupported_within(*made).collect()))) == sorted(map(repr, want))
    assert entities.unsupported_within(made[0].limit(0), *made[1:]).count() == 0


@pytest.mark.parametrize("gone", [0, 1, 16])
@pytest.mark.parametrize("side", [3, 4096])
def test_pairs_of_groups_are_named_before_they_are_made(spark, monkeypatch, side, gone):
    """Names of keys, of which some go without none, few or most of their group, null among them."""
    monkeypatch.setattr(entities, "LEFT", side)
    monkeypatch.setattr(entities, "RIGHT", side)
    monkeypatch.setattr(entities, "GONE", gone)
    rng = random.Random(9)
    left, right = [(a, a % 3) for a in range(40)] + [(None, 1), (7, 1), (7, 2)], [(b, b % 3) for b in range(60)] + [(None, 1), (None, 2), (5, 1)]
    left_seen = [(a, a) for a in range(30)] + [(None, 30), (None, 1), (8, None)]
    right_seen = [(b, s) for s in range(31) for b in rng.sample([None, *range(60)], (0, 1, 5, 55)[s % 4])] + [(8, None)]
    held = {(a, b) for a, s in left_seen for b, t in right_seen if s == t is not None}
    name = lambda p, k: None if k is None else f"{p}{k}"
    want = {(name("c", a), name("s", b)) for a, g in left for b, h in right if g == h and (a, b) not in held}
    made = [spark.createDataFrame(x, s) for x, s in ((left, "a int, group int"), (right, "b int, group int"), (left_seen, "a int, session int"), (right_seen, "b int, session int"))]
    got = entities.unsupported_within(*made, *(lambda k, p=p: F.concat(F.lit(p), k.cast("string")) for p in "cs"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_unsupported_pairs_do_no_work_for_each_pair(spark):
    plan = catalog.QUERIES["unsupported_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "array_contains" in above and not any(x in above for x in ("concat", "cast", "array_except"))


def test_unsupported_pairs_are_not_shuffled(spark):
    plan = catalog.QUERIES["unsupported_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert not any(x in above for x in ("Exchange", "Join", "Aggregate", "ExistingRDD"))


def test_sets_for_the_cells_of_pairs_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(entities, "LEFT", 2)
    monkeypatch.setattr(entities, "SPREAD", 10, raising=False)
    left, right = (spark.range(60).select(F.col("id").alias(k), (F.col("id") % 3).cast("int").alias("group")) for k in "ab")
    seen = spark.range(5)
    out = entities.unsupported_within(left, right, seen.select(F.col("id").alias("a"), F.col("id").alias("session")), seen.select(F.col("id").alias("b"), F.col("id").alias("session")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    made = plan[plan.index("collect_set(b") :]
    assert "group" in made and ", 3), REPARTITION_BY_NUM" in made and out.count() == 3 * 20 * 20 - 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_notes_are_parsed_once_and_by_many_tasks(spark):
    """No size of tags is asked where notes are read, and a file of many notes is dealt to tasks first."""
    plan = _plan(catalog.QUERIES["newest_by_tag"](spark, "/root/testdata/sf0.001"))
    assert "Filter (size(" not in plan and "REPARTITION_BY_NUM" in plan
    one = spark.createDataFrame([(f"n{i}.md", "#a") for i in range(40)], "path string, raw string").coalesce(1)
    assert notes.parse_notes(one).rdd.getNumPartitions() == 4


def test_a_graph_of_notes_parses_them_once(spark):
    plan = _plan(catalog.QUERIES["note_graph"](spark, "/root/testdata/sf0.001"))
    assert "FileScan" not in plan and "ExistingRDD" in plan


def test_notes_of_files_are_read_once(spark):
    plan = _plan(catalog_site.QUERIES["notes_of_files"](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan binaryFile") == 1


def test_similar_names_that_share_most_of_their_letters(spark):
    """Names of one frame: pieces of them are in all of them, the rarest pairs of letters aren't."""
    rng = random.Random(7)
    names = sorted({f"house of the {''.join(rng.choices('abcdefghij', k=8))} family" for _ in range(300)})
    asked = [n[:14] + n[15:] for n in names[:40]] + ["house of nobody", names[0]]
    own, known = spark.createDataFrame([(n,) for n in asked], "candidate string"), spark.createDataFrame([(n,) for n in names], "name string")
    import difflib

    score = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {}
    for a in asked:
        best = max(((score(a, n), -len(n), n) for n in names), default=None)
        if best[0] >= 0.9:
            want[a] = (best[2], best[0])
    assert {r.candidate: (r.name, r.ratio) for r in entities.resolve_fuzzy(own, known).collect()} == want
    grams = lambda df, c: df.select(F.col(c), entities._grams(F.col(c)).alias("grams"))
    met = entities._met(grams(own.select(F.col("candidate").alias("key")).distinct(), "key"), grams(known, "name"), 0.97)
    results = sum(score(a, n) >= 0.97 for a in set(asked) for n in names)
    assert results <= met.count() <= 10 * results


def test_what_is_open_is_carried_over_tasks(spark):
    rng = random.Random(8)
    lines = [(f, i, rng.choice([None, None, None, i])) for f in ("a", "b", None, "c") for i in range(rng.choice([1, 400]))] + [("d", i, None) for i in range(300)]
    df = spark.createDataFrame(lines, "f string, no int, v int").repartition(5)
    got = {(r.f, r.no): r.x for r in carried(df, ("f",), ("no",), x=F.col("v")).collect()}
    want, open_ = {}, {}
    for f, i, v in lines:
        open_[f] = v if v is not None else open_.get(f)
        want[f, i] = open_[f]
    assert got == want and carried(df.limit(0), ("f",), ("no",), x=F.col("v")).count() == 0
    alone = carried(df.filter("f = 'd'"), (), ("no",), x=F.when(F.col("no") == 7, 1))
    assert alone.filter("x = 1").count() == 293


def test_one_long_file_of_recaps(spark):
    """Many tasks share it, and no line is lost."""
    n = 30_000
    value = F.when(F.col("no") % 1000 == 5, "2024-02-03").when(F.col("no") % 1000 == 7, F.concat(F.lit("Session "), (F.col("no") / 1000).cast("int").cast("string"), F.lit(": x"))).otherwise("text")
    lines = spark.range(n).select(F.col("id").alias("no")).select("no", value.alias("value"))
    found = reports.recap_lines(lines, (r"^Session (\d+): (.*)$",))
    sizes = rows(found.groupBy("part").agg(F.count("*"), F.min("no"), F.count("date"), F.first("header")))
    assert sizes == sorted([(k + 1, 1000 if k < 29 else n - 29_005, 1000 * k + 5, 1, f"Session {k}: x") for k in range(30)], key=repr)


def test_a_stored_index_is_read_by_prefix(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)] + ["the"]
    pages = [(f"p{i:03d}", rng.choice(words), " ".join(["the", *rng.choices(words, k=30)]), rng.sample(words, 2)) for i in range(300)]
    indexed = search.index(spark.createDataFrame(pages, "slug string, title string, content string, tags array<string>"))
    where = f"file://{tmp_path}/index"
    search.store_index(indexed, where, parts=4, postings=50)
    blocks, tokens = spark.read.parquet(where).count(), indexed.select("token", "field").distinct().count()
    assert tokens < blocks < 2 * tokens and spark.read.parquet(where).filter("size(keys) > 150").count() == 0
    stored = search.stored_index(spark, where)
    assert rows(stored, "slug", "field", "token") == rows(indexed.filter("token <> ''").distinct(), "slug", "field", "token")
    for asked in ("the", "a th", "abc", "zzz", ""):
        assert rows(search.query(stored, asked)) == rows(search.query(indexed, asked))
    assert "StringStartsWith(token,ab)" in search.query(stored, "ab")._jdf.queryExecution().executedPlan().toString()


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    page = lambda *r: spark.createDataFrame(list(r), "slug string, ext string, content string")
    assert sinks.current(spark, root) is None
    assert sinks.publish(page(("a", ".html", "one"), ("b/c", ".html", "two"), ("e", None, None)), root) == 1
    content = lambda: {r.path: open(r.file.removeprefix("file://")).read() for r in sinks.published(spark, root).collect()}
    assert content() == {"a.html": "one", "b/c.html": "two", "e": ""}
    broken = page(("a", ".html", "new")).unionAll(page(("x", ".html", "y")).withColumn("content", F.raise_error(F.lit("no emitter"))))
    with pytest.raises(Exception, match="no emitter"):
        sinks.publish(broken, root)
    with pytest.raises(ValueError, match="a.html"):
        sinks.publish(page(("a", ".html", "1"), ("a", ".html", "2")), root)
    assert sinks.current(spark, root) == 1 and content()["a.html"] == "one"
    assert sinks.publish(page(("a", ".html", "one"), ("d", ".html", "two")), root) == 2
    assert content() == {"a.html": "one", "d.html": "two"}
    assert rows(sinks.generation_changes(sinks.published(spark, root, 1), sinks.published(spark, root))) == [("b/c.html", "delete"), ("d.html", "add"), ("e", "delete")]


def test_code_is_left_alone(spark):
    body = "a ==m== `==c==` ``x ` ==d== ``\n~~~py\n==f== `\n```\n~~~\n==n== `open\n\nend` ->\n````\n```\n==in==\n````\n-> ```last\n"
    df = spark.createDataFrame([(body,), ("",), ("``",), (None,)], "b string")
    got = [r[0] for r in df.select(text.outside_code(F.col("b"), lambda c: text.arrows(text.mark_highlights(c)))).collect()]
    assert got[0] == body.replace("a ==m==", "a <mark>m</mark>").replace("==n==", "<mark>n</mark>").replace("->", "→") and got[1:] == ["", "``", None]
    assert re.findall(r"==\w+==", df.select(text.without_code("b")).first()[0]) == ["==m==", "==n=="]


def test_listings_are_made_as_they_fill(spark):
    pages = spark.createDataFrame([("x", f"x/{i:04d}") for i in range(250)] + [("y", "y/1")], "folder string, slug string")
    got = {r.slug: r.content.split("\n") for r in pipeline.listings(pages).collect()}
    assert {k: len(v) for k, v in got.items()} == {"x/index-1": 100, "x/index-2": 100, "x/index-3": 50, "y/index-1": 1}
    assert sorted(sum(got.values(), [])) == sorted(r.slug for r in pages.collect())


def test_the_command_follows_a_folder(spark, tmp_path):
    from quire.__main__ import main

    (tmp_path / "notes/a").mkdir(parents=True)
    put = lambda p, t: (tmp_path / "notes" / p).write_text(t)
    base = f"file://{tmp_path}"
    args = ["watch", "-d", f"{base}/notes", "-o", f"{base}/site", "--state", f"{base}/state", "--ignore", "private/*", "--once"]
    files = lambda: {r.path: open(r.file.removeprefix("file://")).read() for r in sinks.published(spark, f"{base}/site").collect()}
    put("a/One.md", "---\ntitle: One\naliases: [Uno]\ndate: 2024-01-02\n---\ntext [[Two]]"), put("Two.md", "two"), put("Draft.md", "---\ndraft: true\n---\nno")
    assert main(args, spark) == {"generation": 1}
    first = files()
    assert {"a/One.md", "a/One.json", "Two.md", "Two.json", "Uno.html", "feed.xml", "CNAME", "404.html"} == set(first) and first["a/One.md"] == "text [[Two]]"
    assert main(args, spark) == {"generation": 1}  # nothing new
    (tmp_path / "notes/a/One.md").unlink()
    put("Two.md", "two anew"), put("Draft.md", "out now")
    assert main(args, spark) == {"generation": 2}
    assert {"Two.md": "two anew", "Draft.md": "out now"}.items() <= files().items() and set(files()) == {"Two.md", "Two.json", "Draft.md", "Draft.json", "feed.xml", "CNAME", "404.html"}


def test_builds_leave_out_what_ignore_files_say(spark, tmp_path):
    from quire.__main__ import main

    (tmp_path / "notes/tmp").mkdir(parents=True)
    for path, raw in ((".gitignore", "tmp/\n*.draft.md\n"), ("tmp/a.md", "a"), ("b.draft.md", "b"), ("c.md", "c")):
        (tmp_path / "notes" / path).write_text(raw)
    assert main(["build", "-d", f"file://{tmp_path}/notes", "--dry-run"], spark) == {"parsed": 1, "dropped": 0}


def test_uploads_go_through_the_client(spark):
    plan = spark.createDataFrame([("a", "text", None, "create"), ("b", "more", "id7", "update")], "name string, content string, remote string, op string")
    assert rows(sinks.upload(plan, lambda op, remote, name, content: remote or f"new-{name}-{len(content)}")) == [("a", "create", "new-a-4"), ("b", "update", "id7")]

    def broken(op, remote, name, content):
        raise OSError("no connection")

    with pytest.raises(Exception, match="no connection"):
        sinks.upload(plan, broken).collect()
    assert sinks.upload(plan.limit(0), broken).count() == 0


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    build = pipeline.Build(emitters={"pages": lambda p: p.select("slug", F.lit(".md").alias("ext"), F.col("body").alias("content"))})
    notes_ = spark.createDataFrame([("a.md", "x"), ("b.md", "---\ndraft: true\n---\ny")], "path string, raw string")
    out = build.run(notes_, f"file://{tmp_path}/site")
    assert (out["parsed"], out["dropped"], out["generation"]) == (2, 1, 1) and out["filter_seconds"] > 0 < out["emit_seconds"]
    assert build.run(notes_.limit(0), f"file://{tmp_path}/none")["parsed"] == 0

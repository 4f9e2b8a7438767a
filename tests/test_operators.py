import json

import pytest
from pyspark.sql import functions as F

from quire.functions.fuzzy import ratio
from quire.operators import entities, graph, hierarchy, links, markdown, search, windows
from quire.sources import notes, reports, sinks
from quire.streaming import changes


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_front_matter_is_read_leniently(spark, tmp_path):
    (tmp_path / "npcs").mkdir()
    (tmp_path / "npcs/Bob.md").write_text('---\ntitle: "Bob: Red"\naliases:\n  - [[Red [[Bob]]]]\n  - Bobby\ntags: [a/b, "c d"]\ndraft: true\ndate: 2024-02-30\n---\n# Other\nText #x/y [[T|t]]')
    (tmp_path / "plain.md").write_text("# Heading\nno matter")
    (tmp_path / "blank.md").write_text("\n")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/me.md").write_text("x")
    (tmp_path / "no.txt").write_text("x")
    read = notes.read_notes(spark, f"file://{tmp_path}", ignore=("skip",))
    got = {r.path: r for r in notes.parse_notes(read, F.lit("2020-01-01").cast("timestamp")).collect()}
    bob = got["npcs/Bob.md"]
    assert set(got) == {"npcs/Bob.md", "plain.md", "blank.md"}
    assert (bob.title, bob.aliases, bob.tags, bob.draft, bob.folder, bob.slug, bob.links) == ("Bob: Red", ["[[Red [[Bob]]]]", "Bobby"], ["a/b", "c-d", "x/y"], True, "npcs", "npcs/Bob", ["T"])
    assert str(bob.created) == "2020-01-01 00:00:00"
    assert (got["plain.md"].title, got["plain.md"].folder, got["blank.md"].title) == ("Heading", "", "blank")


def test_small_sources(spark, tmp_path):
    (tmp_path / "ignore.txt").write_text("# no\n\nBob\n ANN \n")
    assert rows(reports.read_ignore_list(spark, f"file://{tmp_path}/ignore.txt")) == [("ann",), ("bob",)]
    (tmp_path / "lists.json").write_text(json.dumps({"a": ["X", "y"], "b": []}, indent=1))
    assert rows(reports.read_word_lists(spark, f"file://{tmp_path}/lists.json")) == [("a", "x"), ("a", "y")]
    (tmp_path / "bad.json").write_text("{")
    assert rows(reports.read_word_lists(spark, f"file://{tmp_path}/bad.json")) == []
    (tmp_path / "log.jsonl").write_text('{"model": "m", "iac": {"rc": 0}}\nbroken\n{"model": "n"}\n')
    assert rows(reports.read_log(spark, f"file://{tmp_path}/log.jsonl", "model string, iac struct<rc:int>"), "model", "iac.rc") == [("m", 0), ("n", None)]


def test_recaps_are_split(spark):
    text = ["intro", "2024-01-01", "Session 1: A", "x", "2024-01-08", "note", "Session 2b: B", "y", "Sessions 3a and 4: C", "z", "2024-02-01", "Session 16: D", "w"]
    lines = spark.createDataFrame(list(enumerate(text)), "no int, value string")
    headers = (r"^Sessions (\d+[a-z]?) and (\d+): (.+)$", r"^Session (\d+)([a-z]?): (.+)$")
    got = reports.split_recaps(lines, headers)
    assert rows(got, "part", "date", "header") == [(1, "2024-01-01", "Session 1: A"), (2, "2024-01-08", "Session 2b: B"), (3, None, "Sessions 3a and 4: C"), (4, "2024-02-01", "Session 16: D")]
    some = {r.part: r for r in reports.split_recaps(lines, headers, up_to=15).collect()}
    assert len(some) == 3 and some[3].numbers == [3, 4] and some[3].text.endswith("Session 16: D\nw")


def test_no_recap_is_lost(spark):
    lines = spark.createDataFrame([(i, f"Session {i // 2}: x" if i % 2 else "2024-01-01") for i in range(40)], "no int, value string")
    assert reports.split_recaps(lines, (r"^Session (\d+): (.+)$",)).count() == 20


def test_chat(spark):
    def client(p):
        if p == "b":
            raise ValueError
        return p.upper()

    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert rows(reports.chat(df, client, on_error="accept")) == [("a", "A"), ("b", "YES")]


def test_fuzzy_finds_what_a_cross_join_finds(spark):
    import difflib
    import random

    rng = random.Random(1)
    names = sorted({"".join(rng.choices("abcdefgh ", k=rng.randint(1, 25))).strip() or "a" for _ in range(80)})
    typos = []
    for n in names:
        i = rng.randrange(len(n))
        typos.append(n[:i] + rng.choice(["", "x", n[i] + "y"]) + n[i + 1 :])
    cands = spark.createDataFrame([(t,) for t in typos], "candidate string")
    got = dict(rows(entities.resolve_fuzzy(cands, spark.createDataFrame([(n,) for n in names], "name string")), "candidate", "ratio"))
    keys = {t: " ".join(t.lower().split()) for t in typos}
    best = {t: max(difflib.SequenceMatcher(None, keys[t], n).ratio() for n in names) for t in typos if keys[t]}
    assert got == {t: b for t, b in best.items() if b >= 0.9}
    pair = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    assert [r[0] for r in pair.select(ratio("a", "b")).collect()] == [pytest.approx(2 / 3), None]


def test_every_supplier_is_resolved(spark):
    from quire.plans import catalog

    sf = "/root/testdata/sf0.001"
    found = dict(rows(catalog.QUERIES["fuzzy_entities"](spark, sf), "candidate", "name"))
    assert found == {r.s_name.replace("pplier", "plier"): r.s_name.lower() for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}


def test_numbered_names_meet_only_near_ones(spark, monkeypatch):
    met, plain = [], entities._rarest
    monkeypatch.setattr(entities, "_rarest", lambda r, *a: (met.append(r.count()), plain(r, *a))[1])
    names = spark.range(200).select(F.format_string("supplier#%09d", "id").alias("name"))
    found = entities.resolve_fuzzy(names.select(F.regexp_replace("name", "pplier", "plier").alias("candidate")), names)
    assert rows(found, "candidate", "name") == [(f"suplier#{i:09d}", f"supplier#{i:09d}") for i in range(200)] and not any(met)


@pytest.mark.parametrize("least", [0.9, 0.75])
def test_similar_names_of_all_lengths(spark, least):
    import difflib
    import random

    rng = random.Random(11)
    names = sorted({"".join(rng.choices("ab#12", k=rng.randint(1, 34))) for _ in range(150)} | {"a", "ab", "é" * 5})
    asked = set()
    for n in names:
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(n) + 1)
            n = n[:i] + rng.choice(["", "a", "2"]) + n[i + rng.randint(0, 2) :]
        asked.add(n)
    got = dict(rows(entities.resolve_fuzzy(spark.createDataFrame([(n,) for n in asked], "candidate string"), spark.createDataFrame([(n,) for n in names], "name string"), least), "candidate", "ratio"))
    best = {a: max(difflib.SequenceMatcher(None, a, n).ratio() for n in names) for a in asked if a}
    assert got == {a: b for a, b in best.items() if b >= least}


def test_suppliers_of_one_name_are_rows_of_their_own(spark, tmp_path):
    from quire.plans import catalog

    spark.createDataFrame([(k, f"Supplier#{k // 2:09d}") for k in range(6)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert catalog.QUERIES["fuzzy_entities"](spark, str(tmp_path)).count() == 6


def test_resolution_and_screens(spark):
    ent = spark.createDataFrame([("npcs", "Bob", "npcs/Bob", ["Red"]), ("items", "Red", "items/Red", None)], "kind string, canonical string, path string, aliases array<string>")
    cand = spark.createDataFrame([("RED",), ("(Bob)",), ("x",)], "candidate string")
    assert rows(entities.resolve(cand, entities.name_table(ent)).fillna("-")) == [("(Bob)", "Bob", "npcs"), ("RED", "Bob", "npcs"), ("x", "-", "-")]
    assert dict(rows(entities.name_table(ent, "last"), "name", "canonical"))["red"] == "Red"


def test_mentions(spark):
    lines = spark.createDataFrame([("s/1", 0, "Bob_ met bob. [[Bob|him]] and Old Bob!"), ("s/2", 0, "bobby")], "path string, no int, line string")
    names = spark.createDataFrame([("bob", "Bob"), ("old bob", "Bob")], "alias string, canonical string")
    assert rows(entities.text_mentions(lines, names), "path", "alias", "n") == [("s/1", "bob", 2), ("s/1", "old bob", 1)]
    targets = spark.createDataFrame([("bob", "Zed"), ("bob", "Bob")], "target string, canonical string")
    assert rows(entities.link_mentions(lines, targets)) == [("s/1", 0, "Bob", "bob")]


def test_graph_walks(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)] + [("9", "0"), ("x", "y")], "a string, b string")
    start = spark.createDataFrame([("0",)], "node string")
    assert rows(graph.neighbourhood(e, start, 1)) == [("0", 0), ("1", 1), ("9", 1)]
    assert len(rows(graph.neighbourhood(e, start, -1))) == 10 and max(d for _, d in rows(graph.neighbourhood(e, start, -1))) == 5


def test_transclusion_has_no_depth_of_its_own(spark):
    embeds = spark.createDataFrame([(str(i), str((i + 1) % 11)) for i in range(11)] + [("x", "0")], "page string, target string")
    pages = spark.createDataFrame([(str(i),) for i in range(11)], "path string")
    want = {(str(i), str((i + k) % 11), k) for i in range(11) for k in range(1, 11)} | {("x", str(k), k + 1) for k in range(11)}
    assert set(rows(links.transcluded(embeds, pages), "page", "path", "depth")) == want
    assert max(r[0] for r in rows(links.transcluded(embeds, pages, 3), "depth")) == 3


def test_links_and_cycles(spark):
    embeds = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "page string, target string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert rows(links.transcluded(embeds, pages), "page", "path") == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")]


def test_hierarchy_and_markdown(spark):
    listing = spark.createDataFrame([("f", "n10", False), ("f", "n2", False), ("f", "z", True), ("f", "tags", True)], "folder string, child string, is_folder boolean")
    assert [x for _, x in sorted((r.position, r.child) for r in hierarchy.explorer(listing).collect())] == ["z", "n2", "n10"]
    raw = spark.createDataFrame([("## A b!\n```\n# no\n```\n### C\n#### D",), ("# one",)], "raw string")
    toc = [[tuple(h) for h in r[0]] for r in raw.select(markdown.table_of_contents(F.col("raw"))).collect()]
    assert toc == [[(0, "A b!", "a-b"), (1, "C", "c")], []]
    default = spark.createDataFrame([("a", "x"), ("b", "y")], "slug string, text string")
    assert rows(hierarchy.with_overrides(default, default.filter("slug = 'a'").withColumn("text", F.lit("own")), "text")) == [("a", "own"), ("b", "y")]


def test_search_prefers_titles(spark):
    pages = spark.createDataFrame([("p", "x", "Goblin camp", ["npc"]), ("q", "Goblins", "camp", ["npc/red"]), ("r", "z", "none", ["gob"])], "slug string, title string, content string, tags array<string>")
    found = search.query(search.index(pages), "gob")
    assert [(r.slug, r.field_rank) for r in found.collect()] == [("q", 1), ("p", 2), ("r", 3)]
    assert rows(search.tag_query(pages, "npc/", "camp")) == [("q",)] and search.query(search.index(pages), "").count() == 0


def test_windows(spark):
    df = spark.createDataFrame([("t", ["a", "hit", "c", "d"])], "id string, parts array<string>")
    assert rows(windows.hit_windows(df, "parts", "hit")) == [("t", 1, "a\n\nhit\n\nc")]


def test_sinks(spark):
    have = spark.createDataFrame([("a",)], "k string")
    want = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert rows(sinks.missing(want, have, "k")) == [("b",)]
    assert rows(sinks.rewritten(want, "k", F.regexp_replace("k", "a", "c"))) == [("c",)]


def test_changes_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, batch in enumerate([[("a", "add", 1, "x"), ("a", "change", 3, "z"), ("a", "change", 2, "y")], [("b", "add", 4, "b"), ("a", "delete", 5, None)]]):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("path", "op", "seq", "content"), e))) for e in batch))
    out = []
    stream = changes.run(changes.read_changes(spark, f"file://{src}", 1), f"file://{tmp_path}/cp", lambda df, n: out.append(rows(df, "path", "op", "seq")))
    stream.awaitTermination(120)
    assert sorted(x for b in out for x in b) == [("a", "change", 3), ("a", "delete", 5), ("b", "add", 4)]
    state = spark.createDataFrame([("a", 3, "z")], "path string, seq long, content string")
    late = spark.createDataFrame([("a", "change", 2, "old"), ("b", "add", 9, "n")], changes.SCHEMA)
    assert rows(changes.applied(state, late)) == [("a", 3, "z"), ("b", 9, "n")]


def test_names_of_many_words_are_found(spark):
    lines = spark.createDataFrame([("p", 1, "So the very old and wise King of Kings spoke, the very old man. O'Brien")], "path string, no int, line string")
    names = spark.createDataFrame([("the very old and wise king of kings", "K"), ("the very old", "V"), ("o'brien", "O"), ("", "E")], "alias string, canonical string")
    found = entities.text_mentions(lines, names)
    assert rows(found, "canonical", "n") == [("K", 1), ("O", 1), ("V", 2)]


@pytest.mark.parametrize("bound", [0, 1000])
def test_mentions_with_many_first_words(spark, monkeypatch, bound):
    monkeypatch.setattr(entities, "FIRST_WORDS", bound)
    lines = spark.createDataFrame([("p", i, f"word{i} of {i % 3}") for i in range(20)], "path string, no int, line string")
    names = spark.createDataFrame([(f"word{i} of", str(i)) for i in range(0, 20, 2)] + [("of 1", "x")], "alias string, canonical string")
    assert entities.text_mentions(lines, names).count() == 10 + 7


def test_embeds_are_followed_to_the_end(spark):
    chain = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(9)] + [("p9", "p0")], "page string, target string")
    pages = spark.createDataFrame([(f"p{i}",) for i in range(10)], "path string")
    assert links.transcluded(chain, pages).filter("page = 'p0'").count() == 9


def test_deep_nesting_is_repaired():
    from quire.functions.rewrite import unnest

    text = "x"
    for i in range(30):
        text = f"[[a{i} {text}|b]]" if i % 2 else f"[[{text}]]"
    assert unnest(text).count("[[") == 1


def test_files_are_written_and_a_site_is_built(spark, tmp_path):
    from quire.__main__ import main

    (tmp_path / "notes/a").mkdir(parents=True)
    (tmp_path / "notes/a/One.md").write_text("\n---\ntitle: One\naliases: [Uno]\ndate: 2024-01-02\n---\ntext [[Two]]\n")
    (tmp_path / "notes/Two.md").write_text("+++\ntitle = \"Two\"\n+++\nmore")
    (tmp_path / "notes/Draft.md").write_text("---\ndraft: true\n---\nno")
    base = f"file://{tmp_path}"
    assert main(["build", "-d", f"{base}/notes", "-o", f"{base}/site", "--dry-run"], spark) == {"parsed": 3, "dropped": 1}
    out = main(["build", "-d", f"{base}/notes", "-o", f"{base}/site"], spark)
    assert out["written"]["pages"] == 2 and out["written"]["redirects"] == 1
    assert (tmp_path / "site/pages/a/One.md").read_text() == "text [[Two]]" and (tmp_path / "site/redirects/Uno.html").exists() and (tmp_path / "site/site/CNAME").read_text() == "example.org"
    files = spark.createDataFrame([("a b.png", b"\x00\xff"), ("x.md", b"-")], "path string, content binary")
    assert [tuple(r) for r in sinks.copy_files(files, f"{base}/assets").collect()] == [("a-b.png", 2)] and (tmp_path / "assets/a-b.png").read_bytes() == b"\x00\xff"


def test_exports_are_written_in_order(spark, tmp_path):
    notes = spark.createDataFrame([("a", f"a/{i:03}", f"text {i}") for i in range(50)] + [("b", "b/1", "[[x|y]]")], "folder string, path string, body string")
    flat = sinks.flattened(notes)
    sinks.write_exports(sinks.merge_smallest(flat, most=1), f"file://{tmp_path}/out", parts=7)
    (whole,) = (tmp_path / "out").glob("output=*")
    assert "".join(p.read_text() for p in sorted(whole.glob("part-*"))).split("\n\n") == ["y", *(f"text {i}" for i in range(50)), ""]


def test_numbers_run_over_partitions(spark):
    from pyspark.sql import functions as F

    from quire.plans.cut import numbered

    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(8)
    got = numbered(df, "k", F.col("id").desc()).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda i: (i % 7, -i))
    sums = {r.id: r.at for r in numbered(df, "id", name="at", size=F.col("k")).collect()}
    assert all(sums[i] == sum(j % 7 for j in range(i)) for i in range(0, 1000, 97))


def test_streams_keep_the_latest_change_of_each_path(spark, tmp_path):
    import json

    folder = tmp_path / "events"
    folder.mkdir()
    batches = [[("a", "add", 1, "one"), ("b", "add", 2, "x")], [("a", "change", 5, "five"), ("a", "change", 4, "late")], [("a", "change", 3, "old"), ("b", "delete", 6, None)], [("b", "add", 6, "again")]]
    found = []
    stream = changes.latest(changes.read_changes(spark, f"file://{folder}", 1))
    for i, rows_ in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("path", "op", "seq", "content"), r))) for r in rows_))
        q = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").foreachBatch(lambda df, n: found.append(sorted(map(tuple, df.collect())))).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [x for x in found if x] == [[("a", "add", 1, "one"), ("b", "add", 2, "x")], [("a", "change", 5, "five")], [("b", "delete", 6, None)]]


def test_source_changes_ask_for_a_rebuild(spark):
    events = spark.createDataFrame([("a.md", "change"), ("x/b.png", "delete")], "path string, op string")
    assert not changes.needs_rebuild(events) and changes.needs_rebuild(events.union(spark.createDataFrame([("quartz.ts", "change")], events.schema)))
    assert rows(sinks.removed_files(events)) == [("x/b.png",)]


def test_todos_go_to_the_end(spark):
    notes = spark.createDataFrame([("a", "text"), ("b", "text\n\n## TODO\n- x"), ("c", "no")], "path string, body string")
    todos = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "three"), ("c", None)], "path string, todo string")
    assert rows(sinks.with_todos(notes, todos)) == [("a", "text\n\n## TODOs\n- one\n- two\n"), ("b", "text\n\n## TODO\n- x\n- three\n")]


def test_git_dates_come_after_the_note_s_own(spark):
    from quire.sources import notes

    own = spark.createDataFrame([("a", "2024-01-01", "2020-01-01"), ("b", None, "2020-01-01"), ("c", None, "2020-01-01")], "path string, front string, file string").selectExpr("path", "timestamp(front) AS front", "timestamp(file) AS file")
    git = notes.git_dates(spark.createDataFrame([("2023-05-05T10:00:00Z\n\nb\na\n",), ("2022-05-05T10:00:00Z\n\nb\n",)], "value string"))
    assert [str(r.modified)[:10] for r in notes.dated(own, git).orderBy("path").collect()] == ["2024-01-01", "2023-05-05", "2020-01-01"]
    assert [str(r.modified)[:10] for r in notes.dated(own).orderBy("path").collect()] == ["2024-01-01", "2020-01-01", "2020-01-01"]

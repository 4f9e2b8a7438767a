"""Functions over single values, in tables of input and result."""

import pytest
from pyspark.sql import functions as F

from quire.functions import paths, text
from quire.functions.rewrite import insert_links, repair_nested, unnest


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    paths.slugify_path: {"content/_index.md": "content/index", "cool/what about r&d?.md": "cool/what-about-r-and-d", "a/b.png": "a/b.png", "/note with space/": "note-with-space", "100% #1.html": "100-percent-1"},
    paths.simplify_slug: {"index": "/", "abc/index": "abc/", "a/b": "a/b", "/a/b": "a/b", "": "/"},
    paths.root_of: {"index": ".", "a/b": "..", "a/b/c": "../..", "": "."},
    paths.internal_link: {"index": "./", "index#abc": "./#abc", "a/b/c": "./a/b/c", "./index#abc": "./#abc", "content/with spaces#and Anchor!": "./content/with-spaces#and-anchor", "x.pdf#page=2": "./x.pdf#page=2", "a/b/index.md": "./a/b/"},
    paths.file_extension: {"a/b.md": ".md", "a.b/c": None, "x": None},
    paths.prefixes: {"a/b/c": ["a", "a/b", "a/b/c"], "a": ["a"]},
    paths.folders: {"a/b/c": ["a", "a/b"], "a": []},
    paths.slug_tag: {"My Tag/Sub & x": "My-Tag/Sub--and--x"},
    paths.is_internal: {"http://x": False, "mailto:a": False, "#h": False, "a/b": True},
    paths.is_full_slug: {"a/b": True, "./a": False, "a b": False, "a#b": False, "/a": False},
    paths.is_simple_slug: {"a": True, "a/index": False, "/": True, "./a": False},
    paths.is_file_path: {"a.md": True, "a": False, "../a.md": False},
    text.title_key: {"The Inn (old)": "the inn", "A--B's": "a b s"},
    text.name_key: {'  "Bob"   [the] *Red*': "bob the red"},
    text.node_name: {"Inn of the Sun": "Inn_of_the_Sun", "--": "X", " a ": "a"},
    text.safe_title: {"A: b / c": "A_b_c", "x  y": "x_y"},
    text.file_name: {"a/b: c": "a - b - c"},
    text.unlink: {"[[A]] x [[B|C]]": "A x C", "[[A|B": "[[A|B"},
    text.link_targets: {"[[A]] [[b|c]] [[d#e]]": ["A", "b", "d#e"], "none": []},
    text.inline_tags: {"#a x #b/c y#no #12 #a": ["a", "b/c"]},
    text.strip_comments: {"a %%x\ny%% b": "a  b"},
    text.arrows: {"a -> b => c <- d <-> e": "a → b ⇒ c ← d ↔ e"},
    text.paragraphs: {"a\n\n \nb\nc\n": ["a", "b\nc"], "": []},
    text.is_stub: {"x\n- TODO y": True, "TODO": False},
    text.unbalanced: {"[[a]]": False, "[[a": True, "": False},
    text.shorten_urls: {"see https://www.a.org/b now": "see a.org/b now"},
    text.escape_html: {"<a & 'b'>": "&lt;a &amp; &#039;b&#039;&gt;"},
    text.unescape_html: {"&lt;a &amp; &#039;b&#039;&gt;": "<a & 'b'>"},
    text.capitalize: {"abc": "Abc", "": ""},
    text.chunks: {"": [], "a" * 2501: ["a" * 2500, "a"]},
    text.query_terms: {"a bb c": ["a bb c", "a bb", "bb", "a", "c"]},
    text.proper_names: {"The Old Inn met Bob. `x` ```Not Me```": ["The Old Inn", "Bob"]},
    text.media_kind: {"a.PNG": "image", "b.mp4": "video", "c.flac": "audio", "d.pdf": "document", "e": "page"},
    text.edge_label: {" [via gate if stated] [method: walk]": "via gate; walk", " [feature: x]": "x", "": ""},
    text.block_id: {"a line ^id-1": "id-1", "none": None},
    text.description: {"One. Two.": "One. Two.", "x" * 320: "x" * 300 + "...", ("a" * 100 + ". ") * 3: "a" * 100 + "."},
    text.group_line: {"- NPC: a; b": ("NPC", ["a", "b"]), "none": None},
    text.full_links: {"![[a#b|c]] [[d]]": [(True, "a", "#b", "c"), (False, "d", "", "")]},
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_function(spark, f):
    got = values(spark, CASES[f], f)
    plain = lambda v: tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v
    assert [plain(g) for g in got] == [plain(w) for w in CASES[f].values()]


def test_null_stays_null(spark):
    for f in (paths.slugify_path, text.name_key, text.unlink, text.link_targets, text.escape_html, text.is_stub):
        assert values(spark, [None], f) == [None]


def test_paths_of_two(spark):
    rows = spark.createDataFrame([("a/b/c", "d"), ("index", "a/index"), ("a/b", "a/c")], "a string, b string")
    assert [r[0] for r in rows.select(paths.resolve_relative(F.col("a"), F.col("b"))).collect()] == ["../../d", "./a/", "../a/c"]
    assert [r[0] for r in rows.select(paths.join_segments(F.lit("/x/"), F.col("a"), F.lit("y/"))).limit(1).collect()] == ["/x/a/b/c/y/"]


def test_packed(spark):
    rows = spark.createDataFrame([(["a" * 5, "b" * 5, "c" * 30, "d"],), ([],)], "p array<string>")
    got = [r[0] for r in rows.select(text.packed(F.col("p"), 12)).collect()]
    assert got == [["aaaaa\n\nbbbbb", "c" * 30, "d"], []]


def test_links_are_never_put_into_links(spark):
    names = {"Bob": "npcs/Bob", "Bob the Red": "Bob the Red", "Red": "Red"}
    one = values(spark, ["Bob the Red met Bob, [[Red|Bob]], Bobby and Red.", None], insert_links(names))
    assert one == ["[[Bob the Red]] met [[npcs/Bob|Bob]], [[Red|Bob]], Bobby and [[Red]].", None]
    assert values(spark, ["Red Red"], insert_links(names, first_only=True)) == ["[[Red]] Red"]
    assert values(spark, ["Red"], insert_links({})) == ["Red"]


def test_nested_links_are_repaired(spark):
    assert values(spark, ["[[a/[[b|B]] c]] x", "[[a]]", None], repair_nested) == ["[[a/B c]] x", "[[a]]", None]
    assert unnest("[[a [[b [[c]] d]] e]]") == "[[a b c d e]]"

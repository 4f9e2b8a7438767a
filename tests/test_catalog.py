"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quire.plans import catalog, catalog_more, catalog_site
from tests.conftest import DATA


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


ORACLES = catalog.ORACLES | catalog_more.ORACLES | catalog_site.ORACLES


@pytest.mark.parametrize("name", sorted(catalog.QUERIES | catalog_more.QUERIES | catalog_site.QUERIES))
def test_query(spark, db, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    got = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in ORACLES:
        found = db.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(names)]
        assert got == sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    else:
        assert got


@pytest.mark.parametrize("name", ["name_mentions", "mention_ranking"])
def test_mentions_of_odd_letters(spark, tmp_path, name):
    """Capitals of several letters, a final sigma, white space of one engine alone, brackets, rows without a number."""
    items = ["erßie straße", "ΟΔΟΣ ᾳ ŉ ﬁ", "İx one [[two]] b", "a\x0bb c", "[[ z", "Σ", "stone"]
    turns = [(k, 0, t) for k, t in enumerate([*items, *(t.lower() for t in items), "ERSTE erßie erßie ersu [[one]] ıx", None, ""])] + [(None, 1, "erßie stone"), (90, None, "stone Σ")]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    for t in ("benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(df.columns)
    want = db.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_upper_case_by_letters(spark):
    """All letters whose capital is written with several."""
    from pyspark.sql import functions as F

    from quire.functions import text

    letters = [(c,) for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1] + [("aßé",), ("",), (None,)]
    db = duckdb.connect()
    got = spark.createDataFrame(letters, "c string").select("c", text.upper_letters(F.col("c")).alias("u")).collect()
    assert {r.c: r.u for r in got} == {c: db.execute("SELECT upper(?::VARCHAR)", [c]).fetchone()[0] for c, in letters}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    for p in Path(catalog.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert "quire.llm" not in p.read_text(), p

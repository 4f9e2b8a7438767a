import gc
import glob
import hashlib
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash

import corpus_pipeline
from quire.llm import staging
from quire.llm.byte_bpe import read_ranks
from quire.llm.components import forest
from tests.llm.brute import az, benchmark_hits, lines

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = az(text).split()
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()


def test_every_stage_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (toxic, by_score), (_, by_line), (_, by_copy), (_, by_benchmark), (_, encoded) = corpus_pipeline.STAGES
    clean = by_score(spark, docs, SF)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in clean.collect()}
    wrong = [k for k, t in truth.items() if (k in left) == bool(t)]
    assert len(wrong) <= 0.05 * len(truth) and clean.columns == docs.columns

    rows = docs.collect()
    thinned = by_line(spark, docs, SF).collect()
    want = {(k, s) for k, _, _, s in lines([r.doc_id for r in rows], [r.text for r in rows])}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in thinned} == want

    sets = [_shingles(r.text) for r in rows]
    share = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    ids = np.array([r.doc_id for r in rows])
    close = np.array([(i, j) for i in range(len(sets)) for j in range(i) if share(sets[i], sets[j]) >= 0.8], np.int64).reshape(-1, 2)
    moved, _ = forest(ids[close[:, 0]], ids[close[:, 1]])
    kept = {r.doc_id for r in by_copy(spark, docs, SF).collect()}
    assert kept == set(ids.tolist()) - set(moved.tolist())  # the smallest of each group of 0.8 and more stays, and all others

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {h[0] for h in benchmark_hits([r.doc_id for r in rows], [r.text for r in rows], bench) if not h[-1]}
    assert {r.doc_id for r in by_benchmark(spark, docs, SF).collect()} == want

    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in encoded(spark, docs, SF).collect()}
    assert got == {r.doc_id: (len(reference.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in rows}


def test_run_is_its_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in docs.collect()}


def test_stages_take_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, "w " * 50_000, None, None, None)], base.schema)
    docs = odd.union(base.limit(20)).selectExpr("*", "1 AS block", "'x' AS _gone", "2 AS words", "3 AS _k", "4 AS _y", "5 AS n_lines", "6 AS n_dropped", "7 AS `a.b`", "8 AS c0", "9 AS row", "'h' AS h", "0 AS id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    encoded = corpus_pipeline.STAGES[-1][1]
    assert encoded(spark, docs, SF).count() == 24 and encoded(spark, docs.limit(0), SF).count() == 0


def test_rows_without_an_id_go_alone(spark):
    """Of 1,000 rows without an id one is contaminated and two are copies of another."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(997)]
    docs = spark.createDataFrame([(None, t, "en", "s", 1) for t in [*texts, f"so {item} it", texts[5], texts[5]]], base.schema)
    by_copy, by_benchmark = corpus_pipeline.remove_near_copies, corpus_pipeline.remove_benchmark
    assert by_benchmark(spark, docs, SF).count() == 999 and by_copy(spark, docs, SF).count() == 998
    assert corpus_pipeline.remove_lines(spark, docs, SF).count() == 1000


def folders(spark):
    return set(glob.glob(f"{staging.shared_dir(spark).removeprefix('file://')}/quire-*"))


def test_spent_tables_go(spark):
    known = folders(spark)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    left = folders(spark) - known
    assert len(left) == 1 and out.inputFiles()[0].split("/quire-")[1].split("/")[0] in left.pop()


def test_pipelines_in_threads_are_apart(spark):
    want = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    with ThreadPoolExecutor(3) as pool:
        runs = [pool.submit(lambda: sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())) for _ in range(3)]
        assert all(r.result() == want for r in runs)


def test_a_stage_that_is_not_read_yet_keeps_its_tables_while_others_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lazy = [stage(spark, docs, SF).selectExpr("count(*) AS n") for _, stage in corpus_pipeline.STAGES[:-1]]
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        staging.sweep(spark)
    corpus_pipeline.run(spark, SF)
    sizes = [x.first().n for x in lazy]
    assert sizes[1] == docs.count() and all(0 < n <= sizes[1] for n in sizes)


def test_tables_go_once_nothing_refers_to_them(spark):
    def collected():
        for _ in range(4):  # the JVM is told of what Python lets go, and then collects
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
            staging.sweep(spark)

    known = folders(spark)
    derived = staging.table(spark.range(10).selectExpr("id", "id AS k"), "one").filter("id > 3")
    collected()
    (own,) = folders(spark) - known
    found = derived.count()
    assert found == 6
    del derived
    for _ in range(10):  # plans of the last queries are remembered for a while
        staging.table(spark.range(10).join(spark.range(5), "id"), "other").count()
        collected()
        if own not in folders(spark):
            break
    assert own not in folders(spark)
    known = folders(spark)
    with staging.scope(spark):
        kept = staging.table(spark.range(10), "two")
        assert kept.count() == 10 and len(folders(spark) - known) == 1
    assert folders(spark) <= known


def test_session_settings_stay(spark):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    corpus_pipeline.run(spark, SF).count()
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_very_long_texts_come_in_small_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 3_000_000] * 12 + ["y"] * 5000})
    found = list(staging.pieces([batch, batch.slice(0, 0)]))
    assert sum(p.num_rows for p in found) == batch.num_rows and max(p.num_rows for p in found) <= staging.BATCH_ROWS
    assert all(p.num_rows == 1 or p.nbytes <= staging.BATCH_BYTES for p in found)
    assert sum((p.column(0).to_pylist() for p in found), []) == batch.column(0).to_pylist()


def test_stages_that_are_not_written_in_between_keep_their_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lazy = corpus_pipeline.remove_lines(spark, docs, SF)
    both = corpus_pipeline.remove_near_copies(spark, lazy, SF)
    assert both.count() <= lazy.count() == docs.count()

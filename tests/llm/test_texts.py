import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import byte_bpe, decontaminate, licences, line_dedup, staging, substring_dedup, token_shards
from tests.llm.brute import benchmark_hits, documents, lines, ordered, plain_words, repeats, some_texts

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'", "''", "a", "ab", "s", "t", "re", "'ll", "'S", "12", "!", ",.", " ", "\xa0", "é", "中", "😀", "\x1c", "\x85", "İ", "Σ", "́", "̸", "=", "<|endoftext|>", "<|ENDOFTEXT|>", "½"]), max_size=25)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})


def test_bpe_is_the_librarys(reference):
    bpe = byte_bpe.encoder(BPE)

    @settings(max_examples=400, deadline=None)
    @given(PIECES)
    def check(parts):
        text = "".join(parts)
        (ids,) = bpe.encode(pa.array([text]))
        assert ids.tolist() == reference.encode_ordinary(text) and bpe.decode(ids) == text.encode()

    check()


def test_bpe_rows(spark, reference):
    texts = some_texts(1)
    docs = documents(spark, texts, [None, 5, 5, *range(len(texts) - 3)])
    got = byte_bpe.encode(docs, BPE).collect()
    want = [(k, (t or "").encode()) for k, t in zip([None, 5, 5, *range(len(texts) - 3)], texts)]
    assert [(r.doc_id, bytes(r.decoded)) for r in got] == want
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [reference.encode_ordinary(t or "") for t in texts]
    assert byte_bpe.encode(docs.limit(0), BPE, digests=True).count() == 0


def test_words_encode_as_texts_do():
    own = token_shards.encoder(WORDS)

    @settings(max_examples=400, deadline=None)
    @given(PIECES)
    def check(parts):
        text = "".join(parts)
        (ids,) = own.encode(pa.array([text]))
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids

    check()


def test_token_shards(spark, tmp_path):
    texts = some_texts(2)
    ids = [None, None, 4, 4, 4, *range(-3, len(texts) - 8)]
    entries = token_shards.write(documents(spark, texts, ids), f"file://{tmp_path}/shards", WORDS, end_id=1)
    got = token_shards.read(spark, entries, digests=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids, key=lambda k: (k is not None, k))
    tokenizer = Tokenizer.from_file(WORDS)
    encoded = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered((k, len(e), crc(e)) for k, e in zip(ids, encoded))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert json.loads((tmp_path / "shards/manifest.json").read_text()) == entries
    shards = token_shards.Shards(f"file://{tmp_path}/shards")
    assert shards.get(-3).tolist() == encoded[ids.index(-3)] and shards.get(10**9) is None and shards.get(-99) is None
    for k in {*ids}:
        every = [encoded[i] for i, x in enumerate(ids) if x == k]
        assert ordered(shards.get(k, c).tolist() for c in range(len(every))) == ordered(every) and shards.get(k, len(every)) is None


def test_rows_of_one_id_spread_over_shards(spark, tmp_path):
    texts = [f"text number {i}" for i in range(400)]
    ids = [None] * 150 + [3] * 150 + list(range(4, 104))
    entries = token_shards.write(documents(spark, texts, ids), f"file://{tmp_path}/hot", WORDS, shards=8)
    assert len(entries) == 8 and max(e["n_docs"] for e in entries) < 120 and sum(e["base"] > 0 for e in entries) >= 4
    shards = token_shards.Shards(f"file://{tmp_path}/hot")
    tokenizer = Tokenizer.from_file(WORDS)
    for k in (None, 3, 50):
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in zip(ids, texts) if i == k]
        assert ordered(shards.get(k, c).tolist() for c in range(len(want))) == ordered(want) and shards.get(k, len(want)) is None


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_shards.WordEncoder(P.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        byte_bpe.encode(None, BPE, pattern=r"\S+|\s+")
    assert byte_bpe.PATTERN == P.PATTERN


def test_no_token_shards(spark, tmp_path):
    entries = token_shards.write(documents(spark, []), f"file://{tmp_path}/none", WORDS)
    assert entries == [] and token_shards.read(spark, entries).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    texts = some_texts(seed)
    ids = [None, *range(5, len(texts) + 4)]
    docs = documents(spark, texts, ids)
    assert ordered(line_dedup.drop_lines(docs, digests=True).collect()) == ordered(lines(ids, texts))
    whole = line_dedup.drop_lines(docs)
    assert whole.columns == [*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"]
    got = {(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in whole.collect()}
    assert got == set(lines(ids, texts))


def test_lines_of_one_document_are_no_copies(spark):
    docs = documents(spark, ["the same long line", "the same long line", "tiny"], [3, 3, 4])
    assert {r.n_dropped for r in line_dedup.drop_lines(docs, digests=True).collect()} == {0}
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_lines_of_one_hash_half_are_told_apart():
    told = np.zeros(6, line_dedup.TOLD)
    told["hash"], told["print"] = [7, 7, 7, 9, 9, 5], [1, 1, 2, 1, 3, 1]
    told["first"], told["last"], told["count"] = [4, 2, 3, 1, 1, 8], [4, 2, 6, 5, 2, 9], 1
    every = line_dedup.merged(told)
    assert [tuple(x) for x in every[["hash", "print", "first", "last", "count"]].tolist()] == [(5, 1, 8, 9, 1), (7, 1, 2, 4, 2), (7, 2, 3, 6, 1), (9, 1, 1, 5, 1), (9, 3, 1, 2, 1)]
    for keys in (None, np.array([1, 2, 2, 2, 3], np.uint64)):  # and where the mixed keys of three tie
        index = line_dedup.Index.from_row(*line_dedup.Index.build(every, keys).to_row())
        asked = np.concatenate([every, every[:1]])
        asked["print"][-1] = 77
        there, first = index.first(asked, None if keys is None else np.append(keys, keys[:1]))
        assert there.tolist() == [True] * 5 + [False] and first[:5].tolist() == every["first"].tolist()
        assert len(index.rest) == (0 if keys is None else 2)


def test_lines_of_a_hot_document(spark, monkeypatch):
    """A third of all rows has one doc_id: its rows lie in many blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 20)
    texts = [f"line number {i % 37} of all\nand its own line {i}\nshort" for i in range(150)]
    ids = [9 if i % 3 == 0 else None if i % 3 == 1 and i < 20 else i for i in range(150)]
    got = ordered(line_dedup.drop_lines(documents(spark, texts, ids), digests=True).collect())
    assert got == ordered(lines(ids, texts))


@pytest.mark.parametrize("width, run, hot", [(35, 8, 1000), (6, 3, 1000), (6, 3, 3), (5, 5, 2), (8, 1, 10)])
def test_substrings(spark, width, run, hot):
    texts = some_texts(width)
    ids = [None, *range(3, len(texts) + 1), 3]
    got = substring_dedup.remove_repeats(documents(spark, texts, ids), width=width, run=run, hot=hot, digests=True).collect()
    assert ordered(got) == ordered(repeats(ids, texts, width))


def test_substrings_over_many_blocks(spark, monkeypatch):
    """Blocks of some rows, several shards a task and packets that are sent before a block ends."""
    for name, value in (("BLOCK_BYTES", 2000), ("GATHER", 500), ("SHARD_ANCHORS", 40), ("INDEX_BYTES", 20_000), ("MOST_PARTS", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    monkeypatch.setattr(staging, "BATCH_ROWS", 5)
    texts = some_texts(11)
    ids = [None, *range(3, len(texts) + 1), 3]
    got = substring_dedup.remove_repeats(documents(spark, texts, ids), width=6, run=3, hot=5, digests=True).collect()
    assert ordered(got) == ordered(repeats(ids, texts, 6))


def test_substrings_of_nothing(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0
    (row,) = substring_dedup.remove_repeats(documents(spark, ["A  b\n c"])).collect()
    assert (row.kept, row.n_words, row.n_removed) == ("A b c", 3, 0)


@pytest.mark.parametrize("bound", [64 << 20, 4000])
def test_decontamination(spark, bound):
    """bound: one pass, and many with joined windows."""
    texts = some_texts(5) + ["\u0397\u03a3.\u0391 \u0397\u03a3 " * 7, "KELVIN \u212a"]
    items = [(1, texts[8]), (2, "Alpha, BETA!"), (3, None), (4, ""), (11, texts[9]), (12, texts[9]), (13, "iota"), (14, " ".join(plain_words(texts[12])[:7])), (15, "\u0397\u03a3 \u0391 \u0397\u03a3"), (16, "k"), (None, "theta")]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(docs, bench, set_bytes=bound).collect()
    mine = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got]
    want = benchmark_hits(range(len(texts)), texts, items)
    assert ordered(mine) == ordered(want)
    clean = decontaminate.decontaminate(docs, bench, set_bytes=bound)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {w[0] for w in want if not w[-1]}


def test_a_large_benchmark_goes_by_passes(spark):
    """60,000 b-grams, a bound of 10,000: the same hits as in one pass."""
    items = spark.range(6000).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.concat(F.lit("w"), (F.col("id") * 15 + i).cast("string"))), " ").alias("text"))
    docs = items.select(F.col("id").alias("doc_id"), F.concat(F.lit("some words before "), F.expr("substring_index(text, ' ', 7 + id % 9)"), F.lit(" and after")).alias("text"))
    one, many = (decontaminate.hits(docs, items, item="id", set_bytes=b).collect() for b in (64 << 20, 10_000 * decontaminate.ENTRY))
    assert ordered(map(str, one)) == ordered(map(str, many))
    assert sum(r.contaminated for r in one) == sum(1 for k in range(6000) if 7 + k % 9 >= 10)


def test_rows_without_an_id_are_judged_alone(spark):
    texts = ["clean text " * 3 + str(i) for i in range(999)] + ["the ten words of an item that stands in it here"]
    docs = documents(spark, texts, [None] * 1000)
    bench = spark.createDataFrame([(1, texts[-1])], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 999
    assert [r.n_items for r in decontaminate.hits(docs, bench).filter("contaminated").collect()] == [1]


def test_decontamination_without_a_benchmark(spark):
    docs, none = documents(spark, ["a b", None], [None, None]), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in decontaminate.hits(docs, none).orderBy("n_words").collect()] == [(0, False), (2, False)]
    assert decontaminate.decontaminate(docs, none).count() == 2 and decontaminate.hits(docs.limit(0), none).count() == 0


def test_licences(spark):
    phrases = [(plain_words(p), label) for p, label in licences.PHRASES]
    texts = ["mit license MIT License, mit license", "The GNU General Public License", "cc by cc by", "Apache\nLicense", "mit-license x apache", "gnu general public", licences.NOTICES[0][2] * 2, "x " + licences.NOTICES[4][2], licences.NOTICES[2][2], "", None, "word " * 5000 + "mit license"]
    got = {r.doc_id: r for r in licences.scan(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = plain_words(t)
        places = [(i, label) for p, label in phrases for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        r, at = got[k], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1
    assert (got[6].labels, got[7].labels, got[8].labels, got[9].labels) == ("mit", "lgpl", "apache", "")
    assert licences.scan(documents(spark, [])).count() == 0


def _plain_labels(text):
    """Each template tried at every place: all of its key phrase, and three quarters of its rarest words and that."""
    templates = [(label, plain_words(p), plain_words(p)) for p, label in licences.PHRASES] + [(label, plain_words(k), plain_words(t)) for label, k, t in licences.NOTICES]
    df = lambda x: sum(x in words for _, _, words in templates)
    w, found, best = plain_words(text), set(), 0.0
    for n, (label, key, words) in enumerate(templates):
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rare = words if n < len(licences.PHRASES) else sorted(range(len(words)), key=lambda i: (df(words[i]), i))[: licences.RARE]
        entries = set(range(at, at + len(key))) | (set(range(len(words))) if rare is words else set(rare))
        for start in range(-len(words), len(w)):
            met = [0 <= start + i < len(w) and w[start + i] == words[i] for i in sorted(entries)]
            if w[start + at : start + at + len(key)] == key and start + at >= 0 and sum(met) >= licences.SHARE * len(entries):
                found.add(label)
                best = max(best, sum(met) / len(entries))
    return ",".join(sorted(found)), best


def test_labels_are_those_of_a_plain_search(spark):
    texts = []
    for _, key, notice in licences.NOTICES:
        w = plain_words(notice)
        texts += [f"x {notice} y", " ".join(w[2:]), " ".join(w[:-3]), " ".join(x if i % 2 else "other" for i, x in enumerate(w)), f"about the {key} itself", " ".join(plain_words(key)[1:]), notice.upper()]
    got = licences.scan(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.labels, round(r.score, 9)) for r in got] == [(a, round(b, 9)) for a, b in map(_plain_labels, texts)]
    assert all(n[0] in r.labels.split(",") for n, r in zip(licences.NOTICES, got[::7]))
    assert licences.scan(documents(spark, ["MIT LICEN\u017fE Apache \u212a"])).first().labels == ""


def test_rows_of_one_key_and_text_are_spread_over_shards(spark, tmp_path):
    docs = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'' AS text").unionAll(spark.range(2000).selectExpr("7 AS doc_id", "'same'"))
    entries = token_shards.write(docs, f"file://{tmp_path}/shards", WORDS, end_id=1, shards=4)
    assert sum(e["n_docs"] for e in entries) == 102_000 and max(e["n_docs"] for e in entries) < 40_000
    shards = token_shards.Shards(f"file://{tmp_path}/shards")
    assert all(shards.get(None, c).tolist() == [1] for c in (0, 30_000, 60_000, 99_999)) and shards.get(None, 100_000) is None
    assert shards.get(7, 1999).tolist() == shards.get(7).tolist() and shards.get(7, 2000) is None


def test_many_windows_around_one_run_of_words_are_spread(spark):
    """One run of 8 words stands in all documents, each of which there is twice, within its own surroundings."""
    run = lambda text: substring_dedup.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 8, 8).runs[0]
    common = min((f"b{k} c d e f g h i" for k in range(500)), key=run)  # the smallest run of most windows it stands in
    texts = [" ".join([*(f"a{i}x{j}" for j in range(20)), *common.split(), *(f"z{i}x{j}" for j in range(20))]) for i in range(700)] * 2
    ids = list(range(len(texts)))
    got = substring_dedup.remove_repeats(documents(spark, texts, ids).repartition(3), hot=50, digests=True).collect()
    assert ordered(got) == ordered(repeats(ids, texts, 35)) and {r.n_removed for r in got} == {48}
    # What a shard is told of by the segments of a block: the windows of the run go by their own hashes.
    data, offsets = np.frombuffer("".join(texts[:700]).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[:700]])])
    own = substring_dedup.Words(data, offsets, 35, 8)
    names, times = np.unique(own.anchor[own.valid], return_counts=True)
    hot = names[times >= 50]
    first, last, dealt = own.segments(np.setdiff1d(names, hot), hot, np.sort(own.windows(np.flatnonzero(own.valid))))
    sizes = [b - a for _, a, b in substring_dedup._cuts(np.sort(dealt), 16)]
    assert len(sizes) == 16 and max(sizes) < 2 * np.median(sizes) and len(hot) and (first <= last).all()

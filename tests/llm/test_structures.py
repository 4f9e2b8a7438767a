from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.components import components, forest
from quire.llm.fm_index import FMIndex
from quire.llm.mph import MinimalPerfectHash
from quire.llm.textbytes import CHUNK, TokenCache, byte_sums, slice_hashes, text_chunks, word_spans


@pytest.mark.parametrize("n", [0, 1, 2, 100, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    mph = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    assert len(mph.to_bytes()) < 1000 + len(keys)  # a few bits a key


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        MinimalPerfectHash.build(np.array([5, 5], np.uint64))


def test_words_of_chunks():
    texts = ["a b", "c", None, "", " d\te\x0b", "é f" * 3, "x" * (CHUNK + 5) + " y", "z"]
    found = []
    for i, j, data, offsets in text_chunks(pa.array(texts)):
        start, end, first = word_spans(data, offsets)
        raw = data.tobytes()
        for k in range(j - i):
            found.append([raw[a:b].decode() for a, b in zip(start[first[k] : first[k + 1]], end[first[k] : first[k + 1]])])
    assert found == [(t or "").split() for t in texts]


def test_slices_hash_by_content():
    data = np.frombuffer(b"abcXabc", np.uint8)
    sums = byte_sums(data)
    h = slice_hashes(sums, np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]


def test_token_cache_forgets_without_harm():
    calls = []

    def encode(slices, hashes):
        calls.append(len(slices))
        return [list(s) for s in slices]

    cache = TokenCache(encode, bits=2, pool=40)
    data = np.frombuffer(b"".join(bytes([65 + i, 66 + i]) for i in range(20)) * 2, np.uint8)
    start = np.arange(0, len(data), 2)
    for _ in range(3):
        ids, sizes = cache.ids(data, byte_sums(data), start, start + 2)
        assert bytes(ids.astype(np.uint8)) == data.tobytes() and set(sizes) == {2}


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 9])
def test_fm_index_counts(depth):
    rng = np.random.default_rng(depth)
    texts = [rng.integers(1, 4, rng.integers(0, 40)) for _ in range(30)] + [np.ones(50, int)]
    weights = rng.integers(1, 4, len(texts))
    symbols, begins = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen = Counter()
    for t, w in zip(texts, weights):
        for i in range(len(t) - depth + 1):
            seen[tuple(t[i : i + depth])] += w
    want = np.zeros(len(symbols), int)
    for t, at in zip(texts, begins):
        for i in range(len(t) - depth + 1):
            want[at + i] = seen[tuple(t[i : i + depth])]
    assert (FMIndex(symbols, begins, weights, depth).matches(symbols, begins) == want).all()


def _smallest(edges):
    nodes, roots = forest(*np.array(edges, np.int64).T)
    out = {n: n for e in edges for n in e}
    out.update(zip(nodes.tolist(), roots.tolist()))
    return out


@pytest.mark.parametrize("finish", [0, 5, 10_000])
def test_components(spark, finish):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(1900, 1960)] + [(7, 7), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), finish=finish).collect()
    want = {n: c for n, c in _smallest(edges).items() if any(n in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_any_five_bytes_hold_a_posting_group():
    from quire.llm.simhash import posting_groups

    groups = posting_groups()
    assert all(any(set(g) <= set(x) for g in groups) for x in combinations(range(8), 5))

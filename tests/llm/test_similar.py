import math
import random

import numpy as np
import pytest
import xxhash

from quire.llm import embedding_dedup, simhash
from quire.llm.components import forest
from tests.llm.brute import az, documents, ordered, some_texts


def _fingerprint(text, words=3):
    w = [x.encode() for x in az(text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    k = min(words, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(n, near):
    a, b = np.nonzero(near)
    root = np.arange(n)
    nodes, roots = forest(a, b)
    root[nodes] = roots
    return root


def test_fingerprints_and_components(spark):
    texts = some_texts(3)
    ids = [None, *range(10, len(texts) + 9)]
    prints = np.array([_fingerprint(t) for t in texts], np.uint64)
    root = _components(len(texts), np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
    least = {r: min((ids[i] for i in np.flatnonzero(root == r) if ids[i] is not None), default=None) for r in set(root.tolist())}
    want = [(ids[i], f"{int(prints[i]):016x}", least[int(root[i])]) for i in range(len(texts))]
    assert ordered(simhash.near_duplicates(documents(spark, texts, ids)).collect()) == ordered(want)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    every = {int(x) for x in base}
    for x in base[:20].tolist():  # chains of flips, far from the first after some steps
        for _ in range(60):
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                x ^= 1 << b
            every.add(x)
    for _ in range(300):  # a ball of over 32 members that share most bytes
        every.add(int(base[30]) ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(1, 5), replace=False)))
    own = np.array(sorted(every), np.uint64)
    root = _components(len(own), np.bitwise_count(own[:, None] ^ own[None]) <= 3)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long")).collect()
    at = {int(x): i for i, x in enumerate(own.view(np.int64))}
    near = np.zeros((len(own), len(own)), bool)
    for a, b in edges:
        near[at[a], at[b]] = near[at[b], at[a]] = True
    assert (_components(len(own), near) == root).all()


def test_many_in_a_list_are_looked_up():
    own = np.unique(np.random.default_rng(2).integers(0, 2**16, 3000, dtype=np.uint64))
    a, b = simhash._list_edges(own, 2, 0xFFFF)  # more members than the 137 neighbours within two bits
    want = {(int(x), int(y)) for i, x in enumerate(own) for y in own[i + 1 :][np.bitwise_count(own[i + 1 :] ^ x) <= 2]}
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want


def test_similar_documents(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)) for _ in range(12)]
    texts, group = [], []
    for g, t in enumerate(base):
        for c in range(1 if g < 6 else 30):
            w = t.split()
            for _ in range(4 if c else 0):  # four edits of 400 words: similarity 0.9
                w[rng.randrange(400)] = f"x{rng.random()}"
            texts.append(" ".join(w))
            group.append(g)
    texts += ["", None, texts[0]]
    group += [20, 20, 0]
    got = {r.doc_id: r.component_id for r in simhash.similar(documents(spark, texts)).collect()}
    assert got == {i: group.index(g) for i, g in enumerate(group)}
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, texts)).collect()) == sorted({group.index(g) for g in group})


@pytest.mark.parametrize("block", [256, 8])
def test_links_are_verified_by_the_similarity_of_shingle_sets(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(simhash, "PIVOTS", 2, raising=False)
    rng = random.Random(9)
    texts = []
    for g in range(40):  # one run of edits of a 400-word text: similarities from 0.5 to 0.85, on both sides of 0.8
        base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
        texts.append(" ".join(base))
        for edits in (7, 9, 10, 12, 15, 25) if g else [rng.randint(5, 12) for _ in range(40)]:
            w = list(base)
            at = rng.randrange(20)
            for i in range(edits):
                w[(at + i * 15) % 400] = f"x{rng.random()}"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    share = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    assert ((share > 0.7) & (share < 0.8)).sum() > 50 and ((share >= 0.8) & (share < 0.85)).sum() > 50
    want = _components(len(texts), share >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.similar(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [int(np.flatnonzero(want == want[i])[0]) for i in range(len(texts))]


def test_copies_without_an_id(spark):
    """One row of each group stays, that of the smallest id that is there; rows of one id are judged apart."""
    a, b, c = ("some words of text " * 9 + x for x in ("one", "two two", "three three three"))
    texts, ids = [a, a, a, b, b, c, a, c, "other words stand here now"], [None, 7, 5, None, None, 5, 5, 5, None]
    docs = documents(spark, texts, ids)
    apart = simhash.one_of_each(docs, similarity=0.99)
    assert apart.columns == docs.columns and ordered((r.doc_id, r.text) for r in apart.collect()) == ordered([(5, a), (None, b), (5, c), (None, texts[-1])])
    assert ordered(simhash.similar(docs, similarity=0.99).collect()) == ordered([(None, 5), (7, 5), (5, 5), (None, None), (None, None), (5, 5), (5, 5), (5, 5), (None, None)])


@pytest.mark.parametrize("groups", [40, 300])
def test_a_long_list_of_small_groups_connects_as_all_pairs_do(monkeypatch, groups):
    """And no list of the rows that share one group of bytes is compared with itself whole."""
    monkeypatch.setattr(simhash, "LONG", 64)
    rng = np.random.default_rng(12)
    base = rng.integers(0, 256, (groups, simhash.SIGNATURE), dtype=np.uint8)
    own = np.repeat(base, 4, axis=0)
    own[rng.random(own.shape) < 0.15] = 7
    own[:, :4] = 1  # the group by which they are posted
    a, b = simhash._signature_edges(own, 62, tuple(range(1, 24)))
    near = np.zeros((len(own), len(own)), bool)
    near[a, b] = near[b, a] = True
    assert (_components(len(own), near) == _components(len(own), (own[:, None] == own[None]).sum(axis=2) >= 62)).all()


def test_a_large_list_of_signatures_connects_as_all_pairs_do():
    rng = np.random.default_rng(5)
    own = rng.integers(0, 256, (120, simhash.SIGNATURE), dtype=np.uint8)
    own[:70] = own[0]
    own[:70][rng.random((70, simhash.SIGNATURE)) < 0.1] = 0
    agree = 77
    a, b = simhash._signature_edges(own, agree)
    near = np.zeros((120, 120), bool)
    near[a, b] = near[b, a] = True
    assert (_components(120, near) == _components(120, (own[:, None] == own[None]).sum(axis=2) >= agree)).all()


def _vectors(rng, n, d=64):
    out = []
    for i in range(n):
        v = rng.standard_normal(d)
        for _ in range(rng.integers(1, 8)):
            out.append((v + rng.standard_normal(d) * rng.choice([0, 0.01, 0.08, 0.1]) * 1.0).astype(np.float32).tolist())
    return out


@pytest.mark.parametrize("tile", [4096, 8])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(6)
    vectors = _vectors(rng, 80)
    crowd, other = rng.standard_normal(64), rng.standard_normal(64).astype(np.float32).tolist()
    vectors += [(crowd + rng.standard_normal(64) * 0.05).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i + 5, v, int(rng.integers(0, 2))) for i, v in enumerate(vectors)]
    rows += [(0, None, 1), (1, [0.0] * 64, 1), (2, [None, *[1.0] * 63], 1), (3, [math.nan, *[1.0] * 63], 1), (4, vectors[0], None), (9999, vectors[1][:10], rows[1][2]), (9998, [], 0), (9997, [1e30] * 64, 0), (9996, [1e-30] * 64, 0)]
    # Without a vec_id: with a vector of others, two of their own, and one that links with nothing; then repeated vec_ids.
    rows += [(None, vectors[1], rows[1][2]), (None, other, 1), (None, other, 1), (None, None, 1), (7000, vectors[2], rows[2][2]), (7000, vectors[40], rows[40][2]), (7000, vectors[40], rows[40][2])]
    clashing = spark.createDataFrame([(*r, 1, b"x", 5, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, v binary, n int, bucket int")
    got = embedding_dedup.near_duplicates(clashing, tile=tile).collect()
    valid = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = np.zeros((len(rows), len(rows)), bool)
    for x in valid:
        for y in valid:
            if x != y and rows[x][2] == rows[y][2] and len(rows[x][1]) == len(rows[y][1]):
                a, b = (np.array(rows[z][1], np.float32).astype(float) for z in (x, y))
                near[x, y] = (a / abs(a).max()) @ (b / abs(b).max()) / np.linalg.norm(a / abs(a).max()) / np.linalg.norm(b / abs(b).max()) >= 0.98
    root, want = _components(len(rows), near), []
    for i, (k, _, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        least = min(members, default=None)
        want.append((k, int(near[i].sum()), least, k == least if members else root[i] == i))
    assert ordered(got) == ordered(want)


def test_vectors_travel_only_to_lists_that_may_hold_a_pair(spark):
    """Codes go to every table; of vectors without neighbours few are sent at all."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((400, 64)).astype(np.float32)
    vectors[1] = vectors[0] + 0.01
    codes, keys = embedding_dedup.encoded(vectors / np.linalg.norm(vectors, axis=1, keepdims=True).astype(float), np.arange(400), np.ones(400), *embedding_dedup.tables_for(400))
    bits, tables = embedding_dedup.tables_for(400)
    own = embedding_dedup.Codes(codes, bits, tables)
    assert (own.keys == keys).all()
    asked = set()
    for t in range(tables):
        order = np.argsort(keys[:, t], kind="stable")
        bucket = (keys[order, t].astype(np.int64) << embedding_dedup._TABLE_BITS) | t
        for i, j in embedding_dedup.passing(bucket, np.full(400, -1), embedding_dedup.Codes(codes[order], bits, tables), 0.98):
            asked |= {(t, int(order[x])) for x in (*i, *j)}
    assert {0, 1} <= {x for _, x in asked} and len(asked) < 400 * tables / 10


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label string")).count() == 0


def test_binary_codes_estimate_without_bias():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal((300, 64)) * 0.1
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    bits, tables = embedding_dedup.tables_for(300)
    codes, other = (embedding_dedup.Codes(embedding_dedup.encoded(z, np.arange(300), np.ones(300), bits, tables)[0], bits, tables) for z in (x, y))
    exact = (x * y).sum(axis=1)
    estimate = (codes.signs * other.rotated).sum(axis=1) * codes.scale
    assert abs((estimate - exact).mean()) < 0.01
    assert (codes.upper_of(np.arange(300), np.arange(300)) > 0).all()
    pairs = np.arange(300)
    both = embedding_dedup.Codes(np.concatenate([embedding_dedup.encoded(z, pairs, np.ones(300), bits, tables)[0] for z in (x, y)]), bits, tables)
    assert (both.upper_of(pairs, pairs + 300) >= exact).all()

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import importance, mixing, ranked
from tests.llm.brute import documents, plain_words, some_texts

ITEMS = "item_id long, text string, no int, term string, shard int, w string"


def items(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(k, t, 1, "x", 2, "w") for k, t in zip(ids, texts)], ITEMS)


def runs(words):
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(ids, texts, target, share):
    own, (s, t) = [runs(plain_words(x)) for x in texts], (Counter(), Counter())
    s.update(b for f in own for b in f)
    t.update(b for x in target for b in runs(plain_words(x)))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    out = []
    for k, x, f in zip(ids, texts, own):
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(x))])
    eligible = [r for r in out if r[4] >= 20]
    drawn = sorted(eligible, key=lambda r: (-r[3], r[0] is None, r[0]))[: share * len(eligible) // 100]
    return out, drawn


@pytest.mark.parametrize("share", [5, 60])
def test_importance_resampling(spark, share):
    texts = some_texts(11) + ["ÉCOLE École école Straße" * 9, "I.B.M. a-b " * 12]
    ids = [*range(7, len(texts) + 6), None]
    docs, target = documents(spark, texts, ids), items(spark, ["alpha beta GAMMA delta", "", None, "zeta eta theta iota", "zeta eta theta iota"])
    got = importance.scored(docs, target, share=share).collect()
    want, drawn = resampled(ids, texts, ["alpha beta GAMMA delta", "", "", "zeta eta theta iota", "zeta eta theta iota"], share)
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got))) == sorted(map(repr, map(tuple, want)))
    ranked_rows = sorted((r.rank, r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [(r[0], r[1], r[2]) for r in ranked_rows] == [(i, d[3], d[0]) for i, d in enumerate(drawn, 1)]
    kept = importance.sample(docs, target, share=share)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(d[0]) for d in drawn)


def test_importance_resampling_of_odd_tables(spark):
    docs, target = documents(spark, ["a b " * 30] * 40, [5] * 20 + [None] * 20), items(spark, ["a"])
    got = importance.scored(docs, target, share=50).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert importance.scored(docs.limit(0), target).count() == 0
    assert importance.scored(docs, target.limit(0), share=50).filter("rank IS NOT NULL").count() == 20
    dotted = docs.selectExpr("*", "2 AS n_words", "3 AS h", "5 AS features", "6 AS `x.y`")
    assert importance.sample(dotted, target, share=50).columns == dotted.columns


def goals(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if goal[s] > most * sizes[s]]
        if not above:
            return fixed | goal
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("few", [0, 1000])
def test_source_mixing(spark, few):
    rng = np.random.default_rng(12)
    names = ["a", "B", "é", None, "", "zz", "tiny", "m"]
    rows = [(i, "w " * int(n), names[min(int(s), 7)]) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 900), rng.geometric(0.3, 900) - 1))]
    rows += [(None, None, "a"), (None, "", None), (7, "  ", "zz"), (8, "one two\tthree\nfour", "alone"), (9, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "3 AS row", "4 AS `a.b`", "5 AS copies")
    got = mixing.plan(docs, few=few).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = goals(total)
    assert sorted(map(repr, ((r.doc_id, r.size, r.source, r.source_size) for r in got))) == sorted(map(repr, ((k, size(t), s, total[s]) for k, t, s in rows)))
    taken = defaultdict(int)
    for r in got:
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in total) and math.isclose(sum(want.values()), sum(total.values()))
    again = mixing.plan(docs.repartition(7), few=few).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    emitted = mixing.mix(docs, few=few)
    assert emitted.columns == docs.columns
    assert Counter(r.doc_id for r in emitted.collect() if r.doc_id is not None) == Counter(r.doc_id for r in got if r.doc_id is not None for _ in range(r.copies))


def test_source_mixing_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert mixing.plan(docs.limit(0)).count() == 0
    assert [(r.target, r.taken) for r in mixing.plan(docs).collect()] == [(0.0, 0)] * 2


def best(ids, texts, asked, k):
    own = [Counter(plain_words(t)) for t in texts]
    lens = [sum(c.values()) for c in own]
    n, total = sum(x > 0 for x in lens), sum(lens)
    df = Counter(t for c in own for t in c)
    out = []
    for item, text in asked:
        scores = []
        for key, c, length in zip(ids, own, lens):
            m = 25 + (75 * length * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(plain_words(text)).items() if t in c)
            if s:
                scores.append((-s, key is None, key))
        out += [(item, i, key, -s) for i, (s, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("docs_each", "set_bytes", "probe", "k"), [(8192, 16 << 20, 64, 10), (7, 200, 2, 3), (1, 1, 0, 1)])
def test_ranked_search(spark, monkeypatch, docs_each, set_bytes, probe, k):
    monkeypatch.setattr(ranked, "SHARD_DOCS", docs_each)
    monkeypatch.setattr(ranked, "PIECE", 50)
    texts = some_texts(13) + ["École ÉCOLE straße I.B.M.", "école", "b m i " * 3]
    ids = [*range(len(texts) - 1), None]
    asked = [(1, "alpha Beta beta"), (1, "zeta"), (None, "GAMMA kappa"), (3, None), (4, "unheard of"), (5, "École ibm i b"), (6, "épsilon " * 50), (7, " ".join(t or "" for t in texts[7:20]))]
    index = ranked.build(documents(spark, texts, ids).repartition(3))
    got = ranked.search(index, items(spark, [t for _, t in asked], [i for i, _ in asked]), k=k, set_bytes=set_bytes, probe=probe)
    # Equal scores of a null id and others, and of copies, go by ascending id.
    assert sorted(repr(tuple(r)) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == best(ids, texts, asked, k)


def test_ranked_search_of_empty_tables(spark):
    docs, asked = documents(spark, ["alpha beta", None, ""]), items(spark, ["alpha", ""])
    assert ranked.search(ranked.build(docs.limit(0)), asked).count() == 0
    assert ranked.search(ranked.build(docs), asked.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked.search(ranked.build(docs), asked).collect()] == [(0, 1, 0)]
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS id", "2 AS `a.b`")
    assert ranked.search(ranked.build(named), asked).first().doc_id == "d0"


def test_impacts_do_not_overflow():
    tf, lens = np.array([1, 5], np.uint32), np.array([10, 2_000_000_000], np.uint32)
    n, total = 10**11, 10**13
    want = [(10**9 * int(t)) // (1000 * int(t) + 8 * (25 + (75 * int(x) * n) // total)) for t, x in zip(tf, lens)]
    assert ranked.impacts(tf, lens, n, total, 75).tolist() == want

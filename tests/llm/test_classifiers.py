import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import quality, queries, staging, toxicity
from tests.llm.brute import documents

SF = "/root/testdata/sf0.01"


def test_isotonic():
    score = np.arange(6)
    value = quality.isotonic(score, np.array([0, 2, 1, 3, 3, 4.0]), np.array([4, 4, 4, 4, 4, 4.0]))
    assert np.allclose(value, [0, 0.375, 0.375, 0.75, 0.75, 1]) and (np.diff(value) >= 0).all()


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, 5))
    phi = quality.Fourier(np.zeros(5), np.ones(5), features=20_000, gamma=0.1)(x)[:, :-1]
    exact = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert abs(phi @ phi.T - exact).max() < 0.05


@pytest.mark.parametrize("query, label, at", [(queries.op1_quality, "quality", 0.7), (queries.op5_toxicity, "toxic", 0.5)])
def test_held_out_rows(spark, query, label, at):
    found = query(spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0
    assert found.filter((F.col("score") >= at) != (F.col("predicted") == 1)).count() == 0
    held = found.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (held.predicted == held[label]).mean() > 0.93


@pytest.mark.parametrize("labels, low, high", [([], 0, 1), ([(0, 1), (1, 1)], 0.9, 1), ([(0, 0), (1, 0)], 0, 0.1), ([(0, None)], 0, 1)])
def test_few_labels(spark, labels, low, high):
    docs = documents(spark, ["a text of words", "", None, "x" * 100_000], [0, 1, None, 3])
    given = spark.createDataFrame(labels, "doc_id long, y int")
    measured = staging.table(quality.measure(docs), "statistics")
    scores = [r.score for r in quality.score(measured, quality.fit(measured, given, "y")).collect()]
    scores += [r.score for r in toxicity.score(docs, toxicity.fit(docs, given, "y")).collect()]
    assert len(scores) == 8 and all(low <= s <= high for s in scores)
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_identity_terms_are_no_insult(spark):
    """Most toxic examples name a group; a neutral mention of it is still clean."""
    texts, y = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(f"words number {i % 7} and more. " + ("Those women are pathetic." if bad and i % 8 == 0 else "You are pathetic." if bad else "The men met." if i % 3 else "Nothing here."))
        y.append(int(bad))
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tests = documents(spark, ["The women met.", "The men met.", "He is pathetic."])
    score = {r.doc_id: r.score for r in toxicity.score(tests, model).collect()}
    assert score[0] < 0.5 and abs(score[0] - score[1]) < 0.1 and score[2] > 0.5
    kept = toxicity.keep_clean(tests, model)
    assert kept.columns == tests.columns and {r.doc_id for r in kept.collect()} == {0, 1}


def _logit(model, text):
    p = model.score(pa.array([text]))[0]
    return np.log(p / (1 - p))


@pytest.mark.parametrize("group", toxicity.IDENTITY, ids=lambda g: g[0])
def test_a_group_that_goes_with_insults_is_no_insult(spark, group):
    """One term stands with insults and another without; neutral sentences score alike, beginnings of the terms included."""
    rng, texts, y = random.Random(1), [], []
    for i in range(300):
        bad = i % 2
        rest = " ".join(rng.choices(["people", "met", "today", "again", "there", "music", "blanket", "whisper", "oldest", "mention"], k=6))
        texts.append(f"{rest}. The {group[0] if bad else group[1]} {'idiots are pathetic' if bad else 'folk sang'}. {rest}")
        y.append(bad)
    model = toxicity.fit(documents(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    scores = [_logit(model, f"The {w} people met again.") for w in group]
    assert max(scores) - min(scores) < 0.1
    assert _logit(model, "You idiots are pathetic") > 0 > scores[0]


def test_the_penalty_is_the_change_of_the_score(monkeypatch):
    """Against sentences that are really exchanged and scored."""
    groups = (("women", "men", "mothers"), ("old", "elderly"))
    texts = ["Women and men. The women of the womb!", "old woman, ELDERLY folk", "mothers moth", "nothing", "old old men", ""]
    rng = np.random.default_rng(3)
    hashes = np.unique(np.concatenate([h for _, _, h, _, _ in toxicity.document_words(pa.array([*texts, " ".join(w for g in groups for w in g)]))]))
    vocabulary = hashes[hashes > 0]
    weights = rng.standard_normal(len(vocabulary) + 1)
    model, terms = toxicity.Model(vocabulary, weights), toxicity.Terms(groups, vocabulary)
    want, found = [], []
    for t in texts:
        for s in toxicity_sentences(t):
            words = s.split()
            (own,) = [h for _, _, h, _, _ in toxicity.document_words(pa.array([s]))]
            at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
            found += [(*x, 1) for x in terms.swapped(at[vocabulary[at] == own])]
            for g in groups:
                for w in set(words) & set(g):
                    want += [(_logit(model, s) - _logit(model, " ".join(o if x == w else x for x in words))) ** 2 for o in g if o != w]
    penalty = weights[:-1] @ toxicity.swap_matrix(terms, found, len(vocabulary)) @ weights[:-1]
    assert len(found) == len(want) and np.isclose(penalty, np.mean(want))


def toxicity_sentences(text):
    return [" ".join("".join(c if c.isalnum() else " " for c in s).split()) for s in text.lower().replace("!", ".").split(".")]


def test_repeated_ids_stay_within_the_sample(spark):
    docs = documents(spark, [f"text {i}" for i in range(500)] + ["other"] * 5 + [None], [1] * 500 + [2, 3, 4, 5, 6] + [None])
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.sampled(docs, labels, "toxic", "doc_id", "text", None, 4)
    assert rows.count() == 4
    assert toxicity.sampled(docs, labels, "toxic", "doc_id", "text", None, 100).count() == 6
    assert toxicity.score(docs, toxicity.fit(docs, labels, sample=4)).count() == 506


def test_quality_against_a_dense_fit(spark):
    """Partition sums, cross-fitted calibration and scores against one dense solution on the driver."""
    rng = random.Random(2)
    texts, y = [], []
    for i in range(240):
        good = i % 3 > 0
        texts.append(" ".join(rng.choices(["the", "river", "runs", "to", "a", "town."] if good else ["BUY", "!!!", "$$", "the", "now"], k=rng.randint(3, 60))))
        y.append(int(good) if i % 11 else 1 - int(good))
    ids = list(range(240))
    docs = documents(spark, [*texts, "", None], [*ids, 900, 901])
    labels = spark.createDataFrame([*zip(ids, y), (0, y[0]), (1, None), (5000, 1)], "doc_id long, quality int")
    measured = staging.table(quality.measure(docs), "statistics")
    model = quality.fit(measured, labels)
    got = {r.doc_id: r.score for r in quality.score(measured, model).collect()}

    rows = np.array([x.astype("<f4").astype(float) for x in quality.statistics(pa.array([*texts, "", None]))])
    use, target = np.array([*ids, 0]), np.array([*y, y[0]], float)
    use, target = use[np.arange(241) != 1], target[np.arange(241) != 1]
    use, target = np.append(use, 1), np.append(target, y[1])  # the other label of row 1 is null
    fold = np.array([r.f for r in spark.createDataFrame([(int(k),) for k in use], "k long").select(quality.fold_of(F.col("k")).alias("f")).collect()])
    fourier = quality.Fourier(rows[use].mean(0), rows[use].std(0))
    phi = fourier(rows)

    def ridge(at, t):
        plain = np.diag([quality.RIDGE * len(at) / quality.FEATURES] * quality.FEATURES + [0])
        return np.linalg.solve(phi[at].T @ phi[at] + plain, phi[at].T @ t)

    out = np.zeros(len(use))
    for f in (0, 1):
        out[fold == f] = phi[use[fold == f]] @ ridge(use[fold != f], target[fold != f])
    bins = np.clip((out + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    at, total, weight = np.unique(bins), np.bincount(bins, target), np.bincount(bins)
    # Plain isotonic regression: the largest mean of any stretch that ends there, of the smallest that begins there.
    t, w = total[at], weight[at]
    mean = lambda a, b: t[a : b + 1].sum() / w[a : b + 1].sum()
    plain = [max(min(mean(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    want = np.clip(np.interp(phi @ ridge(use, target), (at + 0.5) / quality.BINS * 2 - 0.5, plain), 0, 1)
    assert np.allclose([got[k] for k in [*ids, 900, 901]], want, atol=1e-6)


def test_neutral_mentions_score_alike_after_a_fit_on_the_tables(spark):
    """The tables name no group, but insults share beginnings with some terms."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    for group in toxicity.IDENTITY:
        for sentence in ("my {} neighbour bought bread at the market today", "{}", "we met the {} at noon"):
            scores = [_logit(model, sentence.format(term)) for term in group]
            assert max(scores) - min(scores) < 0.05 and abs(scores[0] - _logit(model, sentence.format(""))) < 0.05
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(truth[r.doc_id], r.predicted) for r in toxicity.score(docs, model).collect() if truth.get(r.doc_id) is not None]
    assert np.mean([t == p for t, p in got]) > 0.97

"""Toxicity: a classifier regularised by counterfactuals (operator 5).

A document is the set of its words and of their beginnings of ``HEADS`` bytes, as insults are inflected. Those that
tell labels apart make the vocabulary, by a z-score over the labelled sample; identity terms always belong to it.
Logistic regression on the presence of the vocabulary gets a penalty: in every labelled sentence each identity term is
exchanged for each other of its group, and ``SWAP`` times the mean squared change of the sentence's score (its logit) is
added to the loss. The change is that of all entries that come and go with the term, its beginnings included, less those
that other words of the sentence bring too; so a neutral mention of a group scores the same for all groups.

Labelled sentences may name no group at all, and a term may still score by a beginning that it shares with an insult. So
each sentence that names none gets one term, in turn, and so does the empty sentence get each: there the term is exchanged
for the others and for none, and ``SWAP`` times the mean squared change of each such pair is added too. The terms are
data, by language; a caller may pass others.

The fit uses at most ``SAMPLE`` labelled documents, those of the smallest hash of their key, written as a table; that many
rows of word numbers come to the driver. Scores take whole texts. Cases: a null or empty text scores as a text without
known words; without labels, or with one class only, every score is the mean label (0.0 without any); null labels do not
count; a null doc_id is scored and has no label; of rows of one doc_id one is learnt from, that of the smallest hash of
its text, once for each different label; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.columns import own as col
from quire.llm.mph import mix
from quire.llm.textbytes import NO_WORD, byte_sums, slice_hashes, text_chunks, word_spans

SAMPLE, VOCABULARY, LEAST, RIDGE, SWAP = 20_000, 600, 5, 1.0, 1000.0
HEADS = (3, 4, 5, 6)
# Groups of identity terms that can stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("transgender", "cisgender", "nonbinary"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "extranjeros", "gitanos", "discapacitados"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "étrangers", "handicapés", "homosexuels"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "ausländer", "behinderte", "homosexuelle"),
)
_GAP = NO_WORD
#: What ends a sentence.
_STOP = np.isin(np.arange(256), list(b".!?\n"))


def word_hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return slice_hashes(byte_sums(raw), np.concatenate([[0], ends[:-1]]), ends)


def document_words(column: pa.Array):
    """(first document, end, hashes, each document's first hash, number of stops before each).

    Of each word the hash, then those of its beginnings, 0 where the word is no longer.
    """
    each = 1 + len(HEADS)
    for i, j, data, offsets in text_chunks(column):
        data = np.frombuffer(data.tobytes().lower(), np.uint8)
        start, end, first = word_spans(data, offsets, _GAP)
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        sums = byte_sums(data)
        out = np.zeros((len(start), each), np.uint64)
        out[:, 0] = slice_hashes(sums, start, end)
        for k, size in enumerate(HEADS):
            longer = np.flatnonzero(end - start > size)
            out[longer, k + 1] = mix(slice_hashes(sums, start[longer], start[longer] + size), size)
        yield i, j, out.ravel(), first * each, np.repeat(stops[start], each)


def _known(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted vocabulary: (document, number) of each different known word of each document, and all hits in words."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == hashes)
    doc = np.searchsorted(first, hit, "right") - 1
    both = np.unique(doc * len(vocabulary) + at[hit])
    return both // len(vocabulary), both % len(vocabulary), hit


class Model:
    """weights: of the words of the sorted vocabulary, then the constant."""

    def __init__(self, vocabulary: np.ndarray | None = None, weights: np.ndarray | None = None, constant: float = 0.0):
        self.vocabulary, self.weights, self.constant = vocabulary, weights, constant

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.constant)
        if self.vocabulary is not None:
            for i, j, hashes, first, _ in document_words(column):
                doc, number, _ = _known(hashes, first, self.vocabulary)
                z = self.weights[-1] + np.bincount(doc, self.weights[number], j - i)
                out[i:j] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, size: int, swaps: np.ndarray, ridge: float, swap: float, rounds: int = 50) -> np.ndarray:
    """Newton's method on sparse rows of ones. swaps: the matrix of swap_matrix(), of which w' swaps w is the penalty."""
    w, n = np.zeros(size + 1), len(y)
    dense = np.zeros((n, size + 1), np.float32)
    dense[rows, columns] = 1
    dense[:, -1] = 1
    penalty = np.diag([ridge] * size + [1e-6]).astype(float)
    penalty[:size, :size] += swap * swaps
    balance = np.where(y > 0, n / 2 / max(1, y.sum()), n / 2 / max(1, n - y.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(dense @ w, -30, 30)))
        gradient = dense.T @ (balance * (p - y)) + penalty @ w
        curve = (dense * (balance * np.maximum(p * (1 - p), 1e-4))[:, None].astype(np.float32)).T @ dense
        step = np.linalg.solve(curve + penalty, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-4:
            break
    return w


class Terms:
    """Identity terms: their numbers in a vocabulary and which entries each brings to a document, itself and its beginnings."""

    def __init__(self, identity, vocabulary: np.ndarray):
        def of(word: str) -> list[int]:
            (found,) = [h for _, _, h, _, _ in document_words(pa.array([word]))]
            at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
            return sorted(set(at[vocabulary[at] == found].tolist()))

        words = [w for g in identity for w in g]
        self.brings = [of(w) for w in words]
        self.others = [[words.index(o) for o in g if o != w] for g in identity for w in g]
        self.at = {int(np.searchsorted(vocabulary, word_hashes([w])[0])): i for i, w in enumerate(words)}

    def placed(self, number: np.ndarray, term: int) -> list[tuple[int, int, int, int]]:
        """The same for a sentence without terms that gets this one; the other may be none, -1."""
        out = [x for x in self.swapped(np.concatenate([number, self.brings[term]]).astype(np.int64)) if x[0] == term]
        lost = out[0][2] if out else sum(1 << k for k, e in enumerate(self.brings[term]) if e not in set(number.tolist()))
        return [*out, (term, -1, lost, 0)]

    def swapped(self, number: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The exchanges in one sentence, the numbers of its known entries word by word, repeats included.

        Each is (term, other, lost, gained): lost has a bit for each entry of the term that nothing else in the sentence
        brings, gained one for each entry of the other that the sentence lacks without the term.
        """
        every, times = np.unique(number, return_counts=True)
        count, out = dict(zip(every.tolist(), times.tolist())), []
        for entry in count.keys() & self.at.keys():
            term = self.at[entry]
            left = {e: count.get(e, 0) - count[entry] for e in self.brings[term]}
            lost = sum(1 << k for k, e in enumerate(self.brings[term]) if left[e] <= 0)
            for other in self.others[term]:
                out.append((term, other, lost, sum(1 << k for k, e in enumerate(self.brings[other]) if left.get(e, count.get(e, 0)) <= 0)))
        return out

    def change(self, term: int, other: int, lost: int, gained: int, size: int) -> np.ndarray:
        """What the exchange does to the entries of the sentence: -1, 0 or 1 each."""
        out = np.zeros(size)
        for sign, which, bits in ((-1, term, lost), (1, other, gained)):
            for k, e in enumerate(self.brings[which] if which >= 0 else ()):
                out[e] += sign * (bits >> k & 1)
        return out


def swap_matrix(terms: Terms, swaps: list[tuple[int, int, int, int, int]], size: int, by_pair: bool = False) -> np.ndarray:
    """The mean over exchanges (term, other, lost, gained, times) of change x change': w' of it w is the mean squared change of the score.

    by_pair: the sum of such means, one for each pair of term and other.
    """
    out, total = np.zeros((size, size)), Counter()
    for term, other, _, _, times in swaps:
        total[(term, other) if by_pair else None] += times
    for *swap, times in swaps:
        own = terms.change(*swap, size)
        at = np.flatnonzero(own)
        out[np.ix_(at, at)] += np.outer(own[at], own[at]) * (times / total[tuple(swap[:2]) if by_pair else None])
    return out


def sampled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, train: Column | None, sample: int) -> DataFrame:
    """(text, y), written: at most ``sample`` labelled documents, those of the smallest hash of their key, one row a key and label."""
    own = labels.filter(train) if train is not None else labels
    own = own.select(col(key).alias("_k"), col(label).cast("int").alias("_y")).filter("_k is not null and _y is not null").distinct()
    # At most ``sample`` rows of 12 bytes: a bounded broadcast, which spares the texts a shuffle.
    few = own.orderBy(F.xxhash64("_k"), "_k", "_y").limit(sample)
    rows = docs.select(col(key).alias("_k"), col(text).cast("string").alias("text")).join(F.broadcast(few), "_k")
    # Of rows of one id the text of the smallest hash, by an aggregate with a combiner, so that repeats can't outgrow the bound.
    one = rows.groupBy("_k", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.coalesce(F.col("text"), F.lit("")))).alias("text"))
    return staging.table(one.select("text", "_y"), "sample")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", train: Column | None = None, sample: int = SAMPLE, identity=IDENTITY) -> Model:
    """train: over the columns of labels, which rows may be learnt from."""
    staging.reachable(docs.sparkSession)
    rows = sampled(docs, labels, label, key, text, train, sample)

    def count(batches):
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        total = np.zeros(2, np.int64)
        for batch in staging.pieces(batches):
            y = batch.column(1).to_numpy().astype(np.int64) > 0
            total += [(~y).sum(), y.sum()]
            for i, _, hashes, first, _ in document_words(batch.column(0)):
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                order = np.lexsort((hashes, doc))
                h, d = hashes[order], doc[order]
                new = h != 0
                new[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, toxic = h[new], y[i + d[new]]
                names, at = np.unique(h, return_inverse=True)
                parts.append((names, np.bincount(at, ~toxic, len(names)).astype(np.int64), np.bincount(at, toxic, len(names)).astype(np.int64)))
        names, clean, toxic = (np.concatenate(x) for x in zip(*parts))
        names, at = np.unique(names, return_inverse=True)
        none = np.zeros(len(names) + 1, bool)
        none[-1] = True  # the last row counts documents
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(names, np.uint64(0)).view(np.int64), mask=none), pa.array(np.append(np.bincount(at, clean, len(names)), total[0]).astype(float)), pa.array(np.append(np.bincount(at, toxic, len(names)), total[1]).astype(float))], ["h", "clean", "toxic"]
        )

    counts = staging.table(rows.mapInArrow(count, "h long, clean double, toxic double").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "word-counts")
    total = counts.filter("h is null").first()
    if total is None or not total.clean or not total.toxic:
        return Model(constant=float(total is not None and total.toxic > 0))
    p, q = F.col("toxic") / total.toxic, F.col("clean") / total.clean
    both = (F.col("toxic") + F.col("clean")) / (total.toxic + total.clean)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / total.toxic + 1 / total.clean) + F.lit(1e-12))
    chosen = counts.filter(F.col("h").isNotNull() & (F.col("toxic") + F.col("clean") >= LEAST)).orderBy(F.abs(z).desc(), "h").limit(VOCABULARY).select("h").collect()
    vocabulary = np.unique(np.concatenate([np.array([r.h for r in chosen], np.int64).view(np.uint64), *(word_hashes(list(g)) for g in identity)]))
    terms = Terms(identity, vocabulary)

    def known(batches):
        for batch in staging.pieces(batches):
            y, out = batch.column(1).to_pylist(), []
            for i, j, hashes, first, _ in document_words(batch.column(0)):
                doc, number, _ = _known(hashes, first, vocabulary)
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                out += [(y[i + k], number[ends[k] : ends[k + 1]].astype("<u4").tobytes()) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["y", "words"])

    def exchanges(batches):
        times: Counter = Counter()
        for batch in staging.pieces(batches):
            for _, _, hashes, first, sentence in document_words(batch.column(0)):
                _, _, hit = _known(hashes, first, vocabulary)
                number = np.searchsorted(vocabulary, hashes[hit])
                # A sentence is what lies between stops within one document.
                place = np.stack([np.searchsorted(first, hit, "right"), sentence[hit]], 1)
                edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1), [True]])) if len(hit) else [0]
                named = np.isin(number, list(terms.at))
                for a, b in zip(edge[:-1], edge[1:]):
                    if named[a:b].any():
                        times.update((0, *x) for x in terms.swapped(number[a:b]))
                    else:
                        times.update((1, *x) for x in terms.placed(number[a:b], int(number[a:b].sum()) % len(terms.brings)))
        columns = list(zip(*((*k, n) for k, n in times.items()))) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["made", "term", "other", "lost", "gained", "times"])

    found = rows.mapInArrow(known, "y int, words binary").collect()  # at most ``sample`` rows
    # Bounded by the pairs of terms and the entries that each brings, whatever the texts.
    kinds = ("made", "term", "other", "lost", "gained")
    pairs = rows.mapInArrow(exchanges, f"{', '.join(f'{c} long' for c in kinds)}, times long").groupBy(*kinds).agg(F.sum("times").alias("times")).collect()
    words = [np.frombuffer(r.words, "<u4").astype(np.int64) for r in found]
    y = np.array([r.y > 0 for r in found], float)
    at = np.repeat(np.arange(len(words)), [len(x) for x in words])
    pairs = sorted(tuple(r) for r in pairs)
    swaps = swap_matrix(terms, [r[1:] for r in pairs if not r[0]], len(vocabulary))
    empty = [(*x, 1) for t in range(len(terms.brings)) for x in terms.placed(np.zeros(0, np.int64), t)]
    swaps += swap_matrix(terms, [r[1:] for r in pairs if r[0]] + empty, len(vocabulary), by_pair=True)
    weights = logistic(at, np.concatenate([np.zeros(0, np.int64), *words]), y, len(vocabulary), swaps, RIDGE, SWAP)
    return Model(vocabulary, weights)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(the key, score, predicted) for each row."""
    staging.reachable(docs.sparkSession)

    def run(batches):
        for batch in staging.pieces(batches):
            own = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64()), pa.array((own >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(col(key), col(text).cast("string")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, as they are."""
    staging.reachable(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for batch in staging.pieces(batches):
            yield batch.filter(pa.array(model.score(batch.column(place)) < threshold))

    # Under numbers, as names may hold dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)

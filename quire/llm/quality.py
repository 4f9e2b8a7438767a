"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration (operator 1).

The statistics of a document (lengths, character shares, repetition of words, word pairs and lines) are standardised
and mapped to cosines of random projections, whose inner products approximate a Gaussian kernel. Each partition adds up
its part of the normal equations; the sums, of a size fixed by ``FEATURES``, give the ridge solution. Calibration pools
adjacent violators over ``BINS`` sums of labels by score, where each labelled row is scored by a solution from the other
half of the rows (halves by a hash of the key), so that no row calibrates a fit that has seen it.

Cases: a null or empty text has statistics of zero and a score like any other; without labels, or with one class only,
every score is the mean label (0.5 without any); rows of one doc_id share its labels, repeated labels count repeatedly,
null labels not at all; a null doc_id is scored and has no label; texts are whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import staging
from quire.llm.textbytes import byte_sums, prefix_sums, slice_hashes, text_chunks, word_spans

FEATURES, GAMMA, RIDGE, BINS, SEED = 128, 0.05, 1e-3, 2000, 20240301
_KINDS = [range(65, 91), range(97, 123), range(48, 58), [0x20], [10], list(b".,;:"), list(b"!?"), list(b"|#*$%&@<>{}[]=~^_/\\+"), range(128, 256)]
_KIND = np.stack([np.isin(np.arange(256), list(k)) for k in _KINDS], 1).astype(np.float64)
STATISTICS = 3 + len(_KINDS) + 12


def statistics(column: pa.Array):
    """One row of numbers for each text."""
    for i, j, data, offsets in text_chunks(column):
        start, end, first = word_spans(data, offsets)
        hashes = slice_hashes(byte_sums(data), start, end)
        sums, sizes = prefix_sums(hashes), end - start
        at = np.arange(max(0, len(start) - 1))
        pairs = slice_hashes(sums, at, at + 2)
        last = data[end - 1] if len(end) else data[:0]
        odd = (_KIND[last, 6] + _KIND[last, 7]) > 0
        newline = np.flatnonzero(data == 10)
        for k in range(j - i):
            raw, a, b = data[offsets[k] : offsets[k + 1]], first[k], first[k + 1]
            n, words = len(raw), b - a
            counts = np.bincount(raw, minlength=256)
            out = np.zeros(STATISTICS)
            out[:3] = np.log1p(n), np.log1p(words), n / max(words, 1) / 10
            if n:
                share = counts / n
                out[3 : 3 + len(_KINDS)] = share @ _KIND
                some = share[share > 0]
                rest = out[3 + len(_KINDS) :]
                rest[0] = -(some * np.log(some)).sum()
            if words:
                own, own_sizes = hashes[a:b], sizes[a:b]
                _, repeats = np.unique(own, return_counts=True)
                rest[1], rest[2] = len(repeats) / words, repeats.max() / words
                rest[3] = len(np.unique(pairs[a : b - 1])) / (words - 1) if words > 1 else 1
                rest[4], rest[5] = own_sizes.mean() / 10, own_sizes.std() / 10
                rest[6] = odd[a:b].mean()
                rest[7] = (repeats == 1).sum() / len(repeats)
                cuts = newline[np.searchsorted(newline, offsets[k]) : np.searchsorted(newline, offsets[k + 1])]
                bounds = np.searchsorted(start[a:b], cuts) + a
                begin, stop = np.concatenate([[a], bounds]), np.concatenate([bounds, [b]])
                full = stop > begin
                lines = slice_hashes(sums, begin[full], stop[full])
                rest[8], rest[9] = np.log1p(len(lines)), np.log1p(words / len(lines))
                rest[10] = len(np.unique(lines)) / len(lines)
                rest[11] = np.isin(data[end[stop[full] - 1] - 1], list(b".!?")).mean()
            yield out


class Fourier:
    """Standardised statistics as cosines; the last column is the constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, gamma: float = GAMMA):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1)
        self.turn = rng.standard_normal((len(mean), features)) * np.sqrt(2 * gamma)
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(rows), 1))], axis=1)


def isotonic(score: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing values nearest to total / weight, by pooling adjacent violators. score: ascending."""
    blocks: list[list[float]] = []
    for t, w in zip(total.tolist(), weight.tolist()):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + n]
    return np.repeat([t / w for t, w, _ in blocks], [n for _, _, n in blocks])


class Model:
    """A fitted scorer; without a solution every score is the mean label."""

    def __init__(self, mean_label: float = 0.5, fourier: Fourier | None = None, solution: np.ndarray | None = None):
        self.mean_label, self.fourier, self.solution = mean_label, fourier, solution
        self.at, self.value = np.array([0.5]), np.array([mean_label])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.fourier(rows) @ self.solution

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.solution is None:
            return np.full(len(rows), self.mean_label)
        return np.clip(np.interp(self.raw(rows), self.at, self.value), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, STATISTICS).astype(np.float64)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(the key, stats): the statistics of each document, as binary."""
    staging.reachable(docs.sparkSession)

    def run(batches):
        for batch in staging.pieces(batches):
            raw = [x.astype("<f4").tobytes() for x in statistics(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [key, "stats"])

    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, stats binary")


def fold_of(key: Column) -> Column:
    """The half of the labelled rows that a key belongs to."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(2)).cast("int")


def _sums(rows: DataFrame, make) -> np.ndarray:
    """Adds up make(statistics, labels, half), a vector of fixed length, over all partitions."""

    def run(batches):
        total = 0
        for batch in staging.pieces(batches):
            if batch.num_rows:
                total = total + make(_matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.float64), batch.column(2).to_numpy())
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])

    found = rows.select("stats", "y", "half").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r.i] = r.x
    return out


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", train: Column | None = None) -> Model:
    """From all labelled rows of ``measured`` (a table, as it is read several times) for which ``train`` holds."""
    staging.reachable(measured.sparkSession)
    own = labels.select(labels[key].alias("_k"), labels[label].cast("double").alias("y")).filter(F.col("y").isNotNull())
    rows = measured.filter(train) if train is not None else measured
    rows = staging.table(rows.join(own, rows[key] == own["_k"]).select("stats", "y", fold_of(F.col("_k")).alias("half")), "labelled")
    first = _sums(rows, lambda x, y, half: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(first):
        return Model()
    n, positive = first[:2]
    if positive in (0, n):
        return Model(positive / n)
    mean = first[2 : 2 + STATISTICS] / n
    fourier = Fourier(mean, np.sqrt(np.maximum(0, first[2 + STATISTICS :] / n - mean**2)))
    upper = np.triu_indices(FEATURES + 1)

    def equations(x, y, half):
        phi = fourier(x)
        return np.concatenate([np.concatenate([[len(p)], (p.T @ p)[upper], p.T @ t]) for p, t in ((phi[half == k], y[half == k]) for k in (0, 1))])

    def solved(sums):
        gram = np.zeros((FEATURES + 1, FEATURES + 1))
        gram[upper] = sums[1 : 1 + len(upper[0])]
        gram = gram + np.triu(gram, 1).T + np.diag([RIDGE * sums[0] / FEATURES] * FEATURES + [0])
        return np.linalg.solve(gram, sums[1 + len(upper[0]) :])

    halves = _sums(rows, equations).reshape(2, -1)
    model = Model(positive / n, fourier, solved(halves.sum(0)))
    # A half without rows, as with very few labels, is scored by the solution from all.
    other = np.stack([solved(h) if h[0] else model.solution for h in halves[::-1]])

    def binned(x, y, half):
        raw = np.einsum("nf,nf->n", fourier(x), other[half])
        at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    third = _sums(rows, binned)
    weight, total = third[:BINS], third[BINS:]
    some = np.flatnonzero(weight)
    model.at, model.value = (some + 0.5) / BINS * 2 - 0.5, isotonic(some, total[some], weight[some])
    return model


def score(measured: DataFrame, model: Model, key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(the key, score, predicted) for each row."""

    def run(batches):
        for batch in staging.pieces(batches):
            if batch.num_rows:
                own = model.score(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64()), pa.array((own >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return measured.select(key, "stats").mapInArrow(run, f"`{key}` {measured.schema[key].dataType.simpleString()}, score double, predicted int")

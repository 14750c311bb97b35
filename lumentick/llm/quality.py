"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian density whose covariance is shrunk towards the pooled one and a multiple of
the identity. The score is the posterior of label 1, from the difference of log-densities; Mahalanobis
distances use the Cholesky factors, which are computed once on the driver and kept with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_mod, mix, slices, stored

_KINDS = 7
#: Byte classes: 1 upper case, 2 symbols, 3 exclamation and question marks, 4 digits, 5 sentence punctuation, 6 line feeds.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
for _c in b"#*$%&|<>@^~=+_\\{}[]":
    _CLASS[_c] = 2
for _c in b"!?":
    _CLASS[_c] = 3
_CLASS[48:58] = 4
for _c in b".,;:":
    _CLASS[_c] = 5
_CLASS[10] = 6

FEATURES = ("upper", "symbols", "marks", "digits", "punctuation", "lines", "word_length", "adjacent", "distinct", "repeated")


def features(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics a text; ratios are pulled to a usual value where a text is short."""
    w = Words(column)
    n = len(column)
    rows = np.repeat(np.arange(n), np.diff(w.offsets))
    kind = _CLASS[w.buf].astype(np.int64)
    # Capital letters of two bytes (U+00C0 to U+00DE) are capitals too.
    if len(w.buf) > 1:
        kind[1:][(w.buf[:-1] == 0xC3) & (w.buf[1:] >= 0x80) & (w.buf[1:] <= 0x9E)] = 1
    count = np.bincount(rows * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    size = np.diff(w.offsets).astype(float)
    words = np.diff(w.bounds).astype(float)
    h = w.hashes()
    of = np.repeat(np.arange(n), np.diff(w.bounds))
    same = np.zeros(len(h), dtype=bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    adjacent = np.bincount(of, weights=same, minlength=n)
    salted = mix(h ^ mix(of.astype(np.uint64)))
    distinct = np.bincount(of[np.unique(salted, return_index=True)[1]], minlength=n)
    two = mix(salted[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else salted[:0]
    inside = of[1:] == of[:-1] if len(h) > 1 else np.zeros(0, bool)
    two, at = two[inside], of[:-1][inside] if len(h) > 1 else of[:0]
    fresh = np.bincount(at[np.unique(two, return_index=True)[1]], minlength=n)
    pairs = np.bincount(at, minlength=n)

    def rate(c, total, usual, weight):
        return np.log((c + usual * weight + 0.25) / (total + weight))

    return np.column_stack(
        [
            rate(count[:, 1], size, 0.015, 200), rate(count[:, 2], size, 0.0, 200), rate(count[:, 3], size, 0.001, 200), rate(count[:, 4], size, 0.001, 200), rate(count[:, 5], size, 0.016, 200),
            rate(count[:, 6], size, 0.003, 300), np.log((size + 6 * 40) / (words + 40)), rate(adjacent, words, 0.005, 40), rate(distinct, words, 0.8, 40), rate(pairs - fresh, pairs, 0.03, 40),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and log priors."""

    mean: np.ndarray
    factor: np.ndarray
    prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row."""
        log = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T) if len(x) else np.zeros((x.shape[1], 0))
            log.append(self.prior[k] - np.log(np.diag(self.factor[k])).sum() - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float, ridge: float, floor: float = 0.02) -> Discriminant:
    """moments: count, sum and sum of outer products by class; a class without rows takes the other's shape.

    ``pool`` is the weight of the pooled covariance, ``ridge`` that of the identity times the mean variance.
    """
    d = len(FEATURES)
    n = np.array([moments.get(k, (0.0,))[0] for k in (0, 1)])
    if not n.sum():
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.log([0.5, 0.5]))
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        c, s, q = moments[k] if n[k] else moments[1 - k]
        mean[k] = s / c
        cov[k] = q / c - np.outer(mean[k], mean[k])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factor = []
    for k in (0, 1):
        s = (1 - pool) * cov[k] + pool * pooled
        s = (1 - ridge) * s + (ridge * np.trace(pooled) / d + floor * floor) * np.eye(d)
        factor.append(np.linalg.cholesky(s))
    return Discriminant(mean, np.stack(factor), np.log((n + 1) / (n.sum() + 2)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the features ``x`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = features(part.column("text"))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "x"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, x array<double>")


def train(stats: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, pool: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit on every labelled row whose crc32(doc_id as text) mod ``folds`` is not ``held``.

    Only count, sums and sums of products by class reach the driver, added up by Spark.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", folds) != held)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    d = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            y = np.asarray(batch.column("quality"))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        i = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel())], names=["i", "v"])

    sums = stats.join(known, "doc_id").select("x", "quality").mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in sums:
        total[r["i"]] = r["v"]
    total = total.reshape(2, -1)
    return fit({k: (t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for k, t in enumerate(total) if t[0] > 0}, pool, ridge)


def scored(stats: DataFrame, model: Discriminant, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    out = stats.select("doc_id", "x").mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; learns from ``labels.quality``.

    Defined results: null and empty texts are scored from the statistics of an empty text; labels that
    are null or neither 0 nor 1, and labels of unknown ids, teach nothing; without any label all scores
    are 0.5; a null id is in the fold of the empty text; repeated rows get equal scores; an empty table
    gives an empty result. The features come from ``text`` alone.
    """
    stats = stored(statistics(docs), "statistics")
    return scored(stats, train(stats, labels))


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are."""
    model = train(stored(statistics(docs), "statistics"), labels)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part.filter(pa.array(model.score(features(part.column("text"))) >= threshold))

    return docs.mapInArrow(run, schema)

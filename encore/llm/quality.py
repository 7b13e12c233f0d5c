"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import slices, stored
from encore.llm.statistics import NAMES, statistics

#: Share of the pooled covariance, and of a multiple of the unit matrix, in each class's covariance.
TO_POOLED, TO_UNIT = 0.5, 0.1
#: Labelled rows that good_rows learns from, about, where there are more.
SAMPLE = 100_000


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant. A class without rows is None."""

    classes: tuple

    @classmethod
    def from_moments(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
        """From each class's row count, sum and sum of outer products."""
        total = sum(m[0] for m in moments.values())
        centred = {}
        for label, (n, s, ss) in moments.items():
            mean = s / n
            centred[label] = n, mean, ss / n - np.outer(mean, mean)
        pooled = sum(n * c for n, _, c in centred.values()) / total if total else None
        out: list = [None, None]
        for label, (n, mean, cov) in centred.items():
            cov = (1 - TO_POOLED - TO_UNIT) * cov + TO_POOLED * pooled
            # a unit of each statistic is its own pooled variance
            cov = cov + np.diag(TO_UNIT * np.maximum(np.diag(pooled), 1e-4) + 1e-6)
            factor = np.linalg.cholesky(cov)
            out[label] = np.log(n / total), mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()
        return cls(tuple(out))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; without rows of either class 0.5, without rows of one the other's."""
        if self.classes[0] is None or self.classes[1] is None:
            only = 0.5 if self.classes == (None, None) else float(self.classes[1] is not None)
            return np.full(len(x), only)
        density = []
        for prior, mean, inverse, logdet in self.classes:
            z = (x - mean) @ inverse.T
            density.append(prior - 0.5 * (np.einsum("ij,ij->i", z, z) + logdet))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def labelled(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label) to learn from: one row per id (the majority of repeated ones), without held-out and null ones."""
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder)
    )
    return rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of rows with doc_id and text; needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(part.column("text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: rows (label, k, value) of 1, x and the outer products of x."""
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, y = _matrix(batch.column("x")), batch.column("label").to_numpy()
        for label in (0, 1):
            own = x[y == label]
            sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
    width = sums.shape[1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), 2)), pa.array(sums.reshape(-1))],
        names=["label", "k", "value"],
    )


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Class means and covariances from all labelled rows: tasks add up moments, 1 + d + d*d numbers a class reach the driver."""
    rows = stats.join(labels, "doc_id").select("label", "x")
    sums = rows.mapInArrow(_moments, "label int, k int, value double").groupBy("label", "k").agg(F.sum("value").alias("value")).collect()
    d = len(NAMES)
    flat = np.zeros((2, 1 + d + d * d))
    for r in sums:
        flat[r.label, r.k] = r.value
    moments = {c: (f[0], f[1 : 1 + d], f[1 + d :].reshape(d, d)) for c, f in enumerate(flat) if f[0]}
    return Discriminant.from_moments(moments)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Probability that each document is of quality 1.

    Twenty statistics of the whole text (word counts and lengths, shares of kinds of characters, words
    and lines, repetition), transformed towards normality, feed a quadratic discriminant whose
    class covariances shrink towards the pooled one and its diagonal; scores are differences of
    Mahalanobis log-densities, from Cholesky factors inverted once. It learns from ``labels``
    (doc_id, quality) outside the held-out third.

    Returns doc_id, held_out, score, predicted. Null and empty texts are scored as texts without
    words; a null doc_id is neither held out nor learnt from; without labels of both kinds the
    score is constant (0.5 without any); repeated rows are scored each. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stats = stored(document_statistics(rows), "quality-statistics")
    model = fit(stats, labelled(labels, "quality", 3, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def sampled(labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """About ``rows`` rows of (doc_id, label), all if there are no more: those whose id hashes low enough.

    The bound follows from the count, so no row is moved or sorted to draw the sample.
    """
    share = min(1.0, rows / max(1, labels.count()))
    return labels if share == 1 else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))


def good_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (columns doc_id and text among them) that the classifier does not reject, all columns kept.

    It learns as score_quality does, from about ``sample`` labelled rows at most (their ids are broadcast, the
    bound is theirs): the statistics of other texts are computed once, to filter, and no text is
    shuffled. Null and empty texts are judged as texts without words; repeated rows are judged each;
    without labels of both kinds no row (0.5 or all 1) or every row (all 0) goes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = sampled(stored(labelled(labels, "quality", 3, 1), "quality-labels"), sample)
    taught = document_statistics(rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"))
    model = fit(taught, F.broadcast(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(statistics(part.column("text"))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)

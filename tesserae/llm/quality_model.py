"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .bpe import in_slices
from .common import field, fold, stored, whole
from .host_rules import repeated_words

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
MARKS, PIPES, ENDS, LOUD = b"#*$%&<>~^\\=_{}[]@", b"|", b".,;:?", b"!"

#: The statistics, in the order of the vector.
STATISTICS = (
    "log_chars", "log_words", "log_word_length", "log_deflated", "entropy", "marks", "pipes", "loud", "upper", "digits", "ends",
    "distinct", "top_word", "same_as_before", "repeats", "same_lines", "short_words", "line_length",
)


def _logit(part: float, whole: float) -> float:
    """Of a share, smoothed by half a case so that 0 and 1 stay finite and long texts may tell smaller shares."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str) -> list[float]:
    """Statistics of a whole text on scales on which they are roughly normal: logarithms and logits of smoothed shares."""
    data = text.encode("utf-8", "surrogatepass")
    words, size = data.split(), len(data)
    n, count = len(words), Counter(words)
    without = lambda chars: size - len(data.translate(None, chars))
    upper, lower = without(UPPER), without(LOWER)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(size, 1)
    share = share[share > 0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(size),
        math.log1p(n),
        math.log1p(sum(map(len, words)) / max(n, 1)),
        math.log((len(zlib.compress(data, 1)) + 8) / (size + 8)),
        float(-(share * np.log2(share)).sum()),
        _logit(without(MARKS), size),
        _logit(without(PIPES), size),
        _logit(without(LOUD), size),
        _logit(upper, upper + lower),
        _logit(without(DIGIT), size),
        _logit(without(ENDS), n),
        _logit(len(count), n),
        _logit(max(count.values(), default=0), n),
        _logit(sum(map(operator.eq, words, words[1:])), n),
        _logit(repeated_words(words), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(sum(c for w, c in count.items() if len(w) < 4), n),
        math.log1p(size / max(len(lines), 1)),
    ]


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array<double>): :func:`statistics` of every row's whole text, a null text counting as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            ends = np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two normal densities. Scores are posteriors; without both classes every score is ``share``, that of class 1 in training."""

    share: float
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    clip: float = 8.0

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """For each class the inverse of the covariance's Cholesky factor, and the log of the factor's determinant; computed once a worker."""
        found = [np.linalg.cholesky(c) for c in self.covariances]
        return [(np.linalg.inv(f), float(np.log(np.diag(f)).sum())) for f in found]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        z = np.clip((x - self.centre) / self.scale, -self.clip, self.clip)
        density = [-0.5 * (((z - m) @ inverse.T) ** 2).sum(axis=1) - log_det for m, (inverse, log_det) in zip(self.means, self.factors, strict=True)]
        odds = density[1] - density[0] + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


#: Shrinkages to choose from, and the folds of the training rows that choose.
SHRINKAGES, FOLDS = (0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8), 4


def moments(labelled: DataFrame) -> np.ndarray:
    """By fold and class: rows, sums and sums of products of the vectors, added up by Spark; FOLDS * 2 * (1 + d + d * d) numbers reach the driver."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, 1 + d + d * d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            y, part = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in range(FOLDS):
                for k in (0, 1):
                    own = x[(y == k) & (part == f)]
                    total[f, k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    found = np.zeros(FOLDS * 2 * (1 + d + d * d))
    for r in labelled.select("x", "label", "fold").mapInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        found[r.place] = r.value
    return found.reshape(FOLDS, 2, -1)


def discriminant(found: np.ndarray, shrinkage: float, ridge: float = 1e-3) -> Discriminant:
    """From the moments of both classes.

    A class covariance is pulled by ``shrinkage`` towards the pooled one and its diagonal, in equal parts, after scaling by the pooled
    deviations, and gets ``ridge`` on the diagonal.
    """
    d = len(STATISTICS)
    n, total, square = found[:, 0], found[:, 1 : d + 1], found[:, d + 1 :].reshape(2, d, d)
    if n.min() < 2:
        return Discriminant(float((n[1] + 0.5) / (n.sum() + 1)), np.zeros(d), np.ones(d), np.zeros((0, d)), np.zeros((0, d, d)))
    means = total / n[:, None]
    within = square - n[:, None, None] * means[:, :, None] * means[:, None, :]
    centre = total.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(within.sum(axis=0)) / (n.sum() - 2), 1e-12))
    scaled = within / scale[:, None] / scale
    pooled = scaled.sum(axis=0) / (n.sum() - 2)
    towards = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
    covariances = [(1 - shrinkage) * c / (k - 1) + shrinkage * towards + ridge * np.eye(d) for c, k in zip(scaled, n, strict=True)]
    return Discriminant(float(n[1] / n.sum()), centre, scale, (means - centre) / scale, np.array(covariances))


def fit(labelled: DataFrame, shrinkage: float | None = None, worst: float = 1e-3) -> Discriminant:
    """From rows (x, label 0/1), all of them; rows with a null label or vector don't count.

    Without a ``shrinkage``, the one is taken whose models of all folds but one have the least logarithmic loss on the fold that they lack,
    a probability under ``worst`` counting as that. No row outside of ``labelled`` has a say.
    """
    part = F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = labelled.select("x", F.col("label").cast("long").alias("label"), part).filter("x is not null and label in (0, 1)")
    found = moments(rows)
    whole = found.sum(axis=0)
    if shrinkage is None and whole[:, 0].min() >= 2:
        models = [[discriminant(whole - own, s) for s in SHRINKAGES] for own in found]

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(SHRINKAGES))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, len(STATISTICS))
                y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for f, by_shrinkage in enumerate(models):
                    own = fold == f
                    for k, model in enumerate(by_shrinkage):
                        p = model.scores(x[own])
                        total[k] -= np.log(np.maximum(np.where(y[own] == 1, p, 1 - p), worst)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "loss"])

        seen = rows.mapInArrow(losses, "place long, loss double").groupBy("place").agg(F.sum("loss").alias("loss")).collect()
        shrinkage = SHRINKAGES[min(seen, key=lambda r: (round(r.loss, 6), r.place)).place]
    return discriminant(whole, shrinkage or SHRINKAGES[0])


def _marks(labels: DataFrame, label_col: str) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")).filter("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 5, limit: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out (crc32 of the id modulo ``held_out`` is 0), score (0 to 1) and predicted (score >= limit).

    Only rows that are not held out and have a label train the model. A null text counts as empty, a null id as the empty text in the
    checksum; null labels don't count, of several labels of one id the largest does, and repeated rows train and score each. Without
    labels of both classes every score is the training share of class 1 (0.5 without any). Other columns are ignored.
    """
    scored = stored(vectors(docs, id_col, text_col), "statistics").withColumn("held_out", fold("doc_id", held_out) == 0)
    model = fit(stored(scored.filter("not held_out").join(_marks(labels, label_col), "doc_id").select("x", "label"), "labelled"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return scored.select("doc_id", "held_out", "x").mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 5, limit: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the classifier of :func:`quality_scores` rejects; columns unchanged.

    Every row is judged by its own text, whatever its id. Rows lie in the shared folder with their statistics, which are computed once; only
    ids and statistics are joined to the labels, so no text is shuffled.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            ends = np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc", "x"])

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.scores(batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))) >= limit
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], ["doc"])

    rows = docs.select(whole(docs), F.col(text_col).cast("string").alias("text"))
    doc = rows.schema["doc"]
    rows = stored(rows.mapInArrow(described, StructType([doc]).add("x", ArrayType(DoubleType()))), "quality-rows")
    training = rows.select(field(id_col).cast("long").alias("doc_id"), "x").filter(fold("doc_id", held_out) != 0)
    model = fit(stored(training.join(_marks(labels, label_col), "doc_id").select("x", "label"), "labelled"))
    return rows.mapInArrow(accepted, StructType([doc])).select("doc.*")

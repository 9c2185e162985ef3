"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader updates.

The model is fitted on a bounded sample of labelled rows, which one pass over the documents turns into sparse vectors;
the driver then runs the updates in a fixed order. Scoring is one pass without a shuffle: a text's score is the logistic
of the sparse dot product of its n-gram frequencies with the weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_and_text, per_row, texts_of
from tessera.llm.grams import WordTable

DIMENSIONS = 1 << 18
#: At most so many labelled rows of either label are learned from: those whose id has the least hash.
SAMPLE = 4_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
#: A text's feature values have this length (L2).
SCALE = 3.0


def vector(grams: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: buckets, and the square roots of their counts, scaled to a fixed length."""
    at, count = np.unique((grams % np.uint64(dimensions)).astype(np.int64), return_counts=True)
    value = np.sqrt(count.astype(np.float64))
    return at, value * (SCALE / max(1e-9, float(np.sqrt((value * value).sum()))))


def labelled(labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, fold: tuple[int, int] = (5, 0)) -> list[tuple[int, int]]:
    """(doc_id, label) of a bounded sample outside the held-out fold, in the order in which it is learned."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] != fold[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = [rows.where(f"label = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    return sorted((tuple(r) for r in picked[0].union(picked[1]).select("doc_id", "label").collect()), key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0]))


def sample_vectors(docs: DataFrame, ids: Iterable[int], dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, at, value (int32 and float32 arrays as bytes) of the rows of ``docs`` whose id is among the bounded ``ids``."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wanted = WordTable(), sent.value
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if doc_id in wanted:
                    at, value = vector(words.features(words.rows((text or "").encode("utf-8", "replace").split())), dimensions)
                    for column, x in zip(out, (doc_id, at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["doc_id", "at", "value"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, at binary, value binary")


class FTRL:
    """Follow-the-regularised-leader with per-coordinate rates (FTRL-Proximal) for logistic loss; the last weight is the bias."""

    def __init__(self, dimensions: int):
        self.z, self.n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ value)) - label) * weight * value
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The weights, bias last; both labels weigh the same in all. Without any labelled document all weights are 0."""
    rows = labelled(labels, label_col, sample)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    vectors = sample_vectors(docs, [i for i, _ in rows], dimensions).groupBy("doc_id").agg(F.min(F.struct("at", "value")).alias("v")) if rows else None
    for r in vectors.collect() if rows else []:  # at most twice the sample's bound; of rows that repeat an id, one
        found[r["doc_id"]] = np.frombuffer(r["v"]["at"], np.int32), np.frombuffer(r["v"]["value"], np.float32).astype(float)
    rows = [(i, y) for i, y in rows if i in found]
    share = [max(1, sum(y == k for _, y in rows)) for k in (0, 1)]
    model = FTRL(dimensions)
    for _ in range(EPOCHS):
        for i, y in rows:
            model.learn(*found[i], y, len(rows) / 2 / share[y])
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row; a null or empty text scores the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        words, w = WordTable(), sent.value

        def of(text: str | None) -> tuple:
            at, value = vector(words.features(words.rows((text or "").encode("utf-8", "replace").split())), len(w) - 1)
            p = sigmoid(float(w[at] @ value + w[-1]))
            return p, int(p >= threshold)

        return of

    return per_row(id_and_text(docs), make, [("score", T.DoubleType()), ("predicted", T.IntegerType())])


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Only text is an input of the score. Labels are read outside the held-out fold (crc32 of the id as text, mod 5, is 0)
    only; a document labelled twice counts as 1 if any label is. Null ids are never learned from and not held out;
    repeated rows are scored as often as they stand; an empty table gives an empty one.
    """
    scored = score(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")

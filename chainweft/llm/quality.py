"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.llm.text import CACHED_LENGTH, CACHED_WORDS, TASK_TABLES, WordHashes, bounded_labels, held_out, mixed, sliced

#: Size of the weight vector: n-grams are hashed into so many places.
PLACES = 1 << 18
#: Bound of the training sample: labelled rows in hash order of their id.
MAX_TRAINING_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCALE = 8.0


def _shape(word: bytes) -> bytes:
    """The outline of a whole word: a for lower, A for upper case, 9 for digits, signs as they are; runs count once."""
    return _short_shape(word) if len(word) <= 64 else _outline(word)


def _outline(word: bytes) -> bytes:
    out: list[str] = []
    for c in word.decode("utf-8", "ignore"):
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out).encode()


#: Long words stay out of the cache.
_short_shape = lru_cache(maxsize=20_000)(_outline)


class _Shapes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        value = WordHashes.__missing__(_PLAIN, _shape(word))
        if len(self) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
            self[word] = value
        return value


_PLAIN, _SHAPES = WordHashes(), _Shapes()
TASK_TABLES.extend((_PLAIN, _SHAPES))


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's n-grams: words (1, 2) and word outlines (1, 2, 3).

    A value is the n-gram's share of its kind times ``SCALE``. Every text also has one constant.
    """
    found = text.split() if text else []
    places, values = [np.zeros(1, np.int64)], [np.ones(1)]
    if found:
        word, shape = _PLAIN.of(found), _SHAPES.of(found)
        for kind, (base, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
            if len(base) < n:
                continue
            gram = np.full(len(base) - n + 1, kind, np.uint64)
            for k in range(n):
                gram = mixed(gram * np.uint64(31) + base[k : len(base) - n + 1 + k])
            places.append((gram % np.uint64(PLACES - 1)).astype(np.int64) + 1)
            values.append(np.full(len(gram), SCALE / len(gram)))
    return np.concatenate(places), np.concatenate(values)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of follow-the-regularised-leader over ``rows`` in order."""
    z, n = np.zeros(PLACES), np.zeros(PLACES)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> np.ndarray:
    """Weights learnt from at most ``max_rows`` labelled documents that are not held out.

    Of rows that share an id the least text is taken, so the sample has a fixed bound and one task
    sees it whole; the result is ``PLACES`` numbers at most.
    """
    chosen = bounded_labels(labels, "quality", ~held_out(F.col("doc_id"), 4, 2), max_rows)
    sample = (
        documents.select("doc_id", F.col("text").cast("binary").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
        .select("text", "label", "place")
    )

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, xs = [], []
            for text in batch.column("text").to_pylist():
                places, values = features(text)
                own, where = np.unique(places, return_inverse=True)
                at.append(own.astype(np.int32))
                xs.append(np.bincount(where, values).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("label"), batch.column("text"), pa.array(at, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))],
                ["place", "label", "text", "at", "x"],
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, at, x in zip(batch.column("label").to_pylist(), batch.column("at"), batch.column("x"), strict=True):
                rows.append((at.values.to_numpy(), x.values.to_numpy().astype(float), label))
        w = ftrl(rows) if rows else np.zeros(PLACES)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used])], ["at", "w"])

    learnt = (
        sample.mapInArrow(folded, "place long, label int, text binary, at array<int>, x array<float>")
        .groupBy("place", "label").agg(F.min(F.struct(F.col("text").isNull(), "text", "at", "x")).alias("least")).select("place", "label", "least.at", "least.x")
        .repartitionByRange(1, "place", "at").sortWithinPartitions("place", "at", "x")
        .mapInArrow(fitted, "at long, w double")
    )
    weights = np.zeros(PLACES)
    for at, w in learnt.collect():  # PLACES rows at most
        weights[at] = w
    return weights


def scored(documents: DataFrame, weights: np.ndarray, column: str = "quality_score") -> DataFrame:
    """``documents`` with the probability of good quality of each whole text.

    A null or empty text is scored by the constant alone. Columns that are there stay as they
    are; a column that already has the name of the result is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # PLACES numbers

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        w = shared.value
        out = []
        for text in texts:
            at, x = features(text)
            out.append(1 / (1 + np.exp(-np.clip(float(w[at] @ x), -35, 35))))
        return pd.Series(out, dtype=float)

    return documents.withColumn(column, score(F.col("text").cast("binary")))


def passing(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns they came with."""
    mark = "__quality__"
    return scored(documents, train(documents, labels, max_rows), mark).where(F.col(mark) >= threshold).drop(mark)

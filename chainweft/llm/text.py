"""Words, shingles and small Spark helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept with their hash in a worker, the first to come; others are hashed each time.
CACHED_WORDS, CACHED_LENGTH = 100_000, 32
#: Rows that a worker turns into Python objects at once.
SLICE_ROWS = 500

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: Tables that fill up while a task runs; a worker outlives its tasks and must not keep them.
TASK_TABLES: list[dict] = []


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``SLICE_ROWS`` at most, so that a worker stays small; empties ``TASK_TABLES`` at the end."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
        del batch
        pa.default_memory_pool().release_unused()
    for kept in TASK_TABLES:
        kept.clear()
    release()


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; none for a null text."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
            self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


#: The hashes of lower-case words that a worker knows, for all operators.
WORDS = WordHashes()
TASK_TABLES.append(WORDS)


_SHIFTS, _FACTORS = np.array([30, 27, 31], np.uint64), np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = values >> _SHIFTS[0]
    x ^= values
    x *= _FACTORS[0]
    y = x >> _SHIFTS[1]
    x ^= y
    x *= _FACTORS[1]
    np.right_shift(x, _SHIFTS[2], out=y)
    x ^= y
    return x


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; a shorter text is one run, no word none."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(n, width)
    places = np.arange(span)
    # all places of a run at once: numpy's calls cost more than their work on short texts
    lanes = mixed(hashes[None, :] + (places + 1).astype(np.uint64)[:, None])
    lanes *= _ODD[places % len(_ODD)][:, None]
    out = lanes[0, : n - span + 1] + np.uint64(span)
    for k in range(1, span):
        out += lanes[k, k : n - span + 1 + k]
    return mixed(out)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` at most for the jobs that run inside, for rows that hold large arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_labels(labels: DataFrame, column: str, learn: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (``doc_id``, ``label``, ``place``), the first in hash order.

    Rows without an id or a label are left out; a document with several labels takes the greatest.
    """
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64("doc_id", F.lit(17)))
        .orderBy("place", "doc_id").limit(rows)
    )

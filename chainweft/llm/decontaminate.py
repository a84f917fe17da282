"""Benchmark decontamination: size-partitioned MinHash search for short items in long documents.

The Jaccard similarity of a short item and a long document is near nothing, so MinHash alone
cannot find it. Items are therefore partitioned by size (powers of two), and for each
partition of up to U shingles a document is read as windows of 2U shingles that step by U:
every run of U shingles lies in some window, and an item that the window contains by 0.8 has a
Jaccard similarity of at least 0.19 with it. With ``HASHES`` = 64 values compared one by one,
such a window is missed with a probability below 2 in a million. Candidates are verified by
exact containment: how many of the item's distinct shingles the whole document has.

Documents send only what may matter: the values of their windows go through a bitmap of fixed
size that holds the items' values, and only documents with a hit send rows at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.llm.text import WORDS, batches_of, mixed, shingles, sliced, words
from chainweft.session import materialise

HASHES = 64
#: Bits of the two bitmaps; their size does not depend on the tables.
BITS = 1 << 26
_BUCKET = 32_768  # bits in a bucket of Spark's bitmap functions

_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(text: bytes | None) -> np.ndarray:
    return shingles(WORDS.of(words(text)))


def _upper(n: int) -> int:
    """The largest size in the partition of an item with ``n`` shingles."""
    return 1 << (n - 1).bit_length()


@cache
def _kind(upper: int) -> np.ndarray:
    return mixed(np.arange(HASHES, dtype=np.uint64) * np.uint64(64) + np.uint64(upper.bit_length()))


def _keys(least: np.ndarray, upper: int) -> np.ndarray:
    """Keys of MinHash values (``HASHES`` columns), apart for each partition and hash; the values are spread already."""
    return least ^ _kind(upper)


def _least(rows: np.ndarray, size: int) -> np.ndarray:
    """The least values of each ``size`` rows, of the rest at the end too."""
    whole = len(rows) // size * size
    parts = [rows[:whole].reshape(-1, size, rows.shape[1]).min(axis=1)] if whole else []
    return np.concatenate([*parts, rows[whole:].min(axis=0, keepdims=True)]) if whole < len(rows) else parts[0]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, upper, own, keys = [], [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            runs = _runs(text)
            if len(runs):
                ids.append(item)
                upper.append(_upper(len(runs)))
                own.append(np.unique(runs).view(np.int64))
                least = np.array([(runs * a).min() for a in _A], np.uint64)
                keys.append(_keys(least, upper[-1]).ravel().view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(upper, pa.int32()), pa.array(own, longs), pa.array(keys, longs)],
            ["item_id", "upper", "own", "keys"],
        )


def _bitmap(values: DataFrame) -> np.ndarray:
    """Bits of the column ``value``; at most BITS / 8 bytes come to the driver."""
    bit = F.pmod(F.col("value"), F.lit(BITS)) + 1  # Spark numbers bits from 1
    rows = values.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in rows.collect():
        at = (bucket - 1) * _BUCKET // 8
        out[at : at + len(bits)] |= np.frombuffer(bytes(bits), np.uint8)
    return out


def _holds(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(BITS - 1)
    return (bitmap[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _searched(key_bits, own_bits, uppers: list[int]):  # noqa: ANN001, ANN202
    def hits(runs: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        found = []
        part = max(uppers) * max(1, 4096 // max(uppers))  # a multiple of every step; parts overlap by a window
        for at in range(0, len(runs), part):
            own = runs[at : at + part + 2 * max(uppers)]
            blocks, size = own[:, None] * _A[None, :], 1
            for upper in uppers:  # ascending powers of two: blocks of a size are made of the smaller ones
                blocks, size = _least(blocks, upper // size), upper
                least = np.minimum(blocks[1:], blocks[:-1]) if len(blocks) > 1 else blocks
                found.append(_keys(least, upper).ravel())
        keys = np.concatenate(found) if found else runs[:0]
        return np.unique(keys[_holds(bitmap, keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in sliced(batches):
            rows, keys, own = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                runs = _runs(text)
                if len(runs) and len(found := hits(runs, key_bits.value)):
                    rows.append(k)
                    keys.append(found.view(np.int64))
                    mine = np.unique(runs)
                    own.append(mine[_holds(own_bits.value, mine)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ident").take(pa.array(rows, pa.int64())), batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(keys, longs), pa.array(own, longs)],
                ["ident", "doc_id", "keys", "hits"],
            )

    return run


def _ident() -> Column:
    """What tells documents apart: the id, or the text of those without one."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("#"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))


def contaminations(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs ``ident``, ``doc_id``, ``item_id``, ``n_item``, ``n_found``, ``containment`` of documents that contain an item.

    A pair is reported if a window of the document meets the item's MinHash values and the whole
    document holds at least ``threshold`` of the item's distinct five-word shingles (A-Z in lower
    case). Items with the same shingles are reported once, under the least ``item_id``; a text of
    one to four words has one shingle; null and blank texts, and items without an id, contain
    and match nothing. Rows that share an id are one document, which holds what any of them holds. Documents without an id are told
    apart by their text.
    """
    spark = documents.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null")
    items = bench.mapInArrow(_items, "item_id long, upper int, own array<long>, keys array<long>")
    items = items.groupBy("own").agg(F.min("item_id").alias("item_id"), F.min("upper").alias("upper"), F.min_by("keys", "item_id").alias("keys"))
    uppers = sorted(r[0] for r in items.select("upper").distinct().collect())  # powers of two: a few
    text = documents.select(_ident().alias("ident"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    shape = "ident string, doc_id long, keys array<long>, hits array<long>"
    if not uppers:
        found = text.where(F.lit(False)).select("ident", "doc_id", F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<long>").alias("hits"))
    else:
        key_bits = spark.sparkContext.broadcast(_bitmap(items.select(F.explode("keys").alias("value"))))
        own_bits = spark.sparkContext.broadcast(_bitmap(items.select(F.explode("own").alias("value"))))
        found = text.mapInArrow(_searched(key_bits, own_bits, uppers), shape)
    with batches_of(spark, 1000):
        found = materialise(found, "windows")
    pairs = (
        found.select("ident", F.explode("keys").alias("key"))
        .join(items.select("item_id", F.explode("keys").alias("key")), "key").select("ident", "item_id").distinct()
    )
    held = found.groupBy("ident", "doc_id").agg(F.flatten(F.collect_set("hits")).alias("hits"))
    n_found = F.size(F.array_intersect("hits", "own"))
    return (
        pairs.join(held, "ident").join(items.select("item_id", "own"), "item_id")
        .select("ident", "doc_id", "item_id", F.size("own").cast("long").alias("n_item"), n_found.cast("long").alias("n_found"))
        .withColumn("containment", F.col("n_found") / F.col("n_item"))
        .where(F.col("n_found") >= threshold * F.col("n_item"))
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no item, with the columns they came with."""
    marks = contaminations(documents, benchmark, threshold).select(F.col("ident").alias("__found__")).distinct()
    return documents.join(marks, _ident() == F.col("__found__"), "left_anti")

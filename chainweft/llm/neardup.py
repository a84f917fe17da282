"""Near-duplicate detection: a multi-index Hamming join on b-bit MinHash signatures.

Every distinct shingle set ("unit") gets ``COMPONENTS`` MinHash values of ``b = 16`` bits. Two
sets of similarity s differ in a component with probability 1 - s, so sets of similarity 0.85
lie within ``RADIUS`` differing components but for about four in a million. The signature is
split into chunks, and the pigeonhole rule gives each chunk an error allowance: if the
allowances plus one add up to ``RADIUS`` + 1, two signatures within the radius agree in some
chunk up to its allowance. The allowed errors are enumerated as keys (each way to leave out an
allowed component), so an equi-join on keys meets every pair within the radius.

A bucket (the units of one key) is never expanded into all its pairs. Each unit is first
compared with two or three leaders of its bucket. What these links join is one component, and only
buckets that still hold several components are looked at again: small ones pair by pair, large
ones as a grid of blocks of bounded size in which intersections are counted by inverted lists.
Links are confirmed on full shingle sets, never on signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.llm.text import WORDS, batches_of, mixed, shingles, sliced, words
from chainweft.session import materialise

COMPONENTS, CHUNK, RADIUS = 64, 4, 24
CHUNKS = COMPONENTS // CHUNK
#: Chunks that allow one error; the others allow none. (allowance + 1) adds up to RADIUS + 1.
LOOSE = RADIUS + 1 - CHUNKS
#: Buckets above it are finished in blocks instead of pair by pair.
SMALL_BUCKET = 24
#: Bytes of shingle sets on either side of a block.
BLOCK_BYTES = 8_000_000

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a whole text."""
    return np.unique(shingles(WORDS.of(words(text))))


def signature(own: np.ndarray) -> np.ndarray:
    """The ``COMPONENTS`` MinHash values of a set that is not empty, 16 bits each."""
    least = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        part = own[at : at + 2048]
        for j in range(COMPONENTS):
            low = (part * _A[j] + _B[j]).min()
            if low < least[j]:
                least[j] = low
    return (least >> np.uint64(40)).astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys of signatures (one row each): 4 for a chunk that allows an error, else 1."""
    out = []
    s = signatures.astype(np.uint64)
    for c in range(CHUNKS):
        part = s[:, c * CHUNK : (c + 1) * CHUNK]
        for left_out in range(CHUNK) if c < LOOSE else [CHUNK]:
            rest = [part[:, k] for k in range(CHUNK) if k != left_out]
            key = np.full(len(s), c * (CHUNK + 1) + left_out, np.uint64)
            for value in rest:
                key = mixed(key * np.uint64(65537) + value)
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def _digest(own: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(own.tobytes(), digest_size=16).digest()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        n, digest, sig = [], [], []
        for text in batch.column("text").to_pylist():
            own = shingle_set(text)
            n.append(len(own))
            digest.append(_digest(own) if len(own) else None)
            sig.append(signature(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
            ["doc_id", "n", "digest", "sig"],
        )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        if batch.num_rows:
            own = keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, COMPONENTS))
            unit = np.repeat(batch.column("unit").to_numpy(), own.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(unit)], ["key", "unit"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        unit, found = [], []
        for u, digest, text in zip(*(batch.column(k).to_pylist() for k in ("unit", "digest", "text")), strict=True):
            own = shingle_set(text)
            if len(own) and _digest(own) == digest:
                unit.append(u)
                found.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(found, pa.binary())], ["unit", "own"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures lie within the radius."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for k in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= RADIUS))


def _confirmed(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fits = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    fits.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                fits.append(100 * inter >= percent * (len(both) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return run


def _blocks(percent: int):  # noqa: ANN202
    """Links between a block of probes and a block of targets, one for each pair of components."""

    def run(probes: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(probes) and len(targets):
            sets = [np.frombuffer(v, np.uint64) for v in targets["own_t"]]
            sizes = np.array([len(v) for v in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            values = np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            owner = owner[order]
            values, first = np.unique(values[order], return_index=True)
            end = np.append(first[1:], len(owner))
            units, comps, joined = targets["unit_t"].to_numpy(), targets["comp_t"].to_numpy(), set()
            for unit, comp, own in zip(probes["unit"], probes["comp"], probes["own"], strict=True):
                p = np.frombuffer(own, np.uint64)
                at = np.minimum(np.searchsorted(values, p), len(values) - 1)
                at = at[values[at] == p]
                hits = np.concatenate([owner[first[k] : end[k]] for k in at]) if len(at) else owner[:0]
                inter = np.bincount(hits, minlength=len(sets))
                for k in np.flatnonzero((100 * inter >= percent * (len(p) + sizes - inter)) & (comps != comp)):
                    if (pair := (min(comp, comps[k]), max(comp, comps[k]))) not in joined:
                        joined.add(pair)
                        out.append((min(unit, units[k]), max(unit, units[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def components(links: DataFrame) -> DataFrame:
    """``v`` and the least vertex ``comp`` that it reaches, for every vertex of ``links`` (``a``, ``b``).

    Each round every vertex moves to its least neighbour, and the links are drawn anew between
    what the vertices have become; links within one are gone. Stars end after a round or two,
    chains in about the logarithm of their length, and each round has fewer links than the last.
    """
    open_ = materialise(links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    labels = None
    while labels is None or not open_.isEmpty():
        ends = open_.select("y", "x").unionByName(open_.select(F.col("x").alias("y"), F.col("y").alias("x")))
        moves = materialise(ends.groupBy(F.col("y").alias("w")).agg(F.min("x").alias("to")).select("w", F.least("w", "to").alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("w").alias("v"), F.col("to").alias("comp"))
        else:
            labels = materialise(labels.join(moves, F.col("comp") == F.col("w"), "left").select("v", F.coalesce("to", "comp").alias("comp")), "labels")
        x = moves.select(F.col("w").alias("x"), F.col("to").alias("to_x"))
        y = moves.select(F.col("w").alias("y"), F.col("to").alias("to_y"))
        moved = open_.join(x, "x").join(y, "y").where("to_x <> to_y")
        open_ = materialise(moved.select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).distinct(), "edges")
    return labels


def _pairs_within(pairs: DataFrame, units: DataFrame) -> DataFrame:
    a = units.select(F.col("unit").alias("a"), F.col("sig").alias("sig_a"))
    b = units.select(F.col("unit").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("unit").alias("a"), F.col("own").alias("own_a"))
    b = sets.select(F.col("unit").alias("b"), F.col("own").alias("own_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "own_a", "own_b").mapInArrow(_confirmed(percent), "a long, b long")


def _in_blocks(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of large buckets (``unit``, ``leader``, ``comp``), whole and in bounded blocks."""
    groups = components(open_.select(F.col("unit").alias("a"), F.col("leader").alias("b")).distinct())
    held = open_.select("unit", "comp").distinct().join(groups.select(F.col("v").alias("unit"), F.col("comp").alias("cluster")), "unit")
    held = held.join(sets, "unit").withColumn("bytes", F.length("own"))
    held = materialise(held, "blocks")
    sizes = held.groupBy("cluster", "comp").agg(F.count("*").alias("members"))
    main = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("members", "comp")).alias("main"))
    weight = held.join(main, "cluster").groupBy("cluster", "main").agg(
        F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("target_blocks"),
        F.ceil(F.sum(F.when(F.col("comp") != F.col("main"), F.col("bytes")).otherwise(0)) / BLOCK_BYTES).cast("int").alias("probe_blocks"),
    )
    # the largest component needs no comparison within itself: only the others ask
    held = held.join(weight.where("probe_blocks > 0"), "cluster").drop("bytes")
    spread = F.xxhash64("unit", F.lit(5))
    probes = held.where("comp <> main").withColumn("x", F.pmod(spread, F.col("probe_blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("target_blocks") - 1)))
    targets = held.withColumn("y", F.pmod(spread, F.col("target_blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1)))
    cell = [F.col("cluster"), F.col("x").cast("int"), F.col("y").cast("int")]
    left = probes.select(*(c.alias(f"p{k}") for k, c in enumerate(cell)), *(F.col(c).alias(c) for c in ("unit", "comp", "own")))
    right = targets.select(*(c.alias(f"t{k}") for k, c in enumerate(cell)), *(F.col(c).alias(f"{c}_t") for c in ("unit", "comp", "own")))
    return left.groupBy("p0", "p1", "p2").cogroup(right.groupBy("t0", "t1", "t2")).applyInPandas(_blocks(percent), "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every document.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct
    five-word shingles (A-Z in lower case, ASCII white space); ``percent`` is 85 at least, the
    similarity that the radius is made for. A text of one to four words has one shingle, its whole
    sequence; a null or blank text has none and is linked with nothing. The component is the least
    ``doc_id`` that links reach; ties and equal texts need no order. Rows that repeat an id are one
    document (of several texts under one id the one with the greatest digest counts). A row without
    an id is kept, has no component and is linked with nothing. An empty table gives none.
    """
    if percent < 85:
        raise ValueError("the signature radius covers similarities of 85 percent or more")
    with batches_of(documents.sparkSession, 1000):
        return _joined(documents, percent)


def _joined(documents: DataFrame, percent: int) -> DataFrame:
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = materialise(text.mapInArrow(_prints, "doc_id long, n long, digest binary, sig binary"), "prints")
    one = prints.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("digest", "n", "sig")).alias("p")).select("doc_id", "p.*")
    # the same set is one unit, named by its least document
    units = materialise(
        one.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("unit"), F.first("sig").alias("sig")), "units"
    )
    keyed = units.select("unit", "sig").mapInArrow(_keyed, "key long, unit long").repartition("key")
    lead = keyed.groupBy("key").agg(
        F.count("*").alias("members"), F.min("unit").alias("leader"),
        F.min_by("unit", F.xxhash64("unit", F.lit(1))).alias("second"), F.min_by("unit", F.xxhash64("unit", "key")).alias("third"),
    ).where("members > 1").withColumn("third", F.expr(f"if(members <= {SMALL_BUCKET}, third, leader)"))
    buckets = materialise(keyed.join(lead, "key"), "buckets")
    tried = (
        buckets.select("unit", F.explode(F.array("leader", "second", "third")).alias("other")).where("unit <> other")
        .select(F.least("unit", "other").alias("a"), F.greatest("unit", "other").alias("b")).distinct()
    )
    tried = materialise(tried, "tried")
    near = materialise(_pairs_within(tried, units), "near")
    wanted = buckets.where(f"members > {SMALL_BUCKET}").select("unit").unionByName(
        near.select(F.explode(F.array("a", "b")).alias("unit"))
    ).unionByName(buckets.where(f"members > 2 AND members <= {SMALL_BUCKET}").select("unit")).distinct()
    asked = wanted.join(units.select("unit", "digest"), "unit")
    sets = materialise(
        text.withColumnRenamed("doc_id", "unit").join(asked, "unit").select("unit", "digest", "text").mapInArrow(_sets, "unit long, own binary").dropDuplicates(["unit"]),
        "sets",
    )
    links = materialise(_links(near, sets, percent), "links")
    first = components(links)

    placed = buckets.join(first.withColumnRenamed("v", "unit"), "unit", "left").withColumn("comp", F.coalesce("comp", "unit"))
    mixed_keys = placed.where("members > 2").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_ = materialise(placed.join(mixed_keys, "key"), "open")
    small = open_.where(f"members <= {SMALL_BUCKET}").select("key", "unit", "comp")
    rest = (
        small.join(small.select("key", F.col("unit").alias("b"), F.col("comp").alias("comp_b")), "key")
        .where("unit < b AND comp <> comp_b").select(F.col("unit").alias("a"), "b").distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    more = _links(_pairs_within(rest, units), sets, percent)
    hot = _in_blocks(open_.where(f"members > {SMALL_BUCKET}"), sets, percent)
    # what the first links join is one vertex by now
    comp_a = first.select(F.col("v").alias("a"), F.col("comp").alias("comp_a"))
    comp_b = first.select(F.col("v").alias("b"), F.col("comp").alias("comp_b"))
    late = more.unionByName(hot).join(comp_a, "a", "left").join(comp_b, "b", "left")
    again = components(late.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")))
    found = materialise(first.unionByName(again.select("v", F.col("v").alias("comp"))).groupBy("v").agg(F.min("comp").alias("comp")), "first")
    again = again.select(F.col("v").alias("w"), F.col("comp").alias("last"))
    found = found.join(again, F.col("comp") == F.col("w"), "left").select("v", F.coalesce("last", "comp").alias("comp"))

    of_unit = one.join(units.select("digest", "unit"), "digest", "left")
    result = of_unit.join(found.withColumnRenamed("v", "unit"), "unit", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "unit", "doc_id").alias("component_id")
    )
    unnamed = prints.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.unionByName(unnamed).withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def deduplicated(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay, one of each component, with the columns they came with."""
    marks = near_duplicates(documents, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept__"))
    return documents.join(marks, F.col("doc_id") == F.col("__kept__"), "left_semi").unionByName(documents.where("doc_id IS NULL"))

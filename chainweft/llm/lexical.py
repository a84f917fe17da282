"""Ranked lexical search: many queries share partial document scores along a graph of term sets.

The score of a document for a query is a sum over the query's terms, and queries of a benchmark
share many terms. Per block of queries, terms that stand in the same queries become one set, and
a query becomes a list of such sets, the most shared first. Pairs of neighbours that two or more
lists have are mined round by round and replaced by a new set, so the lists shrink to the roots of
a graph in which each shared set stands once. A task scores its documents a batch at a time: one
accumulator row per set, filled from the terms, then added up along the graph, each shared sum
made once for all queries that use it. It keeps the best ``k`` of each query, and the tasks' bests
meet in the end, so no pair of query and document is ever shuffled.

Documents are read twice: words are counted once into narrow rows of query terms, from which the
global counts (documents, words, documents of a term) come by an ordinary aggregate.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweft.llm.text import batches_of, sliced
from chainweft.session import materialise

#: Bounds of a block of queries, all of which a task holds at once: queries and bytes of distinct terms.
BLOCK_QUERIES, BLOCK_BYTES = 2_000, 4 << 20
#: Documents that are scored together, and the accumulators that they may have.
SCORED_ROWS, ACCUMULATORS = 500, 4 << 20
#: Candidates that a task holds beyond its bests before it cuts them.
HELD = 200_000

#: Letters and digits of ASCII, A-Z in lower case, and all bytes of other characters; the rest parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class Sharing:
    """Term sets of a block of queries: ``leaf`` of each term, sums (``left``, ``right``) of sets, and the ``roots`` of each query."""

    leaf: dict[bytes, int]
    sums: list[tuple[int, int]] = field(default_factory=list)
    roots: list[list[int]] = field(default_factory=list)
    leaves: int = 0


def shared(queries: list[list[bytes]]) -> Sharing:
    """The graph of term sets for queries that are lists of distinct terms."""
    holders: dict[bytes, list[int]] = defaultdict(list)
    for q, own in enumerate(queries):
        for term in own:
            holders[term].append(q)
    sets: dict[tuple[int, ...], int] = {}
    leaf = {term: sets.setdefault(tuple(held), len(sets)) for term, held in sorted(holders.items())}
    lists: list[list[int]] = [[] for _ in queries]
    # the most shared sets first, so that queries with common terms have common neighbours
    for held, node in sorted(sets.items(), key=lambda x: (-len(x[0]), x[1])):
        for q in held:
            lists[q].append(node)
    out = Sharing(leaf, leaves=len(sets))
    while True:
        pairs = Counter(p for own in lists for p in set(zip(own, own[1:], strict=False)))
        common = {p: n for p, n in pairs.items() if n > 1}
        if not common:
            break
        nodes: dict[tuple[int, int], int] = {}
        for q, own in enumerate(lists):
            new, k = [], 0
            while k < len(own):
                here = common.get(tuple(own[k : k + 2]), 0)
                # the next pair goes first if more lists have it
                if here and here >= common.get(tuple(own[k + 1 : k + 3]), 0):
                    pair = (own[k], own[k + 1])
                    if pair not in nodes:
                        nodes[pair] = out.leaves + len(out.sums)
                        out.sums.append(pair)
                    new.append(nodes[pair])
                    k += 2
                else:
                    new.append(own[k])
                    k += 1
            lists[q] = new
    out.roots = lists
    return out


def _counted(vocabulary):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in sliced(batches):
            sizes, ids, often, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                found = terms(text)
                own = Counter([i for i in map(number.get, found) if i is not None])
                sizes.append(len(found))
                ids.extend(own)
                often.extend(own.values())
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(often, pa.int64()))],
                ["doc_id", "size", "terms", "often"],
            )

    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class _Best:
    """The best ``k`` documents of each query: highest score, then least id (a null id first)."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.at_least = np.ones(queries, np.int64)
        self.query, self.score = np.empty(0, np.int64), np.empty(0, np.int64)
        self.doc, self.known = np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        query, row = np.nonzero(scores >= self.at_least[:, None])
        if not len(query):
            return
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, scores[query, row]])
        self.doc, self.known = np.concatenate([self.doc, doc[row]]), np.concatenate([self.known, known[row]])
        if len(self.query) > HELD or len(query) > 20 * self.k * len(self.at_least):
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.doc, self.known, -self.score, self.query))
        query = self.query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        self.query, self.score, self.doc, self.known = self.query[order], self.score[order], self.doc[order], self.known[order]
        full = rank[rank < self.k] == self.k - 1
        self.at_least[self.query[full]] = self.score[full]


def _scored(graph, weights: np.ndarray, documents: int, words: int, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_of, leaves, sums, roots = graph.value
        best = _Best(len(roots), k)
        rows = max(1, min(SCORED_ROWS, ACCUMULATORS // (leaves + len(sums) + len(roots))))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                length = 10 + 90 * batch.column("size").to_numpy() * documents // words
                lists = batch.column("terms")
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                term, often = lists.flatten().to_numpy(), batch.column("often").flatten().to_numpy()
                part = weights[term] * (1_000_000_000 * often // (1000 * often + 8 * length[row]))
                sets = np.zeros((leaves + len(sums), batch.num_rows), np.int64)
                np.add.at(sets, (leaf_of[term], row), part)
                for node, (left, right) in enumerate(sums, leaves):
                    np.add(sets[left], sets[right], out=sets[node])
                scores = np.zeros((len(roots), batch.num_rows), np.int64)
                for q, own in enumerate(roots):
                    for node in own:
                        scores[q] += sets[node]
                ids = batch.column("doc_id")
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.query, pa.int32()), pa.array(best.doc, pa.int64(), mask=~best.known), pa.array(best.score, pa.int64())], ["query", "doc_id", "score"]
        )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries (id, distinct terms) in blocks that a task can hold; a query beyond the bound is a block of its own."""
    block: list = []
    size = 0
    rows = items.orderBy("item_id").toLocalIterator()
    for item, texts in rows:
        own = sorted({t for text in texts for t in terms(bytes(text))})
        held = sum(map(len, own))
        if block and (len(block) == BLOCK_QUERIES or size + held > BLOCK_BYTES):
            yield block
            block, size = [], 0
        if own:
            block.append((item, own))
            size += held
    if block:
        yield block


def ranked(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` documents with the highest scores above 0 for each item.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns
    are not looked at. Every row of ``documents`` is a document of its own, also where ids repeat
    or are null; equal scores go by id, a null id first. Rows of items that share an id (a null id
    too) are one item, and a term counts once in it. Null and empty texts have no terms: they are
    never found and find nothing, and don't count as documents. Texts are read whole.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(asked.groupBy("item_id").agg(F.collect_set("text").alias("texts"))):
        graph = shared([own for _, own in block])
        number = {term: i for i, term in enumerate(graph.leaf)}
        with batches_of(spark, 1000):
            counted = materialise(docs.mapInArrow(_counted(spark.sparkContext.broadcast(number)), "doc_id long, size long, terms array<int>, often array<long>"), "counted")
        total, words = counted.where("size > 0").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not total:
            break
        weights = np.zeros(len(number), np.int64)
        for term, holding in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = weight(total, holding)
        shape = spark.sparkContext.broadcast((np.array(list(graph.leaf.values()), np.int64), graph.leaves, graph.sums, graph.roots))
        found = counted.where(F.size("terms") > 0).mapInArrow(_scored(shape, weights, total, words, k), "query int, doc_id long, score long")
        first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found = materialise(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "ranked")
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "query int, item_id long")
        out = out.unionByName(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out

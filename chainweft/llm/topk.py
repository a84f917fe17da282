"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code has a bit for the sign of each of its 64 components. Codes are split into
segments of 16 bits, and each segment has an index. A query looks up the segment values within
radius r of its own, segment by segment and r by r. When segments 0..j have been searched to
radius r and the others to r - 1, every code within distance m * r + j has been met, by the
pigeonhole rule. A query ends when its k-th verified distance is covered in this sense; only the
others grow their radii. A segment has 65,536 values, which bounds the look-ups of a query for any
table size; with more codes its radii stay smaller. Codes that are farther than what a query already
holds are dropped as they are verified.

Equal codes are one entry with its k + 1 least ids, and equal queries are one search, so copies
cost nothing and the order (distance, id) stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.session import materialise

BITS, SEGMENT = 64, 16
SEGMENTS = BITS // SEGMENT
#: Look-ups of a query that one step may add when it takes several segments together.
STEP_LOOKUPS = 8_000


def code_of(vector: Column) -> Column:
    """A long with bit i set if component i is above 0; missing components and NaN count as not above."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when((F.get(vector, i) > 0) & ~F.isnan(F.get(vector, i)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segment(code: Column, j: int) -> Column:
    return F.shiftrightunsigned(code, SEGMENT * j).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int")


def _steps() -> Iterator[tuple[int, list[int], int]]:
    """Radius, segments, and the distance that is covered after them."""
    for r in range(SEGMENT + 1):
        ring = comb(SEGMENT, r)
        together = max(1, min(SEGMENTS, STEP_LOOKUPS // ring))
        for j in range(0, SEGMENTS, together):
            own = list(range(j, min(j + together, SEGMENTS)))
            yield r, own, SEGMENTS * r + own[-1]


def _ring(r: int) -> Column:
    """Masks with ``r`` bits, as one text that Spark folds to a constant array."""
    masks = (sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), r))
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")


def _values(codes: DataFrame, own: list[int]) -> DataFrame:
    """(code, .., j, value) for each segment in ``own``."""
    keys = F.array(*(F.struct(F.lit(j).alias("j"), _segment(F.col("code"), j).alias("value")) for j in own))
    return codes.select("*", F.explode(keys).alias("key")).select("*", "key.j", "key.value").drop("key")


def _looked_up(queries: DataFrame, codes: DataFrame, r: int, own: list[int]) -> DataFrame:
    """(q, code, n, least, distance) of codes that the step meets, no step before has met, and that lie within the query's ``bound``."""
    def ring(j: int) -> Column:
        return F.transform(_ring(r), lambda m: F.struct(F.lit(j).alias("j"), _segment(F.col("q"), j).bitwiseXOR(m).alias("value")))

    asked = queries.select("q", "bound", F.explode(F.concat(*map(ring, own))).alias("key")).select("q", "bound", "key.j", "key.value")
    # Spark takes a few queries for few look-ups and would send them all to the driver
    met = asked.hint("merge").join(_values(codes.select("code", "n", "least"), own), ["j", "value"])
    apart = F.col("q").bitwiseXOR(F.col("code"))
    at = [F.bit_count(_segment(apart, j)) for j in range(SEGMENTS)]
    # first met in the nearest segment, the first one among equals
    first = F.array_position(F.array(*at), F.array_min(F.array(*at))) - 1
    fresh = (F.bit_count(apart) <= F.col("bound")) & (F.array_min(F.array(*at)) == r) & (first == F.col("j"))
    return met.where(fresh).select("q", "code", "n", "least", F.bit_count(apart).alias("distance"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``neighbour_id``, ``distance``: the ``k`` nearest others of each query row.

    Both tables have ``vec_id`` and ``embedding``. Order is by Hamming distance, then by id. A query
    doesn't find rows of its own id. Rows without an id or a vector are neither found nor asked;
    rows that repeat an id count once, by the least code. With fewer than ``k`` others all are given.
    """
    def coded(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding")).where("id IS NOT NULL AND embedding IS NOT NULL")
        return rows.select("id", code_of(F.col("embedding")).alias("code")).groupBy("id").agg(F.min("code").alias("code"))

    # Spark limits the rows of a frequent code in each task before they meet
    every = coded(vectors).withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id")))
    codes = materialise(
        every.where(F.col("place") <= k + 1).groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.array_sort(F.collect_list("id")).alias("ids")), "codes"
    )
    asking = materialise(coded(queries), "asking")
    open_ = materialise(asking.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), "open")
    total = codes.count()
    nearer = Window.partitionBy("q").orderBy("distance", "least")
    best, done, shape = None, [], "q long, code long, n long, least long, distance int"
    for r, own, covered in _steps():
        if open_.isEmpty():
            break
        new = _looked_up(open_, codes, r, own)
        pool = new if best is None else best.join(open_, "q", "left_semi").unionByName(new)
        # k + 1 codes have k + 1 ids at least, and each stands by its least
        best = materialise(pool.withColumn("at", F.row_number().over(nearer)).where(F.col("at") <= k + 1).drop("at"), "best")
        held = best.groupBy("q").agg(
            F.sum(F.when(F.col("distance") <= covered, F.col("n"))).alias("ids"), F.count("*").alias("codes"), F.max("distance").alias("farthest"),
        )
        # all that there is, or k + 1 ids within what is covered
        over = (F.col("ids") >= k + 1) | (F.col("codes") == total)
        held = materialise(held.withColumn("over", F.coalesce(over, F.lit(False))), "held")
        done.append(best.join(held.where("over"), "q", "left_semi"))
        left = open_.join(held.where("over"), "q", "left_anti").join(held.select("q", "codes", "farthest"), "q", "left")
        bound = F.when(F.col("codes") == k + 1, F.col("farthest")).otherwise(F.lit(BITS))
        open_ = materialise(left.select("q", bound.alias("bound")), "open")
    found = vectors.sparkSession.createDataFrame([], shape)
    for part in done:
        found = found.unionByName(part)
    # an exact cut per query code first, then per query
    ids = found.join(codes.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("neighbour_id"))
    by_id = Window.partitionBy("q").orderBy("distance", "neighbour_id")
    ids = ids.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("near"))
    out = asking.join(ids, asking["code"] == ids["q"])
    others = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("id")), 1, k)
    return out.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "found")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("found.neighbour_id").alias("neighbour_id"), F.col("found.distance").alias("distance")
    )

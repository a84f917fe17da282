"""Order-sensitive helpers that split hot keys.

A plain window puts every row of one key into one task.  The helpers here cut
a key into slices of its order (a block or time range), work inside the
slices, reduce each slice to one small row and carry that row forward.  The
only window over a whole key then runs over its slice rows, whose number is
bounded by the range of the order divided by the slice width.  A slice that
holds too many rows can be cut again at their percentiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"


def _slice(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def with_even_slices(df: DataFrame, keys: Sequence[str], position: str, rows: int, pieces: int = 128) -> DataFrame:
    """``df`` with its slices cut again at percentiles of ``position`` where one holds more than ``rows`` rows.

    Slices keep their order, and rows of one position stay together.  Only
    overfull slices are sorted into percentiles; their number is at most the
    number of rows divided by ``rows``.
    """
    group = [*keys, SLICE]
    full = df.groupBy(*group).count().where(F.col("count") > rows).select(*group)
    shares = [k / pieces for k in range(1, pieces)]
    borders = df.join(full, group, "left_semi").groupBy(*group).agg(F.percentile_approx(position, shares, 10_000).alias("__borders"))
    inner = F.when(F.col("__borders").isNull(), 0).otherwise(F.size(F.filter("__borders", lambda b: b < F.col(position))))
    return df.join(borders, group, "left").withColumn(SLICE, F.col(SLICE) * pieces + inner).drop("__borders")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    slice_on: str,
    width: int,
    suffix: str = "_prev",
    forward: bool = False,
) -> DataFrame:
    """Add the previous (or next) row's ``values`` within ``keys``.

    ``slice_on`` must be the leading order column or non-decreasing with it.
    """
    keys, order, values = list(keys), list(order), list(values)
    sliced = df.withColumn(SLICE, _slice(F.col(slice_on), width))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    payload = F.struct(*values)
    shift = F.lead if forward else F.lag
    body = sliced.withColumn("__near", shift(payload).over(inside))
    pick = F.min_by if forward else F.max_by
    ends = sliced.groupBy(*keys, SLICE).agg(pick(payload, F.struct(*order)).alias("__end"))
    across = Window.partitionBy(*keys).orderBy(SLICE)
    ends = ends.withColumn("__far", shift("__end").over(across)).drop("__end")
    joined = body.join(ends, [*keys, SLICE], "left")
    near = F.coalesce("__near", "__far")
    out = joined.select(*df.columns, *[near[v].alias(v + suffix) for v in values])
    return out


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    slice_on: str,
    width: int,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` in ``order``."""
    return with_running_totals(df, keys, order, {name: value}, slice_on, width)


def with_running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    slice_on: str,
    width: int,
) -> DataFrame:
    """Inclusive running sums within ``keys`` in ``order``; ``values``: new name to column."""
    keys, order = list(keys), list(order)
    sliced = df.withColumn(SLICE, _slice(F.col(slice_on), width))
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    body = sliced.withColumns({f"__near_{n}": F.sum(v).over(inside) for n, v in values.items()})
    ends = sliced.groupBy(*keys, SLICE).agg(*[F.sum(v).alias(f"__end_{n}") for n, v in values.items()])
    before = (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = ends.select(*keys, SLICE, *[F.sum(f"__end_{n}").over(before).alias(f"__far_{n}") for n in values])
    joined = body.join(ends, [*keys, SLICE], "left")
    totals = [(F.col(f"__near_{n}") + F.coalesce(f"__far_{n}", F.lit(0))).alias(n) for n in values]
    return joined.select(*df.columns, *totals)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    slice_on: str,
    width: int,
    forward: bool = False,
    inclusive: bool = False,
    slice_rows: int | None = None,
) -> DataFrame:
    """Attach the nearest earlier (or later) ``right`` row to each left row.

    Both frames carry ``keys`` and ``order`` under the same names; ``payload``
    columns of the right frame come back, null where there is no such row.
    Slices of more than ``slice_rows`` rows, if given, are cut again.
    Cost is one sort of the union per slice: pairs are never formed.
    """
    keys, order, payload = list(keys), list(order), list(payload)
    kept = [c for c in left.columns if c not in keys and c not in order]
    # Rows of equal position: left sorts first when the match must be strict.
    left_first = forward == inclusive
    a = left.select(
        *keys,
        *order,
        F.lit(0 if left_first else 1).alias("__side"),
        F.struct(*([F.col(c) for c in kept] or [F.lit(1).alias("__none")])).alias("__left"),
    )
    b = right.select(
        *keys,
        *order,
        F.lit(1 if left_first else 0).alias("__side"),
        F.struct(*payload).alias("__right"),
    )
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn(SLICE, _slice(F.col(slice_on), width))
    if slice_rows is not None:
        both = with_even_slices(both, keys, slice_on, slice_rows)
    # A later row is an earlier row of the reversed order: frames that start at
    # the partition head are evaluated in one pass, frames that end at its tail
    # are not.
    turn = F.desc if forward else F.asc
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*[turn(c) for c in [*order, "__side"]])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(turn(SLICE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    near = F.last("__right", ignorenulls=True).over(inside)
    far = F.last("__end", ignorenulls=True).over(across)
    pick = F.min_by if forward else F.max_by
    body = both.withColumn("__near", near)
    position = F.when(F.col("__right").isNotNull(), F.struct(*order))
    ends = both.groupBy(*keys, SLICE).agg(pick("__right", position).alias("__end"))
    ends = ends.withColumn("__far", far).drop("__end")
    found = F.coalesce("__near", "__far")
    return (
        body.where(F.col("__left").isNotNull())
        .join(ends, [*keys, SLICE], "left")
        .select(
            *keys,
            *order,
            *[F.col("__left")[c].alias(c) for c in kept],
            *[found[p].alias(p) for p in payload],
        )
    )


def with_group_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Whole-group aggregates next to every row, by aggregate and join.

    Unlike ``agg().over(partitionBy(keys))`` this pre-aggregates on the map
    side and leaves the join to adaptive skew splitting.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(totals, keys, "inner")


#: Parts over which the rows of one group are dealt.
GROUP_PARTS = 8


def dealt(df: DataFrame, keys: Sequence[str], by: str, part: str = "__part") -> DataFrame:
    """``df`` shuffled to ``keys`` and a part of the group by the hash of ``by``, which stays as a column.

    Folds by ``keys``, the part and anything that ``by`` is among then move no
    rows, and folds by ``keys`` alone get at most ``GROUP_PARTS`` rows a group,
    however many tasks there are.
    """
    return df.withColumn(part, F.pmod(F.hash(by), F.lit(GROUP_PARTS))).repartition(*keys, part)


def with_part_totals(df: DataFrame, keys: Sequence[str], totals: DataFrame, part: str = "__part") -> DataFrame:
    """Group totals (one row of ``keys``) beside the rows of a :func:`dealt` frame: the totals go to each part, the rows stay."""
    each = F.explode(F.sequence(F.lit(0), F.lit(GROUP_PARTS - 1)))
    return df.join(totals.withColumn(part, each), [*keys, part]).drop(part)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark limits each task to ``n`` before the shuffle.

    It does so up to a threshold only; beyond it a hot key would go whole to one task.
    """
    most = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > most:
        raise ValueError(f"{n} rows of a group are more than windowGroupLimitThreshold ({most})")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)

"""Filters, pages, per-wallet cuts and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.functions.ids import DAY_MS
from chainweft.functions.ordered import top_per_group

MAX_WINDOW_DAYS = 3650
POSITION = [
    "block_number", "transaction_index", "event_index", "event_sub_index", "relationship_id",
]


def wallet_edges(edges: DataFrame) -> DataFrame:
    """Each transfer once per endpoint, as ``wallet``, ``peer``, ``direction``.

    A self-transfer is one row for its wallet (direction ``out``).
    """
    out, into = F.lit("out"), F.lit("in")
    src, dst = F.col("from_address"), F.col("to_address")
    one = F.array(F.struct(src.alias("wallet"), dst.alias("peer"), out.alias("direction")))
    two = F.array(
        F.struct(src.alias("wallet"), dst.alias("peer"), out.alias("direction")),
        F.struct(dst.alias("wallet"), src.alias("peer"), into.alias("direction")),
    )
    sides = F.when(src == dst, one).otherwise(two)
    return edges.select("*", F.inline(sides))


def scope(
    edges: DataFrame,
    from_block: int | None = None,
    to_block: int | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    asset_id: str | None = None,
    wallet: str | None = None,
    direction: str = "both",
) -> DataFrame:
    """Inclusive block and time ranges, asset or collection, endpoint and direction."""
    if direction not in ("incoming", "outgoing", "both"):
        raise ValueError(f"unknown direction {direction}")
    if from_block is not None and to_block is not None and from_block > to_block:
        raise ValueError("from_block must not exceed to_block")
    if from_ms is not None and to_ms is not None and from_ms > to_ms:
        raise ValueError("from_ms must not exceed to_ms")
    df = edges
    for column, low, high in (
        ("block_number", from_block, to_block),
        ("block_timestamp_unix_ms", from_ms, to_ms),
    ):
        if low is not None:
            df = df.where(F.col(column) >= low)
        if high is not None:
            df = df.where(F.col(column) <= high)
    if asset_id is not None:
        collection = asset_id.startswith("erc1155:") and "/" not in asset_id
        df = df.where(
            F.col("asset_id").startswith(asset_id + "/") if collection
            else F.col("asset_id") == asset_id
        )
    if wallet is not None:
        incoming, outgoing = F.col("to_address") == wallet, F.col("from_address") == wallet
        df = df.where(
            {"incoming": incoming, "outgoing": outgoing, "both": incoming | outgoing}[direction]
        )
    return df


def utxo_direction(legs: DataFrame, direction: str = "all") -> DataFrame:
    """Wallet transactions that received, spent, or did both."""
    received = F.col("received_output_count") > 0
    spent = F.col("spent_input_count") > 0
    keep = {"all": F.lit(True), "received": received, "spent": spent, "both": received & spent}
    return legs.where(keep[direction])


def page(edges: DataFrame, after: Sequence[object] | None, n: int,
         position: Sequence[str] = tuple(POSITION)) -> DataFrame:
    """The next ``n`` rows below a position, newest first, with ``has_more``."""
    columns = [F.col(c) for c in position]
    df = edges
    if after is not None:
        here = F.struct(*columns)
        types = dict(edges.dtypes)
        there = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(position, after)])
        df = df.where(here < there)
    newest = [c.desc() for c in columns]
    # The window sees n + 1 rows at most; the last one only tells whether more exist.
    rows = df.orderBy(*newest).limit(n + 1)
    whole = Window.partitionBy(F.lit(1))
    marked = rows.withColumn("has_more", F.count("*").over(whole) > n).withColumn(
        "__row", F.row_number().over(whole.orderBy(*newest))
    )
    return marked.where(F.col("__row") <= n).drop("__row")


def pages(edges: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Set form: the first page of every wallet with row numbers."""
    return top_per_group(edges, keys, order, n, "page_row")


def recent(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key and whether the key has more.

    ``n + 1`` rows per key survive the task-side limit; the last one is only
    the marker that the cut was real.
    """
    near = top_per_group(df, keys, order, n + 1)
    cut = near.where(F.col("rank") == n + 1).select(*keys, F.lit(True).alias("__cut"))
    return (
        near.where(F.col("rank") <= n)
        .join(cut, list(keys), "left")
        .withColumn("truncated", F.coalesce("__cut", F.lit(False)))
        .drop("__cut")
    )


def observation_window(df: DataFrame, days: int | None, at: int,
                       column: str = "block_timestamp_unix_ms") -> DataFrame:
    """All history, or the last ``days`` days before ``at``; more than the limit is an error."""
    if not days:
        return df
    if days > MAX_WINDOW_DAYS:
        raise ValueError(f"a window has {MAX_WINDOW_DAYS} days at most; leave days out for all history")
    start = max(0, at - days * DAY_MS)
    return df.where(F.col(column) >= start)


def participants(txs: DataFrame, edges: DataFrame, n: int = 4) -> DataFrame:
    """Per transaction: sender, recipient, then other endpoints by name, up to ``n``.

    ``ambiguous`` marks a hash that occurs more than once.  Endpoints are
    deduplicated before they are ranked, so a transaction with very many legs
    keeps ``n + 1`` rows per task.
    """
    known = txs.groupBy("tx_hash").agg(F.count("*").alias("occurrences"))
    own = txs.select(
        "tx_hash",
        F.posexplode(F.array("from_address", "to_address")).alias("priority", "address"),
    )
    legs = edges.select(
        "tx_hash",
        F.explode(F.array("from_address", "to_address")).alias("address"),
    ).select("tx_hash", F.lit(2).alias("priority"), "address")
    every = (
        own.unionByName(legs)
        .where(F.col("address").isNotNull())
        .groupBy("tx_hash", "address")
        .agg(F.min("priority").alias("priority"))
    )
    ranked = top_per_group(every, ["tx_hash"], [F.col("priority"), F.col("address")], n + 1)
    lists = ranked.groupBy("tx_hash").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "address"))), lambda s: s["address"]
        ).alias("__all")
    )
    return known.join(lists, "tx_hash").select(
        "tx_hash",
        (F.col("occurrences") > 1).alias("ambiguous"),
        F.slice("__all", 1, n).alias("participants"),
        (F.size("__all") > n).alias("participants_truncated"),
    )


def top_k(df: DataFrame, count: str, key: Sequence[str], k: int) -> DataFrame:
    """The ``k`` largest rows by count, ties by key."""
    return df.orderBy(F.desc(count), *key).limit(k)


def addresses(inputs: DataFrame, outputs: DataFrame, after: str | None = None) -> DataFrame:
    """Every address on either leg table; ``after`` resumes in key order."""
    both = inputs.select("address").unionByName(outputs.select("address"))
    both = both.where(F.col("address").isNotNull())
    if after is not None:
        both = both.where(F.col("address") > after)
    return both.distinct()


def diff_claims(
    old: DataFrame, new: DataFrame, excluded: DataFrame,
    compared: Sequence[str] = ("entity_name", "entity_type", "symbols"),
) -> DataFrame:
    """Added, removed, changed and unresolved claims between two list snapshots.

    A claim that vanished is unresolved, not removed, when the newer list has
    an entry of the same owner and network that could not be read.
    """
    a = old.select("claim_id", "uid", "network", F.struct(*compared).alias("before"))
    b = new.select("claim_id", F.struct(*compared).alias("after"))
    unclear = excluded.select("uid", "network").distinct().withColumn("__unclear", F.lit(True))
    both = a.join(b, "claim_id", "full_outer").join(unclear, ["uid", "network"], "left")
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull() & F.col("__unclear"), "unresolved")
        .when(F.col("after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    return both.select("claim_id", change.alias("change")).where(F.col("change").isNotNull())

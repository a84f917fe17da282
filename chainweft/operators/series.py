"""Gaps, bursts and continuity along block height or time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.functions.ids import HOUR_MS
from chainweft.functions.ordered import top_per_group, with_previous
from chainweft.operators.scope import wallet_edges

TS = "block_timestamp_unix_ms"
HEIGHT_SLICE = 100_000


def wallet_times(edges: DataFrame) -> DataFrame:
    """One row per wallet and transaction with its earliest time."""
    return wallet_edges(edges).groupBy("wallet", "tx_hash").agg(F.min(TS).alias("at"))


def avg_gap(times: DataFrame) -> DataFrame:
    """Mean seconds between a wallet's transactions.

    The gaps between sorted times add up to last minus first, so no ordering
    of the wallet's rows is needed.
    """
    spread = times.groupBy("wallet").agg(
        F.count("*").alias("transactions"), (F.max("at") - F.min("at")).alias("spread")
    )
    mean = F.col("spread") / (F.col("transactions") - 1) / 1000.0
    return spread.select(
        "wallet",
        "transactions",
        F.when(F.col("transactions") < 2, F.lit(0.0)).otherwise(mean).alias("avg_gap_seconds"),
    )


def burst_score(times: DataFrame) -> DataFrame:
    """How far the busiest hour exceeds the mean active hour, scaled to 0..1."""
    hourly = times.groupBy("wallet", F.floor(F.col("at") / HOUR_MS).alias("hour")).agg(
        F.count("*").alias("n")
    )
    per = hourly.groupBy("wallet").agg(
        F.max("n").alias("top"), F.sum("n").alias("all"), F.count("*").alias("hours")
    )
    raw = (F.col("top") / (F.col("all") / F.col("hours")) - 1.0) / 9.0
    score = F.when(F.col("all") < 3, F.lit(0.0)).otherwise(
        F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    )
    return per.select("wallet", score.alias("burst_score"))


def missing_ranges(blocks: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Ranges of absent heights between the lowest and highest stored block.

    ``state`` widens the range to the published start and tip.
    """
    heights = blocks.select("network_id", "block_number").distinct()
    if state is not None:
        from chainweft.operators.visibility import per_network

        fence = per_network(state)
        low = fence.select("network_id", (F.col("start_block") - 1).alias("block_number"))
        high = fence.select("network_id", (F.col("last_block_number") + 1).alias("block_number"))
        heights = heights.join(
            fence.select("network_id", "start_block", "last_block_number"), "network_id"
        ).where(F.col("block_number").between(F.col("start_block"), F.col("last_block_number")))
        heights = heights.select("network_id", "block_number").unionByName(low).unionByName(high)
    ahead = with_previous(
        heights, ["network_id"], ["block_number"], ["block_number"], "block_number", HEIGHT_SLICE,
        suffix="_next", forward=True,
    )
    gap = F.col("block_number_next") - F.col("block_number") - 1
    return ahead.where(gap > 0).select(
        "network_id",
        (F.col("block_number") + 1).alias("from_block"),
        (F.col("block_number_next") - 1).alias("to_block"),
        gap.alias("missing"),
    )


def first_ranges(ranges: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` ranges per network and whether there are more."""
    from chainweft.operators.scope import recent

    return recent(ranges, ["network_id"], [F.col("from_block")], n)


def parent_breaks(blocks: DataFrame) -> DataFrame:
    """Blocks whose stored predecessor is not the parent they name.

    Heights are consecutive by definition, so the predecessor comes from an
    equi-join on ``height - 1``.
    """
    before = blocks.select(
        "network_id", (F.col("block_number") + 1).alias("block_number"),
        F.col("block_hash").alias("previous_hash"),
    )
    return (
        blocks.select("network_id", "block_number", "block_hash", "parent_hash")
        .join(before, ["network_id", "block_number"])
        .where(F.col("parent_hash") != F.col("previous_hash"))
    )


def best_k(paths: DataFrame, k: int, keys: Sequence[str] = ("subject_id", "asset_id"),
           score: str = "exposure_score", tie: str = "path_id") -> DataFrame:
    """The ``k`` strongest rows per subject and asset."""
    return top_per_group(paths, list(keys), [F.desc(score), F.col(tie)], k)


def winner(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest priority, then confidence; later candidates win full ties."""
    rest = [c for c in candidates.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct("priority", "confidence", "position"))
    return candidates.groupBy(*keys).agg(top.alias("w")).select(*keys, "w.*")

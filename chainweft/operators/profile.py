"""Wallet identity, behaviour and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions.ids import DAY_MS
from chainweft.operators.scope import wallet_edges


def identity(wallets: DataFrame, exchanges: DataFrame, entities: DataFrame, contracts: DataFrame) -> DataFrame:
    """Exchange, else entity, else contract, else an unlabelled wallet.

    Each label table is reduced to its best row per address before the join.
    ``contracts``: address, protocol, contract_type.
    """
    ex = exchanges.groupBy(F.col("address").alias("wallet")).agg(
        F.max_by(F.struct("entity_id", "exchange_name", "address_role", "confidence"),
                 F.struct("confidence", "entity_id")).alias("x")
    )
    en = entities.groupBy(F.col("address").alias("wallet")).agg(
        F.max_by(F.struct("entity_id", "entity_name", "entity_type", "confidence"),
                 F.struct("confidence", "entity_id")).alias("n")
    )
    co = contracts.groupBy(F.col("address").alias("wallet")).agg(F.max("protocol").alias("protocol"), F.max("contract_type").alias("contract_type"), F.max(F.lit(1)).alias("c"))
    rows = wallets.join(ex, "wallet", "left").join(en, "wallet", "left").join(co, "wallet", "left")
    x, n, c = F.col("x").isNotNull(), F.col("n").isNotNull(), F.col("c").isNotNull()
    return rows.select(
        "wallet",
        F.when(x & (F.lower("x.address_role") == "deposit"), "exchange_deposit_wallet")
        .when(x, "exchange_service_wallet").when(n, F.col("n.entity_type"))
        .when(c, F.concat(F.lit("contract:"), "contract_type")).otherwise("wallet").alias("identity_type"),
        F.when(x, F.col("x.entity_id")).when(n, F.col("n.entity_id")).alias("entity_id"),
        F.when(x, F.col("x.exchange_name")).when(n, F.col("n.entity_name")).when(c, F.col("protocol")).alias("entity_name"),
        F.when(x, F.col("x.confidence")).when(n, F.col("n.confidence")).when(c, F.lit(0.65)).otherwise(0.25).alias("identity_confidence"),
        F.when(x, "exchange_addresses").when(n, "address_entity").when(c, "contract_metadata").otherwise("unlabeled").alias("identity_source"),
    )


def relationship_label(direction: Column, identity_type: Column) -> Column:
    """What a peer is to a wallet."""
    sender = direction == "sender"
    return (
        F.when(identity_type.startswith("exchange") & sender, "exchange funding source")
        .when(identity_type.startswith("exchange"), "exchange cash-out destination")
        .when(identity_type.contains("contract"), "contract interaction")
        .when(identity_type.contains("sweeper"), "sweeper wallet")
        .when(sender, "direct sender wallet").otherwise("direct receiver wallet")
    )


def largest_peer(edges: DataFrame) -> DataFrame:
    """Transfers with the busiest counterparty of each wallet."""
    pairs = wallet_edges(edges).groupBy("wallet", "peer").agg(F.count("*").alias("n"))
    return pairs.groupBy("wallet").agg(F.max("n").alias("largest_peer_transfers"))


def active_hours(edges: DataFrame) -> DataFrame:
    """Hours of the day (UTC) in which a wallet moved; at most 24 values."""
    hour = F.floor(F.pmod(F.col("block_timestamp_unix_ms"), F.lit(DAY_MS)) / 3_600_000).cast("int")
    return wallet_edges(edges).select("wallet", hour.alias("hour")).distinct().groupBy("wallet").agg(
        F.array_sort(F.collect_list("hour")).alias("active_hours")
    )


def behaviour_ratios(aggregate: DataFrame, largest: DataFrame, bursts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Shares of a wallet's transfers by kind, concentration, span and burst score."""
    total = F.col("total_transfers")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0))
    span = (F.col("last_seen_timestamp") - F.col("first_seen_timestamp")) / float(DAY_MS)
    days = F.when(F.col("last_seen_timestamp") > F.col("first_seen_timestamp"), span).otherwise(F.lit(1.0))
    rows = aggregate.join(largest, "wallet", "left").join(bursts, "wallet", "left").join(
        gaps.select("wallet", "avg_gap_seconds"), "wallet", "left"
    )
    return rows.select(
        *aggregate.columns,
        days.alias("observed_days"),
        (F.col("incoming_transfers") / F.greatest("outgoing_transfers", F.lit(1))).alias("inbound_outbound_ratio"),
        (F.coalesce("largest_peer_transfers", F.lit(0)) / F.greatest(total, F.lit(1))).alias("counterparty_concentration"),
        share("contract_call_transfers").alias("contract_call_ratio"), share("swap_transfers").alias("swap_ratio"),
        share("bridge_transfers").alias("bridge_ratio"), share("exchange_transfers").alias("exchange_interaction_ratio"),
        F.coalesce("burst_score", F.lit(0.0)).alias("burst_score"),
        F.coalesce("avg_gap_seconds", F.lit(0.0)).alias("avg_tx_interval_seconds"),
    )


def evidence_confidence(df: DataFrame) -> DataFrame:
    """Confidence by volume, plus a bonus for age."""
    n, days = F.col("total_transfers"), F.col("observed_days")
    # Confidence per volume and bonus per observed age.
    volume = F.when(n >= 200, 0.85).when(n >= 50, 0.75).when(n >= 10, 0.62).when(n >= 3, 0.45).otherwise(0.30)
    bonus = F.when(days >= 30, 0.08).when(days >= 7, 0.04).otherwise(0.0)
    return df.withColumn("evidence_confidence", F.least(volume + bonus, F.lit(1.0)))


def wallet_type(df: DataFrame) -> DataFrame:
    """First rule that fits, with its label and least confidence.

    Needs identity_type, identity_confidence, the aggregate and its ratios, and
    evidence_confidence.
    """
    s, r, n = F.col("unique_senders"), F.col("unique_receivers"), F.col("total_transfers")
    exchange = F.col("identity_type").startswith("exchange")
    # Rules in order - type, label, least confidence.
    rules: list[tuple[Column, Column | str, str, Column | float]] = [
        (exchange, F.col("identity_type"), "Identified exchange wallet", F.col("identity_confidence")),
        ((F.col("exchange_interaction_ratio") >= 0.35) & (s >= 10) & (r <= 5)
         & (F.col("incoming_transfers") > F.col("outgoing_transfers")),
         "exchange_deposit_funnel", "Probable exchange deposit funnel", 0.72),
        ((s >= 50) & (r >= 50) & (n >= 200), "service_or_exchange_hub", "High-volume service or exchange hub", 0.70),
        ((s >= 10) & (r <= 3), "collector_wallet", "Collector wallet", 0.65),
        ((r >= 10) & (s <= 3), "distributor_wallet", "Distributor wallet", 0.65),
        (F.col("swap_ratio") >= 0.25, "defi_swapper", "DeFi swap-heavy wallet", 0.62),
        (F.col("bridge_ratio") >= 0.15, "bridge_user", "Bridge-heavy wallet", 0.62),
        (F.col("contract_call_ratio") >= 0.50, "contract_power_user", "Contract-heavy wallet", 0.60),
        ((F.col("burst_score") >= 0.75) & (r >= 5), "burst_distributor", "Burst distribution wallet", 0.58),
    ]
    kind, label, least = F.lit("retail_wallet"), F.lit("Ordinary wallet behavior"), F.lit(0.0)
    for fits, name, text, floor in reversed(rules):
        kind = F.when(fits, name).otherwise(kind)
        label = F.when(fits, text).otherwise(label)
        least = F.when(fits, floor).otherwise(least)
    return df.withColumns(
        {"wallet_type": kind, "fingerprint_label": label,
         "confidence": F.greatest(F.col("evidence_confidence"), least)}
    )


def behaviour_flags(df: DataFrame) -> DataFrame:
    s, r = F.col("unique_senders"), F.col("unique_receivers")
    # Flags and their thresholds.
    flags = {
        "exchange_interaction_heavy": F.col("exchange_interaction_ratio") >= 0.5,
        "bursty_activity": F.col("burst_score") >= 0.75,
        "counterparty_concentration": (F.col("counterparty_concentration") >= 0.75) & (F.col("total_transfers") >= 5),
        "many_senders_few_receivers": (s >= 25) & (r <= 3),
        "few_senders_many_receivers": (r >= 25) & (s <= 3),
        "bridge_heavy_activity": F.col("bridge_ratio") >= 0.25,
        "swap_heavy_activity": F.col("swap_ratio") >= 0.4,
    }
    return df.withColumn(
        "behaviour_flags", F.array_compact(F.array(*[F.when(fits, F.lit(name)) for name, fits in flags.items()]))
    )


def quality_warnings(df: DataFrame, edge_limit: int = 0, depth: int = 0) -> DataFrame:
    """What limits the evidence about a wallet.

    Needs total_transfers, asset_count, metadata_gaps, pending_reviews and
    truncated; ``edge_limit`` and ``depth`` are those of the graph request.
    """
    n = F.col("total_transfers")
    rules = {
        "fingerprint_event_sample_truncated": F.col("truncated"),
        "no_observed_flow_history": n == 0,
        "low_observed_flow_volume": (n > 0) & (n < 3),
        "graph_edge_limit_reached": F.lit(edge_limit > 0) & (n >= edge_limit),
        "no_indexed_wallet_holdings": F.col("asset_count") == 0,
        "token_metadata_gaps_in_holdings": F.col("metadata_gaps") > 0,
        "incomplete_balance_history": F.col("incomplete_balances") > 0,
        "graph_depth_capped": F.lit(depth >= 6),
        "identity_claims_pending_review": F.col("pending_reviews") > 0,
    }
    return df.withColumn(
        "warnings", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    )

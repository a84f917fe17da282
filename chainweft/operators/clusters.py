"""Clustering leads.  Leads are candidates for review; they are never unioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions.ids import ZERO_ADDRESS, script_subject, stable_id
from chainweft.operators.visibility import latest

# Confidence and limits of the unspent-output leads.
COMMON_INPUT_CONFIDENCE = 0.5
CHANGE_CONFIDENCE = 0.3
MAX_MEMBERS = 16


def address_family(address: Column) -> Column:
    """Script family an address format belongs to."""
    return (
        F.when(address.startswith("1"), "p2pkh").when(address.startswith("3"), "p2sh")
        .when(address.startswith("bc1p"), "taproot")
        .when(address.startswith("bc1q") & (F.length(address) == 42), "p2wpkh")
        .when(address.startswith("bc1q") & (F.length(address) == 62), "p2wsh")
        .otherwise("other")
    )


def tx_shape(inputs: DataFrame, outputs: DataFrame, txs: DataFrame) -> DataFrame:
    """What the lead rules need of a transaction, as counters and short lists.

    Legs fold to (transaction, side, subject) and (transaction, value, subject)
    before the transaction row, and member lists are built only for
    transactions within the member limit, so no leg list is ever unbounded.
    """
    subject = script_subject(F.col("address"), F.col("script_hex"))
    script = F.col("address").isNull()
    legs = inputs.select(
        "tx_hash", F.lit("i").alias("side"), subject.alias("subject"), "value_sats",
        (script | (F.col("value_sats") == 0)).cast("int").alias("bad"),
    ).unionByName(
        outputs.select(
            "tx_hash", F.lit("o").alias("side"), subject.alias("subject"), "value_sats",
            (script & (F.col("value_sats") > 0)).cast("int").alias("bad"),
        )
    )
    per_value = legs.groupBy("tx_hash", "side", "subject", "value_sats").agg(
        F.count("*").alias("n"), F.max("bad").alias("bad")
    )
    positive_out = (F.col("side") == "o") & (F.col("value_sats") > 0)
    equal = per_value.where(positive_out).groupBy("tx_hash", "value_sats").agg(F.count("*").alias("owners"))
    equal = equal.groupBy("tx_hash").agg(F.max("owners").alias("equal_owners"))
    per_subject = per_value.groupBy("tx_hash", "side", "subject").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("value_sats") > 0, F.col("n"))).alias("positive"),
        F.max("bad").alias("bad"),
    )
    is_in = F.col("side") == "i"
    counts = per_subject.groupBy("tx_hash").agg(
        F.coalesce(F.sum(F.when(is_in, F.col("n"))), F.lit(0)).alias("inputs"),
        F.count_if(is_in).alias("input_subjects"),
        F.coalesce(F.sum(F.when(~is_in, F.col("positive"))), F.lit(0)).alias("positive_outputs"),
        F.count_if(~is_in & (F.col("positive") > 0)).alias("output_subjects"),
        F.max("bad").alias("bad"),
    )
    return txs.select("tx_hash", "coinbase").join(counts, "tx_hash").join(equal, "tx_hash", "left").withColumn(
        "equal_owners", F.coalesce("equal_owners", F.lit(0))
    )


def lead_suppression(shape: DataFrame) -> DataFrame:
    """Why a transaction yields no lead; null where it may."""
    reason = (
        F.when(F.col("coinbase") == 1, "coinbase")
        .when(F.col("bad") == 1, "script_or_zero_input_context")
        .when((F.col("input_subjects") >= 2) & (F.col("equal_owners") >= 2), "possible_collaborative_transaction")
        .when(F.col("input_subjects") > MAX_MEMBERS, "member_limit")
    )
    return shape.withColumn("suppressed", reason)


def common_input(inputs: DataFrame, shape: DataFrame) -> DataFrame:
    """Two to sixteen distinct input addresses of one transaction."""
    open_tx = lead_suppression(shape).where(
        F.col("suppressed").isNull() & F.col("input_subjects").between(2, MAX_MEMBERS)
    ).select("tx_hash")
    members = inputs.select("tx_hash", "address").distinct().join(open_tx, "tx_hash", "left_semi")
    lists = members.groupBy("tx_hash").agg(F.array_sort(F.collect_list("address")).alias("members"))
    return lists.select(
        stable_id(F.lit("common_input_candidate"), F.col("tx_hash"), F.array_join("members", "|")).alias("cluster_id"),
        "tx_hash", "members", F.lit("common_input_candidate").alias("heuristic"),
        F.lit(COMMON_INPUT_CONFIDENCE).alias("confidence"),
    )


def change_candidate(inputs: DataFrame, outputs: DataFrame, shape: DataFrame) -> DataFrame:
    """One input, two positive outputs to two others, one of the input's family."""
    open_tx = lead_suppression(shape).where(
        F.col("suppressed").isNull() & (F.col("inputs") == 1) & (F.col("positive_outputs") == 2)
        & (F.col("output_subjects") == 2)
    ).select("tx_hash")
    source = inputs.join(open_tx, "tx_hash", "left_semi").select("tx_hash", F.col("address").alias("payer"))
    paid = outputs.where(F.col("value_sats") > 0).select("tx_hash", "output_index", "address")
    both = source.join(paid, "tx_hash")
    same = address_family(F.col("address")) == address_family(F.col("payer"))
    # two rows per transaction at most
    per = both.groupBy("tx_hash", "payer").agg(
        F.count_if(F.col("address") == F.col("payer")).alias("own"),
        F.count_if(same).alias("same"),
        F.max(F.when(same, F.struct("address", "output_index"))).alias("hit"),
    )
    family = address_family(F.col("payer"))
    return per.where((F.col("own") == 0) & (F.col("same") == 1) & (family != "other")).select(
        "tx_hash", F.col("payer"), F.col("hit.address").alias("candidate"),
        F.col("hit.output_index").alias("candidate_output_index"), family.alias("family"),
        F.lit("change_candidate").alias("heuristic"), F.lit(CHANGE_CONFIDENCE).alias("confidence"),
    )


def deposit_wallets(activity: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Wallets that collect from several senders and sweep into a known service."""
    rows = sweeps.join(activity.withColumnRenamed("address", "candidate_address").drop(
        "first_seen_block", "last_seen_block"), "candidate_address")
    fits = (
        (F.col("inbound_txs") >= 2) & (F.col("unique_senders") >= 2) & (F.col("outbound_txs") >= 1)
        & (F.col("unique_receivers") <= 3) & (F.col("sweep_count") >= 1)
    )
    # Base and weights of the confidence.
    confidence = F.least(
        F.lit(0.55) + F.lit(0.15) * (F.least("unique_senders", F.lit(10)) / 10.0)
        + F.lit(0.15) * (F.least("sweep_count", F.lit(5)) / 5.0),
        F.lit(0.90), F.col("anchor_confidence"),
    )
    return rows.where(fits).select(
        "candidate_address", "anchor_address", "anchor_entity_id", "sweep_count", "unique_senders",
        confidence.alias("confidence"), F.lit("DEPOSIT").alias("address_role"),
    )


def service_wallets(activity: DataFrame) -> DataFrame:
    """Role of a busy wallet by its fan-in and fan-out."""
    i, o = F.col("inbound_txs"), F.col("outbound_txs")
    s, r = F.col("unique_senders"), F.col("unique_receivers")
    # Thresholds and confidence per role.
    rules = [
        ("HOT", 0.80, (i >= 100) & (o >= 100) & (s >= 50) & (r >= 50)),
        ("SWEEP", 0.72, (i >= 25) & (s >= 20) & (o > 0) & (r <= 10)),
        ("WITHDRAW", 0.68, (o >= 25) & (r >= 20) & (s <= 10)),
    ]
    role, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, value, fits in reversed(rules):
        role = F.when(fits, name).otherwise(role)
        confidence = F.when(fits, value).otherwise(confidence)
    busy = ((i >= 25) & (s >= 20)) | ((o >= 25) & (r >= 20))
    return activity.where(busy).select(
        "address", role.alias("address_role"), confidence.alias("confidence")
    ).where(F.col("address_role").isNotNull())


def shared_destination(edges: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """Destinations of one asset and token with a few distinct senders.

    ``token`` is taken where edges have it, so that edges lying in buckets of the
    group are folded in place; else it is ``token_id`` with null as empty.
    """
    if "token" not in edges.columns:
        edges = edges.withColumn("token", F.coalesce("token_id", F.lit("")))
    real = edges.where(
        (F.col("amount_raw") != "0") & (F.col("from_address") != F.col("to_address"))
        & ~F.col("from_address").isin("", ZERO_ADDRESS) & ~F.col("to_address").isin("", ZERO_ADDRESS)
    )
    keys = ["to_address", "asset_id", "token"]
    pairs = real.groupBy(*keys, "from_address").agg(
        F.count("*").alias("n"), F.max("block_number").alias("b1")
    )
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("distinct_senders"), F.sum("n").alias("transfers"), F.max("b1").alias("last_block")
    ).where(F.col("distinct_senders").between(least, most)).withColumnRenamed("to_address", "destination")


def shared_destination_members(edges: DataFrame, leads: DataFrame) -> DataFrame:
    """Senders behind the leads (at most ``most`` per lead by construction)."""
    keyed = edges.withColumn("token", F.coalesce("token_id", F.lit(""))).withColumnRenamed("to_address", "destination")
    return keyed.join(leads.select("destination", "asset_id", "token"), ["destination", "asset_id", "token"], "left_semi").groupBy(
        "destination", "asset_id", "token", F.col("from_address").alias("sender")
    ).agg(F.count("*").alias("transfers"), F.min("relationship_id").alias("evidence_ref"))


def entity_clusters(entity_addresses: DataFrame, claims: DataFrame, run_id: str) -> DataFrame:
    """Reviewed entities as clusters: one membership per address, anchor the least address."""
    members = entity_addresses.select("claim_id").distinct().join(
        claims.where(F.col("claim_kind") == "label"), "claim_id"
    )
    anchors = members.groupBy("entity_id").agg(
        F.min("address").alias("anchor"), F.count("*").alias("active_member_count")
    )
    cluster = stable_id(F.lit("entity_cluster"), F.col("entity_id"))
    return members.join(anchors, "entity_id").select(
        cluster.alias("cluster_id"), F.concat_ws(":", F.lit(run_id), cluster).alias("cluster_version"),
        "entity_id", F.col("address").alias("subject_id"), F.col("anchor").alias("left_subject_id"),
        "active_member_count", "confidence", "address_role",
        stable_id(F.lit("cluster_claim"), F.lit(run_id), cluster, F.col("address")).alias("cluster_claim_id"),
        F.lit("reviewed_entity").alias("heuristic"),
    )


def deployment_control(txs: DataFrame, run_id: str) -> DataFrame:
    """Deployer and contract of every successful deployment."""
    return txs.where((F.col("status") == 1) & (F.coalesce("contract_address", F.lit("")) != "")).select(
        stable_id(F.lit("deployment_control"), F.lit(run_id), F.col("tx_hash")).alias("claim_id"),
        F.concat(F.lit("control:"), "tx_hash").alias("cluster_id"), F.col("contract_address").alias("subject_id"),
        F.col("from_address").alias("left_subject_id"), F.lit(1.0).alias("confidence"),
        F.lit("contract_deployment_control").alias("heuristic"), F.lit("pending").alias("review_status"),
    )


def changed_claims(new: DataFrame, existing: DataFrame, compared: Sequence[str]) -> DataFrame:
    """New claims that differ from the latest of the same address, cluster and method."""
    keys = ["address", "cluster_id", "claim_method"]
    newest = latest(existing, keys, "created_at_unix_ms")
    content = [*keys, *compared]
    a = new.withColumn("__content", stable_id(*[F.col(c) for c in content]))
    b = newest.select(stable_id(*[F.col(c) for c in content]).alias("__content"))
    return a.join(b, "__content", "left_anti").drop("__content")

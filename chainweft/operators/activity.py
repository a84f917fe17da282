"""Per-wallet aggregates of account transfers and unspent-output legs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.functions import wide
from chainweft.functions.ids import DAY_MS, bucket_start, day_start
from chainweft.functions.ordered import dealt, top_per_group, with_group_totals, with_part_totals
from chainweft.operators.scope import wallet_edges
from chainweft.session import materialise

TS = "block_timestamp_unix_ms"
OCCURRENCE = [
    "network_id", "block_number", "block_hash", "block_timestamp_unix_ms", "commit_id",
    "revision", "tx_hash", "transaction_index",
]


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _incoming() -> Column:
    """Rows of :func:`wallet_edges` that credit the wallet (self-transfers do both)."""
    return (F.col("direction") == "in") | (F.col("wallet") == F.col("peer"))


def _outgoing() -> Column:
    return F.col("direction") == "out"


# unspent outputs ---------------------------------------------------------


def wallet_legs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per wallet and transaction occurrence: legs and value of both sides."""
    spent = inputs.select(
        F.col("address").alias("wallet"), *OCCURRENCE, F.col("value_sats").alias("spent"),
        F.lit(None).cast("bigint").alias("received"),
    )
    received = outputs.select(
        F.col("address").alias("wallet"), *OCCURRENCE, F.lit(None).cast("bigint").alias("spent"),
        F.col("value_sats").alias("received"),
    )
    return (
        spent.unionByName(received)
        .where(F.col("wallet").isNotNull())
        .groupBy("wallet", *OCCURRENCE)
        .agg(
            F.count("spent").alias("spent_input_count"),
            F.count("received").alias("received_output_count"),
            F.coalesce(F.sum("spent"), F.lit(0)).alias("spent_sats"),
            F.coalesce(F.sum("received"), F.lit(0)).alias("received_sats"),
        )
    )


def involved(legs: DataFrame, txs: DataFrame) -> DataFrame:
    """Wallet legs with the counters of exactly their transaction occurrence."""
    return legs.join(
        txs.select(*OCCURRENCE, "coinbase", "input_count", "output_count", "fee_sats"), OCCURRENCE
    )


def utxo_summary(scoped: DataFrame) -> DataFrame:
    """The 22 wallet measures over matched transactions."""
    received, spent = F.col("received_output_count"), F.col("spent_input_count")
    coinbase = F.col("coinbase") == 1
    # One row per (wallet, transaction) comes in, so days fold to (wallet, day)
    # first: distinct days become a plain count and the hot wallets are split.
    daily = scoped.groupBy("wallet", F.floor(F.col(TS) / DAY_MS).alias("day")).agg(
        F.count("*").alias("n"),
        F.sum(spent).alias("si"),
        F.sum(received).alias("ro"),
        _n(received > 0).alias("rt"),
        _n(spent > 0).alias("st"),
        _n((received > 0) & (spent > 0)).alias("bt"),
        _n(coinbase).alias("ct"),
        F.sum("received_sats").alias("rs"),
        F.sum("spent_sats").alias("ss"),
        F.sum(F.when(~coinbase, F.col("fee_sats"))).alias("fi"),
        F.sum(F.when(spent > 0, F.col("fee_sats"))).alias("fs"),
        F.min(TS).alias("t0"),
        F.max(TS).alias("t1"),
        F.min("block_number").alias("b0"),
        F.max("block_number").alias("b1"),
        F.max(F.when(coinbase, 0).otherwise(F.col("input_count"))).alias("mi"),
        F.max("output_count").alias("mo"),
        _n(~coinbase & (F.col("input_count") > 1)).alias("xi"),
        _n(F.col("output_count") > 1).alias("xo"),
    )

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    def exact(c: str) -> Column:
        return F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("string")

    return daily.groupBy("wallet").agg(
        total("n").alias("transaction_count"),
        total("si").alias("spent_input_count"),
        total("ro").alias("received_output_count"),
        (total("si") + total("ro")).alias("transfer_count"),
        total("rt").alias("receiving_transactions"),
        total("st").alias("spending_transactions"),
        total("bt").alias("both_sides_transactions"),
        total("ct").alias("coinbase_transactions"),
        exact("rs").alias("received_sats"),
        exact("ss").alias("spent_sats"),
        F.sum((F.col("rs") - F.col("ss")).cast("decimal(20,0)")).cast("string").alias("net_flow_sats"),
        exact("fi").alias("fees_of_involved_transactions_sats"),
        exact("fs").alias("spending_transaction_fees_sats"),
        F.min("t0").alias("first_seen_unix_ms"),
        F.max("t1").alias("last_seen_unix_ms"),
        F.min("b0").alias("first_seen_block"),
        F.max("b1").alias("last_seen_block"),
        F.count("*").alias("active_days"),
        F.max("mi").alias("maximum_transaction_inputs"),
        F.max("mo").alias("maximum_transaction_outputs"),
        total("xi").alias("multi_input_transactions"),
        total("xo").alias("multi_output_transactions"),
    )


def utxo_daily(scoped: DataFrame) -> DataFrame:
    def exact(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("string")

    return scoped.groupBy("wallet", day_start(F.col(TS)).alias("day_unix_ms")).agg(
        F.count("*").alias("transactions"),
        F.sum("received_output_count").alias("received"),
        F.sum("spent_input_count").alias("spent"),
        exact(F.col("received_sats")).alias("received_sats"),
        exact(F.col("spent_sats")).alias("spent_sats"),
        exact(F.col("received_sats") - F.col("spent_sats")).alias("net_flow_sats"),
        exact(F.when(F.col("coinbase") == 0, F.col("fee_sats"))).alias(
            "fees_of_involved_transactions_sats"
        ),
    )


def utxo_counterparties(scoped: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Subjects on the other side of a wallet's transactions, with whole-set totals.

    ``scoped``: wallets with their transactions and leg counts, or the matched
    occurrences alone (no ``wallet``), which stand for every wallet in them.
    Legs are dealt by transaction once; both sides of a transaction are folds of
    that one shuffle and meet without another, one row for each wallet and
    subject of a transaction, which goes straight into the fold of its pair.
    The pairs are written once, so totals don't count them anew.
    """
    from chainweft.functions.ids import script_subject

    # One key for the occurrence: by its columns, constant ones would drop out of the joins and not out of the shuffle.
    # A null in it matches nothing.
    at, known = F.struct(*OCCURRENCE).alias("at"), reduce(Column.__and__, [F.col(c).isNotNull() for c in OCCURRENCE])

    def legs(rows: DataFrame, side: str) -> DataFrame:
        # the script stands for subjects without an address until pairs are folded; its digest is longer
        return rows.where(known).select(
            at, F.col("address").alias("wallet"), F.when(F.col("address").isNull(), F.col("script_hex")).alias("script"),
            *[F.lit(side == s).alias(s) for s in ("paid", "got")],
        )

    dealt_legs = legs(inputs, "paid").unionByName(legs(outputs, "got")).repartition("at")
    # ``kind`` is read off a measure: a filter on a key would sink below the shuffle and split it in two
    subjects = dealt_legs.groupBy("at", "wallet", "script").agg(
        *[F.max(s).alias(s) for s in ("paid", "got")], F.max(F.col("wallet").isNotNull()).alias("kind"),
    )
    peers = subjects.select("at", F.col("wallet").alias("peer"), "script", F.col("paid").alias("up"), F.col("got").alias("down"))
    if "wallet" in scoped.columns:
        wallets = scoped.where(known).groupBy("wallet", at).agg(
            F.max(F.col("spent_input_count") > 0).alias("paid"), F.max(F.col("received_output_count") > 0).alias("got"),
        )
    else:
        # an inner join with distinct occurrences: a semi-join would sink below the shuffle as well
        wallets = subjects.where("kind").select("wallet", "at", "paid", "got").join(scoped.where(known).select(at).distinct(), "at")
    up, down = F.col("got") & F.col("up"), F.col("paid") & F.col("down")
    pairs = (
        wallets.join(peers, "at")
        .where((up | down) & (F.col("peer").isNull() | (F.col("peer") != F.col("wallet"))))
        .groupBy("wallet", "peer", "script")
        .agg(
            F.count("*").alias("transaction_count"),
            _n(up).alias("upstream_transactions"),
            _n(down).alias("downstream_transactions"),
            F.min(F.col("at")[TS]).alias("first_seen_unix_ms"),
            F.max(F.col("at")[TS]).alias("last_seen_unix_ms"),
        )
    )
    found = with_group_totals(
        materialise(pairs, "counterparties"),
        ["wallet"],
        total_counterparties=F.count("*"),
        upstream_subjects=_n(F.col("upstream_transactions") > 0),
        downstream_subjects=_n(F.col("downstream_transactions") > 0),
    )
    return found.select(
        "wallet", F.when(F.col("peer").isNull(), "script").otherwise("address").alias("subject_type"),
        script_subject(F.col("peer"), F.col("script")).alias("subject_id"), *[c for c in found.columns if c not in ("wallet", "peer", "script")],
    )


def utxo_balances(states: DataFrame, height: int | Column) -> DataFrame:
    """Unspent value per wallet; a coinbase output needs 100 confirmations."""
    at = F.lit(height) if isinstance(height, int) else height
    unspent = F.col("is_spent") == 0
    depth = at - F.col("block_number")
    young = (F.col("coinbase") == 1) & (depth < 100)
    ready = (F.col("coinbase") == 0) | (depth >= 99)

    def exact(keep: Column) -> Column:
        value = F.when(keep, F.col("value_sats")).cast("decimal(20,0)")
        return F.coalesce(F.sum(value), F.lit(0)).cast("string")

    return states.groupBy(F.col("address").alias("wallet")).agg(
        F.count("*").alias("latest_output_count"),
        _n(~unspent).alias("spent_output_count"),
        _n(unspent).alias("utxo_count"),
        exact(unspent).alias("balance_sats"),
        exact(unspent & young).alias("immature_sats"),
        exact(unspent & ready).alias("eligible_next_block_sats"),
    )


# accounts ----------------------------------------------------------------


def fingerprint(edges: DataFrame) -> DataFrame:
    """Transfers in and out, distinct counterparties, first and last seen."""
    # (wallet, peer) first: the distinct count becomes a row count and a wallet
    # with a third of all transfers is spread over its peers.
    pairs = wallet_edges(edges).groupBy("wallet", "peer").agg(
        F.count("*").alias("n"),
        _n(_incoming()).alias("i"),
        _n(_outgoing()).alias("o"),
        F.min(TS).alias("t0"),
        F.max(TS).alias("t1"),
    )
    return pairs.groupBy("wallet").agg(
        F.sum("n").alias("transfer_count"),
        F.sum("i").alias("inbound_transfers"),
        F.sum("o").alias("outbound_transfers"),
        F.count("*").alias("unique_counterparties"),
        F.min("t0").alias("first_seen_unix_ms"),
        F.max("t1").alias("last_seen_unix_ms"),
    )


def tx_summary(txs: DataFrame) -> DataFrame:
    """Transactions, failures and contract calls a wallet takes part in; fees it paid."""
    sides = F.array_compact(F.array_distinct(F.array("from_address", "to_address")))
    call = (F.col("input_data") != "") & (F.col("input_data") != "0x")
    per = txs.select("*", F.explode(sides).alias("wallet"))
    return per.groupBy("wallet").agg(
        F.count("*").alias("transaction_count"),
        _n(F.col("status") == 0).alias("failed_transactions"),
        _n(call).alias("contract_calls"),
        wide.total(F.col("fee_raw"), F.col("from_address") == F.col("wallet")).alias("paid_fees_raw"),
    )


def semantic_counts(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.groupBy(F.col("subject_id").alias("wallet")).agg(
        _n(kind == "swap").alias("swap_events"),
        _n(kind.startswith("bridge")).alias("bridge_events"),
        _n(kind.startswith("mixer_")).alias("mixer_events"),
        _n(kind.startswith("liquidity_")).alias("liquidity_events"),
    )


def asset_flows(edges: DataFrame) -> DataFrame:
    """Exact amounts and counts per wallet, asset and token."""
    amount = F.col("amount_raw")
    return wallet_edges(edges).groupBy("wallet", "asset_id", "token_id").agg(
        wide.total(amount, _incoming()).alias("inbound_amount"),
        wide.total(amount, _outgoing()).alias("outbound_amount"),
        _n(_incoming()).alias("inbound_transfers"),
        _n(_outgoing()).alias("outbound_transfers"),
        F.count("*").alias("transfer_count"),
    )


def counterparties(edges: DataFrame) -> DataFrame:
    """Peers of each wallet with their share of its transfers."""
    pairs = wallet_edges(edges).groupBy("wallet", "peer").agg(
        _n(_incoming()).alias("inbound_transfers"),
        _n(_outgoing()).alias("outbound_transfers"),
        F.count("*").alias("total_transfers"),
        F.max(TS).alias("last_seen_unix_ms"),
    )
    return with_group_totals(pairs, ["wallet"], __all=F.sum("total_transfers")).withColumn(
        "transfer_share", F.col("total_transfers") / F.col("__all")
    ).drop("__all")


def daily_activity(edges: DataFrame) -> DataFrame:
    return wallet_edges(edges).groupBy("wallet", day_start(F.col(TS)).alias("day_unix_ms")).agg(
        _n(_incoming()).alias("received"),
        _n(_outgoing()).alias("sent"),
        F.countDistinct("tx_hash").alias("transactions"),
    )


def enrich(edges: DataFrame, features: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Wallet rows with transaction flags and the peer's exchange confidence.

    The right sides hold one row per key before they are joined, so no wallet
    row is multiplied; transaction flags join before the endpoint explosion.
    """
    flags = [
        "is_swap", "is_bridge", "is_mint", "is_burn", "is_liquidity_add",
        "is_liquidity_remove", "is_contract_call",
    ]
    per_tx = features.groupBy("tx_hash").agg(*[F.max(f).alias(f) for f in flags])
    known = exchanges.groupBy(F.col("address").alias("peer")).agg(
        F.max("confidence").alias("exchange_confidence")
    )
    flagged = edges.join(per_tx, "tx_hash", "left")
    out = wallet_edges(flagged).join(known, "peer", "left")
    return out.withColumns({f: F.coalesce(f, F.lit(0)) for f in flags})


def wallet_aggregate(enriched: DataFrame) -> DataFrame:
    """Counts, exact volumes, active days and diversity per wallet.

    Two folds instead of one aggregate with five distinct counts, which would
    copy every row, amounts included, once per distinct count: (wallet, peer,
    direction) carries counts and volumes, and the three remaining distinct counts
    run over three narrow columns.  Most pairs have one transfer, so rows are
    dealt by wallet and part of its peers as they are, flags as bits of one
    number, and folded to pairs and then to parts of a wallet where they lie.
    """
    ins, outs = _incoming(), _outgoing()
    marks = {"swap": F.col("is_swap") > 0, "bridge": F.col("is_bridge") > 0, "call": F.col("is_contract_call") > 0,
             "exchange": F.coalesce("exchange_confidence", F.lit(0.0)) > 0}
    bits = reduce(Column.bitwiseOR, [F.when(m, 1 << k).otherwise(0) for k, m in enumerate(marks.values())])
    rows = dealt(enriched.select("wallet", "peer", "direction", "amount_raw", TS, bits.alias("marks")), ["wallet"], "peer")
    pairs = rows.groupBy("wallet", "__part", "peer", "direction").agg(
        F.count("*").alias("n"), *[F.sum(p).alias(f"l{k}") for k, p in enumerate(wide.limbs(F.col("amount_raw")))],
        F.min(TS).alias("t0"), F.max(TS).alias("t1"),
        *[_n(F.col("marks").bitwiseAND(1 << k) != 0).alias(m) for k, m in enumerate(marks)],
    )
    volume = lambda side: [F.sum(F.when(side, F.col(f"l{k}"))) for k in range(wide.LIMBS)]
    number = lambda side: F.sum(F.when(side, F.col("n")).otherwise(0))
    sums = {"n": F.sum("n"), "ni": number(ins), "no": number(outs), "pi": _n(ins), "po": _n(outs), **{m: F.sum(m) for m in marks}}
    sides = {f"{d}{k}": limb for d, side in (("i", ins), ("o", outs)) for k, limb in enumerate(volume(side))}
    parts = pairs.groupBy("wallet", "__part").agg(
        *[c.alias(name) for name, c in sums.items()], *[c.cast(f"decimal({wide.DIGITS + 10},0)").alias(name) for name, c in sides.items()],
        F.min("t0").alias("t0"), F.max("t1").alias("t1"),
    )
    raw = lambda d: wide.joined([F.coalesce(F.sum(f"{d}{k}"), F.lit(0)).cast("decimal(37,0)") for k in range(wide.LIMBS)])
    flows = parts.groupBy("wallet").agg(
        F.sum("n").alias("total_transfers"),
        F.sum("ni").alias("incoming_transfers"), F.sum("no").alias("outgoing_transfers"),
        F.sum("pi").alias("unique_senders"), F.sum("po").alias("unique_receivers"),
        raw("i").alias("total_volume_in_raw"), raw("o").alias("total_volume_out_raw"),
        F.min("t0").alias("first_seen_timestamp"), F.max("t1").alias("last_seen_timestamp"),
        F.sum("swap").alias("swap_transfers"), F.sum("bridge").alias("bridge_transfers"),
        F.sum("call").alias("contract_call_transfers"), F.sum("exchange").alias("exchange_transfers"),
    )
    spread = enriched.groupBy("wallet").agg(
        F.countDistinct("tx_hash").alias("unique_transactions"),
        F.countDistinct(F.floor(F.col(TS) / DAY_MS)).alias("active_days"),
        F.countDistinct("asset_id").alias("token_diversity"),
    )
    return flows.join(spread, "wallet")


def trend_bucket_ms(days: int | None) -> int:
    """Day buckets up to 120 days, weeks up to 730, else 30 days."""
    if not days or days > 730:
        return 30 * DAY_MS
    return 7 * DAY_MS if days > 120 else DAY_MS


def flow_trend(enriched: DataFrame, days: int | None) -> DataFrame:
    """Transfers and distinct transactions by operation, per wallet and bucket."""
    bucket = bucket_start(F.col(TS), trend_bucket_ms(days)).alias("bucket_start_unix_ms")
    flags = [
        "swap", "bridge", "mint", "burn", "liquidity_add", "liquidity_remove", "contract_call",
    ]
    # Flags belong to the transaction, so one row per transaction and bucket
    # carries all eight distinct counts; the flags are bits of one number.
    bits = [F.when(F.col(f"is_{f}") > 0, 1 << k).otherwise(0) for k, f in enumerate(flags)]
    per_tx = enriched.groupBy("wallet", bucket, "tx_hash").agg(
        _n(_incoming()).alias("i"),
        _n(_outgoing()).alias("o"),
        F.bit_or(reduce(Column.bitwiseOR, bits)).alias("marks"),
    )
    return per_tx.groupBy("wallet", "bucket_start_unix_ms").agg(
        F.sum("i").alias("incoming_transfers"),
        F.sum("o").alias("outgoing_transfers"),
        F.count("*").alias("unique_transactions"),
        *[_n(F.col("marks").bitwiseAND(1 << k) != 0).alias(f"{f}_transactions") for k, f in enumerate(flags)],
    )


def trend_summary(trend: DataFrame) -> DataFrame:
    measures = [c for c in trend.columns if c not in ("wallet", "bucket_start_unix_ms")]
    return trend.groupBy("wallet").agg(*[F.sum(m).alias(m) for m in measures])


def token_usage(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most used assets of every wallet."""
    per_tx = wallet_edges(edges).groupBy("wallet", "asset_id", "tx_hash").agg(
        F.count("*").alias("n"), *_limb_sums("amount_raw")
    )
    usage = per_tx.groupBy("wallet", "asset_id").agg(
        F.sum("n").alias("transfer_count"),
        F.count("*").alias("unique_transactions"),
        wide.joined(_limb_totals()).alias("volume_raw"),
    )
    return top_per_group(usage, ["wallet"], [F.desc("transfer_count"), F.col("asset_id")], k)


def _limb_sums(amount: str) -> list[Column]:
    return [F.sum(p).alias(f"__l{i}") for i, p in enumerate(wide.limbs(F.col(amount)))]


def _limb_totals() -> list[Column]:
    return [F.coalesce(F.sum(f"__l{i}"), F.lit(0)) for i in range(wide.LIMBS)]


def peer_profiles(edges: DataFrame) -> DataFrame:
    """Senders and receivers of every wallet with dominant asset and share.

    Wallet rows are dealt by wallet and part of its peers once; both folds and
    the wallet's total, counted from the rows themselves, meet there.
    """
    role = F.when(F.col("direction") == "in", "sender").otherwise("receiver")
    rows = dealt(
        wallet_edges(edges).select("wallet", "peer", role.alias("role"), "asset_id", TS, "amount_raw"), ["wallet"], "peer"
    )
    by_asset = rows.groupBy("wallet", "__part", "peer", "role", "asset_id").agg(
        F.count("*").alias("n"),
        F.min(TS).alias("t0"),
        F.max(TS).alias("t1"),
        *_limb_sums("amount_raw"),
    )
    profile = by_asset.groupBy("wallet", "__part", "peer", "role").agg(
        F.sum("n").alias("transfer_count"),
        wide.joined(_limb_totals()).alias("total_volume_raw"),
        F.min("t0").alias("first_seen_timestamp"),
        F.max("t1").alias("last_seen_timestamp"),
        F.count("*").alias("token_count"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("asset_id").alias("a")))["a"].alias(
            "dominant_token"
        ),
    )
    all_ = wallet_edges(edges).groupBy("wallet").agg(F.count("*").alias("__all"))
    return with_part_totals(profile, ["wallet"], all_).withColumn(
        "share_of_wallet_transfers", F.col("transfer_count") / F.col("__all")
    ).drop("__all")


def address_activity(edges: DataFrame, **at_least: int) -> DataFrame:
    """Counts per endpoint; keyword thresholds keep rows at or above them."""
    sides = F.array(
        F.struct(F.col("from_address").alias("address"), F.col("to_address").alias("receiver"),
                 F.lit(None).cast("string").alias("sender")),
        F.struct(F.col("to_address").alias("address"), F.lit(None).cast("string").alias("receiver"),
                 F.col("from_address").alias("sender")),
    )
    per = edges.select("block_number", F.inline(sides)).where(F.col("address") != "")
    pairs = per.groupBy("address", "sender", "receiver").agg(
        F.count("*").alias("n"),
        F.min("block_number").alias("b0"),
        F.max("block_number").alias("b1"),
    )
    sent, got = F.col("receiver").isNotNull(), F.col("sender").isNotNull()
    activity = pairs.groupBy("address").agg(
        F.coalesce(F.sum(F.when(got, F.col("n"))), F.lit(0)).alias("inbound_txs"),
        F.coalesce(F.sum(F.when(sent, F.col("n"))), F.lit(0)).alias("outbound_txs"),
        _n(got).alias("unique_senders"),
        _n(sent).alias("unique_receivers"),
        F.min("b0").alias("first_seen_block"),
        F.max("b1").alias("last_seen_block"),
    )
    for column, least in at_least.items():
        activity = activity.where(F.col(column) >= least)
    return activity


# What makes an exchange address an anchor.
ANCHOR_ROLES = ("HOT", "SWEEP", "TREASURY", "INTERNAL")
ANCHOR_CONFIDENCE = 0.80


def anchor_sweeps(edges: DataFrame, exchanges: DataFrame, samples: int = 20) -> DataFrame:
    """Transfers into known service addresses, with up to ``samples`` hashes.

    Sample hashes are ranked after deduplication, so each task sends at most
    ``samples`` of them per pair.
    """
    anchors = exchanges.where(
        F.col("address_role").isin(*ANCHOR_ROLES) & (F.col("confidence") >= ANCHOR_CONFIDENCE)
    ).select(
        F.col("address").alias("to_address"),
        F.col("entity_id").alias("anchor_entity_id"),
        F.col("confidence").alias("anchor_confidence"),
    )
    into = edges.where(
        (F.col("from_address") != "") & (F.col("from_address") != F.col("to_address"))
    ).join(anchors, "to_address")
    keys = ["from_address", "to_address", "anchor_entity_id", "anchor_confidence"]
    per_tx = into.groupBy(*keys, "tx_hash").agg(
        F.count("*").alias("n"),
        F.min("block_number").alias("b0"),
        F.max("block_number").alias("b1"),
    )
    counts = per_tx.groupBy(*keys).agg(
        F.sum("n").alias("sweep_count"),
        F.min("b0").alias("first_seen_block"),
        F.max("b1").alias("last_seen_block"),
    )
    shown = top_per_group(per_tx.select(*keys, "tx_hash"), keys, [F.col("tx_hash")], samples)
    lists = shown.groupBy(*keys).agg(
        F.array_sort(F.collect_list("tx_hash")).alias("evidence_tx_hashes")
    )
    return counts.join(lists, keys).withColumnsRenamed(
        {"from_address": "candidate_address", "to_address": "anchor_address"}
    )


# flows inside transactions -------------------------------------------------


def net_flows(edges: DataFrame, keys: Sequence[str] = ("tx_hash",)) -> DataFrame:
    """Signed exact net flow per transaction, address and asset; self-transfers cancel."""
    moved = edges.where(F.col("from_address") != F.col("to_address"))
    sides = F.array(
        F.struct(F.col("from_address").alias("address"), F.lit(None).cast("string").alias("plus"),
                 F.col("amount_raw").alias("minus")),
        F.struct(F.col("to_address").alias("address"), F.col("amount_raw").alias("plus"),
                 F.lit(None).cast("string").alias("minus")),
    )
    per = moved.select(*keys, "asset_id", F.inline(sides))
    out = per.groupBy(*keys, "address", "asset_id").agg(
        wide.net(F.col("plus"), F.col("minus")).alias("net_raw")
    )
    return out.withColumn("sign", wide.sign(F.col("net_raw")))


def boundary_flows(edges: DataFrame, txs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Fungible flow across a contract's boundary, per transaction and contract.

    ``contracts``: tx_hash, contract.  When a leg touches the contract the
    contract is the boundary, otherwise the initiator is; the two are never
    mixed, which would count routed legs twice.
    """
    pairs = contracts.select("tx_hash", "contract").distinct()
    legs = (
        edges.join(pairs, "tx_hash")
        .join(txs.select("tx_hash", F.col("from_address").alias("initiator")), "tx_hash")
        .withColumn(
            "touches",
            ((F.col("from_address") == F.col("contract")) | (F.col("to_address") == F.col("contract"))).cast("int"),
        )
    )
    keys = ["tx_hash", "contract"]
    # legs lie by transaction already; a window over one transaction and contract moves none
    legs = legs.where(F.col("contract").isNotNull()).withColumn("at_contract", F.max("touches").over(Window.partitionBy(*keys)))
    from chainweft.functions.ids import ZERO_ADDRESS

    real = legs.where(
        (F.coalesce("token_id", F.lit("")) == "")
        & (F.col("from_address") != F.col("to_address"))
        & (F.col("amount_raw") != "0")
    )
    at = F.col("at_contract") == 1
    inbound = F.when(at, F.col("to_address") == F.col("contract")).otherwise(
        F.col("from_address") == F.col("initiator")
    ) & (F.col("to_address") != ZERO_ADDRESS)
    outbound = F.when(at, F.col("from_address") == F.col("contract")).otherwise(
        F.col("to_address") == F.col("initiator")
    ) & (F.col("from_address") != ZERO_ADDRESS)
    per_asset = real.groupBy(*keys, "at_contract", "asset_id").agg(
        wide.total(F.col("amount_raw"), inbound).alias("amount_in"),
        wide.total(F.col("amount_raw"), outbound).alias("amount_out"),
        F.count_if(inbound).alias("legs_in"),
        F.count_if(outbound).alias("legs_out"),
    )
    return per_asset.where((F.col("legs_in") > 0) | (F.col("legs_out") > 0)).withColumn(
        "boundary", F.when(at, "protocol").otherwise("subject")
    ).drop("at_contract")


def net_balances(edges: DataFrame) -> DataFrame:
    """Indexed net balance per wallet and asset."""
    return net_flows(edges, keys=("network_id",)).withColumnsRenamed(
        {"address": "wallet", "net_raw": "balance_raw"}
    )


def exposure_summary(exposures: DataFrame, seeds: DataFrame) -> DataFrame:
    """Best row per source, then one combined score per wallet.

    Sources count as independent: ``1 - prod(1 - min(score, 0.99))``.
    """
    live = seeds.where((F.col("risk_level") > 0) & (F.col("is_active") == 1)).groupBy(
        F.col("address").alias("source_address")
    ).agg(F.max("risk_level").alias("source_risk_level"))
    rows = exposures.join(live, "source_address")
    best = rows.groupBy("exposed_address", "source_address").agg(
        F.max("source_risk_level").alias("source_risk_level"),
        F.min("hop_distance").alias("hop_distance"),
        F.max("exposure_score").alias("exposure_score"),
        F.sum("path_count").alias("path_count"),
        F.max("last_seen_block").alias("last_seen_block"),
    )
    effective = F.least(
        F.greatest(F.col("exposure_score") * F.least(F.col("source_risk_level") / 100.0, F.lit(1.0)), F.lit(0.0)),
        F.lit(1.0),
    )
    best = best.withColumn("effective_score", effective)
    kept = F.log(F.lit(1.0) - F.least(F.col("effective_score"), F.lit(0.99)))
    return best.groupBy(F.col("exposed_address").alias("wallet")).agg(
        (F.lit(1.0) - F.exp(F.sum(kept))).alias("score"),
        F.count("*").alias("source_count"),
        F.sum("path_count").alias("path_count"),
        F.min("hop_distance").alias("min_hop_distance"),
        F.max("exposure_score").alias("max_path_score"),
    )


def busiest(edges: DataFrame, from_block: int, to_block: int, k: int = 20) -> DataFrame:
    """The wallets with the most transfers in a block range."""
    part = edges.where(F.col("block_number").between(from_block, to_block))
    ends = part.select(F.explode(F.array("from_address", "to_address")).alias("wallet"))
    counts = ends.where(F.col("wallet") != "").groupBy("wallet").agg(F.count("*").alias("transfers"))
    return counts.orderBy(F.desc("transfers"), "wallet").limit(k)


def node_degrees(edges: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """In and out degree of every endpoint; focus wallets appear even without edges."""
    sides = F.array(
        F.struct(F.col("from_address").alias("address"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("to_address").alias("address"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    ends = edges.select(F.inline(sides)).withColumn("f", F.lit(0))
    if focus is not None:
        ends = ends.unionByName(
            focus.select("address", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("f"))
        )
    return ends.groupBy("address").agg(
        F.sum("i").alias("inbound_edges"),
        F.sum("o").alias("outbound_edges"),
        F.max("f").alias("is_focus"),
    )


def evaluate(cases: DataFrame) -> DataFrame:
    """Confusion counts, abstentions, precision and recall per network.

    ``cases``: network_id, expected (0/1), predicted (0/1, null = abstained).
    """
    want, got = F.col("expected") == 1, F.col("predicted")
    said = got.isNotNull()
    tp, fp = _n(want & said & (got == 1)), _n(~want & said & (got == 1))
    fn, tn = _n(want & said & (got == 0)), _n(~want & said & (got == 0))
    counts = cases.groupBy("network_id").agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        _n(~said).alias("abstained"), _n(~said & want).alias("abstained_positive"),
    )
    hits = F.col("tp")
    return counts.withColumns(
        {
            "precision": F.when(hits + F.col("fp") > 0, hits / (hits + F.col("fp"))),
            "recall": F.when(hits + F.col("fn") > 0, hits / (hits + F.col("fn"))),
        }
    )

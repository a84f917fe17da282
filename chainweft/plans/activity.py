"""Queries over per-wallet activity (inventory section E and the overview)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.operators import activity as op
from chainweft.operators import matching, series, visibility
from chainweft.plans.registry import query
from chainweft.sources.tables import Tables


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _scoped(t: Tables) -> DataFrame:
    return op.involved(op.wallet_legs(t.utxo_inputs(), t.utxo_outputs()), t.utxo_txs())


@query(
    "wallet_overview",
    """
    WITH pairs AS (SELECT wallet, peer, count(*) AS n, max(block_timestamp_unix_ms) AS t1 FROM wallet_edges GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY n DESC, peer) AS rank,
        sum(n) OVER (PARTITION BY wallet) AS transfers, count(*) OVER (PARTITION BY wallet) AS peers FROM pairs),
    vol AS (SELECT wallet, cast(sum(amount) FILTER (direction = 'in') AS varchar) AS received_raw,
        cast(sum(amount) FILTER (direction = 'out') AS varchar) AS sent_raw FROM wallet_edges GROUP BY 1)
    SELECT r.wallet, cast(transfers AS bigint) AS transfer_count, peers AS unique_counterparties, rank, peer,
        n AS peer_transfers, round(n / transfers, 6) AS transfer_share,
        coalesce(received_raw, '0') AS received_raw, coalesce(sent_raw, '0') AS sent_raw
    FROM ranked r JOIN vol USING (wallet) WHERE rank <= 5
    """,
)
def wallet_overview(t: Tables) -> DataFrame:
    """Per wallet: totals, exact volumes and its five main counterparties."""
    from chainweft.functions import wide
    from chainweft.functions.ordered import top_per_group
    from chainweft.operators.scope import wallet_edges

    # One pass folds transfers to (wallet, peer); totals and ranking use the fold.
    pairs = wallet_edges(t.edges()).groupBy("wallet", "peer").agg(
        F.count("*").alias("peer_transfers"),
        *[F.coalesce(F.sum(F.when(F.col("direction") == "in", p)), F.lit(0)).alias(f"i{k}")
          for k, p in enumerate(wide.limbs(F.col("amount_raw")))],
        *[F.coalesce(F.sum(F.when(F.col("direction") == "out", p)), F.lit(0)).alias(f"o{k}")
          for k, p in enumerate(wide.limbs(F.col("amount_raw")))],
    )
    totals = pairs.groupBy("wallet").agg(
        F.sum("peer_transfers").alias("transfer_count"),
        F.count("*").alias("unique_counterparties"),
        wide.joined([F.sum(f"i{k}") for k in range(wide.LIMBS)]).alias("received_raw"),
        wide.joined([F.sum(f"o{k}") for k in range(wide.LIMBS)]).alias("sent_raw"),
    )
    top = top_per_group(
        pairs.select("wallet", "peer", "peer_transfers"), ["wallet"],
        [F.desc("peer_transfers"), F.col("peer")], 5,
    )
    share = F.round(F.col("peer_transfers") / F.col("transfer_count"), 6)
    return top.join(totals, "wallet").withColumn("transfer_share", share)


@query(
    "e01_utxo_wallet_legs",
    """SELECT wallet, tx_hash, block_number, cast(spent_input_count AS bigint) AS spent_input_count,
        cast(received_output_count AS bigint) AS received_output_count,
        cast(spent_sats AS bigint) AS spent_sats, cast(received_sats AS bigint) AS received_sats FROM legs""",
)
def utxo_wallet_legs(t: Tables) -> DataFrame:
    return op.wallet_legs(t.utxo_inputs(), t.utxo_outputs()).select(
        "wallet", "tx_hash", "block_number", "spent_input_count", "received_output_count",
        "spent_sats", "received_sats",
    )


@query(
    "e02_utxo_wallet_summary",
    """SELECT wallet, count(*) AS transaction_count, cast(sum(spent_input_count) AS bigint) AS spent_input_count,
        cast(sum(received_output_count) AS bigint) AS received_output_count,
        cast(sum(spent_input_count + received_output_count) AS bigint) AS transfer_count,
        count(*) FILTER (received_output_count > 0) AS receiving_transactions,
        count(*) FILTER (spent_input_count > 0) AS spending_transactions,
        count(*) FILTER (received_output_count > 0 AND spent_input_count > 0) AS both_sides_transactions,
        count(*) FILTER (coinbase = 1) AS coinbase_transactions,
        cast(sum(received_sats) AS varchar) AS received_sats, cast(sum(spent_sats) AS varchar) AS spent_sats,
        cast(sum(received_sats) - sum(spent_sats) AS varchar) AS net_flow_sats,
        cast(coalesce(sum(fee_sats) FILTER (coinbase = 0), 0) AS varchar) AS fees_of_involved_transactions_sats,
        cast(coalesce(sum(fee_sats) FILTER (spent_input_count > 0), 0) AS varchar) AS spending_transaction_fees_sats,
        min(block_timestamp_unix_ms) AS first_seen_unix_ms, max(block_timestamp_unix_ms) AS last_seen_unix_ms,
        min(block_number) AS first_seen_block, max(block_number) AS last_seen_block,
        count(DISTINCT block_timestamp_unix_ms // 86400000) AS active_days,
        max(CASE WHEN coinbase = 1 THEN 0 ELSE input_count END) AS maximum_transaction_inputs,
        max(output_count) AS maximum_transaction_outputs,
        count(*) FILTER (coinbase = 0 AND input_count > 1) AS multi_input_transactions,
        count(*) FILTER (output_count > 1) AS multi_output_transactions
        FROM involved GROUP BY wallet""",
)
def utxo_wallet_summary(t: Tables) -> DataFrame:
    return op.utxo_summary(_scoped(t))


@query(
    "e03_utxo_daily_activity",
    """SELECT wallet, block_timestamp_unix_ms // 86400000 * 86400000 AS day_unix_ms, count(*) AS transactions,
        cast(sum(received_output_count) AS bigint) AS received, cast(sum(spent_input_count) AS bigint) AS spent,
        cast(sum(received_sats) AS varchar) AS received_sats, cast(sum(spent_sats) AS varchar) AS spent_sats,
        cast(sum(received_sats - spent_sats) AS varchar) AS net_flow_sats,
        cast(coalesce(sum(fee_sats) FILTER (coinbase = 0), 0) AS varchar) AS fees_of_involved_transactions_sats
        FROM involved GROUP BY 1, 2""",
)
def utxo_daily_activity(t: Tables) -> DataFrame:
    return op.utxo_daily(_scoped(t))


@query(
    "e04_utxo_counterparties",
    """WITH peers AS (
        SELECT s.wallet, CASE WHEN i.address IS NULL THEN 'script' ELSE 'address' END AS subject_type,
            coalesce(i.address, 'script:' || sha256(i.script_hex)) AS subject_id, i.tx_hash, 'up' AS role, i.block_timestamp_unix_ms
        FROM involved s JOIN inputs i USING (network_id, block_number, block_hash, commit_id, revision, tx_hash, transaction_index)
        WHERE s.received_output_count > 0 AND (i.address IS NULL OR i.address <> s.wallet)
        UNION ALL
        SELECT s.wallet, CASE WHEN o.address IS NULL THEN 'script' ELSE 'address' END,
            coalesce(o.address, 'script:' || sha256(o.script_hex)), o.tx_hash, 'down', o.block_timestamp_unix_ms
        FROM involved s JOIN outputs o USING (network_id, block_number, block_hash, commit_id, revision, tx_hash, transaction_index)
        WHERE s.spent_input_count > 0 AND (o.address IS NULL OR o.address <> s.wallet)),
    c AS (SELECT wallet, subject_type, subject_id, count(DISTINCT tx_hash) AS transaction_count,
        count(DISTINCT tx_hash) FILTER (role = 'up') AS upstream_transactions,
        count(DISTINCT tx_hash) FILTER (role = 'down') AS downstream_transactions,
        min(block_timestamp_unix_ms) AS first_seen_unix_ms, max(block_timestamp_unix_ms) AS last_seen_unix_ms
        FROM peers GROUP BY 1, 2, 3)
    SELECT *, count(*) OVER (PARTITION BY wallet) AS total_counterparties,
        count(*) FILTER (upstream_transactions > 0) OVER (PARTITION BY wallet) AS upstream_subjects,
        count(*) FILTER (downstream_transactions > 0) OVER (PARTITION BY wallet) AS downstream_subjects FROM c""",
)
def utxo_counterparties(t: Tables) -> DataFrame:
    """Every wallet's legs in the transactions of the block table; their counters aren't asked for."""
    return op.utxo_counterparties(t.utxo_headers(), t.utxo_inputs(), t.utxo_outputs())


@query(
    "e05_account_fingerprint",
    """SELECT wallet, count(*) AS transfer_count, count(*) FILTER (direction = 'in') AS inbound_transfers,
        count(*) FILTER (direction = 'out') AS outbound_transfers, count(DISTINCT peer) AS unique_counterparties,
        min(block_timestamp_unix_ms) AS first_seen_unix_ms, max(block_timestamp_unix_ms) AS last_seen_unix_ms
        FROM wallet_edges GROUP BY wallet""",
)
def account_fingerprint(t: Tables) -> DataFrame:
    return op.fingerprint(t.edges())


@query(
    "e06_account_tx_summary",
    """SELECT wallet, count(*) AS transaction_count, count(*) FILTER (status = 0) AS failed_transactions,
        count(*) FILTER (input_data NOT IN ('', '0x')) AS contract_calls,
        cast(coalesce(sum(fee) FILTER (from_address = wallet), 0) AS varchar) AS paid_fees_raw
        FROM (SELECT from_address AS wallet, * FROM txs UNION ALL SELECT to_address, * FROM txs) GROUP BY wallet""",
)
def account_tx_summary(t: Tables) -> DataFrame:
    return op.tx_summary(t.account_txs())


@query(
    "e07_semantic_counts",
    """SELECT subject_id AS wallet, count(*) FILTER (event_type = 'swap') AS swap_events,
        count(*) FILTER (starts_with(event_type, 'bridge')) AS bridge_events,
        count(*) FILTER (starts_with(event_type, 'mixer_')) AS mixer_events,
        count(*) FILTER (starts_with(event_type, 'liquidity_')) AS liquidity_events FROM sem GROUP BY 1""",
)
def semantic_counts(t: Tables) -> DataFrame:
    return op.semantic_counts(t.semantic_events())


@query(
    "e08_asset_flows",
    """SELECT wallet, asset_id, token_id,
        cast(coalesce(sum(amount) FILTER (direction = 'in'), 0) AS varchar) AS inbound_amount,
        cast(coalesce(sum(amount) FILTER (direction = 'out'), 0) AS varchar) AS outbound_amount,
        count(*) FILTER (direction = 'in') AS inbound_transfers, count(*) FILTER (direction = 'out') AS outbound_transfers,
        count(*) AS transfer_count FROM wallet_edges GROUP BY 1, 2, 3""",
)
def asset_flows(t: Tables) -> DataFrame:
    return op.asset_flows(t.edges())


@query(
    "e09_counterparty_shares",
    """SELECT wallet, peer, count(*) FILTER (direction = 'in') AS inbound_transfers,
        count(*) FILTER (direction = 'out') AS outbound_transfers, count(*) AS total_transfers,
        max(block_timestamp_unix_ms) AS last_seen_unix_ms,
        round(count(*) / sum(count(*)) OVER (PARTITION BY wallet), 6) AS transfer_share
        FROM wallet_edges GROUP BY 1, 2""",
)
def counterparty_shares(t: Tables) -> DataFrame:
    return _round(op.counterparties(t.edges()), "transfer_share")


@query(
    "e10_account_daily_activity",
    """SELECT wallet, block_timestamp_unix_ms // 86400000 * 86400000 AS day_unix_ms,
        count(*) FILTER (direction = 'in') AS received, count(*) FILTER (direction = 'out') AS sent,
        count(DISTINCT tx_hash) AS transactions FROM wallet_edges GROUP BY 1, 2""",
)
def account_daily_activity(t: Tables) -> DataFrame:
    return op.daily_activity(t.edges())


@query(
    "e11_wallet_aggregate",
    """SELECT wallet, count(*) AS total_transfers, count(DISTINCT tx_hash) AS unique_transactions,
        count(*) FILTER (direction = 'in') AS incoming_transfers, count(*) FILTER (direction = 'out') AS outgoing_transfers,
        count(DISTINCT peer) FILTER (direction = 'in') AS unique_senders,
        count(DISTINCT peer) FILTER (direction = 'out') AS unique_receivers,
        cast(coalesce(sum(amount) FILTER (direction = 'in'), 0) AS varchar) AS total_volume_in_raw,
        cast(coalesce(sum(amount) FILTER (direction = 'out'), 0) AS varchar) AS total_volume_out_raw,
        min(block_timestamp_unix_ms) AS first_seen_timestamp, max(block_timestamp_unix_ms) AS last_seen_timestamp,
        count(DISTINCT block_timestamp_unix_ms // 86400000) AS active_days, count(DISTINCT asset_id) AS token_diversity,
        count(*) FILTER (is_swap > 0) AS swap_transfers, count(*) FILTER (is_bridge > 0) AS bridge_transfers,
        count(*) FILTER (is_contract_call > 0) AS contract_call_transfers,
        count(*) FILTER (confidence > 0) AS exchange_transfers
        FROM wallet_edges LEFT JOIN features USING (tx_hash) LEFT JOIN exchanges x ON x.address = peer GROUP BY wallet""",
)
def wallet_aggregate(t: Tables) -> DataFrame:
    return op.wallet_aggregate(op.enrich(t.edges(), t.features(), t.exchanges()))


_TREND = """SELECT wallet, block_timestamp_unix_ms // 2592000000 * 2592000000 AS bucket_start_unix_ms,
        count(*) FILTER (direction = 'in') AS incoming_transfers, count(*) FILTER (direction = 'out') AS outgoing_transfers,
        count(DISTINCT tx_hash) AS unique_transactions,
        count(DISTINCT tx_hash) FILTER (is_swap > 0) AS swap_transactions,
        count(DISTINCT tx_hash) FILTER (is_bridge > 0) AS bridge_transactions,
        count(DISTINCT tx_hash) FILTER (is_mint > 0) AS mint_transactions,
        count(DISTINCT tx_hash) FILTER (is_burn > 0) AS burn_transactions,
        count(DISTINCT tx_hash) FILTER (is_liquidity_add > 0) AS liquidity_add_transactions,
        count(DISTINCT tx_hash) FILTER (is_liquidity_remove > 0) AS liquidity_remove_transactions,
        count(DISTINCT tx_hash) FILTER (is_contract_call > 0) AS contract_call_transactions
        FROM wallet_edges LEFT JOIN features USING (tx_hash) GROUP BY 1, 2"""


@query("e12_flow_trend", _TREND)
def flow_trend(t: Tables) -> DataFrame:
    return op.flow_trend(op.enrich(t.edges(), t.features(), t.exchanges()), None)


@query(
    "e12_flow_trend_total",
    f"""WITH trend AS ({_TREND}) SELECT wallet, cast(sum(incoming_transfers) AS bigint) AS incoming_transfers,
        cast(sum(outgoing_transfers) AS bigint) AS outgoing_transfers, cast(sum(unique_transactions) AS bigint) AS unique_transactions,
        cast(sum(swap_transactions) AS bigint) AS swap_transactions, cast(sum(bridge_transactions) AS bigint) AS bridge_transactions,
        cast(sum(mint_transactions) AS bigint) AS mint_transactions, cast(sum(burn_transactions) AS bigint) AS burn_transactions,
        cast(sum(liquidity_add_transactions) AS bigint) AS liquidity_add_transactions,
        cast(sum(liquidity_remove_transactions) AS bigint) AS liquidity_remove_transactions,
        cast(sum(contract_call_transactions) AS bigint) AS contract_call_transactions FROM trend GROUP BY wallet""",
)
def flow_trend_total(t: Tables) -> DataFrame:
    return op.trend_summary(flow_trend(t))


@query(
    "e13_token_usage",
    """SELECT * FROM (SELECT wallet, asset_id, count(*) AS transfer_count, count(DISTINCT tx_hash) AS unique_transactions,
        cast(sum(amount) AS varchar) AS volume_raw,
        row_number() OVER (PARTITION BY wallet ORDER BY count(*) DESC, asset_id) AS rank
        FROM wallet_edges GROUP BY 1, 2) WHERE rank <= 10""",
)
def token_usage(t: Tables) -> DataFrame:
    return op.token_usage(t.edges())


@query(
    "e14_peer_profiles",
    """WITH a AS (SELECT wallet, peer, CASE direction WHEN 'in' THEN 'sender' ELSE 'receiver' END AS role, asset_id,
        count(*) AS n, sum(amount) AS v, min(block_timestamp_unix_ms) AS t0, max(block_timestamp_unix_ms) AS t1
        FROM wallet_edges GROUP BY 1, 2, 3, 4),
    d AS (SELECT *, first_value(asset_id) OVER (PARTITION BY wallet, peer, role ORDER BY n DESC, asset_id) AS dom FROM a)
    SELECT wallet, peer, role, cast(sum(n) AS bigint) AS transfer_count, cast(sum(v) AS varchar) AS total_volume_raw,
        min(t0) AS first_seen_timestamp, max(t1) AS last_seen_timestamp, count(*) AS token_count, min(dom) AS dominant_token,
        round(sum(n) / sum(sum(n)) OVER (PARTITION BY wallet), 6) AS share_of_wallet_transfers
    FROM d GROUP BY 1, 2, 3""",
)
def peer_profiles(t: Tables) -> DataFrame:
    return _round(op.peer_profiles(t.edges()), "share_of_wallet_transfers")


_ACTIVITY = """SELECT wallet AS address, count(*) FILTER (direction = 'in') AS inbound_txs,
        count(*) FILTER (direction = 'out') AS outbound_txs,
        count(DISTINCT peer) FILTER (direction = 'in') AS unique_senders,
        count(DISTINCT peer) FILTER (direction = 'out') AS unique_receivers,
        min(block_number) AS first_seen_block, max(block_number) AS last_seen_block FROM wallet_edges GROUP BY 1"""


@query("e15_address_activity", f"SELECT * FROM ({_ACTIVITY}) WHERE inbound_txs >= 5 AND unique_senders >= 3")
def address_activity(t: Tables) -> DataFrame:
    return op.address_activity(t.edges(), inbound_txs=5, unique_senders=3)


@query(
    "e16_anchor_sweeps",
    """SELECT from_address AS candidate_address, to_address AS anchor_address, entity_id AS anchor_entity_id,
        confidence AS anchor_confidence, count(*) AS sweep_count, min(block_number) AS first_seen_block,
        max(block_number) AS last_seen_block,
        array_to_string(list_sort(list_distinct(list(tx_hash)))[:20], ',') AS evidence_tx_hashes
        FROM edges JOIN exchanges x ON x.address = to_address
        WHERE from_address <> to_address AND confidence >= 0.8 AND address_role IN ('HOT', 'SWEEP', 'TREASURY', 'INTERNAL')
        GROUP BY 1, 2, 3, 4""",
)
def anchor_sweeps(t: Tables) -> DataFrame:
    return op.anchor_sweeps(t.edges(), t.exchanges()).withColumn(
        "evidence_tx_hashes", F.array_join("evidence_tx_hashes", ",")
    )


@query(
    "e17_net_flows",
    """SELECT tx_hash, address, asset_id, cast(sum(v) AS varchar) AS net_raw, cast(sign(sum(v)) AS int) AS sign FROM (
        SELECT tx_hash, from_address AS address, asset_id, -amount AS v FROM edges WHERE from_address <> to_address
        UNION ALL SELECT tx_hash, to_address, asset_id, amount FROM edges WHERE from_address <> to_address) GROUP BY 1, 2, 3""",
)
def net_flows(t: Tables) -> DataFrame:
    return op.net_flows(t.edges())


@query(
    "e18_boundary_flows",
    f"""WITH c AS (SELECT DISTINCT tx_hash, to_address AS contract FROM txs),
    l AS (SELECT e.*, c.contract, x.from_address AS initiator,
        max(CASE WHEN e.from_address = c.contract OR e.to_address = c.contract THEN 1 ELSE 0 END) OVER (PARTITION BY tx_hash, contract) AS atc
        FROM edges e JOIN c USING (tx_hash) JOIN txs x USING (tx_hash)),
    s AS (SELECT *, (CASE WHEN atc = 1 THEN to_address = contract ELSE from_address = initiator END)
            AND to_address <> '0x0000000000000000000000000000000000000000' AS inb,
        (CASE WHEN atc = 1 THEN from_address = contract ELSE to_address = initiator END)
            AND from_address <> '0x0000000000000000000000000000000000000000' AS outb
        FROM l WHERE token_id IS NULL AND from_address <> to_address AND amount <> 0)
    SELECT tx_hash, contract, asset_id, cast(coalesce(sum(amount) FILTER (inb), 0) AS varchar) AS amount_in,
        cast(coalesce(sum(amount) FILTER (outb), 0) AS varchar) AS amount_out, count(*) FILTER (inb) AS legs_in,
        count(*) FILTER (outb) AS legs_out, CASE WHEN atc = 1 THEN 'protocol' ELSE 'subject' END AS boundary
    FROM s GROUP BY tx_hash, contract, asset_id, atc HAVING count(*) FILTER (inb OR outb) > 0""",
)
def boundary_flows(t: Tables) -> DataFrame:
    txs = t.account_txs()
    return op.boundary_flows(t.edges(), txs, txs.select("tx_hash", F.col("to_address").alias("contract")))


@query(
    "e19_net_balances",
    """SELECT network_id, address AS wallet, asset_id, cast(sum(v) AS varchar) AS balance_raw, cast(sign(sum(v)) AS int) AS sign FROM (
        SELECT network_id, from_address AS address, asset_id, -amount AS v FROM edges
        UNION ALL SELECT network_id, to_address, asset_id, amount FROM edges) GROUP BY 1, 2, 3""",
)
def net_balances(t: Tables) -> DataFrame:
    return op.net_balances(t.edges())


_STATES = """newest AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY tx_hash, output_index
        ORDER BY block_number DESC, transaction_index DESC, address DESC, value_sats DESC) = 1),
    used AS (SELECT prev_tx_hash, prev_output_index, block_number AS b, transaction_index AS i, tx_hash AS x FROM spends
        QUALIFY row_number() OVER (PARTITION BY prev_tx_hash, prev_output_index ORDER BY block_number DESC, transaction_index DESC, tx_hash DESC) = 1),
    st AS (SELECT n.*, CASE WHEN b IS NOT NULL AND (b, i) > (block_number, transaction_index) THEN 1 ELSE 0 END AS is_spent,
        CASE WHEN b IS NOT NULL AND (b, i) > (block_number, transaction_index) THEN x END AS spending_tx
        FROM newest n LEFT JOIN used u ON u.prev_tx_hash = n.tx_hash AND u.prev_output_index = n.output_index)"""


@query("d11_output_states", f"WITH {_STATES} SELECT * FROM st")
def output_states(t: Tables) -> DataFrame:
    return matching.output_states(t.occurrences(), t.spends())


@query(
    "e20_utxo_balances",
    f"""WITH {_STATES} SELECT address AS wallet, count(*) AS latest_output_count, count(*) FILTER (is_spent = 1) AS spent_output_count,
        count(*) FILTER (is_spent = 0) AS utxo_count,
        cast(coalesce(sum(value_sats) FILTER (is_spent = 0), 0) AS varchar) AS balance_sats,
        cast(coalesce(sum(value_sats) FILTER (is_spent = 0 AND coinbase = 1 AND 11000 - block_number < 100), 0) AS varchar) AS immature_sats,
        cast(coalesce(sum(value_sats) FILTER (is_spent = 0 AND (coinbase = 0 OR 11000 - block_number >= 99)), 0) AS varchar) AS eligible_next_block_sats
        FROM st GROUP BY 1""",
)
def utxo_balances(t: Tables) -> DataFrame:
    return op.utxo_balances(output_states(t), 11_000)


@query(
    "e22_failure_summary",
    """SELECT 'utxo:1' AS network_id, status, count(*) AS failures, max(last_failed_at_unix_ms) AS last_failed_at_unix_ms
        FROM (SELECT * FROM failures QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY revision DESC) = 1) GROUP BY 2""",
)
def failure_summary(t: Tables) -> DataFrame:
    from chainweft.operators import quality

    return quality.failure_summary(t.failures())


@query(
    "e22_journal_summary",
    """SELECT network_id, count(*) FILTER (ingestion_status = 'processing') AS processing_blocks,
        count(*) FILTER (ingestion_status = 'processing' AND block_timestamp_unix_ms < 1300050000000) AS stale_processing_blocks,
        count(*) FILTER (ingestion_status = 'failed') AS failed_blocks FROM current_blocks GROUP BY 1""",
)
def journal_summary(t: Tables) -> DataFrame:
    from chainweft.operators import quality

    return quality.journal_summary(t.blocks(), 1_300_050_000_000)


@query(
    "e23_block_coverage",
    """SELECT network_id, count(*) AS complete_blocks, min(block_number) AS first_synced_block, max(block_number) AS last_synced_block,
        count(*) FILTER (receipt_coverage = 1) AS receipt_complete_blocks, count(*) FILTER (trace_coverage = 1) AS trace_complete_blocks,
        count(*) FILTER (trace_coverage = 1) = count(*) AS internal_transfer_coverage,
        max(block_number) - min(block_number) + 1 = count(*) AS contiguous_indexed_range,
        max(block_number) - min(block_number) + 1 = count(*) AND min(block_number) = 0 AS history_from_genesis
        FROM canonical_blocks GROUP BY 1""",
)
def block_coverage(t: Tables) -> DataFrame:
    from chainweft.operators import quality

    return quality.coverage(visibility.canonical_blocks(t.blocks(), t.state()))


@query(
    "e24_busiest_wallets",
    """SELECT wallet, count(*) AS transfers FROM (SELECT from_address AS wallet, block_number FROM edges UNION ALL SELECT to_address, block_number FROM edges)
        WHERE block_number BETWEEN 14000000 AND 15500000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def busiest_wallets(t: Tables) -> DataFrame:
    return op.busiest(t.edges(), 14_000_000, 15_500_000)


@query(
    "e25_evaluation_metrics",
    """WITH c AS (SELECT asset_id AS network_id, CASE WHEN amount % 3 = 0 THEN 1 ELSE 0 END AS expected,
        CASE WHEN transfer_type = 'native_transfer' THEN NULL WHEN amount % 5 < 2 THEN 1 ELSE 0 END AS predicted FROM edges),
    k AS (SELECT network_id, count(*) FILTER (expected = 1 AND predicted = 1) AS tp, count(*) FILTER (expected = 0 AND predicted = 1) AS fp,
        count(*) FILTER (expected = 1 AND predicted = 0) AS fn, count(*) FILTER (expected = 0 AND predicted = 0) AS tn,
        count(*) FILTER (predicted IS NULL) AS abstained, count(*) FILTER (predicted IS NULL AND expected = 1) AS abstained_positive FROM c GROUP BY 1)
    SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM k""",
)
def evaluation_metrics(t: Tables) -> DataFrame:
    amount = F.col("amount_raw").cast("bigint")
    cases = t.edges().select(
        F.col("asset_id").alias("network_id"),
        (amount % 3 == 0).cast("int").alias("expected"),
        F.when(F.col("transfer_type") != "native_transfer", (amount % 5 < 2).cast("int")).alias("predicted"),
    )
    return _round(op.evaluate(cases), "precision", "recall")


@query(
    "e26_node_degrees",
    """WITH ends AS (SELECT from_address AS address, 0 AS i, 1 AS o, 0 AS f FROM edges UNION ALL SELECT to_address, 1, 0, 0 FROM edges
        UNION ALL SELECT 'C' || c_custkey, 0, 0, 1 FROM customer)
    SELECT address, cast(sum(i) AS bigint) AS inbound_edges, cast(sum(o) AS bigint) AS outbound_edges, max(f) AS is_focus FROM ends GROUP BY 1""",
)
def node_degrees(t: Tables) -> DataFrame:
    focus = t.raw("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("address"))
    return op.node_degrees(t.edges(), focus)


@query(
    "e27_exchange_interactions",
    """SELECT wallet, peer AS exchange_address, exchange_name, address_role AS exchange_role,
        CASE direction WHEN 'in' THEN 'incoming' ELSE 'outgoing' END AS direction, count(*) AS transfers,
        cast(sum(amount) AS varchar) AS amount_raw, max(confidence) AS confidence
        FROM wallet_edges JOIN exchanges x ON x.address = peer GROUP BY 1, 2, 3, 4, 5""",
)
def exchange_interactions(t: Tables) -> DataFrame:
    return matching.exchange_summary(t.edges(), t.exchanges())


@query("e27_incoming_origins", "SELECT DISTINCT to_address AS wallet, from_address AS origin FROM edges")
def incoming_origins(t: Tables) -> DataFrame:
    return matching.incoming_origins(t.edges())


@query(
    "f03_average_gap",
    """WITH x AS (SELECT wallet, tx_hash, min(block_timestamp_unix_ms) AS t FROM wallet_edges GROUP BY 1, 2),
    g AS (SELECT wallet, t, t - lag(t) OVER (PARTITION BY wallet ORDER BY t) AS gap FROM x)
    SELECT wallet, count(*) AS transactions, round(coalesce(sum(gap) / count(gap) / 1000.0, 0.0), 6) AS avg_gap_seconds FROM g GROUP BY 1""",
)
def average_gap(t: Tables) -> DataFrame:
    return _round(series.avg_gap(series.wallet_times(t.edges())), "avg_gap_seconds")


@query(
    "f04_burst_score",
    """WITH x AS (SELECT 'C' || user_id AS wallet, event_id, epoch_us(ts) // 1000 // 3600000 AS h FROM events),
    y AS (SELECT wallet, h, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT wallet, round(CASE WHEN sum(n) < 3 THEN 0.0 ELSE least(greatest((max(n) / (sum(n) / count(*)) - 1.0) / 9.0, 0.0), 1.0) END, 6) AS burst_score
    FROM y GROUP BY 1""",
)
def burst_score(t: Tables) -> DataFrame:
    times = t.semantic_events().select(
        F.col("subject_id").alias("wallet"), F.col("block_timestamp_unix_ms").alias("at")
    )
    return _round(series.burst_score(times), "burst_score")

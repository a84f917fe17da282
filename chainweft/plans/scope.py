"""Queries over filters, pages, windows and set operations (sections C, F, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.functions.ordered import top_per_group, with_group_totals
from chainweft.operators import activity, series, visibility
from chainweft.operators import scope as op
from chainweft.plans.registry import query
from chainweft.sources.tables import Tables


@query(
    "c01_scoped_transfers",
    """SELECT relationship_id, from_address, to_address, cast(amount AS varchar) AS amount_raw FROM edges
        WHERE block_number BETWEEN 14000000 AND 15000000 AND block_timestamp_unix_ms <= 899000000000 AND asset_id = 'asset:3'""",
)
def scoped_transfers(t: Tables) -> DataFrame:
    df = op.scope(t.edges(), from_block=14_000_000, to_block=15_000_000, to_ms=899_000_000_000, asset_id="asset:3")
    return df.select("relationship_id", "from_address", "to_address", "amount_raw")


@query("c01_incoming_of_wallet", "SELECT relationship_id, from_address FROM edges WHERE to_address = 'S3'")
def incoming_of_wallet(t: Tables) -> DataFrame:
    return op.scope(t.edges(), wallet="S3", direction="incoming").select("relationship_id", "from_address")


@query("c02_utxo_both_sides", "SELECT wallet, tx_hash FROM legs WHERE received_output_count > 0 AND spent_input_count > 0")
def utxo_both_sides(t: Tables) -> DataFrame:
    legs = activity.wallet_legs(t.utxo_inputs(), t.utxo_outputs())
    return op.utxo_direction(legs, "both").select("wallet", "tx_hash")


@query(
    "c03_keyset_page",
    """SELECT relationship_id, block_number, true AS has_more FROM edges
        WHERE (block_number, transaction_index, event_index, relationship_id) < (14700000, 0, 0, '')
        ORDER BY block_number DESC, transaction_index DESC, event_index DESC, relationship_id DESC LIMIT 50""",
)
def keyset_page(t: Tables) -> DataFrame:
    position = ["block_number", "transaction_index", "event_index", "relationship_id"]
    return op.page(t.edges(), [14_700_000, 0, 0, ""], 50, position).select(
        "relationship_id", "block_number", "has_more"
    )


@query(
    "c03_wallet_first_pages",
    """SELECT wallet, relationship_id, page_row FROM (SELECT *, row_number() OVER (PARTITION BY wallet
        ORDER BY block_number DESC, transaction_index DESC, event_index DESC, relationship_id DESC) AS page_row FROM wallet_edges) WHERE page_row <= 10""",
)
def wallet_first_pages(t: Tables) -> DataFrame:
    order = [F.desc(c) for c in ("block_number", "transaction_index", "event_index", "relationship_id")]
    return op.pages(op.wallet_edges(t.edges()), 10, ["wallet"], order).select(
        "wallet", "relationship_id", "page_row"
    )


@query(
    "c04_recent_transfers",
    """SELECT wallet, relationship_id, rank, n > 5 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY wallet) AS n, row_number() OVER (PARTITION BY wallet
        ORDER BY block_number DESC, transaction_index DESC, event_index DESC, relationship_id DESC) AS rank FROM wallet_edges) WHERE rank <= 5""",
)
def recent_transfers(t: Tables) -> DataFrame:
    order = [F.desc(c) for c in ("block_number", "transaction_index", "event_index", "relationship_id")]
    return op.recent(op.wallet_edges(t.edges()), ["wallet"], order, 5).select(
        "wallet", "relationship_id", "rank", "truncated"
    )


@query("c05_observation_window", "SELECT relationship_id FROM edges WHERE block_timestamp_unix_ms >= 946684800000 - 31536000000")
def observation_window(t: Tables) -> DataFrame:
    return op.observation_window(t.edges(), 365, 946_684_800_000).select("relationship_id")


@query(
    "c06_transaction_participants",
    """WITH e AS (SELECT tx_hash, from_address AS a, 0 AS p FROM txs UNION ALL SELECT tx_hash, to_address, 1 FROM txs
        UNION ALL SELECT x.tx_hash, x.from_address, 2 FROM edges x UNION ALL SELECT x.tx_hash, x.to_address, 2 FROM edges x),
    d AS (SELECT tx_hash, a, min(p) AS p FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY p, a) AS k, count(*) OVER (PARTITION BY tx_hash) AS n FROM d)
    SELECT tx_hash, false AS ambiguous, string_agg(a, ',' ORDER BY k) AS participants, max(n) > 4 AS participants_truncated FROM r WHERE k <= 4 GROUP BY 1""",
)
def transaction_participants(t: Tables) -> DataFrame:
    return op.participants(t.account_txs(), t.edges()).withColumn(
        "participants", F.array_join("participants", ",")
    )


@query(
    "f01_limit_per_key",
    """SELECT subject_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY block_timestamp_unix_ms DESC, event_id) AS rank FROM sem) WHERE rank <= 3""",
)
def limit_per_key(t: Tables) -> DataFrame:
    order = [F.desc("block_timestamp_unix_ms"), F.col("event_id")]
    return top_per_group(t.semantic_events(), ["subject_id"], order, 3).select("subject_id", "event_id")


@query(
    "f02_whole_result_counts",
    """SELECT wallet, asset_id, transfer_count, count(*) OVER (PARTITION BY wallet) AS assets,
        count(*) FILTER (transfer_count > 2) OVER (PARTITION BY wallet) AS busy_assets
        FROM (SELECT wallet, asset_id, count(*) AS transfer_count FROM wallet_edges GROUP BY 1, 2)""",
)
def whole_result_counts(t: Tables) -> DataFrame:
    per = op.wallet_edges(t.edges()).groupBy("wallet", "asset_id").agg(F.count("*").alias("transfer_count"))
    return with_group_totals(
        per, ["wallet"], assets=F.count("*"), busy_assets=F.count_if(F.col("transfer_count") > 2)
    )


@query(
    "f05_missing_ranges",
    """WITH h AS (SELECT unnest(range(0, (SELECT last_block_number + 1 FROM state))) AS h),
    m AS (SELECT h FROM h WHERE h NOT IN (SELECT block_number FROM canonical_blocks)),
    g AS (SELECT h, h - row_number() OVER (ORDER BY h) AS grp FROM m)
    SELECT 'utxo:1' AS network_id, min(h) AS from_block, max(h) AS to_block, count(*) AS missing FROM g GROUP BY grp""",
)
def missing_ranges(t: Tables) -> DataFrame:
    return series.missing_ranges(visibility.canonical_blocks(t.blocks(), t.state()), t.state())


@query(
    "f05_first_missing_ranges",
    """WITH h AS (SELECT unnest(range(0, (SELECT last_block_number + 1 FROM state))) AS h),
    m AS (SELECT h FROM h WHERE h NOT IN (SELECT block_number FROM canonical_blocks)),
    g AS (SELECT h, h - row_number() OVER (ORDER BY h) AS grp FROM m),
    r AS (SELECT min(h) AS from_block, max(h) AS to_block FROM g GROUP BY grp)
    SELECT from_block, to_block, (SELECT count(*) > 5 FROM r) AS truncated FROM r ORDER BY from_block LIMIT 5""",
)
def first_missing_ranges(t: Tables) -> DataFrame:
    return series.first_ranges(missing_ranges(t), 5).select("from_block", "to_block", "truncated")


@query(
    "f06_parent_breaks",
    """SELECT b.network_id, b.block_number, b.block_hash, b.parent_hash, p.block_hash AS previous_hash
        FROM canonical_blocks b JOIN canonical_blocks p ON p.block_number = b.block_number - 1 WHERE b.parent_hash <> p.block_hash""",
)
def parent_breaks(t: Tables) -> DataFrame:
    return series.parent_breaks(visibility.canonical_blocks(t.blocks(), t.state()))


@query(
    "f07_best_per_subject_asset",
    """SELECT to_address AS subject_id, asset_id, relationship_id AS path_id FROM (SELECT *, row_number() OVER (PARTITION BY to_address, asset_id ORDER BY amount DESC, relationship_id) AS k FROM edges) WHERE k <= 3""",
)
def best_per_subject_asset(t: Tables) -> DataFrame:
    paths = t.edges().select(
        F.col("to_address").alias("subject_id"), "asset_id", F.col("relationship_id").alias("path_id"),
        F.col("amount_raw").cast("double").alias("exposure_score"),
    )
    return series.best_k(paths, 3).select("subject_id", "asset_id", "path_id")


@query(
    "f08_winning_candidate",
    """SELECT subject_id, event_type, protocol FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY
        CASE event_type WHEN 'swap' THEN 1 ELSE 2 END DESC, confidence DESC, event_id DESC) AS k FROM sem) WHERE k = 1""",
)
def winning_candidate(t: Tables) -> DataFrame:
    candidates = t.semantic_events().select(
        "subject_id", "event_type", "protocol", "confidence",
        F.when(F.col("event_type") == "swap", 1).otherwise(2).alias("priority"),
        F.col("event_id").alias("position"),
    )
    return series.winner(candidates, ["subject_id"]).select("subject_id", "event_type", "protocol")


@query(
    "g01_total_order",
    """SELECT relationship_id FROM edges ORDER BY block_number DESC, transaction_index, event_index, relationship_id LIMIT 100""",
)
def total_order(t: Tables) -> DataFrame:
    return t.edges().orderBy(
        F.desc("block_number"), "transaction_index", "event_index", "relationship_id"
    ).limit(100).select("relationship_id")


@query("g02_top_assets", "SELECT asset_id, count(*) AS transfers FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_assets(t: Tables) -> DataFrame:
    counts = t.edges().groupBy("asset_id").agg(F.count("*").alias("transfers"))
    return op.top_k(counts, "transfers", ["asset_id"], 10)


@query(
    "g03_union_legs",
    """SELECT 'input' AS side, tx_hash, value_sats FROM inputs UNION ALL SELECT 'output', tx_hash, value_sats FROM outputs""",
)
def union_legs(t: Tables) -> DataFrame:
    a = t.utxo_inputs().select(F.lit("input").alias("side"), "tx_hash", "value_sats")
    return a.unionByName(t.utxo_outputs().select(F.lit("output").alias("side"), "tx_hash", "value_sats"))


@query("g04_distinct_outpoints", "SELECT DISTINCT tx_hash, output_index FROM occ")
def distinct_outpoints(t: Tables) -> DataFrame:
    return t.occurrences().select("tx_hash", "output_index").distinct()


@query(
    "g05_label_list_diff",
    """WITH o AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS nm FROM supplier WHERE s_suppkey % 5 <> 0),
    n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 1 THEN 'moved' ELSE 'n' || s_nationkey END AS nm FROM supplier WHERE s_suppkey % 6 <> 0)
    SELECT 'cl' || coalesce(o.k, n.k) AS claim_id, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL AND o.k % 4 = 0 THEN 'unresolved'
        WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.nm <> n.nm""",
)
def label_list_diff(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    rows = t.raw("supplier").select(
        key, F.concat(F.lit("cl"), key.cast("string")).alias("claim_id"), key.cast("string").alias("uid"),
        F.lit("net").alias("network"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("entity_name"),
        F.lit("x").alias("entity_type"), F.array(F.lit("ETH")).alias("symbols"),
    )
    old = rows.where(key % 5 != 0)
    moved = F.when(key % 7 == 1, "moved").otherwise(F.col("entity_name"))
    new = rows.where(key % 6 != 0).withColumn("entity_name", moved)
    return op.diff_claims(old, new, rows.where(key % 4 == 0))


@query(
    "g06_address_sweep",
    "SELECT DISTINCT address FROM (SELECT address FROM inputs UNION ALL SELECT address FROM outputs) WHERE address > '3'",
)
def address_sweep(t: Tables) -> DataFrame:
    return op.addresses(t.utxo_inputs(), t.utxo_outputs(), after="3")

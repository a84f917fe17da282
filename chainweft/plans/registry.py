"""Registered queries and the check SQL that goes with them.

``CTES`` restates the canonical frames of :mod:`chainweft.sources.tables` as
SQL over the supplied tables; a check names the frames it needs and
:func:`check_sql` prefixes their definitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from chainweft.sources.tables import Tables

Build = Callable[[Tables], DataFrame]
QUERIES: dict[str, Build] = {}
CHECKS: dict[str, str] = {}

ZERO = "'0x0000000000000000000000000000000000000000'"
_MINUTE = "(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 1440 + {k} % 1440)"
_HEADER = """'utxo:1' AS network_id, ({k}) // 50 AS block_number, 'b' || (({k}) // 50) AS block_hash,
    1300000000000 + (({k}) // 50) * 600000 AS block_timestamp_unix_ms, 'k' || (({k}) // 50) AS commit_id,
    CASE WHEN (({k}) // 50) % 11 = 3 THEN 2 ELSE 1 END AS revision,
    'u' || ({k}) AS tx_hash, ({k}) % 50 AS transaction_index"""
_OWNER = """CASE WHEN l_suppkey % 16 <> 15 THEN (CASE l_suppkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE 'bc1p' END)
    || 'S' || l_suppkey END AS address, '6a' || lpad(cast(l_suppkey AS varchar), 10, '0') AS script_hex"""
_VALUE = """CASE WHEN l_quantity > 35 THEN 1000000 WHEN l_quantity = 1 THEN 0
    ELSE cast(round(l_extendedprice * 100) AS bigint) END"""
_DAY = "date_diff('day', date '1970-01-01', cast(l_shipdate as date))"

CTES: dict[str, str] = {
    "txs": f"""SELECT 'acct:1' AS network_id, 't' || o_orderkey AS tx_hash,
        {_MINUTE.format(k='o_orderkey')} AS block_number,
        {_MINUTE.format(k='o_orderkey')} * 60000 AS block_timestamp_unix_ms,
        o_orderkey // 1440 AS transaction_index, 'C' || o_custkey AS from_address,
        'S' || (o_custkey % 50) AS to_address, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS status,
        cast(round(o_totalprice * 100) AS bigint) % 100000 AS fee,
        CASE WHEN o_orderpriority LIKE '1%' THEN '0xa9059cbb' WHEN o_orderpriority LIKE '2%' THEN '0x38ed1739'
             WHEN o_orderpriority LIKE '5%' THEN '' ELSE '0x' END AS input_data
        FROM orders""",
    "edges": f"""SELECT 'acct:1' AS network_id,
        'r' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relationship_id,
        't' || l_orderkey AS tx_hash, {_MINUTE.format(k='l_orderkey')} AS block_number,
        {_MINUTE.format(k='l_orderkey')} * 60000 AS block_timestamp_unix_ms,
        l_orderkey // 1440 AS transaction_index, (l_partkey * 10 + l_linenumber) * 100000 + l_suppkey % 100000 AS event_index,
        CASE WHEN l_quantity = 50 THEN {ZERO} WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS from_address,
        CASE WHEN l_quantity = 49 THEN {ZERO} WHEN l_returnflag = 'R' THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS to_address,
        'asset:' || (l_partkey % 25) AS asset_id,
        CASE WHEN l_linenumber = 7 THEN cast(l_partkey AS varchar) END AS token_id,
        CASE WHEN l_linenumber = 7 THEN 1 ELSE cast(round(l_extendedprice * 100) AS bigint) END AS amount,
        CASE WHEN l_linenumber = 7 THEN 'erc721_transfer' WHEN l_partkey % 25 = 0 THEN 'native_transfer'
             ELSE 'erc20_transfer' END AS transfer_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "features": """SELECT 't' || l_orderkey AS tx_hash,
        max(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) AS is_swap,
        max(CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END) AS is_bridge,
        max(CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END) AS is_mint,
        max(CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END) AS is_burn,
        max(CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END) AS is_liquidity_add,
        max(CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END) AS is_liquidity_remove,
        max(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) AS is_contract_call
        FROM lineitem GROUP BY l_orderkey""",
    "sem": """SELECT 'e' || event_id AS event_id, 'x' || (event_id // 2) AS tx_hash, 'C' || user_id AS subject_id,
        CASE event_type WHEN 'view' THEN 'swap' WHEN 'click' THEN 'bridge_transfer' WHEN 'error' THEN 'mixer_deposit'
             WHEN 'purchase' THEN 'liquidity_add' ELSE 'liquidity_remove' END AS event_type,
        'p' || (cast(json_extract_string(props, '$.k') AS int) % 10) AS protocol,
        cast(json_extract_string(props, '$.k') AS int) / 100.0::double AS confidence,
        epoch_us(ts) // 1000 AS block_timestamp_unix_ms, cast(round(value * 100) AS bigint) AS amount FROM events""",
    "sources": """SELECT 'src' || n_nationkey AS source_id, n_name AS source_name,
        CASE WHEN rev = 1 OR n_nationkey % 7 <> 0 THEN 1 ELSE 0 END AS is_active, rev AS revision
        FROM nation, (VALUES (1), (2)) v(rev)""",
    "claims": """SELECT 'acct:1' AS network_id, 'cl' || s_suppkey AS claim_id, 'S' || s_suppkey AS address, 'label' AS claim_kind,
        'ent' || (s_suppkey % 40) AS entity_id, 'Entity ' || (s_suppkey % 40) AS entity_name,
        CASE s_suppkey % 10 WHEN 0 THEN 'exchange' WHEN 1 THEN 'DEX' WHEN 2 THEN 'bridge' WHEN 3 THEN 'mixer'
             WHEN 4 THEN 'Custodian' ELSE 'unknown' END AS entity_type,
        CASE (s_suppkey // 10) % 4 WHEN 0 THEN 'HOT' WHEN 1 THEN 'SWEEP' WHEN 2 THEN 'DEPOSIT' ELSE 'COLD' END AS address_role,
        (s_suppkey % 5 + 5) / 10.0::double AS confidence,
        CASE WHEN s_suppkey % 25 = 7 THEN 50 + s_suppkey % 51 ELSE 0 END AS risk_level,
        CASE WHEN s_suppkey % 25 = 7 THEN 1 ELSE 0 END AS is_exposure_seed,
        CASE WHEN s_suppkey % 25 = 7 THEN 'sanctions' ELSE '' END AS seed_category,
        'src' || s_nationkey AS source_id,
        CASE WHEN rev = 2 THEN 'approved' WHEN s_suppkey % 4 = 3 THEN 'pending' ELSE 'approved' END AS review_status,
        CASE WHEN rev = 2 THEN 'lead' WHEN s_suppkey % 4 = 3 THEN '' ELSE 'analyst' END AS reviewed_by,
        0 AS valid_from_unix_ms, CASE WHEN s_suppkey % 9 = 8 THEN 900000000000 END AS valid_to_unix_ms, rev AS revision
        FROM supplier, (VALUES (1), (2)) v(rev) WHERE rev = 1 OR s_suppkey % 3 = 0""",
    "reviews": """SELECT 'rv' || s_suppkey || '-' || rev AS review_id, 'claim' AS subject_type, 'cl' || s_suppkey AS subject_id,
        CASE WHEN rev = 1 THEN 'approve' WHEN s_suppkey % 12 = 5 THEN 'reject' ELSE 'revoke' END AS decision,
        CASE WHEN s_suppkey % 3 = 0 THEN 'lead' ELSE 'analyst' END AS reviewed_by,
        CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS claim_revision, rev AS revision
        FROM supplier, (VALUES (1), (2)) v(rev)
        WHERE (rev = 1 AND s_suppkey % 4 <> 3) OR (rev = 2 AND s_suppkey % 6 = 5)""",
    "exchanges": """SELECT 'S' || s_suppkey AS address, 'ent' || (s_suppkey % 40) AS entity_id,
        'Exchange ' || (s_suppkey % 40) AS exchange_name,
        CASE (s_suppkey // 10) % 4 WHEN 0 THEN 'HOT' WHEN 1 THEN 'SWEEP' WHEN 2 THEN 'DEPOSIT' ELSE 'COLD' END AS address_role,
        ((s_suppkey // 10) % 3 + 7) / 10.0::double AS confidence FROM supplier WHERE s_suppkey % 10 = 0""",
    "outputs": f"""SELECT {_HEADER.format(k='l_orderkey')}, (l_partkey * 10 + l_linenumber) * 100000 + l_suppkey % 100000 AS output_index, {_OWNER},
        {_VALUE} AS value_sats, CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS coinbase FROM lineitem""",
    "inputs": f"""SELECT {_HEADER.format(k='l_orderkey + 1 + l_partkey % 7')}, (l_partkey * 10 + l_linenumber) * 100000 + l_suppkey % 100000 AS input_index,
        {_OWNER}, {_VALUE} AS value_sats, 'u' || l_orderkey AS prev_tx_hash,
        (l_partkey * 10 + l_linenumber) * 100000 + l_suppkey % 100000 AS prev_output_index
        FROM lineitem WHERE l_returnflag <> 'N' AND (l_orderkey + 1 + l_partkey % 7) % 50 <> 0""",
    "utxs": f"""SELECT {_HEADER.format(k='o_orderkey')}, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS coinbase,
        coalesce(i.n, 0) AS input_count, coalesce(o.n, 0) AS output_count,
        CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE greatest(coalesce(i.v, 0) - coalesce(o.v, 0), 0) END AS fee_sats
        FROM orders LEFT JOIN (SELECT tx_hash, count(*) n, sum(value_sats) v FROM inputs GROUP BY 1) i ON i.tx_hash = 'u' || o_orderkey
        LEFT JOIN (SELECT tx_hash, count(*) n, sum(value_sats) v FROM outputs GROUP BY 1) o ON o.tx_hash = 'u' || o_orderkey""",
    "occ": f"""SELECT 'u' || l_orderkey AS tx_hash, l_linenumber AS output_index, {_DAY} AS block_number,
        l_partkey AS transaction_index, 'S' || l_suppkey AS address,
        cast(round(l_extendedprice * 100) AS bigint) AS value_sats,
        CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS coinbase FROM lineitem""",
    "spends": f"""SELECT 'u' || l_orderkey AS prev_tx_hash, l_linenumber AS prev_output_index,
        {_DAY} + cast(l_quantity AS bigint) AS block_number, l_suppkey AS transaction_index,
        'x' || l_partkey || '-' || l_suppkey AS tx_hash FROM lineitem WHERE l_linestatus = 'F'""",
    "blocks": """SELECT 'utxo:1' AS network_id, h AS block_number, 'b' || h AS block_hash,
        CASE WHEN h % 41 = 9 THEN 'fork' ELSE 'b' || (h - 1) END AS parent_hash,
        1300000000000 + h * 600000 AS block_timestamp_unix_ms, 'k' || h AS commit_id, rev AS revision,
        CASE WHEN rev = 2 AND h % 22 = 3 THEN 0 ELSE 1 END AS canonical,
        CASE WHEN rev = 2 AND h % 22 = 3 THEN 'orphaned' WHEN rev = 1 AND h % 29 = 7 THEN 'processing' ELSE 'complete' END AS ingestion_status,
        n - (CASE WHEN h % 53 = 0 THEN 1 ELSE 0 END) AS transaction_count, 1 AS receipt_coverage,
        CASE WHEN h % 5 <> 0 THEN 1 ELSE 0 END AS trace_coverage
        FROM (SELECT o_orderkey // 50 AS h, count(*) AS n FROM orders GROUP BY 1) b, (VALUES (1), (2)) v(rev)
        WHERE h % 37 <> 5 AND (rev = 1 OR h % 11 = 3)""",
    "state": """SELECT 'utxo:1' AS network_id, 2 AS revision, 1 AS initialized, 0 AS start_block,
        max(o_orderkey) // 50 - 2 AS last_block_number, 'b' || (max(o_orderkey) // 50 - 2) AS last_block_hash FROM orders""",
    "failures": """SELECT 'f' || event_id AS failure_id, event_id % 5000 AS block_number,
        CASE WHEN rev = 1 THEN 'pending' WHEN event_id % 8 = 0 THEN 'resolved' ELSE 'dead_letter' END AS status,
        rev AS attempts, epoch_us(ts) // 1000 + rev * 60000 AS last_failed_at_unix_ms, rev AS revision
        FROM events, (VALUES (1), (2)) v(rev) WHERE event_type = 'error' AND (rev = 1 OR event_id % 4 = 0)""",
    # derived frames shared by several checks
    "current_blocks": """SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY network_id, block_number ORDER BY revision DESC) = 1""",
    "canonical_blocks": """SELECT b.* FROM current_blocks b, state s WHERE canonical = 1 AND ingestion_status = 'complete'
        AND block_number BETWEEN start_block AND last_block_number AND b.revision <= s.revision""",
    "wallet_edges": """SELECT from_address AS wallet, to_address AS peer, 'out' AS direction, edges.* FROM edges
        UNION ALL SELECT to_address, from_address, 'in', edges.* FROM edges WHERE from_address <> to_address""",
    "legs": """SELECT address AS wallet, network_id, block_number, block_hash, block_timestamp_unix_ms, commit_id, revision, tx_hash, transaction_index,
        sum(side) AS spent_input_count, sum(1 - side) AS received_output_count,
        sum(CASE WHEN side = 1 THEN value_sats ELSE 0 END) AS spent_sats, sum(CASE WHEN side = 0 THEN value_sats ELSE 0 END) AS received_sats
        FROM (SELECT address, network_id, block_number, block_hash, block_timestamp_unix_ms, commit_id, revision, tx_hash, transaction_index, value_sats, 1 AS side FROM inputs
              UNION ALL SELECT address, network_id, block_number, block_hash, block_timestamp_unix_ms, commit_id, revision, tx_hash, transaction_index, value_sats, 0 FROM outputs) x
        WHERE address IS NOT NULL GROUP BY ALL""",
    "involved": """SELECT l.*, t.coinbase, t.input_count, t.output_count, t.fee_sats FROM legs l JOIN utxs t
        USING (network_id, block_number, block_hash, block_timestamp_unix_ms, commit_id, revision, tx_hash, transaction_index)""",
}


def check_sql(body: str) -> str:
    """Prefix ``body`` with the frame definitions it mentions."""
    body = dedent(body).strip()
    needed: list[str] = []
    entered: set[str] = set()

    def add(text: str) -> None:
        for name, definition in CTES.items():
            if name not in entered and re.search(rf"\b{name}\b", text):
                entered.add(name)
                add(definition)
                needed.append(name)

    add(body)
    parts = [f"{name} AS ({CTES[name]})" for name in needed]
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if head:
        parts.append(body[head.end():])
        return "WITH RECURSIVE " + ",\n".join(parts)
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name`` with its check SQL, if SQL can state it."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return build

    return register


def bound(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: build(Tables(spark, path))

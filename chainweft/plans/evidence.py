"""Queries over logs, traces and transactions stated by the supplied tables (section B, J10-J12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions import wide
from chainweft.functions.ids import ZERO_ADDRESS
from chainweft.operators import events as ev
from chainweft.operators import extract as op
from chainweft.operators import matching
from chainweft.plans.registry import ZERO, query
from chainweft.plans.visibility import registry_rows
from chainweft.sources.tables import Tables


def _word(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n.cast("bigint"))), 64, "0")


def _hex_address(prefix: str, key: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(key.cast("bigint"))), 12, "0")), 40, "0"))


def _topic_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.substring(address, 3, 40), 64, "0"))


def _c(k: str) -> Column:
    return _hex_address("c", F.col(k))


def _s(k: str) -> Column:
    return _hex_address("5", F.col(k))


def _h(prefix: str, key: str) -> str:
    return f"'0x' || lpad('{prefix}' || lpad(format('{{:x}}', {key}), 12, '0'), 40, '0')"


def _lines(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("tx_hash"),
        ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey") % 100_000).alias("log_index"),
    )


_IDX = "(l_partkey * 10 + l_linenumber) * 100000 + l_suppkey % 100000"


def token_logs(t: Tables) -> DataFrame:
    """Each line as a transfer log; line 7 an NFT, line 6 cut short by one digit."""
    line = F.col("l_linenumber")
    nft = line == 7
    topics = [F.lit("0x" + op.TRANSFER), _topic_address(_c("l_orderkey")), _topic_address(_s("l_suppkey"))]
    return _lines(t).select(
        "tx_hash", "log_index", _hex_address("a", F.col("l_partkey") % 25).alias("address"),
        F.when(nft, F.array(*topics, F.concat(F.lit("0x"), _word(F.col("l_partkey"))))).otherwise(F.array(*topics)).alias("topics"),
        F.when(nft, "0x").when(line == 6, F.concat(F.lit("0x"), F.substring(_word(F.col("cents")), 2, 63)))
        .otherwise(F.concat(F.lit("0x"), _word(F.col("cents")))).alias("data"),
    )


@query(
    "b01_token_transfers",
    f"""SELECT 't' || l_orderkey AS tx_hash, {_IDX} AS log_index, {_h('c', 'l_orderkey')} AS from_address, {_h('5', 'l_suppkey')} AS to_address,
        CASE WHEN l_linenumber = 7 THEN '1' ELSE cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar) END AS amount_raw,
        CASE WHEN l_linenumber = 7 THEN cast(l_partkey AS varchar) END AS token_id FROM lineitem WHERE l_linenumber <> 6""",
)
def token_transfers(t: Tables) -> DataFrame:
    return op.token_transfers(token_logs(t)).select(
        "tx_hash", "log_index", "from_address", "to_address", "amount_raw", "token_id"
    )


def multi_logs(t: Tables) -> DataFrame:
    """Lines 1-3 as single, 4-6 as two-item batches, 7 as a batch whose lists differ in length."""
    line = F.col("l_linenumber")
    single = line <= 3
    ends = [_topic_address(_c("l_orderkey")), _topic_address(_s("l_suppkey"))]
    operator = _topic_address(_c("l_partkey"))
    one = F.concat(_word(F.col("l_partkey")), _word(F.col("cents")))
    lit = lambda n: _word(F.lit(n))
    ids = F.concat(lit(2), _word(F.col("l_partkey")), _word(F.col("l_partkey") + 1))
    two = F.concat(lit(2), _word(F.col("cents")), _word(F.col("l_quantity").cast("bigint")))
    short = F.concat(lit(1), _word(F.col("cents")))
    data = F.when(single, one).otherwise(F.concat(lit(64), lit(160), ids, F.when(line == 7, short).otherwise(two)))
    return _lines(t).select(
        "tx_hash", "log_index", _hex_address("a", F.col("l_partkey") % 25).alias("address"),
        F.array(F.when(single, "0x" + op.TRANSFER_SINGLE).otherwise("0x" + op.TRANSFER_BATCH), operator, *ends).alias("topics"),
        F.concat(F.lit("0x"), data).alias("data"),
    )


@query(
    "b02_multi_token_transfers",
    f"""WITH x AS (SELECT *, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM lineitem)
    SELECT 't' || l_orderkey AS tx_hash, {_IDX} AS log_index, 0 AS event_sub_index, cast(l_partkey AS varchar) AS token_id, cast(cents AS varchar) AS amount_raw FROM x WHERE l_linenumber < 7
    UNION ALL SELECT 't' || l_orderkey, {_IDX}, 1, cast(l_partkey + 1 AS varchar), cast(cast(l_quantity AS bigint) AS varchar) FROM x WHERE l_linenumber BETWEEN 4 AND 6""",
)
def multi_token_transfers(t: Tables) -> DataFrame:
    transfers, _ = op.erc1155_transfers(multi_logs(t))
    return transfers.select("tx_hash", "log_index", "event_sub_index", "token_id", "amount_raw")


@query("b02_multi_token_rejects", f"SELECT 't' || l_orderkey AS tx_hash, {_IDX} AS log_index, 'malformed_multi_token_log' AS reason FROM lineitem WHERE l_linenumber = 7")
def multi_token_rejects(t: Tables) -> DataFrame:
    _, rejects = op.erc1155_transfers(multi_logs(t))
    return rejects


@query(
    "b03_transfer_kinds",
    f"""SELECT relationship_id, CASE WHEN from_address = {ZERO} THEN s || '_mint' WHEN to_address = {ZERO} THEN s || '_burn' ELSE s || '_transfer' END AS transfer_kind
        FROM (SELECT *, split_part(transfer_type, '_', 1) AS s FROM edges)""",
)
def transfer_kinds(t: Tables) -> DataFrame:
    edges = t.edges().withColumn("standard", F.split("transfer_type", "_")[0])
    return op.transfer_kind(edges).select("relationship_id", "transfer_kind")


@query(
    "b04_native_transfers",
    """SELECT 't' || o_orderkey AS tx_hash, 'S' || (o_custkey % 50) AS to_address, cast(cast(round(o_totalprice * 100) AS bigint) AS varchar) AS amount_raw,
        CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'contract_call_value' ELSE 'native_transfer' END AS transfer_type
        FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 4 <> 0""",
)
def native_transfers(t: Tables) -> DataFrame:
    key = F.regexp_extract("from_address", "([0-9]+)$", 1).cast("bigint")
    price = t.raw("orders").select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tx_hash"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("price"),
    )
    txs = t.account_txs().join(price, "tx_hash").withColumns(
        {"value_raw": F.when(key % 4 != 0, F.col("price")).otherwise("0"), "contract_address": F.lit(None).cast("string")}
    )
    return op.native_transfers(txs, "native:ETH").select("tx_hash", "to_address", "amount_raw", "transfer_type")


@query(
    "b04_contract_transfers",
    """SELECT 't' || l_orderkey AS tx_hash, 'C' || l_suppkey AS from_address, 'S' || l_partkey AS to_address, cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar) AS amount_raw,
        CASE l_linenumber WHEN 1 THEN 'native_transfer' WHEN 2 THEN 'trc10_transfer' ELSE 'contract_call_value' END AS transfer_type FROM lineitem WHERE l_linenumber <= 3""",
)
def contract_transfers(t: Tables) -> DataFrame:
    """Each line as one typed contract in JSON."""
    names = F.array(F.lit("TransferContract"), F.lit("TransferAssetContract"), F.lit("TriggerSmartContract"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = F.struct(
        F.coalesce(F.get(names, F.col("l_linenumber") - 1), F.lit("VoteWitnessContract")).alias("type"), name("C", "l_suppkey").alias("owner"),
        F.when(F.col("l_linenumber") <= 2, name("S", "l_partkey")).alias("to"), name("S", "l_partkey").alias("contract"),
        F.lit("1001").alias("asset"), F.when(F.col("l_linenumber") != 3, F.col("cents").cast("string")).alias("amount"),
        F.col("cents").cast("string").alias("call_value"),
    )
    txs = _lines(t).select("tx_hash", F.lit(1).alias("status"), F.to_json(F.array(one)).alias("contracts_json"))
    return op.contract_transfers(txs).select("tx_hash", "from_address", "to_address", "amount_raw", "transfer_type")


def traces(t: Tables) -> DataFrame:
    """Lines as call frames of their order: 1 [0], 2 [0,1], 3 [1], 4 [1,0], 5 [1,0,2], 6 [2], 7 [2,0]."""
    shapes = F.array(*[F.array(*[F.lit(i) for i in s]) for s in ([0], [0, 1], [1], [1, 0], [1, 0, 2], [2], [2, 0])])
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return _lines(t).select(
        "tx_hash", F.get(shapes, F.col("l_linenumber") - 1).alias("trace_address"),
        F.when(F.col("l_partkey") % 6 == 0, "STATICCALL").otherwise("call").alias("call_type"),
        name("C", "l_suppkey").alias("from_address"), name("S", "l_partkey").alias("to_address"),
        F.when(F.col("l_partkey") % 7 == 0, "0").otherwise(F.col("cents").cast("string")).alias("value_raw"),
        F.when(F.col("l_quantity") <= 5, "reverted").alias("error"),
    )


@query(
    "b05_internal_transfers",
    """WITH f AS (SELECT *, [[0], [0, 1], [1], [1, 0], [1, 0, 2], [2], [2, 0]][l_linenumber] AS p FROM lineitem),
    bad AS (SELECT DISTINCT l_orderkey, p FROM f WHERE l_quantity <= 5)
    SELECT 't' || l_orderkey AS tx_hash, array_to_string(p, ',') AS trace_address, 'S' || l_partkey AS to_address, cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar) AS amount_raw FROM f
    WHERE l_partkey % 6 <> 0 AND l_partkey % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.l_orderkey = f.l_orderkey AND len(bad.p) <= len(f.p) AND f.p[1:len(bad.p)] = bad.p)""",
)
def internal_transfers(t: Tables) -> DataFrame:
    return op.internal_transfers(traces(t), "native:ETH").select(
        "tx_hash", F.array_join(F.col("trace_address").cast("array<string>"), ",").alias("trace_address"), "to_address",
        "amount_raw",
    )


@query(
    "b06_block_credits",
    "SELECT o_orderkey AS block_number, 0 AS position, 'v' || o_custkey AS to_address, cast(cast(round(o_totalprice * 100) AS bigint) * 1000000000 AS varchar) AS amount_raw FROM orders",
)
def block_credits(t: Tables) -> DataFrame:
    one = F.struct(
        F.lit("1").alias("index"), F.lit("2").alias("validatorIndex"), F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias("address"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("amount"),
    )
    blocks = t.raw("orders").select(F.col("o_orderkey").alias("block_number"), F.to_json(F.array(one)).alias("withdrawals_json"))
    return op.block_credits(blocks, "native:ETH").select("block_number", "position", "to_address", "amount_raw")


@query(
    "b07_utxo_edges",
    """SELECT tx_hash, 'utxo_input' AS transfer_type, coalesce(address, 'script:' || sha256(script_hex)) AS from_subject_id, 'tx:' || block_hash || ':' || tx_hash AS to_subject_id, cast(value_sats AS varchar) AS amount_raw FROM inputs
        UNION ALL SELECT tx_hash, 'utxo_output', 'tx:' || block_hash || ':' || tx_hash, coalesce(address, 'script:' || sha256(script_hex)), cast(value_sats AS varchar) FROM outputs""",
)
def utxo_edges(t: Tables) -> DataFrame:
    return matching.utxo_edges(t.utxo_inputs(), t.utxo_outputs()).select(
        "tx_hash", "transfer_type", "from_subject_id", "to_subject_id", "amount_raw"
    )


@query(
    "b08_utxo_totals",
    """WITH i AS (SELECT tx_hash, count(*) AS n, sum(value_sats) AS v FROM inputs GROUP BY 1), o AS (SELECT tx_hash, count(*) AS n, sum(value_sats) AS v FROM outputs GROUP BY 1)
    SELECT u.tx_hash, u.coinbase, coalesce(i.n, 0) AS inputs, coalesce(o.n, 0) AS outputs, cast(coalesce(i.v, 0) AS bigint) AS input_sats, cast(coalesce(o.v, 0) AS bigint) AS output_sats,
        cast(CASE WHEN u.coinbase = 1 THEN 0 ELSE coalesce(i.v, 0) - coalesce(o.v, 0) END AS bigint) AS fee_sats, u.coinbase = 1 OR coalesce(i.v, 0) >= coalesce(o.v, 0) AS conserved
    FROM utxs u LEFT JOIN i USING (tx_hash) LEFT JOIN o USING (tx_hash) WHERE i.n IS NOT NULL OR o.n IS NOT NULL""",
)
def utxo_totals(t: Tables) -> DataFrame:
    return op.utxo_totals(t.utxo_inputs(), t.utxo_outputs(), t.utxo_txs())


@query("b09_stable_ids", "SELECT relationship_id, sha256(tx_hash || '|' || event_index || '|' || coalesce(token_id, '')) AS stable_id FROM edges")
def stable_ids(t: Tables) -> DataFrame:
    return op.with_stable_ids(t.edges(), ["tx_hash", "event_index", "token_id"]).select("relationship_id", "stable_id")


V2_SWAP = "0x" + op.RECEIPT_SHAPES[0][0]
V2_MINT = "0x" + op.RECEIPT_SHAPES[5][0]


def pool_logs(t: Tables) -> DataFrame:
    """One pool log per line: swap at even suppliers, liquidity added at odd ones; every third line is badly padded."""
    even = F.col("l_suppkey") % 2 == 0
    bad = F.col("l_linenumber") == 3
    pad = F.when(bad, F.concat(F.lit("0xf"), F.substring(_topic_address(_c("l_orderkey")), 4, 63))).otherwise(_topic_address(_c("l_orderkey")))
    cents, zero = _word(F.col("cents")), _word(F.lit(0))
    return _lines(t).select(
        "tx_hash", "log_index", _s("l_suppkey").alias("address"),
        F.when(even, F.array(F.lit(V2_SWAP), pad, _topic_address(_c("l_partkey")))).otherwise(F.array(F.lit(V2_MINT), pad)).alias("topics"),
        F.concat(F.lit("0x"), F.when(even, F.concat(cents, zero, zero, cents)).otherwise(F.concat(cents, cents))).alias("data"),
    )


def hex_edges(t: Tables) -> DataFrame:
    """Account transfers with EVM-shaped addresses."""
    def named(column: str) -> Column:
        key = F.regexp_extract(column, "([0-9]+)$", 1).cast("bigint")
        return (
            F.when(F.col(column) == ZERO_ADDRESS, F.col(column))
            .when(F.col(column).startswith("C"), _hex_address("c", key)).otherwise(_hex_address("5", key))
        )

    return t.edges().withColumns({"from_address": named("from_address"), "to_address": named("to_address")})


@query(
    "b10_abi_proof",
    f"""SELECT 't' || l_orderkey AS tx_hash, {_IDX} AS log_index, CASE WHEN l_suppkey % 2 = 0 THEN 'amm_v2_swap' ELSE 'amm_v2_mint' END AS abi,
        CASE WHEN l_suppkey % 2 = 0 THEN 'swap' ELSE 'liquidity_add' END AS operation, l_linenumber <> 3 AS abi_valid FROM lineitem""",
)
def abi_proof(t: Tables) -> DataFrame:
    return op.abi_proof(pool_logs(t)).select("tx_hash", "log_index", "abi", "operation", "abi_valid")


@query(
    "b11_normalized_ids",
    f"""SELECT 'valid' AS kind, {_h('c', 'c_custkey')} AS address FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'rejected', 'bad' || c_custkey FROM customer WHERE c_custkey % 5 = 0""",
)
def normalized_ids(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    rows = t.raw("customer").select(
        F.when(key % 5 == 0, F.concat(F.lit("bad"), key.cast("string"))).otherwise(F.upper(_hex_address("c", key))).alias("address")
    ).withColumn("address", F.regexp_replace("address", "^0X", "0x"))
    valid, rejects = op.normalize_ids(rows, {"address": "evm_address"})
    return valid.select(F.lit("valid").alias("kind"), "address").unionByName(
        rejects.select(F.lit("rejected").alias("kind"), "address")
    )


@query(
    "b12_formatted_amounts",
    """SELECT relationship_id, CASE WHEN amount % 1000000 = 0 THEN cast(amount // 1000000 AS varchar) ELSE (amount // 1000000) || '.' || rtrim(lpad(cast(amount % 1000000 AS varchar), 6, '0'), '0') END AS amount,
        cast(amount AS varchar) AS raw FROM edges""",
)
def formatted_amounts(t: Tables) -> DataFrame:
    text = wide.scaled(F.col("amount_raw"), F.lit(6))
    return t.edges().select("relationship_id", text.alias("amount"), wide.unscaled(text, F.lit(6)).alias("raw"))


def order_logs(t: Tables) -> DataFrame:
    """Lines as marketplace orders: one NFT offered, one native payment back."""
    w = lambda n: _word(F.lit(n))
    pad = lambda a: F.lpad(F.substring(a, 3, 40), 64, "0")
    seller, buyer = _c("l_suppkey"), _s("l_orderkey")
    offer = F.concat(w(2), pad(_hex_address("a", F.col("l_partkey") % 25)), _word(F.col("l_partkey")), F.when(F.col("l_linenumber") == 7, w(2)).otherwise(w(1)))
    paid = F.concat(w(0), w(0), w(0), _word(F.col("cents")), pad(seller))
    data = F.concat(_word(F.col("log_index")), pad(buyer), w(128), w(9 * 32), w(1), offer, w(1), paid)
    return _lines(t).select(
        "tx_hash", "log_index", F.lit("0xmarket").alias("address"),
        F.array(F.lit("0x" + op.ORDER_FULFILLED), F.concat(F.lit("0x"), pad(seller)), F.concat(F.lit("0x"), w(0))).alias("topics"),
        F.concat(F.lit("0x"), data).alias("data"), "l_partkey", seller.alias("seller"), buyer.alias("buyer"),
    )


@query(
    "b13_nft_orders",
    f"""WITH x AS (SELECT *, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM lineitem WHERE l_linenumber < 7)
    SELECT 't' || l_orderkey AS tx_hash, {_IDX} AS log_index, 0 AS item_index, 'erc721' AS item_type, cast(l_partkey AS varchar) AS identifier, '1' AS amount_raw FROM x
    UNION ALL SELECT 't' || l_orderkey, {_IDX}, 1, 'native', '0', cast(cents AS varchar) FROM x""",
)
def nft_orders(t: Tables) -> DataFrame:
    """Line 7 offers two of a single item and is therefore not decoded."""
    return op.nft_orders(order_logs(t)).select("tx_hash", "log_index", "item_index", "item_type", "identifier", "amount_raw")


@query(
    "b13_nft_order_transfers",
    f"SELECT DISTINCT 't' || l_orderkey AS tx_hash, {_IDX} AS log_index, 'n' || ({_IDX}) || '-' || l_orderkey AS relationship_id FROM lineitem WHERE l_linenumber < 6",
)
def nft_order_transfers(t: Tables) -> DataFrame:
    logs = order_logs(t)
    moves = logs.where(F.col("log_index") % 1_000_000 < 600_000).select(
        "tx_hash", F.concat(F.lit("n"), F.col("log_index").cast("string"), F.lit("-"), F.substring("tx_hash", 2, 20)).alias("relationship_id"),
        F.concat(F.lit("erc721:"), _hex_address("a", F.col("l_partkey") % 25), F.lit("/"), F.col("l_partkey").cast("string")).alias("asset_id"),
        F.lit("1").alias("amount_raw"), F.col("seller").alias("from_address"), F.col("buyer").alias("to_address"),
    )
    return op.nft_order_edges(op.nft_orders(logs), moves).select("tx_hash", "log_index", "relationship_id")


@query(
    "j10_pool_events",
    f"""WITH lg AS (SELECT *, {_h('5', 'l_suppkey')} AS pool FROM lineitem WHERE l_linenumber <> 3),
    fl AS (SELECT tx_hash, pool, side, asset_id, sum(amount) AS v FROM (SELECT tx_hash, to_address AS pool, 'in' AS side, asset_id, amount, token_id FROM edges UNION ALL SELECT tx_hash, from_address, 'out', asset_id, amount, token_id FROM edges)
        WHERE token_id IS NULL GROUP BY ALL),
    p AS (SELECT tx_hash, pool, count(*) FILTER (side = 'in') AS ni, count(*) FILTER (side = 'out') AS no, string_agg(asset_id, ',' ORDER BY asset_id) FILTER (side = 'in') AS ai, string_agg(asset_id, ',' ORDER BY asset_id) FILTER (side = 'out') AS ao,
        string_agg(v::varchar, ',' ORDER BY asset_id) FILTER (side = 'in') AS vi, string_agg(v::varchar, ',' ORDER BY asset_id) FILTER (side = 'out') AS vo FROM fl GROUP BY 1, 2)
    SELECT 't' || l_orderkey AS tx_hash, {_IDX} AS log_index, CASE WHEN l_suppkey % 2 = 0 THEN 'swap' ELSE 'liquidity_add' END AS event_type,
        coalesce(CASE WHEN l_suppkey % 2 = 1 OR (ni = 1 AND no = 1) THEN ai END, '') AS asset_in, coalesce(CASE WHEN l_suppkey % 2 = 1 OR (ni = 1 AND no = 1) THEN vi END, '') AS amount_in,
        coalesce(CASE WHEN l_suppkey % 2 = 0 AND ni = 1 AND no = 1 THEN ao END, '') AS asset_out, coalesce(CASE WHEN l_suppkey % 2 = 0 AND ni = 1 AND no = 1 THEN vo END, '') AS amount_out,
        CASE WHEN l_suppkey % 2 = 0 AND ni = 1 AND no = 1 THEN 0.86 WHEN l_suppkey % 2 = 1 AND ni > 0 THEN 0.88 ELSE 0.72 END AS confidence
    FROM lg LEFT JOIN p ON p.tx_hash = 't' || l_orderkey AND p.pool = 'S' || l_suppkey""",
)
def pool_events(t: Tables) -> DataFrame:
    registry = registry_rows(t).where(F.lit(False)).withColumn("confidence", F.lit(0.9))
    return ev.log_events(pool_logs(t), hex_edges(t), registry).select(
        "tx_hash", "log_index", "event_type", "asset_in", "amount_in", "asset_out", "amount_out", "confidence"
    )


@query(
    "j11_registered_bridge_events",
    f"""SELECT 't' || o_orderkey AS tx_hash, 'bridge_transfer' AS event_type, CASE WHEN o_custkey % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS bridge_direction,
        CASE WHEN o_custkey % 2 = 0 THEN {_h('c', 'o_custkey')} ELSE {_h('c', 'o_custkey + 1')} END AS subject_id, cast(cast(round(o_totalprice * 100) AS bigint) AS varchar) AS amount_raw FROM orders WHERE o_orderkey % 3 = 0""",
)
def registered_bridge_events(t: Tables) -> DataFrame:
    """Every order as a bridge log; only every third comes from the registered contract."""
    topics = list(ev.BRIDGE_TOPICS)
    out, back = "0x" + topics[1], "0x" + topics[5]
    key = F.col("o_custkey")
    logs = t.raw("orders").select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tx_hash"), F.lit(0).alias("log_index"),
        F.when(F.col("o_orderkey") % 3 == 0, "0xBridge").otherwise("0xother").alias("address"),
        F.array(F.when(key % 2 == 0, out).otherwise(back), _topic_address(_hex_address("c", key)), _topic_address(_hex_address("c", key + 1))).alias("topics"),
        F.concat(F.lit("0x"), _word(F.round(F.col("o_totalprice") * 100).cast("bigint")), _word(F.lit(64)), _word(F.lit(0))).alias("data"),
    )
    registry = t.raw("region").where(F.col("r_regionkey") == 0).select(
        F.lit("0xbridge").alias("contract"), F.lit("op_bridge").alias("protocol"), F.lit("op_standard_bridge_v1").alias("decoder"),
        F.lit("bridge").alias("protocol_type"), F.lit("eip155:10").alias("remote_network_id"),
    )
    return ev.registered_events(logs, registry, t.account_txs(), "eip155:1").select(
        "tx_hash", "event_type", "bridge_direction", "subject_id", "amount_raw"
    )


_REGISTRY_EVENTS = f"""ok AS (SELECT 't' || o_orderkey AS tx_hash, o_custkey AS ck, o_custkey % 50 AS sk, o_orderkey // 1440 AS x, o_orderpriority LIKE '2%' AS swaps FROM orders WHERE o_orderstatus <> 'F'),
    lg AS (SELECT 't' || l_orderkey AS tx_hash, {_IDX} AS li, l_suppkey AS k, l_suppkey % 2 = 0 AS is_swap, l_linenumber <> 3 AS valid FROM lineitem WHERE 't' || l_orderkey IN (SELECT tx_hash FROM ok)),
    rl AS (SELECT 's' AS side, s_suppkey AS k, s_suppkey % 8 AS pick FROM supplier UNION ALL SELECT 'c', c_custkey, 8 FROM customer WHERE c_custkey % 40 = 7),
    ba AS (SELECT DISTINCT u.tx_hash, side, rl.k, pick FROM (SELECT tx_hash, sk AS k FROM ok UNION ALL SELECT tx_hash, k FROM lg) u JOIN rl ON rl.k = u.k AND side = 's'
        UNION ALL SELECT tx_hash, side, k, pick FROM ok JOIN rl ON side = 'c' AND k = ck),
    nb AS (SELECT ba.*, CASE side WHEN 's' THEN 'S' ELSE 'C' END || k AS who, x, 'C' || ck AS initiator FROM ba JOIN ok USING (tx_hash)),
    le AS (SELECT nb.tx_hash, nb.side, nb.k, initiator, who, e.*, max(CASE WHEN from_address = who OR to_address = who THEN 1 ELSE 0 END) OVER (PARTITION BY nb.tx_hash, nb.side, nb.k) AS hit FROM nb JOIN (SELECT tx_hash AS tx, from_address, to_address, asset_id, token_id, amount FROM edges) e ON e.tx = nb.tx_hash),
    fl AS (SELECT tx_hash, side, k, asset_id, count(*) FILTER (CASE WHEN hit = 1 THEN to_address = who ELSE from_address = initiator END AND to_address <> {ZERO}) AS i,
        count(*) FILTER (CASE WHEN hit = 1 THEN from_address = who ELSE to_address = initiator END AND from_address <> {ZERO}) AS o FROM le WHERE coalesce(token_id, '') = '' AND from_address <> to_address AND amount <> 0 GROUP BY 1, 2, 3, 4),
    fw AS (SELECT tx_hash, side, k, max(CASE WHEN i > 0 THEN 1 ELSE 0 END) AS inward, max(CASE WHEN o > 0 THEN 1 ELSE 0 END) AS outward, count(*) AS assets FROM fl WHERE i > 0 OR o > 0 GROUP BY 1, 2, 3),
    di AS (SELECT nb.tx_hash, side, nb.k, 'swap' AS ev, nb.k AS em, nb.x AS ix, false AS from_log, 'method' AS source, 0.88 AS confidence, 1 AS p FROM nb JOIN ok USING (tx_hash) WHERE side = 's' AND nb.k = sk AND pick < 3 AND swaps
        UNION ALL SELECT nb.tx_hash, side, nb.k, CASE WHEN pick = 4 THEN 'lending_supply' ELSE 'swap' END, nb.k, li, true, 'event_topic', 0.98, 2 FROM nb JOIN lg ON lg.tx_hash = nb.tx_hash AND lg.k = nb.k WHERE side = 's' AND pick IN (0, 4) AND is_swap AND valid
        UNION ALL SELECT nb.tx_hash, nb.side, nb.k, CASE WHEN is_swap THEN 'swap' ELSE 'liquidity_add' END, lg.k, li, true, 'standard_topic', CASE WHEN inward = 1 AND outward = 1 THEN 0.98 ELSE 0.90 END, 3
            FROM nb JOIN lg ON lg.tx_hash = nb.tx_hash LEFT JOIN fw ON fw.tx_hash = nb.tx_hash AND fw.side = nb.side AND fw.k = nb.k WHERE nb.side = 's' AND pick IN (0, 2) AND valid
        UNION ALL SELECT tx_hash, side, k, CASE WHEN pick = 7 THEN 'scam_interaction' ELSE 'chain_system_transaction' END, k, x, false, 'interaction', 1.0, 3 FROM nb WHERE pick IN (7, 8)),
    fb AS (SELECT nb.tx_hash, nb.side, nb.k, CASE pick WHEN 2 THEN 'swap' WHEN 3 THEN CASE WHEN inward = 1 THEN 'bridge_deposit' ELSE 'bridge_withdrawal' END WHEN 4 THEN CASE WHEN inward = 1 THEN 'lending_supply' ELSE 'lending_withdrawal' END
            WHEN 5 THEN CASE WHEN inward = 1 THEN 'staking_deposit' ELSE 'staking_withdrawal' END ELSE CASE WHEN inward = 1 THEN 'mixer_deposit' ELSE 'mixer_withdrawal' END END AS ev, nb.k AS em, x AS ix, false AS from_log, 'fund_flow' AS source,
            CASE pick WHEN 2 THEN 0.76 WHEN 3 THEN 0.74 ELSE 0.72 END AS confidence, 4 AS p
        FROM nb JOIN fw ON fw.tx_hash = nb.tx_hash AND fw.side = nb.side AND fw.k = nb.k WHERE (nb.tx_hash, nb.side, nb.k) NOT IN (SELECT tx_hash, side, k FROM di) AND (pick IN (3, 4, 5, 6) OR (pick = 2 AND inward = 1 AND outward = 1 AND assets >= 2))),
    ev AS (SELECT * FROM (SELECT * FROM di UNION ALL SELECT * FROM fb) QUALIFY row_number() OVER (PARTITION BY tx_hash, side, k, ev, em, ix, from_log ORDER BY p) = 1)"""


@query(
    "j12_registry_events",
    f"""WITH {_REGISTRY_EVENTS} SELECT tx_hash, CASE side WHEN 's' THEN {_h('5', 'k')} ELSE {_h('c', 'k')} END AS contract, ev AS event_type, CASE side WHEN 's' THEN {_h('5', 'em')} ELSE {_h('c', 'em')} END AS emitter,
        ix AS event_index, from_log, source, confidence::DOUBLE AS confidence FROM ev""",
)
def registry_events(t: Tables) -> DataFrame:
    """Rules of every decoder but the deposit pools', applied to hex-addressed transactions and pool logs."""
    number = F.regexp_extract("contract", "([0-9]+)$", 1).cast("bigint")
    empty = F.array().cast("array<string>")
    swap_topic = F.col("decoder").isin("amm_v2", "lending_generic")
    registry = registry_rows(t).select("contract", "protocol", "protocol_type", "decoder").withColumns(
        {
            "contract": _hex_address("5", number),
            "method_ids": F.when(F.col("protocol_type") == "dex", F.array(F.lit("0x38ed1739"))).otherwise(empty),
            "method_event_types": F.when(F.col("protocol_type") == "dex", F.array(F.lit("swap"))).otherwise(empty),
            "event_topics": F.when(swap_topic, F.array(F.lit(V2_SWAP))).otherwise(empty),
            "event_types": F.when(F.col("protocol_type") == "dex", F.array(F.lit("swap"))).when(swap_topic, F.array(F.lit("lending_supply"))).otherwise(empty),
        }
    )
    system = t.raw("customer").where(F.col("c_custkey") % 40 == 7).select(
        _c("c_custkey").alias("contract"), F.lit("chain").alias("protocol"), F.lit("system").alias("protocol_type"), F.lit("chain_system").alias("decoder"),
        *[empty.alias(c) for c in ("method_ids", "method_event_types", "event_topics", "event_types")],
    )

    def named(column: str, prefix: str) -> Column:
        return _hex_address(prefix, F.regexp_extract(column, "([0-9]+)$", 1).cast("bigint"))

    txs = t.account_txs().withColumns({"from_address": named("from_address", "c"), "to_address": named("to_address", "5")})
    found = ev.registry_events(txs, pool_logs(t), hex_edges(t), registry.unionByName(system))
    return found.drop("event_id")


@query("j12_registry_errors", "SELECT 'reg' || s_suppkey AS registry_id, 'incompatible_decoder' AS reason FROM supplier WHERE s_suppkey % 6 = 1 AND s_suppkey % 8 <> 7")
def registry_errors(t: Tables) -> DataFrame:
    """Every sixth rule is given the scam decoder."""
    key = F.regexp_extract("contract", "([0-9]+)$", 1).cast("bigint")
    empty = F.array().cast("array<string>")
    registry = registry_rows(t).withColumns(
        {"decoder": F.when(key % 6 == 1, "reviewed_interaction").otherwise(F.col("decoder")), "method_event_types": empty, "event_types": empty}
    )
    return ev.registry_errors(registry)

"""Queries that pair evidence (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.operators import activity, visibility
from chainweft.operators import matching as op
from chainweft.plans.registry import query
from chainweft.sources.tables import Tables


@query(
    "d01_fact_on_canonical_block",
    """SELECT u.tx_hash, u.block_number, u.coinbase, cast(u.fee_sats AS bigint) AS fee_sats FROM utxs u JOIN canonical_blocks b
        USING (network_id, block_number, block_hash, commit_id, revision, block_timestamp_unix_ms)""",
)
def fact_on_canonical_block(t: Tables) -> DataFrame:
    blocks = visibility.canonical_blocks(t.blocks(), t.state())
    return visibility.canonical(t.utxo_txs(), blocks).select("tx_hash", "block_number", "coinbase", "fee_sats")


_MATCH = """m AS (SELECT l.wallet, count(*) AS wallet_occurrences, count(t.tx_hash) AS matched_occurrences,
        count(*) FILTER (t.tx_hash IS NOT NULL AND (l.spent_input_count > t.input_count OR l.received_output_count > t.output_count
            OR (t.coinbase = 1 AND l.spent_input_count > 0))) AS invalid_occurrences
        FROM legs l LEFT JOIN utxs t USING (network_id, block_number, block_hash, block_timestamp_unix_ms, commit_id, revision, tx_hash, transaction_index) GROUP BY 1)"""


@query("d02_wallet_legs_matched", f"WITH {_MATCH} SELECT * FROM m")
def wallet_legs_matched(t: Tables) -> DataFrame:
    return op.match_legs(activity.wallet_legs(t.utxo_inputs(), t.utxo_outputs()), t.utxo_txs())


@query(
    "n04_leg_disagreement",
    f"WITH {_MATCH} SELECT * FROM m WHERE wallet_occurrences <> matched_occurrences OR invalid_occurrences > 0",
)
def leg_disagreement(t: Tables) -> DataFrame:
    return op.leg_disagreement(activity.wallet_legs(t.utxo_inputs(), t.utxo_outputs()), t.utxo_txs())


@query(
    "d03_edge_witness",
    """WITH e AS (SELECT tx_hash, 'utxo_input' AS transfer_type, input_index AS event_index, value_sats FROM inputs
        UNION ALL SELECT tx_hash, 'utxo_output', output_index, value_sats FROM outputs)
    SELECT transfer_type, CASE WHEN value_sats % 7 = 3 THEN 0 ELSE 1 END AS matched, count(*) AS rows, cast(sum(value_sats) AS varchar) AS sats FROM e GROUP BY 1, 2""",
)
def edge_witness(t: Tables) -> DataFrame:
    """Edges of which some carry an address the leg does not confirm."""
    edges = op.utxo_edges(t.utxo_inputs(), t.utxo_outputs())
    wrong = F.col("amount_raw").cast("bigint") % 7 == 3
    edges = edges.withColumn("prev_tx_hash", F.when(wrong, "other").otherwise(F.col("prev_tx_hash")))
    marked = op.witness(edges, t.utxo_inputs(), t.utxo_outputs())
    return marked.groupBy("transfer_type", "matched").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("amount_raw").cast("decimal(38,0)")).cast("string").alias("sats"),
    )


@query(
    "d04_wallet_enrichment",
    """SELECT wallet, relationship_id, direction, is_swap, is_bridge, is_contract_call, confidence AS exchange_confidence
        FROM wallet_edges JOIN features USING (tx_hash) LEFT JOIN exchanges x ON x.address = peer""",
)
def wallet_enrichment(t: Tables) -> DataFrame:
    return activity.enrich(t.edges(), t.features(), t.exchanges()).select(
        "wallet", "relationship_id", "direction", "is_swap", "is_bridge", "is_contract_call",
        "exchange_confidence",
    )


@query(
    "d05_exchange_flows",
    """SELECT sha256(relationship_id || '|' || coalesce(f.entity_id, '') || '|' || coalesce(t.entity_id, '')) AS flow_id, relationship_id, tx_hash, block_number, from_address, to_address, asset_id,
        cast(amount AS varchar) AS amount_raw,
        CASE WHEN f.address IS NOT NULL AND t.address IS NOT NULL AND f.entity_id <> t.entity_id THEN f.exchange_name || ' -> ' || t.exchange_name
            WHEN t.address IS NOT NULL THEN t.exchange_name ELSE f.exchange_name END AS exchange_name,
        CASE WHEN f.address IS NOT NULL AND t.address IS NOT NULL AND f.entity_id = t.entity_id AND f.address_role = 'DEPOSIT' AND t.address_role IN ('HOT', 'COLD') THEN 'sweep'
            WHEN f.address IS NOT NULL AND t.address IS NOT NULL THEN 'exchange_transfer' WHEN t.address IS NOT NULL THEN 'deposit' ELSE 'withdrawal' END AS flow_type,
        CASE WHEN f.address IS NOT NULL AND t.address IS NOT NULL THEN least(f.confidence, t.confidence) WHEN t.address IS NOT NULL THEN t.confidence ELSE f.confidence END AS confidence
        FROM edges LEFT JOIN exchanges f ON f.address = from_address LEFT JOIN exchanges t ON t.address = to_address WHERE f.address IS NOT NULL OR t.address IS NOT NULL""",
)
def exchange_flows(t: Tables) -> DataFrame:
    return op.exchange_flows(t.edges(), t.exchanges())


@query(
    "d06_rapid_pass_through",
    """WITH i AS (SELECT to_address AS wallet, asset_id, tx_hash, block_timestamp_unix_ms AS t FROM edges),
    o AS (SELECT from_address AS wallet, asset_id, tx_hash, block_timestamp_unix_ms AS t FROM edges)
    SELECT i.wallet, count(*) AS pair_count FROM i JOIN o ON i.wallet = o.wallet AND i.asset_id = o.asset_id
        AND o.t BETWEEN i.t AND i.t + 86400000 AND i.tx_hash <> o.tx_hash GROUP BY 1""",
)
def rapid_pass_through(t: Tables) -> DataFrame:
    """A day instead of ten minutes: supplied orders are far apart in time."""
    return op.pass_through(t.edges(), 86_400_000)


def forward_sql(window_ms: int, divisor: int) -> str:
    """The sequential rule: receipts of a wallet in order, each with the first fitting payment left, none used twice."""
    return f"""fin AS (SELECT to_address AS wallet, asset_id, coalesce(token_id, '') AS token, tx_hash, amount, block_timestamp_unix_ms AS at,
        (block_timestamp_unix_ms, transaction_index, tx_hash, event_index) AS place FROM edges WHERE from_address <> to_address AND amount > 0),
    fout AS (SELECT from_address AS wallet, asset_id, coalesce(token_id, '') AS token, tx_hash, amount, block_timestamp_unix_ms AS at,
        (block_timestamp_unix_ms, transaction_index, tx_hash, event_index) AS place FROM edges WHERE from_address <> to_address),
    fits AS (SELECT i.wallet, i.asset_id, i.tx_hash AS itx, o.tx_hash AS otx, i.at AS received_at, o.at AS sent_at, o.place,
        dense_rank() OVER (PARTITION BY i.wallet ORDER BY i.place) AS turn FROM fin i JOIN fout o ON i.wallet = o.wallet AND i.asset_id = o.asset_id AND i.token = o.token
        AND i.tx_hash <> o.tx_hash AND o.at > i.at AND o.at - i.at <= {window_ms} AND abs(i.amount - o.amount) <= i.amount // {divisor}),
    fturns AS (SELECT wallet, max(turn) AS turns FROM fits GROUP BY 1),
    fwalk AS (SELECT wallet, 0::BIGINT AS turn, []::VARCHAR[] AS used, NULL::VARCHAR AS itx, NULL::VARCHAR AS otx, NULL::VARCHAR AS asset_id, NULL::BIGINT AS received_at, NULL::BIGINT AS sent_at FROM fturns
        UNION ALL SELECT * FROM (SELECT w.wallet, w.turn + 1 AS turn, CASE WHEN f.otx IS NULL THEN w.used ELSE list_concat(w.used, [f.itx, f.otx]) END AS used, f.itx, f.otx, f.asset_id, f.received_at, f.sent_at
            FROM fwalk w JOIN fturns n ON n.wallet = w.wallet AND w.turn < n.turns LEFT JOIN fits f ON f.wallet = w.wallet AND f.turn = w.turn + 1
            AND NOT list_contains(w.used, f.itx) AND NOT list_contains(w.used, f.otx) QUALIFY row_number() OVER (PARTITION BY w.wallet ORDER BY f.place NULLS LAST) = 1)),
    forwarded AS (SELECT wallet, itx AS incoming_tx, otx AS outgoing_tx, asset_id, received_at, sent_at FROM fwalk WHERE otx IS NOT NULL)"""


@query(
    "d07_rapid_forwarding",
    f"WITH RECURSIVE {forward_sql(20 * 86_400_000, 2)} SELECT wallet, incoming_tx, outgoing_tx, asset_id, received_at, sent_at FROM forwarded",
)
def rapid_forwarding(t: Tables) -> DataFrame:
    """Twenty days and half the amount as tolerance, for the same reason."""
    found = op.forwarding_pairs(t.edges(), 20 * 86_400_000, 2, 30 * 86_400_000)
    return found.select("wallet", "incoming_tx", "outgoing_tx", "asset_id", "received_at", "sent_at")


@query(
    "d08_event_sequence",
    """WITH l AS (SELECT subject_id, event_id, block_timestamp_unix_ms AS t FROM sem WHERE starts_with(event_type, 'mixer_')),
    r AS (SELECT subject_id, event_id, block_timestamp_unix_ms AS t FROM sem WHERE event_type = 'bridge_transfer'),
    p AS (SELECT l.subject_id, l.event_id AS left_event_id, r.event_id AS right_event_id, l.t AS lt, r.t AS rt FROM l JOIN r ON l.subject_id = r.subject_id AND abs(l.t - r.t) <= 3600000),
    n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY left_event_id, rt >= lt ORDER BY abs(lt - rt), right_event_id) = 1)
    SELECT subject_id, left_event_id, right_event_id, abs(lt - rt) AS distance_ms FROM n QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY lt, left_event_id, rt, right_event_id) = 1""",
)
def event_sequence(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return op.event_sequence(t.semantic_events(), kind.startswith("mixer_"), kind == "bridge_transfer")


@query(
    "d09_previous_output",
    """SELECT s.tx_hash, s.prev_tx_hash, s.prev_output_index, s.block_number, s.transaction_index, o.block_number AS origin_block, o.transaction_index AS origin_position
        FROM spends s LEFT JOIN LATERAL (SELECT block_number, transaction_index FROM occ WHERE occ.tx_hash = s.prev_tx_hash AND output_index = s.prev_output_index
            AND (occ.block_number < s.block_number OR (occ.block_number = s.block_number AND occ.transaction_index < s.transaction_index))
            ORDER BY block_number DESC, transaction_index DESC LIMIT 1) o ON true""",
)
def previous_output(t: Tables) -> DataFrame:
    return op.previous_output(t.spends(), t.occurrences()).select(
        "tx_hash", "prev_tx_hash", "prev_output_index", "block_number", "transaction_index",
        "origin_block", "origin_position",
    )


@query(
    "d10_spender",
    """WITH n AS (SELECT tx_hash, output_index, block_number AS b, transaction_index AS p,
            lead(block_number) OVER w AS ab, lead(transaction_index) OVER w AS ap FROM occ WINDOW w AS (PARTITION BY tx_hash, output_index ORDER BY block_number, transaction_index)),
    f AS (SELECT n.*, s.block_number AS sb, s.transaction_index AS sp FROM n LEFT JOIN LATERAL (SELECT block_number, transaction_index FROM spends
            WHERE prev_tx_hash = n.tx_hash AND prev_output_index = n.output_index AND (spends.block_number > n.b OR (spends.block_number = n.b AND spends.transaction_index > n.p))
            ORDER BY block_number, transaction_index LIMIT 1) s ON true)
    SELECT tx_hash, output_index, b AS block_number, p AS transaction_index,
        CASE WHEN ab IS NULL OR sb < ab OR (sb = ab AND sp <= ap) THEN sb END AS spent_block,
        CASE WHEN ab IS NULL OR sb < ab OR (sb = ab AND sp <= ap) THEN sp END AS spent_position FROM f""",
)
def spender(t: Tables) -> DataFrame:
    return op.spender(t.occurrences(), t.spends()).select(
        "tx_hash", "output_index", "block_number", "transaction_index", "spent_block", "spent_position"
    )


@query(
    "d12_semi_anti",
    """SELECT relationship_id, to_address IN (SELECT address FROM exchanges) AS to_exchange FROM edges
        WHERE from_address NOT IN (SELECT address FROM claims WHERE entity_type = 'mixer')""",
)
def semi_anti(t: Tables) -> DataFrame:
    mixers = t.claims().where(F.col("entity_type") == "mixer").select(F.col("address").alias("from_address"))
    known = t.exchanges().select(F.col("address").alias("to_address"))
    kept = t.edges().join(mixers, "from_address", "left_anti")
    yes = kept.join(known, "to_address", "left_semi").select("relationship_id", F.lit(True).alias("to_exchange"))
    no = kept.join(known, "to_address", "left_anti").select("relationship_id", F.lit(False).alias("to_exchange"))
    return yes.unionByName(no)


@query(
    "d16_bridge_correlation",
    """WITH e AS (SELECT event_id, protocol, CASE WHEN k = 0 THEN 'net' || a ELSE 'net' || b END AS local_network,
            CASE WHEN k = 0 THEN 'net' || b ELSE 'net' || a END AS remote_network, user_id, cents
        FROM (SELECT 'e' || event_id AS event_id, 'p' || (event_id // 2 % 10) AS protocol, event_id % 2 AS k, event_id // 2 % 3 AS a, event_id // 2 % 3 + 1 AS b,
            event_id // 2 AS user_id, event_id // 20 AS cents FROM events)),
    k AS (SELECT *, protocol || '|' || least(local_network || '|x', remote_network || '|x') || '|' || greatest(local_network || '|x', remote_network || '|x') || '|' || user_id || '|' || user_id || '|' || cents AS key FROM e)
    SELECT sha256(key) AS correlation_key, min((local_network, event_id))[2] AS first_event_id, max((local_network, event_id))[2] AS second_event_id
    FROM k GROUP BY key HAVING count(*) = 2 AND min(local_network) <> max(local_network)""",
)
def bridge_correlation(t: Tables) -> DataFrame:
    """Two supplied events with neighbouring ids act as the two ends of one transfer."""
    key = F.col("event_id")
    half = F.floor(key / 2).cast("bigint")
    net = lambda n: F.concat(F.lit("net"), n.cast("string"))
    a, b = net(half % 3), net(half % 3 + 1)
    first = key % 2 == 0
    events = t.raw("events").select(
        F.concat(F.lit("e"), key.cast("string")).alias("event_id"),
        F.concat(F.lit("p"), (half % 10).cast("string")).alias("protocol"),
        F.when(first, a).otherwise(b).alias("local_network"), F.lit("x").alias("local_asset"),
        F.when(first, b).otherwise(a).alias("remote_network"), F.lit("x").alias("remote_asset"),
        half.alias("sender"), half.alias("receiver"),
        F.floor(key / 20).cast("bigint").alias("amount_raw"),
    )
    return op.correlated_pairs(events)


@query(
    "d17_with_state",
    "SELECT tx_hash, u.block_number, last_block_number - u.block_number AS depth FROM utxs u, state s",
)
def with_state(t: Tables) -> DataFrame:
    return op.with_state(t.utxo_txs(), t.state()).select(
        "tx_hash", "block_number", (F.col("last_block_number") - F.col("block_number")).alias("depth")
    )


def _bridge_sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as bridge sends and, half a day to days later, relays with a small fee."""
    key = F.col("l_orderkey")
    line = t.raw("lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    at = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    home = F.when(F.col("l_returnflag") == "R", 56).otherwise(1)
    away = F.when(F.col("l_returnflag") == "R", 1).otherwise(56)
    token = F.concat(F.lit("tok"), (F.col("l_partkey") % 3).cast("string"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    places = lambda chain: F.when(chain == 1, F.lit("")).otherwise(F.lit("000000000000"))
    sends = line.select(
        F.col("k").alias("operation_id"), F.concat(F.lit("o"), key.cast("string")).alias("sender"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("receiver"), home.alias("chain_id"),
        away.alias("remote_chain_id"), token.alias("token"), F.concat(F.lit("s"), F.col("k")).alias("event_id"),
        at.alias("timestamp_ms"), F.concat(cents.cast("string"), places(home)).alias("amount_raw"),
    )
    fee = F.col("l_linenumber") * 100
    paid = F.floor(cents * (10_000 - fee) / 10_000).cast("bigint")
    relays = line.where(F.col("l_linestatus") == "F").select(
        F.col("k").alias("operation_id"), F.concat(F.lit("o"), key.cast("string")).alias("sender"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("receiver"), away.alias("chain_id"),
        home.alias("remote_chain_id"), token.alias("token"), F.concat(F.lit("r"), F.col("k")).alias("event_id"),
        (at + F.col("l_quantity").cast("bigint") * 7_200_000).alias("timestamp_ms"),
        F.concat(paid.cast("string"), places(away)).alias("amount_raw"),
    )
    grid = t.raw("region").where(F.col("r_regionkey") < 3).select(
        F.concat(F.lit("tok"), F.col("r_regionkey").cast("string")).alias("token"),
        F.concat(F.lit("SYM"), F.col("r_regionkey").cast("string")).alias("symbol"),
        F.explode(F.array(F.struct(F.lit(1).alias("c"), F.lit(6).alias("d")),
                          F.struct(F.lit(56).alias("c"), F.lit(18).alias("d")))).alias("x"),
    )
    assets = grid.select(F.col("x.c").alias("chain_id"), "token", "symbol", F.col("x.d").alias("decimals"))
    return sends, relays, assets


@query(
    "d13_bridge_match",
    """WITH l AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, cast(round(l_extendedprice * 100) AS bigint) AS c FROM lineitem WHERE l_linestatus = 'F'),
    p AS (SELECT *, cast(floor(c * (10000 - l_linenumber * 100) / 10000) AS bigint) AS paid FROM l)
    SELECT k AS operation_id, 's' || k AS send_event_id, 'r' || k AS relay_event_id, cast(l_quantity AS bigint) * 7200000 AS delay_ms
    FROM p WHERE l_quantity * 7200000 <= 172800000 AND paid::hugeint * 10000 >= c::hugeint * 9500 AND paid::hugeint * 10000 <= c::hugeint * 10500""",
)
def bridge_match(t: Tables) -> DataFrame:
    sends, relays, assets = _bridge_sides(t)
    return op.match_bridge(sends, relays, assets).select(
        "operation_id", "send_event_id", "relay_event_id", "delay_ms"
    )


@query(
    "d14_message_match",
    """SELECT 's' || event_id AS send_event_id, 'r' || event_id AS receive_event_id, event_id % 60 * 3600000 AS delay_ms FROM events
        WHERE event_type IN ('view', 'click') AND event_id % 60 <= 48""",
)
def message_match(t: Tables) -> DataFrame:
    """Supplied events as messages; the receive lags by the id modulo 60 hours."""
    key = F.col("event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    common = [
        F.col("user_id").cast("string").alias("recipient"), key.alias("nonce"),
        F.sha2(key.cast("string"), 256).alias("message_hash"),
    ]
    events = t.raw("events")
    sends = events.select(
        F.concat(F.lit("net"), F.col("event_type")).alias("network_id"), F.lit(4).alias("route_id"),
        F.lit("usd").alias("token"), *common, at.alias("timestamp_ms"),
        F.concat(F.lit("s"), key.cast("string")).alias("event_id"),
    )
    receives = events.select(
        F.lit("away").alias("network_id"), *common, (at + key % 60 * 3_600_000).alias("timestamp_ms"),
        F.concat(F.lit("r"), key.cast("string")).alias("event_id"),
    )
    routes = events.where(F.col("event_type").isin("view", "click")).select(
        F.concat(F.lit("net"), F.col("event_type")).alias("source"), F.lit(4).alias("route_id"),
        F.lit("usd").alias("token"), F.lit("away").alias("destination"),
    ).distinct()
    return op.match_messages(sends, receives, routes).select("send_event_id", "receive_event_id", "delay_ms")


#: What the mint logs of a deposit look like, by half its output index modulo 8: 0 one pair, 1 with a fee pair, 2 the recipient
#: twice, 3 amounts that differ, 4 no transfer, 5 a debt below the mint, 6 too late, 7 none.
_VARIANT = "(output_index // 2) % 8"
_MINT = f"""o AS (SELECT DISTINCT tx_hash, output_index, block_timestamp_unix_ms, block_number, value_sats FROM outputs WHERE coinbase = 0),
    r AS (SELECT tx_hash, output_index, value_sats, block_timestamp_unix_ms + 600000 AS reveal_ms, block_number, {_VARIANT} AS v FROM o WHERE output_index % 2 = 0)"""


def mint_logs(reveals: DataFrame) -> DataFrame:
    """Vault and token logs for deposits (deposit_key, depositor, value_sats, timestamp_ms, variant)."""
    pad = lambda c: F.lpad(F.substring(c, 3, 40), 64, "0")
    word = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c.cast("bigint"))), 64, "0"))
    v, zero = F.col("variant"), F.lit("0" * 64)
    some, fee = F.col("value_sats") * 9_000_000_000, F.col("value_sats") * 1_000
    other = F.lit("0x" + "fe" * 20)

    def log(index: int, address: str, topics: list[Column], value: Column, keep: Column) -> Column:
        row = F.struct(F.lit(index).alias("log_index"), F.lit(address).alias("address"), F.array(*topics).alias("topics"), word(value).alias("data"))
        return F.when(keep, row)

    def two(index: int, who: Column, value: Column, keep: Column) -> list[Column]:
        moved = F.when(v == 3, value + 1).otherwise(value)
        return [
            log(index, op.MINT_VAULT, [F.lit(op.MINTED), pad(who)], value, keep),
            log(index + 1, op.MINT_TOKEN, [F.lit(op.TRANSFER), zero, pad(who)], moved, keep & (v != 4)),
        ]

    debt = F.when(v == 5, some - 1).otherwise(some + fee)
    final = log(12, op.MINT_VAULT, [F.lit(op.MINT_FINALIZED), pad(other), F.col("deposit_key"), pad(F.col("depositor"))], debt, F.lit(True))
    noise = log(7, op.MINT_TOKEN, [F.lit(op.TRANSFER), pad(other), pad(F.col("depositor"))], some, F.lit(True))
    every = [
        noise, *two(8, F.col("depositor"), some, v.isin(1, 2)), *two(10, F.col("depositor"), some, v != 1), *two(10, other, fee, v == 1), final,
    ]
    late = F.when(v == 6, op.MINT_WINDOW_MS + 1).otherwise(op.HOUR_MS)
    return reveals.where(v < 7).select(
        F.concat(F.lit("m"), "deposit_key").alias("tx_hash"), F.lit(3).alias("block_number"), (F.col("timestamp_ms") + late).alias("timestamp_ms"),
        F.inline(F.array_compact(F.array(*every))),
    )


@query(
    "d15_deposit_lifecycle",
    f"""WITH {_MINT}, s AS (SELECT DISTINCT prev_tx_hash AS tx_hash, prev_output_index AS output_index, tx_hash AS spend_tx, block_timestamp_unix_ms AS spend_ms FROM inputs)
    SELECT r.tx_hash, r.output_index, CASE WHEN v IN (0, 1) AND value_sats > 0 THEN 'minted' WHEN s.spend_tx IS NOT NULL AND r.output_index % 3 = 0 AND s.spend_ms + 300000 >= greatest(r.reveal_ms, s.spend_ms - 7200000) THEN 'swept'
        WHEN s.spend_tx IS NOT NULL THEN 'spent' ELSE 'revealed' END AS stage, s.spend_tx,
        CASE WHEN value_sats > 0 THEN CASE v WHEN 0 THEN value_sats::hugeint * 9000000000 WHEN 1 THEN value_sats::hugeint * 9000001000 END END::VARCHAR AS minted_raw
    FROM r LEFT JOIN s USING (tx_hash, output_index)""",
)
def deposit_lifecycle(t: Tables) -> DataFrame:
    """Outputs with an even index are revealed ten minutes later; some are swept, and most have mint logs."""
    outs, reveals = _deposits(t)
    ins = t.utxo_inputs().dropDuplicates(["prev_tx_hash", "prev_output_index"])
    hashed = lambda c: F.sha2(c, 256)
    spends = ins.select(
        "prev_tx_hash", "prev_output_index", F.col("tx_hash"), "block_number",
        F.col("block_timestamp_unix_ms").alias("timestamp_ms"),
    )
    wide_spends = spends.withColumn("tx_hash", hashed(F.col("tx_hash")))
    sweeps = ins.where(F.col("prev_output_index") % 3 == 0).select(
        op.reversed_hash(hashed(F.col("tx_hash"))).alias("sweep_tx_reversed"),
        hashed(F.concat_ws(":", "prev_tx_hash", F.col("prev_output_index").cast("string"))).alias("wallet"),
        (F.col("block_timestamp_unix_ms") + 300_000).alias("timestamp_ms"),
        F.concat(F.lit("w"), F.col("tx_hash")).alias("event_id"), F.lit(2).alias("block_number"), F.lit(1).alias("log_index"),
    )
    mints = op.mint_observations(mint_logs(reveals))
    chain = op.deposit_lifecycle(outs, reveals.drop("value_sats", "variant"), wide_spends, sweeps, mints)
    names = spends.select(F.col("tx_hash").alias("spend_name"), hashed(F.col("tx_hash")).alias("spend_tx")).distinct()
    return chain.join(names, "spend_tx", "left").select(
        "tx_hash", "output_index", "stage", F.col("spend_name").alias("spend_tx"), "minted_raw"
    )


def _deposits(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Outputs, and the reveals of those with an even index."""
    outs = t.utxo_outputs().where(F.col("coinbase") == 0).dropDuplicates(["tx_hash", "output_index"])
    deposit = F.sha2(F.concat_ws(":", "tx_hash", F.col("output_index").cast("string")), 256)
    reveals = outs.where(F.col("output_index") % 2 == 0).select(
        F.col("tx_hash").alias("funding_tx_hash"), "output_index", deposit.alias("deposit_key"),
        F.concat(F.lit("0x"), F.substring(deposit, 1, 40)).alias("depositor"), deposit.alias("wallet"),
        (F.col("block_timestamp_unix_ms") + 600_000).alias("timestamp_ms"),
        F.lit(1).alias("block_number"), F.lit(1).alias("log_index"), "value_sats", (F.floor(F.col("output_index") / 2) % 8).alias("variant"),
    )
    return outs, reveals


@query(
    "d15_mint_observations",
    f"""WITH {_MINT} SELECT sha256(tx_hash || ':' || output_index) AS deposit_key, (value_sats::hugeint * CASE v WHEN 1 THEN 9000001000 ELSE 9000000000 END)::VARCHAR AS minted_raw, (CASE v WHEN 1 THEN value_sats * 1000 ELSE 0 END)::VARCHAR AS fee_raw
        FROM r WHERE v IN (0, 1, 5, 6) AND value_sats > 0""",
)
def mint_observations(t: Tables) -> DataFrame:
    """Every variant that pairs, whether or not the deposit's time and amounts allow it."""
    return op.mint_observations(mint_logs(_deposits(t)[1])).select("deposit_key", "minted_raw", "fee_raw")


@query(
    "d18_receipt_swaps",
    """WITH s AS (SELECT tx_hash, pool, side, asset_id, sum(amount) AS total FROM (
            SELECT tx_hash, to_address AS pool, 'in' AS side, asset_id, amount FROM edges WHERE token_id IS NULL
            UNION ALL SELECT tx_hash, from_address, 'out', asset_id, amount FROM edges WHERE token_id IS NULL)
        WHERE amount > 0 GROUP BY ALL),
    p AS (SELECT tx_hash, pool, count(*) FILTER (side = 'in') AS ni, count(*) FILTER (side = 'out') AS no,
        max(asset_id) FILTER (side = 'in') AS asset_in, max(asset_id) FILTER (side = 'out') AS asset_out,
        sum(total) FILTER (side = 'in') AS amount_in, sum(total) FILTER (side = 'out') AS amount_out FROM s GROUP BY 1, 2)
    SELECT tx_hash, pool, asset_in, asset_out, cast(amount_in AS varchar) AS amount_in, cast(amount_out AS varchar) AS amount_out FROM p
    WHERE ni = 1 AND no = 1 AND asset_in <> asset_out AND amount_in % 2 = 0""",
)
def receipt_swaps(t: Tables) -> DataFrame:
    """Swap logs stated by the transfers themselves; odd totals are misreported."""
    real = t.edges().where(F.col("token_id").isNull())
    legs = real.select(
        "tx_hash", F.col("amount_raw").cast("bigint").alias("v"),
        F.inline(F.array(F.struct(F.col("to_address").alias("pool"), F.lit(1).alias("i")),
                         F.struct(F.col("from_address").alias("pool"), F.lit(0).alias("i")))),
    )
    logs = legs.groupBy("tx_hash", "pool").agg(
        F.coalesce(F.sum(F.when(F.col("i") == 1, F.col("v"))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("i") == 0, F.col("v"))), F.lit(0)).alias("b"),
    ).select(
        "tx_hash", "pool", F.lit(0).alias("log_index"),
        (F.col("a") + F.col("a") % 2).cast("string").alias("amount0_in"), F.lit("0").alias("amount1_in"),
        F.lit("0").alias("amount0_out"), F.col("b").cast("string").alias("amount1_out"),
    )
    return op.receipt_swaps(logs, t.edges()).drop("log_index")

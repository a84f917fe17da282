"""Queries over clustering leads and pattern detectors (sections I and J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweft.operators import activity, clusters, events, visibility
from chainweft.operators import detect as op
from chainweft.plans.activity import _ACTIVITY
from chainweft.plans.graph import current_claims
from chainweft.plans.registry import ZERO, query
from chainweft.plans.visibility import AT, registry_rows
from chainweft.sources.tables import Tables


def shape(t: Tables) -> DataFrame:
    return clusters.tx_shape(t.utxo_inputs(), t.utxo_outputs(), t.utxo_txs())


_SHAPE = """leg AS (SELECT tx_hash, 'i' AS side, coalesce(address, 'script:' || sha256(script_hex)) AS subject, value_sats AS v, address IS NULL OR value_sats = 0 AS bad FROM inputs
        UNION ALL SELECT tx_hash, 'o', coalesce(address, 'script:' || sha256(script_hex)), value_sats, address IS NULL AND value_sats > 0 FROM outputs),
    eq AS (SELECT tx_hash, max(n) AS equal_owners FROM (SELECT tx_hash, v, count(DISTINCT subject) AS n FROM leg WHERE side = 'o' AND v > 0 GROUP BY 1, 2) GROUP BY 1),
    shp AS (SELECT u.tx_hash, coinbase, count(*) FILTER (side = 'i') AS inputs, count(DISTINCT subject) FILTER (side = 'i') AS input_subjects,
        count(*) FILTER (side = 'o' AND v > 0) AS positive_outputs, count(DISTINCT subject) FILTER (side = 'o' AND v > 0) AS output_subjects,
        bool_or(bad) AS bad, coalesce(max(equal_owners), 0) AS equal_owners
        FROM utxs u JOIN leg USING (tx_hash) LEFT JOIN eq USING (tx_hash) GROUP BY 1, 2),
    sup AS (SELECT *, CASE WHEN coinbase = 1 THEN 'coinbase' WHEN bad THEN 'script_or_zero_input_context'
        WHEN input_subjects >= 2 AND equal_owners >= 2 THEN 'possible_collaborative_transaction' WHEN input_subjects > 16 THEN 'member_limit' END AS suppressed FROM shp)"""
_FAMILY = "CASE WHEN starts_with({a}, '1') THEN 'p2pkh' WHEN starts_with({a}, '3') THEN 'p2sh' WHEN starts_with({a}, 'bc1p') THEN 'taproot' ELSE 'other' END"


@query(
    "i01_common_input_leads",
    f"""WITH {_SHAPE} SELECT tx_hash, string_agg(DISTINCT address, ',' ORDER BY address) AS members, 0.5::double AS confidence
        FROM inputs JOIN sup USING (tx_hash) WHERE suppressed IS NULL AND input_subjects BETWEEN 2 AND 16 GROUP BY 1""",
)
def common_input_leads(t: Tables) -> DataFrame:
    found = clusters.common_input(t.utxo_inputs(), shape(t))
    return found.select("tx_hash", F.array_join("members", ",").alias("members"), "confidence")


@query(
    "i02_change_leads",
    f"""WITH {_SHAPE}, c AS (SELECT tx_hash FROM sup WHERE suppressed IS NULL AND inputs = 1 AND positive_outputs = 2 AND output_subjects = 2),
    p AS (SELECT i.tx_hash, i.address AS payer, o.address AS a, o.output_index, {_FAMILY.format(a='i.address')} = {_FAMILY.format(a='o.address')} AS same
        FROM inputs i JOIN c USING (tx_hash) JOIN outputs o USING (tx_hash) WHERE o.value_sats > 0)
    SELECT tx_hash, payer, max(a) FILTER (same) AS candidate, {_FAMILY.format(a='payer')} AS family FROM p GROUP BY 1, 2
    HAVING count(*) FILTER (same) = 1 AND count(*) FILTER (a = payer) = 0 AND {_FAMILY.format(a='payer')} <> 'other'""",
)
def change_leads(t: Tables) -> DataFrame:
    return clusters.change_candidate(t.utxo_inputs(), t.utxo_outputs(), shape(t)).select(
        "tx_hash", "payer", "candidate", "family"
    )


@query(
    "i03_lead_suppression",
    f"WITH {_SHAPE} SELECT coalesce(suppressed, 'open') AS suppressed, count(*) AS transactions FROM sup GROUP BY 1",
)
def lead_suppression(t: Tables) -> DataFrame:
    return clusters.lead_suppression(shape(t)).groupBy(
        F.coalesce("suppressed", F.lit("open")).alias("suppressed")
    ).agg(F.count("*").alias("transactions"))


def funnel_edges(t: Tables) -> DataFrame:
    """Every order pays its customer from its priority desk; filled orders go on to a service."""
    order = t.raw("orders")
    key = F.col("o_custkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    base = [F.col("o_orderkey").alias("block_number"), name("t", F.col("o_orderkey")).alias("tx_hash")]
    into = order.select(*base, name("desk", F.substring("o_orderpriority", 1, 1)).alias("from_address"),
                        name("C", key).alias("to_address"))
    on = order.where(F.col("o_orderstatus") == "F").select(
        *base, name("C", key).alias("from_address"), name("S", key % 7 * 10).alias("to_address")
    )
    return into.unionByName(on)


@query(
    "i04_deposit_wallets",
    """WITH fe AS (SELECT 'desk' || substr(o_orderpriority, 1, 1) AS f, 'C' || o_custkey AS t FROM orders
        UNION ALL SELECT 'C' || o_custkey, 'S' || (o_custkey % 7 * 10) FROM orders WHERE o_orderstatus = 'F'),
    a AS (SELECT w AS address, count(*) FILTER (d = 'in') AS inbound_txs, count(*) FILTER (d = 'out') AS outbound_txs, count(DISTINCT p) FILTER (d = 'in') AS unique_senders,
        count(DISTINCT p) FILTER (d = 'out') AS unique_receivers FROM (SELECT f AS w, t AS p, 'out' AS d FROM fe UNION ALL SELECT t, f, 'in' FROM fe) GROUP BY 1),
    s AS (SELECT f AS candidate_address, t AS anchor_address, entity_id, confidence AS ac, count(*) AS sweep_count
        FROM fe JOIN exchanges x ON x.address = t WHERE confidence >= 0.8 AND address_role IN ('HOT', 'SWEEP', 'TREASURY', 'INTERNAL') GROUP BY 1, 2, 3, 4)
    SELECT candidate_address, anchor_address, entity_id AS anchor_entity_id, sweep_count, unique_senders,
        round(least(0.55 + 0.15 * (least(unique_senders, 10) / 10.0) + 0.15 * (least(sweep_count, 5) / 5.0), 0.90, ac), 6) AS confidence
    FROM s JOIN a ON a.address = candidate_address WHERE inbound_txs >= 2 AND unique_senders >= 2 AND outbound_txs >= 1 AND unique_receivers <= 3""",
)
def deposit_wallets(t: Tables) -> DataFrame:
    edges = funnel_edges(t)
    found = clusters.deposit_wallets(
        activity.address_activity(edges), activity.anchor_sweeps(edges, t.exchanges())
    )
    return found.withColumn("confidence", F.round("confidence", 6)).drop("address_role")


@query(
    "i05_service_wallets",
    f"""WITH a AS ({_ACTIVITY}) SELECT * FROM (SELECT address, CASE WHEN inbound_txs >= 100 AND outbound_txs >= 100 AND unique_senders >= 50 AND unique_receivers >= 50 THEN 'HOT'
        WHEN inbound_txs >= 25 AND unique_senders >= 20 AND outbound_txs > 0 AND unique_receivers <= 10 THEN 'SWEEP'
        WHEN outbound_txs >= 25 AND unique_receivers >= 20 AND unique_senders <= 10 THEN 'WITHDRAW' END AS address_role FROM a) WHERE address_role IS NOT NULL""",
)
def service_wallets(t: Tables) -> DataFrame:
    return clusters.service_wallets(activity.address_activity(t.edges())).select("address", "address_role")


_SHARED = f"""SELECT to_address AS destination, asset_id, coalesce(token_id, '') AS token, count(DISTINCT from_address) AS distinct_senders, count(*) AS transfers, max(block_number) AS last_block
        FROM edges WHERE amount > 0 AND from_address <> to_address AND from_address <> {ZERO} AND to_address <> {ZERO}
        GROUP BY 1, 2, 3 HAVING count(DISTINCT from_address) BETWEEN 3 AND 20"""


@query("i06_shared_destinations", _SHARED)
def shared_destinations(t: Tables) -> DataFrame:
    return clusters.shared_destination(t.edges())


@query(
    "i06_shared_destination_senders",
    f"""WITH l AS ({_SHARED}) SELECT destination, l.asset_id, token, from_address AS sender, count(*) AS transfers, min(relationship_id) AS evidence_ref
        FROM l JOIN edges e ON e.to_address = destination AND e.asset_id = l.asset_id AND coalesce(e.token_id, '') = token
        GROUP BY 1, 2, 3, 4""",
)
def shared_destination_senders(t: Tables) -> DataFrame:
    return clusters.shared_destination_members(t.edges(), clusters.shared_destination(t.edges()))


@query(
    "i07_entity_clusters",
    f"""WITH cur AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1),
    src AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY revision DESC) = 1),
    act AS (SELECT cur.* FROM cur JOIN src USING (source_id) WHERE is_active = 1 AND lower(review_status) = 'approved' AND (valid_to_unix_ms IS NULL OR valid_to_unix_ms > {AT}))
    SELECT entity_id, address AS subject_id, min(address) OVER (PARTITION BY entity_id) AS left_subject_id, count(*) OVER (PARTITION BY entity_id) AS active_member_count,
        sha256('entity_cluster|' || entity_id) AS cluster_id FROM act""",
)
def entity_clusters(t: Tables) -> DataFrame:
    active = visibility.active_claims(t.claims(), t.sources(), AT)
    return clusters.entity_clusters(active, active, "run1").select(
        "entity_id", "subject_id", "left_subject_id", "active_member_count", "cluster_id"
    )


@query(
    "i08_deployment_control",
    "SELECT 'control:' || tx_hash AS cluster_id, 'N' || tx_hash AS subject_id, from_address AS left_subject_id FROM txs WHERE status = 1 AND input_data = ''",
)
def deployment_control(t: Tables) -> DataFrame:
    """Orders without call data act as deployments of a new contract."""
    contract = F.when(F.col("input_data") == "", F.concat(F.lit("N"), "tx_hash"))
    return clusters.deployment_control(t.account_txs().withColumn("contract_address", contract), "run1").select(
        "cluster_id", "subject_id", "left_subject_id"
    )


@query(
    "i09_changed_claims",
    """SELECT 'S' || s_suppkey AS address, 'ent' || (s_suppkey % 40) AS cluster_id, CASE WHEN s_suppkey % 5 = 0 THEN 'HOT' ELSE 'DEPOSIT' END AS address_role FROM supplier
        WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0""",
)
def changed_claims(t: Tables) -> DataFrame:
    """Stored claims know every supplier but multiples of seven; fives changed role."""
    key = F.col("s_suppkey")
    base = t.raw("supplier").select(
        key, F.concat(F.lit("S"), key.cast("string")).alias("address"),
        F.concat(F.lit("ent"), (key % 40).cast("string")).alias("cluster_id"), F.lit("sweep").alias("claim_method"),
    )
    role = F.when(key % 5 == 0, "HOT").otherwise("DEPOSIT")
    new = base.withColumn("address_role", role)
    old = base.where(key % 7 != 0).withColumns({"address_role": F.lit("DEPOSIT"), "created_at_unix_ms": F.lit(2)})
    older = old.withColumns({"address_role": F.lit("HOT"), "created_at_unix_ms": F.lit(1)})
    return clusters.changed_claims(new, old.unionByName(older), ["address_role"]).select(
        "address", "cluster_id", "address_role"
    )


@query("j01_consolidation", f"WITH {_SHAPE} SELECT tx_hash, inputs FROM shp WHERE coinbase = 0 AND inputs >= 5 AND positive_outputs = 1")
def consolidation(t: Tables) -> DataFrame:
    return op.consolidation(shape(t)).select("tx_hash", "inputs")


@query(
    "j02_fan_out",
    f"WITH {_SHAPE} SELECT tx_hash, inputs, positive_outputs FROM shp WHERE coinbase = 0 AND inputs BETWEEN 1 AND 2 AND positive_outputs >= 5 AND output_subjects >= 3",
)
def fan_out(t: Tables) -> DataFrame:
    return op.fan_out(shape(t)).select("tx_hash", "inputs", "positive_outputs")


@query(
    "j03_possible_coinjoin",
    f"""WITH {_SHAPE}, v AS (SELECT tx_hash, value_sats, count(DISTINCT address) AS n FROM outputs WHERE value_sats > 0 AND address IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT address) >= 3)
    SELECT tx_hash, value_sats AS equal_output_sats, n AS equal_addresses FROM v JOIN shp USING (tx_hash) WHERE coinbase = 0 AND input_subjects >= 3
    QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY n DESC, value_sats DESC) = 1""",
)
def possible_coinjoin(t: Tables) -> DataFrame:
    return op.coinjoin(shape(t), t.utxo_outputs()).select("tx_hash", "equal_output_sats", "equal_addresses")


_PEEL = f"""{_SHAPE}, pl AS (SELECT o.tx_hash, max((value_sats, output_index)) AS lg, min((value_sats, output_index)) AS sm FROM outputs o JOIN shp USING (tx_hash)
        WHERE shp.coinbase = 0 AND inputs = 1 AND positive_outputs = 2 AND value_sats > 0 GROUP BY 1),
    step AS (SELECT pl.tx_hash, lg[1] AS largest_sats, lg[2] AS largest_output_index, i.value_sats AS input_sats, prev_tx_hash, prev_output_index FROM pl JOIN inputs i USING (tx_hash)
        WHERE lg[1] // sm[1] >= 4 AND lg[1] < i.value_sats)"""


@query("j04_peel_steps", f"WITH {_PEEL} SELECT tx_hash, largest_output_index, largest_sats, input_sats FROM step")
def peel_steps(t: Tables) -> DataFrame:
    return op.peel_steps(shape(t), t.utxo_inputs(), t.utxo_outputs()).select(
        "tx_hash", "largest_output_index", "largest_sats", "input_sats"
    )


def _loose_steps(t: Tables) -> DataFrame:
    """One-input transactions with the largest output, whatever the ratio."""
    one = shape(t).where((F.col("coinbase") == 0) & (F.col("inputs") == 1) & (F.col("positive_outputs") >= 1))
    top = t.utxo_outputs().join(one.select("tx_hash"), "tx_hash", "left_semi").groupBy("tx_hash").agg(
        F.max(F.struct(F.col("value_sats").alias("v"), F.col("output_index").alias("i"))).alias("l")
    )
    return t.utxo_inputs().join(top, "tx_hash").select(
        "tx_hash", F.col("l.i").alias("largest_output_index"), "prev_tx_hash", "prev_output_index"
    )


@query(
    "j05_peel_chains",
    f"""WITH RECURSIVE {_SHAPE}, st AS (SELECT i.tx_hash, l[2] AS li, i.prev_tx_hash, i.prev_output_index FROM inputs i JOIN (SELECT o.tx_hash, max((value_sats, output_index)) AS l FROM outputs o JOIN shp USING (tx_hash)
            WHERE shp.coinbase = 0 AND inputs = 1 AND positive_outputs >= 1 GROUP BY 1) x USING (tx_hash)),
    lk AS (SELECT p.tx_hash AS parent, c.tx_hash AS child FROM st c JOIN st p ON c.prev_tx_hash = p.tx_hash AND c.prev_output_index = p.li),
    up AS (SELECT tx_hash AS anchor, tx_hash AS head, 0 AS back FROM st UNION ALL SELECT anchor, parent, back + 1 FROM up JOIN lk ON child = head WHERE back < 2),
    h AS (SELECT anchor, head, back FROM up QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY back DESC) = 1),
    dn AS (SELECT anchor, head AS node, head AS chain, 1 AS steps FROM h UNION ALL SELECT anchor, child, chain || '>' || child, steps + 1 FROM dn JOIN lk ON parent = node WHERE steps < 5)
    SELECT anchor, chain, steps FROM dn QUALIFY steps >= 3 AND row_number() OVER (PARTITION BY anchor ORDER BY steps DESC) = 1""",
)
def peel_chains(t: Tables) -> DataFrame:
    """The chain rule over looser steps, as strict peel steps rarely meet in the supplied data."""
    found = op.peel_chains(_loose_steps(t))
    return found.select("anchor", F.array_join("chain", ">").alias("chain"), "steps")


def _peel_lines(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer's orders as a line of payments: each spends what the one before left and pays its own total."""
    line = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = t.raw("orders").select(
        F.concat(F.lit("p"), "o_orderkey").alias("tx_hash"), F.concat(F.lit("C"), "o_custkey").alias("address"), F.col("o_custkey"), "o_orderkey", cents.alias("cents")
    ).withColumns({
        "held": F.sum("cents").over(line) + 100_000_000,
        "prev_tx_hash": F.coalesce(F.lead("tx_hash").over(line), F.lit("origin")),
    })
    header = ["tx_hash", "address", F.lit("").alias("script_hex")]
    inputs = rows.select(*header, F.col("held").alias("value_sats"), "prev_tx_hash", F.lit(0).alias("prev_output_index"))
    left = rows.select(*header, F.lit(0).alias("output_index"), (F.col("held") - F.col("cents")).alias("value_sats"))
    paid = rows.select("tx_hash", F.concat(F.lit("S"), F.col("o_orderkey") % 50).alias("address"), F.lit("").alias("script_hex"), F.lit(1).alias("output_index"), (F.col("cents") - 1).alias("value_sats"))
    return inputs, left.unionByName(paid), rows.select("tx_hash", F.lit(0).alias("coinbase"))


@query(
    "j05_peel_chains_strict",
    """WITH RECURSIVE r AS (SELECT 'p' || o_orderkey AS tx, o_custkey AS c, o_orderkey AS k, cast(round(o_totalprice * 100) AS bigint) AS cents FROM orders),
    v AS (SELECT tx, cents, sum(cents) OVER (PARTITION BY c ORDER BY k DESC) + 100000000 AS held, lag(tx) OVER (PARTITION BY c ORDER BY k) AS prev, lag(cents) OVER (PARTITION BY c ORDER BY k) AS pc FROM r),
    st AS (SELECT tx, prev, pc FROM v WHERE cents > 1 AND greatest(held - cents, cents - 1) // least(held - cents, cents - 1) >= 4),
    lk AS (SELECT p.tx AS parent, c.tx AS child FROM st c JOIN st p ON p.tx = c.prev JOIN v ON v.tx = p.tx WHERE v.held - v.cents >= v.cents - 1),
    up AS (SELECT tx AS anchor, tx AS head, 0 AS back FROM st UNION ALL SELECT anchor, parent, back + 1 FROM up JOIN lk ON child = head WHERE back < 2),
    h AS (SELECT anchor, head, back FROM up QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY back DESC) = 1),
    dn AS (SELECT anchor, head AS node, head AS chain, 1 AS steps FROM h UNION ALL SELECT anchor, child, chain || '>' || child, steps + 1 FROM dn JOIN lk ON parent = node WHERE steps < 5)
    SELECT anchor, chain, steps FROM dn QUALIFY steps >= 3 AND row_number() OVER (PARTITION BY anchor ORDER BY steps DESC) = 1""",
)
def peel_chains_strict(t: Tables) -> DataFrame:
    inputs, outputs, txs = _peel_lines(t)
    found = op.peel_chains(op.peel_steps(clusters.tx_shape(inputs, outputs, txs), inputs, outputs))
    return found.select("anchor", F.array_join("chain", ">").alias("chain"), "steps")


_NET = f"""net AS (SELECT tx_hash, address, asset_id, sum(v) AS n FROM (SELECT tx_hash, from_address AS address, asset_id, -amount AS v FROM edges
        UNION ALL SELECT tx_hash, to_address, asset_id, amount FROM edges) GROUP BY 1, 2, 3),
    sg AS (SELECT tx_hash, address, count(*) FILTER (n < 0) AS sent, count(*) FILTER (n > 0) AS received, min(asset_id) FILTER (n < 0) AS sa, min(asset_id) FILTER (n > 0) AS ra
        FROM net WHERE address <> {ZERO} GROUP BY 1, 2)"""


@query("j06_swaps", f"WITH {_NET} SELECT tx_hash, address AS subject, sa AS asset_in, ra AS asset_out FROM sg WHERE sent = 1 AND received = 1")
def swaps(t: Tables) -> DataFrame:
    return op.swaps(activity.net_flows(t.edges()))


@query(
    "j07_liquidity",
    f"""WITH {_NET} SELECT tx_hash, address AS subject, ra AS pool_asset, 'liquidity_add' AS event_type FROM sg WHERE sent >= 2 AND received = 1
            AND (tx_hash, address, ra) IN (SELECT tx_hash, to_address, asset_id FROM edges WHERE from_address = {ZERO})
        UNION ALL SELECT tx_hash, address, sa, 'liquidity_remove' FROM sg WHERE sent = 1 AND received >= 2
            AND (tx_hash, sa) IN (SELECT tx_hash, asset_id FROM edges WHERE to_address = {ZERO})""",
)
def liquidity(t: Tables) -> DataFrame:
    edges = t.edges()
    return op.liquidity(activity.net_flows(edges), edges)


@query(
    "j08_bridge_moves",
    f"""WITH {_NET} SELECT DISTINCT n.tx_hash, address AS subject, n.asset_id, CASE WHEN n > 0 THEN 'bridge_in' ELSE 'bridge_out' END AS event_type FROM net n JOIN features USING (tx_hash)
        WHERE is_bridge = 1 AND address <> {ZERO} AND ((n > 0 AND (n.tx_hash, address, n.asset_id) IN (SELECT tx_hash, to_address, asset_id FROM edges WHERE from_address = {ZERO}))
            OR (n < 0 AND (n.tx_hash, address, n.asset_id) IN (SELECT tx_hash, from_address, asset_id FROM edges WHERE to_address = {ZERO})))""",
)
def bridge_moves(t: Tables) -> DataFrame:
    hints = t.features().where(F.col("is_bridge") == 1)
    return op.bridge_moves(t.edges(), hints)


@query(
    "j09_mint_burn",
    f"""SELECT tx_hash, relationship_id, 'token_mint' AS event_type, to_address AS subject FROM edges WHERE from_address = {ZERO}
        UNION ALL SELECT tx_hash, relationship_id, 'token_burn', from_address FROM edges WHERE to_address = {ZERO}""",
)
def mint_burn(t: Tables) -> DataFrame:
    return op.mint_burn(t.edges()).select("tx_hash", "relationship_id", "event_type", "subject")


@query(
    "j13_transaction_features",
    f"""WITH ev AS (SELECT tx_hash, 'token_mint' AS e FROM edges WHERE from_address = {ZERO} UNION ALL SELECT tx_hash, 'token_burn' FROM edges WHERE to_address = {ZERO}
        UNION ALL SELECT tx_hash, 'swap' FROM features WHERE is_swap = 1 UNION ALL SELECT tx_hash, 'bridge_deposit' FROM features WHERE is_bridge = 1),
    f AS (SELECT tx_hash, max(CASE WHEN e = 'swap' THEN 1 ELSE 0 END) AS is_swap, max(CASE WHEN e = 'bridge_deposit' THEN 1 ELSE 0 END) AS is_bridge,
        max(CASE WHEN e = 'token_mint' THEN 1 ELSE 0 END) AS is_mint, max(CASE WHEN e = 'token_burn' THEN 1 ELSE 0 END) AS is_burn, min(e) AS transaction_subtype FROM ev GROUP BY 1),
    a AS (SELECT tx_hash, count(DISTINCT asset_id) AS unique_assets FROM edges GROUP BY 1),
    p AS (SELECT tx_hash, count(DISTINCT x) AS participants FROM (SELECT tx_hash, from_address AS x FROM edges UNION ALL SELECT tx_hash, to_address FROM edges) WHERE x <> {ZERO} GROUP BY 1)
    SELECT f.*, CASE WHEN is_bridge = 1 THEN 'bridge' WHEN is_swap = 1 THEN 'defi' ELSE 'token' END AS transaction_type, unique_assets, participants,
        CASE WHEN input_data NOT IN ('', '0x') THEN 1 ELSE 0 END AS is_contract_call
    FROM f JOIN a USING (tx_hash) JOIN p USING (tx_hash) JOIN txs USING (tx_hash)""",
)
def transaction_features(t: Tables) -> DataFrame:
    edges, flags = t.edges(), t.features()
    found = op.mint_burn(edges).select("tx_hash", "event_type")
    for flag, name in (("is_swap", "swap"), ("is_bridge", "bridge_deposit")):
        found = found.unionByName(flags.where(F.col(flag) == 1).select("tx_hash", F.lit(name).alias("event_type")))
    rows = op.tx_features(found.withColumn("confidence", F.lit(1.0)), t.account_txs(), edges)
    return rows.drop("is_liquidity_add", "is_liquidity_remove", "classification_confidence")


def _typed_input(t: Tables) -> DataFrame:
    flags = t.features()
    kinds = t.edges().groupBy("tx_hash").agg(
        F.max((F.col("asset_id") != "asset:0").cast("int")).alias("has_token_transfer"),
        F.max((F.col("asset_id") == "asset:0").cast("int")).alias("has_native_transfer"),
    )
    number = F.regexp_extract("tx_hash", "([0-9]+)$", 1).cast("bigint")
    names = F.array(*[F.lit(c) for c in ("unknown", "lending", "staking", "mixer", "scam", "nft", "dex", "token", "wallet")])
    return flags.join(kinds, "tx_hash").select(
        "tx_hash", F.col("is_bridge").alias("has_bridge"),
        F.when(number % 2 == 0, "bridge_in").alias("bridge_subtype"), F.col("is_liquidity_add").alias("has_liquidity_add"),
        F.col("is_liquidity_remove").alias("has_liquidity_remove"), F.col("is_swap").alias("has_swap"),
        F.col("is_mint").alias("has_mint"), F.col("is_burn").alias("has_burn"),
        F.get(names, (number % 9).cast("int")).alias("category"), F.when(number % 4 == 0, "borrow").alias("operation"),
        (number % 100 / 100.0).alias("base_confidence"), "is_contract_call", F.lit("TriggerSmartContract").alias("contract_type"),
        "has_token_transfer", "has_native_transfer",
    )


@query(
    "j14_transaction_type",
    """WITH x AS (SELECT f.*, cast(substr(f.tx_hash, 2) AS bigint) AS k, max(CASE WHEN asset_id <> 'asset:0' THEN 1 ELSE 0 END) AS tok, max(CASE WHEN asset_id = 'asset:0' THEN 1 ELSE 0 END) AS nat
        FROM features f JOIN edges USING (tx_hash) GROUP BY ALL),
    y AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'borrow' END AS m, k % 9 AS c, k % 100 / 100.0::double AS q FROM x)
    SELECT tx_hash, CASE WHEN is_bridge = 1 THEN 'bridge' WHEN is_liquidity_add = 1 OR is_liquidity_remove = 1 THEN 'liquidity' WHEN is_swap = 1 THEN 'swap'
            WHEN is_mint = 1 AND is_burn = 1 THEN 'token_lifecycle' WHEN is_mint = 1 THEN 'mint' WHEN is_burn = 1 THEN 'burn'
            WHEN c = 1 THEN 'lending' WHEN c = 2 THEN 'staking' WHEN c = 3 THEN 'mixer_interaction' WHEN c = 4 THEN 'scam_interaction' WHEN c = 5 THEN 'nft_interaction'
            WHEN c = 6 THEN 'dex_interaction' WHEN c = 7 THEN 'token_interaction' WHEN c = 8 THEN 'wallet_interaction' WHEN is_contract_call = 1 THEN 'contract_call'
            WHEN tok = 1 THEN 'token_transfer' WHEN nat = 1 THEN 'native_transfer' ELSE 'unknown' END AS transaction_type,
        CASE WHEN is_bridge = 1 THEN CASE WHEN k % 2 = 0 THEN 'bridge_in' ELSE 'bridge_transfer' END WHEN is_liquidity_add = 1 THEN 'add' WHEN is_liquidity_remove = 1 THEN 'remove'
            WHEN is_swap = 1 THEN 'token_swap' WHEN is_mint = 1 AND is_burn = 1 THEN 'mint_and_burn' WHEN is_mint = 1 THEN 'token_mint' WHEN is_burn = 1 THEN 'token_burn'
            WHEN c IN (3, 4, 8) THEN coalesce(m, 'labeled_counterparty') WHEN c IN (1, 2, 5, 6, 7) THEN coalesce(m, 'contract_call')
            WHEN is_contract_call = 1 THEN 'TriggerSmartContract' WHEN tok = 1 THEN 'trc20_transfer' WHEN nat = 1 THEN 'trx_transfer' ELSE 'TriggerSmartContract' END AS transaction_subtype,
        round(CASE WHEN is_bridge = 1 THEN greatest(q, 0.88) WHEN is_liquidity_add = 1 OR is_liquidity_remove = 1 THEN greatest(q, 0.82) WHEN is_swap = 1 THEN greatest(q, 0.78)
            WHEN is_mint = 1 AND is_burn = 1 THEN 0.85 WHEN is_mint = 1 OR is_burn = 1 THEN 0.82 WHEN c IN (3, 4) THEN greatest(q, 0.80) WHEN c = 5 THEN greatest(q, 0.75)
            WHEN c IN (1, 2, 6, 7, 8) THEN greatest(q, 0.70) WHEN is_contract_call = 1 THEN greatest(q, 0.50) ELSE 0.95 END, 6) AS confidence FROM y""",
)
def transaction_types(t: Tables) -> DataFrame:
    return op.transaction_type(_typed_input(t)).select(
        "tx_hash", "transaction_type", "transaction_subtype", F.round("confidence", 6).alias("confidence")
    )


@query(
    "j15_contract_classes",
    f"""WITH {_NET}, t AS (SELECT *, 'S' || (cast(substr(from_address, 2) AS bigint) % 50) AS tgt FROM txs),
    reg AS (SELECT 'S' || s_suppkey AS contract, CASE WHEN s_suppkey % 8 < 3 THEN 'dex' WHEN s_suppkey % 8 = 3 THEN 'bridge' WHEN s_suppkey % 8 = 4 THEN 'lending' WHEN s_suppkey % 8 = 5 THEN 'staking' WHEN s_suppkey % 8 = 6 THEN 'mixer' ELSE 'scam' END AS pt FROM supplier WHERE s_suppkey % 3 = 0),
    e AS (SELECT tx_hash, count(*) AS n, bool_or(token_id IS NOT NULL) AS nft, bool_or(token_id IS NULL) AS ft FROM edges GROUP BY 1),
    fl AS (SELECT DISTINCT tx_hash FROM (SELECT tx_hash, address FROM net GROUP BY 1, 2 HAVING count(*) FILTER (n < 0) >= 1 AND count(*) FILTER (n > 0) >= 1 AND count(*) >= 2) JOIN e USING (tx_hash) WHERE n >= 2),
    c AS (SELECT tx_hash, 100 AS p, 0.9::double AS q, pt AS cat, 'registry' AS src FROM t JOIN reg ON contract = to_address
        UNION ALL SELECT tx_hash, 80, CASE input_data WHEN '0xa9059cbb' THEN 0.72::double ELSE 0.84::double END, CASE input_data WHEN '0xa9059cbb' THEN 'token' ELSE 'dex' END, 'method_signature' FROM t WHERE length(input_data) > 2
        UNION ALL SELECT tx_hash, 70, 0.55, 'dex', 'flow_analysis' FROM fl
        UNION ALL SELECT tx_hash, 65, 0.97, 'nft', 'nft_event' FROM e WHERE nft
        UNION ALL SELECT tx_hash, 60, 0.96, 'token', 'token_event' FROM e WHERE ft),
    w AS (SELECT *, first_value(cat) OVER (PARTITION BY tx_hash ORDER BY p DESC) AS wc FROM c)
    SELECT tx_hash, max(wc) AS category, round(1.0 - coalesce(product(1.0 - q) FILTER (cat = wc), 1.0), 6) AS confidence,
        string_agg(CASE WHEN cat = wc THEN src ELSE 'conflict_' || src END, '+' ORDER BY p DESC) AS detection_source FROM w GROUP BY 1""",
)
def contract_classes(t: Tables) -> DataFrame:
    edges = t.edges()
    key = F.regexp_extract("contract", "([0-9]+)$", 1).cast("bigint")
    registry = registry_rows(t).where(key % 3 == 0).withColumn("confidence", F.lit(0.9))
    txs = t.account_txs().withColumns(
        {"contract_address": F.lit(None).cast("string"), "contract_type": F.lit("TriggerSmartContract")}
    )
    candidates = events.classification_candidates(txs, registry, activity.net_flows(edges), edges)
    return events.classify(candidates).select(
        "tx_hash", "category", F.round("confidence", 6).alias("confidence"), "detection_source"
    )


@query(
    "j16_display_events",
    """SELECT subject_id, event_id, category, rank FROM (SELECT *, CASE WHEN starts_with(event_type, 'mixer_') THEN 'mixer' ELSE 'defi' END AS category,
        row_number() OVER (PARTITION BY subject_id ORDER BY block_timestamp_unix_ms DESC, event_id) AS rank FROM sem) WHERE rank <= 20""",
)
def display_events(t: Tables) -> DataFrame:
    return events.display_events(t.semantic_events(), 20).select("subject_id", "event_id", "category", "rank")


@query(
    "j16_nft_legs",
    """SELECT wallet, relationship_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY block_number DESC, transaction_index DESC, event_index DESC, relationship_id) AS rank
        FROM wallet_edges WHERE token_id IS NOT NULL) WHERE rank <= 10""",
)
def nft_legs(t: Tables) -> DataFrame:
    return events.nft_legs(t.edges(), 10).select("wallet", "relationship_id", "rank")


def labelled_wallets(t: Tables) -> DataFrame:
    return current_claims(t).withColumnRenamed("address", "wallet").withColumn(
        "evidence_refs", F.array(F.concat(F.lit("label:"), "claim_id"))
    )

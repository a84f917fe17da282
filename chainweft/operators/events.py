"""Semantic events decoded from logs and reviewed registry rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions import wide
from chainweft.functions.ids import stable_id, word, word_address
from chainweft.functions.ordered import top_per_group
from chainweft.operators.activity import boundary_flows
from chainweft.operators.extract import _topic, abi_proof, amount_of, normal_logs, receipts
from chainweft.session import materialise

# Topic families that name an unregistered pool's protocol.
FAMILY = {
    "amm_v2_swap": "uniswap_v2_compatible", "amm_v2_mint": "uniswap_v2_compatible",
    "amm_v2_burn": "uniswap_v2_compatible", "amm_v3_swap": "uniswap_v3_compatible",
    "amm_v3_mint": "uniswap_v3_compatible", "amm_v3_burn": "uniswap_v3_compatible",
    "curve_int128_swap": "curve_exchange", "balancer_v2_swap": "balancer_vault",
}
# Evidence quality of pool events.
DIRECT, MATCHED_SWAP, MATCHED_LIQUIDITY, UNMATCHED = 0.95, 0.86, 0.88, 0.72


def _map(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key)


def pool_flows(edges: DataFrame, pools: DataFrame) -> DataFrame:
    """Fungible flow into and out of each (tx_hash, pool): asset and amount lists by asset."""
    wanted = pools.select("tx_hash", "pool").distinct()
    legs = edges.where(F.col("token_id").isNull() & (F.col("from_address") != F.col("to_address")))
    sides = legs.select(
        "tx_hash", "asset_id", "amount_raw",
        F.inline(
            F.array(
                F.struct(F.col("to_address").alias("pool"), F.lit("in").alias("side")),
                F.struct(F.col("from_address").alias("pool"), F.lit("out").alias("side")),
            )
        ),
    ).join(wanted, ["tx_hash", "pool"], "left_semi")
    totals = sides.groupBy("tx_hash", "pool", "side", "asset_id").agg(
        wide.total(F.col("amount_raw")).alias("total")
    )
    lists = totals.groupBy("tx_hash", "pool").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "in", F.struct("asset_id", "total")))).alias("ins"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "out", F.struct("asset_id", "total")))).alias("outs"),
    )
    return lists


def _join(items: Column, field: str) -> Column:
    return F.array_join(F.transform(items, lambda x: x[field]), ",")


def log_events(logs: DataFrame, edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Swap and liquidity events of known topic families with the pool's own flows.

    A swap takes its assets from the log (vault swaps), else from flows with one
    asset on each side, else it stays without assets at lower confidence.
    """
    data = F.col("data")
    token = lambda i: F.concat(F.lit("erc20:"), word_address(_topic(i)))
    stated = F.when(
        F.col("abi") == "balancer_v2_swap",
        F.struct(token(2).alias("asset_in"), amount_of(word(data, 0)).alias("amount_in"), token(3).alias("asset_out"), amount_of(word(data, 1)).alias("amount_out")),
    )
    # logs are decoded once; what goes on is short
    known = materialise(
        abi_proof(logs).where(
            F.col("abi_valid") & F.col("operation").isin("swap", "liquidity_add", "liquidity_remove")
        ).select("tx_hash", "log_index", F.col("address").alias("pool"), "abi", "operation", stated.alias("stated")),
        "pool-logs",
    )
    flows = pool_flows(edges, known)
    dex = registry.where(F.col("protocol_type") == "dex").select(
        F.lower("contract").alias("pool"), F.col("protocol").alias("registered"),
        F.col("confidence").alias("registered_confidence"),
    )
    rows = known.join(flows, ["tx_hash", "pool"], "left").join(dex, "pool", "left")
    swap, add = F.col("operation") == "swap", F.col("operation") == "liquidity_add"
    direct = swap & (F.col("abi") == "balancer_v2_swap")
    ins = F.coalesce("ins", F.array().cast("array<struct<asset_id:string,total:string>>"))
    outs = F.coalesce("outs", F.array().cast("array<struct<asset_id:string,total:string>>"))
    single = (F.size(ins) == 1) & (F.size(outs) == 1)
    quality = (
        F.when(direct, DIRECT).when(swap & single, MATCHED_SWAP).when(swap, UNMATCHED)
        .when(F.when(add, F.size(ins)).otherwise(F.size(outs)) > 0, MATCHED_LIQUIDITY).otherwise(UNMATCHED)
    )
    pick_in = swap & single & ~direct | add
    pick_out = swap & single & ~direct | (~swap & ~add)
    return rows.select(
        stable_id(F.col("tx_hash"), F.col("log_index"), F.col("operation"), F.col("pool")).alias("event_id"),
        "tx_hash", "log_index", F.col("operation").alias("event_type"),
        F.coalesce("registered", _map(FAMILY, F.col("abi"))).alias("protocol"), F.col("pool").alias("protocol_contract"),
        F.when(direct, F.col("stated.asset_in")).when(pick_in, _join(ins, "asset_id")).otherwise("").alias("asset_in"),
        F.when(direct, F.col("stated.amount_in")).when(pick_in, _join(ins, "total")).otherwise("").alias("amount_in"),
        F.when(direct, F.col("stated.asset_out")).when(pick_out, _join(outs, "asset_id")).otherwise("").alias("asset_out"),
        F.when(direct, F.col("stated.amount_out")).when(pick_out, _join(outs, "total")).otherwise("").alias("amount_out"),
        F.greatest(quality, F.coalesce("registered_confidence", F.lit(0.0))).alias("confidence"),
    )


# Bridge event signatures - topic: (direction, carries a token).
BRIDGE_TOPICS = {
    "7ff126db8024424bbfd9826e8ab82ff59136289ea440b04b39a0df1b03b9cabf": ("outbound", True),
    "2849b43074093a05396b6f2a937dee8565b15a48a7b3d4bffb732a5017380af5": ("outbound", False),
    "718594027abd4eaed59f95162563e0cc6d0e8d5b86b1c7be8b1b0ac3343d0396": ("outbound", True),
    "35d79ab81f2b2017e19afb5c5571778877782d7a8786f5907f93b0f4702f4f23": ("outbound", False),
    "d59c65b35445225835c83f50b6ede06a7be047d22e357073e250d9af537518cd": ("inbound", True),
    "31b2166ff604fc5672ea5df08a78081d2bc6d746cadce880747f3643d819e83d": ("inbound", False),
    "3ceee06c1e37648fcbb6ed52e17b3e1f275a1f8c7b22a84b2b84732431e046b3": ("inbound", True),
    "2ac69ee804d9a7a0984249f508dfab7cb2534b465b6ce1580f99a38ba9c5e631": ("inbound", False),
}


def registered_events(logs: DataFrame, registry: DataFrame, txs: DataFrame, network_id: str) -> DataFrame:
    """Standard-bridge and mixer events, only from contracts registered for them.

    ``registry``: contract, protocol, protocol_type, decoder, remote_network_id.
    """
    own = normal_logs(logs)
    rules = registry.select(F.lower("contract").alias("address"), "protocol", "decoder", "protocol_type",
                            "remote_network_id")
    data = F.col("data")
    bridge = own.join(
        rules.where((F.col("decoder") == "op_standard_bridge_v1") & (F.col("protocol_type") == "bridge")), "address"
    ).withColumns(
        {
            "bridge_direction": _map({k: v[0] for k, v in BRIDGE_TOPICS.items()}, _topic(0)),
            "token": _map({k: v[1] for k, v in BRIDGE_TOPICS.items()}, _topic(0)),
        }
    ).where(F.col("bridge_direction").isNotNull())
    token = F.col("token")
    parts = bridge.withColumns(
        {
            "sender": word_address(F.when(token, _topic(3)).otherwise(_topic(1))),
            "receiver": word_address(F.when(token, word(data, 0)).otherwise(_topic(2))),
            "amount_raw": amount_of(F.when(token, word(data, 1)).otherwise(word(data, 0))),
            "local_asset": F.when(token, F.concat(F.lit("erc20:"), word_address(_topic(1)))).otherwise("native"),
            "remote_asset": F.when(token, F.concat(F.lit("erc20:"), word_address(_topic(2)))).otherwise("native"),
            "local_network": F.lit(network_id), "remote_network": F.col("remote_network_id"),
        }
    ).where(F.col("sender").isNotNull() & F.col("receiver").isNotNull() & (F.col("amount_raw") != "0"))
    from chainweft.operators.matching import bridge_correlation

    outbound = F.col("bridge_direction") == "outbound"
    columns = [
        "event_id", "tx_hash", "log_index", "event_type", "subject_id", "counterparty", "protocol",
        "protocol_contract", "bridge_direction", "amount_raw", "correlation_key", "confidence",
    ]
    bridges = bridge_correlation(parts).select(
        stable_id(F.col("tx_hash"), F.col("log_index"), F.lit("bridge_transfer"), F.col("address")).alias("event_id"),
        "tx_hash", "log_index", F.lit("bridge_transfer").alias("event_type"),
        F.when(outbound, F.col("sender")).otherwise(F.col("receiver")).alias("subject_id"),
        F.when(outbound, F.col("receiver")).otherwise(F.col("sender")).alias("counterparty"), "protocol",
        F.col("address").alias("protocol_contract"), "bridge_direction", "amount_raw", "correlation_key",
        F.lit(0.98).alias("confidence"),
    )
    mixer = abi_proof(logs).where(F.col("abi_valid") & F.col("operation").startswith("mixer_")).join(
        rules.where((F.col("decoder") == "tornado_cash_v1") & (F.col("protocol_type") == "mixer")), "address"
    ).join(txs.select("tx_hash", F.col("from_address").alias("initiator")), "tx_hash")
    deposit = F.col("operation") == "mixer_deposit"
    mixers = mixer.select(
        stable_id(F.col("tx_hash"), F.col("log_index"), F.col("operation"), F.col("address")).alias("event_id"),
        "tx_hash", "log_index", F.col("operation").alias("event_type"),
        F.when(deposit, F.col("initiator")).otherwise(word_address(word(data, 0))).alias("subject_id"),
        F.col("address").alias("counterparty"), "protocol", F.col("address").alias("protocol_contract"),
        F.lit("").alias("bridge_direction"), F.lit("").alias("amount_raw"),
        stable_id(F.when(deposit, _topic(1)).otherwise(word(data, 1))).alias("correlation_key"),
        F.lit(0.99).alias("confidence"),
    )
    return bridges.select(*columns).unionByName(mixers.select(*columns))


# Decoders that read a standard receipt: decoder -> receipt names.
STANDARD = {
    "amm_v2": ("amm_v2_swap", "amm_v2_mint", "amm_v2_burn"),
    "amm_v3": ("amm_v3_swap", "amm_v3_mint", "amm_v3_burn"),
    "aggregator": (
        "amm_v2_swap", "amm_v3_swap", "curve_int128_swap", "balancer_v2_swap", "amm_v2_mint", "amm_v2_burn",
        "amm_v3_mint", "amm_v3_burn",
    ),
}
# Event by flow direction when nothing else was seen, and its quality.
FALLBACK = {
    "bridge_generic": ("bridge_deposit", "bridge_withdrawal", 0.74),
    "lending_generic": ("lending_supply", "lending_withdrawal", 0.72),
    "staking_generic": ("staking_deposit", "staking_withdrawal", 0.72),
    "mixer_generic": ("mixer_deposit", "mixer_withdrawal", 0.72),
}
# Decoders and event prefixes allowed per protocol type.
ALLOWED = {
    "dex": (("amm_v2", "amm_v3", "aggregator"), "^(swap$|liquidity_)"),
    "bridge": (("bridge_generic",), "^bridge_"),
    "lending": (("lending_generic",), "^lending_"),
    "staking": (("staking_generic",), "^staking_"),
    "mixer": (("tornado_cash_v1", "mixer_generic"), "^mixer_"),
    "scam": (("reviewed_interaction",), "^scam_interaction$"),
    "system": (("chain_system",), "^chain_system_transaction$"),
}


def _matches(pattern: str):
    return lambda value: value.rlike(pattern)


def registry_errors(registry: DataFrame) -> DataFrame:
    """Registry rows whose decoder or mapped events do not fit their protocol type."""
    fits_decoder, fits_events = F.lit(False), F.lit(False)
    events = F.concat("method_event_types", "event_types")
    for kind, (decoders, pattern) in ALLOWED.items():
        here = F.col("protocol_type") == kind
        fits_decoder = F.when(here, F.col("decoder").isin(*decoders)).otherwise(fits_decoder)
        fits_events = F.when(here, F.forall(events, _matches(pattern))).otherwise(fits_events)
    reasons = F.array_compact(
        F.array(F.when(~fits_decoder, F.lit("incompatible_decoder")), F.when(~fits_events, F.lit("incompatible_event")))
    )
    return registry.select("registry_id", F.explode(reasons).alias("reason"))


def _indexed(rules: DataFrame, values: str, kinds: str, name: str) -> DataFrame:
    """(contract, ``name``) to event type, one row for each value a rule names, its first place winning."""
    places = rules.select("contract", kinds, F.posexplode(values).alias("place", name))
    return places.groupBy("contract", name).agg(F.min_by(F.get(kinds, F.col("place")), "place").alias("event_type"))


def registry_events(txs: DataFrame, logs: DataFrame, edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Events by reviewed rule: method, log topic, standard receipt, then flow direction.

    ``registry``: contract, protocol, protocol_type, decoder, method_ids,
    method_event_types, event_topics, event_types.  Failed transactions emit
    nothing.  Within a transaction and contract an event is taken once, from the
    strongest source.

    Rules are an inverted index: a call looks up (contract, selector), a log
    (address, first topic), a receipt (transaction, receipt name), so logs of a
    transaction never meet contracts that have no rule for them.
    """
    ok = txs.where(F.col("status") == 1)
    rules = registry.withColumn("contract", F.lower("contract"))
    deciding = rules.select("contract", "protocol_type", "decoder")
    seen = materialise(
        receipts(logs).join(ok.select("tx_hash"), "tx_hash", "left_semi").select(
            "tx_hash", "log_index", F.col("address").alias("contract"), _topic(0).alias("topic0"), "abi", "operation", "abi_valid"
        ),
        "registry-logs",
    )
    heads = ok.select("tx_hash", "from_address", "to_address", "transaction_index", F.substring("input_data", 1, 10).alias("selector"))
    base = materialise(
        heads.where(F.coalesce("to_address", F.lit("")) != "").select("tx_hash", F.col("to_address").alias("contract"))
        .unionByName(seen.select("tx_hash", "contract"))
        .distinct()
        .join(deciding, "contract")
        .unionByName(
            heads.select("tx_hash", F.col("from_address").alias("contract")).join(
                deciding.where(F.col("protocol_type") == "system"), "contract"
            )
        )
        .dropDuplicates(["tx_hash", "contract"])
        .join(heads.select("tx_hash", "transaction_index"), "tx_hash"),
        "registry-base",
    )
    columns = ["tx_hash", "contract", "event_type", "emitter", "event_index", "from_log", "source", "confidence", "priority"]

    def out(df: DataFrame, kind: Column, emitter: str, index: str, from_log: bool, source: str,
            confidence: Column, priority: int) -> DataFrame:
        return df.select(
            "tx_hash", "contract", kind.alias("event_type"), F.col(emitter).alias("emitter"),
            F.col(index).cast("bigint").alias("event_index"), F.lit(from_log).alias("from_log"),
            F.lit(source).alias("source"), confidence.cast("double").alias("confidence"), F.lit(priority).alias("priority"),
        ).select(*columns)

    calls = heads.withColumn("contract", F.col("to_address")).join(
        _indexed(rules, "method_ids", "method_event_types", "selector"), ["contract", "selector"]
    )
    method = out(calls, F.col("event_type"), "contract", "transaction_index", False, "method", F.lit(0.88), 1)
    by_topic = _indexed(rules, "event_topics", "event_types", "topic").withColumn("topic0", F.regexp_replace(F.lower("topic"), "^0x", ""))
    readable = F.col("abi").isNull() | F.col("abi_valid")
    topic = out(
        seen.where(readable).join(by_topic, ["contract", "topic0"]),
        F.col("event_type"), "contract", "log_index", True, "event_topic", F.lit(0.98), 2,
    )
    flows = boundary_flows(edges, ok, base.select("tx_hash", "contract"))
    flow = materialise(
        flows.groupBy("tx_hash", "contract").agg(
            F.max((F.col("legs_in") > 0).cast("int")).alias("inward"), F.max((F.col("legs_out") > 0).cast("int")).alias("outward"),
            F.count("*").alias("assets"),
        ),
        "registry-flow",
    )
    both = (F.coalesce("inward", F.lit(0)) == 1) & (F.coalesce("outward", F.lit(0)) == 1)
    names = F.array().cast("array<string>")
    for decoder, named in STANDARD.items():
        names = F.when(F.col("decoder") == decoder, F.array(*map(F.lit, named))).otherwise(names)
    proven = seen.where("abi_valid").select("tx_hash", "abi", "operation", "log_index", F.col("contract").alias("emitter"))
    standard = out(
        base.select("tx_hash", "contract", F.explode(names).alias("abi")).join(proven, ["tx_hash", "abi"])
        .join(flow, ["tx_hash", "contract"], "left"),
        F.col("operation"), "emitter", "log_index", True, "standard_topic", F.when(both, 0.98).otherwise(0.90), 3,
    )
    mixer = out(
        seen.where(F.col("abi_valid") & F.col("operation").startswith("mixer_")).join(
            deciding.where(F.col("decoder") == "tornado_cash_v1").select("contract"), "contract"
        ),
        F.col("operation"), "contract", "log_index", True, "standard_topic", F.lit(0.99), 3,
    )
    fixed_kind = F.when(F.col("decoder") == "reviewed_interaction", "scam_interaction").when(
        F.col("decoder") == "chain_system", "chain_system_transaction"
    )
    fixed = out(
        base.where(fixed_kind.isNotNull()), fixed_kind, "contract", "transaction_index", False,
        "interaction", F.lit(1.0), 3,
    )
    direct = materialise(method.unionByName(topic).unionByName(standard).unionByName(mixer).unionByName(fixed), "registry-direct")
    silent = base.join(direct.select("tx_hash", "contract").distinct(), ["tx_hash", "contract"], "left_anti").join(
        flow, ["tx_hash", "contract"]
    )
    kind, quality = F.lit(None).cast("string"), F.lit(None).cast("double")
    for decoder, (inbound, outbound, value) in FALLBACK.items():
        here = F.col("decoder") == decoder
        named = F.when(F.col("inward") == 1, inbound).when(F.col("outward") == 1, outbound)
        kind, quality = F.when(here, named).otherwise(kind), F.when(here, value).otherwise(quality)
    routed = (F.col("decoder") == "aggregator") & both & (F.col("assets") >= 2)
    kind, quality = F.when(routed, "swap").otherwise(kind), F.when(routed, 0.76).otherwise(quality)
    fallback = out(silent.where(kind.isNotNull()), kind, "contract", "transaction_index", False, "fund_flow", quality, 4)
    keys = ["tx_hash", "contract", "event_type", "emitter", "event_index", "from_log"]
    best = direct.unionByName(fallback).groupBy(*keys).agg(
        F.min_by(F.struct("source", "confidence"), "priority").alias("b")
    )
    return best.select(
        stable_id(*[F.col(k) for k in keys]).alias("event_id"), *keys, "b.source", "b.confidence"
    )


# contract classification -----------------------------------------------------

# Call selectors and what they say - (protocol, category, operation, confidence).
SELECTORS = {
    **{s: ("Generic DEX", "dex", "swap", 0.84) for s in (
        "38ed1739", "7ff36ab5", "18cbafe5", "8803dbee", "fb3bdb41", "4a25d94a", "5c11d795",
        "414bf389", "c04b8d59", "db3e2198", "f28c0498")},
    **{s: ("Generic DEX", "dex", "liquidity_add", 0.80) for s in ("e8e33700", "f305d719")},
    **{s: ("Generic DEX", "dex", "liquidity_remove", 0.80) for s in ("baa2abde", "02751cec", "2195995c", "af2979eb")},
    "a0712d68": ("Generic Lending", "lending", "supply", 0.86),
    "c5ebeaec": ("Generic Lending", "lending", "borrow", 0.86),
    "db006a75": ("Generic Lending", "lending", "redeem", 0.86),
    "852a12e3": ("Generic Lending", "lending", "redeem_underlying", 0.86),
    "0e752702": ("Generic Lending", "lending", "repay", 0.86),
    "4e4d9fea": ("Generic Lending", "lending", "repay", 0.86),
    "f5e3c462": ("Generic Lending", "lending", "liquidate", 0.86),
    "c2998238": ("Generic Lending", "lending", "enter_market", 0.86),
    "ede4edd0": ("Generic Lending", "lending", "exit_market", 0.86),
    "a694fc3a": ("Generic Staking", "staking", "stake", 0.78),
    "2e17de78": ("Generic Staking", "staking", "unstake", 0.78),
    "a9059cbb": ("Generic TRC20", "token", "transfer", 0.72),
    "40c10f19": ("Generic TRC20", "token", "mint", 0.72),
    "1249c58b": ("Generic TRC20", "token", "mint", 0.72),
    "42966c68": ("Generic TRC20", "token", "burn", 0.72),
    "79cc6790": ("Generic TRC20", "token", "burn_from", 0.72),
    "42842e0e": ("Generic NFT", "nft", "nft_transfer", 0.82),
    "b88d4fde": ("Generic NFT", "nft", "nft_transfer", 0.82),
    "f242432a": ("Generic NFT", "nft", "nft_transfer", 0.82),
    "2eb2c2d6": ("Generic NFT", "nft", "nft_batch_transfer", 0.82),
    "a22cb465": ("Generic NFT", "nft", "nft_approval", 0.82),
    "6352211e": ("Generic NFT", "nft", "nft_owner_query", 0.82),
    "c87b56dd": ("Generic NFT", "nft", "nft_metadata_query", 0.82),
}
# Native contract types - (category, operation), confidence 0.99.
NATIVE_TYPES = {
    "FreezeBalanceContract": ("staking", "stake"), "FreezeBalanceV2Contract": ("staking", "stake"),
    "UnfreezeBalanceContract": ("staking", "unstake"), "UnfreezeBalanceV2Contract": ("staking", "unstake"),
    "WithdrawExpireUnfreezeContract": ("staking", "withdraw"), "WithdrawBalanceContract": ("staking", "withdraw"),
    "DelegateResourceContract": ("staking", "delegate_resource"),
    "UnDelegateResourceContract": ("staking", "undelegate_resource"), "VoteWitnessContract": ("staking", "vote"),
    "TransferAssetContract": ("token", "transfer"), "AssetIssueContract": ("token", "issue"),
    "ParticipateAssetIssueContract": ("token", "participate_issue"), "UpdateAssetContract": ("token", "update"),
    "UnfreezeAssetContract": ("token", "unfreeze"), "AccountCreateContract": ("wallet", "account_create"),
    "AccountUpdateContract": ("wallet", "account_update"),
    "AccountPermissionUpdateContract": ("wallet", "permission_update"), "SetAccountIdContract": ("wallet", "account_id_update"),
}
# Priority per source, highest wins.
PRIORITY = {"registry": 100, "native_contract_type": 90, "method_signature": 80, "flow_analysis": 70,
            "nft_event": 65, "token_event": 60}


def classification_candidates(txs: DataFrame, registry: DataFrame, net: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything that says what a transaction's contract is, one row per statement.

    ``txs``: tx_hash, contract_address, to_address, contract_type, input_data;
    ``registry``: contract, protocol, protocol_type, confidence.
    """
    selector = F.lower(F.substring(F.regexp_replace(F.trim("input_data"), "^0[xX]", ""), 1, 8))

    def row(df: DataFrame, protocol: Column, category: Column, confidence: Column, source: str,
            operation: Column) -> DataFrame:
        return df.select(
            "tx_hash", protocol.alias("protocol"), category.alias("category"), confidence.cast("double").alias("confidence"),
            F.lit(source).alias("source"), operation.cast("string").alias("operation"), F.lit(PRIORITY[source]).alias("priority"),
        )

    none = F.lit(None)
    known = registry.select("contract", "protocol", "protocol_type", F.col("confidence").alias("c"))
    at_contract = txs.join(known, txs["contract_address"] == known["contract"])
    at_target = txs.join(known, txs["to_address"] == known["contract"]).join(
        at_contract.select("tx_hash"), "tx_hash", "left_anti"
    )
    cols = ["tx_hash", "protocol", "protocol_type", "c"]
    reg = at_contract.select(*cols).unionByName(at_target.select(*cols))
    native = F.create_map(*[x for k, v in NATIVE_TYPES.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    methods = F.create_map(*[
        x for k, v in SELECTORS.items()
        for x in (F.lit(k), F.struct(F.lit(v[0]).alias("p"), F.lit(v[1]).alias("c"), F.lit(v[2]).alias("o"), F.lit(v[3]).alias("q")))
    ])
    typed = txs.withColumn("n", F.try_element_at(native, F.trim("contract_type"))).where(F.col("n").isNotNull())
    called = txs.withColumn("m", F.try_element_at(methods, selector)).where(F.col("m").isNotNull())
    # flow: some address sent one asset and received another, and has two assets
    both = net.groupBy("tx_hash", "address").agg(
        F.count_if(F.col("sign") < 0).alias("d"), F.count_if(F.col("sign") > 0).alias("u"), F.count("*").alias("n")
    ).where((F.col("d") >= 1) & (F.col("u") >= 1) & (F.col("n") >= 2)).select("tx_hash").distinct()
    several = edges.groupBy("tx_hash").agg(F.count("*").alias("n"), F.max(F.col("token_id").isNotNull().cast("int")).alias("nft"),
                                           F.max(F.col("token_id").isNull().cast("int")).alias("ft"))
    flow = both.join(several.where(F.col("n") >= 2), "tx_hash")
    return (
        row(reg, F.col("protocol"), F.col("protocol_type"), F.col("c"), "registry", none)
        .unionByName(row(typed, F.lit("Native"), F.col("n")[0], F.lit(0.99), "native_contract_type", F.col("n")[1]))
        .unionByName(row(called, F.col("m.p"), F.col("m.c"), F.col("m.q"), "method_signature", F.col("m.o")))
        .unionByName(row(flow, F.lit("Flow-based DEX candidate"), F.lit("dex"), F.lit(0.55), "flow_analysis", F.lit("swap")))
        .unionByName(row(several.where(F.col("nft") == 1), F.lit("NFT standard"), F.lit("nft"), F.lit(0.97), "nft_event", F.lit("nft_transfer")))
        .unionByName(row(several.where(F.col("ft") == 1), F.lit("Token standard"), F.lit("token"), F.lit(0.96), "token_event", F.lit("transfer")))
    )


def classify(candidates: DataFrame) -> DataFrame:
    """Winner by priority then confidence; agreeing statements raise the confidence.

    The rest of an agreeing category multiplies what remains uncertain.  A
    transaction has at most one statement per source, so lists stay short.
    """
    one = F.struct("priority", "confidence", "protocol", "category", "operation", "source")
    per = candidates.groupBy("tx_hash").agg(F.reverse(F.array_sort(F.collect_list(one))).alias("all"))
    win = F.col("all")[0]
    agreeing = F.filter("all", lambda c: c["category"] == win["category"])
    left = F.aggregate(
        agreeing, F.lit(1.0), lambda acc, c: acc * (F.lit(1.0) - F.least(F.greatest(c["confidence"], F.lit(0.0)), F.lit(1.0)))
    )
    named = F.transform(
        "all", lambda c: F.when(c["category"] == win["category"], c["source"]).otherwise(F.concat(F.lit("conflict_"), c["source"]))
    )
    by_method = F.get(F.filter("all", lambda c: c["source"] == "method_signature"), 0)["operation"]
    return per.select(
        "tx_hash", win["protocol"].alias("protocol"), win["category"].alias("category"), (F.lit(1.0) - left).alias("confidence"),
        F.array_join(F.array_distinct(named), "+").alias("detection_source"),
        F.coalesce(win["operation"], by_method).alias("operation"),
    )


def display_events(events: DataFrame, n: int) -> DataFrame:
    """Events worth showing, by category, newest first, ``n`` per subject."""
    kind = F.col("event_type")
    category = (
        F.when(kind.startswith("mixer_"), "mixer")
        .when((kind == "swap") | kind.rlike("^(liquidity|lending|staking|bridge)_"), "defi")
    )
    shown = events.withColumn("category", category).where(F.col("category").isNotNull())
    return top_per_group(shown, ["subject_id"], [F.desc("block_timestamp_unix_ms"), F.col("event_id")], n)


def nft_legs(edges: DataFrame, n: int) -> DataFrame:
    """NFT transfers of every wallet, newest first, ``n`` per wallet."""
    from chainweft.operators.scope import wallet_edges

    rows = wallet_edges(edges.where(F.col("token_id").isNotNull()))
    return top_per_group(
        rows, ["wallet"],
        [F.desc("block_number"), F.desc("transaction_index"), F.desc("event_index"), F.col("relationship_id")], n,
    )

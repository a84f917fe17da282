"""Pattern detectors per transaction, run over all transactions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions import wide
from chainweft.functions.chains import places
from chainweft.functions.ids import ZERO_ADDRESS
from chainweft.session import materialise

# Thresholds and confidence of the unspent-output patterns.
CONSOLIDATION = ("utxo_consolidation_candidate", 0.60)
FAN_OUT = ("utxo_fan_out_candidate", 0.60)
COINJOIN = ("utxo_possible_coinjoin", 0.35)
PEEL_STEP = ("utxo_peel_step_candidate", 0.45)
PEEL_CHAIN = ("utxo_peel_chain_candidate", 0.50)
MAX_CHAIN = 5


def _event(df: DataFrame, kind: tuple[str, float]) -> DataFrame:
    return df.withColumn("event_type", F.lit(kind[0])).withColumn("confidence", F.lit(kind[1]))


def consolidation(shape: DataFrame) -> DataFrame:
    """At least five inputs into one positive output.  ``shape``: clusters.tx_shape."""
    hit = shape.where((F.col("coinbase") == 0) & (F.col("inputs") >= 5) & (F.col("positive_outputs") == 1))
    return _event(hit.select("tx_hash", "inputs"), CONSOLIDATION)


def fan_out(shape: DataFrame) -> DataFrame:
    """One or two inputs into at least five positive outputs of three subjects."""
    hit = shape.where(
        (F.col("coinbase") == 0) & F.col("inputs").between(1, 2) & (F.col("positive_outputs") >= 5)
        & (F.col("output_subjects") >= 3)
    )
    return _event(hit.select("tx_hash", "inputs", "positive_outputs"), FAN_OUT)


def coinjoin(shape: DataFrame, outputs: DataFrame) -> DataFrame:
    """Three input subjects and one value paid to three addresses; the widest value wins."""
    joint = shape.where((F.col("coinbase") == 0) & (F.col("input_subjects") >= 3)).select("tx_hash")
    owners = outputs.where((F.col("value_sats") > 0) & F.col("address").isNotNull()).select(
        "tx_hash", "value_sats", "address"
    ).distinct()
    per_value = owners.groupBy("tx_hash", "value_sats").agg(F.count("*").alias("addresses")).where(
        F.col("addresses") >= 3
    )
    top = per_value.join(joint, "tx_hash", "left_semi").groupBy("tx_hash").agg(
        F.max(F.struct("addresses", "value_sats")).alias("t")
    )
    return _event(
        top.select("tx_hash", F.col("t.value_sats").alias("equal_output_sats"), F.col("t.addresses").alias("equal_addresses")),
        COINJOIN,
    )


def peel_steps(shape: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One input into a large and a small output, at least four to one.

    Equal values keep the later output, and the large one must be below the input.
    """
    open_tx = shape.where(
        (F.col("coinbase") == 0) & (F.col("inputs") == 1) & (F.col("positive_outputs") == 2)
    ).select("tx_hash")
    paid = outputs.where(F.col("value_sats") > 0).join(open_tx, "tx_hash", "left_semi")
    here = F.struct(F.col("value_sats").alias("v"), F.col("output_index").alias("i"))
    pair = paid.groupBy("tx_hash").agg(F.max(here).alias("large"), F.min(here).alias("small"))
    spent = inputs.select("tx_hash", F.col("value_sats").alias("input_sats"), "prev_tx_hash", "prev_output_index")
    rows = pair.join(spent, "tx_hash")
    ratio = F.call_function("div", F.col("large.v"), F.col("small.v"))
    hit = rows.where((ratio >= 4) & (F.col("large.v") < F.col("input_sats"))).select(
        "tx_hash", F.col("large.i").alias("largest_output_index"), F.col("large.v").alias("largest_sats"),
        "input_sats", "prev_tx_hash", "prev_output_index",
    )
    return _event(hit, PEEL_STEP)


def peel_chains(steps: DataFrame, length: int = MAX_CHAIN, back: int = 2, least: int = 3) -> DataFrame:
    """Steps linked through the spent larger output: ``least`` to ``length`` of them around each anchor.

    A chain begins at most ``back`` steps before its anchor.  A step has one
    input and one larger output, so links form lines: each step gets its line
    and its place on it (see ``places``), and every anchor collects the few
    places of its window in one aggregate, whatever the length.
    """
    own = steps.select(F.col("tx_hash").alias("node"), "prev_tx_hash", "prev_output_index", "largest_output_index")
    links = own.select(F.col("node").alias("child"), "prev_tx_hash", "prev_output_index").join(
        own.select(F.col("node").alias("parent"), F.col("node").alias("prev_tx_hash"), F.col("largest_output_index").alias("prev_output_index")),
        ["prev_tx_hash", "prev_output_index"],
    ).select("child", "parent")
    placed = places(own, materialise(links, "peel-links"))
    place = F.col("place")
    # anchors whose window holds this place: the window begins at max(anchor - back, 0)
    anchors = F.sequence(F.greatest(place - (length - 1 - back), F.lit(0)), place + back)
    near = placed.select("root", "node", "place", F.explode(anchors).alias("anchor_place")).where(
        (place >= F.greatest(F.col("anchor_place") - back, F.lit(0))) & (place < F.greatest(F.col("anchor_place") - back, F.lit(0)) + length)
    ).unionByName(
        # the first anchors' windows are not moved back in full
        placed.select("root", "node", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(back - 1).cast("long"))).alias("anchor_place")).where(
            (place < length) & (F.col("anchor_place") < place - (length - 1 - back))
        )
    )
    chains = near.groupBy("root", "anchor_place").agg(
        F.array_sort(F.collect_list(F.struct("place", "node"))).alias("c"),
        F.max(F.when(place == F.col("anchor_place"), F.col("node"))).alias("anchor"),
    ).where(F.col("anchor").isNotNull() & (F.size("c") >= least))
    hit = chains.select("anchor", F.transform("c", lambda x: x["node"]).alias("chain"), F.size("c").alias("steps"))
    return _event(hit, PEEL_CHAIN)


# account transactions --------------------------------------------------------


def _signs(net: DataFrame) -> DataFrame:
    """Per transaction and address: what went down, what came up (short asset lists)."""
    down, up = F.col("sign") < 0, F.col("sign") > 0
    return net.where(F.col("address") != ZERO_ADDRESS).groupBy("tx_hash", "address").agg(
        F.count_if(down).alias("sent"), F.count_if(up).alias("received"),
        F.min(F.when(down, F.col("asset_id"))).alias("sent_asset"),
        F.min(F.when(up, F.col("asset_id"))).alias("received_asset"),
    )


def swaps(net: DataFrame) -> DataFrame:
    """Exactly one asset down and another up."""
    hit = _signs(net).where((F.col("sent") == 1) & (F.col("received") == 1))
    return hit.select("tx_hash", F.col("address").alias("subject"), F.col("sent_asset").alias("asset_in"),
                      F.col("received_asset").alias("asset_out"))


def liquidity(net: DataFrame, edges: DataFrame) -> DataFrame:
    """Two or more assets against one pool token minted to the wallet or burned in the transaction."""
    signs = _signs(net)
    minted = edges.where(F.col("from_address") == ZERO_ADDRESS).select(
        "tx_hash", F.col("to_address").alias("address"), F.col("asset_id").alias("pool_asset")
    ).distinct()
    burned = edges.where(F.col("to_address") == ZERO_ADDRESS).select(
        "tx_hash", F.col("asset_id").alias("pool_asset")
    ).distinct()
    add = signs.where((F.col("sent") >= 2) & (F.col("received") == 1)).select(
        "tx_hash", "address", F.col("received_asset").alias("pool_asset")
    ).join(minted, ["tx_hash", "address", "pool_asset"], "left_semi")
    remove = signs.where((F.col("sent") == 1) & (F.col("received") >= 2)).select(
        "tx_hash", "address", F.col("sent_asset").alias("pool_asset")
    ).join(burned, ["tx_hash", "pool_asset"], "left_semi").select("tx_hash", "address", "pool_asset")
    return add.withColumn("event_type", F.lit("liquidity_add")).unionByName(
        remove.withColumn("event_type", F.lit("liquidity_remove"))
    ).withColumnRenamed("address", "subject")


def bridge_moves(edges: DataFrame, hints: DataFrame) -> DataFrame:
    """Mint to, or burn by, a wallet with matching net flow, only in hinted transactions.

    Edges of hinted transactions are dealt by transaction once; what a wallet
    moved of an asset and whether the zero address took part come from one fold.
    """
    told = edges.join(hints.select("tx_hash").distinct(), "tx_hash", "left_semi")
    zero = lambda c: (F.col(c) == ZERO_ADDRESS).cast("int").alias("zero")
    none = F.lit(None).cast("string")
    sides = F.array(
        F.struct(F.col("from_address").alias("subject"), none.alias("plus"), F.col("amount_raw").alias("minus"), zero("to_address")),
        F.struct(F.col("to_address").alias("subject"), F.col("amount_raw").alias("plus"), none.alias("minus"), zero("from_address")),
    )
    legs = told.where(F.col("from_address") != F.col("to_address")).select("tx_hash", "asset_id", F.inline(sides))
    moved = legs.where(F.col("subject") != ZERO_ADDRESS).groupBy("tx_hash", "subject", "asset_id").agg(
        wide.sign(wide.net(F.col("plus"), F.col("minus"))).alias("sign"),
        F.max(F.when(F.col("plus").isNotNull(), F.col("zero"))).alias("minted"),
        F.max(F.when(F.col("minus").isNotNull(), F.col("zero"))).alias("burned"),
    )
    into, out = (F.col("sign") > 0) & (F.col("minted") == 1), (F.col("sign") < 0) & (F.col("burned") == 1)
    return moved.where(into | out).select(
        "tx_hash", "subject", "asset_id", F.when(into, "bridge_in").otherwise("bridge_out").alias("event_type")
    )


def mint_burn(edges: DataFrame) -> DataFrame:
    """One event per transfer from (mint) or to (burn) the zero address."""
    mint, burn = F.col("from_address") == ZERO_ADDRESS, F.col("to_address") == ZERO_ADDRESS
    kinds = F.array_compact(
        F.array(
            F.when(mint, F.struct(F.lit("token_mint").alias("event_type"), F.col("to_address").alias("subject"))),
            F.when(burn, F.struct(F.lit("token_burn").alias("event_type"), F.col("from_address").alias("subject"))),
        )
    )
    return edges.where(mint | burn).select(
        "tx_hash", "relationship_id", "asset_id", "amount_raw", F.inline(kinds)
    )


def tx_features(events: DataFrame, txs: DataFrame, edges: DataFrame) -> DataFrame:
    """Flags, type and extent of every transaction that has events."""
    kind = F.col("event_type")
    has = lambda c: F.max(c.cast("int"))
    flags = events.groupBy("tx_hash").agg(
        has(kind == "swap").alias("is_swap"), has(kind.startswith("bridge_")).alias("is_bridge"),
        has(kind == "token_mint").alias("is_mint"), has(kind == "token_burn").alias("is_burn"),
        has(kind == "liquidity_add").alias("is_liquidity_add"), has(kind == "liquidity_remove").alias("is_liquidity_remove"),
        has(kind == "chain_system_transaction").alias("__system"), has(kind == "scam_interaction").alias("__scam"),
        has(kind.startswith("mixer_")).alias("__mixer"),
        has(kind.startswith("lending_") | kind.startswith("staking_") | kind.startswith("liquidity_") | (kind == "swap")).alias("__defi"),
        F.min("event_type").alias("transaction_subtype"), F.max("confidence").alias("classification_confidence"),
    )
    label = (
        F.when(F.col("__system") == 1, "system").when(F.col("__scam") == 1, "intelligence")
        .when(F.col("__mixer") == 1, "privacy").when(F.col("is_bridge") == 1, "bridge")
        .when(F.col("__defi") == 1, "defi").otherwise("token")
    )
    touched = edges.join(flags.select("tx_hash"), "tx_hash", "left_semi")
    assets = touched.select("tx_hash", "asset_id").distinct().groupBy("tx_hash").agg(F.count("*").alias("unique_assets"))
    people = touched.select("tx_hash", F.explode(F.array("from_address", "to_address")).alias("a")).where(
        F.col("a") != ZERO_ADDRESS
    ).distinct().groupBy("tx_hash").agg(F.count("*").alias("participants"))
    call = (F.coalesce("to_address", F.lit("")) != "") & ~F.col("input_data").isin("0x", "")
    calls = txs.select("tx_hash", call.cast("int").alias("is_contract_call"))
    return (
        flags.withColumn("transaction_type", label).drop("__system", "__scam", "__mixer", "__defi")
        .join(assets, "tx_hash", "left").join(people, "tx_hash", "left").join(calls, "tx_hash", "left")
        .fillna(0, ["unique_assets", "participants", "is_contract_call"])
    )


def transaction_type(df: DataFrame) -> DataFrame:
    """One type and subtype per transaction, strongest evidence first.

    Input flags: has_bridge, bridge_subtype, has_liquidity_add, has_liquidity_remove,
    has_swap, has_mint, has_burn, category, operation, base_confidence,
    is_contract_call, contract_type, has_token_transfer, has_native_transfer.
    """
    base, category = F.col("base_confidence"), F.col("category")
    on = lambda c: F.col(c) == 1
    method = lambda otherwise: F.coalesce("operation", F.lit(otherwise))
    least = lambda floor: F.greatest(base, F.lit(floor))
    swap = on("has_swap") & ~on("has_liquidity_add") & ~on("has_liquidity_remove")
    # Order of the rules, names and least confidence.
    rules: list[tuple[Column, str, Column, Column]] = [
        (on("has_bridge") | (category == "bridge"), "bridge", F.coalesce("bridge_subtype", F.lit("bridge_transfer")), least(0.88)),
        (on("has_liquidity_add"), "liquidity", F.lit("add"), least(0.82)),
        (on("has_liquidity_remove"), "liquidity", F.lit("remove"), least(0.82)),
        (swap, "swap", F.lit("token_swap"), least(0.78)),
        (on("has_mint") & on("has_burn"), "token_lifecycle", F.lit("mint_and_burn"), F.lit(0.85)),
        (on("has_mint"), "mint", F.lit("token_mint"), F.lit(0.82)),
        (on("has_burn"), "burn", F.lit("token_burn"), F.lit(0.82)),
        (category == "lending", "lending", method("contract_call"), least(0.70)),
        (category == "staking", "staking", method("contract_call"), least(0.70)),
        (category == "mixer", "mixer_interaction", method("labeled_counterparty"), least(0.80)),
        (category == "scam", "scam_interaction", method("labeled_counterparty"), least(0.80)),
        (category == "nft", "nft_interaction", method("contract_call"), least(0.75)),
        (category == "dex", "dex_interaction", method("contract_call"), least(0.70)),
        (category == "token", "token_interaction", method("contract_call"), least(0.70)),
        (category == "wallet", "wallet_interaction", method("labeled_counterparty"), least(0.70)),
        (on("is_contract_call"), "contract_call", F.col("contract_type"), least(0.50)),
        (on("has_token_transfer"), "token_transfer", F.lit("trc20_transfer"), F.lit(0.95)),
        (on("has_native_transfer"), "native_transfer", F.lit("trx_transfer"), F.lit(0.95)),
    ]
    name, subtype, confidence = F.lit("unknown"), F.col("contract_type"), base
    for fits, kind, sub, value in reversed(rules):
        fits = F.coalesce(fits, F.lit(False))
        name = F.when(fits, kind).otherwise(name)
        subtype = F.when(fits, sub).otherwise(subtype)
        confidence = F.when(fits, value).otherwise(confidence)
    return df.withColumns(
        {"transaction_type": name, "transaction_subtype": subtype, "confidence": confidence}
    )



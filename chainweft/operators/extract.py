"""Transfers out of evidence tables: logs, transactions, traces and withdrawals.

All decoding is column arithmetic on hex text; amounts leave as decimal
strings.  ``logs``: tx_hash, log_index, address, topics (array), data.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions import wide
from chainweft.functions.ids import (
    BITCOIN_ADDRESS, DECIMAL_AMOUNT, EVM_ADDRESS, EVM_HASH, PLAIN_HASH, TRON_ADDRESS, ZERO_ADDRESS,
    small_word, stable_id, unprefixed, word, word_address, word_count,
)

# Event signatures of the token standards (first topic).
TRANSFER = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRANSFER_SINGLE = "c3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
TRANSFER_BATCH = "4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"
ORDER_FULFILLED = "9d9af8e38d66c62e2c12f0225249fd9d721c54b83f48d9352c97c6cacdcb6f31"


def amount_of(hex_word: Column) -> Column:
    """A word as decimal text; short values take the 60-bit shortcut."""
    return F.coalesce(
        small_word(hex_word).cast("string"),
        F.when(hex_word.rlike("^[0-9a-f]{64}$"), wide.from_hex(hex_word)),
    )


def normal_logs(logs: DataFrame) -> DataFrame:
    """Logs with lower-case, unprefixed topics and data."""
    return logs.withColumns(
        {
            "topics": F.transform("topics", lambda t: F.regexp_replace(F.lower(t), "^0x", "")),
            "data": unprefixed(F.coalesce("data", F.lit(""))),
            "address": F.lower("address"),
        }
    )


def _topic(i: int) -> Column:
    return F.get(F.col("topics"), i)


def token_transfers(logs: DataFrame) -> DataFrame:
    """Fungible (3 topics, one data word) and single-item (4 topics, no data) transfers."""
    own = normal_logs(logs).where(_topic(0) == TRANSFER)
    fungible = (F.size("topics") == 3) & (F.length("data") == 64)
    single = (F.size("topics") == 4) & (F.col("data") == "")
    out = own.where(fungible | single).select(
        "tx_hash", "log_index", F.col("address").alias("contract"),
        word_address(_topic(1)).alias("from_address"), word_address(_topic(2)).alias("to_address"),
        F.when(fungible, amount_of(F.col("data"))).otherwise("1").alias("amount_raw"),
        F.when(single, amount_of(_topic(3))).alias("token_id"),
        F.when(fungible, "erc20").otherwise("erc721").alias("standard"),
        F.lit(0).alias("event_sub_index"),
    )
    return out.where(F.col("from_address").isNotNull() & F.col("to_address").isNotNull())


def _words(data: Column, start: Column, count: Column) -> Column:
    """``count`` words from word index ``start``; empty when there are none."""
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: word(data, start + i))


def _exploded(df: DataFrame, items: Column, keep: list[str], names: tuple[str, str]) -> DataFrame:
    """``posexplode`` that keeps the decoding steps apart.

    Filtering on a decoded column would make the optimizer substitute every
    step into the filter; filtering on the generator's output cannot.
    """
    position, item = names
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return rows.where(F.col(item).isNotNull())


def erc1155_transfers(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transfers, rejects) of single and batch multi-token logs.

    A batch is two dynamic arrays: offsets, lengths and words are read in
    steps, each from the columns of the step before.
    """
    data = F.col("data")
    own = normal_logs(logs).where(_topic(0).isin(TRANSFER_SINGLE, TRANSFER_BATCH)).select(
        "tx_hash", "log_index", F.col("address").alias("contract"), "data", (_topic(0) == TRANSFER_BATCH).alias("batch"),
        F.size("topics").alias("topic_count"), word_address(_topic(2)).alias("from_address"),
        word_address(_topic(3)).alias("to_address"), word_count(data).alias("w"),
    )
    step = own.withColumns({"o1": small_word(word(data, 0)), "o2": small_word(word(data, 1))})
    step = step.withColumns(
        {f"h{k}": F.when(F.col("batch") & (F.col(f"o{k}") % 32 == 0) & (F.col(f"o{k}") / 32 < F.col("w")),
                         (F.col(f"o{k}") / 32).cast("int")) for k in (1, 2)}
    )
    step = step.withColumns({f"n{k}": small_word(word(data, F.col(f"h{k}"))) for k in (1, 2)})
    whole = (
        (F.col("n1") == F.col("n2")) & (F.col("n1") <= F.col("w") - F.col("h1") - 1)
        & (F.col("n2") <= F.col("w") - F.col("h2") - 1)
    )
    ends = (F.col("topic_count") == 4) & F.col("from_address").isNotNull() & F.col("to_address").isNotNull()
    good = F.coalesce(ends & F.when(F.col("batch"), whole).otherwise(F.length("data") == 128), F.lit(False))
    step = step.withColumn("good", good)
    n = F.when(F.col("batch") & F.col("good"), F.col("n1").cast("int")).otherwise(0)
    step = step.withColumns({"ids": _words(data, F.col("h1") + 1, n), "vals": _words(data, F.col("h2") + 1, n)})
    single = F.array(F.struct(word(data, 0).alias("id"), word(data, 1).alias("value")))
    pairs = F.when(
        F.col("good"),
        F.when(F.col("batch"), F.arrays_zip(F.col("ids").alias("id"), F.col("vals").alias("value"))).otherwise(single),
    )
    rows = _exploded(step, pairs, ["tx_hash", "log_index", "contract", "from_address", "to_address"], ("event_sub_index", "p"))
    transfers = rows.select(
        "tx_hash", "log_index", "contract", "from_address", "to_address",
        amount_of(F.col("p")["value"]).alias("amount_raw"), amount_of(F.col("p")["id"]).alias("token_id"),
        F.lit("erc1155").alias("standard"), "event_sub_index",
    )
    reason = F.when(~F.col("good"), F.array(F.lit("malformed_multi_token_log")))
    rejects = _exploded(step, reason, ["tx_hash", "log_index"], ("i", "reason")).drop("i")
    return transfers, rejects


def transfer_kind(transfers: DataFrame) -> DataFrame:
    """Name by standard; mint when sent by the zero address, burn when sent to it."""
    kind = (
        F.when(F.col("from_address") == ZERO_ADDRESS, F.concat("standard", F.lit("_mint")))
        .when(F.col("to_address") == ZERO_ADDRESS, F.concat("standard", F.lit("_burn")))
        .otherwise(F.concat("standard", F.lit("_transfer")))
    )
    return transfers.withColumn("transfer_kind", kind)


def native_transfers(txs: DataFrame, native_asset: str) -> DataFrame:
    """Successful transactions that move native value; with call data it is call value.

    ``txs``: tx_hash, from_address, to_address, contract_address, value_raw,
    status, input_data.  A deployment pays the created contract.
    """
    target = F.coalesce("to_address", "contract_address")
    call = (F.coalesce("input_data", F.lit("")) != "") & (F.col("input_data") != "0x")
    return txs.where(
        (F.col("status") == 1) & (F.col("value_raw") != "0") & target.isNotNull()
    ).select(
        "tx_hash", "from_address", target.alias("to_address"), F.lit(native_asset).alias("asset_id"),
        F.col("value_raw").alias("amount_raw"),
        F.when(call, "contract_call_value").otherwise("native_transfer").alias("transfer_type"),
    )


# Contract types of the account-model network that move value.
VALUE_CONTRACTS = {
    "TransferContract": "native_transfer",
    "TransferAssetContract": "trc10_transfer",
    "TriggerSmartContract": "contract_call_value",
}


def contract_transfers(txs: DataFrame) -> DataFrame:
    """Value transfers stated by typed contracts in a JSON column ``contracts_json``."""
    schema = (
        "array<struct<type:string,owner:string,to:string,contract:string,asset:string,amount:string,call_value:string>>"
    )
    one = txs.where(F.col("status") == 1).select(
        "tx_hash", F.posexplode(F.from_json("contracts_json", schema)).alias("event_index", "c")
    )
    names = F.create_map(*[F.lit(v) for kv in VALUE_CONTRACTS.items() for v in kv])
    kind = F.try_element_at(names, F.col("c.type"))
    amount = F.coalesce("c.amount", "c.call_value")
    return one.where(kind.isNotNull() & amount.rlike(DECIMAL_AMOUNT) & (amount != "0")).select(
        "tx_hash", "event_index", F.col("c.owner").alias("from_address"),
        F.coalesce("c.to", "c.contract").alias("to_address"),
        F.when(F.col("c.type") == "TransferAssetContract", F.concat(F.lit("trc10:"), "c.asset"))
        .otherwise("native:TRX").alias("asset_id"),
        amount.alias("amount_raw"), kind.alias("transfer_type"),
    )


# Frames that carry value.
VALUE_CALLS = ("CALL", "CREATE", "CREATE2", "SELFDESTRUCT")


def internal_transfers(traces: DataFrame, native_asset: str) -> DataFrame:
    """Value moved inside transactions; reverted frames and all below them are left out.

    ``traces``: tx_hash, trace_address (array, empty for the root), call_type,
    from_address, to_address, value_raw, error.  A frame is dropped when any
    prefix of its address, itself included, failed; depth bounds the prefixes.
    """
    key = lambda path: F.array_join(path.cast("array<string>"), ",")
    # below the root only: a failed root is a failed transaction
    failed = traces.where(F.col("error").isNotNull() & (F.size("trace_address") > 0)).select(
        "tx_hash", key(F.col("trace_address")).alias("prefix")
    ).distinct()
    moving = traces.where(
        (F.size("trace_address") > 0)
        & F.upper("call_type").isin(*VALUE_CALLS)
        & F.col("to_address").isNotNull() & F.col("value_raw").isNotNull()
        & (F.col("value_raw") != "0") & (F.col("from_address") != F.col("to_address"))
    )
    prefixes = moving.select(
        "tx_hash", F.col("trace_address"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("trace_address")),
                lambda n: key(F.slice("trace_address", F.lit(1), n)),
            )
        ).alias("prefix"),
    )
    reverted = prefixes.join(failed, ["tx_hash", "prefix"], "left_semi").select(
        "tx_hash", "trace_address"
    ).distinct()
    return moving.join(reverted, ["tx_hash", "trace_address"], "left_anti").select(
        "tx_hash", "trace_address", "from_address", "to_address", F.lit(native_asset).alias("asset_id"),
        F.col("value_raw").alias("amount_raw"), F.lit("native_internal").alias("transfer_type"),
    )


def block_credits(blocks: DataFrame, native_asset: str) -> DataFrame:
    """Validator withdrawals of a block, stated in gwei, as credits in base units."""
    schema = "array<struct<index:string,validatorIndex:string,address:string,amount:string>>"
    gwei = F.col("w.amount")
    raw = F.when(gwei == "0", F.lit("0")).otherwise(F.concat(gwei, F.repeat(F.lit("0"), F.lit(9))))
    return blocks.select(
        "block_number", F.posexplode(F.from_json("withdrawals_json", schema)).alias("position", "w")
    ).where(gwei.rlike(DECIMAL_AMOUNT)).select(
        "block_number", "position", F.lower("w.address").alias("to_address"),
        F.lit(native_asset).alias("asset_id"), raw.alias("amount_raw"),
    )


def utxo_totals(inputs: DataFrame, outputs: DataFrame, txs: DataFrame) -> DataFrame:
    """Sums and fee per transaction; ``conserved`` is false where outputs exceed inputs."""
    legs = inputs.select("tx_hash", F.col("value_sats").alias("i"), F.lit(None).cast("bigint").alias("o")).unionByName(
        outputs.select("tx_hash", F.lit(None).cast("bigint").alias("i"), F.col("value_sats").alias("o"))
    )
    sums = legs.groupBy("tx_hash").agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("input_sats"), F.coalesce(F.sum("o"), F.lit(0)).alias("output_sats"),
        F.count("i").alias("inputs"), F.count("o").alias("outputs"),
    )
    coinbase = F.col("coinbase") == 1
    return txs.select("tx_hash", "coinbase").join(sums, "tx_hash").select(
        "tx_hash", "coinbase", "inputs", "outputs", "input_sats", "output_sats",
        F.when(coinbase, 0).otherwise(F.col("input_sats") - F.col("output_sats")).alias("fee_sats"),
        (coinbase | (F.col("input_sats") >= F.col("output_sats"))).alias("conserved"),
    )


# Receipt shapes - (first topic, name, operation, topics, data words).
RECEIPT_SHAPES = [
    ("d78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822", "amm_v2_swap", "swap", 3, 4),
    ("c42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67", "amm_v3_swap", "swap", 3, 5),
    ("8b3e96f2b889fa771c53c981b40daf005f63f637f1869f707052d15a3dd97140", "curve_int128_swap", "swap", 2, 4),
    ("d013ca23e77a65003c2c659c5442c00c805371b7fc1ebd4c206c41d1536bd90b", "curve_int128_swap", "swap", 2, 4),
    ("2170c741c41531aec20e7c107c24eecfdd15e69c9bb0a8dd37b1840b9e0b207b", "balancer_v2_swap", "swap", 4, 2),
    ("4c209b5fc8ad50758f13e2e1088ba56a560dff690a1c6fef26394f4c03821c4f", "amm_v2_mint", "liquidity_add", 2, 2),
    ("dccd412f0b1252819cb1fd330b93224ca42612892bb3f4f789976e6d81936496", "amm_v2_burn", "liquidity_remove", 3, 2),
    ("7a53080ba414158be7ec69b987b5fb7d07dee101fe85488f0853ae16239d0bde", "amm_v3_mint", "liquidity_add", 4, 4),
    ("0c396cd989a39f4459b5fa1aed6a9a8dcdbc45908acfd67e028cd568da98982c", "amm_v3_burn", "liquidity_remove", 4, 3),
    ("a945e51eec50ab98c161376f0db4cf2aeba3ec92755fe2fcd388bdbbb80ff196", "tornado_deposit", "mixer_deposit", 2, 2),
    ("e9e508bad6d4c3227e881ca19068f099da81b5164dd6d62b2eaf1e8bc6c34931", "tornado_withdrawal", "mixer_withdrawal", 2, 3),
]
# Padding per shape - (place, index, significant digits, signed).
RECEIPT_PADDING = {
    "amm_v2_swap": [("topic", 1, 40, False), ("topic", 2, 40, False)],
    "amm_v2_burn": [("topic", 1, 40, False), ("topic", 2, 40, False)],
    "amm_v3_swap": [
        ("topic", 1, 40, False), ("topic", 2, 40, False), ("word", 2, 40, False), ("word", 3, 32, False),
        ("word", 4, 6, True),
    ],
    "curve_int128_swap": [("topic", 1, 40, False), ("word", 0, 32, True), ("word", 2, 32, True)],
    "balancer_v2_swap": [("topic", 2, 40, False), ("topic", 3, 40, False)],
    "amm_v2_mint": [("topic", 1, 40, False)],
    "amm_v3_mint": [
        ("topic", 1, 40, False), ("topic", 2, 6, True), ("topic", 3, 6, True), ("word", 0, 40, False),
        ("word", 1, 32, False),
    ],
    "amm_v3_burn": [
        ("topic", 1, 40, False), ("topic", 2, 6, True), ("topic", 3, 6, True), ("word", 0, 32, False),
    ],
    "tornado_deposit": [("word", 0, 8, False)],
    "tornado_withdrawal": [("topic", 1, 40, False), ("word", 0, 40, False)],
}


def _padded(value: Column, digits: int, signed: bool) -> Column:
    zeros = f"^0{{{64 - digits}}}"
    plain = value.rlike(zeros + ("[0-7]" if signed else ""))
    return (plain | value.rlike(f"^f{{{64 - digits}}}[89a-f]")) if signed else plain


def abi_proof(logs: DataFrame) -> DataFrame:
    """Known logs with their receipt name and whether topics, size and padding fit."""
    return receipts(logs).where(F.col("abi").isNotNull())


def receipts(logs: DataFrame) -> DataFrame:
    """All logs, normalised, with what ``abi_proof`` says of the known ones and nulls for the others."""
    own = normal_logs(logs)
    table = F.create_map(
        *[
            part
            for topic, name, operation, topics, words in RECEIPT_SHAPES
            for part in (
                F.lit(topic),
                F.struct(F.lit(name).alias("name"), F.lit(operation).alias("operation"),
                         F.lit(topics).alias("topics"), F.lit(words).alias("words")),
            )
        ]
    )
    rows = own.withColumn("shape", F.try_element_at(table, _topic(0)))
    size_ok = (
        (F.size("topics") == F.col("shape.topics"))
        & (F.length("data") == F.col("shape.words") * 64)
        & F.col("data").rlike("^[0-9a-f]*$")
        & F.forall("topics", lambda t: t.rlike("^[0-9a-f]{64}$"))
    )
    padding = F.lit(True)
    for name, places in RECEIPT_PADDING.items():
        ok = F.lit(True)
        for place, index, digits, signed in places:
            value = _topic(index) if place == "topic" else word(F.col("data"), index)
            ok = ok & _padded(value, digits, signed)
        padding = F.when(F.col("shape.name") == name, ok).otherwise(padding)
    valid = F.when(F.col("shape").isNotNull(), F.coalesce(size_ok & padding, F.lit(False)))
    return rows.withColumn("abi", F.col("shape.name")).withColumn("operation", F.col("shape.operation")).withColumn(
        "abi_valid", valid
    ).drop("shape")


def normalize_ids(df: DataFrame, columns: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects) after normalising id columns.

    ``columns`` maps a column to its format: evm_address, evm_hash, plain_hash,
    tron_address or bitcoin_address.  EVM ids and hashes become lower case.
    """
    formats = {
        "evm_address": EVM_ADDRESS, "evm_hash": EVM_HASH, "plain_hash": PLAIN_HASH,
        "tron_address": TRON_ADDRESS, "bitcoin_address": BITCOIN_ADDRESS,
    }
    lowered = {
        c: (F.lower(F.trim(c)) if kind in ("evm_address", "evm_hash", "plain_hash") else F.trim(c))
        for c, kind in columns.items()
    }
    rows = df.withColumns(lowered)
    bad = F.array_compact(
        F.array(*[
            F.when(~F.coalesce(F.col(c).rlike(formats[kind]), F.lit(False)), F.lit(c))
            for c, kind in columns.items()
        ])
    )
    marked = rows.withColumn("invalid_columns", bad)
    return marked.where(F.size("invalid_columns") == 0).drop("invalid_columns"), marked.where(F.size("invalid_columns") > 0)


def asset_parts(df: DataFrame) -> DataFrame:
    """Standard, contract and token id of asset ids such as ``erc721:0x../7``."""
    pattern = "^(native|erc20|erc721|erc1155|trc10|trc20|trc721):([^/]+)(?:/(0|[1-9][0-9]*))?$"
    pick = lambda i: F.regexp_extract("asset_id", pattern, i)
    return df.withColumns(
        {
            "asset_standard": pick(1), "asset_contract": pick(2),
            "asset_token": F.when(pick(3) != "", pick(3)),
            "asset_valid": F.col("asset_id").rlike(pattern),
        }
    )


# Item types of marketplace orders.
ITEM_TYPES = ("native", "erc20", "erc721", "erc1155")


#: The least word that needs more than 60 bits.
_LARGE_WORD = bytes(24) + bytes([16]) + bytes(7)


def _unhexed(data: Column) -> Column:
    """Hex data, with or without prefix, as bytes; null where it is no hex of whole words."""
    digits = F.when(F.lower(F.left(data, F.lit(2))) == "0x", F.substring(data, F.lit(3), F.octet_length(data))).otherwise(data)
    return F.when(F.octet_length(digits) % 64 == 0, F.unhex(digits))


def _byte_word(data: Column, index: Column | int) -> Column:
    """The 32 bytes of word number ``index``; null where the data is shorter."""
    at = F.lit(index) if isinstance(index, int) else index
    bits = F.substring(data, (at * F.lit(32) + F.lit(1)).cast("int"), F.lit(32))
    return F.when(F.octet_length(data) >= (at + F.lit(1)) * F.lit(32), bits)


def _small_bytes(value: Column) -> Column:
    """A word of bytes that fits 60 bits as ``bigint``, else null."""
    return F.when(value < F.lit(_LARGE_WORD), F.conv(F.hex(F.substring(value, F.lit(25), F.lit(8))), 16, 10).cast("bigint"))


def _address_bytes(value: Column) -> Column:
    """An EVM address from a left-padded word of bytes; null when the padding is not zero."""
    return F.when(F.substring(value, F.lit(1), F.lit(12)) == F.lit(bytes(12)), _hexed(F.substring(value, F.lit(13), F.lit(20)), "0x"))


def _hexed(value: Column, prefix: str = "") -> Column:
    text = F.lower(F.hex(value))
    return F.concat(F.lit(prefix), text) if prefix else text


def nft_orders(logs: DataFrame) -> DataFrame:
    """Marketplace order logs as one row per item of the offer or the consideration.

    A log is decoded only as a whole: fixed offsets, exact size, and every item
    consistent with its type.  Data is read as bytes, whose words are cut out
    without a scan, and each log is decoded once.
    """
    data = F.col("data")
    at = lambda i: _small_bytes(_byte_word(data, i))
    topic = lambda i: F.regexp_replace(F.lower(_topic(i)), "^0x", "")
    own = logs.where((topic(0) == ORDER_FULFILLED) & (F.size("topics") == 3)).select(
        "tx_hash", "log_index", _unhexed(F.col("data")).alias("data"), word_address(topic(1)).alias("offerer"),
    )
    step = own.withColumns(
        {"w": F.floor(F.octet_length(data) / 32).cast("int"), "order_hash": _hexed(_byte_word(data, 0), "0x"),
         "recipient": _address_bytes(_byte_word(data, 1)), "o2": at(2), "o3": at(3), "offers": at(4)}
    )
    start = F.when(F.col("offers") < F.col("w"), F.col("offers") * 4 + 5)
    step = step.withColumn("start", start)
    step = step.withColumn("received", F.when(F.col("start") < F.col("w"), at(F.col("start"))))
    shaped = (
        (F.col("o2") == 128) & (F.col("o3") == F.col("start") * 32)
        & (F.col("w") == F.col("start") + 1 + F.col("received") * 5)
        & F.col("recipient").isNotNull() & (F.col("offerer") != ZERO_ADDRESS) & (F.col("order_hash") != "0x" + "0" * 64)
    )
    step = step.withColumn("shaped", F.coalesce(shaped, F.lit(False)))

    def items(first: Column, size: int, count: str) -> Column:
        n = F.when(F.col("shaped"), F.col(count)).otherwise(0).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(data, ((first + i * size) * 32 + 1).cast("int"), F.lit(32 * size)))

    # items stay raw bytes until they are one row each
    step = step.withColumns(
        {"offer": items(F.lit(5), 4, "offers"), "consideration": items(F.col("start") + 1, 5, "received")}
    )
    both = F.concat(
        F.transform("offer", lambda x: F.struct(F.lit("offer").alias("side"), x.alias("x"))),
        F.transform("consideration", lambda x: F.struct(F.lit("consideration").alias("side"), x.alias("x"))),
    )
    one = _exploded(
        step, both, ["tx_hash", "log_index", "order_hash", "offerer", "recipient"], ("item_index", "s")
    )
    raw = F.col("s")["x"]
    parts = one.select(
        "tx_hash", "log_index", "order_hash", "offerer", "recipient", "item_index",
        F.col("s")["side"].alias("side"), _small_bytes(_byte_word(raw, 0)).alias("kind"), _address_bytes(_byte_word(raw, 1)).alias("token"),
        _byte_word(raw, 2).alias("id_word"), _byte_word(raw, 3).alias("amount_word"),
        F.when(F.col("s")["side"] == "consideration", _address_bytes(_byte_word(raw, 4))).alias("item_recipient"),
    )
    zero_word = F.lit(bytes(32))
    zero_id, zero_token = F.col("id_word") == zero_word, F.col("token") == ZERO_ADDRESS
    sound = (
        F.when(F.col("kind") == 0, zero_token & zero_id).when(F.col("kind") == 1, ~zero_token & zero_id)
        .when(F.col("kind") == 2, ~zero_token & (F.col("amount_word") == F.lit(bytes(31) + b"\x01")))
        .when(F.col("kind") == 3, ~zero_token).otherwise(False)
    ) & (F.col("amount_word") != zero_word) & ((F.col("side") == "offer") | F.col("item_recipient").isNotNull())
    marked = parts.withColumn("sound", F.coalesce(sound, F.lit(False)).cast("int"))
    # an order counts only when all its items do; its items, bounded by the log's data, travel together
    items_of = marked.groupBy("tx_hash", "log_index").agg(
        F.min("sound").alias("all_sound"),
        F.collect_list(F.struct("order_hash", "offerer", "recipient", "item_index", "side", "kind", "token", "id_word", "amount_word", "item_recipient")).alias("items"),
    )
    kinds = F.array(*[F.lit(k) for k in ITEM_TYPES])
    amount = lambda c: F.coalesce(
        _small_bytes(F.col(c)).cast("string"), wide.from_hex(_hexed(F.col(c)))
    )
    return items_of.where(F.col("all_sound") == 1).select("tx_hash", "log_index", F.inline("items")).select(
        "tx_hash", "log_index", "order_hash", "offerer", "recipient", "item_index", "side",
        F.get(kinds, F.col("kind").cast("int")).alias("item_type"), "token", amount("id_word").alias("identifier"),
        amount("amount_word").alias("amount_raw"), "item_recipient",
    )


def nft_order_edges(orders: DataFrame, edges: DataFrame) -> DataFrame:
    """Order items matched to the NFT transfers of the same transaction."""
    offered = F.col("side") == "offer"
    nft = orders.where(F.col("item_type").isin("erc721", "erc1155")).select(
        "tx_hash", "log_index", "order_hash", "amount_raw",
        F.concat("item_type", F.lit(":"), "token", F.lit("/"), "identifier").alias("asset_id"),
        # who gives is stated for offers only
        F.when(offered, F.col("offerer")).alias("giver"),
        F.when(offered, F.col("recipient")).otherwise(F.col("item_recipient")).alias("to_address"), offered.alias("offered"),
    ).where(F.col("to_address") != ZERO_ADDRESS)
    move = edges.select("tx_hash", "relationship_id", "asset_id", "amount_raw", "from_address", "to_address")
    found = move.join(nft, ["tx_hash", "asset_id", "amount_raw", "to_address"]).where(
        ~F.col("offered") | (F.col("giver") == F.col("from_address"))
    )
    return found.select("tx_hash", "log_index", "order_hash", "relationship_id").distinct()


def with_stable_ids(df: DataFrame, columns: list[str], name: str = "stable_id") -> DataFrame:
    return df.withColumn(name, stable_id(*[F.col(c) for c in columns]))

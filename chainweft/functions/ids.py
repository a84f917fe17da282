"""Stable identifiers, id formats and hex words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of identifiers on the supported networks.
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
EVM_ADDRESS = "^0x[0-9a-f]{40}$"
EVM_HASH = "^0x[0-9a-f]{64}$"
PLAIN_HASH = "^[0-9a-f]{64}$"
TRON_ADDRESS = "^T[1-9A-HJ-NP-Za-km-z]{33}$"
BITCOIN_ADDRESS = "^([13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})$"
DECIMAL_AMOUNT = "^(0|[1-9][0-9]{0,77})$"

# Native asset and decimals per network.
NETWORKS = {
    "tron:mainnet": ("TRX", 6),
    "eip155:1": ("ETH", 18),
    "eip155:56": ("BNB", 18),
    "bip122:000000000019d6689c085ae165831e93": ("BTC", 8),
}

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined with ``|``; null parts count as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def script_subject(address: Column, script_hex: Column) -> Column:
    """The address, or ``script:`` and the digest of the script text."""
    return F.coalesce(address, F.concat(F.lit("script:"), F.sha2(script_hex, 256)))


def unprefixed(data: Column) -> Column:
    text = F.lower(data)
    return F.substr(text, F.when(F.startswith(text, F.lit("0x")), F.lit(3)).otherwise(F.lit(1)))


def word(data: Column, index: Column | int) -> Column:
    """The 64-digit word number ``index`` of hex data without prefix."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.substring(data, (at * F.lit(64) + F.lit(1)).cast("int"), F.lit(64))


def word_count(data: Column) -> Column:
    return (F.length(data) / 64).cast("int")


def word_address(hex_word: Column) -> Column:
    """An EVM address from a left-padded word; null when the padding is not zero."""
    return F.when(
        hex_word.rlike("^0{24}[0-9a-f]{40}$"), F.concat(F.lit("0x"), F.right(hex_word, F.lit(40)))
    )


def small_word(hex_word: Column) -> Column:
    """A word that fits 60 bits as ``bigint``, else null."""
    return F.when(
        hex_word.rlike("^0{49}[0-9a-f]{15}$"),
        F.conv(F.right(hex_word, F.lit(15)), 16, 10).cast("bigint"),
    )


def day_start(ms: Column) -> Column:
    return bucket_start(ms, DAY_MS)


def bucket_start(ms: Column, width: int) -> Column:
    return (ms - F.pmod(ms, F.lit(width))).cast("bigint")

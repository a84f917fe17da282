"""Facts in the shape in which readers ask for them: defaults filled, fields taken out of stored evidence, asset ids split."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that the stored evidence of a transaction and of an event holds as JSON, with their types.
TRANSACTION_FIELDS = {
    "contract_address": "string", "nonce": "bigint", "transaction_type": "bigint", "input_selector": "string",
    "input_data": "string", "gas_limit": "bigint", "gas_used": "bigint",
}
EVENT_FIELDS = {
    "protocol_contract": "string", "counterparty_address": "string", "asset_in": "string", "asset_out": "string",
    "remote_asset": "string", "bridge_direction": "string", "correlation_key": "string",
}


def fields_of(evidence: Column, fields: Mapping[str, str]) -> list[Column]:
    """The named fields of a JSON text in one parse; what is missing, or not of its type, is empty or zero."""
    parsed = F.from_json(evidence, ", ".join(f"{name} string" for name in fields))
    empty = {"string": F.lit(""), "bigint": F.lit(0).cast("bigint")}
    return [F.coalesce(parsed[name].try_cast(kind), empty[kind]).alias(name) for name, kind in fields.items()]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def asset_parts(asset_id: Column) -> tuple[Column, Column, Column]:
    """(standard, contract or symbol, item) of ``standard:contract/item``; the item is empty where there is none."""
    whole, item = F.substring_index(asset_id, "/", 1), F.when(F.contains(asset_id, F.lit("/")), F.substring_index(asset_id, "/", -1))
    return F.substring_index(whole, ":", 1), F.substring_index(whole, ":", -1), F.coalesce(item, F.lit(""))


def network_asset(network_id: Column, asset_id: Column) -> Column:
    """An asset under its network, without its item; native assets in lower case."""
    whole = F.substring_index(asset_id, "/", 1)
    return F.concat(network_id, F.lit("/"), F.when(whole.startswith("native:"), F.lower(whole)).otherwise(whole))


def project_transactions(txs: DataFrame) -> DataFrame:
    """Transactions with their evidence fields; ``txs`` has status as text, amount_raw, fee_raw and raw_evidence_json."""
    return txs.select(
        "network_id", "tx_hash", "block_number", "block_timestamp_unix_ms", "transaction_index", _text("from_address"), _text("to_address"),
        F.coalesce("amount_raw", F.lit("0")).alias("value"), F.coalesce(F.col("status") == "success", F.lit(False)).cast("int").alias("status"),
        F.coalesce(F.col("status").isin("success", "failed"), F.lit(False)).cast("int").alias("status_known"), F.col("fee_raw").alias("fee_paid"),
        *fields_of(F.col("raw_evidence_json"), TRANSACTION_FIELDS),
    )


def project_edges(edges: DataFrame) -> DataFrame:
    """Transfer edges with text defaults, the asset under its network, and the asset's parts."""
    standard, contract, item = asset_parts(F.col("asset_id"))
    return edges.select(
        "relationship_id", "network_id", "tx_hash", "block_number", "transaction_index", "event_index", _text("from_address"), _text("to_address"),
        network_asset(F.col("network_id"), F.col("asset_id")).alias("asset_id"), standard.alias("asset_standard"), contract.alias("asset_contract"), item.alias("asset_item"),
        _text("token_id"), F.col("amount_raw").alias("amount"), "transfer_type",
    )


def project_events(events: DataFrame) -> DataFrame:
    """Semantic events with their evidence fields and amounts as text."""
    return events.select(
        "event_id", "tx_hash", "event_type", F.col("subject_id").alias("subject_address"), "protocol", _text("amount_in"), _text("amount_out"), "confidence",
        *fields_of(F.col("raw_evidence_json"), EVENT_FIELDS),
    )

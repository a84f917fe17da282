"""Row constraints of the stored tables: named kinds of rules, applied per table from a list and reported in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions.ids import DECIMAL_AMOUNT

# What a status column may hold.
STATUSES = {
    "ingestion": ("processing", "complete", "failed", "orphaned"),
    "failure": ("retry", "dead_letter", "repairing", "gap", "resolved"),
    "review": ("pending", "approved", "rejected", "revoked"),
    "decision": ("approved", "rejected", "revoked"),
    "membership": ("pending", "active", "inactive", "revoked"),
    "run": ("pending", "waiting", "running", "complete", "failed", "stale", "cancelled", "truncated"),
    "risk": ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL"),
}
LARGEST_TOKEN = "115792089237316195423570985008687907853269984665640564039457584007913129639935"
MOST_SATS = 2_100_000_000_000_000
EVIDENCE_REF = r"^[a-z][a-z0-9_]*:[^\p{Cntrl}]+$"

# What every row that belongs to a block holds.
_PLACED = ("filled:block_hash", "hash:block_hash", "filled:commit_id", "positive:revision", "filled:tx_hash", "hash:tx_hash")

# The rules of each table as kind:column; a status also names its list.
CONTRACTS = {
    "schema_migrations": ("network", "filled:migration_id", "positive:schema_version", "positive:revision"),
    "warehouse_identity": ("network", "positive:schema_version", "positive:revision"),
    "sync_state": ("network", "positive:revision", "flag:initialized", "hash_if:initialized:last_block_hash"),
    "ingested_blocks": ("network", "hash:block_hash", "status:ingestion:ingestion_status", "flag:canonical", "positive:revision"),
    "transactions": ("network", "filled:block_hash", "hash:tx_hash", "amount:amount_raw", "amount:fee_raw"),
    "address_relationships": ("network", "filled:relationship_id", "hash:tx_hash", "amount:amount_raw"),
    "transaction_features": ("network", "hash:tx_hash", "flag:is_swap", "flag:is_bridge", "flag:is_mint", "flag:is_burn"),
    "semantic_events": ("network", "filled:event_id", "hash:tx_hash", "share:confidence", "amount:amount_raw"),
    "metadata_jobs": ("network", "filled:job_id", "filled:asset_id", "positive:revision"),
    "ingestion_failures": ("network", "filled:failure_id", "status:failure:status", "positive:attempts", "positive:revision"),
    "ingestion_benchmarks": ("network", "filled:benchmark_id", "json:settings_json", "positive:revision"),
    "intelligence_sources": ("network", "filled:source_id", "flag:is_active", "positive:revision"),
    "intelligence_claims": ("network", "filled:claim_id", "share:confidence", "flag:is_exposure_seed", "status:review:review_status", "refs:evidence_refs", "positive:revision"),
    "intelligence_reviews": ("network", "filled:review_id", "status:decision:decision", "filled:reviewed_by", "positive:revision"),
    "cluster_claims": ("network", "filled:claim_id", "share:confidence", "status:review:review_status", "refs:evidence_refs"),
    "cluster_memberships": ("network", "filled:cluster_id", "filled:cluster_version", "filled:subject_id", "status:membership:status", "positive:revision"),
    "cluster_runs": ("network", "filled:run_id", "status:run:status", "json:cursor_json", "flag:truncated", "positive:revision"),
    "exposure_seeds": ("network", "filled:seed_id", "flag:is_active", "positive:revision"),
    "exposure_runs": ("network", "filled:run_id", "status:run:status", "flag:truncated", "positive:revision"),
    "exposure_paths": ("network", "filled:path_id", "filled:run_id", "share:exposure_score"),
    "risk_policies": ("network", "filled:policy_version", "flag:enabled", "percent:medium_threshold", "percent:high_threshold"),
    "risk_policy_rules": ("network", "filled:policy_version", "filled:rule_id", "percent:max_contribution", "flag:enabled", "positive:revision"),
    "wallet_risk_signals": ("network", "filled:signal_id", "filled:assessment_id", "percent:contribution", "refs:evidence_refs"),
    "wallet_risk_assessments": ("network", "filled:assessment_id", "maybe_percent:risk_score", "status:risk:risk_level"),
    "asset_metadata": ("network", "filled:asset_id", "asset:asset_id", "native_decimals:asset_id:decimals", "status:review:review_status", "reviewed:review_status:reviewed_by", "refs:evidence_refs", "positive:revision"),
    "bitcoin_inputs": ("network", "kind:outputs", *_PLACED, "bytes:script_hex", "sats:value_sats", "hash:prev_tx_hash"),
    "bitcoin_outputs": ("network", "kind:outputs", *_PLACED, "bytes:script_hex", "sats:value_sats", "flag:coinbase"),
    "evm_logs": ("network", "kind:logs", *_PLACED),
    "tron_contracts": ("network", "kind:contracts", *_PLACED, "json:payload_json"),
}


def _finite_between(name: str, low: float, high: float) -> Column:
    value = F.col(name).cast("double")
    return ~F.isnan(value) & value.between(low, high)


@dataclass(frozen=True)
class Network:
    """What rows of a network look like: patterns of hashes and asset ids, decimals of the native asset, ledger kinds."""

    hashes: str
    assets: str = ""
    native_decimals: int | None = None
    kinds: tuple[str, ...] = ()


def _by_network(networks: Mapping[str, Network], condition: Callable[[Network], Column]) -> Column:
    out = F.lit(False)
    for name, network in networks.items():
        out = F.when(F.col("network_id") == name, condition(network)).otherwise(out)
    return out


def _rule(text: str, networks: Mapping[str, Network]) -> Column:
    """The condition that one rule asks for."""
    kind, *names = text.split(":")
    formats = {name: network.hashes for name, network in networks.items()}
    if kind == "kind":
        return F.col("network_id").isin(*[name for name, network in networks.items() if names[0] in network.kinds])
    if kind == "asset":
        number = F.regexp_extract(names[0], "([0-9]+)$", 1)
        return _by_network(networks, lambda n: F.col(names[0]).rlike(n.assets)) & (
            (F.length(number) < len(LARGEST_TOKEN)) | (F.length(number) == len(LARGEST_TOKEN)) & (number <= LARGEST_TOKEN)
        )
    if kind == "native_decimals":
        return ~F.startswith(F.col(names[0]), F.lit("native:")) | _by_network(networks, lambda n: F.col(names[1]) == F.lit(n.native_decimals))
    if kind == "reviewed":
        return (F.col(names[0]) == "pending") | (F.length(names[1]) > 0)
    if kind == "network":
        return F.col("network_id").isin(*formats)
    name = names[-1]
    hashed = F.lit(False)
    for network, pattern in formats.items():
        hashed = F.when(F.col("network_id") == network, F.col(name).cast("string").rlike(pattern)).otherwise(hashed)
    if kind == "hash":
        return hashed
    if kind == "hash_if":
        return F.when(F.col(names[0]) == 0, F.col(name) == "").otherwise(hashed)
    if kind == "status":
        return F.col(name).isin(*STATUSES[names[0]])
    if kind == "refs":
        return F.forall(name, lambda r: F.coalesce(r.rlike(EVIDENCE_REF), F.lit(False)))
    return {
        "filled": lambda: F.length(name) > 0,
        "positive": lambda: F.col(name) > 0,
        "flag": lambda: F.col(name).isin(0, 1),
        "share": lambda: _finite_between(name, 0.0, 1.0),
        "percent": lambda: _finite_between(name, 0.0, 100.0),
        "maybe_percent": lambda: F.col(name).isNull() | _finite_between(name, 0.0, 100.0),
        "amount": lambda: F.col(name).isNull() | F.col(name).rlike(DECIMAL_AMOUNT),
        "sats": lambda: F.col(name) <= MOST_SATS,
        "bytes": lambda: F.col(name).rlike("^(?:[0-9a-f]{2})*$"),
        "json": lambda: F.try_parse_json(F.col(name)).isNotNull(),
    }[kind]()


def with_violations(df: DataFrame, table: str, networks: Mapping[str, Network]) -> DataFrame:
    """``df`` with ``violations``: the rules of ``table`` that a row breaks, all in one pass.

    A condition that is null is broken, as a missing value proves nothing.
    """
    broken = [F.when(~F.coalesce(_rule(r, networks), F.lit(False)), F.lit(r)) for r in CONTRACTS[table]]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))

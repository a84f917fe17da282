"""Data-quality and operations reports over blocks, failures and claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions.ordered import with_running_total
from chainweft.operators.series import missing_ranges
from chainweft.operators.visibility import latest, per_network, violations
from chainweft.sources.files import network_of_symbol


#: Heights of a missing range that one row carries.
PIECE = 100_000


def gaps(blocks: DataFrame, txs: DataFrame, state: DataFrame, utxo: bool = True,
         require_trace: bool = False) -> DataFrame:
    """Every published height with a problem and the reasons for it.

    ``blocks`` are canonical blocks.  Missing heights come from the ranges
    between stored ones, so nothing is generated for heights that exist.
    """
    # a long range is cut before it is written out, so no row holds it whole
    pieces = missing_ranges(blocks, state).select(
        "network_id", "to_block", F.explode(F.sequence("from_block", "to_block", F.lit(PIECE))).alias("from_block")
    )
    missing = pieces.select(
        "network_id", F.explode(F.sequence("from_block", F.least("to_block", F.col("from_block") + PIECE - 1))).alias("block_number"),
        F.array(F.lit("missing_block")).alias("reasons"),
    )
    stored = txs.groupBy("network_id", "block_number").agg(F.count("*").alias("stored"))
    before = blocks.select(
        "network_id", (F.col("block_number") + 1).alias("block_number"),
        F.col("block_hash").alias("previous_hash"),
    )
    fence = per_network(state).select("network_id", "start_block")
    rows = (
        blocks.join(stored, ["network_id", "block_number"], "left")
        .join(before, ["network_id", "block_number"], "left")
        .join(fence, "network_id")
    )

    def absent(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)) != 1

    checks: list[tuple[str, Column]] = [
        ("transaction_count_mismatch", F.col("transaction_count") != F.coalesce("stored", F.lit(0))),
        (
            "parent_not_verified",
            (F.col("block_number") > F.col("start_block"))
            & ~F.col("parent_hash").eqNullSafe(F.col("previous_hash")),
        ),
    ]
    if utxo:
        checks.append(("prevout_coverage_missing", absent("prevout_coverage")))
    else:
        checks.append(("receipt_coverage_missing", absent("receipt_coverage")))
        if require_trace:
            checks.append(("trace_coverage_missing", absent("trace_coverage")))
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    present = rows.select("network_id", "block_number", reasons.alias("reasons"))
    return present.where(F.size("reasons") > 0).unionByName(missing)


def failure_summary(failures: DataFrame) -> DataFrame:
    """Current failures by status."""
    current = latest(failures, ["network_id", "failure_id"])
    return current.groupBy("network_id", "status").agg(
        F.count("*").alias("failures"), F.max("last_failed_at_unix_ms").alias("last_failed_at_unix_ms")
    )


def journal_summary(blocks: DataFrame, stale_before_ms: int) -> DataFrame:
    """Processing, stale and failed blocks of the journal."""
    current = latest(blocks, ["network_id", "block_number"])
    working = F.col("ingestion_status") == "processing"
    return current.groupBy("network_id").agg(
        F.count_if(working).alias("processing_blocks"),
        F.count_if(working & (F.col("block_timestamp_unix_ms") < stale_before_ms)).alias(
            "stale_processing_blocks"
        ),
        F.count_if(F.col("ingestion_status") == "failed").alias("failed_blocks"),
    )


def failure_list(failures: DataFrame, status: str | None = None, from_block: int | None = None,
                 to_block: int | None = None, after: tuple[int, str] | None = None,
                 n: int = 100) -> DataFrame:
    """Current failures by status and block range, paged on (block, id)."""
    df = latest(failures, ["network_id", "failure_id"])
    if status is not None:
        df = df.where(F.col("status") == status)
    if from_block is not None:
        df = df.where(F.col("block_number") >= from_block)
    if to_block is not None:
        df = df.where(F.col("block_number") <= to_block)
    if after is not None:
        here = F.struct(F.col("block_number").alias("b"), F.col("failure_id").alias("f"))
        there = F.struct(F.lit(after[0]).cast("bigint").alias("b"), F.lit(after[1]).alias("f"))
        df = df.where(here > there)
    return df.orderBy("block_number", "failure_id").limit(n)


def coverage(blocks: DataFrame) -> DataFrame:
    """Extent and completeness of the canonical blocks per network."""
    count, low, high = F.count("*"), F.min("block_number"), F.max("block_number")
    solid = (high - low + 1) == count
    return blocks.groupBy("network_id").agg(
        count.alias("complete_blocks"),
        low.alias("first_synced_block"),
        high.alias("last_synced_block"),
        F.count_if(F.col("receipt_coverage") == 1).alias("receipt_complete_blocks"),
        F.count_if(F.col("trace_coverage") == 1).alias("trace_complete_blocks"),
        (F.count_if(F.col("trace_coverage") == 1) == count).alias("internal_transfer_coverage"),
        solid.alias("contiguous_indexed_range"),
        (solid & (low == 0)).alias("history_from_genesis"),
    )


def health(state: DataFrame, journal: DataFrame, failures: DataFrame, missing: DataFrame,
           heads: DataFrame, max_lag: int) -> DataFrame:
    """One status per network: NOT_STARTED, DEGRADED, LAGGING or HEALTHY.

    ``heads``: network_id, head; a network whose source gives no head is degraded.
    """
    # One row per network and status, at most a few dozen rows in all.
    stuck = failures.where(F.col("status") == "dead_letter").groupBy("network_id").agg(
        F.sum("failures").alias("non_retryable_failures")
    )
    holes = missing.groupBy("network_id").agg(F.sum("missing").alias("missing_block_count"))
    rows = (
        latest(state, ["network_id"])
        .join(journal, "network_id", "left")
        .join(stuck, "network_id", "left")
        .join(holes, "network_id", "left")
        .join(heads.select("network_id", F.col("head").cast("bigint").alias("head")), "network_id", "left")
        .fillna(0, ["processing_blocks", "stale_processing_blocks", "failed_blocks",
                    "non_retryable_failures", "missing_block_count"])
    )
    tip = F.when(F.col("initialized") == 1, F.col("last_block_number"))
    source = F.col("head")
    lag = F.when(source.isNotNull() & tip.isNotNull(), F.greatest(source - tip, F.lit(0)))
    bad = (
        source.isNull()
        | (F.col("stale_processing_blocks") > 0)
        | (F.col("failed_blocks") > 0)
        | (F.col("non_retryable_failures") > 0)
        | (F.col("missing_block_count") > 0)
    )
    status = (
        F.when(tip.isNull(), "NOT_STARTED").when(bad, "DEGRADED")
        .when(lag > max_lag, "LAGGING").otherwise("HEALTHY")
    )
    return rows.select(
        "network_id", status.alias("status"), lag.alias("lag_blocks"), "processing_blocks",
        "stale_processing_blocks", "failed_blocks", "non_retryable_failures", "missing_block_count",
    )


def sanction_claims(entries: DataFrame, source_key: str, valid: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(claims, excluded) from list entries; invalid addresses are excluded with a reason.

    ``valid`` maps a network id to the pattern its addresses must match.
    """
    known = entries.withColumn("network_id", network_of_symbol(F.col("asset"))).where(
        F.col("network_id").isNotNull()
    )
    evm = F.col("network_id").startswith("eip155:")
    norm = known.withColumn("address", F.when(evm, F.lower("address")).otherwise(F.col("address")))
    fits = F.lit(False)
    for network, pattern in valid.items():
        fits = fits | ((F.col("network_id") == network) & F.col("address").rlike(pattern))
    marked = norm.withColumn("ok", fits)
    digest = F.substring(F.sha2("address", 256), 1, 16)
    claim = F.concat_ws(":", F.lit(source_key), "entry_uid", "network_id", digest)
    claims = (
        marked.where("ok")
        .withColumn("claim_id", claim)
        .groupBy("claim_id", "network_id", "address", F.col("entry_uid").alias("uid"))
        .agg(
            F.min("name").alias("entity_name"),
            F.lower(F.coalesce(F.min("entity_type"), F.lit("sanctioned_party"))).alias("entity_type"),
            F.array_sort(F.collect_set(F.upper("asset"))).alias("symbols"),
        )
        .withColumn("review_status", F.lit("pending"))
    )
    excluded = marked.where(~F.col("ok")).select(
        F.col("entry_uid").alias("uid"), F.col("network_id"), F.col("asset").alias("symbol"), "address",
        F.lit("address_not_valid_for_supported_network").alias("reason"),
    )
    return claims, excluded


# What an imported claim must carry.
CLAIM_STATUSES = ("pending", "approved", "rejected", "revoked")


def claim_rules() -> dict[str, Column]:
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    return {
        "claim_id": filled("claim_id"),
        "address": filled("address"),
        "source_id": filled("source_id"),
        "confidence_range": F.col("confidence").between(0.0, 1.0),
        "risk_range": F.col("risk_level").between(0, 100),
        "status": F.col("review_status").isin(*CLAIM_STATUSES),
        "reviewer": (F.col("review_status") != "approved") | filled("reviewed_by"),
        "seed_has_risk": (F.col("is_exposure_seed") != 1) | (F.col("risk_level") > 0),
        "validity_order": F.col("valid_to_unix_ms").isNull()
        | (F.col("valid_to_unix_ms") > F.col("valid_from_unix_ms")),
    }


def check_claims(new: DataFrame, current: DataFrame) -> DataFrame:
    """Reasons not to import a claim.

    ``new`` may carry ``expected_revision``: null says the claim must be new,
    a number must equal the stored revision.
    """
    own = violations(new, claim_rules(), ["claim_id"])
    repeated = new.groupBy("claim_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
        "claim_id", F.lit("unique_claim_id").alias("rule")
    )
    stored = latest(current, ["network_id", "claim_id"]).select(
        "claim_id", F.col("network_id").alias("__net"), F.col("revision").alias("__rev")
    )
    both = new.join(stored, "claim_id", "left")
    cross = both.where(F.col("__net").isNotNull() & (F.col("__net") != F.col("network_id"))).select(
        "claim_id", F.lit("cross_network").alias("rule")
    )
    out = own.unionByName(repeated).unionByName(cross)
    if "expected_revision" in new.columns:
        stale = both.where(~F.col("expected_revision").eqNullSafe(F.col("__rev"))).select(
            "claim_id", F.lit("expected_revision").alias("rule")
        )
        out = out.unionByName(stale)
    return out


def apply_reviews(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claim status as its newest review decides; revoked and rejected deactivate."""
    newest = latest(
        reviews.where(F.col("subject_type") == "claim"), ["network_id", "subject_id"], ties=["review_id"]
    ).select(
        "network_id", F.col("subject_id").alias("claim_id"), "decision",
        F.col("reviewed_by").alias("reviewer"),
    )
    status = (
        F.when(F.col("decision") == "approve", "approved")
        .when(F.col("decision") == "reject", "rejected")
        .when(F.col("decision") == "revoke", "revoked")
    )
    current = latest(claims, ["network_id", "claim_id"])
    rows = current.join(newest, ["network_id", "claim_id"], "left")
    return rows.withColumns(
        {
            "review_status": F.coalesce(status, F.col("review_status")),
            "reviewed_by": F.coalesce("reviewer", "reviewed_by"),
        }
    ).withColumn("is_active", (F.col("review_status") == "approved").cast("int")).select(
        *claims.columns, "is_active"
    )


def pending_reviews(claims: DataFrame) -> DataFrame:
    """Pending claims per source and kind."""
    current = latest(claims, ["network_id", "claim_id"])
    return current.where(F.col("review_status") == "pending").groupBy("source_id", "claim_kind").agg(
        F.count("*").alias("pending")
    )


def review_history(reviews: DataFrame) -> DataFrame:
    """Decisions per claim in order, numbered from the oldest."""
    rows = reviews.where(F.col("subject_type") == "claim").withColumn("__one", F.lit(1))
    return with_running_total(
        rows, ["subject_id"], ["revision", "review_id"], "__one", "revision", 100_000, "step"
    ).drop("__one")


def metadata_backlog(discoveries: DataFrame, metadata: DataFrame, jobs: DataFrame, at: int) -> DataFrame:
    """Discovered assets without complete metadata that are not backing off."""
    found = discoveries.groupBy("network_id", "asset_id").agg(
        F.min("block_number").alias("discovered_block")
    )
    keys = ["network_id", "asset_id"]
    whole = latest(metadata, keys).where(F.col("metadata_status") == "complete").select(*keys)
    waiting = latest(jobs, keys).where(F.col("next_attempt_unix_ms") > at).select(*keys)
    return found.join(whole, keys, "left_anti").join(waiting, keys, "left_anti")


def range_profile(tables: Mapping[str, DataFrame], from_block: int, to_block: int,
                  width: int) -> DataFrame:
    """Rows per table and block range."""
    out = None
    for name, table in tables.items():
        start = (F.floor(F.col("block_number") / width) * width).cast("bigint")
        part = (
            table.where(F.col("block_number").between(from_block, to_block))
            .groupBy(start.alias("range_start"))
            .agg(F.count("*").alias("rows"))
            .select(F.lit(name).alias("table"), "range_start", "rows")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables")
    return out


# Row constraints of the block journal and the transfer edges.
BLOCK_STATUSES = ("processing", "complete", "failed", "orphaned")


def block_rules() -> dict[str, Column]:
    return {
        "hash": F.length("block_hash") > 0,
        "parent": (F.col("block_number") == 0) | (F.length("parent_hash") > 0),
        "revision": F.col("revision") > 0,
        "status": F.col("ingestion_status").isin(*BLOCK_STATUSES),
        "canonical_flag": F.col("canonical").isin(0, 1),
        "orphan_not_canonical": (F.col("ingestion_status") != "orphaned") | (F.col("canonical") == 0),
        "counts": F.col("transaction_count") >= 0,
    }


def edge_rules(networks: Sequence[str]) -> dict[str, Column]:
    from chainweft.functions.ids import DECIMAL_AMOUNT

    filled = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    return {
        "network": F.col("network_id").isin(*networks),
        "relationship_id": filled("relationship_id"),
        "tx_hash": filled("tx_hash"),
        "endpoint": filled("from_address") | filled("to_address"),
        "amount": F.col("amount_raw").rlike(DECIMAL_AMOUNT),
        "nft_amount": (F.col("transfer_type") != "erc721_transfer") | (F.col("amount_raw") == "1"),
        "nft_token": (F.col("transfer_type") != "erc721_transfer") | F.col("token_id").isNotNull(),
    }

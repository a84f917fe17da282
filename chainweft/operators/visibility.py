"""Which rows count: newest revisions, canonical facts, sealed output, active labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT_KEYS = [
    "network_id", "block_number", "block_hash", "commit_id", "revision",
    "block_timestamp_unix_ms",
]


def latest(
    df: DataFrame, keys: Sequence[str], revision: str = "revision", ties: Sequence[str] = ()
) -> DataFrame:
    """The newest row per key.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key with very many versions never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(revision, *ties))
    row = df.groupBy(*keys).agg(newest.alias("__row"))
    return row.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def per_network(state: DataFrame) -> DataFrame:
    """One state row per network (four networks exist), safe to send everywhere."""
    return F.broadcast(latest(state, ["network_id"]))


def canonical_blocks(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Newest version of every block that is complete, canonical and published."""
    fence = per_network(state).where(F.col("initialized") == 1).select(
        "network_id",
        F.col("revision").alias("__at"),
        "start_block",
        "last_block_number",
        "last_block_hash",
    )
    current = latest(blocks, ["network_id", "block_number"])
    kept = current.join(fence, "network_id").where(
        (F.col("canonical") == 1)
        & (F.col("ingestion_status") == "complete")
        & (F.col("revision") <= F.col("__at"))
        & F.col("block_number").between(F.col("start_block"), F.col("last_block_number"))
        & (
            (F.col("block_number") < F.col("last_block_number"))
            | (F.col("block_hash") == F.col("last_block_hash"))
        )
    )
    return kept.select(*blocks.columns)


def canonical(facts: DataFrame, canonical_block_rows: DataFrame) -> DataFrame:
    """Facts written by the very block version that is canonical."""
    return facts.join(canonical_block_rows.select(*FACT_KEYS), FACT_KEYS, "left_semi")


def snapshot(state: DataFrame) -> DataFrame:
    """A digest per network that changes whenever the published state does."""
    fields = sorted(state.columns)
    body = F.to_json(F.struct(*fields))
    return latest(state, ["network_id"]).select("network_id", F.sha2(body, 256).alias("snapshot_id"))


def snapshot_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.select("network_id", F.col("snapshot_id").alias("before_id"))
    b = after.select("network_id", F.col("snapshot_id").alias("after_id"))
    return a.join(b, "network_id", "full_outer").withColumn(
        "changed", ~F.col("before_id").eqNullSafe(F.col("after_id"))
    )


def visible_publications(
    publications: DataFrame, state: DataFrame, canonical_block_rows: DataFrame
) -> DataFrame:
    """Complete seals whose source revision and anchor block still hold."""
    current = latest(publications, ["network_id", "family", "publication_id"])
    fence = per_network(state).where(F.col("initialized") == 1).select(
        "network_id", F.col("revision").alias("source_revision"), "last_block_number"
    )
    anchors = canonical_block_rows.select(
        "network_id", F.col("block_number").alias("as_of_block"), "block_hash"
    )
    return (
        current.where(F.col("status") == "complete")
        .join(fence, ["network_id", "source_revision"])
        .where(F.col("as_of_block") <= F.col("last_block_number"))
        .join(anchors, ["network_id", "as_of_block", "block_hash"], "left_semi")
        .select(*publications.columns)
    )


def visible(
    derived: DataFrame, runs: DataFrame, publications: DataFrame, family: str, key: str = "run_id"
) -> DataFrame:
    """Derived rows of visible publications whose run row is complete too."""
    seal = publications.where(F.col("family") == family).select(
        "network_id",
        F.col("publication_id").alias(key),
        F.col("output_revision").alias("revision"),
    )
    whole = latest(runs, ["network_id", key]).where(F.col("status") == "complete")
    on = ["network_id", key, "revision"]
    return derived.join(seal, on, "left_semi").join(whole.select(*on), on, "left_semi")


def active_claims(claims: DataFrame, sources: DataFrame, at: int) -> DataFrame:
    """Approved claims of active sources that are valid at ``at`` (ms)."""
    current = latest(claims, ["network_id", "claim_id"])
    live = latest(sources, ["network_id", "source_id"]).where(F.col("is_active") == 1)
    return current.where(
        (F.lower("review_status") == "approved")
        & (F.col("valid_from_unix_ms") <= at)
        & (F.col("valid_to_unix_ms").isNull() | (F.col("valid_to_unix_ms") > at))
    ).join(live.select("network_id", "source_id"), ["network_id", "source_id"], "left_semi").select(
        *claims.columns
    )


def active_reviewed(
    claims: DataFrame, sources: DataFrame, reviews: DataFrame, at: int
) -> DataFrame:
    """Active claims whose newest review approves exactly this claim version."""
    newest = latest(
        reviews.where(F.col("subject_type") == "claim"), ["network_id", "subject_id"],
        ties=["review_id"],
    ).where(F.col("decision") == "approve")
    match = newest.select(
        "network_id",
        F.col("subject_id").alias("claim_id"),
        F.col("claim_revision").alias("revision"),
        "reviewed_by",
    )
    return active_claims(claims, sources, at).where(F.trim("reviewed_by") != "").join(
        match, ["network_id", "claim_id", "revision", "reviewed_by"], "left_semi"
    ).select(*claims.columns)


def active_registry(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """Enabled, approved registry rows of active sources."""
    live = latest(sources, ["network_id", "source_id"]).where(F.col("is_active") == 1)
    return (
        latest(registry, ["network_id", "registry_id"])
        .where((F.col("enabled") == 1) & (F.lower("review_status") == "approved"))
        .join(live.select("network_id", "source_id"), ["network_id", "source_id"], "left_semi")
        .select(*registry.columns)
    )


def active_entities(
    addresses: DataFrame, entities: DataFrame, claims: DataFrame, entity_type: str | None = None
) -> DataFrame:
    """Entity addresses backed by an active claim and an active entity."""
    current = latest(addresses, ["network_id", "entity_id", "address"]).where(
        F.col("is_active") == 1
    )
    owners = latest(entities, ["network_id", "entity_id"]).where(F.col("is_active") == 1)
    if entity_type is not None:
        owners = owners.where(F.lower("entity_type") == entity_type)
    owners = owners.select("network_id", "entity_id", "entity_name", "entity_type")
    backing = claims.select("network_id", "claim_id", "entity_id", "address")
    return current.join(owners, ["network_id", "entity_id"]).join(
        backing, ["network_id", "claim_id", "entity_id", "address"], "left_semi"
    )


def verify_publication(
    parent: DataFrame, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], key: str = "run_id"
) -> DataFrame:
    """Problems that forbid sealing an output, one row per parent, table and rule.

    ``parent`` carries ``row_counts`` (map of table name to expected rows).
    Each table is reduced by its own key first, so duplicates are found and
    counted by the same aggregation.
    """
    found = []
    on = [key, "revision"]
    parents = parent.groupBy(key).agg(
        F.count("*").alias("parents"),
        F.max("revision").alias("revision"),
        F.first("row_counts").alias("row_counts"),
    )
    found.append(
        parents.where(F.col("parents") != 1).select(
            key, F.lit("parent").alias("table"), F.lit("one_parent").alias("rule"),
            F.col("parents").alias("found"),
        )
    )
    for name, (table, keys) in tables.items():
        per_key = table.groupBy(key, "revision", *[k for k in keys if k not in on]).agg(
            F.count("*").alias("__n")
        )
        per_run = per_key.groupBy(*on).agg(
            F.sum("__n").alias("rows"), F.sum((F.col("__n") > 1).cast("int")).alias("repeated")
        )
        expected = parents.select(
            *on, F.coalesce(F.try_element_at("row_counts", F.lit(name)), F.lit(0)).alias("expected")
        )
        both = expected.join(per_run, on, "full_outer")
        rules = {
            "row_count": (
                F.col("expected").isNotNull()
                & (F.coalesce("rows", F.lit(0)) != F.col("expected")),
                F.coalesce("rows", F.lit(0)),
            ),
            "unique_key": (F.coalesce("repeated", F.lit(0)) > 0, F.col("repeated")),
            "known_parent": (F.col("expected").isNull(), F.col("rows")),
        }
        cases = F.array_compact(
            F.array(*[
                F.when(bad, F.struct(F.lit(rule).alias("rule"), n.cast("bigint").alias("found")))
                for rule, (bad, n) in rules.items()
            ])
        )
        found.append(
            both.select(key, F.lit(name).alias("table"), F.explode(cases).alias("c")).select(
                key, "table", "c.rule", "c.found"
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def invalidate(publications: DataFrame, ids: DataFrame, revision: int) -> DataFrame:
    """Rows to append: the named publications again, newer and invalidated."""
    keys = ["network_id", "family", "publication_id"]
    current = latest(publications, keys)
    return (
        current.where(F.col("revision") < revision)
        .join(ids.select(*keys), keys, "left_semi")
        .withColumn("status", F.lit("invalidated"))
        .withColumn("revision", F.lit(revision).cast("bigint"))
        .select(*publications.columns)
    )


def verify_facts(
    expected_counts: DataFrame, facts: Mapping[str, tuple[DataFrame, Sequence[str]]]
) -> DataFrame:
    """Blocks whose stored rows differ from the announced counts or repeat a key.

    ``expected_counts``: block_number, counts (map of table name to rows).
    """
    reports = []
    for name, (table, keys) in facts.items():
        per_key = table.groupBy("block_number", *[k for k in keys if k != "block_number"]).agg(
            F.count("*").alias("__n")
        )
        stored = per_key.groupBy("block_number").agg(
            F.sum("__n").alias("stored"), F.sum((F.col("__n") > 1).cast("int")).alias("repeated")
        )
        wanted = expected_counts.select(
            "block_number", F.coalesce(F.try_element_at("counts", F.lit(name)), F.lit(0)).alias("expected")
        )
        both = wanted.join(stored, "block_number", "left").select(
            "block_number",
            F.lit(name).alias("table"),
            F.col("expected").cast("bigint"),
            F.coalesce("stored", F.lit(0)).alias("stored"),
            F.coalesce("repeated", F.lit(0)).alias("repeated"),
        )
        reports.append(both.where((F.col("expected") != F.col("stored")) | (F.col("repeated") > 0)))
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    return out


def content_differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows on one side only, with their multiplicity; no row set is held whole."""
    columns = expected.columns
    a = expected.select(*columns, F.lit(1).alias("__n"))
    b = stored.select(*columns, F.lit(-1).alias("__n"))
    return (
        a.unionByName(b)
        .groupBy(*columns)
        .agg(F.sum("__n").alias("difference"))
        .where(F.col("difference") != 0)
    )


def violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule; a rule that evaluates to null counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def rollback(
    blocks: DataFrame, canonical_block_rows: DataFrame, height: int, revision: int
) -> DataFrame:
    """Rows to append: tombstones for every canonical block above ``height``."""
    return (
        canonical_block_rows.where(F.col("block_number") > height)
        .withColumn("revision", F.lit(revision).cast("bigint"))
        .withColumn("canonical", F.lit(0))
        .withColumn("ingestion_status", F.lit("orphaned"))
        .select(*blocks.columns)
    )


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-independent digest; equal tables give equal rows."""
    mixed = F.xxhash64(*sorted(df.columns))
    low = F.sum(F.pmod(mixed, F.lit(1 << 31)).cast("decimal(20,0)"))
    whole = F.sum(mixed.cast("decimal(20,0)"))
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(whole, F.lit(0)).cast("string").alias("sum_digest"),
        F.coalesce(low, F.lit(0)).cast("string").alias("low_digest"),
        F.coalesce(F.bit_xor(mixed), F.lit(0)).alias("xor_digest"),
    )


def common_ancestor(local: DataFrame, remote: DataFrame, depth: int) -> DataFrame:
    """Highest block both branches share, at most ``depth`` below the local tip."""
    tip = F.broadcast(local.groupBy("network_id").agg(F.max("block_number").alias("tip")))
    keys = ["network_id", "block_number", "block_hash"]
    shared = local.select(*keys).join(remote.select(*keys), keys, "left_semi")
    return (
        shared.join(tip, "network_id")
        .where(F.col("block_number") >= F.col("tip") - depth)
        .groupBy("network_id")
        .agg(
            F.max("block_number").alias("block_number"),
            F.max_by("block_hash", "block_number").alias("block_hash"),
        )
    )

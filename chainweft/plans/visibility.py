"""Queries over revisions, canonical facts, labels and publications (section A)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.functions import ids
from chainweft.operators import contracts, projections, quality
from chainweft.operators import visibility as op
from chainweft.plans.registry import query
from chainweft.session import shared_dir
from chainweft.sources import files
from chainweft.sources.tables import ACCOUNT, UTXO, Tables

AT = 1_000_000_000_000


@query("a01_latest_blocks", "SELECT * FROM current_blocks")
def latest_blocks(t: Tables) -> DataFrame:
    return op.latest(t.blocks(), ["network_id", "block_number"])


@query(
    "a01_latest_line_version",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) // 1000 AS shipped_ms FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""",
)
def latest_line_version(t: Tables) -> DataFrame:
    lines = t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("shipped_ms"),
    )
    return op.latest(lines, ["l_orderkey", "l_linenumber"], "shipped_ms", ["l_partkey", "l_suppkey"])


@query("a02_canonical_blocks", "SELECT * FROM canonical_blocks")
def canonical_blocks(t: Tables) -> DataFrame:
    return op.canonical_blocks(t.blocks(), t.state())


@query(
    "a03_canonical_outputs",
    """SELECT o.tx_hash, o.output_index, o.block_number, o.address, o.value_sats FROM outputs o JOIN canonical_blocks b
        USING (network_id, block_number, block_hash, commit_id, revision, block_timestamp_unix_ms)""",
)
def canonical_outputs(t: Tables) -> DataFrame:
    return op.canonical(t.utxo_outputs(), canonical_blocks(t)).select(
        "tx_hash", "output_index", "block_number", "address", "value_sats"
    )


@query("a04_snapshot_identity")
def snapshot_identity(t: Tables) -> DataFrame:
    return op.snapshot(t.state())


@query(
    "a04_snapshot_changed",
    "SELECT network_id, true AS changed FROM state",
)
def snapshot_changed(t: Tables) -> DataFrame:
    later = t.state().withColumn("revision", F.col("revision") + 1)
    return op.snapshot_changed(op.snapshot(t.state()), op.snapshot(later)).select("network_id", "changed")


def _runs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(derived rows, runs, publications) on the block network: one run per part brand."""
    part = t.raw("part")
    key = F.col("p_partkey")
    brand = F.col("p_brand")
    number = F.regexp_extract(brand, "([0-9]+)$", 1).cast("bigint")
    derived = part.select(
        F.lit(UTXO).alias("network_id"), brand.alias("run_id"), key.alias("row_key"),
        F.when(key % 10 == 0, 1).otherwise(2).cast("bigint").alias("revision"),
    )
    per = part.groupBy("p_brand").agg(F.count("*").alias("rows")).withColumn("n", number)
    runs = per.select(
        F.lit(UTXO).alias("network_id"), brand.alias("run_id"),
        F.when(F.col("n") % 6 == 5, "running").otherwise("complete").alias("status"),
        F.lit(2).cast("bigint").alias("revision"), "rows",
    )
    publications = per.select(
        F.lit(UTXO).alias("network_id"), F.lit("cluster").alias("family"), brand.alias("publication_id"),
        F.when(F.col("n") % 4 == 3, 1).otherwise(2).cast("bigint").alias("source_revision"),
        (F.col("n") * 3).alias("as_of_block"), F.concat(F.lit("b"), (F.col("n") * 3).cast("string")).alias("block_hash"),
        F.lit(2).cast("bigint").alias("output_revision"), F.lit("complete").alias("status"),
        F.lit(2).cast("bigint").alias("revision"),
    )
    return derived, runs, publications


_PUBS = """p AS (SELECT p_brand AS publication_id, cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS bigint) AS n, count(*) AS rows FROM part GROUP BY 1, 2),
    pubs AS (SELECT publication_id, CASE WHEN n % 4 = 3 THEN 1 ELSE 2 END AS source_revision, n * 3 AS as_of_block, 'b' || (n * 3) AS block_hash, n FROM p),
    vp AS (SELECT pubs.* FROM pubs JOIN state s ON s.revision = source_revision JOIN canonical_blocks b ON b.block_number = as_of_block AND b.block_hash = pubs.block_hash
        WHERE as_of_block <= last_block_number)"""


@query(
    "a05_visible_rows",
    f"""WITH {_PUBS} SELECT p_brand AS run_id, p_partkey AS row_key FROM part JOIN vp ON publication_id = p_brand
        WHERE p_partkey % 10 <> 0 AND n % 6 <> 5""",
)
def visible_rows(t: Tables) -> DataFrame:
    derived, runs, publications = _runs(t)
    seals = op.visible_publications(publications, t.state(), canonical_blocks(t))
    return op.visible(derived, runs, seals, "cluster").select("run_id", "row_key")


_ACTIVE = f"""cur AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1),
    src AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY revision DESC) = 1),
    act AS (SELECT cur.* FROM cur JOIN src USING (source_id) WHERE is_active = 1 AND lower(review_status) = 'approved'
        AND valid_from_unix_ms <= {AT} AND (valid_to_unix_ms IS NULL OR valid_to_unix_ms > {AT}))"""


@query("a06_active_claims", f"WITH {_ACTIVE} SELECT claim_id, address, entity_id, entity_type, risk_level, revision FROM act")
def active_claims(t: Tables) -> DataFrame:
    return op.active_claims(t.claims(), t.sources(), AT).select(
        "claim_id", "address", "entity_id", "entity_type", "risk_level", "revision"
    )


@query(
    "a07_active_reviewed_claims",
    f"""WITH {_ACTIVE}, rv AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY revision DESC, review_id DESC) = 1)
    SELECT claim_id, address, act.revision, act.reviewed_by FROM act JOIN rv ON subject_id = claim_id
    WHERE decision = 'approve' AND claim_revision = act.revision AND rv.reviewed_by = act.reviewed_by AND trim(act.reviewed_by) <> ''""",
)
def active_reviewed_claims(t: Tables) -> DataFrame:
    return op.active_reviewed(t.claims(), t.sources(), t.reviews(), AT).select(
        "claim_id", "address", "revision", "reviewed_by"
    )


def registry_rows(t: Tables) -> DataFrame:
    """Reviewed protocol contracts: one row per supplier."""
    key = F.col("s_suppkey")
    pick = key % 8
    return t.raw("supplier").select(
        F.lit(ACCOUNT).alias("network_id"),
        F.concat(F.lit("reg"), key.cast("string")).alias("registry_id"),
        F.concat(F.lit("S"), key.cast("string")).alias("contract"),
        F.concat(F.lit("protocol"), (key % 12).cast("string")).alias("protocol"),
        F.when(pick < 3, "dex").when(pick == 3, "bridge").when(pick == 4, "lending")
        .when(pick == 5, "staking").when(pick == 6, "mixer").otherwise("scam").alias("protocol_type"),
        F.when(pick == 0, "amm_v2").when(pick == 1, "amm_v3").when(pick == 2, "aggregator")
        .when(pick == 3, "bridge_generic").when(pick == 4, "lending_generic")
        .when(pick == 5, "staking_generic").when(pick == 6, "mixer_generic")
        .otherwise("reviewed_interaction").alias("decoder"),
        (key % 9 != 4).cast("int").alias("enabled"),
        F.when(key % 7 == 6, "pending").otherwise("approved").alias("review_status"),
        F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("source_id"),
        F.lit(1).cast("bigint").alias("revision"),
    )


@query(
    "a08_active_registry",
    """WITH src AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY revision DESC) = 1)
    SELECT 'reg' || s_suppkey AS registry_id, 'S' || s_suppkey AS contract, 'protocol' || (s_suppkey % 12) AS protocol FROM supplier
    JOIN src ON source_id = 'src' || s_nationkey WHERE is_active = 1 AND s_suppkey % 9 <> 4 AND s_suppkey % 7 <> 6""",
)
def active_registry(t: Tables) -> DataFrame:
    return op.active_registry(registry_rows(t), t.sources()).select("registry_id", "contract", "protocol")


def _entities(t: Tables) -> tuple[DataFrame, DataFrame]:
    claims = op.latest(t.claims(), ["network_id", "claim_id"])
    key = F.regexp_extract("address", "([0-9]+)$", 1).cast("bigint")
    addresses = claims.select(
        "network_id", "entity_id", "address", "claim_id", "address_role", "confidence",
        (key % 13 != 12).cast("int").alias("is_active"), "revision",
    )
    number = F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("bigint")
    entities = claims.select("network_id", "entity_id", "entity_name").distinct().select(
        "*", F.when(number % 10 == 0, "exchange").otherwise("service").alias("entity_type"),
        (number % 11 != 10).cast("int").alias("is_active"), F.lit(1).cast("bigint").alias("revision"),
    )
    return addresses, entities


_ENT = """ea AS (SELECT cur.address, cur.entity_id, cur.entity_name, cur.address_role,
        CASE WHEN cast(substr(cur.entity_id, 4) AS int) % 10 = 0 THEN 'exchange' ELSE 'service' END AS entity_type
        FROM cur JOIN act USING (claim_id) WHERE cast(substr(cur.address, 2) AS int) % 13 <> 12 AND cast(substr(cur.entity_id, 4) AS int) % 11 <> 10)"""


@query("a09_active_entities", f"WITH {_ACTIVE}, {_ENT} SELECT address, entity_id, entity_type, address_role FROM ea")
def active_entities(t: Tables) -> DataFrame:
    addresses, entities = _entities(t)
    return op.active_entities(addresses, entities, op.active_claims(t.claims(), t.sources(), AT)).select(
        "address", "entity_id", "entity_type", "address_role"
    )


@query(
    "a09_active_exchange_addresses",
    f"WITH {_ACTIVE}, {_ENT} SELECT address, entity_id, entity_name FROM ea WHERE entity_type = 'exchange'",
)
def active_exchange_addresses(t: Tables) -> DataFrame:
    addresses, entities = _entities(t)
    return op.active_entities(
        addresses, entities, op.active_claims(t.claims(), t.sources(), AT), "exchange"
    ).select("address", "entity_id", "entity_name")


@query(
    "a10_publication_check",
    """WITH r AS (SELECT p_brand AS run_id, cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS bigint) AS n, count(*) AS rows,
        count(*) FILTER (p_partkey % 10 <> 0) AS stored FROM part GROUP BY 1),
    o AS (SELECT p_brand AS run_id, count(*) AS stored FROM part WHERE p_partkey % 10 = 0 GROUP BY 1)
    SELECT run_id, 'claims' AS "table", 'row_count' AS rule, stored AS found FROM r WHERE stored <> rows - n % 3
    UNION ALL SELECT run_id, 'claims', 'known_parent', stored FROM o""",
)
def publication_check(t: Tables) -> DataFrame:
    derived, runs, _ = _runs(t)
    n = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("bigint")
    parent = runs.select(
        "run_id", "revision", F.create_map(F.lit("claims"), F.col("rows") - n % 3).alias("row_counts")
    )
    return op.verify_publication(parent, {"claims": (derived, ["row_key"])})


@query(
    "a11_invalidated_publications",
    f"""WITH {_PUBS} SELECT publication_id, 9 AS revision, 'invalidated' AS status, as_of_block FROM pubs WHERE n % 2 = 0""",
)
def invalidated_publications(t: Tables) -> DataFrame:
    _, _, publications = _runs(t)
    n = F.regexp_extract("publication_id", "([0-9]+)$", 1).cast("bigint")
    return op.invalidate(publications, publications.where(n % 2 == 0), 9).select(
        "publication_id", "revision", "status", "as_of_block"
    )


@query(
    "a12_block_fact_check",
    """WITH b AS (SELECT block_number, transaction_count FROM current_blocks),
    s AS (SELECT block_number, count(*) AS n FROM utxs GROUP BY 1),
    o AS (SELECT block_number, sum(m) AS n, count(*) FILTER (m > 1) AS rep FROM (SELECT block_number, tx_hash, output_index, count(*) AS m FROM outputs GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT block_number, 'transactions' AS "table", transaction_count AS expected, coalesce(n, 0) AS stored, 0 AS repeated FROM b LEFT JOIN s USING (block_number) WHERE transaction_count <> coalesce(n, 0)
    UNION ALL SELECT block_number, 'outputs', 200, cast(coalesce(n, 0) AS bigint), coalesce(rep, 0) FROM b LEFT JOIN o USING (block_number) WHERE coalesce(n, 0) <> 200 OR coalesce(rep, 0) > 0""",
)
def block_fact_check(t: Tables) -> DataFrame:
    current = op.latest(t.blocks(), ["network_id", "block_number"])
    expected = current.select(
        "block_number",
        F.create_map(F.lit("transactions"), F.col("transaction_count").cast("bigint"),
                     F.lit("outputs"), F.lit(200).cast("bigint")).alias("counts"),
    )
    return op.verify_facts(
        expected,
        {"transactions": (t.utxo_txs(), ["tx_hash"]), "outputs": (t.utxo_outputs(), ["tx_hash", "output_index"])},
    )


@query(
    "a12_content_differences",
    """SELECT tx_hash, output_index, value_sats, 1 AS difference FROM outputs WHERE value_sats % 101 = 0
        UNION ALL SELECT tx_hash, output_index, value_sats + 1, -1 FROM outputs WHERE value_sats % 101 = 0""",
)
def content_differences(t: Tables) -> DataFrame:
    expected = t.utxo_outputs().select("tx_hash", "output_index", "value_sats")
    odd = F.when(F.col("value_sats") % 101 == 0, F.col("value_sats") + 1).otherwise(F.col("value_sats"))
    return op.content_differences(expected, expected.withColumn("value_sats", odd))


@query(
    "a13_row_violations",
    """SELECT rule, count(*) AS rows FROM (
        SELECT 'status' AS rule FROM blocks WHERE ingestion_status NOT IN ('processing', 'complete', 'failed', 'orphaned')
        UNION ALL SELECT 'orphan_not_canonical' FROM blocks WHERE ingestion_status = 'orphaned' AND canonical <> 0
        UNION ALL SELECT 'even_height' FROM blocks WHERE block_number % 2 <> 0
        UNION ALL SELECT 'coverage' FROM blocks WHERE trace_coverage <> 1) GROUP BY 1""",
)
def row_violations(t: Tables) -> DataFrame:
    rules = quality.block_rules() | {
        "even_height": F.col("block_number") % 2 == 0, "coverage": F.col("trace_coverage") == 1,
    }
    broken = op.violations(t.blocks(), rules, ["block_number"])
    return broken.groupBy("rule").agg(F.count("*").alias("rows"))


@query(
    "a13_edge_violations",
    """SELECT rule, count(*) AS rows FROM (SELECT 'network' AS rule FROM edges) GROUP BY 1""",
)
def edge_violations(t: Tables) -> DataFrame:
    broken = op.violations(t.edges(), quality.edge_rules(list(ids.NETWORKS)), ["relationship_id"])
    return broken.groupBy("rule").agg(F.count("*").alias("rows"))


_SHAPES = {
    ACCOUNT: contracts.Network("^[tx][0-9]+$", "^(?:native:COIN|token:(?:0|[1-9][0-9]*)(?:/(?:0|[1-9][0-9]*))?)$", 6, ("logs",)),
    UTXO: contracts.Network("^[bu][0-9]+$", "^native:COIN$", 8, ("outputs",)),
}


def _broken(df: DataFrame, table: str, key: str) -> DataFrame:
    found = contracts.with_violations(df, table, {ACCOUNT: _SHAPES[ACCOUNT]})
    return found.select(F.lit(table).alias("table_name"), F.col(key).alias("key"), "revision", F.explode("violations").alias("rule"))


@query(
    "a13_contract_violations",
    """WITH c AS (SELECT 'cl' || s_suppkey AS id, s_suppkey AS k, revision, review_status, network_id FROM (SELECT claims.*, cast(substr(claim_id, 3) AS bigint) AS s_suppkey FROM claims)),
    s AS (SELECT source_id AS id, cast(substr(source_id, 4) AS bigint) AS k, revision FROM sources),
    r AS (SELECT review_id AS id, decision, cast(substr(subject_id, 3) AS bigint) AS k, revision FROM reviews),
    f AS (SELECT failure_id AS id, cast(substr(failure_id, 2) AS bigint) AS k, revision, attempts, status FROM failures)
    SELECT 'intelligence_claims' AS table_name, id AS key, revision, rule FROM (
        SELECT id, revision, 'share:confidence' AS rule FROM c WHERE k % 6 = 1 UNION ALL SELECT id, revision, 'flag:is_exposure_seed' FROM c WHERE k % 9 = 2 UNION ALL SELECT id, revision, 'status:review:review_status' FROM c WHERE k % 10 = 3
        UNION ALL SELECT id, revision, 'refs:evidence_refs' FROM c WHERE k % 7 = 4 OR k % 8 = 5 UNION ALL SELECT id, revision, 'network' FROM c WHERE k % 13 = 6)
    UNION ALL SELECT 'intelligence_sources', id, revision, 'network' FROM s WHERE k % 4 = 1 UNION ALL SELECT 'intelligence_sources', id, revision, 'flag:is_active' FROM s WHERE k % 5 = 2
    UNION ALL SELECT 'intelligence_reviews', id, revision, 'status:decision:decision' FROM r WHERE decision NOT IN ('reject', 'approve', 'revoke') OR k % 5 = 1
    UNION ALL SELECT 'intelligence_reviews', id, revision, 'filled:reviewed_by' FROM r WHERE k % 7 = 2
    UNION ALL SELECT 'ingestion_failures', id, revision, 'status:failure:status' FROM f WHERE k % 9 = 1 OR status = 'pending' UNION ALL SELECT 'ingestion_failures', id, revision, 'positive:attempts' FROM f WHERE k % 11 = 2
    UNION ALL SELECT 'transactions', 't' || o_orderkey, 1, 'hash:tx_hash' FROM orders WHERE o_orderkey % 8 = 1 UNION ALL SELECT 'transactions', 't' || o_orderkey, 1, 'amount:amount_raw' FROM orders WHERE o_orderkey % 12 = 5
    UNION ALL SELECT 'ingestion_benchmarks', 'bench' || event_id, 1, 'json:settings_json' FROM events WHERE event_id % 6 = 5""",
)
def contract_violations(t: Tables) -> DataFrame:
    """Five stored tables and the events' settings, with faults planted by key; every broken rule of every row."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("bigint")
    k = number("claim_id")
    claims = t.claims().withColumns({
        "confidence": F.when(k % 6 == 1, F.lit(float("nan"))).otherwise(F.col("confidence")), "is_exposure_seed": F.when(k % 9 == 2, 2).otherwise(F.col("is_exposure_seed")),
        "review_status": F.when(k % 10 == 3, "maybe").otherwise(F.col("review_status")), "network_id": F.when(k % 13 == 6, "elsewhere").otherwise(F.col("network_id")),
        "evidence_refs": F.when(k % 7 == 4, F.array(F.lit("tx:1"), F.lit("no colon"))).when(k % 8 == 5, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit("note:fine"))),
    })
    k = number("source_id")
    sources = t.sources().withColumns({"network_id": F.when(k % 4 != 1, ACCOUNT), "is_active": F.when(k % 5 != 2, F.col("is_active"))})
    k = number("subject_id")
    named = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "revoke", "revoked")
    reviews = t.reviews().withColumns({"network_id": F.lit(ACCOUNT), "decision": F.when(k % 5 != 1, named).otherwise(F.col("decision")), "reviewed_by": F.when(k % 7 != 2, F.col("reviewed_by")).otherwise("")})
    k = number("failure_id")
    failures = t.failures().withColumns({"network_id": F.lit(ACCOUNT), "status": F.when(k % 9 == 1, "lost").otherwise(F.col("status")), "attempts": F.when(k % 11 == 2, 0).otherwise(F.col("attempts"))})
    k = number("tx_hash")
    txs = t.account_txs().withColumns({"key": F.col("tx_hash"), "block_hash": F.lit("b"), "amount_raw": F.when(k % 12 == 5, "007").otherwise("7"), "revision": F.lit(1)}).withColumn("tx_hash", F.when(k % 8 == 1, "no hash").otherwise(F.col("tx_hash")))
    settings = t.raw("events").select(
        F.lit(ACCOUNT).alias("network_id"), F.concat(F.lit("bench"), "event_id").alias("benchmark_id"), F.when(F.col("event_id") % 6 == 5, F.lit("{open")).otherwise(F.col("props")).alias("settings_json"), F.lit(1).alias("revision"),
    )
    parts = [
        _broken(claims, "intelligence_claims", "claim_id"), _broken(sources, "intelligence_sources", "source_id"), _broken(reviews, "intelligence_reviews", "review_id"),
        _broken(failures, "ingestion_failures", "failure_id"), _broken(txs, "transactions", "key"), _broken(settings, "ingestion_benchmarks", "benchmark_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "a13_ledger_violations",
    """WITH i AS (SELECT tx_hash, input_index AS place, revision FROM inputs), o AS (SELECT tx_hash, output_index AS place, revision, value_sats FROM outputs)
    SELECT 'bitcoin_inputs' AS table_name, tx_hash AS key, place, revision, rule FROM (
        SELECT *, 'hash:prev_tx_hash' AS rule FROM i WHERE place % 71 = 4 UNION ALL SELECT *, 'hash:block_hash' FROM i WHERE place % 67 = 3 UNION ALL SELECT *, 'filled:block_hash' FROM i WHERE place % 67 = 3
        UNION ALL SELECT *, 'network' FROM i WHERE place % 61 = 2 UNION ALL SELECT *, 'kind:outputs' FROM i WHERE place % 61 = 2 OR place % 59 = 1
        UNION ALL SELECT *, unnest(['hash:block_hash', 'hash:tx_hash', 'hash:prev_tx_hash']) FROM i WHERE (place % 61 = 2 OR place % 59 = 1)) GROUP BY ALL
    UNION ALL SELECT 'bitcoin_outputs', tx_hash, place, revision, rule FROM (
        SELECT *, 'sats:value_sats' AS rule FROM o WHERE place % 97 = 5 AND value_sats > 0 UNION ALL SELECT *, 'bytes:script_hex' FROM o WHERE place % 89 = 3
        UNION ALL SELECT *, 'flag:coinbase' FROM o WHERE place % 83 = 2 UNION ALL SELECT *, 'filled:commit_id' FROM o WHERE place % 79 = 1)""",
)
def ledger_violations(t: Tables) -> DataFrame:
    """Inputs and outputs of the unspent-output network with faults planted by index; every broken rule of every row."""
    at = F.col("input_index")
    inputs = t.utxo_inputs().withColumns({
        "prev_tx_hash": F.when(at % 71 == 4, "none").otherwise(F.col("prev_tx_hash")), "block_hash": F.when(at % 67 == 3, "").otherwise(F.col("block_hash")),
        "network_id": F.when(at % 61 == 2, "elsewhere").when(at % 59 == 1, ACCOUNT).otherwise(F.col("network_id")),
    }).withColumn("place", at)
    at = F.col("output_index")
    outputs = t.utxo_outputs().withColumns({
        "value_sats": F.when(at % 97 == 5, F.col("value_sats") + contracts.MOST_SATS).otherwise(F.col("value_sats")), "script_hex": F.when(at % 89 == 3, "6aZ").otherwise(F.col("script_hex")),
        "coinbase": F.when(at % 83 == 2, 2).otherwise(F.col("coinbase")), "commit_id": F.when(at % 79 != 1, F.col("commit_id")),
    }).withColumn("place", at)
    parts = [contracts.with_violations(df, table, _SHAPES).select(F.lit(table).alias("table_name"), F.col("tx_hash").alias("key"), "place", "revision", F.explode("violations").alias("rule"))
             for df, table in ((inputs, "bitcoin_inputs"), (outputs, "bitcoin_outputs"))]
    return parts[0].unionByName(parts[1])


@query(
    "a13_event_and_asset_violations",
    """SELECT 'evm_logs' AS table_name, 'x' || event_id AS key, rule FROM (
        SELECT event_id, 'kind:logs' AS rule FROM events WHERE event_id % 9 = 4 UNION ALL SELECT event_id, 'hash:tx_hash' FROM events WHERE event_id % 9 = 4 OR event_id % 8 = 1
        UNION ALL SELECT event_id, 'hash:block_hash' FROM events WHERE event_id % 9 = 4 UNION ALL SELECT event_id, 'positive:revision' FROM events WHERE event_id % 13 = 6)
    UNION ALL SELECT 'tron_contracts', 'x' || event_id, unnest(CASE WHEN event_id % 6 = 5 THEN ['kind:contracts', 'json:payload_json'] ELSE ['kind:contracts'] END) FROM events
    UNION ALL SELECT 'asset_metadata', 'm' || p_partkey, rule FROM (
        SELECT p_partkey, 'asset:asset_id' AS rule FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 = 2 OR p_partkey % 10 <> 0 AND p_partkey % 7 <> 2 AND p_partkey % 17 = 3
        UNION ALL SELECT p_partkey, 'native_decimals:asset_id:decimals' FROM part WHERE p_partkey % 20 = 0
        UNION ALL SELECT p_partkey, 'reviewed:review_status:reviewed_by' FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 3 <> 0
        UNION ALL SELECT p_partkey, 'refs:evidence_refs' FROM part WHERE p_partkey % 11 = 7)""",
)
def event_and_asset_violations(t: Tables) -> DataFrame:
    """Logs and contract calls from the events and asset records from the parts, with faults planted by key."""
    k = F.col("event_id")
    rows = t.raw("events").select(
        F.concat(F.lit("x"), k).alias("key"), F.when(k % 9 == 4, UTXO).otherwise(ACCOUNT).alias("network_id"), F.concat(F.lit("x"), k).alias("block_hash"), F.lit("k").alias("commit_id"),
        F.when(k % 13 != 6, 1).otherwise(0).alias("revision"), F.concat(F.when(k % 8 == 1, F.lit("X")).otherwise("x"), k).alias("tx_hash"),
    )
    # no known network carries contract calls here, so each row breaks that rule
    calls = t.raw("events").select(
        F.concat(F.lit("x"), k).alias("key"), F.lit(ACCOUNT).alias("network_id"), F.concat(F.lit("x"), k).alias("block_hash"), F.lit("k").alias("commit_id"),
        F.lit(1).alias("revision"), F.concat(F.lit("x"), k).alias("tx_hash"), F.when(k % 6 == 5, F.lit("{open")).otherwise(F.col("props")).alias("payload_json"),
    )
    k = F.col("p_partkey")
    assets = t.raw("part").select(
        F.concat(F.lit("m"), k).alias("key"), F.lit(ACCOUNT).alias("network_id"),
        F.when(k % 10 == 0, "native:COIN").when(k % 7 == 2, F.concat(F.lit("token:0"), k)).when(k % 17 == 3, F.concat(F.lit("token:1/"), F.repeat(F.lit("9"), 78))).otherwise(F.concat(F.lit("token:"), k)).alias("asset_id"),
        F.when(k % 20 != 0, 6).alias("decimals"), F.when(k % 3 == 0, "pending").otherwise("approved").alias("review_status"), F.when(k % 4 != 1, "lead").otherwise("").alias("reviewed_by"),
        F.when(k % 11 == 7, F.array(F.lit("Bad ref"))).otherwise(F.array(F.lit("tx:1"))).alias("evidence_refs"), F.lit(1).alias("revision"),
    )
    parts = [contracts.with_violations(df, table, _SHAPES).select(F.lit(table).alias("table_name"), "key", F.explode("violations").alias("rule"))
             for df, table in ((rows, "evm_logs"), (calls, "tron_contracts"), (assets, "asset_metadata"))]
    return reduce(DataFrame.unionByName, parts)


@query(
    "a14_rollback_tombstones",
    "SELECT block_number, block_hash, 3 AS revision, 0 AS canonical, 'orphaned' AS ingestion_status FROM canonical_blocks WHERE block_number > 12",
)
def rollback_tombstones(t: Tables) -> DataFrame:
    return op.rollback(t.blocks(), canonical_blocks(t), 12, 3).select(
        "block_number", "block_hash", "revision", "canonical", "ingestion_status"
    )


@query("a16_table_digest")
def table_digest(t: Tables) -> DataFrame:
    return op.table_digest(t.raw("lineitem"))


@query(
    "a16_digest_equal",
    "SELECT count(*) AS rows, true AS same FROM lineitem",
)
def digest_equal(t: Tables) -> DataFrame:
    """The digest does not depend on row order."""
    a = op.table_digest(t.raw("lineitem"))
    b = op.table_digest(t.raw("lineitem").repartition(7, "l_suppkey"))
    parts = ["rows", "sum_digest", "low_digest", "xor_digest"]
    both = a.unionByName(b)
    return both.agg(
        F.max("rows").alias("rows"), (F.countDistinct(F.struct(*parts)) == 1).alias("same")
    )


@query(
    "a17_projected_events",
    """SELECT event_id, user_id, event_type, cast(json_extract_string(props, '$.k') AS bigint) AS k,
        coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events""",
)
def projected_events(t: Tables) -> DataFrame:
    return t.raw("events").select(
        "event_id", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("missing"),
    )


@query(
    "a17_projected_edges",
    """SELECT relationship_id, split_part(asset_id, ':', 2) AS asset_number, coalesce(token_id, '') AS token_id,
        coalesce(from_address, '') AS from_address, cast(amount AS varchar) AS amount FROM edges""",
)
def projected_edges(t: Tables) -> DataFrame:
    return t.edges().select(
        "relationship_id", F.element_at(F.split("asset_id", ":"), -1).alias("asset_number"),
        F.coalesce("token_id", F.lit("")).alias("token_id"),
        F.coalesce("from_address", F.lit("")).alias("from_address"), F.col("amount_raw").alias("amount"),
    )


def _evidence_transactions(t: Tables) -> DataFrame:
    """Orders as transactions whose evidence is JSON: every ninth has none, every eleventh a nonce that is no number."""
    key = F.col("o_orderkey")
    stored = F.to_json(F.struct(
        F.when(key % 3 == 0, F.concat(F.lit("0xc"), F.col("o_custkey"))).alias("contract_address"),
        F.when(key % 11 == 0, F.lit("many")).otherwise((key % 1000).cast("string")).alias("nonce"), (key % 3).alias("transaction_type"),
        F.col("o_orderpriority").alias("input_data"), (key % 90_000 + 21_000).alias("gas_limit"), (key % 21_000).alias("gas_used"),
    ))
    facts = t.account_txs().select("network_id", "tx_hash", "block_number", "block_timestamp_unix_ms", "transaction_index", "from_address", "to_address", "fee_raw")
    own = t.raw("orders").select(
        F.concat(F.lit("t"), key).alias("tx_hash"), F.when(key % 9 != 4, stored).alias("raw_evidence_json"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").alias("status"),
        F.when(key % 5 != 0, F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")).alias("amount_raw"),
    )
    return facts.join(own, "tx_hash").withColumn("to_address", F.when(F.col("status").isNotNull(), F.col("to_address")))


@query(
    "a17_projected_transactions",
    """SELECT 't' || o_orderkey AS tx_hash, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'S' || (o_custkey % 50) ELSE '' END AS to_address, CASE WHEN o_orderkey % 5 <> 0 THEN cast(cast(round(o_totalprice * 100) AS bigint) AS varchar) ELSE '0' END AS value,
        CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS status, CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END AS status_known,
        CASE WHEN o_orderkey % 9 <> 4 AND o_orderkey % 3 = 0 THEN '0xc' || o_custkey ELSE '' END AS contract_address, CASE WHEN o_orderkey % 9 <> 4 AND o_orderkey % 11 <> 0 THEN o_orderkey % 1000 ELSE 0 END AS nonce,
        CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey % 3 ELSE 0 END AS transaction_type, '' AS input_selector, CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey % 90000 + 21000 ELSE 0 END AS gas_limit, CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey % 21000 ELSE 0 END AS gas_used FROM orders""",
)
def projected_transactions(t: Tables) -> DataFrame:
    return projections.project_transactions(_evidence_transactions(t)).select(
        "tx_hash", "to_address", "value", "status", "status_known", "contract_address", "nonce", "transaction_type", "input_selector", "gas_limit", "gas_used"
    )


@query(
    "a17_split_assets",
    """SELECT relationship_id, 'acct:1/' || CASE WHEN transfer_type = 'native_transfer' THEN 'native:ac' WHEN token_id IS NOT NULL THEN 'erc721:' || asset_id ELSE 'erc20:' || asset_id END AS asset_id,
        CASE WHEN transfer_type = 'native_transfer' THEN 'native' WHEN token_id IS NOT NULL THEN 'erc721' ELSE 'erc20' END AS asset_standard, CASE WHEN transfer_type = 'native_transfer' THEN 'AC' ELSE asset_id END AS asset_contract,
        CASE WHEN transfer_type <> 'native_transfer' AND token_id IS NOT NULL THEN token_id ELSE '' END AS asset_item, coalesce(token_id, '') AS token_id, cast(amount AS varchar) AS amount
        FROM (SELECT relationship_id, transfer_type, token_id, amount, '0x' || replace(asset_id, 'asset:', 'a') AS asset_id FROM edges)""",
)
def split_assets(t: Tables) -> DataFrame:
    """Asset ids of three standards, single items among them."""
    contract = F.concat(F.lit("0x"), F.regexp_replace("asset_id", "asset:", "a"))
    named = F.when(F.col("transfer_type") == "native_transfer", "native:AC").when(
        F.col("token_id").isNotNull(), F.concat(F.lit("erc721:"), contract, F.lit("/"), "token_id")
    ).otherwise(F.concat(F.lit("erc20:"), contract))
    return projections.project_edges(t.edges().withColumn("asset_id", named)).select("relationship_id", "asset_id", "asset_standard", "asset_contract", "asset_item", "token_id", "amount")


@query(
    "a17_event_fields",
    """SELECT event_id, subject_id AS subject_address, '' AS amount_out, cast(amount AS varchar) AS amount_in, CASE WHEN starts_with(event_type, 'bridge') THEN 'outbound' ELSE '' END AS bridge_direction, 'key ' || tx_hash || ' "q"' AS correlation_key, '' AS remote_asset FROM sem""",
)
def event_fields(t: Tables) -> DataFrame:
    stored = F.to_json(F.struct(
        F.when(F.col("event_type").startswith("bridge"), "outbound").alias("bridge_direction"), F.concat(F.lit("key "), "tx_hash", F.lit(' "q"')).alias("correlation_key"),
    ))
    events = t.semantic_events()
    amount = F.col("amount_raw")
    rows = events.withColumns({"raw_evidence_json": stored, "amount_in": amount, "amount_out": F.lit(None).cast("string")})
    return projections.project_events(rows).select("event_id", "subject_address", "amount_out", "amount_in", "bridge_direction", "correlation_key", "remote_asset")


@query(
    "a18_common_ancestor",
    """WITH r AS (SELECT block_number, CASE WHEN block_number > 20 THEN 'z' || block_number ELSE block_hash END AS block_hash FROM current_blocks)
    SELECT l.network_id, max(l.block_number) AS block_number, 'b' || max(l.block_number) AS block_hash
    FROM current_blocks l JOIN r USING (block_number, block_hash) WHERE block_number >= (SELECT max(block_number) - 100000 FROM current_blocks) GROUP BY 1""",
)
def common_ancestor(t: Tables) -> DataFrame:
    local = op.latest(t.blocks(), ["network_id", "block_number"])
    moved = F.when(F.col("block_number") > 20, F.concat(F.lit("z"), F.col("block_number").cast("string")))
    remote = local.withColumn("block_hash", F.coalesce(moved, "block_hash"))
    return op.common_ancestor(local, remote, 100_000)


# stored tables -----------------------------------------------------------------


def _folder(t: Tables, label: str) -> str:
    return f"{shared_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "a15_stored_edges",
    "SELECT relationship_id, tx_hash, block_number, cast(amount AS varchar) AS amount_raw, block_number // 100000 AS block_bucket FROM edges WHERE block_number BETWEEN 13950000 AND 14300000",
)
def stored_edges(t: Tables) -> DataFrame:
    """Two appends of partitioned files with a bloom filter, read back by a range of blocks and its partitions."""
    path = _folder(t, "stored-edges")
    edges = files.with_block_bucket(t.edges().select("relationship_id", "tx_hash", "block_number", "amount_raw"))
    early = F.col("block_number") < 14_100_000
    files.write_table(edges.where(early), path, ["block_bucket"], bloom=["tx_hash"])
    files.write_table(edges.where(~early), path, ["block_bucket"], bloom=["tx_hash"])
    low, high = 13_950_000, 14_300_000
    rows = files.read_table(t.spark, path, edges.schema)
    return rows.where(F.col("block_bucket").between(low // 100_000, high // 100_000) & F.col("block_number").between(low, high))


@query("a15_labels_csv", "SELECT address, entity_id, exchange_name AS entity_name, 'exchange' AS entity_type, 'list, \"' || address_role || '\"' AS source_reference, false AS bad FROM exchanges")
def labels_csv(t: Tables) -> DataFrame:
    """Labels through CSV with a header, quotes and commas."""
    path = _folder(t, "labels-csv")
    labels = t.exchanges().select("address", "entity_id", F.col("exchange_name").alias("entity_name"), F.lit("exchange").alias("entity_type"), F.concat(F.lit('list, "'), "address_role", F.lit('"')).alias("source_reference"))
    labels.write.option("header", "true").option("escape", '"').csv(path)
    return files.read_labels_csv(t.spark, path).withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


@query(
    "a15_claims_json",
    "SELECT claim_id, address, entity_type, confidence, risk_level, review_status, valid_to_unix_ms, revision, 'ev1,ev' || claim_id AS evidence FROM claims",
)
def claims_json(t: Tables) -> DataFrame:
    """Claims as one JSON object a line, read with the fixed schema."""
    path = _folder(t, "claims-json")
    t.claims().withColumn("evidence_refs", F.array(F.lit("ev1"), F.concat(F.lit("ev"), "claim_id"))).write.json(path)
    read = files.read_claims(t.spark, path)
    return read.select("claim_id", "address", "entity_type", "confidence", "risk_level", "review_status", "valid_to_unix_ms", "revision", F.array_join("evidence_refs", ",").alias("evidence"))

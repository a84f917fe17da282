"""Queries over neighbourhoods, paths and exposure (section H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.operators import activity, exposure, matching
from chainweft.operators import graph as op
from chainweft.operators.visibility import latest
from chainweft.plans.registry import ZERO, query
from chainweft.sources.tables import Tables

AT = 1_100_000_000_000
UTXO_AT = 1_400_000_000_000


def current_claims(t: Tables) -> DataFrame:
    return latest(t.claims(), ["network_id", "claim_id"])


def seed_wallets(t: Tables) -> DataFrame:
    return current_claims(t).where(F.col("is_exposure_seed") == 1).select("address", "claim_id", "risk_level")


def _asked(t: Tables) -> DataFrame:
    """Each seed supplier with the exchange three keys on, where there is one."""
    key = F.regexp_extract("address", "([0-9]+)$", 1).cast("bigint")
    near = seed_wallets(t).select(key.alias("a"), (key + 3).alias("b")).withColumn(
        "address", F.concat(F.lit("S"), F.col("b").cast("string"))
    )
    return near.join(t.exchanges().select("address"), "address", "left_semi").select("a", "b")


def _utxo_name(key: Column) -> Column:
    family = F.when(key % 3 == 0, "1").when(key % 3 == 1, "3").otherwise("bc1p")
    return F.when(key % 16 != 15, F.concat(family, F.lit("S"), key.cast("string")))


_UNAME = "CASE WHEN {k} % 16 <> 15 THEN (CASE {k} % 3 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE 'bc1p' END) || 'S' || {k} END"


#: How far above a seed's key the exchanges of the wider requests lie.
_FURTHER = (3, 13, 23, 33, 43, 8, 18, 28, 38, 48)


def _more_pairs(t: Tables) -> DataFrame:
    """Each seed supplier with the exchanges at several distances above it, both ways round."""
    key = F.regexp_extract("address", "([0-9]+)$", 1).cast("bigint")
    near = seed_wallets(t).select(key.alias("a"), F.explode(F.array(*map(F.lit, _FURTHER))).alias("d")).select("a", (F.col("a") + F.col("d")).alias("b"))
    asked = near.withColumn("address", F.concat(F.lit("S"), F.col("b").cast("string"))).join(t.exchanges().select("address"), "address", "left_semi").select("a", "b")
    return asked.unionByName(asked.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _pairs(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    return _asked(t).select(name("a").alias("source"), name("b").alias("target"))


_CUR = "cur AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1), seed AS (SELECT * FROM cur WHERE is_exposure_seed = 1)"
_PAIRS = f"""{_CUR}, asked AS (SELECT cast(substr(address, 2) AS bigint) AS a, cast(substr(address, 2) AS bigint) + 3 AS b FROM seed
        WHERE 'S' || (cast(substr(address, 2) AS bigint) + 3) IN (SELECT address FROM exchanges)),
    pairs AS (SELECT 'S' || a AS source, 'S' || b AS target FROM asked)"""


@query(
    "h01_neighbourhood",
    f"""WITH {_CUR}, a AS (SELECT relationship_id, from_address AS node, to_address AS next FROM edges UNION ALL SELECT relationship_id, to_address, from_address FROM edges),
    l1 AS (SELECT DISTINCT s.address AS focus, relationship_id, next FROM seed s JOIN a ON node = s.address),
    f2 AS (SELECT DISTINCT focus, next AS node FROM l1 WHERE next <> focus AND next <> {ZERO}),
    l2 AS (SELECT DISTINCT focus, a.relationship_id FROM f2 JOIN a USING (node))
    SELECT focus, relationship_id, min(d) AS depth FROM (SELECT focus, relationship_id, 1 AS d FROM l1 UNION ALL SELECT focus, relationship_id, 2 FROM l2) GROUP BY 1, 2""",
)
def neighbourhood(t: Tables) -> DataFrame:
    return op.neighbourhood(t.edges(), seed_wallets(t), 2)


def _flat(found: DataFrame) -> DataFrame:
    return found.select("source", "target", "hop_count", F.array_join("edge_ids", ",").alias("edge_ids"))


@query(
    "h02_simple_paths",
    f"""WITH RECURSIVE {_PAIRS}, w AS (
        SELECT source, target, to_address AS node, 1 AS hop_count, [source, to_address] AS nodes, relationship_id AS edge_ids FROM pairs JOIN edges ON from_address = source AND to_address <> source AND to_address <> {ZERO}
        UNION ALL SELECT source, target, e.to_address, hop_count + 1, list_append(nodes, e.to_address), edge_ids || ',' || relationship_id FROM w JOIN edges e ON e.from_address = w.node
            WHERE hop_count < 3 AND w.node <> target AND e.to_address <> {ZERO} AND NOT list_contains(nodes, e.to_address))
    SELECT source, target, hop_count, edge_ids FROM w WHERE node = target""",
)
def simple_paths(t: Tables) -> DataFrame:
    return _flat(op.paths(t.edges(), _pairs(t), 3))


@query(
    "h02_first_paths",
    f"""WITH RECURSIVE {_PAIRS}, w AS (
        SELECT source, target, to_address AS node, 1 AS hop_count, [source, to_address] AS nodes, [relationship_id] AS edge_ids FROM pairs JOIN edges ON from_address = source AND to_address <> source AND to_address <> {ZERO}
        UNION ALL SELECT source, target, e.to_address, hop_count + 1, list_append(nodes, e.to_address), list_append(edge_ids, relationship_id) FROM w JOIN edges e ON e.from_address = w.node
            WHERE hop_count < 2 AND w.node <> target AND e.to_address <> {ZERO} AND NOT list_contains(nodes, e.to_address))
    SELECT source, target, array_to_string(edge_ids, ',') AS edge_ids, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hop_count, edge_ids) AS rank FROM w WHERE node = target) WHERE rank <= 25""",
)
def first_paths(t: Tables) -> DataFrame:
    ranked = op.rank_paths(op.paths(t.edges(), _pairs(t), 2, first=25), 25)
    return ranked.select("source", "target", F.array_join("edge_ids", ",").alias("edge_ids"), "rank")


_MORE = f"""{_CUR}, near AS (SELECT cast(substr(address, 2) AS bigint) AS a, cast(substr(address, 2) AS bigint) + unnest({list(_FURTHER)}) AS b FROM seed),
    one AS (SELECT a, b FROM near WHERE 'S' || b IN (SELECT address FROM exchanges)), asked AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
    pairs AS (SELECT 'S' || a AS source, 'S' || b AS target FROM asked)"""


@query(
    "h03_ordered_paths_wide",
    f"""WITH RECURSIVE {_MORE}, w AS (
        SELECT source, target, to_address AS node, 1 AS hop_count, [source, to_address] AS nodes, relationship_id AS edge_ids, asset_id, coalesce(token_id, '') AS token, tx_hash, block_number AS b, transaction_index AS x
            FROM pairs JOIN edges ON from_address = source AND to_address <> source AND to_address <> {ZERO}
        UNION ALL SELECT source, target, e.to_address, hop_count + 1, list_append(nodes, e.to_address), edge_ids || ',' || relationship_id, e.asset_id, coalesce(e.token_id, ''), e.tx_hash, e.block_number, e.transaction_index
            FROM w JOIN edges e ON e.from_address = w.node AND e.asset_id = w.asset_id AND coalesce(e.token_id, '') = w.token
            WHERE hop_count < 6 AND w.node <> target AND e.to_address <> {ZERO} AND NOT list_contains(nodes, e.to_address) AND e.tx_hash <> w.tx_hash
              AND (e.block_number > w.b OR (e.block_number = w.b AND e.transaction_index > w.x)))
    SELECT source, target, hop_count, edge_ids FROM w WHERE node = target""",
)
def ordered_paths_wide(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    pairs = _more_pairs(t).select(name("a").alias("source"), name("b").alias("target"))
    return _flat(op.ordered_paths(t.edges(), pairs, 6))


@query(
    "h04_typed_paths_wide",
    f"""WITH RECURSIVE {_MORE}, up AS (SELECT DISTINCT {_UNAME.format(k="a")} AS source, {_UNAME.format(k="b")} AS target FROM asked),
    leg AS (SELECT DISTINCT coalesce(address, 'script ' || script_hex) AS who, tx_hash FROM inputs), got AS (SELECT DISTINCT tx_hash, coalesce(address, 'script ' || script_hex) AS who FROM outputs),
    p2 AS (SELECT source, target, i.who AS w0, i.tx_hash AS t1 FROM up JOIN leg i ON i.who = source JOIN got o ON o.tx_hash = i.tx_hash AND o.who = target WHERE source <> target),
    p4 AS (SELECT source, target, i1.tx_hash AS t1, o1.who AS mid, i2.tx_hash AS t2 FROM up JOIN leg i1 ON i1.who = source JOIN got o1 ON o1.tx_hash = i1.tx_hash AND o1.who <> source AND o1.who <> target
        JOIN leg i2 ON i2.who = o1.who AND i2.tx_hash <> i1.tx_hash JOIN got o2 ON o2.tx_hash = i2.tx_hash AND o2.who = target WHERE source <> target)
    SELECT source, target, 2 AS hop_count, count(*) AS ways FROM p2 GROUP BY 1, 2 UNION ALL SELECT source, target, 4, count(*) FROM p4 GROUP BY 1, 2""",
)
def typed_paths_wide(t: Tables) -> DataFrame:
    """Different ways over one or two transactions: several legs of one way count once."""
    edges = matching.utxo_edges(t.utxo_inputs(), t.utxo_outputs())
    asked = _more_pairs(t).select(_utxo_name(F.col("a")).alias("source"), _utxo_name(F.col("b")).alias("target"))
    found = op.typed_paths(edges.select("from_subject_id", "to_subject_id"), asked.dropna(), 4)
    return found.groupBy("source", "target", "hop_count").agg(F.count("*").alias("ways"))


@query(
    "h03_ordered_paths",
    f"""WITH RECURSIVE {_PAIRS}, w AS (
        SELECT source, target, to_address AS node, 1 AS hop_count, [source, to_address] AS nodes, relationship_id AS edge_ids, asset_id, coalesce(token_id, '') AS token, tx_hash, block_number AS b, transaction_index AS x
            FROM pairs JOIN edges ON from_address = source AND to_address <> source AND to_address <> {ZERO}
        UNION ALL SELECT source, target, e.to_address, hop_count + 1, list_append(nodes, e.to_address), edge_ids || ',' || relationship_id, e.asset_id, coalesce(e.token_id, ''), e.tx_hash, e.block_number, e.transaction_index
            FROM w JOIN edges e ON e.from_address = w.node AND e.asset_id = w.asset_id AND coalesce(e.token_id, '') = w.token
            WHERE hop_count < 4 AND w.node <> target AND e.to_address <> {ZERO} AND NOT list_contains(nodes, e.to_address) AND e.tx_hash <> w.tx_hash
              AND (e.block_number > w.b OR (e.block_number = w.b AND e.transaction_index > w.x)))
    SELECT source, target, hop_count, edge_ids FROM w WHERE node = target""",
)
def ordered_paths(t: Tables) -> DataFrame:
    return _flat(op.ordered_paths(t.edges(), _pairs(t), 4))


@query(
    "h03_ordered_paths_back",
    f"""WITH RECURSIVE {_PAIRS}, w AS (
        SELECT source, target, from_address AS node, 1 AS hop_count, [source, from_address] AS nodes, relationship_id AS edge_ids, asset_id, coalesce(token_id, '') AS token, tx_hash, block_number AS b, transaction_index AS x
            FROM pairs JOIN edges ON to_address = source AND from_address <> source AND from_address <> {ZERO}
        UNION ALL SELECT source, target, e.from_address, hop_count + 1, list_append(nodes, e.from_address), edge_ids || ',' || relationship_id, e.asset_id, coalesce(e.token_id, ''), e.tx_hash, e.block_number, e.transaction_index
            FROM w JOIN edges e ON e.to_address = w.node AND e.asset_id = w.asset_id AND coalesce(e.token_id, '') = w.token
            WHERE hop_count < 2 AND w.node <> target AND e.from_address <> {ZERO} AND NOT list_contains(nodes, e.from_address) AND e.tx_hash <> w.tx_hash
              AND (e.block_number < w.b OR (e.block_number = w.b AND e.transaction_index < w.x)))
    SELECT source, target, hop_count, edge_ids FROM w WHERE node = target""",
)
def ordered_paths_back(t: Tables) -> DataFrame:
    return _flat(op.ordered_paths(t.edges(), _pairs(t), 2, "incoming"))


def utxo_claims(t: Tables) -> DataFrame:
    """Label claims carried over to the unspent-output addresses of the same suppliers."""
    claims = current_claims(t)
    key = F.regexp_extract("address", "([0-9]+)$", 1).cast("bigint")
    return claims.withColumn("address", _utxo_name(key)).where(F.col("address").isNotNull())


@query(
    "h04_typed_paths",
    f"""WITH {_PAIRS}, up AS (SELECT {_UNAME.format(k="a")} AS source, {_UNAME.format(k="b")} AS target FROM asked)
    SELECT source, target, 2 AS hop_count, count(*) AS paths FROM up JOIN inputs i ON i.address = source JOIN outputs o ON o.tx_hash = i.tx_hash AND o.address = target GROUP BY 1, 2""",
)
def typed_paths(t: Tables) -> DataFrame:
    """Address to transaction to address, for every asked pair."""
    edges = matching.utxo_edges(t.utxo_inputs(), t.utxo_outputs())
    asked = _asked(t).select(_utxo_name(F.col("a")).alias("source"), _utxo_name(F.col("b")).alias("target"))
    found = op.typed_paths(edges, asked.dropna(), 2)
    return found.groupBy("source", "target", "hop_count").agg(F.count("*").alias("paths"))


@query(
    "h05_transaction_neighbourhood",
    """WITH x AS (SELECT wallet, tx_hash, max((block_number, transaction_index)) AS pos FROM wallet_edges GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY pos DESC, tx_hash DESC) AS k FROM x)
    SELECT wallet, tx_hash, relationship_id FROM r JOIN edges USING (tx_hash) WHERE k <= 3""",
)
def transaction_neighbourhood(t: Tables) -> DataFrame:
    return op.tx_neighbourhood(t.edges(), 3).select("wallet", "tx_hash", "relationship_id")


_SVC = "svc AS (SELECT DISTINCT address FROM cur WHERE lower(entity_type) IN ('exchange', 'custodian', 'bridge', 'dex', 'mixer'))"
_MOVES = f"""mv AS (SELECT relationship_id, tx_hash, block_number, transaction_index, block_timestamp_unix_ms AS ms, asset_id, coalesce(token_id, '') AS token, amount, 'RECEIVED_FROM_SEED' AS direction, from_address AS node, to_address AS next
        FROM edges WHERE amount > 0 AND from_address <> {ZERO} AND to_address <> {ZERO}
        UNION ALL SELECT relationship_id, tx_hash, block_number, transaction_index, block_timestamp_unix_ms, asset_id, coalesce(token_id, ''), amount, 'SENT_TO_SEED', to_address, from_address
        FROM edges WHERE amount > 0 AND from_address <> {ZERO} AND to_address <> {ZERO})"""


@query(
    "h06_exposure_capped",
    f"""WITH {_CUR}, {_SVC}, {_MOVES}, tot AS (SELECT direction, node, asset_id, sum(amount) AS total FROM mv GROUP BY 1, 2, 3),
    st AS (SELECT mv.*, least(amount::double / total::double, 1.0::double) AS sh, exp((-0.6931471805599453::double * (({AT} - ms)::double / 86400000.0::double)) / 365.0::double) AS w FROM mv JOIN tot USING (direction, node, asset_id)),
    c1 AS (SELECT seed.claim_id AS seed_id, risk_level, direction, node, next, asset_id, [relationship_id] AS rels, block_number AS b, sh, w, risk_level / 100.0::double * 0.65::double * sh * w AS score FROM seed JOIN st ON node = seed.address WHERE next <> node),
    h1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY seed_id, direction, next, asset_id ORDER BY score DESC, rels) <= 3),
    c2 AS (SELECT h1.seed_id, h1.risk_level, direction, h1.node AS origin, st.next, asset_id, list_append(h1.rels, st.relationship_id) AS rels, least(h1.sh, st.sh) AS sh, least(h1.w, st.w) AS w,
        h1.risk_level / 100.0::double * (0.65::double * 0.65::double) * least(h1.sh, st.sh) * least(h1.w, st.w) AS score
        FROM h1 JOIN (SELECT direction, node AS via, next, asset_id, relationship_id, block_number, sh, w FROM st) st ON st.direction = h1.direction AND st.via = h1.next AND st.asset_id = h1.asset_id
        WHERE h1.next NOT IN (SELECT address FROM svc) AND st.next <> h1.node AND st.next <> h1.next AND CASE WHEN h1.direction = 'RECEIVED_FROM_SEED' THEN st.block_number > h1.b ELSE st.block_number < h1.b END),
    h2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY seed_id, direction, next, asset_id ORDER BY score DESC, rels) <= 3)
    SELECT seed_id, direction, subject_id, asset_id, hop_count, array_to_string(rels, ',') AS relationship_ids, round(score, 6) AS exposure_score, CASE WHEN subject_id IN (SELECT address FROM svc) THEN 1 ELSE 0 END AS service_mediated
    FROM (SELECT seed_id, direction, next AS subject_id, asset_id, 1 AS hop_count, rels, score FROM h1 UNION ALL SELECT seed_id, direction, next, asset_id, 2, rels, score FROM h2)""".replace("h1.seed_id, h1.risk_level, direction, h1.node AS origin, st.next, asset_id,", "h1.seed_id, h1.risk_level, h1.direction, h1.node AS origin, st.next, h1.asset_id,"),
)
def exposure_capped(t: Tables) -> DataFrame:
    claims = current_claims(t)
    seeds = claims.where(F.col("is_exposure_seed") == 1).select(
        F.col("claim_id").alias("seed_id"), "address", "risk_level"
    )
    found = exposure.expose_capped(
        t.edges(), seeds, op.service_addresses(claims), AT, exposure.CappedOptions(max_hops=2)
    )
    return found.select(
        "seed_id", "direction", "subject_id", "asset_id", "hop_count",
        F.array_join("relationship_ids", ",").alias("relationship_ids"),
        F.round("exposure_score", 6).alias("exposure_score"), "service_mediated",
    )


def _capped_sql(hops: int, keep: int = 3) -> str:
    """The capped rule hop by hop: kept paths ``h1`` .. of every hop."""
    later = "CASE WHEN st.direction = 'RECEIVED_FROM_SEED' THEN st.block_number > h.b ELSE st.block_number < h.b END"
    parts = [f"""{_MOVES}, tot AS (SELECT direction, node, asset_id, sum(amount) AS total FROM mv GROUP BY 1, 2, 3),
    st AS (SELECT mv.*, least(amount::double / total::double, 1.0::double) AS sh, exp((-0.6931471805599453::double * (({AT} - ms)::double / 86400000.0::double)) / 365.0::double) AS w FROM mv JOIN tot USING (direction, node, asset_id)),
    c1 AS (SELECT seed.claim_id AS seed_id, risk_level, direction, [node, next] AS nodes, next, asset_id, [relationship_id] AS rels, block_number AS b, sh, w FROM seed JOIN st ON node = seed.address WHERE next <> node)"""]
    for hop in range(1, hops + 1):
        if hop > 1:
            parts.append(f"""c{hop} AS (SELECT h.seed_id, h.risk_level, h.direction, list_append(h.nodes, st.next) AS nodes, st.next, h.asset_id, list_append(h.rels, st.relationship_id) AS rels, st.block_number AS b, least(h.sh, st.sh) AS sh, least(h.w, st.w) AS w
        FROM h{hop - 1} h JOIN st ON st.direction = h.direction AND st.node = h.next AND st.asset_id = h.asset_id WHERE h.next NOT IN (SELECT address FROM svc) AND NOT list_contains(h.nodes, st.next) AND {later})""")
        parts.append(f"""h{hop} AS (SELECT *, risk_level / 100.0::double * {0.65**hop!r}::double * sh * w AS score FROM c{hop} QUALIFY row_number() OVER (PARTITION BY seed_id, direction, next, asset_id ORDER BY score DESC, rels) <= {keep})""")
    return ",\n    ".join(parts)


@query(
    "h06_exposure_capped_five_hops",
    f"""WITH {_CUR}, {_SVC}, {_capped_sql(5)}, every AS ({" UNION ALL ".join(f"SELECT seed_id, direction, {k} AS hop_count, asset_id, score FROM h{k}" for k in range(1, 6))})
    SELECT seed_id, direction, hop_count, asset_id, count(*) AS paths, round(max(score), 6) AS best_score FROM every GROUP BY 1, 2, 3, 4""",
)
def exposure_capped_five_hops(t: Tables) -> DataFrame:
    """The defaults: five hops, three paths per subject and asset."""
    claims = current_claims(t)
    seeds = claims.where(F.col("is_exposure_seed") == 1).select(
        F.col("claim_id").alias("seed_id"), "address", "risk_level"
    )
    found = exposure.expose_capped(t.edges(), seeds, op.service_addresses(claims), AT)
    return found.groupBy("seed_id", "direction", "hop_count", "asset_id").agg(
        F.count("*").alias("paths"), F.round(F.max("exposure_score"), 6).alias("best_score")
    )


@query(
    "h07_exposure_best",
    f"""WITH {_CUR}, mv AS (SELECT from_address AS node, to_address AS next, asset_id, relationship_id, tx_hash, block_number AS b, transaction_index AS x, amount,
            least(greatest(pow(0.5::double, ({AT} - block_timestamp_unix_ms)::double / 15552000000.0::double), 0.05::double), 1.0::double) AS w, CASE WHEN to_address IN (SELECT address FROM exchanges) THEN 1 ELSE 0 END AS svc
        FROM edges WHERE transfer_type IN ('native_transfer', 'erc20_transfer') AND amount > 0),
    e1 AS (SELECT seed.address AS src, 1.0::double AS parent, mv.*, sum(amount) OVER (PARTITION BY seed.address, asset_id) AS total FROM seed JOIN mv ON node = seed.address),
    l1 AS (SELECT *, least(amount::double / total::double, 1.0::double) AS sh, [relationship_id] AS rels, parent * 0.75::double * least(0.25::double + 0.75::double * sqrt(least(amount::double / total::double, 1.0::double)), 1.0::double) * w * (CASE WHEN svc = 1 THEN 0.35::double ELSE 1.0::double END) AS score FROM e1 WHERE next <> src),
    t1 AS (SELECT * FROM l1 WHERE svc = 0 QUALIFY row_number() OVER (PARTITION BY src, next, asset_id, b, x ORDER BY score DESC, rels DESC) = 1),
    e2 AS (SELECT t1.src, t1.score AS parent, t1.rels AS prels, t1.next AS via, mv.next, mv.asset_id, mv.relationship_id, mv.tx_hash, mv.b, mv.x, mv.amount, mv.w, mv.svc, sum(mv.amount) OVER (PARTITION BY t1.src, t1.rels) AS total
        FROM t1 JOIN mv ON mv.node = t1.next AND mv.asset_id = t1.asset_id WHERE mv.b > t1.b OR (mv.b = t1.b AND mv.x > t1.x)),
    l2 AS (SELECT *, least(amount::double / total::double, 1.0::double) AS sh, list_append(prels, relationship_id) AS rels, parent * 0.75::double * least(0.25::double + 0.75::double * sqrt(least(amount::double / total::double, 1.0::double)), 1.0::double) * w * (CASE WHEN svc = 1 THEN 0.35::double ELSE 1.0::double END) AS score FROM e2 WHERE next <> src AND next <> via),
    f AS (SELECT src, next, 1 AS hop, score, rels, b, svc FROM l1 UNION ALL SELECT src, next, 2, score, rels, b, svc FROM l2)
    SELECT src AS source_address, next AS exposed_address, hop AS hop_distance, round(score, 6) AS exposure_score, n AS path_count, array_to_string(rels, ',') AS relationship_ids, svc AS service_mediated
    FROM (SELECT *, count(*) OVER (PARTITION BY src, next) AS n FROM f) QUALIFY row_number() OVER (PARTITION BY src, next ORDER BY score DESC, hop, rels DESC) = 1""",
)
def exposure_best(t: Tables) -> DataFrame:
    found = exposure.expose_best(t.edges(), seed_wallets(t), t.exchanges(), AT, 2)
    return found.select(
        "source_address", "exposed_address", "hop_distance", F.round("exposure_score", 6).alias("exposure_score"),
        "path_count", F.array_join("relationship_ids", ",").alias("relationship_ids"), "service_mediated",
    )


_BEST_SCORE = """{parent} * 0.75::double * least(0.25::double + 0.75::double * sqrt(least(amount::double / total::double, 1.0::double)), 1.0::double) * w
        * (CASE WHEN svc = 1 THEN 0.35::double ELSE 1.0::double END)"""


def _best_sql(hops: int) -> str:
    """The best-score rule level by level: paths ``f`` (src, next, hop, score, rels, svc, b) and the best row and count ``bf`` of each pair."""
    parts = [f"""mv AS (SELECT from_address AS node, to_address AS next, asset_id, relationship_id, tx_hash, block_number AS b, transaction_index AS x, amount,
            least(greatest(pow(0.5::double, ({AT} - block_timestamp_unix_ms)::double / 15552000000.0::double), 0.05::double), 1.0::double) AS w, CASE WHEN to_address IN (SELECT address FROM exchanges) THEN 1 ELSE 0 END AS svc
        FROM edges WHERE transfer_type IN ('native_transfer', 'erc20_transfer') AND amount > 0),
    e1 AS (SELECT seed.address AS src, [seed.address] AS nodes, []::VARCHAR[] AS rels0, 1.0::double AS parent, mv.*, sum(amount) OVER (PARTITION BY seed.address, asset_id) AS total FROM seed JOIN mv ON node = seed.address)"""]
    for hop in range(1, hops + 1):
        if hop > 1:
            before = " UNION ALL ".join(f"SELECT src, next, asset_id, b, x, score FROM t{k}" for k in range(1, hop - 1))
            better = f"""AND score > coalesce((SELECT max(o.score) FROM ({before}) o WHERE o.src = l.src AND o.next = l.next AND o.asset_id = l.asset_id AND o.b = l.b AND o.x = l.x), 0.0)""" if before else ""
            parts.append(f"""t{hop - 1} AS (SELECT * FROM (SELECT * FROM l{hop - 1} WHERE svc = 0 QUALIFY row_number() OVER (PARTITION BY src, next, asset_id, b, x ORDER BY score DESC, rels DESC) = 1) l WHERE true {better}),
    e{hop} AS (SELECT t.src, t.nodes, t.rels AS rels0, t.score AS parent, mv.*, sum(mv.amount) OVER (PARTITION BY t.src, t.rels) AS total FROM t{hop - 1} t JOIN mv ON mv.node = t.next AND mv.asset_id = t.asset_id
        WHERE mv.b > t.b OR (mv.b = t.b AND mv.x > t.x))""")
        parts.append(f"""l{hop} AS (SELECT src, next, asset_id, b, x, svc, list_append(nodes, next) AS nodes, list_append(rels0, relationship_id) AS rels, {_BEST_SCORE.format(parent='parent')} AS score FROM e{hop} WHERE NOT list_contains(nodes, next))""")
    every = " UNION ALL ".join(f"SELECT src, next, {k} AS hop, score, rels, svc, b FROM l{k}" for k in range(1, hops + 1))
    parts.append(f"""f AS ({every}),
    bf AS (SELECT *, count(*) OVER (PARTITION BY src, next) AS n FROM f QUALIFY row_number() OVER (PARTITION BY src, next ORDER BY score DESC, hop, rels DESC) = 1)""")
    return ",\n    ".join(parts)


@query(
    "h07_exposure_best_three_hops",
    f"""WITH {_CUR}, {_best_sql(3)} SELECT src AS source_address, next AS exposed_address, hop AS hop_distance, round(score, 6) AS exposure_score, n AS path_count, svc AS service_mediated FROM bf""",
)
def exposure_best_three_hops(t: Tables) -> DataFrame:
    found = exposure.expose_best(t.edges(), seed_wallets(t), t.exchanges(), AT, 3)
    return found.select(
        "source_address", "exposed_address", "hop_distance", F.round("exposure_score", 6).alias("exposure_score"), "path_count", "service_mediated"
    )


@query(
    "e21_exposure_summary",
    f"""WITH {_CUR}, {_best_sql(2)}, eff AS (SELECT bf.*, least(greatest(score * least(risk_level / 100.0::double, 1.0::double), 0.0), 1.0) AS e FROM bf JOIN (SELECT address, max(risk_level) AS risk_level FROM seed WHERE risk_level > 0 GROUP BY 1) s ON s.address = src)
    SELECT next AS wallet, round(1.0::double - exp(sum(ln(1.0::double - least(e, 0.99::double)))), 6) AS score, count(*) AS source_count, sum(n)::BIGINT AS path_count, min(hop) AS min_hop_distance, round(max(score), 6) AS max_path_score FROM eff GROUP BY 1""",
)
def exposure_summary(t: Tables) -> DataFrame:
    found = exposure.expose_best(t.edges(), seed_wallets(t), t.exchanges(), AT, 2)
    seeds = seed_wallets(t).withColumn("is_active", F.lit(1))
    out = activity.exposure_summary(found, seeds)
    return out.withColumns({"score": F.round("score", 6), "max_path_score": F.round("max_path_score", 6)})


_EXPOSED = f"""{_CUR}, svc AS (SELECT DISTINCT address FROM cur WHERE lower(entity_type) IN ('exchange', 'custodian', 'bridge', 'dex')), {_MOVES},
    w AS (SELECT seed.address AS seed, seed.claim_id, risk_level, confidence, direction, next AS node, [seed.address, next] AS nodes, [relationship_id] AS rels, amount AS lo, amount AS hi, ms, asset_id, token, tx_hash, block_number AS b, transaction_index AS x, 1 AS hop
            FROM seed JOIN mv ON mv.node = seed.address WHERE next <> mv.node
        UNION ALL SELECT w.seed, w.claim_id, w.risk_level, w.confidence, w.direction, mv.next, list_append(nodes, mv.next), list_append(rels, mv.relationship_id), least(lo, mv.amount), greatest(hi, mv.amount), mv.ms, mv.asset_id, mv.token, mv.tx_hash, mv.block_number, mv.transaction_index, hop + 1
            FROM w JOIN mv ON mv.direction = w.direction AND mv.node = w.node AND mv.asset_id = w.asset_id AND mv.token = w.token
            WHERE hop < 3 AND w.node NOT IN (SELECT address FROM svc) AND NOT list_contains(nodes, mv.next) AND mv.tx_hash <> w.tx_hash
              AND CASE WHEN w.direction = 'RECEIVED_FROM_SEED' THEN (mv.block_number > w.b OR (mv.block_number = w.b AND mv.transaction_index > w.x)) ELSE (mv.block_number < w.b OR (mv.block_number = w.b AND mv.transaction_index < w.x)) END),
    pth AS (SELECT node AS subject_id, seed AS seed_address, claim_id, direction, hop AS hop_count, asset_id,
        least(greatest(confidence * risk_level / 100.0::double * pow(0.65::double, hop - 1) * pow(0.5::double, ({AT} - ms)::double / 86400000.0::double / 365.0::double) * (lo::double / hi::double), 0.0), 1.0) AS score,
        CASE WHEN node IN (SELECT address FROM svc) OR seed IN (SELECT address FROM svc) THEN 1 ELSE 0 END AS service_mediated, rels
        FROM w WHERE hop = 1 OR node NOT IN (SELECT address FROM svc))"""


@query(
    "h08_exposure_pairs",
    f"""WITH RECURSIVE {_EXPOSED} SELECT subject_id, seed_address, claim_id, direction, hop_count, asset_id, round(score, 6) AS exposure_score, service_mediated, array_to_string(rels, ',') AS relationship_ids FROM pth""",
)
def exposure_pairs(t: Tables) -> DataFrame:
    found = exposure.expose_pairs(t.edges(), None, current_claims(t), AT)
    return found.select(
        "subject_id", "seed_address", "claim_id", "direction", "hop_count", "asset_id",
        F.round("exposure_score", 6).alias("exposure_score"), "service_mediated",
        F.array_join("relationship_ids", ",").alias("relationship_ids"),
    )


@query(
    "h08_strongest_paths",
    f"""WITH RECURSIVE {_EXPOSED} SELECT subject_id, seed_address, claim_id, direction, round(max(score), 6) AS exposure_score, max(service_mediated) AS service_mediated,
        round(max(score) FILTER (hop_count = 1), 6) AS direct_score FROM pth GROUP BY 1, 2, 3, 4""",
)
def strongest_paths(t: Tables) -> DataFrame:
    found = exposure.best_pairs(t.edges(), current_claims(t), AT)
    return found.groupBy("subject_id", "seed_address", "claim_id", "direction").agg(
        F.round(F.max("exposure_score"), 6).alias("exposure_score"), F.max("service_mediated").alias("service_mediated"),
        F.round(F.max(F.when(F.col("hop_count") == 1, F.col("exposure_score"))), 6).alias("direct_score"),
    )


@query(
    "h09_exposure_utxo",
    f"""WITH {_CUR}, cl AS (SELECT {_UNAME.format(k="cast(substr(address, 2) AS bigint)")} AS who, * FROM cur), sd AS (SELECT * FROM cl WHERE is_exposure_seed = 1 AND who IS NOT NULL),
    svc AS (SELECT DISTINCT who FROM cl WHERE who IS NOT NULL AND lower(entity_type) IN ('exchange', 'custodian', 'bridge', 'dex', 'mixer')),
    ti AS (SELECT tx_hash, sum(value_sats) AS tin FROM inputs GROUP BY 1), tt AS (SELECT tx_hash, sum(value_sats) AS tout FROM outputs GROUP BY 1),
    live AS (SELECT u.tx_hash, block_number AS b, transaction_index AS x, block_timestamp_unix_ms AS ms, tin FROM utxs u JOIN ti USING (tx_hash) JOIN tt USING (tx_hash) WHERE coinbase = 0 AND tout <= tin),
    o AS (SELECT tx_hash, output_index, address AS owner, value_sats AS v, b, x, ms, tin FROM outputs JOIN live USING (tx_hash) WHERE value_sats > 0),
    pay AS (SELECT tx_hash, address AS payer, sum(value_sats) AS origin FROM inputs WHERE address IS NOT NULL GROUP BY 1, 2),
    h1 AS (SELECT payer, o.*, greatest(origin - (tin - v), 0) AS lo, least(origin, v) AS hi FROM pay JOIN o USING (tx_hash)),
    h2 AS (SELECT h1.payer, h1.owner AS via, h1.ms AS ms1, o.tx_hash, o.output_index, o.owner, o.v, o.ms, greatest(h1.lo - (o.tin - o.v), 0) AS lo, least(h1.hi, o.v) AS hi, h1.tx_hash AS tx1
        FROM h1 JOIN inputs i ON i.prev_tx_hash = h1.tx_hash AND i.prev_output_index = h1.output_index AND i.value_sats = h1.v JOIN o ON o.tx_hash = i.tx_hash
        WHERE h1.hi > 0 AND (o.b, o.x) > (h1.b, h1.x) AND (h1.owner IS NULL OR h1.owner NOT IN (SELECT who FROM svc))),
    r1 AS (SELECT 'RECEIVED_FROM_SEED' AS direction, owner AS subject_id, payer AS seed, 1 AS hop, lo, hi, v, ms AS last_ms, ms AS at_ms, tx_hash AS txs FROM h1 WHERE owner <> payer
        UNION ALL SELECT 'SENT_TO_SEED', payer, owner, 1, lo, hi, v, ms, ms, tx_hash FROM h1 WHERE owner <> payer
        UNION ALL SELECT 'RECEIVED_FROM_SEED', owner, payer, 2, lo, hi, v, ms, ms1, tx1 || ',' || tx_hash FROM h2 WHERE owner <> payer
            AND (via IS NULL OR via NOT IN (SELECT who FROM sd WHERE valid_to_unix_ms IS NULL OR valid_to_unix_ms > {UTXO_AT}))
        UNION ALL SELECT 'SENT_TO_SEED', payer, owner, 2, lo, hi, v, ms, ms, tx1 || ',' || tx_hash FROM h2 WHERE owner <> payer
            AND (via IS NULL OR via NOT IN (SELECT who FROM sd WHERE valid_to_unix_ms IS NULL OR valid_to_unix_ms > {UTXO_AT})))
    SELECT direction, subject_id, seed AS seed_address, claim_id, hop AS hop_count, cast(lo AS bigint) AS minimum_sats, cast(hi AS bigint) AS maximum_sats,
        CASE WHEN seed IN (SELECT who FROM svc) OR subject_id IN (SELECT who FROM svc) THEN 1 ELSE 0 END AS service_mediated, txs AS tx_hashes,
        round(CASE WHEN seed IN (SELECT who FROM svc) OR subject_id IN (SELECT who FROM svc) THEN 0.0 ELSE least(confidence * risk_level / 100.0::double * (lo::double / v::double) * pow(0.65::double, hop - 1) * pow(0.5::double, ({UTXO_AT} - last_ms)::double / 86400000.0::double / 365.0::double), 1.0) END, 6) AS exposure_score
    FROM r1 JOIN sd ON sd.who = seed WHERE hi > 0 AND (valid_to_unix_ms IS NULL OR valid_to_unix_ms > at_ms) AND (hop = 1 OR subject_id NOT IN (SELECT who FROM svc))""",
)
def exposure_utxo(t: Tables) -> DataFrame:
    txs = t.utxo_txs().withColumn("at_ms", F.col("block_timestamp_unix_ms"))
    found = exposure.expose_utxo(t.utxo_inputs(), t.utxo_outputs(), txs, utxo_claims(t), UTXO_AT, 2)
    return found.select(
        "direction", "subject_id", "seed_address", "claim_id", "hop_count", "minimum_sats", "maximum_sats",
        "service_mediated", F.array_join("tx_hashes", ",").alias("tx_hashes"),
        F.round("exposure_score", 6).alias("exposure_score"),
    )


@query(
    "h10_service_addresses",
    f"WITH {_CUR} SELECT address, min(entity_id) AS entity_id FROM cur WHERE lower(entity_type) IN ('exchange', 'custodian', 'bridge', 'dex', 'mixer') GROUP BY 1",
)
def service_addresses(t: Tables) -> DataFrame:
    return op.service_addresses(current_claims(t))


@query(
    "h11_graph_rejects",
    f"""SELECT reason, count(*) AS rows FROM (
        SELECT 'dangling_edge' AS reason FROM edges WHERE from_address = {ZERO} OR to_address = {ZERO}
        UNION ALL SELECT 'empty_node_id' FROM nation) GROUP BY 1""",
)
def graph_rejects(t: Tables) -> DataFrame:
    """The zero address is left out of the nodes; nations come in as nodes without id."""
    edges = t.edges().select(
        F.col("relationship_id").alias("id"), F.col("from_address").alias("from"), F.col("to_address").alias("to")
    )
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    nodes = t.raw("customer").select(name("C", "c_custkey")).unionByName(
        t.raw("supplier").select(name("S", "s_suppkey"))
    ).unionByName(t.raw("nation").select(F.lit("").alias("id")))
    _, _, rejects = op.normalize_graph(nodes, edges)
    return rejects.groupBy("reason").agg(F.count("*").alias("rows"))


@query(
    "h12_typed_edges",
    """SELECT edge_type, count(*) AS edges FROM (SELECT CASE WHEN is_bridge = 1 THEN 'BRIDGE' WHEN is_swap = 1 THEN 'SWAP' WHEN is_mint = 1 THEN 'MINT'
        WHEN transfer_type = 'native_transfer' THEN 'NATIVE_TRANSFER' ELSE 'MONEY_FLOW' END AS edge_type FROM edges JOIN features USING (tx_hash)) GROUP BY 1""",
)
def typed_edges(t: Tables) -> DataFrame:
    operation = (
        F.when(F.col("is_bridge") == 1, "bridge").when(F.col("is_swap") == 1, "swap").when(F.col("is_mint") == 1, "mint")
    )
    edges = t.edges().join(t.features(), "tx_hash").withColumn("operation_type", operation)
    return op.type_edges(edges).groupBy("edge_type").agg(F.count("*").alias("edges"))


@query(
    "h12_typed_nodes",
    f"""WITH {_CUR}, n AS (SELECT DISTINCT from_address AS id FROM edges UNION SELECT to_address FROM edges)
    SELECT id, CASE WHEN x.address IS NOT NULL THEN 'exchange_wallet' WHEN c.address IS NOT NULL THEN entity_type ELSE 'wallet' END AS node_type,
        CASE WHEN x.address IS NOT NULL THEN exchange_name || ' (' || x.address_role || ')' WHEN c.address IS NOT NULL THEN entity_name || ' (' || entity_type || ')' END AS label,
        CASE WHEN x.address IS NOT NULL THEN greatest(x.confidence, c.confidence) ELSE c.confidence END AS confidence
    FROM n LEFT JOIN exchanges x ON x.address = id LEFT JOIN cur c ON c.address = id""",
)
def typed_nodes(t: Tables) -> DataFrame:
    edges = t.edges().withColumn("protocol", F.lit(""))
    return op.type_nodes(edges, t.exchanges(), current_claims(t))

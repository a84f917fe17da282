"""Queries over wallet profiles, risk, screening and data quality (sections K and N)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweft.functions import ids
from chainweft.operators import activity, exposure, matching, quality, scope, series, visibility
from chainweft.operators import profile as op
from chainweft.operators import risk
from chainweft.plans.activity import _round
from chainweft.plans.detect import _peel_lines, labelled_wallets
from chainweft.plans.graph import _EXPOSED, AT, _best_sql, current_claims, seed_wallets
from chainweft.plans.matching import forward_sql
from chainweft.plans.registry import query
from chainweft.session import shared_dir
from chainweft.sources import files
from chainweft.sources.tables import Tables

_CUR = "cur AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1)"


def _wallets(t: Tables) -> DataFrame:
    return scope.wallet_edges(t.edges()).select("wallet").distinct()


def _contracts(t: Tables) -> DataFrame:
    """Targets of transactions with call data, as contracts."""
    return t.account_txs().where(F.length("input_data") > 2).select(
        F.col("to_address").alias("address"), F.lit("").alias("protocol"), F.lit("Trigger").alias("contract_type")
    )


@query(
    "k01_wallet_identity",
    f"""WITH {_CUR}, w AS (SELECT DISTINCT wallet FROM wallet_edges), c AS (SELECT DISTINCT to_address AS address FROM txs WHERE length(input_data) > 2),
    n AS (SELECT * FROM cur WHERE entity_type <> 'unknown')
    SELECT wallet, CASE WHEN x.address IS NOT NULL AND x.address_role = 'DEPOSIT' THEN 'exchange_deposit_wallet' WHEN x.address IS NOT NULL THEN 'exchange_service_wallet'
            WHEN n.address IS NOT NULL THEN n.entity_type WHEN c.address IS NOT NULL THEN 'contract:Trigger' ELSE 'wallet' END AS identity_type,
        CASE WHEN x.address IS NOT NULL THEN x.entity_id ELSE n.entity_id END AS entity_id,
        CASE WHEN x.address IS NOT NULL THEN x.confidence WHEN n.address IS NOT NULL THEN n.confidence WHEN c.address IS NOT NULL THEN 0.65 ELSE 0.25 END AS identity_confidence
    FROM w LEFT JOIN exchanges x ON x.address = wallet LEFT JOIN n ON n.address = wallet LEFT JOIN c ON c.address = wallet""",
)
def wallet_identity(t: Tables) -> DataFrame:
    entities = current_claims(t).where(F.col("entity_type") != "unknown")
    return op.identity(_wallets(t), t.exchanges(), entities, _contracts(t)).select(
        "wallet", "identity_type", "entity_id", "identity_confidence"
    )


def profiles(t: Tables) -> DataFrame:
    """Aggregate, ratios, identity and confidence of every wallet."""
    edges = t.edges()
    times = series.wallet_times(edges)
    aggregate = activity.wallet_aggregate(activity.enrich(edges, t.features(), t.exchanges()))
    ratios = op.behaviour_ratios(aggregate, op.largest_peer(edges), series.burst_score(times), series.avg_gap(times))
    entities = current_claims(t).where(F.col("entity_type") != "unknown")
    known = op.identity(aggregate.select("wallet"), t.exchanges(), entities, _contracts(t))
    return op.evidence_confidence(ratios.join(known, "wallet"))


_PROFILE = f"""{_CUR}, c AS (SELECT DISTINCT to_address AS address FROM txs WHERE length(input_data) > 2), n AS (SELECT * FROM cur WHERE entity_type <> 'unknown'),
    ag AS (SELECT wallet, count(*) AS total, count(*) FILTER (direction = 'in') AS inc, count(*) FILTER (direction = 'out') AS outg,
        count(DISTINCT peer) FILTER (direction = 'in') AS s, count(DISTINCT peer) FILTER (direction = 'out') AS r, min(block_timestamp_unix_ms) AS t0, max(block_timestamp_unix_ms) AS t1,
        count(*) FILTER (is_swap > 0) / count(*) AS swap_ratio, count(*) FILTER (is_bridge > 0) / count(*) AS bridge_ratio, count(*) FILTER (is_contract_call > 0) / count(*) AS contract_call_ratio,
        count(*) FILTER (confidence > 0) / count(*) AS exchange_interaction_ratio
        FROM wallet_edges LEFT JOIN features USING (tx_hash) LEFT JOIN exchanges e ON e.address = peer GROUP BY 1),
    lp AS (SELECT wallet, max(k) AS top FROM (SELECT wallet, peer, count(*) AS k FROM wallet_edges GROUP BY 1, 2) GROUP BY 1),
    hr AS (SELECT wallet, h, count(*) AS k FROM (SELECT wallet, tx_hash, min(block_timestamp_unix_ms) // 3600000 AS h FROM wallet_edges GROUP BY 1, 2) GROUP BY 1, 2),
    bs AS (SELECT wallet, CASE WHEN sum(k) < 3 THEN 0.0 ELSE least(greatest((max(k) / (sum(k) / count(*)) - 1.0) / 9.0, 0.0), 1.0) END AS burst_score FROM hr GROUP BY 1),
    pr AS (SELECT ag.*, top / greatest(total, 1) AS concentration, burst_score, CASE WHEN t1 > t0 THEN (t1 - t0) / 86400000.0::double ELSE 1.0 END AS days,
        least(CASE WHEN total >= 200 THEN 0.85 WHEN total >= 50 THEN 0.75 WHEN total >= 10 THEN 0.62 WHEN total >= 3 THEN 0.45 ELSE 0.30 END
            + CASE WHEN (t1 - t0) / 86400000.0 >= 30 THEN 0.08 WHEN (t1 - t0) / 86400000.0 >= 7 THEN 0.04 ELSE 0.0 END, 1.0) AS ev,
        CASE WHEN x.address IS NOT NULL AND x.address_role = 'DEPOSIT' THEN 'exchange_deposit_wallet' WHEN x.address IS NOT NULL THEN 'exchange_service_wallet'
            WHEN n.address IS NOT NULL THEN n.entity_type WHEN c.address IS NOT NULL THEN 'contract:Trigger' ELSE 'wallet' END AS identity_type,
        CASE WHEN x.address IS NOT NULL THEN x.confidence WHEN n.address IS NOT NULL THEN n.confidence WHEN c.address IS NOT NULL THEN 0.65 ELSE 0.25 END AS ic
        FROM ag JOIN lp USING (wallet) JOIN bs USING (wallet) LEFT JOIN exchanges x ON x.address = wallet LEFT JOIN n ON n.address = wallet LEFT JOIN c ON c.address = wallet)"""


@query(
    "k02_wallet_type",
    f"""WITH {_PROFILE}, ty AS (SELECT *, CASE WHEN starts_with(identity_type, 'exchange') THEN identity_type
        WHEN exchange_interaction_ratio >= 0.35 AND s >= 10 AND r <= 5 AND inc > outg THEN 'exchange_deposit_funnel' WHEN s >= 50 AND r >= 50 AND total >= 200 THEN 'service_or_exchange_hub'
        WHEN s >= 10 AND r <= 3 THEN 'collector_wallet' WHEN r >= 10 AND s <= 3 THEN 'distributor_wallet' WHEN swap_ratio >= 0.25 THEN 'defi_swapper' WHEN bridge_ratio >= 0.15 THEN 'bridge_user'
        WHEN contract_call_ratio >= 0.50 THEN 'contract_power_user' WHEN burst_score >= 0.75 AND r >= 5 THEN 'burst_distributor' ELSE 'retail_wallet' END AS wallet_type FROM pr)
    SELECT wallet, wallet_type, round(greatest(ev, CASE WHEN starts_with(identity_type, 'exchange') THEN ic ELSE (CASE wallet_type WHEN 'exchange_deposit_funnel' THEN 0.72 WHEN 'service_or_exchange_hub' THEN 0.70
        WHEN 'collector_wallet' THEN 0.65 WHEN 'distributor_wallet' THEN 0.65 WHEN 'defi_swapper' THEN 0.62 WHEN 'bridge_user' THEN 0.62 WHEN 'contract_power_user' THEN 0.60 WHEN 'burst_distributor' THEN 0.58 ELSE 0.0 END) END), 6) AS confidence FROM ty""",
)
def wallet_type(t: Tables) -> DataFrame:
    return op.wallet_type(profiles(t)).select("wallet", "wallet_type", F.round("confidence", 6).alias("confidence"))


@query(
    "k03_behaviour_flags",
    f"""WITH {_PROFILE} SELECT wallet, concat_ws(',', CASE WHEN exchange_interaction_ratio >= 0.5 THEN 'exchange_interaction_heavy' END, CASE WHEN burst_score >= 0.75 THEN 'bursty_activity' END,
        CASE WHEN concentration >= 0.75 AND total >= 5 THEN 'counterparty_concentration' END, CASE WHEN s >= 25 AND r <= 3 THEN 'many_senders_few_receivers' END,
        CASE WHEN r >= 25 AND s <= 3 THEN 'few_senders_many_receivers' END, CASE WHEN bridge_ratio >= 0.25 THEN 'bridge_heavy_activity' END, CASE WHEN swap_ratio >= 0.4 THEN 'swap_heavy_activity' END) AS behaviour_flags FROM pr""",
)
def behaviour_flags(t: Tables) -> DataFrame:
    return op.behaviour_flags(profiles(t)).select("wallet", F.array_join("behaviour_flags", ",").alias("behaviour_flags"))


@query("k04_evidence_confidence", f"WITH {_PROFILE} SELECT wallet, round(ev, 6) AS evidence_confidence FROM pr")
def evidence_confidence(t: Tables) -> DataFrame:
    return profiles(t).select("wallet", F.round("evidence_confidence", 6).alias("evidence_confidence"))


@query(
    "k05_behaviour_ratios",
    f"""WITH {_PROFILE} SELECT wallet, round(days, 6) AS observed_days, round(inc / greatest(outg, 1), 6) AS inbound_outbound_ratio, round(concentration, 6) AS counterparty_concentration,
        round(contract_call_ratio, 6) AS contract_call_ratio, round(swap_ratio, 6) AS swap_ratio, round(bridge_ratio, 6) AS bridge_ratio, round(exchange_interaction_ratio, 6) AS exchange_interaction_ratio FROM pr""",
)
def behaviour_ratios(t: Tables) -> DataFrame:
    columns = [
        "observed_days", "inbound_outbound_ratio", "counterparty_concentration", "contract_call_ratio", "swap_ratio",
        "bridge_ratio", "exchange_interaction_ratio",
    ]
    return _round(profiles(t).select("wallet", *columns), *columns)


@query(
    "k05_active_hours",
    "SELECT wallet, string_agg(h, ',' ORDER BY h) AS active_hours FROM (SELECT DISTINCT wallet, block_timestamp_unix_ms % 86400000 // 3600000 AS h FROM wallet_edges) GROUP BY 1",
)
def active_hours(t: Tables) -> DataFrame:
    hours = op.active_hours(t.edges())
    return hours.select("wallet", F.array_join(F.col("active_hours").cast("array<string>"), ",").alias("active_hours"))


# risk ------------------------------------------------------------------------


def _paths(t: Tables, found: DataFrame) -> DataFrame:
    """Exposure paths with what the gates ask for."""
    seeds = labelled_wallets(t).where(F.col("is_exposure_seed") == 1).select(
        F.col("wallet").alias("seed_address"), risk.approved_label().alias("seed_approved")
    )
    return found.join(seeds, "seed_address", "left").select(
        F.col("subject_id").alias("wallet"), "path_id", "seed_address", "direction", "hop_count", "exposure_score",
        "service_mediated", "tx_hashes", "relationship_ids", "path_subjects",
        "seed_approved", F.lit(None).cast("int").alias("score_eligible"),
    )


def _mixer(t: Tables) -> DataFrame:
    """Supplied events as mixer evidence; every seventh id lacks a registered contract."""
    key = F.regexp_extract("event_id", "([0-9]+)$", 1).cast("bigint")
    return t.semantic_events().select(
        "event_id", "tx_hash", "subject_id", "event_type", "confidence", F.lit("pool").alias("protocol_contract"),
        F.lit("pool").alias("emitter"), F.col("event_type").alias("abi_operation"),
        F.when(key % 7 == 0, "").otherwise("registry").alias("registry_source"), key.alias("log_index"),
    )


def _signals(t: Tables) -> DataFrame:
    return risk.risk_signals(
        labelled_wallets(t), risk.gate_paths(_paths(t, exposure.best_pairs(t.edges(), current_claims(t), AT))), risk.gate_mixer(_mixer(t)),
        risk.forwarding_counts(matching.forwarding_pairs(t.edges())),
    )


_FORWARD = f"{forward_sql(600_000, 10)}, fcount AS (SELECT wallet, count(*) AS pair_count FROM forwarded GROUP BY 1)"
_PASS = """pas AS (SELECT i.to_address AS wallet, count(*) AS pair_count FROM edges i JOIN edges o ON i.to_address = o.from_address AND i.asset_id = o.asset_id
        AND o.block_timestamp_unix_ms BETWEEN i.block_timestamp_unix_ms AND i.block_timestamp_unix_ms + 86400000 AND i.tx_hash <> o.tx_hash GROUP BY 1)"""
_SIGNALS = f"""{_EXPOSED}, {_FORWARD}, good AS (SELECT * FROM cur WHERE lower(review_status) = 'approved'),
    gated AS (SELECT subject_id AS wallet, score, hop_count, direction, CASE WHEN seed_address NOT IN (SELECT address FROM good) THEN 'seed_not_approved' WHEN service_mediated = 1 THEN 'service_mediated' END AS gate_reason FROM pth),
    sig AS (SELECT address AS wallet, 'APPROVED_RISK_LABEL' AS signal_type, least(greatest(risk_level / 100.0::double, 0.0), 1.0) * 70.0::double AS contribution FROM good WHERE is_exposure_seed = 1 AND risk_level > 0
        UNION ALL SELECT wallet, 'ILLICIT_SEED_EXPOSURE', max(score * CASE WHEN hop_count > 1 THEN 25.0::double WHEN direction = 'RECEIVED_FROM_SEED' THEN 55.0::double ELSE 45.0::double END) FROM gated WHERE gate_reason IS NULL GROUP BY 1 HAVING max(score) > 0
        UNION ALL SELECT DISTINCT subject_id, 'MIXER_INTERACTION', 15.0 FROM sem WHERE starts_with(event_type, 'mixer_') AND confidence >= 0.8 AND cast(substr(event_id, 2) AS bigint) % 7 <> 0
        UNION ALL SELECT wallet, 'RAPID_SAME_ASSET_FORWARDING', 5.0 FROM fcount WHERE pair_count >= 3 AND wallet NOT IN (SELECT address FROM good WHERE lower(entity_type) IN ('exchange', 'dex', 'bridge', 'custodian')))"""


@query("k06_risk_signals", f"WITH RECURSIVE {_SIGNALS} SELECT wallet, signal_type, round(contribution, 6) AS contribution FROM sig")
def risk_signals(t: Tables) -> DataFrame:
    return _signals(t).select("wallet", "signal_type", F.round("contribution", 6).alias("contribution"))


@query(
    "k06_forwarding_signals",
    f"""WITH RECURSIVE {forward_sql(60 * 86_400_000, 2)}, {_CUR}, fcount AS (SELECT wallet, count(*) AS pair_count FROM forwarded GROUP BY 1)
    SELECT wallet, pair_count, 5.0::double AS contribution FROM fcount WHERE pair_count >= 3
        AND wallet NOT IN (SELECT address FROM cur WHERE lower(review_status) = 'approved' AND lower(entity_type) IN ('exchange', 'dex', 'bridge', 'custodian'))""",
)
def forwarding_signals(t: Tables) -> DataFrame:
    """The forwarding signal alone, with sixty days and half the amount: supplied transfers are far apart."""
    day = 86_400_000
    counts = risk.forwarding_counts(matching.forwarding_pairs(t.edges(), 60 * day, 2, 60 * day))
    return risk.forwarding_signals(labelled_wallets(t), counts).join(counts, "wallet").select("wallet", "pair_count", "contribution")


_ASSESS = f"""{_SIGNALS}, tot AS (SELECT wallet, sum(contribution) AS total, count(*) AS signal_count FROM sig GROUP BY 1),
    wal AS (SELECT wallet, count(*) AS transfers FROM wallet_edges GROUP BY 1),
    ass AS (SELECT wallet, transfers, coalesce(signal_count, 0) AS signal_count, signal_count IS NOT NULL OR transfers >= 3 AS available, least(coalesce(total, 0.0), 100.0) AS score FROM wal LEFT JOIN tot USING (wallet))"""


@query(
    "k06_risk_assessment",
    f"""WITH RECURSIVE {_ASSESS} SELECT wallet, CASE WHEN available THEN round(score, 1) END AS risk_score, signal_count,
        CASE WHEN NOT available THEN 'UNKNOWN' WHEN score >= 60 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NO_SIGNALS' END AS risk_level, score >= 25 AS requires_analyst_review FROM ass""",
)
def risk_assessment(t: Tables) -> DataFrame:
    wallets = activity.fingerprint(t.edges()).select("wallet", F.col("transfer_count").alias("transfers"))
    return risk.risk_assess(_signals(t), wallets).select(
        "wallet", "risk_score", "signal_count", "risk_level", "requires_analyst_review"
    )


@query(
    "k07_path_gates",
    f"WITH RECURSIVE {_SIGNALS} SELECT coalesce(gate_reason, 'scored') AS gate_reason, count(*) AS paths FROM gated GROUP BY 1",
)
def path_gates(t: Tables) -> DataFrame:
    gated = risk.gate_paths(_paths(t, exposure.expose_pairs(t.edges(), None, current_claims(t), AT)))
    return gated.groupBy(F.coalesce("gate_reason", F.lit("scored")).alias("gate_reason")).agg(F.count("*").alias("paths"))


@query(
    "k07_mixer_gates",
    """SELECT CASE WHEN NOT starts_with(event_type, 'mixer_') THEN 'not_a_mixer_event' WHEN confidence < 0.8 THEN 'low_confidence'
        WHEN cast(substr(event_id, 2) AS bigint) % 7 = 0 THEN 'unregistered_contract' ELSE 'scored' END AS gate_reason, count(*) AS events FROM sem GROUP BY 1""",
)
def mixer_gates(t: Tables) -> DataFrame:
    gated = risk.gate_mixer(_mixer(t))
    return gated.groupBy(F.coalesce("gate_reason", F.lit("scored")).alias("gate_reason")).agg(F.count("*").alias("events"))


_NETWORKS = "(VALUES ('ethereum'), ('bsc'), ('tron')) v(network)"


@query(
    "k07_mixer_evidence",
    f"""WITH e AS (SELECT event_id, cast(substr(event_id, 2) AS bigint) AS k, confidence, network FROM sem, {_NETWORKS} WHERE starts_with(event_type, 'mixer_'))
    SELECT network, event_id, CASE WHEN confidence < 0.8 THEN 'low_confidence' WHEN k % 11 = 1 THEN 'missing_reference' WHEN k % 13 = 2 THEN 'receipt_does_not_prove_event' WHEN k % 17 = 3 THEN 'emitter_differs'
        WHEN network = 'tron' OR k % 7 = 0 OR k % 19 = 4 THEN 'unregistered_contract' WHEN network = 'bsc' AND (k % 5 = 1 OR k % 23 = 6) THEN 'unregistered_contract' ELSE 'scored' END AS gate_reason FROM e""",
)
def mixer_evidence(t: Tables) -> DataFrame:
    """Mixer events whose receipts, emitters and registry rows fail one after the other, on three networks."""
    key = F.regexp_extract("event_id", "([0-9]+)$", 1).cast("bigint")
    pool = F.concat(F.lit("pool"), key % 40)
    events = t.semantic_events().where(F.col("event_type").startswith("mixer_")).select(
        "event_id", "event_type", "confidence", F.when(key % 11 == 1, "").otherwise(F.col("tx_hash")).alias("tx_hash"), pool.alias("protocol_contract"),
        F.when(key % 13 == 2, F.lit(None)).otherwise(F.col("event_type")).alias("abi_operation"),
        F.when(key % 17 == 3, F.concat(F.lit("not-"), pool)).otherwise(pool).alias("emitter"),
        F.when(key % 7 == 0, "").otherwise("registry").alias("registry_source"), F.when(key % 19 != 4, key).alias("log_index"),
        F.when(key % 5 == 1, "pending").otherwise("APPROVED").alias("registry_review"), F.when(key % 23 == 6, "mixer_generic").otherwise(risk.MIXER_DECODER).alias("registry_decoder"),
    )
    out = None
    for network in ("ethereum", "bsc", "tron"):
        part = risk.gate_mixer(events, network).select(F.lit(network).alias("network"), "event_id", F.coalesce("gate_reason", F.lit("scored")).alias("gate_reason"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "k07_propagated_gates",
    f"""WITH {_CUR}, seed AS (SELECT * FROM cur WHERE is_exposure_seed = 1), {_best_sql(2)}, good AS (SELECT address FROM cur WHERE lower(review_status) = 'approved')
    SELECT src AS source_address, next AS wallet, CASE WHEN b % 10 = 3 THEN 'incomplete_path_evidence' WHEN src NOT IN (SELECT address FROM good) THEN 'seed_not_approved' WHEN svc = 1 THEN 'service_mediated' ELSE 'scored' END AS gate_reason FROM bf""",
)
def propagated_gates(t: Tables) -> DataFrame:
    """Best paths as a propagation run stores them; runs of every tenth block have lost their id."""
    found = exposure.expose_best(t.edges(), seed_wallets(t), t.exchanges(), AT, 2)
    approved = labelled_wallets(t).where(F.col("is_exposure_seed") == 1).select(F.col("wallet").alias("source_address"), risk.approved_label().alias("seed_approved"))
    paths = found.join(approved, "source_address", "left").select(
        "source_address", F.col("exposed_address").alias("wallet"), "last_tx_hash", "seed_approved", "service_mediated", F.col("hop_distance").alias("hop_count"),
        F.when(F.col("last_seen_block") % 10 != 3, F.concat(F.lit("run"), "last_seen_block")).alias("propagation_run_id"),
    )
    return risk.gate_propagated(paths).select("source_address", "wallet", F.coalesce("gate_reason", F.lit("scored")).alias("gate_reason"))


@query(
    "k07_utxo_gates",
    """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, cast(round(o_totalprice * 100) AS bigint) AS cents FROM orders),
    v AS (SELECT k, sum(cents) OVER (PARTITION BY c ORDER BY k DESC) + 100000000 - cents AS remains, row_number() OVER (PARTITION BY c ORDER BY k) AS i, c FROM r)
    SELECT 'p' || a.k AS path_id, b.remains::BIGINT AS minimum_sats, b.remains::BIGINT AS maximum_sats, CASE WHEN a.k % 7 IN (1, 2, 3) THEN 0 ELSE 1 END AS score_eligible
    FROM v a JOIN v b ON b.c = a.c AND b.i = a.i + 2""",
)
def utxo_gates(t: Tables) -> DataFrame:
    """Three payments of a line as one path; of seven paths one claims a wrong bound, one spends another output, one has too large a fee."""
    inputs, outputs, _ = _peel_lines(t)
    paid = outputs.where(F.col("output_index") == 0).select("tx_hash", F.col("value_sats").alias("output_sats"))
    order = F.regexp_extract("tx_hash", "([0-9]+)$", 1).cast("bigint")
    line = inputs.join(paid, "tx_hash").withColumn("at", order)
    window = Window.partitionBy("address").orderBy("at")
    step = F.struct("tx_hash", "at", "value_sats", "output_sats", "prev_tx_hash")
    paths = line.select(F.col("tx_hash").alias("path_id"), F.col("at").alias("k"), *[F.lead(step, n).over(window).alias(f"s{n}") if n else step.alias("s0") for n in range(3)]).where("s2 IS NOT NULL")
    steps = paths.select("path_id", F.col("k"), F.posexplode(F.array("s0", "s1", "s2")).alias("step", "s"))
    fault = F.col("k") % 7
    return risk.gate_utxo_steps(
        steps.select(
            "path_id", "step", "s.tx_hash", F.col("s.at").alias("block_number"), F.lit(0).cast("bigint").alias("transaction_index"),
            F.col("s.value_sats").alias("selected_sats"), F.col("s.value_sats").alias("total_input_sats"), F.col("s.output_sats").alias("output_sats"),
            F.when((fault == 3) & (F.col("step") == 2), F.col("s.value_sats")).otherwise(F.lit(1).cast("bigint")).alias("fee_sats"), "s.prev_tx_hash",
            F.when((fault == 2) & (F.col("step") == 1), 1).otherwise(0).cast("bigint").alias("prev_output_index"), F.lit(0).cast("bigint").alias("output_index"),
            (F.col("s.output_sats") + F.when((fault == 1) & (F.col("step") == 1), 1).otherwise(0)).alias("claimed_lower"), F.col("s.output_sats").alias("claimed_upper"),
        )
    )


def _rules(t: Tables) -> DataFrame:
    """Rule maxima, one per signal type, kept as a small reviewed table."""
    kinds = F.array(*[F.lit(s) for s in risk.RULE_SIGNALS])
    first = t.raw("region").where(F.col("r_regionkey") == 0)
    return first.select(F.posexplode(kinds).alias("i", "signal_type")).select(
        "signal_type", (F.lit(80.0) - F.col("i") * 10.0).alias("max_contribution"), F.lower("signal_type").alias("description")
    )


@query(
    "k08_rule_table_risk",
    f"""WITH RECURSIVE {_EXPOSED}, {_PASS}, mix AS (SELECT subject_id AS wallet, count(*) FILTER (starts_with(event_type, 'mixer_')) AS m FROM sem GROUP BY 1),
    seq AS (SELECT DISTINCT a.subject_id AS wallet, CASE WHEN a.event_type = 'swap' THEN 'RAPID_SWAP_BRIDGE_SEQUENCE' ELSE 'MIXER_BRIDGE_SEQUENCE' END AS s FROM sem a JOIN sem b ON a.subject_id = b.subject_id AND b.event_type = 'bridge_transfer'
        AND (a.event_type = 'swap' OR starts_with(a.event_type, 'mixer_')) AND abs(a.block_timestamp_unix_ms - b.block_timestamp_unix_ms) <= 3600000),
    st AS (SELECT address AS wallet, 'CONFIRMED_ILLICIT_SEED' AS s, risk_level / 100.0::double AS v FROM cur WHERE is_exposure_seed = 1
        UNION ALL SELECT subject_id, CASE WHEN hop_count > 1 THEN 'INDIRECT_EXPOSURE' WHEN direction = 'RECEIVED_FROM_SEED' THEN 'DIRECT_RECEIVED_EXPOSURE' ELSE 'DIRECT_SENT_EXPOSURE' END, score FROM pth
        UNION ALL SELECT wallet, 'MIXER_INTERACTION', m / 2.0::double FROM mix WHERE m > 0 UNION ALL SELECT wallet, s, 1.0 FROM seq UNION ALL SELECT wallet, 'RAPID_PASS_THROUGH', pair_count / 3.0::double FROM pas),
    mx AS (SELECT wallet, s, least(greatest(max(v), 0.0), 1.0) * CASE s WHEN 'CONFIRMED_ILLICIT_SEED' THEN 80.0 WHEN 'DIRECT_RECEIVED_EXPOSURE' THEN 70.0 WHEN 'DIRECT_SENT_EXPOSURE' THEN 60.0 WHEN 'INDIRECT_EXPOSURE' THEN 50.0
        WHEN 'MIXER_INTERACTION' THEN 40.0 WHEN 'MIXER_BRIDGE_SEQUENCE' THEN 30.0 WHEN 'RAPID_SWAP_BRIDGE_SEQUENCE' THEN 20.0 ELSE 10.0 END::double AS c FROM st GROUP BY 1, 2)
    SELECT wallet, round(least(sum(c), 100.0), 6) AS risk_score, CASE WHEN sum(c) >= 60 THEN 'HIGH' WHEN sum(c) >= 25 THEN 'MEDIUM' WHEN sum(c) > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level, count(*) AS signal_count FROM mx GROUP BY 1""",
)
def rule_table_risk(t: Tables) -> DataFrame:
    events = t.semantic_events()
    kind = F.col("event_type")
    bridge = kind == "bridge_transfer"
    named = lambda df: df.withColumnRenamed("subject_id", "wallet")
    signals = risk.rule_signals(
        labelled_wallets(t), _paths(t, exposure.expose_pairs(t.edges(), None, current_claims(t), AT)), activity.semantic_counts(events),
        named(matching.event_sequence(events, kind.startswith("mixer_"), bridge)),
        named(matching.event_sequence(events, kind == "swap", bridge)),
        matching.pass_through(t.edges(), 86_400_000),
    )
    return risk.risk_rules(signals, _rules(t), 25.0, 60.0).select(
        "wallet", F.round("risk_score", 6).alias("risk_score"), "risk_level", "signal_count"
    )


@query(
    "k09_limitations",
    f"""WITH RECURSIVE {_SIGNALS}, wal AS (SELECT wallet, count(*) AS n FROM wallet_edges GROUP BY 1),
    c AS (SELECT wallet, unnest(['evidence_score_not_probability', 'stored_evidence_only', 'history_not_from_genesis']) AS code FROM wal
        UNION ALL SELECT wallet, 'internal_coverage_incomplete' FROM wal UNION ALL SELECT wallet, 'fewer_than_three_transfers' FROM wal WHERE n < 3
        UNION ALL SELECT wallet, 'no_scored_exposure' FROM wal WHERE wallet NOT IN (SELECT wallet FROM gated WHERE gate_reason IS NULL)
        UNION ALL SELECT g.wallet, 'not_scored:' || gate_reason FROM gated g JOIN wal USING (wallet) WHERE gate_reason IS NOT NULL)
    SELECT wallet, string_agg(DISTINCT code, ',' ORDER BY code) AS limitations FROM c GROUP BY 1""",
)
def limitations(t: Tables) -> DataFrame:
    wallets = activity.fingerprint(t.edges()).select(
        "wallet", F.col("transfer_count").alias("transfers"), F.lit(False).alias("truncated"),  # all transfers are read
        F.lit(False).alias("internal_coverage"), F.lit(False).alias("from_genesis"),
    )
    gated = risk.gate_paths(_paths(t, exposure.expose_pairs(t.edges(), None, current_claims(t), AT)))
    found = risk.limitations(wallets, gated, gated.where(F.col("gate_reason").isNull()))
    return found.select("wallet", F.array_join("limitations", ",").alias("limitations"))


def _assessments(t: Tables) -> DataFrame:
    """A usable score for every wallet whose supplier or customer key is not a multiple of nine."""
    fp = activity.fingerprint(t.edges())
    key = F.regexp_extract("wallet", "([0-9]+)$", 1).cast("bigint")
    score = F.when(key % 9 != 0, (F.col("transfer_count") % 100).cast("double"))
    return fp.select("wallet", score.alias("risk_score"), F.when(key % 25 == 7, 40.0).otherwise(0.0).alias("label_score"))


@query(
    "k10_watch_screening",
    """WITH w AS (SELECT wallet, CASE WHEN cast(regexp_extract(wallet, '([0-9]+)$', 1) AS bigint) % 9 <> 0 THEN cast(count(*) % 100 AS double) END AS sc,
            CASE WHEN cast(regexp_extract(wallet, '([0-9]+)$', 1) AS bigint) % 25 = 7 THEN 40.0 ELSE 0.0 END AS lb FROM wallet_edges GROUP BY 1),
    e AS (SELECT tx_hash, from_address AS a FROM txs UNION SELECT tx_hash, to_address FROM txs UNION SELECT tx_hash, from_address FROM edges UNION SELECT tx_hash, to_address FROM edges),
    pr AS (SELECT tx_hash, from_address AS a, 0 AS p FROM txs UNION ALL SELECT tx_hash, to_address, 1 FROM txs UNION ALL SELECT tx_hash, a, 2 FROM e),
    d AS (SELECT tx_hash, a, min(p) AS p FROM pr GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY p, a) AS k, count(*) OVER (PARTITION BY tx_hash) AS n FROM d),
    t AS (SELECT tx_hash, count(*) AS expected, count(sc) AS assessed, max(n) > 4 AS cut, max(sc) FILTER (sc >= 50) AS score FROM rk LEFT JOIN w ON w.wallet = a WHERE k <= 4 GROUP BY 1)
    SELECT 'w-' || wallet AS watch_id, CASE WHEN sc IS NULL THEN 'unknown' WHEN lb >= 30 THEN 'matched' ELSE 'no_match' END AS status, CASE WHEN sc IS NOT NULL AND lb >= 30 THEN sc END AS score FROM w
    UNION ALL SELECT 'w-' || tx_hash, CASE WHEN score IS NOT NULL THEN 'matched' WHEN NOT cut AND assessed = expected THEN 'no_match' ELSE 'unknown' END, score FROM t
    UNION ALL SELECT 'w-x' || c_custkey, 'not_indexed', NULL FROM customer""",
)
def watch_screening(t: Tables) -> DataFrame:
    """A label watch per wallet, a score watch per transaction, and unknown hashes per customer."""
    assessed = _assessments(t)
    txs = t.account_txs()
    name = lambda c: F.concat(F.lit("w-"), c).alias("watch_id")
    watches = (
        assessed.select(name(F.col("wallet")), F.lit("address").alias("kind"), F.col("wallet").alias("value"),
                        F.lit("approved_label").alias("rule"), F.lit(30.0).alias("threshold"))
        .unionByName(txs.select(name(F.col("tx_hash")), F.lit("transaction").alias("kind"), F.col("tx_hash").alias("value"),
                                F.lit("evidence_score").alias("rule"), F.lit(50.0).alias("threshold")))
        .unionByName(t.raw("customer").select(
            name(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))), F.lit("transaction").alias("kind"),
            F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("value"), F.lit("evidence_score").alias("rule"),
            F.lit(50.0).alias("threshold")))
    )
    return risk.screen(watches, assessed, scope.participants(txs, t.edges())).select("watch_id", "status", "score")


def watch_checks(t: Tables) -> DataFrame:
    """Supplied events as checks of a watch per user."""
    kind = F.col("event_type")
    return t.raw("events").select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("watch_id"), F.col("event_id").alias("checked_at"),
        F.when(kind.isin("view", "click"), "matched").when(kind == "error", "unknown").otherwise("no_match").alias("status"),
        F.col("value").alias("score"),
    )


@query(
    "k11_alerts",
    """WITH c AS (SELECT 'w' || user_id AS watch_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'matched' ELSE 'no_match' END AS s, value FROM events WHERE event_type <> 'error'),
    p AS (SELECT *, lag(s) OVER (PARTITION BY watch_id ORDER BY event_id) AS was FROM c)
    SELECT watch_id, event_id AS created_at_ms, CASE WHEN value >= 60 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity FROM p WHERE s = 'matched' AND coalesce(was, 'no_match') <> 'matched'""",
)
def alerts(t: Tables) -> DataFrame:
    return risk.alerts(watch_checks(t), 1_000).select("watch_id", "created_at_ms", "severity")


@query(
    "k12_assessment_staleness",
    """SELECT source_validity, count(*) AS assessments FROM (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'unverified' WHEN s_suppkey % 5 = 1 THEN 'stale' WHEN s_suppkey % 3 = 0 THEN 'stale' ELSE 'current' END AS source_validity FROM supplier) GROUP BY 1""",
)
def assessment_staleness(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    now = visibility.snapshot(t.state()).select(
        "network_id", F.col("snapshot_id").alias("source_snapshot_id"), F.sha2(F.lit("labels"), 256).alias("intelligence_snapshot_id")
    )
    ids = t.raw("supplier").select(key, F.lit("utxo:1").alias("network_id")).join(F.broadcast(now), "network_id")
    rows = ids.select(
        "network_id", F.col("s_suppkey"),
        F.when(key % 5 == 0, "short").when(key % 5 == 1, F.sha2(F.lit("old"), 256)).otherwise(F.col("source_snapshot_id")).alias("source_snapshot_id"),
        "intelligence_snapshot_id", F.when(key % 3 == 0, "p0").otherwise("p1").alias("policy_hash"), F.lit(10.0).alias("risk_score"),
    )
    return risk.staleness(rows, now, "p1").groupBy("source_validity").agg(F.count("*").alias("assessments"))


@query(
    "k13_analysis_view",
    f"""WITH RECURSIVE {_EXPOSED} SELECT subject_id AS wallet, CASE direction WHEN 'RECEIVED_FROM_SEED' THEN 'incoming_exposure' ELSE 'outgoing_exposure' END AS kind, count(*) AS items FROM pth GROUP BY 1, 2
        UNION ALL SELECT address, 'cluster_membership', 1 FROM (SELECT DISTINCT address FROM claims)""",
)
def analysis_view(t: Tables) -> DataFrame:
    clusters = current_claims(t).select(
        F.col("address").alias("subject_id"), F.lit("reviewed_entity").alias("heuristic"),
        F.col("entity_id").alias("cluster_id"), "confidence",
    )
    found = exposure.expose_pairs(t.edges(), None, current_claims(t), AT)
    return risk.analysis_view(_paths(t, found), clusters).groupBy("wallet", "kind").agg(F.count("*").alias("items"))


@query(
    "k14_quality_warnings",
    """WITH a AS (SELECT wallet, count(*) AS n, count(DISTINCT asset_id) AS assets FROM wallet_edges GROUP BY 1),
    w AS (SELECT 'C' || c_custkey AS wallet FROM customer UNION SELECT wallet FROM a),
    x AS (SELECT w.wallet, coalesce(n, 0) AS n, coalesce(assets, 0) AS assets, pend.address IS NOT NULL AS pending FROM w LEFT JOIN a USING (wallet)
        LEFT JOIN (SELECT address FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1 AND review_status = 'pending') pend ON pend.address = w.wallet)
    SELECT wallet, concat_ws(',', CASE WHEN n = 0 THEN 'no_observed_flow_history' END, CASE WHEN n > 0 AND n < 3 THEN 'low_observed_flow_volume' END,
        CASE WHEN assets = 0 THEN 'no_indexed_wallet_holdings' END, CASE WHEN pending THEN 'identity_claims_pending_review' END) AS warnings FROM x""",
)
def quality_warnings(t: Tables) -> DataFrame:
    per = scope.wallet_edges(t.edges()).groupBy("wallet").agg(
        F.count("*").alias("total_transfers"), F.countDistinct("asset_id").alias("asset_count")
    )
    everyone = t.raw("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("wallet"))
    pending = current_claims(t).where(F.col("review_status") == "pending").groupBy(F.col("address").alias("wallet")).agg(
        F.count("*").alias("pending_reviews")
    )
    rows = everyone.unionByName(per.select("wallet")).distinct().join(per, "wallet", "left").join(pending, "wallet", "left")
    rows = rows.fillna(0, ["total_transfers", "asset_count", "pending_reviews"]).withColumns(
        {"truncated": F.lit(False), "metadata_gaps": F.lit(0), "incomplete_balances": F.lit(0)}
    )
    return op.quality_warnings(rows).select("wallet", F.array_join("warnings", ",").alias("warnings"))


# quality and operations --------------------------------------------------------


def _canonical(t: Tables) -> DataFrame:
    return visibility.canonical_blocks(t.blocks(), t.state())


@query(
    "n01_gap_scan",
    """WITH h AS (SELECT unnest(range(0, (SELECT last_block_number + 1 FROM state))) AS block_number), n AS (SELECT block_number, count(*) AS k FROM utxs GROUP BY 1),
    j AS (SELECT h.block_number, b.block_hash, b.transaction_count, coalesce(k, 0) AS k, b.parent_hash, p.block_hash AS ph, b.trace_coverage FROM h LEFT JOIN canonical_blocks b USING (block_number) LEFT JOIN n USING (block_number)
        LEFT JOIN canonical_blocks p ON p.block_number = h.block_number - 1),
    r AS (SELECT block_number, CASE WHEN block_hash IS NULL THEN 'missing_block' ELSE concat_ws(',', CASE WHEN transaction_count <> k THEN 'transaction_count_mismatch' END,
        CASE WHEN block_number > 0 AND (ph IS NULL OR parent_hash <> ph) THEN 'parent_not_verified' END, CASE WHEN trace_coverage <> 1 THEN 'trace_coverage_missing' END) END AS reasons FROM j)
    SELECT * FROM r WHERE reasons <> ''""",
)
def gap_scan(t: Tables) -> DataFrame:
    found = quality.gaps(_canonical(t), t.utxo_txs(), t.state(), utxo=False, require_trace=True)
    return found.select("block_number", F.array_join("reasons", ",").alias("reasons"))


@query(
    "n02_health_status",
    """WITH c AS (SELECT c_nationkey AS n, count(*) AS tip, count(*) FILTER (c_acctbal < -900) AS stale, count(*) FILTER (c_acctbal > 9980) AS failed FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS n, count(*) FILTER (s_acctbal < -500) AS dead, count(*) FILTER (s_acctbal > 9800) AS missing FROM supplier GROUP BY 1),
    a AS (SELECT n_nationkey AS n, n_nationkey % 6 <> 5 AS started, c.tip, CASE WHEN n_nationkey % 7 <> 3 THEN c.tip + n_nationkey * 11 - 5 END AS head, coalesce(stale, 0) AS stale, coalesce(failed, 0) AS failed, coalesce(dead, 0) AS dead, coalesce(missing, 0) AS missing
        FROM nation JOIN c ON c.n = n_nationkey LEFT JOIN s ON s.n = n_nationkey)
    SELECT 'net' || n AS network_id, CASE WHEN NOT started THEN 'NOT_STARTED' WHEN head IS NULL OR stale > 0 OR failed > 0 OR dead > 0 OR missing > 0 THEN 'DEGRADED' WHEN greatest(head - tip, 0) > 100 THEN 'LAGGING' ELSE 'HEALTHY' END AS status,
        CASE WHEN started AND head IS NOT NULL THEN greatest(head - tip, 0) END AS lag_blocks, stale AS stale_processing_blocks, failed AS failed_blocks, dead AS non_retryable_failures, missing AS missing_block_count FROM a""",
)
def health_status(t: Tables) -> DataFrame:
    """Every nation as a network: customers are its blocks, the balances tell which of them have trouble."""
    net = lambda c: F.concat(F.lit("net"), F.col(c).cast("string")).alias("network_id")
    blocks = t.raw("customer").groupBy(net("c_nationkey")).agg(
        F.count("*").alias("tip"), F.count_if(F.col("c_acctbal") < -900).alias("stale"), F.count_if(F.col("c_acctbal") > 9980).alias("failed")
    )
    key = F.regexp_extract("network_id", "([0-9]+)$", 1).cast("bigint")
    state = blocks.join(t.raw("nation").select(net("n_nationkey")), "network_id").select(
        "network_id", F.lit(1).alias("revision"), (key % 6 != 5).cast("int").alias("initialized"), F.col("tip").alias("last_block_number")
    )
    journal = blocks.select("network_id", F.col("stale").alias("processing_blocks"), F.col("stale").alias("stale_processing_blocks"), F.col("failed").alias("failed_blocks"))
    trouble = t.raw("supplier").groupBy(net("s_nationkey")).agg(F.count_if(F.col("s_acctbal") < -500).alias("failures"), F.count_if(F.col("s_acctbal") > 9800).alias("missing"))
    heads = blocks.select("network_id", F.when(key % 7 != 3, F.col("tip") + key * 11 - 5).alias("head"))
    found = quality.health(state, journal, trouble.withColumn("status", F.lit("dead_letter")), trouble, heads, 100)
    return found.drop("processing_blocks")


_SANCTION_NETWORK = "CASE s_suppkey % 5 WHEN 0 THEN 'ETH' WHEN 1 THEN 'XBT' WHEN 2 THEN 'BSC' WHEN 3 THEN 'XMR' ELSE 'TRX' END"
_SANCTIONED = f"""entries AS (SELECT s_suppkey AS k, s_name, {_SANCTION_NETWORK} AS asset, CASE s_suppkey % 5 WHEN 0 THEN 'eip155:1' WHEN 1 THEN 'bip122:000000000019d6689c085ae165831e93' WHEN 2 THEN 'eip155:56' WHEN 4 THEN 'tron:mainnet' END AS network_id,
    CASE WHEN s_suppkey % 5 IN (0, 2) THEN '0x' || lpad('ab' || s_suppkey, 40, '0') WHEN s_suppkey % 5 = 1 AND s_suppkey % 3 <> 0 THEN '1' || lpad('A' || translate(s_suppkey::varchar, '0', 'z'), 30, 'B') ELSE 'not an address ' || s_suppkey END AS address FROM supplier)"""


def sanction_entries(t: Tables) -> DataFrame:
    """Suppliers as entries of a published list: written as XML, read as such a list."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    asset = F.when(k % 5 == 0, "ETH").when(k % 5 == 1, "XBT").when(k % 5 == 2, "BSC").when(k % 5 == 3, "XMR").otherwise("TRX")
    hex_ = F.concat(F.lit("0x"), F.lpad(F.concat(F.lit("aB"), text), 40, "0"))
    coin = F.concat(F.lit("1"), F.lpad(F.concat(F.lit("A"), F.translate(text, "0", "z")), 30, "B"))
    address = F.when((k % 5).isin(0, 2), hex_).when((k % 5 == 1) & (k % 3 != 0), coin).otherwise(F.concat(F.lit("not an address "), text))
    kind = lambda a: F.concat(F.lit("Digital Currency Address - "), a)
    one = lambda uid, a, b: F.struct(uid.alias("uid"), a.alias("idType"), b.alias("idNumber"))
    ids = F.array(one(text, kind(asset), address), one(F.concat(text, F.lit("b")), F.lit("Passport"), F.lit("X & Y <1>")))
    entries = t.raw("supplier").select(text.alias("uid"), F.col("s_name").alias("lastName"), F.lit("Entity").alias("sdnType"), F.struct(ids.alias("id")).alias("idList"))
    path = f"{shared_dir(t.spark)}/sanction-list-{uuid.uuid4().hex}"
    entries.write.format("xml").option("rootTag", "sdnList").option("rowTag", "sdnEntry").save(path)
    return files.read_sanction_list(t.spark, path)


_VALID = {"bip122:000000000019d6689c085ae165831e93": ids.BITCOIN_ADDRESS, "eip155:1": ids.EVM_ADDRESS, "eip155:56": ids.EVM_ADDRESS, "tron:mainnet": ids.TRON_ADDRESS}


@query(
    "n05_sanction_claims",
    f"""WITH {_SANCTIONED} SELECT 'list:' || k || ':' || network_id || ':' || substr(sha256(address), 1, 16) AS claim_id, network_id, address, k::varchar AS uid, s_name AS entity_name, 'entity' AS entity_type, asset AS symbols, 'pending' AS review_status
        FROM entries WHERE network_id IS NOT NULL AND address NOT LIKE 'not an%'""",
)
def sanctioned(t: Tables) -> DataFrame:
    claims, _ = quality.sanction_claims(sanction_entries(t), "list", _VALID)
    return claims.withColumn("symbols", F.array_join("symbols", ","))


@query(
    "n05_sanction_excluded",
    f"""WITH {_SANCTIONED} SELECT k::varchar AS uid, network_id, asset AS symbol, address, 'address_not_valid_for_supported_network' AS reason FROM entries WHERE network_id IS NOT NULL AND address LIKE 'not an%'""",
)
def sanction_excluded(t: Tables) -> DataFrame:
    return quality.sanction_claims(sanction_entries(t), "list", _VALID)[1]


@query(
    "n03_failure_list",
    """WITH c AS (SELECT * FROM failures QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY revision DESC) = 1)
    SELECT failure_id, block_number, attempts FROM c WHERE status = 'pending' AND block_number BETWEEN 100 AND 4000 AND (block_number, failure_id) > (200, 'f') ORDER BY block_number, failure_id LIMIT 50""",
)
def failure_list(t: Tables) -> DataFrame:
    return quality.failure_list(t.failures(), "pending", 100, 4_000, (200, "f"), 50).select(
        "failure_id", "block_number", "attempts"
    )


@query(
    "n06_claim_import_check",
    """SELECT rule, count(*) AS claims FROM (SELECT 'reviewer' AS rule FROM supplier WHERE s_suppkey % 8 = 1 UNION ALL SELECT 'confidence_range' FROM supplier WHERE s_suppkey % 11 = 3
        UNION ALL SELECT 'expected_revision' FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'cross_network' FROM supplier WHERE s_suppkey % 13 = 5) GROUP BY 1""",
)
def claim_import_check(t: Tables) -> DataFrame:
    key = F.regexp_extract("address", "([0-9]+)$", 1).cast("bigint")
    new = current_claims(t).withColumns(
        {
            "review_status": F.lit("approved"), "reviewed_by": F.when(key % 8 == 1, " ").otherwise("x"),
            "confidence": F.when(key % 11 == 3, 1.5).otherwise(0.5), "expected_revision": F.lit(2).cast("bigint"),
            "network_id": F.when(key % 13 == 5, "other").otherwise(F.col("network_id")),
        }
    )
    return quality.check_claims(new, t.claims()).groupBy("rule").agg(F.count("*").alias("claims"))


@query(
    "n07_reviews_applied",
    """WITH cur AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1),
    rv AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY revision DESC, review_id DESC) = 1)
    SELECT claim_id, coalesce(CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'revoke' THEN 'revoked' END, cur.review_status) AS review_status,
        CASE WHEN coalesce(decision, cur.review_status) IN ('approve', 'approved') THEN 1 ELSE 0 END AS is_active FROM cur LEFT JOIN rv ON subject_id = claim_id""",
)
def reviews_applied(t: Tables) -> DataFrame:
    return quality.apply_reviews(t.claims(), t.reviews()).select("claim_id", "review_status", "is_active")


@query(
    "n08_pending_reviews",
    "SELECT source_id, claim_kind, count(*) AS pending FROM (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1) WHERE review_status = 'pending' GROUP BY 1, 2",
)
def pending_reviews(t: Tables) -> DataFrame:
    return quality.pending_reviews(t.claims())


@query(
    "n08_review_history",
    "SELECT subject_id, review_id, decision, row_number() OVER (PARTITION BY subject_id ORDER BY revision, review_id) AS step FROM reviews",
)
def review_history(t: Tables) -> DataFrame:
    return quality.review_history(t.reviews()).select("subject_id", "review_id", "decision", "step")


@query(
    "n09_metadata_backlog",
    """SELECT 'part' || l_partkey AS asset_id, min(l_orderkey) AS discovered_block FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)
        AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 = 3) GROUP BY 1""",
)
def metadata_backlog(t: Tables) -> DataFrame:
    """Parts over size 25 have metadata, sizes ending in three back off."""
    asset = lambda c: F.concat(F.lit("part"), F.col(c).cast("string")).alias("asset_id")
    net = F.lit("n").alias("network_id")
    found = t.raw("lineitem").select(net, asset("l_partkey"), F.col("l_orderkey").alias("block_number"))
    part = t.raw("part")
    known = part.where(F.col("p_size") > 25).select(net, asset("p_partkey"), F.lit("complete").alias("metadata_status"), F.lit(1).alias("revision"))
    jobs = part.select(net, asset("p_partkey"), F.when(F.col("p_size") % 10 == 3, 200).otherwise(50).alias("next_attempt_unix_ms"), F.lit(1).alias("revision"))
    return quality.metadata_backlog(found, known, jobs, 100).select("asset_id", "discovered_block")


@query(
    "n10_range_profile",
    """SELECT 'outputs' AS "table", block_number // 50 * 50 AS range_start, count(*) AS rows FROM outputs WHERE block_number BETWEEN 0 AND 1000000 GROUP BY 2
        UNION ALL SELECT 'inputs', block_number // 50 * 50, count(*) FROM inputs WHERE block_number BETWEEN 0 AND 1000000 GROUP BY 2""",
)
def range_profile(t: Tables) -> DataFrame:
    return quality.range_profile({"outputs": t.utxo_outputs(), "inputs": t.utxo_inputs()}, 0, 1_000_000, 50)

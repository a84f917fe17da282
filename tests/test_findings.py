"""Cases of the review's findings: each failed before its change."""

import pytest

import __spark_entry__ as entry
from compare import compare, database

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(PATH)


def test_analysis_view_equals_sql(spark, db):
    ok, note = compare(spark, db, PATH, "k13_analysis_view", entry.queries()["k13_analysis_view"], entry.oracle_sql()["k13_analysis_view"])
    assert ok, note


def test_forwarding_looks_near_the_amount_only():
    """A hub's slice: every receipt with one fitting payment among many of other sizes."""
    from collections import namedtuple

    from chainweft.operators import matching

    Row = namedtuple("Row", "wallet part direction at transaction_index tx_hash event_index asset_id token amount_raw home carried")
    n = 3_000
    ins = [Row("w", 0, "in", k, k, f"i{k}", k, "a", "", str(10**40 * 3 ** (k % 60) + k), True, None) for k in range(n)]
    outs = [Row("w", 0, "out", n + k, k, f"o{k}", k, "a", "", "7", True, None) for k in range(n)]
    outs += [Row("w", 0, "out", 2 * n + k, k, f"p{k}", k, "a", "", r.amount_raw, True, None) for k, r in enumerate(reversed(ins))]
    looked = []

    class Watched(set):
        def __contains__(self, tx):
            looked.append(tx)
            return set.__contains__(self, tx)

    rows = [*ins, *outs]
    rows[0] = rows[0]._replace(carried=["none"])
    matching.set = Watched
    try:
        found = matching._greedy(rows, 10 * n, 10)
    finally:
        del matching.set
    assert len(found) == n and len({p[3] for p in found}) == n
    assert len(looked) < 200 * n


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_decoded_once(spark):
    from chainweft.operators import extract
    from chainweft.plans import evidence
    from chainweft.sources.tables import Tables

    orders = extract.nft_orders(evidence.order_logs(Tables(spark, PATH)))
    assert plan_of(orders).count("Generate posexplode") == 1
    moves = spark.createDataFrame([], "tx_hash string, relationship_id string, asset_id string, amount_raw string, from_address string, to_address string")
    assert plan_of(extract.nft_order_edges(orders, moves)).count("Generate posexplode") == 1


def test_orders_read_bytes_as_the_text_rules_say(spark):
    """Prefix and case don't matter; odd lengths, other characters and missing data decode to nothing."""
    from chainweft.operators import extract

    w = lambda n: f"{n:064x}"
    who = "ab" * 20
    body = w(5) + w(int(who, 16)) + w(128) + w(9 * 32) + w(1) + w(2) + w(int(who, 16)) + w(2**255) + w(1) + w(1) + w(0) * 3 + w(2**60) + w(int(who, 16))
    topics = ["0x" + extract.ORDER_FULFILLED.upper(), "0x" + w(int(who, 16)), "0x" + w(0)]
    datas = ["0x" + body, body.upper(), "0X" + body, body[:-1], body[:-1] + "g", None, "", "0x", body + w(0), "é" * 32 + body]
    rows = [(f"t{k}", k, "0xm", topics, d) for k, d in enumerate(datas)]
    df = spark.createDataFrame(rows, "tx_hash string, log_index int, address string, topics array<string>, data string")
    found = extract.nft_orders(df).orderBy("log_index", "item_index").collect()
    assert [(r.log_index, r.item_type, r.identifier, r.amount_raw) for r in found] == [
        x for k in range(3) for x in ((k, "erc721", str(2**255), "1"), (k, "native", "0", str(2**60)))
    ]
    assert {(r.order_hash, r.offerer, r.recipient) for r in found} == {("0x" + w(5), "0x" + who, "0x" + who)}


def test_pool_events_read_each_log_once(spark, db):
    from chainweft.operators import events
    from chainweft.plans import evidence
    from chainweft.sources.tables import Tables

    t = Tables(spark, PATH)
    registry = evidence.registry_rows(t).where("false").selectExpr("*", "0.9D AS confidence")
    plan = plan_of(events.log_events(evidence.pool_logs(t), evidence.hex_edges(t), registry))
    assert "d78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822" not in plan
    for name in ("j10_pool_events", "j12_registry_events"):
        ok, note = compare(spark, db, PATH, name, entry.queries()[name], entry.oracle_sql()[name])
        assert ok, note


def test_last_hop_of_best_exposure_is_folded_without_being_written(spark, monkeypatch):
    """Levels before the last are written for the next hop; the last goes straight into the fold of its pairs."""
    from chainweft.operators import exposure

    written = []
    kept = exposure.materialise
    monkeypatch.setattr(exposure, "materialise", lambda df, label="step": written.append(label) or kept(df, label))
    rows = [
        ("r1", "t1", 1, 0, 1, 1_000, "S", "a", "x", None, "50", "native_transfer"), ("r2", "t2", 2, 0, 2, 2_000, "a", "b", "x", None, "30", "native_transfer"),
        ("r3", "t3", 3, 0, 3, 3_000, "a", "b", "x", None, "30", "native_transfer"), ("r4", "t4", 4, 0, 4, 4_000, "S", "b", "x", None, "50", "native_transfer"),
    ]
    edges = spark.createDataFrame(rows, (
        "relationship_id string, tx_hash string, block_number long, transaction_index long, event_index long, "
        "block_timestamp_unix_ms long, from_address string, to_address string, asset_id string, token_id string, amount_raw string, transfer_type string"
    ))
    seeds = spark.createDataFrame([("S",)], "address string")
    services = spark.createDataFrame([], "address string")
    for hops, b in ((1, (1, 1, ["r4"])), (2, (1, 3, ["r4"]))):
        written.clear()
        found = {r.exposed_address: (r.hop_distance, r.path_count, list(r.relationship_ids)) for r in exposure.expose_best(edges, seeds, services, 5_000, hops).collect()}
        assert found == {"a": (1, 1, ["r1"]), "b": b}
        assert written.count("best-hop") == hops - 1


def test_counterparties_deal_legs_once(spark, monkeypatch):
    """One shuffle of the legs serves both sides of a transaction, and pairs are folded once for rows and totals."""
    from chainweft.operators import activity

    written = []
    kept = activity.materialise
    monkeypatch.setattr(activity, "materialise", lambda df, label="step": written.append(df) or kept(df, label))
    leg = "address string, network_id string, block_number long, block_hash string, block_timestamp_unix_ms long, commit_id string, revision long, tx_hash string, transaction_index long, script_hex string, value_sats long"
    rows = lambda *legs: spark.createDataFrame([(a, "n", 1, "h", at, "c", 1, tx, 0, s, 5) for a, tx, at, s in legs], leg)
    ins = rows(("a", "t1", 10, "1"), ("a", "t1", 10, "1"), (None, "t1", 10, "2"), ("b", "t2", 20, "3"), ("a", "gone", 30, "1"))
    outs = rows(("a", "t1", 10, "1"), ("b", "t1", 10, "3"), ("a", "t2", 20, "1"), ("b", "gone", 30, "3"))
    txs = ins.unionByName(outs).where("tx_hash <> 'gone'").select(*activity.OCCURRENCE).distinct()
    script = "script:d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35"
    want = {
        ("a", "script", script, 1, 1, 0, 10, 10, 2, 2, 1), ("a", "address", "b", 2, 1, 1, 10, 20, 2, 2, 1),
        ("b", "script", script, 1, 1, 0, 10, 10, 2, 2, 1), ("b", "address", "a", 2, 1, 1, 10, 20, 2, 2, 1),
    }
    for scoped in (txs, activity.wallet_legs(ins, outs).join(txs, activity.OCCURRENCE)):
        assert {tuple(r) for r in activity.utxo_counterparties(scoped, ins, outs).collect()} == want
    assert len(written) == 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        entry.queries()["e04_utxo_counterparties"](spark, PATH)
        assert "ReusedExchange" in written[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_deposit_steps_go_through_once(spark):
    """A hash is turned round without being computed for each of its bytes, and a deposit's steps are no self-joins."""
    from chainweft.operators import matching
    from pyspark.sql import functions as F

    digest = F.sha2(F.col("id").cast("string"), 256)
    df = spark.range(3).select(digest.alias("a"), matching.reversed_hash(matching.reversed_hash(digest)).alias("b"), matching.reversed_hash(digest).alias("c"))
    assert all(r.a == r.b and bytes.fromhex(r.c) == bytes.fromhex(r.a)[::-1] for r in df.collect())
    assert plan_of(df.select("b")).count("sha2") == 1
    deposits = spark.createDataFrame([("t1", 0, "d1", 5), ("t2", 0, "d2", 5), ("t3", 0, "d3", 5)], "tx_hash string, output_index int, deposit_key string, at int")
    steps = spark.createDataFrame([("d1", 9, "x"), ("d1", 7, "y"), ("d1", 3, "z"), ("d2", 4, "w")], "deposit_key string, time int, name string")
    found = matching._first_fit(deposits, steps, ["deposit_key"], F.col("time") > F.col("at"), ["time", "name"])
    assert {(r.tx_hash, r.at, r.time, r.name) for r in found.collect()} == {("t1", 5, 7, "y"), ("t2", 5, None, None), ("t3", 5, None, None)}
    assert plan_of(found).count("Join") == 1


def test_pair_exposure_shuffles_no_steps(spark, monkeypatch):
    """Steps are written in buckets of a hop's keys, without those that no walk takes; a busy address is dealt over several."""
    from chainweft.operators import exposure

    written = []
    kept = exposure.bucketed
    monkeypatch.setattr(exposure, "bucketed", lambda df, keys, label="step": written.append((df, keys)) or kept(df, keys, label))
    edge = (
        "relationship_id string, tx_hash string, block_number long, transaction_index long, block_timestamp_unix_ms long, "
        "from_address string, to_address string, asset_id string, token_id string, amount_raw string"
    )
    rows = [("r0", "t0", 0, 0, 0, "S", "m", "x", None, "9")] + [(f"r{k}", f"t{k}", k, 0, k, "m", f"e{k}", "x", None, "9") for k in range(1, 41)]
    rows += [("q1", "u1", 50, 0, 50, "S", "X", "x", None, "9"), ("q2", "u2", 51, 0, 51, "X", "z", "x", None, "9"), ("q3", "u3", 52, 0, 52, "D", "y", "x", None, "9")]
    edges = spark.createDataFrame(rows, edge)
    claim = "network_id string, claim_id string, address string, entity_type string, entity_id string, is_exposure_seed int, risk_level int, confidence double"
    claims = spark.createDataFrame([("n", "c1", "S", "unknown", "e1", 1, 80, 1.0), ("n", "c2", "X", "exchange", "e2", 0, 0, 1.0), ("n", "c3", "D", "dex", "e3", 1, 80, 1.0)], claim)
    for found in (exposure.expose_pairs(edges, None, claims, 100, 2), exposure.best_pairs(edges, claims, 100, 2)):
        ends = {(r.seed_address, r.subject_id, r.hop_count) for r in found.where("direction = 'RECEIVED_FROM_SEED'").collect()}
        assert ends == {("S", "m", 1), ("S", "X", 1), ("D", "y", 1)} | {("S", f"e{k}", 2) for k in range(1, 41)}
    assert len(written) == 2
    for steps, keys in written:
        assert keys == ["direction", "node", "asset_id", "token", "part"]
        nodes = [(r.node, r.part) for r in steps.collect()]
        assert "X" not in {n for n, _ in nodes} and "D" in {n for n, _ in nodes}
        assert len({p for n, p in nodes if n == "m"}) > 1


def test_wallet_aggregate_folds_pairs_by_direction(spark):
    """A pair's row carries one set of limbs; self-transfers count on both sides (F20)."""
    import re

    from chainweft.operators import activity

    rows = [("t1", 0, "A", "B", "a1", "5"), ("t1", 0, "B", "A", "a1", "7"), ("t2", 90_000_000, "A", "A", "a2", "9" * 40), ("t3", 1, "A", "C", "a1", "0")]
    edges = spark.createDataFrame(rows, "tx_hash string, block_timestamp_unix_ms long, from_address string, to_address string, asset_id string, amount_raw string")
    flags = spark.createDataFrame([("t1", 1, 0, 0, 0, 0, 0, 1)], "tx_hash string, is_swap int, is_bridge int, is_mint int, is_burn int, is_liquidity_add int, is_liquidity_remove int, is_contract_call int")
    exchanges = spark.createDataFrame([("B", 0.9)], "address string, confidence double")
    found = activity.wallet_aggregate(activity.enrich(edges, flags, exchanges))
    folds = re.findall(r"Aggregate \[([^\]]*peer#[^\]]*)\], \[", found._jdf.queryExecution().optimizedPlan().toString())
    assert any("wallet" in x and "direction" in x for x in folds) and not any("wallet" in x and "direction" not in x for x in folds)
    a = {r.wallet: r for r in found.collect()}["A"]
    assert (a.total_transfers, a.incoming_transfers, a.outgoing_transfers, a.unique_senders, a.unique_receivers) == (4, 2, 3, 2, 3)
    assert (a.total_volume_in_raw, a.total_volume_out_raw) == (str(int("9" * 40) + 7), str(int("9" * 40) + 5))
    assert (a.unique_transactions, a.active_days, a.token_diversity, a.swap_transfers, a.exchange_transfers) == (3, 2, 2, 2, 2)


def test_flow_trend_carries_flags_as_bits(spark):
    """One number a transaction holds all flags; counts stay those of distinct transactions (F23, F24)."""
    from chainweft.operators import activity

    kinds = ["is_swap", "is_bridge", "is_mint", "is_burn", "is_liquidity_add", "is_liquidity_remove", "is_contract_call"]
    rows = [("t1", 0, "A", "B"), ("t1", 0, "A", "B"), ("t2", 1, "B", "A"), ("t3", 2, "A", "A"), ("t4", 3, "A", "C")]
    edges = spark.createDataFrame([(*r, "a") for r in rows], "tx_hash string, block_timestamp_unix_ms long, from_address string, to_address string, asset_id string")
    flags = spark.createDataFrame([("t1", 1, 0, 1, 0, 0, 0, 1), ("t2", 1, 1, 0, 0, 0, 1, 0), ("t3", 0, 0, 0, 1, 1, 0, 0)], ["tx_hash", *kinds])
    found = activity.flow_trend(activity.enrich(edges, flags, spark.createDataFrame([], "address string, confidence double")), None)
    assert "bit_or" in found._jdf.queryExecution().optimizedPlan().toString()
    a = {r.wallet: r for r in found.collect()}["A"]
    assert (a.incoming_transfers, a.outgoing_transfers, a.unique_transactions) == (2, 4, 4)
    assert [a[f"{k[3:]}_transactions"] for k in kinds] == [2, 1, 1, 1, 1, 1, 1]


def test_cluster_facts_are_narrow_and_stored_once(spark, monkeypatch, tmp_path):
    """The state keeps what the rule needs; repeated rows, later batches and replaced blocks leave each standing fact once (F12)."""
    from chainweft.plans import streams as plans
    from chainweft.sources.tables import Tables
    from chainweft.streaming import streams

    class Seen(Exception):
        pass

    def seen(sink, schema, *rest):
        raise Seen(*schema.names)

    monkeypatch.setattr(plans.op, "ClusterState", seen)
    with pytest.raises(Seen) as schema:
        plans.clusters_stream(Tables(spark, PATH))
    assert set(schema.value.args) == {"relationship_id", "block_number", "block_hash", "destination", "asset_id", "token", "from_address", "amount_raw"}
    monkeypatch.undo()

    columns = "relationship_id string, block_number long, block_hash string, destination string, asset_id string, token string, from_address string, amount_raw string"
    edge = lambda i, block, sender, where="D": (f"r{i}", int(block[1:]), block, where, "a", "", sender, "5")
    blocks = lambda *names: spark.createDataFrame([(int(n[1:]), n) for n in names], "block_number long, block_hash string")
    batches = [
        ([edge(1, "b1", "A"), edge(1, "b1", "A"), edge(2, "f2", "B"), edge(9, "x1", "Z")], blocks("b1", "f2")),
        ([edge(1, "b1", "A"), edge(3, "f2", "C")], blocks("b1", "f2")),
        ([edge(3, "f2", "C")], blocks("b1", "f2")),
        ([edge(4, "b2", "E"), edge(4, "b2", "E"), edge(5, "b3", "F"), edge(6, "b3", "F", "G")], blocks("b1", "b2", "b3")),
    ]
    empty = spark.createDataFrame([], columns)
    state = streams.ClusterState(streams.Sink(spark, "facts", str(tmp_path)), empty.schema, ["destination", "asset_id", "token"], plans._shared)
    got = []
    for k, (rows, canonical) in enumerate(batches):
        state.add(spark.createDataFrame(rows, columns), k, canonical)
        got.append((state.cursor(k + 1), sorted((r.destination, r.distinct_senders, r.transfers, r.last_block) for r in state.read().collect())))
    assert got == [((0, 2, "f2"), []), ((0, 2, "f2"), [("D", 3, 3, 2)]), ((0, 2, "f2"), [("D", 3, 3, 2)]), ((1, 3, "b3"), [("D", 3, 3, 3)])]
    assert sorted(r.relationship_id for r in state.facts(1, 9).collect()) == ["r1", "r4", "r5", "r6"]
    assert sorted(r.relationship_id for r in state.facts(0, 9).collect()) == ["r1", "r2", "r3"]

    # groups are folded where they lie; an attempt again, also by a state opened anew, leaves the same facts
    plan = state.discover(state.facts(1, 9).drop("epoch", "batch", "bucket"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    spark.sql(f"DROP TABLE {state.table}")
    again = streams.ClusterState(streams.Sink(spark, "facts", str(tmp_path)), empty.schema, ["destination", "asset_id", "token"], plans._shared)
    assert again.facts(1, 9).count() == 4
    again.add(spark.createDataFrame(batches[3][0][:-1], columns), 3, batches[3][1])
    assert sorted(r.relationship_id for r in again.facts(1, 9).collect()) == ["r1", "r4", "r5"]
    assert again.cursor(9) == (1, 3, "b3")


def test_path_steps_are_shuffled_once_a_side(spark, monkeypatch):
    """Steps are written in buckets of a hop's keys; typed steps without ids are one step however many edges make them (F21, F29)."""
    from chainweft.operators import graph

    written = []
    kept = graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, keys, label="step", once=False: written.append((keys, kept(df, keys, label, once))) or written[-1][1])
    pairs = spark.createDataFrame([("S0", "S6")], "source string, target string")
    line = [(f"r{k}{v}", f"t{k}", k, 0, f"S{k}", f"S{k + 1}", "x", None) for k in range(6) for v in "ab"[: 1 + k % 2]]
    edges = spark.createDataFrame(line, "relationship_id string, tx_hash string, block_number long, transaction_index long, from_address string, to_address string, asset_id string, token_id string")
    ways = {tuple(r.edge_ids) for r in graph.ordered_paths(edges, pairs, 6).collect()}
    assert len(ways) == 8 and {len(w) for w in ways} == {6}
    assert [keys for keys, _ in written] == [["node", "asset_id", "token"], ["next", "asset_id", "token"]]

    written.clear()
    legs = [("A", "t1"), ("A", "t1"), ("t1", "M"), ("t1", "M"), ("M", "t2"), ("t2", "B"), ("t1", "B"), ("A", "A")]
    typed = spark.createDataFrame(legs, "from_subject_id string, to_subject_id string")
    asked = spark.createDataFrame([("A", "B")], "source string, target string")
    found = graph.typed_paths(typed, asked, 4)
    assert "edge_ids" not in found.columns
    assert sorted((r.hop_count, tuple(r.nodes)) for r in found.collect()) == [(2, ("A", "t1", "B")), (4, ("A", "t1", "M", "t2", "B"))]
    ((keys, steps),) = written
    assert keys == ["node"] and steps.count() == 5
    assert sorted(map(tuple, (r.nodes for r in graph.typed_paths(typed, asked, 2).collect()))) == [("A", "t1", "B")]


def test_capped_exposure_moves_steps_once(spark, monkeypatch):
    """Steps are shuffled into their buckets and nowhere else; services that no path leaves keep none (F22)."""
    from chainweft.operators import exposure

    written = []
    kept = exposure.bucketed
    monkeypatch.setattr(exposure, "bucketed", lambda df, keys, label="step": written.append((df, keys)) or kept(df, keys, label))
    edge = (
        "relationship_id string, tx_hash string, block_number long, transaction_index long, block_timestamp_unix_ms long, "
        "from_address string, to_address string, asset_id string, token_id string, amount_raw string"
    )
    rows = [
        ("r0", "t0", 1, 0, 0, "S", "m", "x", None, "3"), ("r1", "t1", 2, 0, 0, "m", "a", "x", None, "1"), ("r2", "t2", 0, 0, 0, "m", "b", "x", None, "3"),
        ("r3", "t3", 1, 0, 0, "S", "X", "x", None, "1"), ("r4", "t4", 3, 0, 0, "X", "c", "x", None, "9"), ("r5", "t5", 1, 0, 0, "S", "n", "y", None, "5"),
        ("r6", "t6", 4, 0, 0, "D", "d", "x", None, "9"),
    ]
    seeds = spark.createDataFrame([("c1", "S", 80), ("c2", "D", 80)], "seed_id string, address string, risk_level int")
    services = spark.createDataFrame([("X",), ("D",)], "address string")
    found = exposure.expose_capped(spark.createDataFrame(rows, edge), seeds, services, 0, exposure.CappedOptions(max_hops=2)).where("direction = 'RECEIVED_FROM_SEED'").collect()
    # of m's four units one went on after it received
    assert {(r.seed_id, r.subject_id, r.hop_count, r.amount_share, r.service_mediated) for r in found} == {
        ("c1", "m", 1, 0.75, 0), ("c1", "X", 1, 0.25, 1), ("c1", "n", 1, 1.0, 0), ("c2", "d", 1, 1.0, 0), ("c1", "a", 2, 0.25, 0),
    }
    (steps, step_keys), (totals, total_keys) = written
    assert (step_keys, total_keys) == (["direction", "node", "asset_id", "part"], ["direction", "node", "asset_id"])
    assert not {"step_share", "step_weight"} & set(steps.columns)
    nodes = {r.node for r in steps.collect()}
    assert "X" not in nodes and {"S", "D", "m"} <= nodes
    m = totals.where("node = 'm' AND direction = 'RECEIVED_FROM_SEED'").collect()
    assert [(r.total, r.first_block, r.last_block) for r in m] == [(4.0, 0, 2)]


def test_bridge_moves_fold_hinted_edges_once(spark):
    """One join with the hints and one fold tell flow and zero address alike (F30)."""
    from chainweft.functions.ids import ZERO_ADDRESS
    from chainweft.operators import detect

    rows = [
        ("t1", ZERO_ADDRESS, "A", "x", "5"), ("t1", "A", "B", "x", "2"), ("t1", ZERO_ADDRESS, "A", "x", "9" * 60),  # A gains what was minted
        ("t1", "B", ZERO_ADDRESS, "y", "1"), ("t1", "C", "B", "y", "1"),  # B burns what it got: no net flow
        ("t2", "D", ZERO_ADDRESS, "x", "3"), ("t2", ZERO_ADDRESS, "D", "x", "1"), ("t2", "E", "E", "x", "7"),
        ("t3", ZERO_ADDRESS, "F", "x", "1"),
        ("t4", ZERO_ADDRESS, "G", "x", "1"), ("t4", "G", "H", "x", "4"), ("t4", ZERO_ADDRESS, ZERO_ADDRESS, "x", "8"),
    ]
    edges = spark.createDataFrame(rows, "tx_hash string, from_address string, to_address string, asset_id string, amount_raw string")
    hints = spark.createDataFrame([("t1",), ("t1",), ("t2",), ("t4",)], "tx_hash string")
    found = detect.bridge_moves(edges, hints)
    assert sorted(map(tuple, found.collect())) == [("t1", "A", "x", "bridge_in"), ("t2", "D", "x", "bridge_out")]
    assert plan_of(found).count("Join ") == 1


def test_best_exposure_writes_each_position_once(spark, monkeypatch):
    """Steps carry what their receiver still moves, so a hop looks nothing up and writes its positions once; hot senders are summed in slices (r04 F1)."""
    from chainweft.operators import exposure

    written = []
    kept = exposure.materialise
    monkeypatch.setattr(exposure, "materialise", lambda df, label="step": written.append((label, kept(df, label))) or written[-1][1])
    rows = [("r0", "t0", 1, 0, "S", "m", "x", "9"), ("r1", "t1", 5_000, 3, "S", "m", "x", "4")]
    rows += [(f"p{k}", f"u{k}", 1 + k * 2_500, 3, "m", f"e{k}", "x", str(10**30 + k)) for k in range(8)]
    rows += [("q", "v", 5_000, 3, "m", "f", "x", "7"), ("z", "w", 20_000, 0, "e7", "S", "x", "1"), ("y", "w", 20_001, 0, "e7", "g", "x", "1")]
    edge = "relationship_id string, tx_hash string, block_number long, transaction_index long, from_address string, to_address string, asset_id string, amount_raw string"
    edges = spark.createDataFrame(rows, edge).selectExpr("*", "block_number * 60000 AS block_timestamp_unix_ms", "'native_transfer' AS transfer_type")
    seeds, none = spark.createDataFrame([("S",)], "address string"), spark.createDataFrame([], "address string")
    results = []
    for least in (100_000, 2):
        written.clear()
        monkeypatch.setattr(exposure, "HOT_STEPS", least)
        found = exposure.expose_best(edges, seeds, none, 0, 3).collect()
        results.append(sorted((r.exposed_address, r.hop_distance, r.path_count, round(r.best_path_amount_share, 9), tuple(r.relationship_ids)) for r in found))
        assert [label for label, _ in written] == ["best-hot", "best-steps", "best-hop", "best-hop"]
        onward = {r.relationship_id: r.onward for r in written[1][1].collect()}
        after = lambda b, t: sum(int(r[7]) for r in rows if r[4] == "m" and (r[2], r[3]) > (b, t))
        assert onward["r0"] == float(after(1, 0)) and onward["r1"] == float(after(5_000, 3)) and onward["z"] is None
        assert onward["p7"] == 2.0 and onward["p1"] is None
    assert results[0] == results[1]
    assert {r[0]: r[1:3] for r in results[0]} == {"m": (1, 2), "f": (2, 1), "g": (3, 1), **{f"e{k}": (2, 2 if k > 1 else 1) for k in range(8)}}


def test_pass_through_deals_transfers_once(spark):
    """Slices count on their own: one shuffle of the transfers, no join, and pairs across slices and inside transactions right (r04 F15, F7)."""
    from chainweft.operators import matching

    window = 10
    rows = [(f"t{at}{k}", "ab"[k % 2 :] + "c", "ba"[k % 2 :] + "c", "xy"[at % 3 == 0], at) for at in (0, 3, 635, 639, 640, 641, 645, 649, 650, 651, 1_279, 1_280, 1_289, 1_290) for k in range(3)]
    rows += [("same", "d", "a", "x", 640), ("same", "a", "e", "x", 640), ("self", "a", "a", "x", 700), ("late", "a", "e", "x", 710)]
    edges = spark.createDataFrame(rows, "tx_hash string, from_address string, to_address string, asset_id string, block_timestamp_unix_ms long")
    found = matching.pass_through(edges, window)
    want = {}
    for i in rows:
        for o in rows:
            if i[2] == o[1] and i[3] == o[3] and i[0] != o[0] and 0 <= o[4] - i[4] <= window:
                want[i[2]] = want.get(i[2], 0) + 1
    assert want and {r.wallet: r.pair_count for r in found.collect()} == want
    plan = plan_of(found)
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


def test_forwarding_deals_rows_once(spark, monkeypatch):
    """Rows are shuffled to their wallet slice once, looked at and written there; what cannot match is not written (r04 F5, F6, F9, F13)."""
    from chainweft.operators import matching

    written = []
    kept = matching.bucketed
    monkeypatch.setattr(matching, "bucketed", lambda df, keys, label, dealt: written.append((df, keys, kept(df, keys, label, dealt=dealt))) or written[-1][2])
    rows = [
        ("t1", "a", "w", "x", None, "100", 10), ("t2", "w", "b", "x", None, "95", 20), ("t3", "w", "b", "y", None, "95", 20), ("t4", "c", "w", "z", "7", "5", 95),
        ("t5", "w", "d", "z", "7", "5", 104), ("t6", "w", "d", "z", "8", "5", 104), ("t7", "w", "w", "x", None, "95", 21), (None, "a", "w", None, None, "5", 30), ("t9", "w", "a", None, None, "5", 31),
    ]
    edge = "tx_hash string, from_address string, to_address string, asset_id string, token_id string, amount_raw string, block_timestamp_unix_ms long"
    edges = spark.createDataFrame(rows, edge).selectExpr("*", "0L AS transaction_index", "0L AS event_index")
    found = matching.forwarding_pairs(edges, 20, 10, 100)
    assert {(r.wallet, r.incoming_tx, r.outgoing_tx) for r in found.collect()} == {("w", "t1", "t2"), ("w", "t4", "t5")}
    ((dealt, keys, stored),) = written
    assert keys == ["wallet", "part"] and plan_of(dealt).count("RepartitionByExpression") == 1 and "Join" not in plan_of(dealt)
    assert sorted((r.tx_hash, r.part) for r in stored.collect()) == [("t1", 0), ("t2", 0), ("t4", 0), ("t5", 0)]


def test_witness_meets_legs_on_a_digest(spark):
    """A leg is shuffled as its digest; nulls and texts that join to the same characters stay apart (r04 F10)."""
    from chainweft.operators import matching

    leg = "network_id string, block_number long, block_hash string, block_timestamp_unix_ms long, commit_id string, revision long, tx_hash string, transaction_index long, address string, script_hex string, value_sats long"
    legs = lambda rows, more: spark.createDataFrame([("n", 1, "b", 5, "c", 1, *r) for r in rows], f"{leg}, {more}")
    ins = legs([("t1", 0, "a", "6a", 5, 0, "p", 1), ("t1", 0, "a", "6a", 5, 0, "p", 1), ("t2", 0, None, "6b", 7, 1, None, None)], "input_index long, prev_tx_hash string, prev_output_index long")
    outs = legs([("t1", 0, "b", "6c", 4, 0), (None, 0, "b", "6c", 4, 1)], "output_index long")
    edges = matching.utxo_edges(ins, outs)
    more = edges.where("tx_hash = 't1' AND prev_tx_hash = 'p'").selectExpr(*[f"{'NULL' if c == 'prev_tx_hash' else c} AS {c}" for c in edges.columns])
    found = matching.witness(edges.unionByName(more.distinct()), ins, outs)
    assert found.columns == [*edges.columns, "matched"]
    assert sorted((str(r.tx_hash), r.transfer_type, str(r.prev_tx_hash), r.matched) for r in found.collect()) == [
        ("None", "utxo_output", "None", 0), ("t1", "utxo_input", "None", 0), ("t1", "utxo_input", "p", 1), ("t1", "utxo_input", "p", 1),
        ("t1", "utxo_output", "None", 1), ("t2", "utxo_input", "None", 1),
    ]
    assert "__leg" in plan_of(found).split("Join", 1)[1].splitlines()[0]


def test_wallet_folds_move_no_rows_after_the_deal(spark):
    """Profiles and aggregates deal rows by wallet and part of its peers, and folds to a wallet get a row a part (r04 F14, F11)."""
    import re

    from chainweft.operators import activity

    rows = [(f"t{k}", k, "A", f"B{k % 40}", f"a{k % 3}", str(k)) for k in range(400)] + [("s", 7, "A", "A", "a1", "9" * 40), ("n", 1, None, "A", "a1", "2"), ("m", 1, "C", "A", None, "3")]
    edges = spark.createDataFrame(rows, "tx_hash string, block_timestamp_unix_ms long, from_address string, to_address string, asset_id string, amount_raw string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = activity.peer_profiles(edges)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"hashpartitioning\([^)]*peer", plan)) == 0 and len(re.findall(r"Exchange hashpartitioning", plan)) == 3
        got = {(r.wallet, r.peer, r.role): r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 40 * 2 + 4 and not [k for k in got if k[0] is None]
    b0 = got["A", "B0", "receiver"]
    assert (b0.transfer_count, b0.total_volume_raw, b0.token_count, b0.dominant_token) == (10, str(sum(range(0, 400, 40))), 3, "a0")
    assert b0.share_of_wallet_transfers == 10 / 403 and got["A", None, "sender"].transfer_count == 1 and got["A", "A", "receiver"].total_volume_raw == "9" * 40
    none = spark.createDataFrame([], "tx_hash string, is_swap int, is_bridge int, is_mint int, is_burn int, is_liquidity_add int, is_liquidity_remove int, is_contract_call int")
    flows = activity.wallet_aggregate(activity.enrich(edges, none, spark.createDataFrame([("B1", 0.9)], "address string, confidence double")))
    assert re.search(r"RepartitionByExpression \[wallet#\d+, __part#\d+", flows._jdf.queryExecution().optimizedPlan().toString())
    a = {r.wallet: r for r in flows.collect()}["A"]
    assert (a.total_transfers, a.incoming_transfers, a.outgoing_transfers, a.unique_senders, a.unique_receivers, a.exchange_transfers) == (403, 3, 401, 3, 41, 10)
    assert a.total_volume_out_raw == str(sum(range(400)) + int("9" * 40)) and a.total_volume_in_raw == str(int("9" * 40) + 5)


def test_counterparties_meet_on_one_key(spark, monkeypatch):
    """Legs of one network, a constant, are dealt once for the joins as well; a null in an occurrence matches nothing (r04 F8)."""
    from chainweft.operators import activity
    from chainweft.sources.tables import Tables

    written = []
    monkeypatch.setattr(activity, "materialise", lambda df, label="step": written.append(df) or df)
    t = Tables(spark, PATH)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        activity.utxo_counterparties(t.utxo_headers(), t.utxo_inputs(), t.utxo_outputs())
        plan = written[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [x for x in plan.splitlines() if "Exchange" in x and not x.startswith("(")]
    assert sum("ReusedExchange" not in x for x in lines) == 3 and sum("ReusedExchange" in x for x in lines) == 1


def test_boundary_flows_stay_by_transaction(spark):
    """What a contract's legs say together is told where its transaction lies: edges are read once and joined by transaction alone (r04 F12)."""
    from chainweft.operators import activity

    rows = [("t1", "P", "c", "x", None, "5"), ("t1", "c", "Q", "y", None, "3"), ("t1", "P", "Z", "x", None, "2"), ("t2", "A", "b", "x", None, "9"), ("t2", "b", "A", "x", "7", "1")]
    edges = spark.createDataFrame(rows, "tx_hash string, from_address string, to_address string, asset_id string, token_id string, amount_raw string")
    txs = spark.createDataFrame([("t1", "P"), ("t2", "A")], "tx_hash string, from_address string")
    contracts = spark.createDataFrame([("t1", "c"), ("t1", "d"), ("t1", "c"), ("t2", "k"), ("t2", None)], "tx_hash string, contract string")
    found = activity.boundary_flows(edges, txs, contracts)
    assert sorted((r.tx_hash, r.contract, r.asset_id, r.amount_in, r.amount_out, r.boundary) for r in found.collect()) == [
        ("t1", "c", "x", "5", "0", "protocol"), ("t1", "c", "y", "0", "3", "protocol"), ("t1", "d", "x", "7", "0", "subject"), ("t2", "k", "x", "9", "0", "subject"),
    ]
    assert plan_of(found).count("Join ") == 2

"""Hand-built cases: exact arithmetic, boundaries of rules, and order-sensitive operators."""

import random

import pytest
from pyspark.sql import functions as F

from chainweft.functions import wide
from chainweft.functions.ids import ZERO_ADDRESS
from chainweft.functions.ordered import SLICE, asof, with_even_slices, with_previous, with_running_total
from chainweft.operators import activity, clusters, detect, exposure, extract, matching, quality, risk, series, visibility
from chainweft.operators.graph import ordered_paths

TOP = 2**256 - 1
EDGE = (
    "relationship_id string, tx_hash string, block_number long, transaction_index long, event_index long, "
    "block_timestamp_unix_ms long, from_address string, to_address string, asset_id string, token_id string, amount_raw string"
)


def edge(i, tx, block, src, dst, amount, asset="a", token=None, at=None, index=0):
    return (f"r{i}", tx, block, index, i, block * 1000 if at is None else at, src, dst, asset, token, str(amount))


def test_wide_sums_match_python(spark):
    rng = random.Random(7)
    values = [rng.choice([0, 1, 10**9 - 1, 10**27 - 1, 10**27, 10**54, TOP, rng.getrandbits(256)]) for _ in range(200)]
    signs = [rng.choice([1, -1]) for _ in values]
    rows = [(str(v), s) for v, s in zip(values, signs)]
    df = spark.createDataFrame(rows, "v string, s int")
    plus, minus = F.when(F.col("s") > 0, F.col("v")), F.when(F.col("s") < 0, F.col("v"))
    got = df.agg(wide.total(F.col("v")).alias("t"), wide.net(plus, minus).alias("n"), wide.net(minus, plus).alias("m")).first()
    net = sum(v * s for v, s in zip(values, signs))
    assert (int(got.t), int(got.n), int(got.m)) == (sum(values), net, -net)


def test_hex_words_and_scaling(spark):
    values = [0, 1, 2**60 - 1, 2**60, TOP, 10**40]
    df = spark.createDataFrame([(f"{v:064x}",) for v in values], "w string")
    assert [int(r[0]) for r in df.select(extract.amount_of(F.col("w"))).collect()] == values
    text = spark.createDataFrame([("1", 6), ("1000000", 6), ("1230000", 6), ("5", 0), (str(TOP), 18)], "a string, d int")
    scaled = text.select("a", wide.scaled(F.col("a"), F.col("d")).alias("s"), "d")
    back = scaled.select("a", "s", wide.unscaled(F.col("s"), F.col("d")).alias("b")).collect()
    assert [r.s for r in back][:4] == ["0.000001", "1", "1.23", "5"] and all(r.a == r.b for r in back)


def test_net_flows_cancel_self_transfers_and_keep_256_bits(spark):
    rows = [edge(1, "t", 1, "A", "B", TOP), edge(2, "t", 1, "A", "B", TOP), edge(3, "t", 1, "B", "A", 1), edge(4, "t", 1, "A", "A", 9)]
    got = {(r.address): int(r.net_raw) for r in activity.net_flows(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {"A": 1 - 2 * TOP, "B": 2 * TOP - 1}
    assert sum(got.values()) == 0


def test_ordered_helpers_equal_plain_python_across_slices(spark):
    rng = random.Random(3)
    points = sorted({(rng.choice("xy"), rng.randrange(1000)) for _ in range(150)})
    df = spark.createDataFrame([(k, p, p % 7) for k, p in points], "k string, p long, v long")
    previous = {(r.k, r.p): r.p_prev for r in with_previous(df, ["k"], ["p"], ["p"], "p", 40).collect()}
    running = {(r.k, r.p): r.s for r in with_running_total(df, ["k"], ["p"], "v", "p", 40, "s").collect()}
    for key in "xy":
        mine = [p for k, p in points if k == key]
        for i, p in enumerate(mine):
            assert previous[(key, p)] == (mine[i - 1] if i else None)
            assert running[(key, p)] == sum(q % 7 for q in mine[: i + 1])


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_asof_equals_brute_force(spark, forward, inclusive):
    rng = random.Random(11)
    left = sorted({(rng.choice("xy"), rng.randrange(300)) for _ in range(60)})
    right = sorted({(rng.choice("xy"), rng.randrange(300)) for _ in range(25)})
    a = spark.createDataFrame([(k, p, f"l{p}") for k, p in left], "k string, p long, l string")
    b = spark.createDataFrame([(k, p, p) for k, p in right], "k string, p long, at long")
    got = {(r.k, r.p): r.at for r in asof(a, b, ["k"], ["p"], ["at"], "p", 50, forward, inclusive).collect()}
    for k, p in left:
        fits = [q for kk, q in right if kk == k and ((q > p if forward else q < p) or (inclusive and q == p))]
        assert got[(k, p)] == ((min(fits) if forward else max(fits)) if fits else None)


def test_overfull_slices_are_cut_at_percentiles(spark):
    """One key with nearly all rows in one slice of time spreads over many slices, and look-ups stay right."""
    rng = random.Random(13)
    hot = [("x", int(1000 * rng.random() ** 4)) for _ in range(4000)]
    df = spark.createDataFrame([*hot, *(("y", p) for p in range(0, 900, 90))], "k string, p long").withColumn(SLICE, F.lit(0).cast("long"))
    cut = with_even_slices(df, ["k"], "p", 100).groupBy("k", SLICE).agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"), F.countDistinct("p").alias("kinds")).collect()
    x = sorted((r for r in cut if r.k == "x"), key=lambda r: r[SLICE])
    assert len(x) > 60 and all(r.n <= 100 or r.kinds == 1 for r in x) and all(a.high < b.low for a, b in zip(x, x[1:], strict=False))
    assert sum(r.k == "y" for r in cut) == 1 and sum(r.n for r in cut) == 4010
    events = [(k, p, f"e{i:04}", rng.choice(["mixer_in", "bridge"])) for i, (k, p) in enumerate({*hot, ("y", 3), ("y", 20)})]
    frame = spark.createDataFrame(events, "subject_id string, block_timestamp_unix_ms long, event_id string, event_type string")
    kind = F.col("event_type")
    whole, split = (matching.event_sequence(frame, kind == "mixer_in", kind == "bridge", 2, rows) for rows in (10**6, 20))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    a, b = ([(k, p, i) for k, p, i, t in events if t == want] for want in ("mixer_in", "bridge"))
    near = {k: min((p, i) for k2, p, i in a if k2 == k and any(k3 == k and abs(q - p) <= 2 for k3, q, _ in b)) for k in {k for k, *_ in a} if any(k2 == k and k3 == k and abs(q - p) <= 2 for k2, p, _ in a for k3, q, _ in b)}
    assert {r.subject_id: r.left_event_id for r in split.collect()} == {k: i for k, (_, i) in near.items()}


def test_latest_does_not_depend_on_order(spark):
    rows = [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "only")]
    for shuffled in (rows, rows[::-1]):
        df = spark.createDataFrame(shuffled, "k string, revision long, v string")
        assert {r.k: r.v for r in visibility.latest(df, ["k"]).collect()} == {"a": "new", "b": "only"}


def test_forwarding_counts_three_pairs_and_uses_each_transaction_once(spark):
    rows = []
    for i in range(3):
        rows.append(edge(2 * i, f"in{i}", 1, f"s{i}", "W", 1000, at=10_000 + i * 100, index=i))
        rows.append(edge(2 * i + 1, f"out{i}", 1, "W", f"d{i}", 950, at=10_000 + i * 100 + 50, index=i))
    rows.append(edge(9, "late", 1, "W", "d9", 1000, at=10_000 + 700_000))
    found = matching.forwarding_pairs(spark.createDataFrame(rows, EDGE))
    assert sorted((r.incoming_tx, r.outgoing_tx) for r in found.collect()) == [(f"in{i}", f"out{i}") for i in range(3)]


def test_forwarding_settles_chains_over_many_slices(spark):
    width, rows = 100_000, []
    for i in range(55):  # the first receipt has no payment of its own, so each takes that of the next slice
        at = 50_000 + i * (width - 10)
        rows.append(edge(2 * i, f"in{i}", i + 1, f"s{i}", "W", 1000, at=at, index=0))
        if i:
            rows.append(edge(2 * i + 1, f"out{i}", i + 1, "W", f"d{i}", 1000, at=at + 5, index=1))
    found = matching.forwarding_pairs(spark.createDataFrame(rows, EDGE), width, slice_ms=width).collect()
    assert {(r.incoming_tx, r.outgoing_tx) for r in found} == {(f"in{i}", f"out{i + 1}") for i in range(54)}


def test_forwarding_is_the_same_for_any_slice_width(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        src, dst = ("W", f"p{i}") if rng.random() < 0.5 else (f"p{i}", "W")
        at = rng.randrange(1, 6_000_000)
        rows.append(edge(i, f"t{i}", at, src, dst, rng.choice([100, 105, 200]), at=at, index=i))
    df = spark.createDataFrame(rows, EDGE)

    def pairs(width):
        return sorted((r.incoming_tx, r.outgoing_tx) for r in matching.forwarding_pairs(df, slice_ms=width).collect())

    used, want = set(), []
    ins = sorted((r for r in rows if r[7] == "W"), key=lambda r: (r[5], r[3], r[1]))
    outs = sorted((r for r in rows if r[6] == "W"), key=lambda r: (r[5], r[3], r[1]))
    for a in ins:
        for b in outs:
            if a[1] not in used and b[1] not in used and a[5] < b[5] <= a[5] + 600_000 and abs(int(a[10]) - int(b[10])) <= int(a[10]) // 10:
                used.update((a[1], b[1]))
                want.append((a[1], b[1]))
                break
    assert pairs(600_000) == pairs(1_500_000) == pairs(100_000_000) == sorted(want)


def test_pass_through_counts_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [edge(i, f"t{rng.randrange(20)}", 1, rng.choice("AB"), rng.choice("AB"), 1, at=1000) for i in range(30)]
    times = {f"t{k}": rng.randrange(10_000) for k in range(20)}
    rows = [(*r[:5], times[r[1]], *r[6:]) for r in rows]
    found = {r.wallet: r.pair_count for r in matching.pass_through(spark.createDataFrame(rows, EDGE), 2_000).collect()}
    for w in "AB":
        want = sum(1 for a in rows for b in rows if a[7] == w and b[6] == w and a[1] != b[1] and 0 <= b[5] - a[5] <= 2_000)
        assert found.get(w, 0) == want


@pytest.mark.parametrize("case,want", [((100, 100, 100, 99), (99, 99)), ((50, 50, 100, 50), (0, 50)), ((80, 80, 100, 70), (50, 70))])
def test_utxo_bounds(spark, case, want):
    low, high = exposure.allocate(*[F.lit(v) for v in case])
    assert tuple(spark.range(1).select(low.alias("l"), high.alias("h")).first()) == want


def test_utxo_bounds_equal_brute_force_for_small_totals(spark):
    cases, want = [], []
    for total in range(1, 10):
        for marked in range(total + 1):
            for out in range(total + 1):
                cases.append((marked, marked, total, out))
                # an output of `out` units drawn from `total` of which `marked` are marked
                want.append((max(0, marked - (total - out)), min(marked, out)))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, lo int, hi int, t int, o int")
    low, high = exposure.allocate(F.col("lo"), F.col("hi"), F.col("t"), F.col("o"))
    assert [tuple(r) for r in df.orderBy("i").select(low.alias("a"), high.alias("b")).collect()] == want


def test_best_rule_decay(spark):
    one = exposure.best_step_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0)).alias("a")
    two = exposure.best_step_score(F.lit(0.75), F.lit(1.0), F.lit(1.0), F.lit(0)).alias("b")
    served = exposure.best_step_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1)).alias("c")
    got = spark.range(1).select(one, two, served).first()
    assert got.a == pytest.approx(0.75) and got.b == pytest.approx(0.5625) and got.c < got.a


def test_path_needs_order_asset_and_other_transaction(spark):
    good = [edge(1, "t1", 1, "A", "B", 5), edge(2, "t2", 2, "B", "C", 5)]
    bad = [edge(3, "t3", 1, "B", "C", 5), edge(4, "t1", 3, "B", "C", 5), edge(5, "t5", 3, "B", "C", 5, asset="b")]
    pairs = spark.createDataFrame([("A", "C")], "source string, target string")
    found = ordered_paths(spark.createDataFrame(good + bad, EDGE), pairs, 3).collect()
    assert [r.edge_ids for r in found] == [["r1", "r2"]]


def test_liquidity_add_remove_and_plain_payment(spark):
    def kinds(rows):
        df = spark.createDataFrame(rows, EDGE)
        return [(r.subject, r.event_type) for r in detect.liquidity(activity.net_flows(df), df).collect()]

    add = [edge(1, "t", 1, "U", "P", 5, "x"), edge(2, "t", 1, "U", "P", 5, "y"), edge(3, "t", 1, ZERO_ADDRESS, "U", 1, "lp")]
    remove = [edge(1, "t", 1, "P", "U", 5, "x"), edge(2, "t", 1, "P", "U", 5, "y"), edge(3, "t", 1, "U", "P", 1, "lp"),
              edge(4, "t", 1, "P", ZERO_ADDRESS, 1, "lp")]
    payment = [edge(1, "t", 1, "U", "P", 5, "x"), edge(2, "t", 1, "U", "P", 5, "y"), edge(3, "t", 1, "P", "U", 1, "z")]
    assert ("U", "liquidity_add") in kinds(add)
    assert ("U", "liquidity_remove") in kinds(remove)
    assert kinds(payment) == []


def test_receipt_swap_must_equal_transfers(spark):
    rows = [edge(1, "t", 1, "U", "P", 100, "x"), edge(2, "t", 1, "P", "U", 40, "y")]
    edges = spark.createDataFrame(rows, EDGE)
    schema = "tx_hash string, pool string, log_index int, amount0_in string, amount1_in string, amount0_out string, amount1_out string"
    log = ("t", "P", 0, "100", "0", "0", "40")
    found = lambda logs: matching.receipt_swaps(spark.createDataFrame(logs, schema), edges).count()
    assert found([log]) == 1
    assert found([("t", "P", 0, "101", "0", "0", "40")]) == 0
    assert found([log, ("t", "P", 1, "100", "0", "0", "40")]) == 0


def test_coinbase_maturity(spark):
    states = spark.createDataFrame([("a", 10, 1, 50, 0)], "address string, block_number long, coinbase int, value_sats long, is_spent int")
    for tip, immature, ready in ((108, "50", "0"), (109, "50", "50"), (110, "0", "50")):
        row = activity.utxo_balances(states, tip).first()
        assert (row.immature_sats, row.eligible_next_block_sats) == (immature, ready)


LEG = "tx_hash string, address string, script_hex string, value_sats long"


def test_cluster_leads_and_suppression(spark):
    ins = [("a", "1x", "00", 5), ("a", "1y", "00", 5), ("a", "1y", "00", 5), ("b", "1x", "00", 9), ("b", "1y", "00", 9),
           ("c", "1x", "00", 9), ("d", None, "00", 5), ("d", "1y", "00", 5)]
    outs = [("a", "1z", "00", 4), ("b", "1p", "00", 4), ("b", "1q", "00", 4), ("c", "1n", "00", 4), ("c", "3n", "00", 3), ("d", "1z", "00", 4)]
    i = spark.createDataFrame(ins, LEG)
    o = spark.createDataFrame(outs, LEG).withColumn("output_index", F.lit(0))
    shape = clusters.tx_shape(i, o, i.select("tx_hash", F.lit(0).alias("coinbase")).distinct())
    reasons = {r.tx_hash: r.suppressed for r in clusters.lead_suppression(shape).collect()}
    assert reasons == {"a": None, "b": "possible_collaborative_transaction", "c": None, "d": "script_or_zero_input_context"}
    assert [(r.tx_hash, r.members) for r in clusters.common_input(i, shape).collect()] == [("a", ["1x", "1y"])]
    assert [(r.tx_hash, r.candidate) for r in clusters.change_candidate(i, o, shape).collect()] == [("c", "1n")]


def test_missing_ranges_are_grouped(spark):
    df = spark.createDataFrame([("n", h) for h in (1, 2, 5, 6, 9)], "network_id string, block_number long")
    assert sorted((r.from_block, r.to_block) for r in series.missing_ranges(df).collect()) == [(3, 4), (7, 8)]


def test_reverted_frames_take_their_children_with_them(spark):
    schema = "tx_hash string, trace_address array<int>, call_type string, from_address string, to_address string, value_raw string, error string"
    rows = [("t", [0], "CALL", "A", "B", "1", None), ("t", [1], "CALL", "A", "B", "2", "reverted"), ("t", [1, 0], "CALL", "B", "C", "3", None),
            ("t", [1, 0, 0], "CREATE2", "C", "D", "4", None), ("t", [2], "DELEGATECALL", "A", "B", "5", None), ("t", [3], "call", "A", "A", "6", None)]
    found = extract.internal_transfers(spark.createDataFrame(rows, schema), "native")
    assert [r.amount_raw for r in found.collect()] == ["1"]


def test_risk_policy_levels_and_gates(spark):
    signals = spark.createDataFrame(
        [("h", "APPROVED_RISK_LABEL", 70.0, ""), ("h", "MIXER_INTERACTION", 15.0, ""), ("m", "MIXER_INTERACTION", 15.0, ""),
         ("m", "ILLICIT_SEED_EXPOSURE", 20.04, ""), ("l", "RAPID_SAME_ASSET_FORWARDING", 5.0, "")],
        "wallet string, signal_type string, contribution double, evidence_ref string",
    )
    wallets = spark.createDataFrame([("h", 1), ("m", 9), ("l", 9), ("n", 9), ("u", 2)], "wallet string, transfers int")
    got = {r.wallet: (r.risk_score, r.risk_level) for r in risk.risk_assess(signals, wallets).collect()}
    assert got == {"h": (85.0, "HIGH"), "m": (35.0, "MEDIUM"), "l": (5.0, "LOW"), "n": (0.0, "NO_SIGNALS"), "u": (None, "UNKNOWN")}


def test_alert_opens_once_until_no_match(spark):
    checks = [("w", 1, "matched", 70.0), ("w", 2, "unknown", None), ("w", 3, "matched", 30.0), ("w", 4, "no_match", 1.0), ("w", 5, "matched", 30.0)]
    df = spark.createDataFrame(checks, "watch_id string, checked_at long, status string, score double")
    assert sorted((r.created_at_ms, r.severity) for r in risk.alerts(df, 2).collect()) == [(1, "high"), (5, "medium")]


def test_sanction_list_entries_become_pending_claims(spark, tmp_path):
    from chainweft.functions.ids import BITCOIN_ADDRESS, EVM_ADDRESS, TRON_ADDRESS
    from chainweft.sources.files import read_sanction_list

    ids = [("XBT", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"), ("ETH", "0x" + "Ab" * 20), ("TRX", "not-an-address"), ("XMR", "ignored")]
    body = "".join(f"<id><uid>{i}</uid><idType>Digital Currency Address - {s}</idType><idNumber>{a}</idNumber></id>" for i, (s, a) in enumerate(ids))
    text = f"<sdnList><sdnEntry><uid>7</uid><lastName>Doe</lastName><sdnType>Individual</sdnType><idList>{body}</idList></sdnEntry></sdnList>"
    path = tmp_path / "list.xml"
    path.write_text(text)
    valid = {"bip122:000000000019d6689c085ae165831e93": BITCOIN_ADDRESS, "eip155:1": EVM_ADDRESS, "eip155:56": EVM_ADDRESS, "tron:mainnet": TRON_ADDRESS}
    claims, excluded = quality.sanction_claims(read_sanction_list(spark, str(path)), "list", valid)
    assert {(r.network_id, r.review_status) for r in claims.collect()} == {("bip122:000000000019d6689c085ae165831e93", "pending"), ("eip155:1", "pending")}
    assert [r.symbol for r in excluded.collect()] == ["TRX"]


def test_claims_and_tables_round_trip(spark, tmp_path):
    from chainweft.sources.files import read_claims, read_table, write_table

    (tmp_path / "c.jsonl").write_text('{"network_id":"n","claim_id":"c1","address":"A","confidence":0.5,"evidence_refs":["x"],"revision":1}\n')
    assert read_claims(spark, str(tmp_path / "c.jsonl")).first().claim_id == "c1"
    df = spark.range(10).withColumn("bucket", F.col("id") % 2)
    write_table(df, str(tmp_path / "t"), ["bucket"], bloom=["id"])
    write_table(df, str(tmp_path / "t"), ["bucket"])
    assert read_table(spark, str(tmp_path / "t")).count() == 20


def test_deposit_with_several_logs_is_one_row(spark):
    from chainweft.operators import matching

    spent = "ab" * 32
    outputs = spark.createDataFrame([("t", 0, 100, 5)], "tx_hash string, output_index int, block_number long, value_sats long")
    reveals = spark.createDataFrame(
        [("t", 0, "k", "d", "w", 1000, 1, 1)],
        "funding_tx_hash string, output_index int, deposit_key string, depositor string, wallet string, timestamp_ms long, block_number long, log_index int",
    )
    spends = spark.createDataFrame([("t", 0, spent, 101, 2000)], "prev_tx_hash string, prev_output_index int, tx_hash string, block_number long, timestamp_ms long")
    sweeps = spark.createDataFrame(
        [(spent, "w", 2500, "late", 3, 0), (spent, "w", 2400, "first", 2, 0), (spent, "w", 10, "early", 0, 0)],
        "sweep_tx_reversed string, wallet string, timestamp_ms long, event_id string, block_number long, log_index int",
    )
    mints = spark.createDataFrame(
        [("k", "d", 3000, "m2", "7", "9", 5, 0), ("k", "d", 2900, "m1", "7", "9", 4, 0), ("k", "d", 2900, "big", "99999999999999999999", "9", 3, 0)],
        "deposit_key string, recipient string, timestamp_ms long, event_id string, minted_raw string, debt_raw string, block_number long, log_index int",
    )
    rows = matching.deposit_lifecycle(outputs, reveals, spends, sweeps, mints).collect()
    assert [(r.stage, r.spend_tx, r.sweep_event_id, r.mint_event_id) for r in rows] == [("minted", spent, "first", "m1")]


def test_limits_are_errors_not_silent_cuts(spark):
    import pytest

    from chainweft.functions.ordered import top_per_group
    from chainweft.operators import scope

    df = spark.range(3).withColumn("block_timestamp_unix_ms", F.col("id"))
    with pytest.raises(ValueError):
        scope.observation_window(df, scope.MAX_WINDOW_DAYS + 1, 10)
    with pytest.raises(ValueError):
        top_per_group(df, ["id"], [F.col("id")], 100_000)


def test_published_block_stays_resolved(spark, tmp_path):
    from chainweft.streaming import streams

    columns = "network_id string, failure_id string, block_number long, outcome string, at_ms long"
    sink = streams.Sink(spark, "failures", str(tmp_path / "sink"))
    for at, outcome in enumerate(["failed", "published", "failed"]):
        rows = [("n", "a", 1, outcome, at), ("n", "b", 2, "failed", at)]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        streams.stream_failures(stream, sink, max_attempts=4)
    states = {r.failure_id: (r.attempts, r.status) for r in streams.failure_states(sink).collect()}
    assert states == {"a": (2, "resolved"), "b": (3, "retry")}


def test_bridge_amounts_of_any_width(spark):
    from chainweft.operators import matching

    columns = "operation_id string, sender string, receiver string, chain_id int, remote_chain_id int, event_id string, timestamp_ms long, token string, amount_raw string"
    widest, near = 2**256 - 1, (2**256 - 1) * 10**12
    amounts = {"plain": (10**6, 10**18), "wide": (widest, near), "low": (widest, near * 94 // 100), "edge": (10**6, 95 * 10**16), "endless": (10**150, 10**18)}
    sends = spark.createDataFrame([(k, "s", "r", 1, 2, f"s{k}", 0, "a", str(a)) for k, (a, _) in amounts.items()], columns)
    relays = spark.createDataFrame([(k, "s", "r", 2, 1, f"r{k}", 5, "b", str(b)) for k, (_, b) in amounts.items()], columns)
    assets = spark.createDataFrame([(1, "a", "X", 6), (2, "b", "X", 18)], "chain_id int, token string, symbol string, decimals int")
    assert {r.operation_id for r in matching.match_bridge(sends, relays, assets).collect()} == {"plain", "wide", "edge"}

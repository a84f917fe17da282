"""Path and exposure searches against brute force over random transfers, and hubs."""

from __future__ import annotations

import random
import time
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from chainweft.operators import exposure, graph
from chainweft.session import bucketed

EDGE = "relationship_id string, tx_hash string, block_number long, transaction_index long, block_timestamp_unix_ms long, asset_id string, token_id string, amount_raw string, from_address string, to_address string"
CLAIM = "claim_id string, address string, entity_id string, entity_type string, risk_level int, confidence double, is_exposure_seed int"
DAY = 86_400_000
AT = 1_000 * DAY


def random_edges(rng, n, wallets, assets=2):
    rows = []
    for k in range(n):
        a, b = rng.sample(wallets, 2)
        block = rng.randrange(40)
        rows.append((f"r{k}", f"t{block}-{k % 3}", block, k % 3, block * DAY, f"a{rng.randrange(assets)}", None, str(rng.choice([1, 2, 3, 5, 8, 100])), a, b))
    return rows


def claims_of(seeds, services=()):
    return [(f"c{s}", s, "e", "unknown", 80, 0.9, 1) for s in seeds] + [(f"s{w}", w, f"e{w}", "exchange", 0, 0.5, 0) for w in services]


def plain_paths(rows, seeds, services, hops):
    """(claim, direction, wallet, hops, score) of every ordered simple path from a seed."""
    out = []
    for seed in seeds:
        for direction in (exposure.RECEIVED, exposure.SENT):
            ahead = direction == exposure.RECEIVED
            steps = [(r[8], r[9], r) if ahead else (r[9], r[8], r) for r in rows]

            def grow(nodes, path):
                if path:
                    last, low, high = path[-1], min(float(r[7]) for r in path), max(float(r[7]) for r in path)
                    if nodes[-1] not in services or len(path) == 1:
                        out.append((f"c{seed}", direction, nodes[-1], len(path), 0.9 * 0.8 * 0.65 ** (len(path) - 1) * 0.5 ** ((AT - last[4]) / DAY / 365) * low / high))
                if len(path) == hops or (path and nodes[-1] in services):
                    return
                for a, b, r in steps:
                    if a != nodes[-1] or b in nodes:
                        continue
                    if path:
                        here, there = (r[2], r[3]), (path[-1][2], path[-1][3])
                        if r[5] != path[-1][5] or r[1] == path[-1][1] or not (here > there if ahead else here < there):
                            continue
                    grow([*nodes, b], [*path, r])

            grow([seed], [])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strongest_paths_equal_all_paths(spark, seed):
    rng = random.Random(seed)
    wallets = [f"w{k}" for k in range(8)]
    rows, seeds, services = random_edges(rng, 60, wallets), ["w0", "w1"], ["w2"]
    want = {}
    for claim, direction, wallet, hops, score in plain_paths(rows, seeds, services, 4):
        key = (claim, direction, wallet)
        best, direct = want.get(key, (0.0, 0.0))
        want[key] = (max(best, score), max(direct, score if hops == 1 else 0.0))
    edges, claims = spark.createDataFrame(rows, EDGE), spark.createDataFrame(claims_of(seeds, services), CLAIM)
    found = exposure.best_pairs(edges, claims, AT, 4).collect()
    got = {}
    by_id = {r[0]: r for r in rows}
    for r in found:
        key = (r.claim_id, r.direction, r.subject_id)
        best, direct = got.get(key, (0.0, 0.0))
        got[key] = (max(best, r.exposure_score), max(direct, r.exposure_score if r.hop_count == 1 else 0.0))
        path = [by_id[x] for x in r.relationship_ids]
        amounts = [float(p[7]) for p in path]
        assert [p[1] for p in path] == r.tx_hashes and len(set(r.path_subjects)) == len(path) + 1 == r.hop_count + 1
        again = 0.9 * 0.8 * 0.65 ** (len(path) - 1) * 0.5 ** ((AT - path[-1][4]) / DAY / 365) * min(amounts) / max(amounts)
        assert abs(again - r.exposure_score) < 1e-12
        order = [(p[2], p[3]) for p in path]
        assert all((a < b) == (r.direction == exposure.RECEIVED) for a, b in pairwise(order))
    assert got.keys() == want.keys()
    for key, (best, direct) in want.items():
        assert got[key] == (pytest.approx(best), pytest.approx(direct))


def test_strongest_paths_pass_a_hub(spark):
    """A hundred thousand payments of a hub, reached by many payments of three amounts."""
    n = 100_000
    hub = spark.range(n).select(
        F.concat(F.lit("h"), "id").alias("relationship_id"), F.concat(F.lit("th"), "id").alias("tx_hash"), (F.col("id") + 10_000).alias("block_number"),
        F.lit(0).cast("long").alias("transaction_index"), F.lit(DAY).alias("block_timestamp_unix_ms"), F.lit("a").alias("asset_id"), F.lit(None).cast("string").alias("token_id"),
        F.lit("7").alias("amount_raw"), F.lit("hub").alias("from_address"), F.concat(F.lit("w"), F.col("id") % 5_000).alias("to_address"),
    )
    into = [(f"i{k}", f"ti{k}", k, 0, DAY, "a", None, str([7, 9, 14][k % 3]), "seed", "hub") for k in range(3_000)]
    edges, claims = hub.unionByName(spark.createDataFrame(into, EDGE)), spark.createDataFrame(claims_of(["seed"]), CLAIM)
    started = time.time()
    found = exposure.best_pairs(edges, claims, AT, 2).where("hop_count = 2 AND direction = 'RECEIVED_FROM_SEED'")
    rows = found.groupBy().agg(F.count("*").alias("n"), F.min("exposure_score").alias("low"), F.max("exposure_score").alias("high")).first()
    assert rows.n == 5_000 and rows.low == rows.high and time.time() - started < 120


def plain_simple_paths(rows, pairs, hops, ordered, ahead=True):
    found = set()
    for source, target in pairs:

        def grow(nodes, path):
            if path and nodes[-1] == target:
                found.add((source, target, ",".join(r[0] for r in path)))
                return
            if len(path) == hops:
                return
            for r in rows:
                a, b = (r[8], r[9]) if ahead else (r[9], r[8])
                if a != nodes[-1] or b in nodes:
                    continue
                if ordered and path:
                    here, there = (r[2], r[3]), (path[-1][2], path[-1][3])
                    if r[5] != path[-1][5] or r[1] == path[-1][1] or not (here > there if ahead else here < there):
                        continue
                grow([*nodes, b], [*path, r])

        grow([source], [])
    return found


@pytest.mark.parametrize("hops", [1, 2, 3, 5])
def test_paths_met_in_the_middle_equal_plain_search(spark, hops):
    rng = random.Random(hops)
    wallets = [f"w{k}" for k in range(9)]
    rows = random_edges(rng, 26, wallets, assets=1)
    pairs = [("w0", "w1"), ("w0", "w2"), ("w3", "w1"), ("w4", "w4"), ("w5", "nobody")]
    edges, asked = spark.createDataFrame(rows, EDGE), spark.createDataFrame(pairs, "source string, target string")
    pairs = [p for p in pairs if p[0] != p[1]]

    def got(df):
        out = [(r.source, r.target, ",".join(r.edge_ids)) for r in df.collect()]
        assert len(out) == len(set(out))
        return set(out)

    every = plain_simple_paths(rows, pairs, hops, False)
    assert got(graph.paths(edges, asked, hops)) == every
    assert got(graph.ordered_paths(edges, asked, hops)) == plain_simple_paths(rows, pairs, hops, True)
    assert got(graph.ordered_paths(edges, asked, hops, "incoming")) == plain_simple_paths(rows, pairs, hops, True, False)
    ranked = {p: sorted((x[2].count(","), x[2].split(","), x[2]) for x in every if x[:2] == p)[:3] for p in pairs}
    assert got(graph.paths(edges, asked, hops, first=3)) == {(*p, x[2]) for p, found in ranked.items() for x in found}


def test_hops_leave_the_bucketed_side_in_place(spark):
    keys = ["direction", "node", "asset_id", "part"]
    steps = spark.range(5_000).select(
        F.concat(F.lit("d"), F.col("id") % 2).alias("direction"), F.concat(F.lit("n"), F.col("id") % 7).alias("node"), F.concat(F.lit("a"), F.col("id") % 3).alias("asset_id"), (F.col("id") % 8).cast("int").alias("part"), "id"
    )
    written = bucketed(steps, keys, "steps")
    frontier = spark.range(100).select(F.concat(F.lit("d"), F.col("id") % 2).alias("direction"), F.concat(F.lit("n"), F.col("id") % 9).alias("node"), F.concat(F.lit("a"), F.col("id") % 3).alias("asset_id"), (F.col("id") % 8).cast("int").alias("part"), F.col("id").alias("state"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = frontier.join(written, keys)
        rows = joined.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == frontier.join(steps, keys).count() > 0
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan


def test_capped_rule_spreads_a_hub(spark):
    """Every payment of a hub is met once, whichever of its buckets holds it."""
    hub = [(f"h{k}", f"th{k}", 100 + k, 0, DAY, "a", None, "7", "hub", f"w{k}") for k in range(3_000)]
    edges = spark.createDataFrame([("i", "ti", 1, 0, DAY, "a", None, "7", "seed", "hub"), *hub], EDGE)
    seeds = spark.createDataFrame([("c", "seed", 80)], "seed_id string, address string, risk_level int")
    none = spark.createDataFrame([], "address string")
    found = exposure.expose_capped(edges, seeds, none, AT, exposure.CappedOptions(max_hops=2)).where("direction = 'RECEIVED_FROM_SEED'")
    assert sorted(r.subject_id for r in found.collect()) == sorted(["hub", *(f"w{k}" for k in range(3_000))])

"""Neighbourhoods, paths and shape of the transfer graph.

Searches are level-synchronous: one join per hop for all roots together, each
level written to the shared folder so that neither the plan nor the lineage
grows with the hops.  Paths between pairs meet in the middle.  Limits on hops are the feature; there is no limit on
edges per node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.functions.ids import ZERO_ADDRESS
from chainweft.functions.ordered import top_per_group
from chainweft.operators.scope import wallet_edges
from chainweft.session import bucketed, materialise

DIRECTIONS = ("outgoing", "incoming", "both")


def adjacency(edges: DataFrame, direction: str, extra: Sequence[str] = (),
              source: str = "from_address", target: str = "to_address") -> DataFrame:
    """``node`` to ``next`` for every step the direction allows; with the edge's id, where edges have one."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction}")
    src, dst = F.col(source), F.col(target)
    ahead = F.struct(src.alias("node"), dst.alias("next"))
    back = F.struct(dst.alias("node"), src.alias("next"))
    steps = {
        "outgoing": F.array(ahead),
        "incoming": F.array(back),
        "both": F.when(src == dst, F.array(ahead)).otherwise(F.array(ahead, back)),
    }[direction]
    own = [c for c in ("relationship_id",) if c in edges.columns]
    return edges.select(*own, *extra, F.inline(steps))


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int) -> DataFrame:
    """Edges within ``depth`` expansions of each focus address, with the first level.

    ``focus``: address.  Every node is expanded once per focus; the zero
    address is never expanded.
    """
    steps = adjacency(edges, "both")
    frontier = focus.select(F.col("address").alias("focus"), F.col("address").alias("node")).distinct()
    visited = frontier
    found = None
    for level in range(1, depth + 1):
        live = frontier.where(F.col("node") != ZERO_ADDRESS)
        hits = materialise(
            live.join(steps, "node").select("focus", "relationship_id", F.col("next").alias("node")),
            "neighbourhood",
        )
        level_edges = hits.select("focus", "relationship_id").distinct().withColumn("depth", F.lit(level))
        found = level_edges if found is None else found.unionByName(level_edges)
        if level == depth:
            break
        frontier = materialise(
            hits.select("focus", "node").distinct().join(visited, ["focus", "node"], "left_anti"),
            "frontier",
        )
        visited = visited.unionByName(frontier)
    return found.groupBy("focus", "relationship_id").agg(F.min("depth").alias("depth"))


def _halves(steps: DataFrame, roots: DataFrame, hops: int, extra: Sequence[str], continues: Column | None,
            on_asset: Sequence[str], forward: bool) -> list[DataFrame]:
    """Simple paths of 0, 1, .. ``hops`` steps that leave (or, walked back, reach) each root.

    A path knows its open end ``node`` and that end's step: as ``last_*`` where
    later steps follow it, under the plain names where earlier ones precede it.
    Steps without an id are known by their nodes alone.
    """
    kinds = dict(steps.dtypes)
    ids = "relationship_id" in kinds
    near, far = ("node", "next") if forward else ("next", "node")
    seen, new = ("last_", "") if forward else ("", "last_")
    ahead = steps.select(
        F.col(near).alias("node"), F.col(far).alias("to"), *(["relationship_id"] if ids else []),
        *[F.col(c).alias(f"{new}{c}") for c in extra],
    )
    level = roots.select("root", F.col("root").alias("node"), F.array("root").alias("nodes"),
                         *([F.array().cast("array<string>").alias("edge_ids")] if ids else []),
                         *[F.lit(None).cast(kinds[c]).alias(f"{seen}{c}") for c in extra])
    levels = [level]
    for hop in range(1, hops + 1):
        joined = level.alias("l")
        match = F.col("l.node") == F.col("s.node")
        if hop > 1:
            for c in on_asset:
                match = match & (F.col(f"{seen}{c}") == F.col(f"{new}{c}"))
        joined = joined.join(ahead.alias("s"), match).where(~F.array_contains("nodes", F.col("to")))
        if hop > 1 and continues is not None:
            joined = joined.where(continues)
        add = F.array_append if forward else F.array_prepend
        level = materialise(
            joined.select(
                "root", F.col("to").alias("node"), add("nodes", F.col("to")).alias("nodes"),
                *([add("edge_ids", F.col("relationship_id")).alias("edge_ids")] if ids else []),
                *[F.col(f"{new}{c}").alias(f"{seen}{c}") for c in extra],
            ),
            "half-paths",
        )
        levels.append(level)
    return levels


def _search(steps: DataFrame, pairs: DataFrame, hops: int, extra: Sequence[str],
            continues: Column | None, on_asset: Sequence[str] = (), first: int | None = None) -> DataFrame:
    """Simple paths of at most ``hops`` steps between each (source, target), met in the middle.

    Sources walk half the hops forward and targets half back, each once for all
    pairs that name it, so no search goes further than half the bound.  A path of
    ``n`` steps is met once: ``(n + 1) // 2`` steps from the source and ``n // 2``
    to the target end at one node and share no other.  With ``first`` only that
    many paths of a pair are kept, fewest hops first and then by edge ids, and
    pairs that have them take no part in longer joins.

    Steps are written in buckets of the keys that later hops join on, once for
    each side that has several such hops, so these hops shuffle their paths alone.
    Equal steps without an id are one step.
    """
    ids = "relationship_id" in steps.columns
    open_ = pairs.select("source", "target").distinct().where(
        (F.col("source") != F.col("target"))
        & (F.col("source") != ZERO_ADDRESS) & (F.col("target") != ZERO_ADDRESS)
    )
    usable = steps.where((F.col("next") != ZERO_ADDRESS) & (F.col("node") != ZERO_ADDRESS) & (F.col("node") != F.col("next")))
    if hops > 2:
        usable = bucketed(usable, ["node", *on_asset], "path-steps", once=not ids)
    else:
        usable = materialise(usable if ids else usable.distinct(), "path-steps")
    into = bucketed(usable, ["next", *on_asset], "path-steps") if hops // 2 > 2 else usable
    open_ = materialise(open_, "path-pairs")
    ahead = _halves(usable, open_.select(F.col("source").alias("root")).distinct(), (hops + 1) // 2, extra, continues, on_asset, True)
    back = _halves(into, open_.select(F.col("target").alias("root")).distinct(), hops // 2, extra, continues, on_asset, False)
    results = None
    for hop in range(1, hops + 1):
        one, other = ahead[(hop + 1) // 2].alias("f"), back[hop // 2].alias("b")
        match = (F.col("f.node") == F.col("b.node")) & (F.col("b.root") == F.col("target"))
        apart = F.size(F.array_intersect("f.nodes", "b.nodes")) == 1
        if hop > 1:
            for c in on_asset:
                match = match & (F.col(f"f.last_{c}") == F.col(f"b.{c}"))
            apart = apart if continues is None else apart & continues
        met = one.join(open_, F.col("f.root") == F.col("source")).join(other, match).where(apart).select(
            "source", "target", F.lit(hop).alias("hop_count"),
            F.concat("f.nodes", F.slice("b.nodes", 2, hop)).alias("nodes"),
            *([F.concat("f.edge_ids", "b.edge_ids").alias("edge_ids")] if ids else []),
        )
        if first is not None:
            found = results.groupBy("source", "target").agg(F.count("*").alias("have")) if results is not None else None
            met = top_per_group(met, ["source", "target"], [F.col("edge_ids")], first)
            if found is not None:
                met = met.join(found, ["source", "target"], "left").where(F.col("rank") <= first - F.coalesce("have", F.lit(0))).drop("have")
            met = materialise(met.drop("rank"), "paths")
        results = met if results is None else results.unionByName(met)
        if first is not None and hop < hops:
            full = results.groupBy("source", "target").agg(F.count("*").alias("have")).where(F.col("have") >= first)
            open_ = materialise(open_.join(full, ["source", "target"], "left_anti"), "path-pairs")
    return results


def paths(edges: DataFrame, pairs: DataFrame, hops: int, direction: str = "outgoing", first: int | None = None) -> DataFrame:
    """Simple paths by topology alone; ``first`` keeps so many of each pair, see ``rank_paths``."""
    return _search(adjacency(edges, direction), pairs, hops, [], None, first=first)


def follows(previous: str, incoming: bool) -> Column:
    """Strictly later (earlier when walking backwards) in block order, other transaction."""
    here = F.struct(F.col("block_number").alias("b"), F.col("transaction_index").alias("t"))
    there = F.struct(
        F.col(f"{previous}block_number").alias("b"), F.col(f"{previous}transaction_index").alias("t")
    )
    order = here < there if incoming else here > there
    return order & (F.col("tx_hash") != F.col(f"{previous}tx_hash"))


def ordered_paths(edges: DataFrame, pairs: DataFrame, hops: int, direction: str = "outgoing") -> DataFrame:
    """Paths of one asset and token whose transactions are strictly ordered in time.

    ``both`` is topology only, as order has no meaning without a direction.
    """
    if direction == "both":
        return paths(edges, pairs, hops, "both")
    extra = ["asset_id", "token", "tx_hash", "block_number", "transaction_index"]
    keyed = edges.withColumn("token", F.coalesce("token_id", F.lit("")))
    steps = adjacency(keyed, direction, extra)
    return _search(steps, pairs, hops, extra, follows("last_", direction == "incoming"), ["asset_id", "token"])


def typed_paths(edges: DataFrame, pairs: DataFrame, hops: int, direction: str = "outgoing") -> DataFrame:
    """Paths over typed subjects: addresses, transactions and scripts alike are nodes.

    Edges without ``relationship_id`` give paths of nodes, each once.
    """
    steps = adjacency(edges, direction, source="from_subject_id", target="to_subject_id")
    return _search(steps, pairs, hops, [], None)


def rank_paths(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` paths per pair: fewest hops, then edge ids."""
    return top_per_group(found, ["source", "target"], [F.col("hop_count"), F.col("edge_ids")], n)


def tx_neighbourhood(edges: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` transactions of every wallet with all their legs."""
    per_tx = wallet_edges(edges).groupBy("wallet", "tx_hash").agg(
        F.max(F.struct("block_number", "transaction_index")).alias("at")
    )
    recent = top_per_group(per_tx, ["wallet"], [F.desc("at"), F.desc("tx_hash")], n)
    return recent.select("wallet", "tx_hash").join(edges.drop("wallet"), "tx_hash")


# Entity types at which traversal stops.
SERVICES = ("exchange", "custodian", "bridge", "dex", "mixer")
SERVICES_WITHOUT_MIXER = ("exchange", "bridge", "custodian", "dex")


def service_addresses(claims: DataFrame, kinds: Sequence[str] = SERVICES) -> DataFrame:
    """Addresses labelled with one of the service types, any letter case."""
    return claims.where(F.lower("entity_type").isin(*kinds)).groupBy("address").agg(
        F.min("entity_id").alias("entity_id")
    )


def normalize_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects): unique ids, no empty ids, no edge without its nodes."""
    good_nodes = nodes.where(F.coalesce(F.length("id"), F.lit(0)) > 0)
    rest = [F.min(c).alias(c) for c in nodes.columns if c != "id"]
    kept_nodes = good_nodes.groupBy("id").agg(*rest) if rest else good_nodes.distinct()
    with_id = edges.where(F.coalesce(F.length("id"), F.lit(0)) > 0)
    unique = with_id.groupBy("id").agg(*[F.min(c).alias(c) for c in edges.columns if c != "id"])
    ids = kept_nodes.select("id")
    ends = unique.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(
        ids.withColumnRenamed("id", "to"), "to", "left_semi"
    ).select(*edges.columns)
    dangling = unique.select("id").join(ends.select("id"), "id", "left_anti").select(
        "id", F.lit("dangling_edge").alias("reason")
    )
    empty = edges.where(F.coalesce(F.length("id"), F.lit(0)) == 0).select(
        F.coalesce("id", F.lit("")).alias("id"), F.lit("empty_edge_id").alias("reason")
    )
    no_node = nodes.where(F.coalesce(F.length("id"), F.lit(0)) == 0).select(
        F.coalesce("id", F.lit("")).alias("id"), F.lit("empty_node_id").alias("reason")
    )
    return kept_nodes, ends, dangling.unionByName(empty).unionByName(no_node)


# Edge names by operation, then by transfer type.
OPERATION_EDGES = {
    "swap": "SWAP", "bridge": "BRIDGE", "deposit": "EXCHANGE_DEPOSIT",
    "withdrawal": "EXCHANGE_WITHDRAWAL", "sweep": "EXCHANGE_SWEEP",
    "internal_transfer": "INTERNAL_TRANSFER", "liquidity_add": "LIQUIDITY_ADD",
    "liquidity_remove": "LIQUIDITY_REMOVE", "mint": "MINT", "burn": "BURN",
}
TRANSFER_EDGES = {
    "native_transfer": "NATIVE_TRANSFER", "trc10_transfer": "TRC10_TRANSFER",
    "trc20_transfer": "TRC20_TRANSFER", "internal_transfer": "INTERNAL_TRANSFER",
    "mint": "MINT", "burn": "BURN",
}


def _table(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key)


def type_edges(edges: DataFrame) -> DataFrame:
    """Edge name from ``operation_type`` and ``transfer_type``; the operation wins."""
    operation = F.coalesce("operation_type", F.lit(""))
    between = F.when(operation.startswith("exchange_to_exchange"), F.lit("EXCHANGE_TRANSFER"))
    name = F.coalesce(
        _table(OPERATION_EDGES, operation), between, _table(TRANSFER_EDGES, F.col("transfer_type")),
        F.lit("MONEY_FLOW"),
    )
    return edges.withColumn("edge_type", name)


def type_nodes(edges: DataFrame, exchanges: DataFrame, entities: DataFrame) -> DataFrame:
    """Node kind: exchange, labelled entity, else what its edges suggest.

    ``edges`` carry transfer_type and protocol; labels are one row per address.
    """
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("from_address").alias("id"), F.lit(0).alias("swap_target")),
                F.struct(F.col("to_address").alias("id"),
                         (F.col("transfer_type") == "swap").cast("int").alias("swap_target")),
            )
        )
    ).groupBy("id").agg(F.max("swap_target").alias("swap_target"))
    bridges = edges.where(F.col("transfer_type") == "bridge").select(
        F.col("protocol").alias("id"), F.lit(1).alias("is_bridge")
    ).distinct()
    ex = exchanges.select(F.col("address").alias("id"), "exchange_name", "address_role",
                          F.col("confidence").alias("exchange_confidence"))
    en = entities.select(F.col("address").alias("id"), "entity_name", "entity_type",
                         F.col("confidence").alias("entity_confidence"))
    rows = ends.join(bridges, "id", "left").join(ex, "id", "left").join(en, "id", "left")
    known, labelled = F.col("exchange_name").isNotNull(), F.col("entity_name").isNotNull()
    own = F.lower("id")
    return rows.select(
        "id",
        F.when(known, "exchange_wallet").when(labelled, F.col("entity_type"))
        .when(own.isin("bridge", "mint", "burn"), own)
        .when(F.col("is_bridge") == 1, "bridge").when(F.col("swap_target") == 1, "protocol")
        .otherwise("wallet").alias("node_type"),
        F.when(known, F.concat("exchange_name", F.lit(" ("), "address_role", F.lit(")")))
        .when(labelled, F.concat("entity_name", F.lit(" ("), "entity_type", F.lit(")")))
        .alias("label"),
        F.when(known, F.greatest("exchange_confidence", F.coalesce("entity_confidence", F.lit(0.0))))
        .otherwise(F.col("entity_confidence")).alias("confidence"),
    )

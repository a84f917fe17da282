"""Joins that pair evidence: witnesses, time-bounded sequences, bridges, outpoints."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.functions import wide
from chainweft.functions.ids import HOUR_MS, ZERO_ADDRESS, script_subject, stable_id, unprefixed, word, word_address
from chainweft.functions.ordered import asof
from chainweft.operators.activity import OCCURRENCE
from chainweft.operators.extract import TRANSFER, amount_of
from chainweft.operators.scope import wallet_edges
from chainweft.operators.visibility import latest, per_network
from chainweft.session import bucketed, materialise

TS = "block_timestamp_unix_ms"
DAY_BLOCKS = 144


# witnesses -----------------------------------------------------------------


def match_legs(legs: DataFrame, txs: DataFrame) -> DataFrame:
    """Per wallet: leg occurrences, how many match a transaction, how many are impossible."""
    counters = txs.select(*OCCURRENCE, "coinbase", "input_count", "output_count",
                          F.lit(1).alias("found"))
    joined = legs.join(counters, OCCURRENCE, "left")
    wrong = F.col("found").isNotNull() & (
        F.col("input_count").isNull()
        | F.col("output_count").isNull()
        | (F.col("spent_input_count") > F.coalesce("input_count", F.lit(0)))
        | (F.col("received_output_count") > F.coalesce("output_count", F.lit(0)))
        | ((F.col("coinbase") == 1) & (F.col("spent_input_count") > 0))
    )
    return joined.groupBy("wallet").agg(
        F.count("*").alias("wallet_occurrences"),
        F.count("found").alias("matched_occurrences"),
        F.count_if(wrong).alias("invalid_occurrences"),
    )


def leg_disagreement(legs: DataFrame, txs: DataFrame) -> DataFrame:
    """Wallets whose legs and transaction witnesses disagree."""
    return match_legs(legs, txs).where(
        (F.col("wallet_occurrences") != F.col("matched_occurrences"))
        | (F.col("invalid_occurrences") > 0)
    )


def utxo_edges(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Input and output legs as transfer edges with typed subjects."""
    subject = script_subject(F.col("address"), F.col("script_hex"))
    kind = F.when(F.col("address").isNull(), "script").otherwise("address")
    tx_subject = F.concat_ws(":", F.lit("tx"), "block_hash", "tx_hash")
    empty = F.lit(None)
    spent = inputs.select(
        *OCCURRENCE,
        F.col("input_index").alias("event_index"),
        F.lit("utxo_input").alias("transfer_type"),
        subject.alias("from_subject_id"),
        kind.alias("from_subject_type"),
        tx_subject.alias("to_subject_id"),
        F.lit("transaction").alias("to_subject_type"),
        F.col("address").alias("from_address"),
        empty.cast("string").alias("to_address"),
        F.col("value_sats").cast("string").alias("amount_raw"),
        "prev_tx_hash",
        "prev_output_index",
        empty.cast("bigint").alias("output_index"),
    )
    received = outputs.select(
        *OCCURRENCE,
        F.col("output_index").alias("event_index"),
        F.lit("utxo_output").alias("transfer_type"),
        tx_subject.alias("from_subject_id"),
        F.lit("transaction").alias("from_subject_type"),
        subject.alias("to_subject_id"),
        kind.alias("to_subject_type"),
        empty.cast("string").alias("from_address"),
        F.col("address").alias("to_address"),
        F.col("value_sats").cast("string").alias("amount_raw"),
        empty.cast("string").alias("prev_tx_hash"),
        empty.cast("bigint").alias("prev_output_index"),
        F.col("output_index"),
    )
    return spent.unionByName(received).withColumn(
        "relationship_id",
        stable_id(F.col("block_hash"), F.col("tx_hash"), F.col("transfer_type"), F.col("event_index")),
    )


def _digest(columns: list[str]) -> Column:
    """SHA-256 of the columns as one JSON object, which leaves nulls out, so no two rows read alike; never null."""
    return F.coalesce(F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)), F.lit(b""))


def witness(edges: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Left join of edges to their exact leg; ``matched`` is 0 where none agrees.

    Edges and legs meet on the digest of all compared columns, so a leg is
    shuffled as 32 bytes and an edge with what its reader asks for.
    """
    keys = [
        *OCCURRENCE, "transfer_type", "event_index", "amount_raw",
        "from_subject_id", "to_subject_id",
    ]
    nullable = ["from_address", "to_address", "prev_tx_hash", "prev_output_index", "output_index"]
    # a null among the keys agrees with nothing
    known, leg = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), _digest([*keys, *nullable])
    legs = utxo_edges(inputs, outputs).where(known).select(leg.alias("__leg")).distinct()
    marked = edges.withColumn("__leg", F.when(known, leg)).join(legs.withColumn("__matched", F.lit(1)), "__leg", "left")
    return marked.select(*edges.columns, F.coalesce("__matched", F.lit(0)).alias("matched"))


def exchange_flows(edges: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Transfers that touch an exchange: deposit, withdrawal, sweep or exchange transfer."""

    def side(p: str) -> DataFrame:
        return exchanges.select(
            F.col("address").alias(f"{p}_address"), F.col("entity_id").alias(f"{p}_entity"),
            F.col("exchange_name").alias(f"{p}_name"), F.upper("address_role").alias(f"{p}_role"),
            F.col("confidence").alias(f"{p}_confidence"),
        )

    joined = edges.join(side("from"), "from_address", "left").join(side("to"), "to_address", "left")
    f, t = F.col("from_entity").isNotNull(), F.col("to_entity").isNotNull()
    same = F.col("from_entity") == F.col("to_entity")
    sweep = f & t & same & (F.col("from_role") == "DEPOSIT") & F.col("to_role").isin("HOT", "COLD")
    return joined.where(f | t).select(
        stable_id(F.col("relationship_id"), F.col("from_entity"), F.col("to_entity")).alias("flow_id"),
        "relationship_id", "tx_hash", "block_number", "from_address", "to_address", "asset_id",
        "amount_raw",
        F.when(f & t & ~same, F.concat("from_name", F.lit(" -> "), "to_name"))
        .when(t, F.col("to_name")).otherwise(F.col("from_name")).alias("exchange_name"),
        F.when(sweep, "sweep").when(f & t, "exchange_transfer").when(t, "deposit")
        .otherwise("withdrawal").alias("flow_type"),
        F.when(f & t, F.least("from_confidence", "to_confidence"))
        .when(t, F.col("to_confidence")).otherwise(F.col("from_confidence")).alias("confidence"),
    )


def exchange_summary(edges: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Per wallet and exchange address: interactions by direction with exact volume."""
    known = exchanges.select(
        F.col("address").alias("peer"), "exchange_name", F.col("address_role").alias("exchange_role"),
        F.col("confidence"),
    )
    return (
        wallet_edges(edges)
        .join(known, "peer")
        .groupBy("wallet", F.col("peer").alias("exchange_address"), "exchange_name", "exchange_role",
                 F.when(F.col("direction") == "in", "incoming").otherwise("outgoing").alias("direction"))
        .agg(
            F.count("*").alias("transfers"),
            wide.total(F.col("amount_raw")).alias("amount_raw"),
            F.max("confidence").alias("confidence"),
        )
    )


def incoming_origins(edges: DataFrame) -> DataFrame:
    """Direct senders of every wallet."""
    return edges.select(F.col("to_address").alias("wallet"), F.col("from_address").alias("origin")).distinct()


# time-bounded sequences ------------------------------------------------------


def pass_through(edges: DataFrame, window_ms: int = 600_000) -> DataFrame:
    """How many (receipt, later payment) pairs of one asset fall within the window.

    Counted, not paired.  With ``N(x)`` the payments up to time ``x`` a receipt
    at ``t`` contributes ``N(t + window) - N(before t)``; both values are a
    running count over payments and probes sorted together.  Pairs inside one
    transaction are taken off by multiplying its own counts.

    Transfers are dealt once, by wallet, asset and slice of 64 windows; a
    payment in the first window of a slice goes to the slice before as well, so
    no slice needs to know another's counts.
    """
    width = 64 * window_ms
    keys = ["wallet", "asset_id", "part"]
    own = F.floor(F.col(TS) / width).cast("bigint")
    early = (F.col("o") == 1) & (F.pmod(F.col(TS), F.lit(width)) <= window_ms)
    sides = edges.select(
        "tx_hash", "asset_id", TS,
        F.inline(
            F.array(
                F.struct(F.col("from_address").alias("wallet"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("to_address").alias("wallet"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ),
    )
    per_tx = (
        sides.withColumn("part", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
        .repartition(*keys)
        .groupBy(*keys, "tx_hash", TS)
        .agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    )
    # order at equal times: probe before, payments, probe after
    zero = F.lit(0).cast("bigint")
    points = per_tx.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(TS).alias("at"), F.lit(0).alias("kind"), (-F.col("i")).alias("weight"), zero.alias("paid"),
                         (F.col("i") * F.col("o")).alias("own")),
                F.struct(F.col(TS).alias("at"), F.lit(1).alias("kind"), zero.alias("weight"), F.col("o").alias("paid"), zero.alias("own")),
                F.struct((F.col(TS) + window_ms).alias("at"), F.lit(2).alias("kind"), F.col("i").alias("weight"), zero.alias("paid"), zero.alias("own")),
            )
        ),
    ).where((F.col("weight") != 0) | (F.col("paid") != 0))
    inside = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    running = points.withColumn("sofar", F.sum("paid").over(inside))
    pairs = running.where(F.col("wallet").isNotNull()).groupBy("wallet").agg(
        F.sum(F.col("weight") * F.col("sofar") - F.col("own")).alias("pair_count")
    )
    return pairs.where(F.col("pair_count") > 0)


def event_sequence(
    events: DataFrame, left: Column, right: Column, window_ms: int = HOUR_MS, slice_rows: int = 1_000_000
) -> DataFrame:
    """Subjects with a left and a right event within the window, in either order.

    For every left event only the nearest right event on each side is looked
    up; the first left event in time that has one is reported with it.  A
    subject is cut into slices of 512 windows, and where these hold more than
    ``slice_rows`` events, at their percentiles.
    """
    a = events.where(left).select(
        "subject_id", F.col(TS).alias("at"), F.col("event_id").alias("left_id")
    )
    b = events.where(right).select(
        "subject_id", F.col(TS).alias("at"), F.col(TS).alias("right_at"),
        F.col("event_id").alias("right_id"),
    )
    width = 512 * window_ms
    payload = ["right_at", "right_id"]
    # several right events may share a time: keep the smallest id
    b = b.groupBy("subject_id", "at", "right_at").agg(F.min("right_id").alias("right_id"))
    back = asof(a, b, ["subject_id"], ["at"], payload, "at", width, inclusive=True, slice_rows=slice_rows)
    ahead = asof(a, b, ["subject_id"], ["at"], payload, "at", width, forward=True, inclusive=True, slice_rows=slice_rows)
    found = back.unionByName(ahead).where(F.abs(F.col("right_at") - F.col("at")) <= window_ms)
    first = F.min(F.struct("at", "left_id", "right_at", "right_id"))
    return found.groupBy("subject_id").agg(first.alias("f")).select(
        "subject_id",
        F.col("f.left_id").alias("left_event_id"),
        F.col("f.right_id").alias("right_event_id"),
        F.abs(F.col("f.right_at") - F.col("f.at")).alias("distance_ms"),
    )


PAIR_COLUMNS = [
    "wallet", "part", "incoming_tx", "outgoing_tx", "received_at", "sent_at", "asset_id",
    "incoming_amount", "outgoing_amount",
]


#: Bins of an amount's logarithm: neighbouring bins differ by a factor of exp(1 / 16).
AMOUNT_BINS = 16


def _amount_bin(amount: int) -> int:
    """A bin that never falls as the amount grows; zero has its own, below all others."""
    return math.floor(math.log(amount) * AMOUNT_BINS) if amount else -1


def _first_payment(bins: dict[int, deque], low: int, high: int, after: int, until: int, tx: str, used: set[str]) -> tuple | None:
    """The earliest unused payment of another transaction within the amounts and times.

    ``bins`` hold (place, time, amount, tx) in order.  Times only rise from call
    to call, so what is used or too early at the head of a bin is dropped for good.
    """
    best = None
    first, last = _amount_bin(low), _amount_bin(high)
    for key in range(first, last + 1) if last - first < len(bins) else [k for k in bins if first <= k <= last]:
        queue = bins.get(key)
        if queue is None:
            continue
        while queue and (queue[0][1] <= after or queue[0][3] in used):
            queue.popleft()
        for payment in queue:
            place, at, amount, out_tx = payment
            if at > until or (best is not None and place > best[0]):
                break
            if low <= amount <= high and out_tx != tx and out_tx not in used:
                best = payment
                break
        if not queue:
            del bins[key]
    return best


def _greedy(rows: list, window_ms: int, divisor: int) -> list[tuple]:
    """Earliest-first matching inside one sorted wallet slice (small helper, no I/O).

    Payments wait by asset, token and size of their amount, so a receipt looks
    at payments near its amount and not at all that fall in its window.
    """
    used = set(rows[0].carried) if rows[0].carried is not None else set()
    waiting: dict[tuple, dict[int, deque]] = {}
    for place, r in enumerate(rows):
        if r.direction == "out":
            amount = int(r.amount_raw)
            bins = waiting.setdefault((r.asset_id, r.token), {})
            bins.setdefault(_amount_bin(amount), deque()).append((place, r.at, amount, r.tx_hash))
    out = []
    for r in rows:
        if r.direction != "in" or not r.home:
            continue
        bins = waiting.get((r.asset_id, r.token))
        if not bins or r.tx_hash in used:
            continue
        amount = int(r.amount_raw)
        if amount == 0:
            continue
        slack = amount // divisor
        found = _first_payment(bins, amount - slack, amount + slack, r.at, r.at + window_ms, r.tx_hash, used)
        if found is not None:
            p = rows[found[0]]
            used.update((r.tx_hash, p.tx_hash))
            out.append((r.wallet, r.part, r.tx_hash, p.tx_hash, r.at, p.at, r.asset_id, r.amount_raw, p.amount_raw))
    return out


def _match_slices(batches: Iterator[pd.DataFrame], window_ms: int, divisor: int) -> Iterator[pd.DataFrame]:
    """Stream sorted rows, one wallet slice in memory at a time."""
    stream = (row for pdf in batches for row in pdf.itertuples(index=False))
    found: list[tuple] = []
    for _, group in groupby(stream, key=lambda r: (r.wallet, r.part)):
        found.extend(_greedy(list(group), window_ms, divisor))
        if len(found) >= 10_000:
            yield pd.DataFrame(found, columns=PAIR_COLUMNS)
            found = []
    yield pd.DataFrame(found, columns=PAIR_COLUMNS)


def forwarding_pairs(
    edges: DataFrame, window_ms: int = 600_000, divisor: int = 10, slice_ms: int = 3_600_000,
) -> DataFrame:
    """Receipts followed by a similar payment of the same asset, each transaction used once.

    The rule is sequential per wallet (earliest receipt first, earliest fitting
    payment).  A wallet is cut into time slices; a slice depends on the one
    before only through payments that one already used.  All slices run in
    parallel, the used transactions are handed on, and only slices whose input
    changed run again until nothing changes.  The result equals the
    sequential rule, and no task holds more than one wallet-slice.
    """
    if slice_ms < window_ms:
        raise ValueError("slice must not be shorter than the window")
    own = F.floor(F.col("at") / slice_ms).cast("bigint")
    base = wallet_edges(edges.where(F.col("from_address") != F.col("to_address"))).select(
        "wallet", (F.col("direction") == "out").alias("out"), F.col(TS).alias("at"), "transaction_index", "tx_hash", "event_index",
        "asset_id", F.coalesce("token_id", F.lit("")).alias("token"), "amount_raw",
    )
    early = F.col("out") & (F.pmod(F.col("at"), F.lit(slice_ms)) <= window_ms)
    rows = base.withColumn("part", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
    # An asset that a wallet does not both receive and pay within a slice cannot match.  Rows are dealt once,
    # looked at and written where they lie.
    count = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = Window.partitionBy("wallet", "part", "asset_id", "token")
    both = rows.repartition(count, "wallet", "part").withColumns({
        "pays": F.max(F.col("out")).over(kind), "gets": F.max(~F.col("out")).over(kind),
    }).where(F.col("pays") & F.col("gets") & F.col("asset_id").isNotNull() & F.col("wallet").isNotNull() & F.col("part").isNotNull())
    rows = bucketed(both.drop("pays", "gets"), ["wallet", "part"], "forwarding-rows", dealt=True).select(
        "*", F.when(F.col("out"), "out").otherwise("in").alias("direction"), (F.col("part") == own).alias("home"),
    ).drop("out")
    schema = (
        "wallet string, part bigint, incoming_tx string, outgoing_tx string, received_at bigint, "
        "sent_at bigint, asset_id string, incoming_amount string, outgoing_amount string"
    )

    def run(part_rows: DataFrame) -> DataFrame:
        order = ["wallet", "part", "at", "transaction_index", "tx_hash", "event_index"]
        return (
            part_rows.repartition("wallet", "part")
            .sortWithinPartitions(*order)
            .mapInPandas(lambda batches: _match_slices(batches, window_ms, divisor), schema)
        )

    def handed_on(pairs: DataFrame) -> DataFrame:
        """Used transactions a slice leaves to the next one (payments in its first minutes)."""
        late = F.floor(F.col("sent_at") / slice_ms) > F.col("part")
        return (
            pairs.where(late)
            .groupBy("wallet", (F.col("part") + 1).alias("part"))
            .agg(F.sort_array(F.collect_set("outgoing_tx")).alias("carried"))
        )

    none = F.lit(None).cast("array<string>")
    tagged = lambda df, k: df.withColumn("round", F.lit(k))
    pairs = tagged(materialise(run(rows.withColumn("carried", none)), "forwarding"), 0)
    given = tagged(materialise(handed_on(pairs), "forwarding-carry"), 0)
    changed = given.select("wallet", "part", "carried")
    reruns, done = None, 0
    while not changed.isEmpty():  # slices hand on forwards only, so each round settles at least one more of a chain
        done += 1
        again = materialise(run(rows.join(changed, ["wallet", "part"])), "forwarding")
        next_parts = changed.select("wallet", (F.col("part") + 1).alias("part"))
        before = given.join(next_parts, ["wallet", "part"], "left_semi").groupBy("wallet", "part").agg(
            F.max_by("carried", "round").alias("before")
        )
        # only slices after the ones that ran again can be given something else
        handed = materialise(
            next_parts.join(handed_on(again), ["wallet", "part"], "left").join(before, ["wallet", "part"], "left")
            .where(~F.col("carried").eqNullSafe(F.col("before"))).select("wallet", "part", "carried"),
            "forwarding-carry",
        )
        ran = tagged(changed.select("wallet", "part"), done)
        reruns = ran if reruns is None else reruns.unionByName(ran)
        pairs, given = pairs.unionByName(tagged(again, done)), given.unionByName(tagged(handed, done))
        changed = handed
    if reruns is not None:
        last = reruns.groupBy("wallet", "part").agg(F.max("round").alias("last"))
        pairs = pairs.join(last, ["wallet", "part"], "left").where(F.col("round") == F.coalesce("last", F.lit(0))).drop("last")
    return pairs.drop("part", "round")


# outpoints -------------------------------------------------------------------


def previous_output(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Newest earlier occurrence of the outpoint each input spends."""
    order = ["block_number", "transaction_index"]
    made = outputs.select(
        F.col("tx_hash").alias("prev_tx_hash"), F.col("output_index").alias("prev_output_index"),
        *order,
        F.col("block_number").alias("origin_block"),
        F.col("transaction_index").alias("origin_position"),
        F.col("address").alias("origin_address"), F.col("value_sats").alias("origin_value"),
    )
    payload = ["origin_block", "origin_position", "origin_address", "origin_value"]
    return asof(inputs, made, ["prev_tx_hash", "prev_output_index"], order, payload,
                "block_number", DAY_BLOCKS * 365)


def spender(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """First later input on each output's outpoint, unless the outpoint recurs before it.

    An output whose outpoint occurs again before the spend belongs to the
    older occurrence, so the spend is not its own.
    """
    order = ["block_number", "transaction_index"]
    keys = ["tx_hash", "output_index"]
    used = inputs.select(
        F.col("prev_tx_hash").alias("tx_hash"), F.col("prev_output_index").alias("output_index"),
        *order,
        F.col("block_number").alias("spent_block"),
        F.col("transaction_index").alias("spent_position"),
        F.col("tx_hash").alias("spending_tx"),
    )
    later = outputs.select(
        *keys, *order,
        F.col("block_number").alias("again_block"),
        F.col("transaction_index").alias("again_position"),
    )
    found = asof(outputs, used, keys, order, ["spent_block", "spent_position", "spending_tx"],
                 "block_number", DAY_BLOCKS * 365, forward=True)
    found = asof(found, later, keys, order, ["again_block", "again_position"],
                 "block_number", DAY_BLOCKS * 365, forward=True)
    own = F.col("again_block").isNull() | (
        F.struct(F.col("spent_block").alias("a"), F.col("spent_position").alias("b"))
        <= F.struct(F.col("again_block").alias("a"), F.col("again_position").alias("b"))
    )
    keep = [c for c in found.columns if c not in ("again_block", "again_position")]
    spent = ["spent_block", "spent_position", "spending_tx"]
    return found.select(*[F.when(own, F.col(c)).alias(c) if c in spent else F.col(c) for c in keep])


def output_states(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Latest occurrence of every outpoint and whether its last spend came after it.

    The latest occurrence is chosen before any address filter: a recurrence can
    move an outpoint to another address.
    """
    newest = latest(outputs, ["tx_hash", "output_index"], "block_number",
                    ["transaction_index", "address", "value_sats"])
    at = F.struct(F.col("block_number").alias("b"), F.col("transaction_index").alias("t"))
    last = inputs.groupBy(
        F.col("prev_tx_hash").alias("tx_hash"), F.col("prev_output_index").alias("output_index")
    ).agg(F.max(at).alias("spent_at"), F.max(F.struct(at.alias("at"), F.col("tx_hash").alias("x"))).alias("__s"))
    spent = F.col("spent_at") > F.struct(
        F.col("block_number").alias("b"), F.col("transaction_index").cast("bigint").alias("t")
    )
    return newest.join(last, ["tx_hash", "output_index"], "left").select(
        *outputs.columns,
        F.coalesce(spent.cast("int"), F.lit(0)).alias("is_spent"),
        F.when(spent, F.col("__s.x")).alias("spending_tx"),
    )


# bridges ---------------------------------------------------------------------

BRIDGE_WINDOW_MS = 48 * HOUR_MS
BRIDGE_BPS = 500
#: Limbs of an amount at the finer side's decimals, and the digits that leave room for a factor.
BRIDGE_LIMBS = 5
BRIDGE_DIGITS = BRIDGE_LIMBS * wide.DIGITS - 5


def _scaled_up(amount: Column, places: Column) -> Column:
    return F.concat(amount, F.repeat(F.lit("0"), places.cast("int")))


def _times(amount: Column, factor: int) -> Column:
    """``amount * factor`` for a small factor, exactly, by limbs."""
    return wide.joined([limb * F.lit(factor) for limb in wide.whole_limbs(amount, BRIDGE_LIMBS)])


def match_bridge(
    sends: DataFrame, relays: DataFrame, assets: DataFrame,
    window_ms: int = BRIDGE_WINDOW_MS, bps: int = BRIDGE_BPS,
) -> DataFrame:
    """Send and relay of one operation: same parties, corridor, time and scaled amount.

    ``assets``: chain_id, token, symbol, decimals (a small reviewed table).
    A side that fits more than one partner is ambiguous and left out.  Amounts
    are compared exactly; one of more than ``BRIDGE_DIGITS`` digits, which no
    256-bit word with up to 52 decimals has, fits nothing.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        info = assets.select("chain_id", "token", "symbol", "decimals")
        return df.join(info, ["chain_id", "token"]).select(
            "operation_id", "sender", "receiver",
            *[F.col(c).alias(f"{p}_{c}") for c in
              ("chain_id", "remote_chain_id", "event_id", "timestamp_ms", "amount_raw", "symbol", "decimals")],
        )

    pairs = side(sends, "send").join(side(relays, "relay"), ["operation_id", "sender", "receiver"])
    top = F.greatest("send_decimals", "relay_decimals")
    sent = _scaled_up(F.col("send_amount_raw"), top - F.col("send_decimals"))
    got = _scaled_up(F.col("relay_amount_raw"), top - F.col("relay_decimals"))
    held = (F.length(sent) <= BRIDGE_DIGITS) & (F.length(got) <= BRIDGE_DIGITS)
    sent, got = F.when(held, sent), F.when(held, got)
    delay = F.col("relay_timestamp_ms") - F.col("send_timestamp_ms")
    fits = (
        (F.col("send_remote_chain_id") == F.col("relay_chain_id"))
        & (F.col("relay_remote_chain_id") == F.col("send_chain_id"))
        & (F.col("send_symbol") == F.col("relay_symbol"))
        & delay.between(0, window_ms)
        & held
        & (wide.compared(_times(got, 10_000)) >= wide.compared(_times(sent, 10_000 - bps)))
        & (wide.compared(_times(got, 10_000)) <= wide.compared(_times(sent, 10_000 + bps)))
    )
    near = pairs.where(fits).withColumn("delay_ms", delay)
    single = near
    for p in ("send_event_id", "relay_event_id"):
        counts = near.groupBy(p).agg(F.count("*").alias("__n")).where(F.col("__n") == 1)
        single = single.join(counts.select(p), p, "left_semi")
    return single


def match_messages(sends: DataFrame, receives: DataFrame, routes: DataFrame,
                   window_ms: int = BRIDGE_WINDOW_MS) -> DataFrame:
    """Message send and receive with equal recipient, nonce, route and message hash.

    ``message_hash`` is an input column on both sides.  ``routes``: source,
    destination, route_id, token - the reviewed network pairs.
    """
    a = sends.select(
        F.col("network_id").alias("source"), "route_id", "token", "recipient", "nonce", "message_hash",
        F.col("timestamp_ms").alias("sent_ms"), F.col("event_id").alias("send_event_id"),
    ).join(routes, ["source", "route_id", "token"])
    b = receives.select(
        F.col("network_id").alias("destination"), "recipient", "nonce", "message_hash",
        F.col("timestamp_ms").alias("received_ms"), F.col("event_id").alias("receive_event_id"),
    )
    delay = F.col("received_ms") - F.col("sent_ms")
    return a.join(b, ["destination", "recipient", "nonce", "message_hash"]).withColumn(
        "delay_ms", delay
    ).where(delay.between(0, window_ms))


# Bounds of the deposit chain.
SPEND_BLOCKS = 4_320
PROOF_DELAY_MS = 7 * 24 * HOUR_MS
CLOCK_SKEW_MS = 2 * HOUR_MS
MINT_WINDOW_MS = 7 * 24 * HOUR_MS
UNITS_PER_SAT = 10_000_000_000


def reversed_hash(value: Column) -> Column:
    """A hash, two digits a byte, with its byte order turned round; mentions ``value`` once, for it may be a digest itself."""
    return F.regexp_replace(F.reverse(value), "(.)(.)", "$2$1")


def _first_fit(deposits: DataFrame, steps: DataFrame, keys: list[str], fits: Column, columns: list[str]) -> DataFrame:
    """``deposits`` with ``columns`` of the first step that fits each one, in the order of ``columns``, or nulls.

    Deposits go through once: the fold keeps their columns as its keys and runs
    where the join left them, so steps in a row don't compute earlier ones anew.
    """
    joined = deposits.join(steps, keys, "left")
    first = joined.groupBy(*deposits.columns).agg(F.min(F.when(fits, F.struct(*columns))).alias("__fit"))
    return first.select(*deposits.columns, *[F.col("__fit")[c].alias(c) for c in columns])


# The bridge's vault and token, and its event signatures.
MINT_VAULT = "0x9c070027cdc9dc8f82416b2e5314e11dfb4fe3cd"
MINT_TOKEN = "0x18084fba666a33d37592fa2633fd49a74dd93a88"
MINT_FINALIZED = "2cffebf26d639426e79514d100febae8b2c63e700e5dc0fa6c88a12963350636"
MINTED = "30385c845b448a36257a6a1716e6ad2e1bc2cbe333cde1e69fe849ad6511adfe"


def mint_observations(logs: DataFrame) -> DataFrame:
    """Finalised mints with the token mints that stand directly before them in their transaction.

    ``logs``: tx_hash, log_index, block_number, timestamp_ms, address, topics,
    data.  Before a finalisation stand a minted log and its transfer out of
    nothing, for the recipient; a pair for the fee may stand between.  Each
    finalisation reads its four places by their index, in one pass over the
    bridge's logs of a transaction, so logs are never paired with each other.
    Gives one row for each finalisation that fits.
    """
    topic = [unprefixed(F.get("topics", F.lit(i))) for i in range(4)]
    vault, token = (F.lower("address") == a for a in (MINT_VAULT, MINT_TOKEN))
    last = (
        vault & (topic[0] == MINT_FINALIZED) & (F.size("topics") == 4)
        & (F.coalesce(word_address(topic[1]), F.lit(ZERO_ADDRESS)) != ZERO_ADDRESS)
    )
    minted = vault & (topic[0] == MINTED) & (F.size("topics") == 2)
    moved = token & (topic[0] == TRANSFER) & (F.size("topics") == 3) & (word_address(topic[1]) == ZERO_ADDRESS)
    kind = F.when(last, "last").when(minted, "minted").when(moved, "moved")
    own = logs.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "tx_hash", "log_index", "block_number", "timestamp_ms", "kind", topic[2].alias("deposit_key"),
        word_address(F.when(F.col("kind") == "last", topic[3]).when(F.col("kind") == "minted", topic[1]).otherwise(topic[2])).alias("who"),
        word(unprefixed(F.coalesce("data", F.lit(""))), 0).alias("value"),
    ).withColumn("amount", amount_of(F.col("value")))
    # the places before a log by their index, within its transaction
    step, inside = F.struct("kind", "who", "value", "amount"), Window.partitionBy("tx_hash").orderBy("log_index")
    five = own.withColumns({f"at{k}": F.max(step).over(inside.rangeBetween(-k, -k)) for k in range(1, 5)})

    def pair(first: str, second: str) -> Column:
        a, b = F.col(first), F.col(second)
        fits = (
            (a["kind"] == "minted") & (b["kind"] == "moved") & (a["who"] == b["who"]) & (a["who"] != ZERO_ADDRESS)
            & (a["value"] == b["value"]) & (a["value"] != "0" * 64)
        )
        return F.when(fits, F.struct(a["who"].alias("who"), a["amount"].alias("amount")))

    rows = five.where(F.col("kind") == "last").select(
        "tx_hash", F.col("log_index").alias("final_index"), "block_number", "timestamp_ms", "deposit_key",
        F.col("who").alias("recipient"), F.col("amount").alias("debt_raw"),
        pair("at2", "at1").alias("near"), pair("at4", "at3").alias("far"),
    )
    direct = F.col("near.who") == F.col("recipient")
    to_far = F.coalesce(F.col("far.who") == F.col("recipient"), F.lit(False))
    good = F.col("near").isNotNull() & F.when(direct, ~to_far).otherwise(to_far)
    issued = F.when(direct, F.col("near.amount")).otherwise(F.col("far.amount"))
    fee = F.when(direct, F.lit("0")).otherwise(F.col("near.amount"))
    both = wide.joined([a + b for a, b in zip(wide.whole_limbs(F.col("issued_raw")), wide.whole_limbs(F.col("fee_raw")), strict=True)])
    return rows.where(good).withColumns({"issued_raw": issued, "fee_raw": fee}).select(
        "deposit_key", "recipient", "timestamp_ms", stable_id(F.col("tx_hash"), F.col("final_index"), F.lit("mint")).alias("event_id"),
        F.when(F.col("fee_raw") == "0", F.col("issued_raw")).otherwise(both).alias("minted_raw"), "fee_raw", "debt_raw", "block_number", F.col("final_index").alias("log_index"),
    )


def deposit_lifecycle(
    outputs: DataFrame, reveals: DataFrame, spends: DataFrame, sweeps: DataFrame, mints: DataFrame
) -> DataFrame:
    """Deposit output, its reveal, the spend, the sweep proof and the mint, as one row.

    Every step keeps deposits whose later steps are missing and takes the first
    log that fits, so a deposit is one row.  Sweep logs carry the spend hash
    byte-reversed.
    """
    revealed = outputs.join(
        reveals.select(
            F.col("funding_tx_hash").alias("tx_hash"), "output_index", "deposit_key", "depositor",
            "wallet", F.col("timestamp_ms").alias("reveal_ms"),
            F.struct(F.col("block_number").alias("b"), F.col("log_index").alias("i")).alias("reveal_at"),
        ),
        ["tx_hash", "output_index"],
    )
    used = spends.select(
        F.col("prev_tx_hash").alias("tx_hash"), F.col("prev_output_index").alias("output_index"),
        F.col("tx_hash").alias("spend_tx"), F.col("block_number").alias("spend_block"),
        F.col("timestamp_ms").alias("spend_ms"),
    )
    in_time = F.col("spend_block").between(
        F.col("block_number"), F.col("block_number") + SPEND_BLOCKS
    ) & (F.col("spend_tx") != F.col("tx_hash"))
    swept = _first_fit(revealed, used, ["tx_hash", "output_index"], in_time, ["spend_block", "spend_tx", "spend_ms"])
    proof = sweeps.select(
        reversed_hash(F.col("sweep_tx_reversed")).alias("spend_tx"), "wallet",
        F.col("timestamp_ms").alias("sweep_ms"), F.col("event_id").alias("sweep_event_id"),
        F.struct(F.col("block_number").alias("b"), F.col("log_index").alias("i")).alias("sweep_at"),
    )
    proven = (
        (F.col("sweep_at") > F.col("reveal_at"))
        & (F.col("sweep_ms") >= F.greatest(F.col("reveal_ms"), F.col("spend_ms") - CLOCK_SKEW_MS))
        & (F.col("sweep_ms") <= F.col("spend_ms") + PROOF_DELAY_MS)
    )
    swept = _first_fit(swept, proof, ["spend_tx", "wallet"], proven, ["sweep_at", "sweep_event_id", "sweep_ms"]).drop("sweep_at")
    final = mints.select(
        "deposit_key", F.col("recipient").alias("depositor"), F.col("timestamp_ms").alias("mint_ms"),
        F.col("event_id").alias("mint_event_id"), "minted_raw", "debt_raw",
        F.struct(F.col("block_number").alias("b"), F.col("log_index").alias("i")).alias("mint_at"),
    )
    funding = F.concat(F.col("value_sats").cast("string"), F.repeat(F.lit("0"), F.lit(10)))
    issued = (
        (F.col("mint_at") > F.col("reveal_at"))
        & F.col("mint_ms").between(F.col("reveal_ms"), F.col("reveal_ms") + MINT_WINDOW_MS)
        & (wide.padded(F.col("minted_raw")) <= wide.padded(funding))
        & (wide.padded(F.col("minted_raw")) <= wide.padded(F.col("debt_raw")))
    )
    done = _first_fit(
        swept, final, ["deposit_key", "depositor"], issued, ["mint_at", "mint_event_id", "mint_ms", "minted_raw", "debt_raw"]
    )
    stage = (
        F.when(F.col("mint_ms").isNotNull(), "minted")
        .when(F.col("sweep_ms").isNotNull(), "swept")
        .when(F.col("spend_tx").isNotNull(), "spent")
        .otherwise("revealed")
    )
    return done.drop("mint_at", "reveal_at", "debt_raw").withColumn("stage", stage)


def bridge_correlation(events: DataFrame) -> DataFrame:
    """A key that is the same on both ends of a bridge transfer, whichever end reports."""
    ends = F.array_sort(
        F.array(
            F.concat_ws("|", "local_network", "local_asset"),
            F.concat_ws("|", "remote_network", "remote_asset"),
        )
    )
    return events.withColumn(
        "correlation_key",
        stable_id(F.col("protocol"), ends[0], ends[1], F.col("sender"), F.col("receiver"),
                  F.col("amount_raw")),
    )


def correlated_pairs(events: DataFrame) -> DataFrame:
    """Events of different networks under one correlation key, when exactly two exist."""
    keyed = bridge_correlation(events)
    pair = keyed.groupBy("correlation_key").agg(
        F.count("*").alias("n"),
        F.min(F.struct("local_network", "event_id")).alias("a"),
        F.max(F.struct("local_network", "event_id")).alias("b"),
    )
    return pair.where(
        (F.col("n") == 2) & (F.col("a.local_network") != F.col("b.local_network"))
    ).select(
        "correlation_key",
        F.col("a.event_id").alias("first_event_id"), F.col("b.event_id").alias("second_event_id"),
    )


def receipt_swaps(swap_logs: DataFrame, edges: DataFrame) -> DataFrame:
    """Swaps whose log amounts equal the pool's own transfers in that transaction.

    ``swap_logs``: tx_hash, pool, log_index, amount0_in, amount1_in,
    amount0_out, amount1_out.  A pool with several swaps in one transaction is
    skipped, as is one with more than one asset on a side.
    """
    zero = F.lit("0")
    ins0, ins1 = F.col("amount0_in") != zero, F.col("amount1_in") != zero
    outs0, outs1 = F.col("amount0_out") != zero, F.col("amount1_out") != zero
    forward, back = ins0 & outs1 & ~ins1 & ~outs0, ins1 & outs0 & ~ins0 & ~outs1
    single = (
        swap_logs.groupBy("tx_hash", "pool")
        .agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in
             ("log_index", "amount0_in", "amount1_in", "amount0_out", "amount1_out")])
        .where((F.col("n") == 1) & (forward | back))
        .select(
            "tx_hash", "pool", "log_index",
            F.when(forward, F.col("amount0_in")).otherwise(F.col("amount1_in")).alias("amount_in"),
            F.when(forward, F.col("amount1_out")).otherwise(F.col("amount0_out")).alias("amount_out"),
        )
    )
    real = edges.where(
        F.col("token_id").isNull() & (F.col("from_address") != F.col("to_address"))
        & (F.col("amount_raw") != zero)
    )
    sides = real.select(
        "tx_hash", "asset_id", "amount_raw",
        F.inline(
            F.array(
                F.struct(F.col("to_address").alias("pool"), F.lit("in").alias("side")),
                F.struct(F.col("from_address").alias("pool"), F.lit("out").alias("side")),
            )
        ),
    ).join(single.select("tx_hash", "pool"), ["tx_hash", "pool"], "left_semi")
    per_asset = sides.groupBy("tx_hash", "pool", "side", "asset_id").agg(
        wide.total(F.col("amount_raw")).alias("total")
    )
    is_in = F.col("side") == "in"
    per_pool = per_asset.groupBy("tx_hash", "pool").agg(
        F.count_if(is_in).alias("assets_in"), F.count_if(~is_in).alias("assets_out"),
        F.max(F.when(is_in, F.col("asset_id"))).alias("asset_in"),
        F.max(F.when(~is_in, F.col("asset_id"))).alias("asset_out"),
        F.max(F.when(is_in, F.col("total"))).alias("seen_in"),
        F.max(F.when(~is_in, F.col("total"))).alias("seen_out"),
    )
    return single.join(per_pool, ["tx_hash", "pool"]).where(
        (F.col("assets_in") == 1) & (F.col("assets_out") == 1)
        & (F.col("asset_in") != F.col("asset_out"))
        & (F.col("seen_in") == F.col("amount_in")) & (F.col("seen_out") == F.col("amount_out"))
    ).select("tx_hash", "pool", "log_index", "asset_in", "asset_out", "amount_in", "amount_out")


def with_state(df: DataFrame, state: DataFrame) -> DataFrame:
    """The published state of its network next to every row."""
    facts = per_network(state).select("network_id", "last_block_number", "start_block")
    return df.join(facts, "network_id")

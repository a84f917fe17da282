"""Stream forms replayed over the supplied events and compared with batch SQL (section M)."""

from __future__ import annotations

import uuid
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.operators import clusters
from chainweft.plans.registry import ZERO, query
from chainweft.session import materialise, shared_dir
from chainweft.sources.tables import Tables
from chainweft.streaming import streams as op


def _stream(t: Tables, name: str = "events") -> DataFrame:
    return op.read_stream(t.spark, t.path, t.raw(name).schema, pattern=f"{name}.parquet")


def _restream(df: DataFrame, label: str, parts: int = 4, by: str | None = None) -> DataFrame:
    """A batch frame as a stream of a few files, ordered by a column where one is named."""
    if by is None:
        stored = materialise(df.repartition(parts), label)
    else:  # a file at a time, as they are read by age
        cuts = [float("-inf"), *df.approxQuantile(by, [k / parts for k in range(1, parts)], 0.001), float("inf")]
        folder = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
        for low, high in pairwise(cuts):
            df.where((F.col(by) >= low) & (F.col(by) < high)).coalesce(1).write.mode("append").parquet(folder)
        return op.read_stream(df.sparkSession, folder, df.schema, 1)
    return op.read_stream(df.sparkSession, stored.inputFiles()[0].rsplit("/", 1)[0], stored.schema, 1)


def _activity(t: Tables) -> DataFrame:
    return _stream(t).select(
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("wallet"), F.col("ts").cast("timestamp").alias("at"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.col("event_type").alias("kind"),
        F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("tx_hash"), F.lit("cash").alias("asset_id"),
    )


@query("m01_confirmed_blocks", "SELECT block_number, block_hash, revision FROM blocks WHERE block_number <= (SELECT max(block_number) - 5 FROM blocks)")
def confirmed_blocks(t: Tables) -> DataFrame:
    stream = _restream(t.blocks(), "blocks")
    sink = op.Sink(t.spark, "confirmed")
    op.confirmed(stream, sink, 6)
    return sink.read(stream.schema).select("block_number", "block_hash", "revision")


@query(
    "m02_published_in_order",
    """WITH RECURSIVE hd AS (SELECT DISTINCT 'n' || ((block_number + 31) // 37) AS network_id, block_number, block_hash, parent_hash FROM blocks),
    an AS (SELECT network_id, min(block_number) AS block_number FROM hd GROUP BY 1),
    w AS (SELECT hd.network_id, hd.block_number, hd.block_hash FROM hd JOIN an USING (network_id, block_number)
        UNION SELECT hd.network_id, hd.block_number, hd.block_hash FROM w JOIN hd ON hd.network_id = w.network_id AND hd.block_number = w.block_number + 1 AND hd.parent_hash = w.block_hash)
    SELECT network_id, block_number, block_hash FROM w""",
)
def published_in_order(t: Tables) -> DataFrame:
    """Headers of all revisions in random order; every gap of the supplied heights begins another network."""
    headers = t.blocks().select(
        F.concat(F.lit("n"), F.floor((F.col("block_number") + 31) / 37)).alias("network_id"), "block_number", "block_hash", "parent_hash"
    )
    anchors = headers.groupBy("network_id").agg(F.min_by(F.struct("block_number", "block_hash"), "block_number").alias("a")).select("network_id", "a.*")
    sink = op.Sink(t.spark, "published")
    op.publish_in_order(_restream(headers, "headers"), sink, materialise(anchors, "anchors"))
    return sink.read(op.HEADER).select("network_id", "block_number", "block_hash")


@query("m03_deduplicated_blocks", "SELECT DISTINCT block_number, block_hash, revision FROM blocks")
def deduplicated_blocks(t: Tables) -> DataFrame:
    """Every block arrives twice, the second time up to half a day later and so often in a later file; state is kept for a day."""
    late = t.blocks().withColumn("arrives", F.col("block_timestamp_unix_ms") + F.pmod(F.xxhash64("block_hash"), F.lit(43_200_000)))
    twice = t.blocks().withColumn("arrives", F.col("block_timestamp_unix_ms")).unionByName(late)
    out = op.replay(op.dedupe_blocks(_restream(twice, "twice", 6, "arrives").drop("arrives"), "1 day"), "deduplicated")
    return out.select("block_number", "block_hash", "revision")


@query(
    "m04_late_coverage",
    "SELECT block_number, block_hash, max(revision) AS revision, max(trace_coverage) AS trace_coverage FROM blocks GROUP BY 1, 2",
)
def late_coverage(t: Tables) -> DataFrame:
    stored = op.replay(_restream(t.blocks(), "late"), "coverage")
    return op.late_coverage(stored).select("block_number", "block_hash", "revision", "trace_coverage")


@query(
    "m05_daily_activity_stream",
    """SELECT 'C' || user_id AS wallet, epoch_us(ts) // 86400000000 * 86400000 AS day_unix_ms, count(*) AS events, cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS cents FROM events GROUP BY 1, 2""",
)
def daily_activity_stream(t: Tables) -> DataFrame:
    return op.replay(op.stream_daily(_activity(t)), "daily", "update", ["wallet", "day_unix_ms"])


@query(
    "m05_bursts_stream",
    """SELECT 'C' || user_id AS wallet, w * 600000 AS window_start_ms, count(*) AS events FROM (SELECT user_id, unnest(range(epoch_us(ts) // 600000000 - 5, epoch_us(ts) // 600000000 + 1)) AS w FROM events) GROUP BY 1, 2""",
)
def bursts_stream(t: Tables) -> DataFrame:
    return op.replay(op.stream_bursts(_activity(t)), "bursts", "update", ["wallet", "window_start_ms"])


@query(
    "m06_forwarding_stream",
    """SELECT 'C' || a.user_id AS wallet, 'x' || a.event_id AS incoming_tx, 'x' || b.event_id AS outgoing_tx FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type IN ('view', 'purchase') AND b.event_type IN ('click', 'signup')
        AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 86400 SECONDS AND abs(cast(round(b.value * 100) AS bigint) - cast(round(a.value * 100) AS bigint)) <= cast(round(a.value * 100) AS bigint) * 0.1""",
)
def forwarding_stream(t: Tables) -> DataFrame:
    received = _activity(t).where(F.col("kind").isin("view", "purchase"))
    sent = _activity(t).where(F.col("kind").isin("click", "signup"))
    found = op.stream_forwarding(received, sent, 86_400)
    return op.replay(found, "forwarding").select("wallet", "incoming_tx", "outgoing_tx")


@query(
    "m07_sessions_stream",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM e)
    SELECT 'C' || user_id AS wallet, min(us) // 1000 AS first_ms, max(us) // 1000 AS last_ms, count(*) AS events FROM s GROUP BY user_id, k""",
)
def sessions_stream(t: Tables) -> DataFrame:
    """Session windows emit when closed, so the replay ends with a far-future row per run."""
    far = t.raw("events").agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"),
    )
    both = t.raw("events").unionByName(far)
    stream = _restream(both, "session-input", 1).select(
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("wallet"), F.col("ts").cast("timestamp").alias("at")
    )
    out = op.replay(op.stream_sessions(stream, "6 hours"), "sessions")
    return out.where(F.col("wallet") != "C-1").select("wallet", "first_ms", "last_ms", "events")


@query(
    "m08_alerts_stream",
    """WITH c AS (SELECT 'w' || user_id AS watch_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'matched' ELSE 'no_match' END AS s, value FROM events WHERE event_type <> 'error'),
    p AS (SELECT *, lag(s) OVER (PARTITION BY watch_id ORDER BY event_id) AS was FROM c)
    SELECT watch_id, event_id AS created_at_ms, CASE WHEN value >= 60 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity FROM p WHERE s = 'matched' AND coalesce(was, 'no_match') <> 'matched'""",
)
def alerts_stream(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    checks = _stream(t).select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("watch_id"), F.col("event_id").alias("checked_at"),
        F.when(kind.isin("view", "click"), "matched").when(kind == "error", "unknown").otherwise("no_match").alias("status"),
        F.col("value").alias("score"),
    )
    return op.replay(op.stream_alerts(checks), "alerts").select("watch_id", "created_at_ms", "severity")


@query(
    "m09_clusters_stream",
    f"""WITH p AS (SELECT to_address AS destination, asset_id, coalesce(token_id, '') AS token, from_address, count(*) AS n, max(block_number) AS b FROM edges
        WHERE amount > 0 AND from_address <> to_address AND from_address <> {ZERO} AND to_address <> {ZERO} GROUP BY 1, 2, 3, 4)
    SELECT destination, asset_id, token, count(*) AS distinct_senders, sum(n)::BIGINT AS transfers, max(b) AS last_block FROM p GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 3 AND 20""",
)
def clusters_stream(t: Tables) -> DataFrame:
    """Edges in six batches: out of order, some twice, and some of blocks that a second run finds replaced."""
    own = materialise(
        t.edges().select(
            "relationship_id", "block_number", F.concat(F.lit("b"), "block_number").alias("block_hash"), F.col("to_address").alias("destination"),
            "asset_id", F.coalesce("token_id", F.lit("")).alias("token"), "from_address", "amount_raw",
        ),
        "cluster-own",
    )
    # a seventh of the blocks first comes with other transfers under another hash; the tip is one of them
    tip = own.agg(F.max("block_number").alias("tip"))
    replaced = (F.col("block_number") % 7 == 3) | (F.col("block_number") == F.col("tip"))
    marked = own.crossJoin(F.broadcast(tip)).withColumn("replaced", replaced).drop("tip")  # one row
    first_hash = F.when(F.col("replaced"), F.concat(F.lit("f"), "block_number")).otherwise(F.col("block_hash")).alias("block_hash")
    blocks = materialise(marked.select("block_number", "block_hash", "replaced").distinct(), "canon")
    gone = marked.where("replaced").withColumns(
        {"block_hash": first_hash, "relationship_id": F.concat(F.lit("gone-"), "relationship_id"), "from_address": F.concat(F.lit("x"), "from_address")}
    )
    key = F.xxhash64("relationship_id")
    half = F.pmod(key, F.lit(2)) == 0
    one = marked.where(half & ~F.col("replaced")).unionByName(gone)
    two = marked.where(~half | F.col("replaced")).unionByName(marked.where(key % 5 == 0))
    folder = f"{shared_dir(t.spark)}/cluster-edges-{uuid.uuid4().hex}"
    state = op.ClusterState(op.Sink(t.spark, "clusters"), own.schema, ["destination", "asset_id", "token"], _shared)
    files = 0
    for rows, block_hash in ((one, first_hash), (two, F.col("block_hash"))):
        rows.select(*own.columns).write.mode("append").parquet(folder)
        before, files = files, len(t.spark.read.schema(own.schema).parquet(folder).inputFiles())
        third = max(-(-(files - before) // 3), 1)
        op.stream_clusters(op.read_stream(t.spark, folder, own.schema, third), state, blocks.select("block_number", block_hash))
    return state.read().select("destination", "asset_id", "token", "distinct_senders", "transfers", "last_block")


def _shared(edges: DataFrame) -> DataFrame:
    return clusters.shared_destination(edges.withColumnRenamed("destination", "to_address"))


@query(
    "m10_failures_stream",
    """SELECT 'f' || (event_id % 500) AS failure_id, count(*) FILTER (event_type <> 'purchase') AS attempts,
        CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'resolved' WHEN count(*) >= 5 THEN 'dead_letter' ELSE 'retry' END AS status FROM events GROUP BY 1""",
)
def failures_stream(t: Tables) -> DataFrame:
    """Supplied events as attempts at five hundred blocks; a purchase publishes the block. They come in four batches."""
    attempts = _restream(t.raw("events"), "attempts").select(
        F.lit("n").alias("network_id"), F.concat(F.lit("f"), (F.col("event_id") % 500).cast("string")).alias("failure_id"),
        (F.col("event_id") % 500).alias("block_number"),
        F.when(F.col("event_type") == "purchase", "published").otherwise("failed").alias("outcome"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
    )
    sink = op.Sink(t.spark, "failures")
    op.stream_failures(attempts, sink)
    return op.failure_states(sink).select("failure_id", "attempts", "status")

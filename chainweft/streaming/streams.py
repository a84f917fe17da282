"""Streams of blocks, activity, checks and failures.

State is kept per network, watch or window and is small; late and repeated
rows are settled at read time by revision.  Every batch writes under its batch
id, so a retried batch replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chainweft.functions.chains import places
from chainweft.operators.risk import severity
from chainweft.operators.visibility import latest
from chainweft.session import materialise, shared_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
                pattern: str | None = None) -> DataFrame:
    """A stream over parquet files that arrive in the folder ``path``."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


class Sink:
    """Batches of one stream as parquet folders, one per batch id."""

    def __init__(self, spark: SparkSession, label: str, base: str | None = None):
        self.spark = spark
        self.base = base or f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"

    def write(self, rows: DataFrame, batch_id: int, table: str = "out") -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/{table}/batch={batch_id}")

    def read(self, schema: T.StructType, table: str = "out") -> DataFrame:
        with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(with_batch).parquet(f"{self.base}/{table}")
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], with_batch)


def run_available(stream: DataFrame, sink: Sink, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", sink.checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def replay(stream: DataFrame, label: str, mode: str = "append", keys: Sequence[str] | None = None) -> DataFrame:
    """Run a stream over what is available; with ``keys`` the newest batch per key wins."""
    sink = Sink(stream.sparkSession, label)
    run_available(stream, sink, lambda rows, batch_id: sink.write(rows, batch_id), mode)
    rows = sink.read(stream.schema)
    return (latest(rows, list(keys), "batch") if keys else rows).drop("batch")


# blocks ------------------------------------------------------------------------


def confirmed(stream: DataFrame, sink: Sink, depth: int) -> None:
    """Release blocks at or below ``head - (depth - 1)``; the rest waits.

    Waiting blocks are at most ``depth`` heights per network plus the newest
    batch, and are rewritten with each batch.
    """
    schema = stream.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        waiting = sink.read(schema, "waiting")
        waiting = waiting.where(F.col("batch") == batch_id - 1).drop("batch")
        rows = batch.unionByName(waiting)
        heads = sink.read(T.StructType([T.StructField("network_id", T.StringType()), T.StructField("head", T.LongType())]), "heads")
        heads = heads.where(F.col("batch") < batch_id).select("network_id", "head").unionByName(
            batch.groupBy("network_id").agg(F.max("block_number").alias("head"))
        )
        # one row per network
        head = F.broadcast(heads.groupBy("network_id").agg(F.max("head").alias("head")))
        marked = rows.join(head, "network_id").withColumn("__due", F.col("block_number") <= F.col("head") - (depth - 1))
        sink.write(head, batch_id, "heads")
        sink.write(marked.where("__due").drop("__due", "head"), batch_id)
        sink.write(marked.where(~F.col("__due")).drop("__due", "head"), batch_id, "waiting")

    run_available(stream, sink, each)


HEADER = T.StructType(
    [
        T.StructField("network_id", T.StringType()), T.StructField("block_number", T.LongType()),
        T.StructField("block_hash", T.StringType()), T.StructField("parent_hash", T.StringType()),
    ]
)


def publish_in_order(stream: DataFrame, sink: Sink, anchors: DataFrame) -> None:
    """Publish the headers that a line of parents joins to their network's anchor.

    ``anchors``: network_id, block_number, block_hash; an anchor is published
    with its first descendants.  Headers may come in any order and repeatedly; whatever is not
    attached yet waits in the stored headers.  A batch reads the stored headers
    from the lowest published tip on, links them by (height - 1, parent hash)
    and finds each one's root in a logarithmic number of joins.
    """
    keys = ["network_id", "block_number", "block_hash"]

    def name(height: Column, block: str) -> Column:
        return F.concat_ws("|", "network_id", height.cast("string"), F.col(block))

    def each(batch: DataFrame, batch_id: int) -> None:
        sink.write(batch.select(*HEADER.fieldNames()), batch_id, "headers")
        out = sink.read(HEADER).where(F.col("batch") < batch_id)
        tips = out.groupBy("network_id").agg(F.max_by(F.struct("block_number", "block_hash"), "block_number").alias("tip"))
        start = anchors.join(tips, "network_id", "left").select("network_id", F.col("block_number").alias("anchor"), F.coalesce("tip.block_number", "block_number").alias("from"))
        start = materialise(start, "tips")
        low = start.agg(F.min("from")).first()[0]  # one number, so that the range reaches the scan
        if low is None:
            return
        stored = sink.read(HEADER, "headers").where((F.col("block_number") >= low) & (F.col("batch") <= batch_id)).drop("batch").distinct()
        # a row per network; heights below its anchor never count
        live = materialise(stored.join(start, "network_id").where(F.col("block_number") >= F.col("anchor")), "headers")
        nodes = live.select(name(F.col("block_number"), "block_hash").alias("node"), "network_id", "block_number", "block_hash", "parent_hash")
        own = nodes.where("parent_hash IS NOT NULL").select(F.col("node").alias("child"), name(F.col("block_number") - 1, "parent_hash").alias("parent"))
        links = own.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").dropDuplicates(["child"])
        placed = places(nodes, materialise(links, "links"))
        published = out.select(name(F.col("block_number"), "block_hash").alias("node"))
        roots = anchors.select(name(F.col("block_number"), "block_hash").alias("root")).unionByName(published.select(F.col("node").alias("root"))).distinct()
        new = placed.join(roots, "root", "left_semi").join(published, "node", "left_anti")
        sink.write(nodes.join(new.select("node"), "node", "left_semi").select(*HEADER.fieldNames()).dropDuplicates(keys), batch_id)

    run_available(stream, sink, each)


def dedupe_blocks(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a complete block; a newer revision of the same hash passes."""
    timed = stream.withColumn("block_time", F.timestamp_millis("block_timestamp_unix_ms")).withWatermark("block_time", delay)
    return timed.dropDuplicatesWithinWatermark(["network_id", "block_number", "block_hash", "revision"])


def late_coverage(stored: DataFrame) -> DataFrame:
    """Blocks at read time: the newest revision, never with less coverage than before.

    Late trace rows arrive as higher revisions of the same hash.
    """
    keys = ["network_id", "block_number", "block_hash"]
    best = stored.groupBy(*keys).agg(
        F.max("receipt_coverage").alias("receipt_coverage"), F.max("trace_coverage").alias("trace_coverage"),
        F.max("revision").alias("revision"),
    )
    return best


# activity ----------------------------------------------------------------------


def stream_daily(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Per wallet and day: events and exact value."""
    timed = events.withWatermark("at", delay)
    return timed.groupBy("wallet", F.window("at", "1 day").alias("w")).agg(
        F.count("*").alias("events"), F.sum("cents").alias("cents")
    ).select("wallet", (F.unix_millis(F.col("w.start"))).alias("day_unix_ms"), "events", "cents")


def stream_bursts(events: DataFrame, delay: str = "1 hour", window: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Events per wallet in a sliding window."""
    return events.withWatermark("at", delay).groupBy("wallet", F.window("at", window, slide).alias("w")).agg(
        F.count("*").alias("events")
    ).select("wallet", F.unix_millis(F.col("w.start")).alias("window_start_ms"), "events")


def stream_forwarding(received: DataFrame, sent: DataFrame, seconds: int, tolerance: float = 0.1, delay: str = "1 hour") -> DataFrame:
    """Receipts joined to later payments of a similar amount within ``seconds``.

    Both sides: wallet, asset_id, tx_hash, at, cents.  Watermarks bound the
    state to the time range.
    """
    a = received.select("wallet", "asset_id", F.col("tx_hash").alias("incoming_tx"), F.col("at").alias("received_at"),
                        F.col("cents").alias("received_cents")).withWatermark("received_at", delay)
    b = sent.select(F.col("wallet").alias("w2"), F.col("asset_id").alias("a2"), F.col("tx_hash").alias("outgoing_tx"),
                    F.col("at").alias("sent_at"), F.col("cents").alias("sent_cents")).withWatermark("sent_at", delay)
    on = (
        (F.col("wallet") == F.col("w2")) & (F.col("asset_id") == F.col("a2"))
        & (F.col("sent_at") > F.col("received_at"))
        & (F.col("sent_at") <= F.col("received_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
        & (F.abs(F.col("sent_cents") - F.col("received_cents")) <= F.col("received_cents") * tolerance)
        & (F.col("incoming_tx") != F.col("outgoing_tx"))
    )
    return a.join(b, on).select("wallet", "asset_id", "incoming_tx", "outgoing_tx", "received_cents", "sent_cents")


def stream_sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of activity separated by silence, with the mean gap inside each."""
    per = events.withWatermark("at", delay).groupBy("wallet", F.session_window("at", gap).alias("s")).agg(
        F.count("*").alias("events"), F.min("at").alias("t0"), F.max("at").alias("t1")
    )
    spread = (F.unix_millis("t1") - F.unix_millis("t0")) / 1000.0
    return per.select(
        "wallet", F.unix_millis("t0").alias("first_ms"), F.unix_millis("t1").alias("last_ms"), "events",
        F.when(F.col("events") > 1, spread / (F.col("events") - 1)).otherwise(0.0).alias("avg_gap_seconds"),
    )


# watches -----------------------------------------------------------------------

ALERT = "watch_id string, created_at_ms long, score double"


def stream_alerts(checks: DataFrame) -> DataFrame:
    """One alert when a watch turns to matched; state is one flag per watch.

    ``checks``: watch_id, checked_at, status, score.  Rows of a batch are taken
    in the order of ``checked_at``; unknown checks change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        is_open = bool(held.get[0]) if held.exists else False
        out = []
        rows = [r for pdf in batches for r in pdf.itertuples(index=False) if r.status in ("matched", "no_match")]
        for r in sorted(rows, key=lambda r: (r.checked_at, r.status)):
            if r.status == "matched" and not is_open:
                out.append((key[0], int(r.checked_at), float(r.score)))
            is_open = r.status == "matched"
        held.update((is_open,))
        yield pd.DataFrame(out, columns=["watch_id", "created_at_ms", "score"])

    rows = checks.select("watch_id", "checked_at", "status", "score")
    found = rows.groupBy("watch_id").applyInPandasWithState(step, ALERT, "is_open boolean", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("severity", severity(F.col("score")))


# jobs driven by batches -----------------------------------------------------------


CURSOR = T.StructType(
    [T.StructField("epoch", T.LongType()), T.StructField("block_number", T.LongType()), T.StructField("block_hash", T.StringType())]
)


class ClusterState:
    """Facts in buckets of their group, a cursor, and the newest result of every group, under one sink.

    Facts are only added, to a table of partitions ``epoch``, ``batch`` and
    ``bucket`` in buckets of the group: ``facts/epoch=../batch=../bucket=..``.
    A batch reads the buckets its groups fall into, and of these the batches
    before its own; it is dealt by group once and meets stored facts, older rows
    of its groups and their results where they lie, so none of these is
    shuffled.  All rows of a group are in one bucket.  The cursor names the
    highest block seen and its hash; an epoch ends when that block was replaced.

    A state is opened with the number of buckets it was made with, by default
    the session's shuffle partitions.
    """

    def __init__(self, sink: Sink, schema: T.StructType, key: Sequence[str], discover: Callable[[DataFrame], DataFrame], buckets: int | None = None):
        self.sink, self.schema, self.key, self.discover = sink, schema, list(key), discover
        self.buckets = buckets or int(sink.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"facts_{uuid.uuid5(uuid.NAMESPACE_URL, sink.base).hex}"
        if not sink.spark.catalog.tableExists(self.table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            keys = ", ".join(f"`{c}`" for c in self.key)
            sink.spark.sql(
                f"CREATE TABLE {self.table} ({columns}, epoch BIGINT, batch BIGINT, bucket INT) USING parquet PARTITIONED BY (epoch, batch, bucket) "
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{sink.base}/facts'"
            )
            try:
                sink.spark.read.schema(schema).parquet(f"{sink.base}/facts")
            except Exception as error:  # nothing written yet
                if "PATH_NOT_FOUND" not in str(error):
                    raise
            else:
                sink.spark.catalog.recoverPartitions(self.table)

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Rows with the bucket that Spark writes their group to."""
        return rows.withColumn("bucket", F.pmod(F.hash(*self.key), F.lit(self.buckets)))

    def facts(self, epoch: int, before: int, touched: Sequence[int] | None = None) -> DataFrame:
        """Stored facts of an epoch from batches before ``before``; the bounds reach the scan as partition filters."""
        self.sink.spark.catalog.refreshTable(self.table)
        rows = self.sink.spark.table(self.table).where((F.col("epoch") == epoch) & (F.col("batch") < before))
        return rows if touched is None else rows.where(F.col("bucket").isin(*touched))

    def cursor(self, before: int) -> tuple[int, int, str] | None:
        rows = self.sink.read(CURSOR, "cursor").where(F.col("batch") < before)
        last = rows.orderBy(F.desc("batch")).first()
        return None if last is None else (last.epoch, last.block_number, last.block_hash)

    def _store(self, rows: DataFrame, stored: DataFrame, epoch: int, batch_id: int) -> None:
        """Write the rows, dealt by group, whose id is not stored yet, each once."""
        content = F.struct(*[c for c in rows.columns if c not in (*self.key, "relationship_id")]).alias("content")
        new = rows.select(*self.key, "relationship_id", content)
        held = stored.select(*self.key, "relationship_id", F.lit(None).cast(new.schema["content"].dataType).alias("content"))
        kept = new.unionByName(held).groupBy(*self.key, "relationship_id").agg(
            F.count_if(F.col("content").isNull()).alias("held"), F.first("content", ignorenulls=True).alias("content")
        ).where(F.col("held") == 0)
        if not self.facts(epoch, batch_id + 1).where(F.col("batch") == batch_id).isEmpty():  # left by an attempt that failed
            nothing = self.sink.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
            nothing.sparkSession.sql(f"INSERT OVERWRITE {self.table} PARTITION (epoch = {epoch}, batch = {batch_id}, bucket) SELECT * FROM {{rows}}", rows=nothing)
        placed = self._spread(kept.select(*self.key, "relationship_id", "content.*")).select(
            *self.schema.names, F.lit(epoch).cast("long").alias("epoch"), F.lit(batch_id).cast("long").alias("batch"), "bucket"
        )
        placed.write.insertInto(self.table)

    def _results(self, rows: DataFrame, groups: DataFrame, epoch: int, batch_id: int) -> None:
        """The result of each group, null where the rule no longer holds."""
        found = self.discover(rows.drop("epoch", "batch", "bucket"))
        kept = groups.join(found.withColumn("holds", F.lit(1)), self.key, "left")
        self.sink.write(kept.withColumn("epoch", F.lit(epoch).cast("long")), batch_id)

    def add(self, batch: DataFrame, batch_id: int, canonical: DataFrame) -> None:
        """Take up a batch; ``canonical`` (block_number, block_hash) are the blocks that stand at this time."""
        at = self.cursor(batch_id)
        epoch = at[0] if at else 0
        placed = self._spread(batch)
        # one number per bucket
        touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())
        if not touched:
            return
        block = ["block_number", "block_hash"]
        fresh = placed.dropna(subset=block).select(*self.schema.names)
        anchor_gone = at is not None and canonical.where((F.col("block_number") == at[1]) & (F.col("block_hash") == at[2])).isEmpty()
        old = None
        seen = fresh.select(*block)
        if anchor_gone:  # the facts that still stand, and the batch, begin a new epoch
            old = self.facts(epoch, batch_id).select(*self.schema.names)
            seen = seen.unionByName(old.select(*block))
            epoch += 1
            touched = list(range(self.buckets))
        # blocks that don't stand are fewer than rows, and their join is planned from their real size
        fallen = materialise(seen.distinct().join(canonical, block, "left_anti"), "fallen")
        fresh = fresh.join(fallen, block, "left_anti").repartition(self.buckets, *self.key)
        if old is not None:
            fresh = fresh.unionByName(old.join(fallen, block, "left_anti").select(*fresh.columns))
        self._store(fresh, self.facts(epoch, batch_id, touched), epoch, batch_id)
        now = self.facts(epoch, batch_id + 1, touched)
        added = now.where(F.col("batch") == batch_id)
        top = added.agg(F.max(F.struct("block_number", "block_hash")).alias("m")).first().m
        if top is None:  # nothing new: results and cursor stay
            return
        groups = added.select(*self.key).distinct()
        self._results(now.join(groups, self.key, "left_semi"), groups, epoch, batch_id)
        if at is not None and not anchor_gone and (top.block_number, top.block_hash) < at[1:]:
            top = Row(block_number=at[1], block_hash=at[2])
        self.sink.write(self.sink.spark.createDataFrame([(epoch, top.block_number, top.block_hash)], CURSOR), batch_id, "cursor")

    def read(self) -> DataFrame:
        """The groups that the rule holds for, from the newest epoch and batch of each."""
        empty = self.discover(self.sink.spark.createDataFrame([], self.schema)).schema
        fields = {f.name: f for f in empty.fields}
        schema = T.StructType([*(fields[k] for k in self.key), *(f for n, f in fields.items() if n not in self.key), T.StructField("holds", T.IntegerType()), T.StructField("epoch", T.LongType())])
        rows = self.sink.read(schema)
        newest = rows.agg(F.max("epoch").alias("epoch"))
        current = latest(rows.join(F.broadcast(newest), "epoch"), self.key, "batch")  # one row
        return current.where(F.col("holds") == 1).drop("holds", "epoch", "batch")


def stream_clusters(edges: DataFrame, state: ClusterState, canonical: DataFrame) -> None:
    """Keep the results of a rule over groups of edges as they arrive, late and repeated rows included.

    Only groups with new edges are computed again, from the buckets that hold
    them.  When the block under the cursor was replaced, the edges of blocks
    that still stand are taken up anew.
    """
    run_available(edges, state.sink, lambda batch, batch_id: state.add(batch, batch_id, canonical))


FAILURE_KEYS = ["network_id", "failure_id"]
FAILURE_STATE = T.StructType(
    [
        T.StructField("network_id", T.StringType()), T.StructField("failure_id", T.StringType()),
        T.StructField("block_number", T.LongType()), T.StructField("attempts", T.LongType()),
        T.StructField("status", T.StringType()), T.StructField("next_attempt_unix_ms", T.LongType()),
    ]
)


def stream_failures(attempts: DataFrame, sink: Sink, max_attempts: int = 5, base_ms: int = 60_000) -> None:
    """Keep the retry status of failed blocks from a stream of attempts.

    ``attempts``: network_id, failure_id, block_number, outcome (failed or
    published), at_ms.  Status rows are appended per batch and read by newest
    batch: retry with a doubling delay, dead_letter at the limit, resolved once
    the block was published, whatever arrives later.
    """
    out = FAILURE_STATE
    if max_attempts > 32:
        raise ValueError("the doubling delay is made for 32 attempts at most")

    def each(batch: DataFrame, batch_id: int) -> None:
        before = latest(sink.read(out).where(F.col("batch") < batch_id), FAILURE_KEYS, "batch")
        now = batch.groupBy(*FAILURE_KEYS).agg(
            F.max("block_number").alias("__block"), F.count_if(F.col("outcome") == "failed").alias("__failed"),
            F.max("at_ms").alias("__at"), F.max((F.col("outcome") == "published").cast("int")).alias("__done"),
        )
        held = before.select(*FAILURE_KEYS, F.col("attempts").alias("__before"), (F.col("status") == "resolved").alias("__settled"))
        rows = now.join(held, FAILURE_KEYS, "left")
        total = F.coalesce("__before", F.lit(0)) + F.col("__failed")
        done = (F.col("__done") == 1) | F.coalesce("__settled", F.lit(False))
        status = F.when(done, "resolved").when(total >= max_attempts, "dead_letter").otherwise("retry")
        wait = F.lit(base_ms) * F.pow(F.lit(2.0), F.least(total, F.lit(max_attempts)) - 1)
        sink.write(
            rows.select(
                *FAILURE_KEYS, F.col("__block").cast("bigint").alias("block_number"), total.cast("bigint").alias("attempts"),
                status.alias("status"),
                F.when(status == "retry", (F.col("__at") + wait).cast("bigint")).alias("next_attempt_unix_ms"),
            ),
            batch_id,
        )

    run_available(attempts, sink, each)


def failure_states(sink: Sink) -> DataFrame:
    """The current status of every failure."""
    return latest(sink.read(FAILURE_STATE), FAILURE_KEYS, "batch").drop("batch")


"""Mixing sources to target weights: entropy balancing, solved in its dual, rounded to copies.

Each source gets a target number of words. Among all document rates between 0 and ``CAP`` that
meet the targets, entropy balancing takes those nearest to 1 in relative entropy:
rate = min(CAP, exp(lambda * size / mean size)) with one dual variable for each source. The dual
is convex; Newton's method solves it, with a bracket that falls back to halving. A rate depends
on (source, size) only, so documents are first counted by these two and each step is one
small aggregate. Rates become copies by systematic rounding in the order of sizes, and what
the largest documents leave over is made up by smaller ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.session import materialise

#: Share of all words that the mix takes, and the most that a source or document may repeat.
SHARE, CAP = 1.5, 2
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Slices of documents of one source and size, so that copies of one text are ranked apart.
SLICES = 1024
STEPS, PRECISION = 200, 1e-9


def words_of(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A join key for a source that may be null; it sorts like the source, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame) -> DataFrame:
    """``skey``, ``source_size`` with ``target`` words, by weight and filled up to ``CAP`` times the size.

    ``sources`` has a row for each source, not for each document. Ranks come from one sort by
    ranges, and filling is a few sums: with a water level v a source gets min(CAP * size, v * weight).
    """
    placed = materialise(sources.orderBy("skey").withColumn("at", F.monotonically_increasing_id()), "sources")
    spark = placed.sparkSession
    part = F.shiftright("at", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # one row for each partition
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before))
        before += counts[p]
    offsets = spark.createDataFrame(rows, "part long, before long") if rows else spark.createDataFrame([], "part long, before long")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) % len(WEIGHTS) + 1).cast("int"))
    ranked = placed.withColumn("part", part).join(offsets, "part").select("skey", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * CAP
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:  # each round fills at least one more source
        full = cap <= level * F.col("weight")
        filled, open_ = ranked.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (SHARE * total - (filled or 0)) / open_ if open_ else math.inf
        if not new > level:
            break
        level = new
    return ranked.select("skey", "source_size", F.least(cap.cast("double"), F.lit(max(level, 0.0)) * F.col("weight")).alias("target"))


def rates(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """``sizes`` (``skey``, ``size``, ``n``) with ``target`` and the ``rate`` of a document of that size."""
    mean = sizes.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = materialise(
        aims.join(mean, "skey").where("source_size > 0").select(
            "skey", "target", "mean", F.lit(0.0).alias("dual"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"),
            (F.col("target") >= F.col("source_size") * CAP * (1 - PRECISION)).alias("done"),
        ),
        "dual",
    )
    x = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("dual") * x, F.lit(math.log(CAP))))
    steps = 0
    while not state.where("NOT done").isEmpty():
        if steps == STEPS:
            raise RuntimeError(f"sources without a solution after {STEPS} steps")
        steps += 1
        moved = sizes.join(state.where("NOT done"), "skey").groupBy("skey").agg(
            F.sum(tilt * F.col("size") * F.col("n")).alias("got"),
            F.sum(F.when(tilt < CAP, tilt * x * F.col("size") * F.col("n")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - gap / F.col("slope")
        halved = F.when(F.col("high") == math.inf, F.col("low") * 2 + 1).when(F.col("low") == -math.inf, F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        stepped = state.join(moved, "skey", "left").withColumns({"low": low, "high": high})
        state = materialise(
            stepped.select(
                "skey", "target", "mean",
                F.when(F.col("done") | (F.abs(gap) <= PRECISION * F.col("target")), F.col("dual"))
                .when((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(halved).alias("dual"),
                "low", "high",
                (F.col("done") | (F.abs(gap) <= PRECISION * F.col("target")) | (F.col("high") - F.col("low") < 1e-14 * F.greatest(F.lit(1.0), F.abs("dual")))).alias("done"),
            ),
            "dual",
        )
    full = F.col("source_size") * CAP * (1 - PRECISION) <= F.col("target")
    solved = aims.join(state.select("skey", "mean", "dual"), "skey")
    return sizes.join(solved, "skey").select("skey", "size", "n", "source_size", "target", F.when(full, F.lit(float(CAP))).otherwise(tilt).alias("rate"))


def _rounded(rated: DataFrame) -> DataFrame:
    """``rated`` with ``few`` copies for each document and one more for ``more`` of the ``n`` documents.

    A window runs over the sizes of one source, so its rows are bounded by the longest text.
    """
    down = Window.partitionBy("skey").orderBy(F.col("size").desc())
    upto = F.sum(F.col("rate") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    out = rated.withColumn("upto", upto)
    out = out.withColumn("copies", F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("rate") * F.col("n") + 0.5))
    out = out.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), F.col("n") * CAP))
    while True:  # each pass brings some source nearer to its target, from the same side
        taken = F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("skey"))
        out = out.withColumn("over", taken - F.round("target"))
        free = F.when(F.col("over") > 0, F.col("copies")).otherwise(F.col("n") * CAP - F.col("copies"))
        out = out.withColumn("free", F.when(F.col("size").between(F.lit(1), F.abs("over")), free).otherwise(0))
        before = F.coalesce(F.sum(F.col("free") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("before", before)
        flips = F.least(F.col("free"), F.greatest(F.floor((F.abs("over") - F.col("before")) / F.greatest("size", F.lit(1))), F.lit(0)))
        out = out.withColumn("flips", flips).withColumn("copies", F.col("copies") - F.signum("over") * F.col("flips"))
        out = materialise(out, "rounded")
        if out.where("flips > 0").isEmpty():
            break
    few = F.floor(F.col("copies") / F.col("n")).cast("long")
    return out.select("skey", "size", "source_size", "target", few.alias("few"), (F.col("copies") - few * F.col("n")).cast("long").alias("more"))


def mixed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__mix__`` (size, source_size, target, copies) for each row.

    A null text has size 0 and the null source is the last one. Rows that repeat a document are
    rows of their own. Among documents of one source and size the hash of the id, then the id and
    the text, decide who is taken once more, so reruns agree. A document without words or a
    source without words has no influence and its words taken are 0.
    """
    spread = F.xxhash64(F.col("doc_id"), F.xxhash64("text"))
    rows = documents.withColumn("__mix__", F.struct(_key(F.col("source")).alias("skey"), words_of(F.col("text")).alias("size"), spread.alias("spread"), F.pmod(spread, F.lit(SLICES)).alias("slice")))
    counts = materialise(rows.select("__mix__.skey", "__mix__.size", "__mix__.slice").groupBy("skey", "size", "slice").agg(F.count("*").alias("n")), "sizes")
    sizes = materialise(counts.groupBy("skey", "size").agg(F.sum("n").alias("n")), "sizes")
    aims = materialise(targets(sizes.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    plan = materialise(_rounded(rates(sizes.where("size > 0"), aims)), "plan")
    ahead = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = (
        counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(aims, "skey").join(plan.select("skey", "size", "few", "more"), ["skey", "size"], "left")
        .select(
            F.col("skey").alias("__skey__"), F.col("size").alias("__size__"), F.col("slice").alias("__slice__"),
            F.struct("ahead", "source_size", "target", F.coalesce("few", F.lit(0)).alias("few"), F.coalesce("more", F.lit(0)).alias("more")).alias("__plan__"),
        )
    )
    rows = rows.withColumns({"__skey__": F.col("__mix__.skey"), "__size__": F.col("__mix__.size"), "__slice__": F.col("__mix__.slice")})
    own = ["__skey__", "__size__", "__slice__"]
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.col("__mix__.spread"), "doc_id", "text"))
    ranked = rows.withColumn("__rank__", rank).join(slices, own)
    copies = F.col("__plan__.few") + (F.col("__plan__.ahead") + F.col("__rank__") <= F.col("__plan__.more")).cast("long")
    return ranked.withColumn(
        "__mix__", F.struct(F.col("__size__").alias("size"), F.col("__plan__.source_size").alias("source_size"), F.col("__plan__.target").alias("target"), copies.alias("copies"))
    ).drop(*own, "__rank__", "__plan__")


def taken(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) for each row."""
    narrow = mixed(documents.select("doc_id", "text", "source"))
    return narrow.select("doc_id", "__mix__.size", "__mix__.source_size", "__mix__.target", (F.col("__mix__.copies") * F.col("__mix__.size")).alias("taken"))


def repeated(documents: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    rows = mixed(documents).where("__mix__.copies > 0")
    return rows.withColumn("__copy__", F.explode(F.sequence(F.lit(1), F.col("__mix__.copies").cast("int")))).drop("__mix__", "__copy__")

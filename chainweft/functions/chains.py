"""Places in chains of links, in a logarithmic number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.session import materialise


def places(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``root`` and ``place`` (steps from the root) of every node.

    ``nodes``: node.  ``links``: child, parent; a child has one parent, and
    links make no circle.  Every round doubles how far a node has looked up, so
    a chain of a million links takes twenty joins; a node that has arrived
    takes part as a target only.
    """
    start = nodes.select("node").distinct().join(
        links.select(F.col("child").alias("node"), F.col("parent").alias("up")), "node", "left"
    )
    jumps = materialise(
        start.select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("long").alias("steps")), "jumps"
    )
    while True:
        # what a target itself still has to climb
        climbing = jumps.where(F.col("steps") > 0).select(F.col("node").alias("t"), F.col("up").alias("further"), F.col("steps").alias("more"))
        moved = jumps.join(climbing, F.col("up") == F.col("t"), "left")
        jumps = materialise(
            moved.select("node", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                         F.col("t").isNotNull().alias("moved")),
            "jumps",
        )
        done = jumps.where("moved").isEmpty()
        jumps = jumps.drop("moved")
        if done:
            return jumps.select("node", F.col("up").alias("root"), F.col("steps").alias("place"))

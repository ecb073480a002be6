"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a shuffle join of the edges with the least neighbour of each node; a step's edges are written to the
shared folder and the step before is deleted.  No edge, node or label is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, spread_join, stored

#: Edges of one node that a task may hold.
HUB_ROWS = 262_144


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (or its smaller ones and itself) to the least of its neighbourhood."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = spread_join(near, least, "u", F.col("v"), HUB_ROWS)  # a hub may have a third of all edges
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; the root is the component's smallest node.

    Defined cases: loops and repeated or reversed edges change nothing; an empty table gives an empty result.
    """
    now = stored(edges.select("a", "b").where("a != b").distinct(), label, narrow=True)
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    state = None
    while True:
        step = stored(_star(now, large=True), label, narrow=True)
        after = stored(_star(step, large=False), label, narrow=True)
        seen = tuple(after.agg(F.count(F.lit(1)), mark).first())
        dropped(step)
        dropped(now)
        now = after
        if seen == state or not seen[0]:
            break
        state = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

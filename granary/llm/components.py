"""Connected components of a graph held as a DataFrame, by alternating large and small stars.

Each round is two group-by-minimum-and-join steps over the edges; the edges of each round are written to the shared
folder, nothing of them comes to the driver but their number and a checksum.  A hub's edges are joined on the hub by
an ordinary join, which adaptive execution splits when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import dropped, stored

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with b < a. Large star: each node's greater neighbours are tied to the least of its neighbours and
    itself. Small star: each node and its lesser neighbours are tied to the least of them."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = tied.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns, each row links two nodes. Returns (node, root) for every node that isn't the least of
    its component, root being the least. Null ends and loops are ignored; an empty table gives no rows."""
    a, b = edges.columns
    now = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct(), "edges")
    before = _state(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        after = stored(_star(_star(now, True), False), "edges")
        dropped(now)
        now, state = after, _state(after)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")

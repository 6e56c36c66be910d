"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): after O(log^2 n) rounds every node points at the smallest node that it can reach.
Each step is a grouped minimum, which combines on the map side, and a join with that minimum, which
is written first so that the planner can split a hot node's rows or broadcast the small side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import materialize


#: Edges that one partition holds, and from how many on a step's minima are written before their join.
EDGES, MANY = 200_000, 1_000_000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges(a, b), a > b, n of them at most.  Large star: link every larger neighbour of a node to the
    node's minimum.  Small star: link every smaller neighbour, and the node itself, to the minimum."""
    keep = (lambda df: materialize(df, "star")) if n > MANY else (lambda df: df)
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = keep(edges.groupBy("a").agg(F.min("b").alias("m")))
        moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(low.select("a", F.col("m").alias("b")))
    return materialize(out.where("a <> b").distinct(), "edges", n, EDGES)


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no edge leads on: a forest of stars."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node long, component long) for every node of an edge that is not the smallest of its
    component; nodes that are missing here are their own component.

    Null ends and loops are ignored; repeated and reversed edges count once; an empty table gives an
    empty one.
    """
    a, b = F.col(left), F.col(right)
    e = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    e = materialize(e, "edges", edges.count(), EDGES)
    n = e.count()  # a step never adds edges
    while not _done(e):
        e = _star(_star(e, True, n), False, n)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))

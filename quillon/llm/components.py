"""Connected components of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import discard, kept, written

__all__ = ["components", "discard", "kept", "written"]

#: Edges that a task of the rounds below takes.
TASK_EDGES = 250_000


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``links`` (a, b; both long).

    Alternating stars: each node's larger neighbours, then its smaller ones, are tied to the least
    of them, until every component is a star around its smallest node.  The number of rounds
    grows with the logarithm of a component's diameter.  Rows of a node are never gathered: its
    minimum is aggregated and joined back.  Null ends and loops are left out.

    The minima are joined by ``u ^ 0``, the same number under another name: so both sides of the join
    are dealt for it alone, and adaptive execution can split the rows of a star's centre.
    """
    same = F.expr("u ^ 0L").alias("w")
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a") == F.col("b")).alias("loop"), "a", "b").where("a is not null and b is not null and not loop").select("u", "v").distinct())
    now, before = _sum(edges), None
    while now != before:
        tasks = 1 + now[0] // TASK_EDGES

        def dealt(df, tasks=tasks):
            """Tasks by the number of edges: late rounds have few."""
            return df.coalesce(tasks)

        edges = dealt(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = dealt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least.select(same, "m"), F.col("u") == F.col("w")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's tie to its own minimum is kept when that is smaller than the node
        large = dealt(dealt(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))).distinct())
        down = dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down.select(same, "m"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(dealt(dealt(small.unionByName(down.select("u", F.col("m").alias("v")))).distinct()))
        before, now = now, _sum(edges)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components by alternating large and small stars, as joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.plans.workspace import Workspace


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(ws: Workspace, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the smallest node.

    A large star links each larger neighbour of a node to the smallest node around it, a small
    star the smaller neighbours and the node itself. Both keep the components, and the edges
    turn into stars in a number of rounds that grows with the logarithm of the size. Every step
    is a minimum by key (combined before the exchange) and a join of the edges to those minima. The
    minima are written first: a join to an aggregate of the same key would share its exchange, and
    adaptive execution does not split such a join, while the edges of a hub are split against a
    scan, or the minima are broadcast if they are small. Rounds are written, so a lost executor costs
    one round; an edge goes to at most one other, so tables never grow.
    """
    edges = ws.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")),
        "edges_0",
    )
    last = None
    for r in range(1, max_rounds + 1):
        ring = _both(edges)
        least = ws.write(ring.groupBy("a").agg(F.min("b").alias("m")), f"least_ring_{r}")
        large = (
            ring.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .distinct()
        )
        large = ws.write(large, f"large_{r}")
        least = ws.write(large.groupBy("a").agg(F.min("b").alias("m")), f"least_large_{r}")
        joined = large.join(least, "a")
        small = (
            joined.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges, seen = ws.measured(
            small, f"edges_{r}", total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        )
        now = (seen["rows"], seen["total"])
        ws.drop(f"edges_{r - 1}")
        for stage in (f"large_{r}", f"least_ring_{r}", f"least_large_{r}"):
            ws.drop(stage)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def least_neighbour(edges: DataFrame, n: int, hub: int = 100_000, most: int = 1000) -> DataFrame:
    """``edges`` (u, v) with m, the smallest v of their u.

    A node with more than ``hub`` edges (or the ``most``-th part of all ``n``, if that is more) gets its m by broadcast, so its
    edges stay where they are; there are at most ``most`` such nodes.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    limit = max(hub, n // most)
    if n <= limit:
        return edges.join(low.drop("d"), "u")
    hubs = edges.join(F.broadcast(low.where(F.col("d") > limit).select("u", F.col("m").alias("hub"))), "u", "left")
    rest = hubs.where("hub IS NULL").drop("hub").join(low.where(F.col("d") <= limit).drop("d"), "u")
    return rest.unionByName(hubs.where("hub IS NOT NULL").withColumnRenamed("hub", "m"))


def connected_components(edges: DataFrame, rounds: int = 60, hub: int = 100_000) -> DataFrame:
    """(node, root) for each node of ``edges`` (src, dst); root is the component's smallest node.

    Each round is two aggregations with map-side combine and two joins; a node with very many neighbours is joined by broadcast
    (``least_neighbour``), so its edges are never gathered into one task. Edges are written to the
    shared folder, so a lost executor costs at most one round. Loops and repeated edges are
    harmless; no edges give no rows.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = saved(e, "edges")
    n = e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_neighbour(both, 2 * n, hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = saved(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least_neighbour(large, n, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # stars: every node has one parent, and no parent has one of its own
        got = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        n = got.n
        if got.n == got.d and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")

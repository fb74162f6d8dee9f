"""Connected components of links in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours move to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """u, v of each node that is not the smallest of its component, with that smallest node.

    `links` has two columns of one ordered type; links from a node to itself and null ends
    don't count. Large-star and small-star rounds alternate until nothing moves, in about
    log(n) rounds; each ends in a checkpoint. Minima combine before the shuffle, and the
    joins are plain ones that Spark can split at a hot node.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges, before = checkpoint(edges), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        edges = checkpoint(_small_star(_large_star(edges)))

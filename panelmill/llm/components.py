"""Connected components of a table of links by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored


def _mins(edges: DataFrame) -> DataFrame:
    """Smallest neighbour and degree of each node; combined map-side."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_deg"))


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): the smallest id that a node can reach.

    Each round replaces links by links to smaller nodes, and the number of rounds grows with the
    logarithm of the longest chain. A node with very many links is joined by broadcast
    (their number is bounded, see ``hot_join``), so no task holds its links.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, mark = stored(ordered.distinct(), "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * edges.count()
        if total == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        low = _mins(both).select("u", F.least("u", "m").alias("m"), "_deg")
        large = hot_join(both, low, ["u"], "_deg", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        total = large.count()
        small = hot_join(large, _mins(large), ["u"], "_deg", total).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.*").where("u <> v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now

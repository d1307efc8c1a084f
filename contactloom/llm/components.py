"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.shared import cut


#: Tables of links are dealt out in parts of about so many rows, at least so many parts: a round has some ten
#: shuffles, which would otherwise leave files of every configured partition, most of them next to empty.
ROWS, LEAST = 50_000, 12


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)"))).first()


def _large(edges: DataFrame, parts: int) -> DataFrame:
    """Links each neighbour above a node to the smallest node around."""
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    low = both.groupBy("node").agg(F.min("other").alias("low"))
    met = both.join(low, "node").filter("other > node")
    linked = met.select(F.col("other").alias("node"), F.least("low", F.col("node")).alias("other"))
    return linked.coalesce(parts).distinct().coalesce(parts)


def _small(edges: DataFrame, parts: int) -> DataFrame:
    """Links a node and its neighbours below to the smallest of them."""
    low = edges.groupBy("node").agg(F.min("other").alias("low"))
    met = edges.join(low, "node").filter("other != low").select(F.col("other").alias("node"), F.col("low").alias("other"))
    return met.unionByName(low.select("node", F.col("low").alias("other"))).coalesce(parts).distinct().coalesce(parts)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``node, other`` links; the component is its smallest node.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the
    number of nodes. Loops and repeated links are allowed.
    """
    down = links.filter("node != other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    edges, before = cut(down.distinct()), None
    while (now := _state(edges)) != before:
        before, parts = now, max(LEAST, -(-now[0] // ROWS))
        edges = cut(_small(_large(edges.coalesce(parts), parts), parts))
    roots = edges.select(F.col("other").alias("node")).distinct()
    return edges.select("node", F.col("other").alias("component")).unionByName(roots.withColumn("component", F.col("node")))

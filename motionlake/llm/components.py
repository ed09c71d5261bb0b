"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.session import settle


def _marks(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a bigint, b bigint)``.

    The component is its smallest node. Large-star and small-star rounds alternate until
    the edges are stars around the smallest nodes; a round is two aggregations and two
    joins whose aggregated side has one row per node, so a hub is split by adaptive skew
    handling. Every round is settled, and the driver sees only a count and a checksum.
    """
    edges = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _marks(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select("a", F.col("m").alias("b"))
        )
        edges = settle(linked.where("a <> b").distinct())
        last, mark = mark, _marks(edges)
        if last == mark:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))

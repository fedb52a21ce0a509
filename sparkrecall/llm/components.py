"""Connected components by alternating large and small stars: each round is two aggregations and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) of long nodes -> (node, root): root is the smallest node reachable; only nodes of edges with a <> b.

    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    The driver sees one count and one checksum a round.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least_of(e: DataFrame, own: F.Column) -> DataFrame:
        # a table of its own, so that the join has plain exchanges on either side and a hub can be split
        return keep(e.groupBy("a").agg(own.alias("m")), name + "-least")

    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    was = state(now)
    while was[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = least_of(both, F.least(F.min("b"), F.first("a")))
        large = keep(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name + "-large")
        least_large = least_of(large, F.min("b"))
        small = large.join(least_large, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new_now = keep(small.union(least_large.select("a", F.col("m").alias("b"))).distinct(), name)
        forget(now, least, large, least_large)
        now, new = new_now, state(new_now)
        if new == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

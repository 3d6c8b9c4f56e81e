"""Connected components of an edge table by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that ``edges`` (a, b) joins to another; label is the smallest node it can reach.

    Loops and edges with a null end are ignored; repeated edges count once; no edges, no rows. Each round hangs every neighbour of
    a node below the node's smallest neighbour, from both sides in turn, until the table is all stars. Per node only a minimum
    is gathered, so a hub of any size is pre-aggregated, and its joins are left to Spark to split. Every round is checkpointed, so
    a lost executor costs one round.
    """
    a, b = edges.columns[:2]
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    stars = cut_lineage(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = _state(stars)
    while seen[0]:
        both = stars.selectExpr("lo AS node", "hi AS other").unionAll(stars.selectExpr("hi AS node", "lo AS other"))
        lowest = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("low"))
        large = stars.join(lowest, F.col("lo") == F.col("node")).select("hi", F.col("low").alias("lo")).distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = large.join(roots.withColumnRenamed("hi", "node"), F.col("hi") == F.col("node")).where("lo <> low")
        small = roots.select("hi", F.col("low").alias("lo")).unionAll(moved.select(F.col("lo").alias("hi"), F.col("low").alias("lo")))
        stars = cut_lineage(small.distinct())
        now = _state(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )


def _state(stars: DataFrame) -> tuple:
    """Count and checksum of the distinct edges: equal when a round has changed nothing."""
    return tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())

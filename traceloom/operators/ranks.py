"""Ranks and draws that hold when one group is a third of the data.

``top_per`` cuts every group in the tasks that hold it before its rows meet, ``drawn_first`` finds the digest up to which rows are
drawn and filters by it without moving rows, ``row_ranks`` numbers a group over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import cut_lineage

SLICE_DIGITS = 4
BROADCAST_GROUPS = 100_000


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def seeded_hash(seed: int, *keys: str | Column) -> Column:
    """Order of a seeded draw: the same for the same keys on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]))


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group, the same way for every ``n``: first of each task's part of the group, then of what is left."""
    if not by:
        first = df.orderBy(*order).limit(n)
        return first.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    part = df.withColumn("_part", F.spark_partition_id())
    near = part.withColumn(rank, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col(rank) <= n)
    last = near.drop("_part", rank).withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return last.where(F.col(rank) <= n)


def draw_bounds(df: DataFrame, by: list[str], draw: Column, n: int) -> DataFrame:
    """Per group of more than ``n`` rows the digest of its ``n``-th row in the order of the hex digest ``draw`` (column ``_bound``).

    Only the group and the digest are read. Rows are counted by the first digits of the digest, and the bound is looked for in the
    one slice that holds it.
    """
    drawn = df.select(*by, draw.alias("_draw")).withColumn("_slice", F.left("_draw", F.lit(SLICE_DIGITS)))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counted = drawn.groupBy(*by, "_slice").agg(F.count("*").alias("_size"))
    upto = counted.withColumn("_upto", F.sum("_size").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)))
    holds = upto.where((F.col("_upto") >= n) & (F.col("_upto") - F.col("_size") < n)).select(
        *[F.col(k).alias(f"_of_{k}") for k in by], F.col("_slice").alias("_of_slice"), (F.col("_upto") - F.col("_size")).alias("_before")
    )
    match = F.col("_slice") == F.col("_of_slice")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = drawn.join(holds, match)
    placed = inside.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_draw")))
    return placed.where(F.col("_before") + F.col("_place") == n).select(*by, F.col("_draw").alias("_bound"))


def drawn_first(df: DataFrame, by: list[str], draw: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each group in the order of ``draw``, which must differ between rows; smaller groups stay whole.

    Over all rows the bound is a scalar subquery. Per group the bounds are joined: they are counted, and broadcast up to
    ``BROADCAST_GROUPS`` of them, so that the rows stay where they are; beyond that both sides are shuffled.
    """
    if n <= 0:
        return df.where(F.lit(False))
    bounds = draw_bounds(df, by, draw, n)
    if not by:
        return df.where(draw <= F.coalesce(bounds.select("_bound").scalar(), F.lit("g")))  # past every hex digit
    named = bounds.select(*[F.col(k).alias(f"_of_{k}") for k in by], "_bound")
    if named.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        named = F.broadcast(named)
    match = F.lit(True)
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return df.join(named, match, "left").where(F.col("_bound").isNull() | (draw <= F.col("_bound"))).select(*df.columns)


def row_ranks(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Number the rows of each group in ``order``, which must be total within the group.

    Rows are range-partitioned by group and order, so a large group spans several tasks. Each task numbers its own
    part; at most one group per task goes on from an earlier task, and only those need an offset.
    """
    n = partitions_of(df)
    spread = df.repartitionByRange(n, *[F.col(k) for k in by], *order).withColumn("_part", F.spark_partition_id())
    fixed = cut_lineage(spread)
    parts = fixed.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part")
    offsets = parts.withColumn(
        "_offset", F.sum("_size").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    ).where("_offset IS NOT NULL").drop("_size")
    match = F.col("_part") == F.col("_at")
    renamed = offsets.withColumnRenamed("_part", "_at")
    for k in by:
        renamed = renamed.withColumnRenamed(k, f"_by_{k}")
        match = match & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    local = fixed.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    # One group per task boundary at most, so this side never has more rows than there are tasks.
    joined = local.join(F.broadcast(renamed), match, "left")
    return joined.withColumn(rank, F.coalesce("_offset", F.lit(0)) + F.col("_local")).select(*df.columns, rank)

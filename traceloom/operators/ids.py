"""Set operations on ids and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_ids(*ids: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, ids).distinct()


def common_ids(*ids: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, ids)


def missing_ids(requested: DataFrame, present: DataFrame) -> DataFrame:
    key = requested.columns[0]
    return requested.join(present.select(F.col(present.columns[0]).alias(key)), key, "left_anti")


def unknown_values(requested: DataFrame, present: DataFrame) -> DataFrame:
    return requested.subtract(present)


def dedup_ordered(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Distinct ids with the order of their first appearance."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen"))


def requested_ids(df: DataFrame, key: str, order: Column, limit: int = -1) -> DataFrame:
    """Distinct non-blank ids in order of first appearance, at most ``limit`` of them."""
    firsts = dedup_ordered(df.where(F.trim(F.col(key)) != ""), key, order)
    return firsts.orderBy("first_seen", key).limit(limit) if limit >= 0 else firsts

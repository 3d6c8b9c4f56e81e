"""Values that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns so that each is computed once per row.

    A plain ``withColumn`` may be merged into the expressions that use it; inside an array function it would then
    be worked out again for every element. A one-row ``inline`` keeps it a value of its own, without a shuffle.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(packed)))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, for expressions inside array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

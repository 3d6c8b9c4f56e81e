"""Labels and numbers for histogram bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Edges of the token report.
POW2_EDGES = [128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536]


def bucket_labels(step: int = 10) -> list[str]:
    step = max(1, min(100, step))
    return [f"{left}-{min(left + step, 100)}%" for left in range(0, 100, step)] + ["100%"]


def percent_bucket(percent: Column, step: int = 10) -> Column:
    """Label of the percentage range ``percent`` falls in, after clipping to 0..100."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))
    left = (F.floor(clipped / step) * step).cast("int")
    label = F.concat(left.cast("string"), F.lit("-"), F.least(left + step, F.lit(100)).cast("string"), F.lit("%"))
    return F.when(clipped >= 100.0, F.lit("100%")).otherwise(label)


def fixed_bin(x: Column, lo: float, hi: float, width: float) -> Column:
    """Bin number in [lo, hi]; the upper end belongs to the last bin, outside is null."""
    last = math.ceil((hi - lo) / width) - 1
    raw = ((x - lo) / width).cast("int")
    return (
        F.when((x < lo) | (x > hi) | F.isnan(x), None)
        .when(x == hi, F.lit(last))
        .when(raw <= last, raw)
    )


def fixed_bin_labels(lo: float, hi: float, width: float) -> list[str]:
    """Names of the bins of ``fixed_bin``; the last one includes its upper end."""
    edges = [lo + k * width for k in range(math.ceil((hi - lo) / width) + 1)]
    names = [f"[{a:.4g},{b:.4g})" for a, b in zip(edges, edges[1:])]
    return [*names[:-1], names[-1][:-1] + "]"]


def pow2_bin(n: Column) -> Column:
    """Label of the power-of-two range of a token count."""
    label = F.when(n == 0, F.lit("0"))
    for low, high in zip([0] + POW2_EDGES, POW2_EDGES):
        label = label.when(n < high, F.lit(f"{low}-{high}"))
    return label.otherwise(F.lit(f"{POW2_EDGES[-1]}+"))


def doubling_bin(n: Column, start: int = 256) -> Column:
    """Number of the range [0,start), [start,2start), ... that holds ``n``."""
    return F.when(n < start, F.lit(0)).otherwise(F.length(F.bin(F.floor(n / start))))


def doubling_label(number: Column, start: int = 256) -> Column:
    edge = lambda n: (F.lit(start) * F.pow(F.lit(2.0), n)).cast("bigint")
    low, high = F.when(number == 0, F.lit(0).cast("bigint")).otherwise(edge(number - 1)), edge(number)
    return F.concat(F.lit("["), low.cast("string"), F.lit(","), high.cast("string"), F.lit(")"))


def small_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A fixed little table made of literals, without a Python worker."""
    cells = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def zero_filled(counts: DataFrame, dimension: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every row of a small fixed ``dimension``, with 0 where ``counts`` has nothing."""
    return dimension.join(counts, keys, "left").fillna(0, subset=values)

"""Broadcast of a join side only where its measured bytes are within a bound, tables of bits, and steps that leave no shuffle files behind."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from traceloom.session import cut_lineage

BROADCAST_BYTES = 64 << 20
LEAST_BITS, MOST_BITS = 16, 29


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``BROADCAST_BYTES``, else as it is, for a shuffled join.

    Measures every row, strings, bytes and arrays by their length, so give it a checkpointed or otherwise cheap table.
    """
    size = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            size += 8 + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, ArrayType):
            size += 8 + 8 * F.coalesce(F.size(field.name), F.lit(0))
        else:
            size += 8
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def text_keys(text: Column) -> dict[str, Column]:
    """h1 and h2, 128 bits of hash of a column of text or bytes; null is told from the empty text by the caller."""
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(20240607), text)}


class BitTable:
    """A set of 64-bit keys by their last bits: holds every key put in, and now and then another.

    Keys that are least hashes of many have few leading bits set, so those would not tell them apart.
    """

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bit = keys & np.uint64((1 << self.bits) - 1)
        return (self.table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_table(keys: DataFrame, column: str):
    """Broadcast of a ``BitTable`` of a column of longs.

    It has 8 to 16 bits a key, up to 2**``MOST_BITS`` bits (64 MB). With more keys it holds more of the others, which costs its users
    work and no rows.
    """
    bits = max(LEAST_BITS, min(MOST_BITS, (8 * keys.count()).bit_length()))
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    mask = F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")
    words = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(mask).alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(BitTable(bits, table.view(np.uint8)))


def finished_step(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and the shuffle files that led to it given up.

    Spark removes a shuffle's files when the driver no longer refers to it and has collected its garbage; without asking for that
    they would stay on disk through all later steps. Pass an expression, not a variable that goes on naming the plan.
    """
    out = cut_lineage(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out

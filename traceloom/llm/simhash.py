"""SimHash near-duplicates by one-bit neighbours of whole fingerprints, which stand in for multi-index hashing by segments.

Every distinct fingerprint enumerates its Hamming ball of radius 1: its 64 one-bit neighbours and itself, 65 table keys of all 64
bits. This works for a distance of two only, and needs no split of hot segment values. Two fingerprints differ in at most two bits exactly when they
share a key, for one of the two bits can be flipped on either side, wherever they lie. A table entry is only the key and a
64-bit mask saying which bit each comer flipped, so entries are pre-aggregated before the shuffle, at most 65 fingerprints can
ever meet in one, and no bucket grows with the corpus. The matches of a key form a star around its smallest fingerprint, whose
complete distances are at most two by construction (the check in ``links`` only states it); components of the stars are the groups.

Copies share a fingerprint, so a group of copies is one row here whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, texts
from traceloom.llm.components import components
from traceloom.llm.joins import small_side, text_keys
from traceloom.session import cut_lineage

MAX_DISTANCE = 2  # what one flip on either side can bridge
SHINGLE_WORDS = 3
HASH_SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text: per bit, whether over half of its shingles' hashes set it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        hashes = [xxh64_intdigest(b" ".join(words), HASH_SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(s), HASH_SEED) for s in zip(*(words[k:] for k in range(words_per_shingle)), strict=False)]
    set_bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, fp) of every row: hashes of its text, and the fingerprint as a signed long; null, empty and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("own_id", "own1", "own2")), pa.array(fps, pa.int64())], names=["doc_id", "h1", "h2", "fp"])

    return docs.select(F.col("text").cast("string").alias("text"), *row_keys()).mapInArrow(run, "doc_id long, h1 long, h2 long, fp long")


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all those at most two bits apart."""
    flip = "CASE WHEN bit < 0 THEN 0L ELSE shiftleft(1L, bit) END"
    probes = distinct_fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")).selectExpr(
        f"fp ^ {flip} AS key", f"{flip} AS mask", "CASE WHEN bit < 0 THEN 1 ELSE 0 END AS own"
    )
    entries = probes.groupBy("key").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
    met = entries.where("bit_count(mask) + own > 1").selectExpr(
        "transform(filter(sequence(-1, 63), b -> CASE WHEN b < 0 THEN own = 1 ELSE getbit(mask, b) = 1 END), "
        "b -> key ^ CASE WHEN b < 0 THEN 0L ELSE shiftleft(1L, b) END) AS fps"
    )
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return stars.where(f"a <> b AND bit_count(a ^ b) <= {MAX_DISTANCE}")


def group_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp, group_fp, h1, h2) of every row.

    component_id is the smallest doc_id of the rows that links can reach, this one included; rows with a null doc_id link like any
    other and take the group's id, which is null only if no row of the group has one. Repeated rows come back each. fp and group_fp
    are the fingerprint and the smallest one of its group as signed longs, h1 and h2 hashes of the text.
    """
    fps = cut_lineage(fingerprints(docs))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    grouped = label_rows(fps, nodes, components(links(nodes.select("fp"))))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "group_fp", "h1", "h2")


def label_rows(fps: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, component_id, fp, group_fp, h1, h2) of every row of ``fps`` (doc_id, h1, h2, fp), by the ``nodes`` (fp, first_id) and the ``labels``
    of those that are linked to another."""
    labelled = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = labelled.select(F.col("fp").alias("of"), "label").join(smallest, "label").select("of", "label", "component_id")
    return fps.join(of_fp, fps.fp == of_fp.of).select("doc_id", "component_id", "fp", F.col("label").alias("group_fp"), "h1", "h2")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group of fingerprints."""
    return keep_first(docs, group_documents(docs))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group: that with the smallest doc_id (null after all others, then by a hash of the text).

    ``groups`` has (doc_id, h1, h2, group_fp) of every row. Rows are told apart by doc_id and text, so different texts under one doc_id,
    or under none, are judged each; of rows that repeat both one stays.
    """
    key = ["doc_id", "h1", "h2"]
    rows = cut_lineage(groups.groupBy("group_fp", *key).agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), *key)
    first = rows.groupBy("group_fp").agg(F.min(order).alias("first"))
    marked = cut_lineage(rows.join(first, "group_fp").select(*key, "n", (order == F.col("first")).alias("stays")))
    own = docs.select(F.struct("*").alias("row"), *row_keys())
    away = small_side(cut_lineage(marked.where("NOT stays OR n > 1").select(*key)))
    kept = own.join(away, same_row(own, away), "left_anti").select("row.*")
    again = cut_lineage(marked.where("stays AND n > 1").select(*key))
    if not again.isEmpty():
        repeated = small_side(again)
        kept = kept.unionByName(own.join(repeated, same_row(own, repeated), "left_semi").dropDuplicates(["own_id", "own1", "own2"]).select("row.*"))
    return kept


def row_keys() -> list[Column]:
    """What tells a row of documents apart: own_id, and 128 bits of hash of its text."""
    keys = text_keys(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return [F.col("doc_id").cast("long").alias("own_id"), keys["h1"].alias("own1"), keys["h2"].alias("own2")]


def same_row(own: DataFrame, other: DataFrame) -> Column:
    return own["own_id"].eqNullSafe(other["doc_id"]) & (own["own1"] == other["h1"]) & (own["own2"] == other["h2"])

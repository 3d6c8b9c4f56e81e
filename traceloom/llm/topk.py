"""Exact top-k by integer inner product, pruned by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; per segment its sum and its deviation sqrt(n * sum of squares - sum^2) are kept. For a
query q and a row x the squared distance of a segment of n values is at least ((S_q - S_x)^2 + (D_q - D_x)^2) / n, so with the
exact norms the inner product is at most the sum of (S_q S_x + D_q D_x) / n. Coarse to fine, rows whose bound is below the query's
k-th best known score are given up; the exact integer products of the survivors decide. The first known scores are the exact ones of the rows with
the highest coarse bounds, so nothing is approximate.

Rows and queries are packed into blocks of bounded size, and each block of queries meets each block of rows in one task: what
moves is a block per meeting, and a meeting returns at most k rows a query. The work is that of a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = (1, 4, 16)
ROW_BLOCK = 8192
QUERY_BLOCK = 1024
FOUND = "query_id long, q1 long, q2 long, times long, vec_id long, score long"


class Resolution:
    """Segment sums and deviations of the rows of an integer matrix, and the bound on inner products they give."""

    def __init__(self, values: np.ndarray, segments: int):
        edges = np.unique(np.linspace(0, values.shape[1], segments + 1).astype(int))
        n = np.diff(edges)
        # exact in doubles: sums of squares stay below 2**53 for components below 2**20 and up to 2**13 dimensions
        real = values.astype(np.float64)
        sums = np.add.reduceat(real, edges[:-1], axis=1)
        squares = np.add.reduceat(real * real, edges[:-1], axis=1)
        spread = np.sqrt(np.maximum(n * squares - sums * sums, 0))
        self.features = np.hstack([sums, spread]) / np.sqrt(np.hstack([n, n]))

    def bounds(self, query: int, other: Resolution, rows: np.ndarray | slice) -> np.ndarray:
        """Upper bounds on the products of this matrix's row ``query`` with ``rows`` of the other, with room for rounding."""
        found = other.features[rows] @ self.features[query]
        return found + 1e-9 * np.abs(found) + 0.5


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int, copies: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The k best (place of the query, vec_id, score) of each query among the rows, itself left out: of the rows that have its id and its
    vector the one with copy number 1."""
    if not len(row_ids) or not len(query_ids):
        return []
    copies = np.ones(len(row_ids), np.int64) if copies is None else copies
    of_queries = [Resolution(queries, s) for s in SEGMENTS]
    of_rows = [Resolution(rows, s) for s in SEGMENTS]
    out = []
    for at, query_id in enumerate(query_ids):
        query = queries[at]
        named = np.flatnonzero((row_ids == query_id) & (copies == 1))
        own = named[(rows[named] == query).all(axis=1)]
        alive = np.delete(np.arange(len(row_ids)), own)
        known = None
        for mine, theirs in zip(of_queries, of_rows, strict=True):
            if len(alive) <= k:
                break
            bounds = mine.bounds(at, theirs, alive)
            likely = alive[np.argpartition(bounds, len(alive) - k)[-k:]]
            least = int((rows[likely] @ query).min())
            known = least if known is None else max(known, least)
            alive = alive[bounds >= known]
        scores = rows[alive] @ query
        best = best_of(scores, row_ids[alive], k)
        out += zip([at] * len(best), row_ids[alive][best].tolist(), scores[best].tolist(), strict=True)
    return out


def quantized(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, times): v holds floor(256 * x) of every component, times says how many rows are equal. Null ids, null or empty vectors
    and those with a null or non-finite component take no part; rows that share an id but not the vector stay apart."""
    x = F.col(vector_column).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.where(F.col(id_column).isNotNull() & (F.size(x) > 0) & fine)
    v = F.transform(x, lambda c: F.floor(c * 256).cast("long"))
    return usable.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))


def _pack(rows: DataFrame, blocks: int, number: str) -> DataFrame:
    """One row per block with its ids, numbers and vectors as bytes; a block also holds vectors of one length only."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        flat = np.concatenate([np.asarray(v, np.int64) for v in group["v"]])
        columns = {name: [group[name].to_numpy(np.int64).tobytes()] for name in ("vec_id", number)}
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "block": [group["block"].iloc[0]], **columns, "flat": [flat.tobytes()]})

    block = F.pmod(F.xxhash64("vec_id", number, "v"), F.lit(blocks)).alias("block")
    keyed = rows.select("vec_id", number, "v", F.size("v").alias("dim"), block)
    return keyed.groupBy("dim", "block").applyInPandas(pack, f"dim int, block long, vec_id binary, {number} binary, flat binary")


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product, ties to the smaller id, all if there are fewer.

    Queries are the rows whose id is divisible by ``query_every``; candidates every row but the query's own, of the same length. So rows
    that repeat a query are candidates of each other, and each of them is a query with an answer of its own, whether their vectors are
    equal or not. Of equal rows k + 1 are enough to fill any answer and are all that is looked at. An empty table and a table
    without queries give no rows. Block counts follow the row count, so a block's size does not.
    """
    rows = quantized(vectors, id_column, vector_column)
    total, asked = vectors.agg(F.count(F.lit(1)), F.count_if(F.col(id_column) % query_every == 0)).first()
    row_blocks, query_blocks = -(-total // ROW_BLOCK) or 1, -(-asked // QUERY_BLOCK) or 1
    each = rows.select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k + 1)))).alias("copy"))
    table = _pack(each, row_blocks, "copy").withColumnRenamed("block", "row_block")
    questions = _pack(rows.where(F.col("vec_id") % query_every == 0), query_blocks, "times").select(
        "dim", F.col("block").alias("query_block"), F.col("vec_id").alias("query_ids"), "times", F.col("flat").alias("query_flat")
    )
    # every pair of blocks meets: each side names the blocks of the other
    left = table.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    meetings = left.join(questions, ["dim", "query_block"]).repartition(max(1, row_blocks * query_blocks), "dim", "row_block", "query_block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh128_intdigest

        for batch in batches:
            for m in batch.itertuples():
                numbers = lambda raw: np.frombuffer(raw, np.int64)
                matrix, queries = numbers(m.flat).reshape(-1, m.dim), numbers(m.query_flat).reshape(-1, m.dim)
                ids, times = numbers(m.query_ids), numbers(m.times)
                found = search(ids, queries, numbers(m.vec_id), matrix, k, numbers(m.copy))
                keys = [np.frombuffer(xxh128_intdigest(q.tobytes()).to_bytes(16, "little"), np.int64).tolist() for q in queries]
                rows = [(int(ids[at]), *keys[at], int(times[at]), vec_id, score) for at, vec_id, score in found]
                yield pd.DataFrame(rows, columns=["query_id", "q1", "q2", "times", "vec_id", "score"])

    return _ranked(meetings.mapInPandas(run, FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the meetings found, per query at most k rows a block of rows; once for each row that asks the same."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    asked = best.withColumn("_asked", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return asked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r AS q, q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
    FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND r.r <> q.r AND len(r.v) = len(q.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

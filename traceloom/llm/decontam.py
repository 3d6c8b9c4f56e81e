"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words; the words at its ignored positions may differ. Every window of a document and of a
benchmark item is hashed under each mask, equal hashes are joined, and around each hit document and item are laid side by side: an
overlap counts if, of some ``WINDOW`` neighbouring item words (of all, in a shorter item), a share of at least ``SIMILARITY`` is the
same at the same place. So single substituted words hide neither the hit nor the overlap.

The benchmark is packed into blocks of at most ``BLOCK_BYTES`` of text, each a hash table that goes to the tasks; documents are read
once and nothing of them is shuffled. One block is kept in a worker's memory at a time; a larger benchmark only means more blocks.

Items of fewer than ``MIN_WORDS`` words, null and empty items match nothing; null and empty documents overlap nothing. An empty
benchmark leaves all clean. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, texts
from traceloom.llm.words import finish, word_hashes

MASKS = ("11111", "1101011", "11010011", "1011001001")
MIN_WORDS = 5
WINDOW = 32
SIMILARITY = 0.8
BLOCK_BYTES = 32 << 20
FILTER_BITS = 20
SLICE = 2 << 20
JUDGED = "doc_id long, contaminated boolean, n_items long, item_id long, overlap double"


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window's words under the mask, by the window's first word; empty if there are too few words."""
    n = len(words) - len(mask) + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n] if n > 0 else total
    return finish(total)


class SeedTable:
    """The items of one block: their words, and the windows of all items by hash for each mask."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words, bounds = word_hashes([t for _, t in items])
        self.ids = np.array([i for i, _ in items], np.int64)
        self.begins, self.sizes = bounds[:-1], np.diff(bounds)
        owner = np.repeat(np.arange(len(items)), self.sizes)
        self.tables = []
        for mask in MASKS:
            hashes = seed_hashes(self.words, mask)
            at = np.arange(len(hashes))
            inside = owner[at] == owner[at + len(mask) - 1] if len(at) else np.zeros(0, bool)
            order = np.argsort(hashes[inside], kind="stable")
            hashes, at = hashes[inside][order], at[inside][order]
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((mask, hashes, owner[at] if len(at) else at, at - self.begins[owner[at]] if len(at) else at, seen))

    def alignments(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, offset of the item's first word in all words) that share a seed."""
        found = []
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for mask, hashes, items, places, seen in self.tables:
            mine = seed_hashes(words, mask)
            at = np.flatnonzero(seen[mine >> np.uint64(64 - FILTER_BITS)]) if len(hashes) else np.zeros(0, np.int64)
            at = at[text_of[at] == text_of[at + len(mask) - 1]]
            low, high = np.searchsorted(hashes, mine[at], "left"), np.searchsorted(hashes, mine[at], "right")
            counts = high - low
            entry = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            at = np.repeat(at, counts)
            found.append(np.stack([text_of[at], items[entry], at - places[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text, item, same words of the best window, words of the window) of the verified overlaps."""
        pairs = self.alignments(words, bounds)
        kept = [np.zeros((0, 4), np.int64)]
        step = max(1, (1 << 20) // max(1, int(self.sizes.max(initial=1))))
        for k in range(0, len(pairs), step):
            text, item, offset = pairs[k : k + step].T
            sizes = self.sizes[item]
            first = np.cumsum(sizes) - sizes
            place = np.arange(sizes.sum()) - np.repeat(first, sizes)
            there = np.repeat(offset, sizes) + place
            inside = (there >= np.repeat(bounds[text], sizes)) & (there < np.repeat(bounds[text + 1], sizes))
            same = inside & (words[np.where(inside, there, 0)] == self.words[np.repeat(self.begins[item], sizes) + place])
            summed = np.concatenate([[0], np.cumsum(same)])
            window = np.minimum(sizes, WINDOW)
            wide = np.repeat(window, sizes)
            ends = np.arange(1, len(place) + 1)
            of_window = np.where(place + 1 >= wide, summed[ends] - summed[np.maximum(ends - wide, 0)], -1)
            best = np.maximum.reduceat(of_window, first)
            good = best >= SIMILARITY * window
            kept.append(np.stack([text, item, best, window], axis=1)[good])
        return np.concatenate(kept)

    def judge(self, batch: list[str]) -> list[dict[int, float]]:
        """For each text the overlapped items with the best share of equal words."""
        words, bounds = word_hashes(batch)
        out: list[dict[int, float]] = [{} for _ in batch]
        for text, item, same, window in self.overlaps(words, bounds).tolist():
            item_id = int(self.ids[item])
            out[text][item_id] = max(out[text].get(item_id, 0.0), same / window)
        return out


class Blocks:
    """The broadcast blocks of a benchmark; a single one stays loaded, of several one is loaded at a time."""

    def __init__(self, shared: list):
        self.shared = shared
        self.only = SeedTable(shared[0].value) if len(shared) == 1 else None

    def judge(self, batch: list[str]) -> list[dict[int, float]]:
        out: list[dict[int, float]] = [{} for _ in batch]
        for block in self.shared:
            table = self.only or SeedTable(block.value)
            for found, more in zip(out, table.judge(batch), strict=True):
                found.update(more)
        return out


def share_benchmark(benchmark: DataFrame) -> list:
    """Broadcasts of (item_id, text), at most about ``BLOCK_BYTES`` of text each; only one is held by the driver at a time."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    shared = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared.append(context.broadcast([(r.item_id, r.text) for r in part.collect()]))
    return shared


def judge_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, overlap) of every row: how many items overlap, the smallest id of those with the
    largest share of equal words, and that share (null and 0 for a clean row)."""
    shared = share_benchmark(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shared)
        for batch in slices(batches, "text", SLICE):
            found = blocks.judge(texts(batch, "text"))
            best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, 0.0) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([bool(f) for f in found], pa.bool_()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([b[0] for b in best], pa.int64()),
                    pa.array([b[1] for b in best], pa.float64()),
                ],
                names=["doc_id", "contaminated", "n_items", "item_id", "overlap"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, JUDGED)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns."""
    shared = share_benchmark(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shared)
        for batch in slices(batches, "text", SLICE):
            yield batch.filter(pa.array([not f for f in blocks.judge(texts(batch, "text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Near copies by SimHash, checked by Jaccard similarity: documents whose sets of five-word shingles are alike to 0.8 or more, and what
these links reach.

Each set has a 64-bit SimHash fingerprint, and fingerprints at most two bits apart (``simhash.links``) make candidates. Sets alike to 0.8
may lie much further apart, so tables by segment of minima find the rest: of a set's ``BANDS * ROWS`` minima under fixed mixings, each segment of ``ROWS`` is a table
key. Two sets of similarity s share none of the keys with probability (1 - s**4)**32, which is 5e-8 at 0.8 and less above. Keys are
aggregated before they move, each candidate is tied to the smallest one of its key only, so a large group makes as many rows as it
has members, and the components of these ties are what can be near copies at all.

Each component's whole shingle sets then meet and are compared exactly, sets that are linked already by walking from one to the
next. A component of over ``BLOCK`` shingles is cut into blocks, and every two blocks meet in a task of their own: no task holds more
than two blocks (about; a longer text comes whole), and no pair is left out. The links found are joined to groups.

Words are what ASCII white space separates, ASCII letters in lower case. A text of fewer than five words is one shingle. Null, empty
and blank texts are copies of one another. Texts of equal sets are one row in all this, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import give_back, slices, texts
from traceloom.llm.components import components
from traceloom.llm.joins import small_side
from traceloom.llm import simhash
from traceloom.llm.simhash import keep_first, label_rows, row_keys
from traceloom.llm.words import finish, hashes_of
from traceloom.session import cut_lineage

WORDS = 5
BANDS, ROWS = 32, 4
BLOCK = 1 << 18
FOLD = np.uint64(0xD6E8FEB86659FD93)
MIX = np.random.default_rng(20240811)
XORS, FACTORS = (MIX.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(odd) for odd in (0, 1))
SPLIT_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def alike(shared, size, other):
    """Whether sets of these sizes and so many common members have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (size + other)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` neighbouring words."""
    n = max(0, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * FOLD + words[k : k + n]
    return finish(total)


def shingle_sets(batch: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, never none: a text without words has the shingle 0."""
    words, bounds = hashes_of([t.encode("utf-8", "surrogatepass").translate(SPLIT_BYTES) + b" " for t in batch])
    windows = folded(words, WORDS)
    sets = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start >= WORDS:
            sets.append(np.unique(windows[start : end - WORDS + 1]))
        else:
            sets.append(folded(words[start:end], end - start) if end > start else np.zeros(1, np.uint64))
    return sets


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A key of each whole set as signed longs."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s.tobytes(), len(s)) for s in sets], np.uint64).view(np.int64)


def segment_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The ``BANDS`` table keys of each set as signed longs, a row a set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(sets), band, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            total = total * FOLD + np.minimum.reduceat((flat ^ XORS[k]) * FACTORS[k], starts)
        keys[:, band] = finish(total)
    return keys.view(np.int64)


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each set as a signed long: per bit, whether over half of its shingles' hashes set it."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    half = np.array([len(s) for s in sets]) / 2
    flat = np.concatenate(sets).astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.empty((len(sets), 8), np.uint8)
    for k in range(8):  # a byte of the hashes at a time, so that the bits of all are never held together
        bits = np.unpackbits(flat[:, k : k + 1], axis=1, bitorder="little")
        out[:, k] = np.packbits(np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > half[:, None], axis=1, bitorder="little")[:, 0]
    return out.view("<i8")[:, 0]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, fp, size, keys, print) of every row: hashes of its text, the key of its set, the set's size, its table keys and its
    fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts(batch, "text"))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(segment_keys(sets).ravel()))
            columns = [*(batch.column(k) for k in ("own_id", "own1", "own2")), pa.array(set_keys(sets)), pa.array([len(s) for s in sets], pa.int64()), keys, pa.array(fingerprints_of(sets))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "fp", "size", "keys", "print"])
        sets = keys = columns = None
        give_back()  # the worker goes on to later stages

    return docs.select(F.col("text").cast("string").alias("text"), *row_keys()).mapInArrow(run, "doc_id long, h1 long, h2 long, fp long, size long, keys array<long>, print long")


def whole_sets(docs: DataFrame) -> DataFrame:
    """(fp, shingles) of every row: the key of its set and the set itself as packed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "fp long, shingles binary")


def ties(sketched: DataFrame) -> DataFrame:
    """Edges (a, b) from every set to the smallest one of each table key it shares."""
    entries = sketched.select("fp", F.explode("keys").alias("key"))
    lows = entries.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    met = small_side(cut_lineage(lows.select(F.col("key").alias("of"), "low")))
    return entries.join(met, F.col("key") == F.col("of")).where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def fingerprint_ties(sketched: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that connect all whose fingerprints are equal or at most two bits apart."""
    prints = cut_lineage(sketched.groupBy("print").agg(F.min("fp").alias("low"), F.max("fp").alias("high")))
    own = sketched.join(small_side(prints.where("low < high").select(F.col("print").alias("of"), "low")), F.col("print") == F.col("of"))
    equal = own.where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    low = lambda name, end: prints.select(F.col("print").alias(f"_{end}"), F.col("low").alias(name))
    near = simhash.links(prints.select(F.col("print").alias("fp"))).withColumnsRenamed({"a": "_x", "b": "_y"})
    met = near.join(low("a", "x"), "_x").join(low("b", "y"), "_y").where("a <> b").select("a", "b")
    return equal.unionAll(met)


def links_within(members: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges that connect exactly the sets that links of 0.8 or more connect, one for each set reached from another."""
    fps, sets = list(members), list(members.values())
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(ids) and int(ids.max()) + 1, bool)
    left, flat = np.arange(len(sets)), ids
    queue: list[int] = []
    while len(left):
        at = queue.pop() if queue else int(left[0])
        if left[0] == at:
            flat, left = flat[sizes[at] :], left[1:]
        if not len(left):
            break
        own = ids[bounds[at] : bounds[at + 1]]
        mark[own] = True
        starts = np.cumsum(sizes[left]) - sizes[left]
        near = alike(np.add.reduceat(mark[flat], starts, dtype=np.int64), sizes[at], sizes[left])
        mark[own] = False
        if near.any():
            for other in left[near].tolist():
                yield fps[at], fps[other]
                queue.append(other)
            flat = flat[np.repeat(~near, sizes[left])]
            left = left[~near]


def links(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Edges (a, b) of keys of sets that connect those alike to 0.8 or more."""
    labels = cut_lineage(components(fingerprint_ties(sketched).unionAll(ties(sketched))))
    met = small_side(labels)
    sized = sketched.join(met, sketched.fp == met.node).groupBy("label", "fp").agg(F.min("doc_id").alias("first_id"), F.max("size").alias("size"))
    nodes = cut_lineage(sized)
    blocks = nodes.groupBy("label").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    places = nodes.join(small_side(cut_lineage(blocks)), "label").select(F.col("fp").alias("of"), "label", "blocks")
    firsts = small_side(nodes.where("first_id IS NOT NULL").select("first_id").distinct())
    picked = docs.select("doc_id", "text").join(firsts, docs["doc_id"].cast("long") == firsts["first_id"], "left_semi")
    picked = picked.unionAll(docs.where(docs["doc_id"].isNull()).select("doc_id", "text"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = whole_sets(picked).join(small_side(cut_lineage(places)), F.col("fp") == F.col("of")).select(
        "label", "fp", "shingles", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, {}

        def found() -> pa.RecordBatch:
            edges = np.array(list(links_within(members)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for batch in slices(batches, "shingles"):
            for *key, fp, shingles in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != group:
                    if len(members) > 1:
                        yield found()
                    group, members = key, {}
                members[fp] = np.frombuffer(shingles, np.uint64)
        if len(members) > 1:
            yield found()

    return dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, "a long, b long")


def group_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id, fp, group_fp, h1, h2) of every row; component_id is the smallest doc_id of the rows that links can reach, this
    one included. Null doc_ids and repeated rows are treated as in simhash.group_documents."""
    sketched = cut_lineage(sketches(docs))
    nodes = cut_lineage(sketched.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return label_rows(sketched.select("doc_id", "h1", "h2", "fp"), nodes, components(links(docs, sketched)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group of near copies, as simhash.keep_first picks them."""
    return keep_first(docs, group_documents(docs))

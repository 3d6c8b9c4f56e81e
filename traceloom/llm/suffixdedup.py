"""Removal of repeated byte strings with suffix arrays per shard.

A byte goes if a string of ``WINDOW`` bytes that covers it starts anywhere else too, in the same text or another. Every window (place
where such a string could start) belongs to one anchor, its gram with the least hash; equal windows have equal anchors, so they can
only meet within an anchor. Neighbouring windows of one anchor form a stretch.

1. Stretches are counted by anchor. An anchor that occurs once repeats nothing. If all its stretches are equal (copies), all their
   windows are repeated. The rest are mixed. A bit table that grows with the anchors, up to a bound, tells later passes which to look
   at; a bit set by chance only makes them look at more.
2. The stretches of mixed anchors, of equal ones at most two from each task, are dealt to shards by anchor, without the gram, which
   the anchor stands for; what a task has for a shard is packed and compressed. An anchor with very many is dealt to several shards,
   which are its own. Per shard a suffix array (Larsson-Sadakane refinement) and the common prefixes of its neighbours (Kasai) show which
   windows are equal, and so which start more than once.
3. Where an anchor fills several shards, each shard sorts the hashes of its windows by their place around the gram, which equal
   windows share, and cuts them in pieces; the lists of one piece from all shards meet in a task, where each is searched for in the
   others (binary search). Of very many shards the pieces are cut by hash too.
4. The repeated windows go back to the documents as few byte ranges each, and the bytes they cover are removed.

Copies are counted before they move, so a group of any size is a row per task; a mixed anchor of any size is split. Null texts are
empty; texts shorter than a window keep all bytes. Repeated rows are copies of each other. Ranges find their rows by 128 bits of hash of
the text alone, as equal texts lose equal ranges; doc_id may be null or shared by different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import packed, slices
from traceloom.llm.joins import BitTable, bit_table, finished_step, small_side, text_keys
from traceloom.llm.suffixes import Hashed, anchored_windows, common_prefixes, suffix_array
from traceloom.llm.words import finish

WINDOW = 200
GRAM = 64
SHARD_STRETCHES = 2048
SHARD_BYTES = 4 << 20
MOST_SPLIT = 1_000_000  # anchors that may have shards of their own; the largest come first
BUFFER_BYTES = 24 << 20
SLICE = 1 << 20
ALL = 1 << 30
PLACE_PIECES = 16
REST = WINDOW - GRAM  # bytes of a window without its gram
SEEN_STRETCHES = 500_000
STRETCH = "h1 long, h2 long, anchor long, content long, windows long"
PACKED = "shard long, part int, parts int, stretches binary"
REPEATS = "anchor long, content long, first int, last int, piece int, hashes binary, owners binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text as bytes, h1, h2): the parts of a row that this operator reads."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(text_keys(F.col("text")))


def found_in(batch: pa.RecordBatch, bits: BitTable | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The stretches of a batch, with a bit table only those of its anchors, and the batch's bytes and text bounds."""
    flat, bounds = packed(batch.column("text").to_pylist())
    found = anchored_windows(flat, bounds, WINDOW, GRAM)
    if bits is not None:
        keep = bits.holds(found["anchor"])
        found = {name: values[keep] for name, values in found.items()}
    return found, flat, bounds


def stretches(docs: DataFrame, seen=None) -> DataFrame:
    """The stretches of all texts, with a bit table only those of its anchors; windows holds the first window's place and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found, _, bounds = found_in(batch, seen and seen.value)
            rows = pa.array(found["text"])
            start = (found["start"] - bounds[found["text"]]).astype(np.int64)
            columns = [batch.column("h1").take(rows), batch.column("h2").take(rows)]
            columns += [pa.array(found[k].view(np.int64)) for k in ("anchor", "content")]
            columns.append(pa.array(start << 32 | found["windows"].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "anchor", "content", "windows"])

    return keyed(docs).select("text", "h1", "h2").mapInArrow(run, STRETCH)


class Packer:
    """Stretches gathered by shard, and packed as compressed arrays when the buffer is full."""

    def __init__(self, shards: int, large: tuple[np.ndarray, np.ndarray]):
        self.shards, (self.large, self.parts) = shards, large
        self.rows: dict[tuple[int, int, int], list] = {}
        self.size = 0

    def add(self, anchors: np.ndarray, contents: np.ndarray, windows: np.ndarray, places: np.ndarray, raw: list[bytes | None]) -> None:
        at = np.minimum(np.searchsorted(self.large, anchors), max(0, len(self.large) - 1))
        own = self.large[at] == anchors if len(self.large) else np.zeros(len(anchors), bool)
        parts = np.where(own, self.parts[at], 1) if len(self.large) else np.ones(len(anchors), np.int64)
        shard = np.where(own, anchors.view(np.int64), (anchors % np.uint64(self.shards)).view(np.int64))
        part = np.where(own, (contents % parts.astype(np.uint64)).astype(np.int64), 0)
        columns = (anchors.view(np.int64), contents.view(np.int64), windows, places)
        for key, *row, text in zip(zip(shard.tolist(), part.tolist(), parts.tolist(), strict=True), *(c.tolist() for c in columns), raw, strict=True):
            self.rows.setdefault(key, []).append((*row, text))
            self.size += 60 + len(text or b"")

    def flush(self) -> pa.RecordBatch:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        blobs = []
        for rows in self.rows.values():
            rows.sort(key=lambda r: r[0])  # stretches of one anchor are alike
            anchors, contents, windows, places, texts = zip(*rows, strict=True)
            sizes = [-1 if t is None else len(t) for t in texts]
            head = np.array([len(rows)], "<i8").tobytes() + b"".join(np.array(c, "<i8").tobytes() for c in (anchors, contents))
            head += b"".join(np.array(c, "<i4").tobytes() for c in (windows, places, sizes))
            blobs.append(press(head + b"".join(t for t in texts if t)))
        keys = list(zip(*self.rows, strict=True)) or [(), (), ()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), pa.array(blobs, pa.binary())],
            names=["shard", "part", "parts", "stretches"],
        )
        self.rows, self.size = {}, 0
        return out


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """Anchors, contents, windows, places and texts of a packed row."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    anchors, contents = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
    windows, places, sizes = np.frombuffer(raw, "<i4", 3 * n, 8 + 16 * n).reshape(3, n)
    ends = 8 + 28 * n + np.cumsum(np.maximum(sizes, 0))
    texts = [None if size < 0 else raw[end - size : end] for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return anchors, contents, windows, places, texts


def packed_stretches(docs: DataFrame, mixed, large, shards: int) -> DataFrame:
    """The stretches of mixed anchors without the gram, packed by shard. Of equal ones a task gives two, the second without the bytes:
    that a stretch is there twice is all that its further copies could tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[int, int], int] = {}
        packer = Packer(shards, large.value)
        for batch in slices(batches, "text", SLICE):
            found, flat, _ = found_in(batch, mixed.value)
            raw = flat.tobytes()
            chosen, content = [], []
            if len(times) > SEEN_STRETCHES:
                times.clear()
            begins, places, counts = found["start"].tolist(), found["place"].tolist(), found["windows"].tolist()
            for k, key in enumerate(zip(found["anchor"].tolist(), found["content"].tolist(), strict=True)):
                before = times.get(key, 0)
                if before == 2:
                    continue
                times[key] = before + 1
                chosen.append(k)
                at = places[k]
                content.append(None if before else raw[begins[k] : at] + raw[at + GRAM : begins[k] + counts[k] + WINDOW - 1])
            place = (found["place"] - found["start"])[chosen]
            packer.add(found["anchor"][chosen], found["content"][chosen], found["windows"][chosen], place, content)
            if packer.size > BUFFER_BYTES:
                yield packer.flush()
        yield packer.flush()

    return keyed(docs).select("text").mapInArrow(run, PACKED)


def runs_of(flags: np.ndarray, owner: np.ndarray, offset: np.ndarray, step: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Maximal runs of set flags within an owner: owner, first and last offset. ``step`` are the places that must follow each other."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    follow = at if step is None else step[at]
    breaks = np.flatnonzero((np.diff(follow) != 1) | (np.diff(owner[at]) != 0)) + 1
    first, last = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks - 1, [len(at) - 1]])]
    return owner[first], offset[first], offset[last]


def resolve_shard(group: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The windows of a shard's stretches that start more than once; of an anchor in several shards also the hashes of all its windows.

    The rows of the latter carry a piece of the hashes' range, sorted, and which stretch and offset each window is. A stretch's gram
    is one symbol of its anchor's own, so a window is ``REST`` + 1 symbols and equal only within an anchor.
    """
    rows = [unpacked(blob) for blob in group["stretches"]]
    anchor, content, windows, place = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in range(4))
    texts = [t for r in rows for t in r[4]]
    order = np.lexsort((np.array([t is None for t in texts]), content, anchor))
    anchor, content, windows, place = anchor[order], content[order], windows[order], place[order]
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
    times = np.bincount(np.cumsum(fresh) - 1)
    contents = [texts[k] for k in order[fresh].tolist()]
    anchor, content, windows, place = anchor[fresh], content[fresh], windows[fresh], place[fresh]
    marked = b"".join([c[:p] + b"\0" + c[p:] + b"\0" for c, p in zip(contents, place.tolist(), strict=True)])
    sizes = np.array([len(b) + 1 for b in contents])
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.frombuffer(marked, np.uint8).astype(np.int32) + 1
    x[starts + place] = 257 + np.unique(anchor, return_inverse=True)[1]
    x[starts + sizes] = 0
    order = suffix_array(x)
    prefix = common_prefixes(x, order, starts, sizes, REST + 1)
    equal_to = np.empty(len(x), np.int64)
    equal_to[order] = np.cumsum(prefix < REST + 1)
    owner = np.repeat(np.arange(len(contents)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    classes = equal_to[starts[owner] + offset]
    counts = np.bincount(classes, times[owner])
    who, first, last = runs_of(counts[classes] > 1, owner, offset)
    out = [pd.DataFrame({"anchor": anchor[who], "content": content[who], "first": first, "last": last, "piece": -1, "hashes": None, "owners": None})]
    if shards > 1:
        hashed = Hashed(np.frombuffer(marked, np.uint8))
        at = starts[owner] + offset
        hashes = finish(hashed.ranges(at, at + REST + 1) ^ (place[owner] - offset).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        by = np.argsort(hashes, kind="stable")
        hashes, owner, offset = hashes[by], owner[by], offset[by]
        by_place = min(shards, PLACE_PIECES)
        by_hash = np.uint64(-(-shards // by_place))
        piece = (place[owner] - offset) * by_place // (REST + 1) + by_place * ((hashes >> np.uint64(32)) * by_hash >> np.uint64(32)).astype(np.int64)
        for p in np.unique(piece):
            mine = piece == p
            places = np.stack([content[owner[mine]], offset[mine]])
            columns = {"anchor": anchor[:1], "content": [0], "first": [0], "last": [0], "piece": [p], "hashes": [hashes[mine].tobytes()]}
            out.append(pd.DataFrame(columns | {"owners": [places.astype(np.int64).tobytes()]}))
    return pd.concat(out, ignore_index=True)


def merge_shards(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of one piece that another shard of the same anchor holds too, found by binary search in each, as runs of offsets."""
    lists = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
    together = np.sort(np.concatenate([np.unique(mine) for mine in lists]))
    found = [np.zeros((2, 0), np.int64)]
    for mine, owners in zip(lists, group["owners"], strict=True):
        shared = np.searchsorted(together, mine, "right") - np.searchsorted(together, mine, "left") > 1
        found.append(np.frombuffer(owners, np.int64).reshape(2, -1)[:, shared])
    content, offset = np.concatenate(found, axis=1)
    by = np.lexsort((offset, content))
    content, offset = content[by], offset[by]
    owner, first, last = runs_of(np.ones(len(content), bool), content, offset, offset)
    return pd.DataFrame({"anchor": group["anchor"].iloc[0], "content": owner, "first": first, "last": last})


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, object]:
    """(anchor, content, first, last): the repeated windows of stretches as runs of offsets, and the bit table of the anchors to look at."""
    anchors = finished_step(
        stretches(docs)
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("times"), F.min("content").alias("low"), F.max("content").alias("high"))
        .where("times > 1")
    )
    pure, mixed = anchors.where("low = high"), anchors.where("low <> high")
    seen, look_in = (bit_table(found.select("anchor"), "anchor") for found in (anchors, mixed))
    total = mixed.agg(F.sum("times")).first()[0] or 0
    shards = max(1, -(-total * WINDOW // SHARD_BYTES))
    hottest = mixed.where(F.col("times") > SHARD_STRETCHES).orderBy(F.desc("times"), "anchor").limit(MOST_SPLIT).toArrow()
    by_anchor = np.argsort(hottest["anchor"].to_numpy().view(np.uint64))
    parts = -(-hottest["times"].to_numpy() // SHARD_STRETCHES)
    large = docs.sparkSession.sparkContext.broadcast((hottest["anchor"].to_numpy().view(np.uint64)[by_anchor], parts[by_anchor]))

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        return resolve_shard(group, int(group["parts"].iloc[0]))

    resolved = finished_step(packed_stretches(docs, look_in, large, shards).groupBy("shard", "part", "parts").applyInPandas(resolve, REPEATS))
    within = resolved.where("piece < 0").select("anchor", "content", "first", "last")
    across = resolved.where("piece >= 0").groupBy("anchor", "piece").applyInPandas(merge_shards, "anchor long, content long, first int, last int")
    copies = pure.select("anchor", F.col("low").alias("content"), F.lit(0).alias("first"), F.lit(ALL).alias("last"))
    return copies.unionAll(within).unionAll(across), seen


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(h1, h2, spans): per text with a repeated window the maximal byte ranges to remove, as pairs of long packed in bytes."""
    repeats, seen = repeated_windows(docs)
    start, windows = F.shiftright("windows", 32), F.col("windows").bitwiseAND(0xFFFFFFFF)
    # a run's place and length, which spread a set's hashes; its two ends would nearly cancel in them
    run = F.shiftleft(start + F.col("first"), 32).bitwiseOR(F.least(F.col("last").cast("long"), windows - 1) - F.col("first"))
    found = stretches(docs, seen).join(repeats, ["anchor", "content"]).select("h1", "h2", run.alias("run"))
    gathered = found.groupBy("h1", "h2").agg(F.collect_set("run").alias("runs"))

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            flat = runs.flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))])
            first = flat >> 32
            end = first + (flat & 0xFFFFFFFF) + WINDOW
            spans = [joined_ranges(first[a:b], end[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(spans, pa.binary())], names=["h1", "h2", "spans"])

    return gathered.mapInArrow(join_runs, "h1 long, h2 long, spans binary")


def joined_ranges(first: np.ndarray, last: np.ndarray) -> bytes:
    """The maximal ranges that overlapping or touching ranges make, as pairs of long."""
    by = np.argsort(first, kind="stable")
    first, reach = first[by], np.maximum.accumulate(last[by])
    breaks = np.flatnonzero(first[1:] > reach[:-1]) + 1
    return np.stack([first[np.concatenate([[0], breaks])], reach[np.concatenate([breaks - 1, [len(first) - 1]])]], axis=1).tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: kept is what is left of the text's bytes."""
    ranges = finished_step(removed_ranges(docs)).select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), "spans")
    rows = keyed(docs)
    joined = rows.join(small_side(ranges), (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sizes, removed, counts, kept = [], [], [], []
            for text, packed_spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                spans = np.frombuffer(packed_spans or b"", np.int64).reshape(-1, 2).tolist()
                edges = [0, *(e for s in spans for e in s), len(text)]
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in spans))
                counts.append(len(spans))
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            columns = [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (sizes, removed, counts)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

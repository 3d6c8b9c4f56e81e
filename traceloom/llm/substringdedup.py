"""Removal of repeated word sequences with suffix trees partitioned by variable-length prefixes.

A word goes if a window of ``WINDOW`` words that covers it starts anywhere else too, in the same text or another. Only some suffixes
are looked at: each window belongs to its anchor, the sequence of ``GRAM`` neighbouring words with the least hash, and equal windows
have equal anchors at equal places. Neighbouring windows of one anchor form a stretch.

1. Stretches are counted by prefix, at first the anchor's own words. A prefix that occurs once repeats nothing. If all its stretches
   are equal (copies), all their windows are repeated.
2. The distinct stretches of the other prefixes go to shards by prefix, equal ones at most twice from a task, packed and compressed. Per
   prefix the suffix tree of its windows is grown (``subtrees``), and what lies below an internal node of ``WINDOW`` words is repeated.
3. A prefix with more than ``MOST_STRETCHES`` unequal stretches is made longer: its windows are halved by the place of the anchor in
   them, and each half has the longer sequence of words that all its windows share. So prefixes grow, level by level and over their
   distinct stretches only, until their groups fit in memory, or to the full window, where equal prefixes are equal windows.
4. The repeated windows go back to the texts as few ranges each, and the words they cover are removed.

Words are what ASCII white space separates, unchanged. Null texts are empty; texts of fewer words than a window keep all. Repeated rows
are copies of each other. Ranges find their rows by 128 bits of hash of the text, so doc_id may be null or shared by different texts.
Long words travel as a digest of 256 bits. No group of stretches and no slice of text is without a bound on its size, but for a single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import slices
from traceloom.llm.joins import BitTable, bit_table, small_side, text_keys
from traceloom.llm.subtrees import deep_leaves, subtrees
from traceloom.llm.suffixes import Hashed, anchored
from traceloom.llm.words import finish, hashes_of
from traceloom.session import cut_lineage

WINDOW = 35
GRAM = 8
MOST_STRETCHES = 4096  # unequal stretches of one prefix in a shard
SHARD_BYTES = 4 << 20
STRETCH_BYTES = 300  # of a packed stretch, to reckon shards with
BUFFER_BYTES = 16 << 20
SLICE = 4 << 20
LONG_WORD = 64
SEEN_STRETCHES = 300_000
ALL = 1 << 30
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
LEVELS = (WINDOW - GRAM).bit_length() + 1
REPEATS = "prefix long, content long, first int, last int"


def cells(level: int) -> list[tuple[int, int]]:
    """The ranges of places that the anchor can have in the windows of one prefix: at level 0 all, then halves, at last single places."""
    places = WINDOW - GRAM + 1
    edges = np.unique(np.linspace(0, places, min(places, 1 << level) + 1).astype(int)).tolist()
    return [(low, high - 1) for low, high in zip(edges[:-1], edges[1:], strict=True)]


def hashed_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in order, and where each text's words begin, with the total at the end."""
    return hashes_of([t.translate(SPACES) + b" " for t in raw])


def finer_stretches(found: dict[str, np.ndarray], hashed: Hashed, level: int) -> dict[str, np.ndarray]:
    """The parts of stretches that lie in the cells of a level, each with its longer prefix."""
    parts = []
    for number, (low, high) in enumerate(cells(level)):
        place = found["place"]
        start, last = np.maximum(found["start"], place - high), np.minimum(found["start"] + found["windows"] - 1, place - low)
        some = np.flatnonzero(last >= start)
        start, last, place = start[some], last[some], place[some]
        core = hashed.ranges(place - low, place + WINDOW - high) + np.uint64(level * 64 + number)
        content = hashed.ranges(start, last + WINDOW) ^ (place - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        columns = (found["text"][some], start, last - start + 1, place, finish(core ^ np.uint64(0xD6E8FEB86659FD93)), finish(content))
        parts.append(dict(zip(("text", "start", "windows", "place", "anchor", "content"), columns, strict=True)))
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text as bytes, h1, h2): the parts of a row that this operator reads."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns(text_keys(F.col("text")))


def prefix_counts(docs: DataFrame) -> DataFrame:
    """(prefix, times, low, high) of the anchors that occur several times; low and high are the least and greatest content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hashes, bounds = hashed_words(batch.column("text").to_pylist())
            found = anchored(Hashed(hashes), bounds, WINDOW, GRAM)
            yield pa.RecordBatch.from_arrays([pa.array(found[k].view(np.int64)) for k in ("anchor", "content")], names=["prefix", "content"])

    found = keyed(docs).select("text").mapInArrow(run, "prefix long, content long")
    counts = found.groupBy("prefix").agg(F.count(F.lit(1)).alias("times"), F.min("content").alias("low"), F.max("content").alias("high"))
    return cut_lineage(counts.where("times > 1"))


def stretches(docs: DataFrame, seen) -> DataFrame:
    """The stretches whose prefix is in a bit table; windows holds the place of the first window and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hashes, bounds = hashed_words(batch.column("text").to_pylist())
            found = anchored(Hashed(hashes), bounds, WINDOW, GRAM)
            at = np.flatnonzero(seen.value.holds(found["anchor"]))
            rows = pa.array(found["text"][at])
            columns = [batch.column("h1").take(rows), batch.column("h2").take(rows)]
            columns += [pa.array(found[k][at].view(np.int64)) for k in ("anchor", "content")]
            columns.append(pa.array((found["start"] - bounds[found["text"]])[at] << 32 | found["windows"][at]))
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "prefix", "content", "windows"])

    return keyed(docs).select("text", "h1", "h2").mapInArrow(run, "h1 long, h2 long, prefix long, content long, windows long")


def carried(words: list[bytes]) -> bytes:
    """Words joined by a space; long ones as a digest, which begins with a character that no word holds."""
    return b" ".join([w if len(w) <= LONG_WORD else b"\x0b" + hashlib.sha256(w).hexdigest().encode() for w in words])


def distinct_stretches(batches: Iterator[pa.RecordBatch], wanted: BitTable) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """(prefix, content, windows, place, words) of the stretches of a task whose prefix is wanted. Of equal ones there are two, the second
    without its words: that a stretch is there twice is all that its further copies could tell."""
    times: dict[tuple[int, int], int] = {}
    for batch in slices(batches, "text", SLICE):
        raw = batch.column("text").to_pylist()
        hashes, bounds = hashed_words(raw)
        found = anchored(Hashed(hashes), bounds, WINDOW, GRAM)
        chosen = wanted.holds(found["anchor"])
        columns = [found[k][chosen] for k in ("text", "anchor", "content", "start", "windows", "place")]
        if len(times) > SEEN_STRETCHES:
            times.clear()
        rows, words, of = [], [], -1
        for text, prefix, content, start, windows, place in zip(*(c.tolist() for c in columns), strict=True):
            before = times.get((prefix, content), 0)
            if before == 2:
                continue
            times[prefix, content] = before + 1
            if text != of:
                words, of, begin = raw[text].split(), text, int(bounds[text])
            part = b"" if before else carried(words[start - begin : start - begin + windows + WINDOW - 1])
            rows.append((prefix, content, windows, place - start, part))
        yield rows


def packed_shards(docs: DataFrame, mixed, shards: int) -> DataFrame:
    """The distinct stretches of mixed prefixes, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        size = 0
        for found in distinct_stretches(batches, mixed.value):
            for prefix, content, windows, _, words in found:
                rows.setdefault(prefix % shards, []).append((prefix, content, windows, words))
                size += 40 + len(words)
            if size > BUFFER_BYTES:
                yield packed_rows(rows)
                rows, size = {}, 0
        yield packed_rows(rows)

    return keyed(docs).select("text").mapInArrow(run, "shard long, stretches binary")


def hot_stretches(docs: DataFrame, hot) -> DataFrame:
    """The distinct stretches of prefixes that are to grow, each as a part of itself (of1, of2, offset 0), with the number of its occurrences: one or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in distinct_stretches(batches, hot.value):
            prefix, content, windows, place, words = zip(*found, strict=True) if found else ((), (), (), (), ())
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (prefix, content)]
            columns += [pa.array(c, pa.int32()) for c in (windows, place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.binary())], names=["of1", "of2", "windows", "place", "words"])

    found = keyed(docs).select("text").mapInArrow(run, "of1 long, of2 long, windows int, place int, words binary")
    once = found.groupBy("of1", "of2", "windows", "place").agg(F.count(F.lit(1)).alias("times"), F.max("words").alias("words"))
    return once.withColumn("offset", F.lit(0))


PART = "of1 long, of2 long, offset int, windows int, place int, times long, words binary, prefix long, content long"


def finer_parts(parts: DataFrame, level: int) -> DataFrame:
    """Parts of stretches cut by the cells of a level, with their prefix and content there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", SLICE):
            raw = [w.split(b" ") for w in batch.column("words").to_pylist()]
            hashes, bounds = hashes_of([b" ".join(w) + b" " for w in raw])
            begin = bounds[:-1]
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("offset", "windows", "place")}
            whole = {"text": np.arange(len(raw)), "start": begin, "windows": columns["windows"], "place": begin + columns["place"]}
            found = finer_stretches(whole, Hashed(hashes), level)
            rows, start = found["text"], found["start"] - begin[found["text"]]
            words = [b" ".join(raw[r][s : s + n + WINDOW - 1]) for r, s, n in zip(rows.tolist(), start.tolist(), found["windows"].tolist(), strict=True)]
            taken = [batch.column(k).take(pa.array(rows)) for k in ("of1", "of2", "times")]
            numbers = [columns["offset"][rows] + start, found["windows"], found["place"] - found["start"]]
            keys = [pa.array(found[k].view(np.int64)) for k in ("anchor", "content")]
            yield pa.RecordBatch.from_arrays([*taken[:2], *(pa.array(c.astype(np.int32)) for c in numbers), taken[2], pa.array(words, pa.binary()), *keys], names=[c.split()[0] for c in PART.split(", ")])

    return parts.select("of1", "of2", "offset", "windows", "place", "times", "words").mapInArrow(run, PART)


def grown(docs: DataFrame, hot) -> list[DataFrame]:
    """(prefix, content, first, last): the repeated windows of the stretches of hot prefixes, found with longer prefixes."""
    out = []
    parts = hot_stretches(docs, hot)
    for level in range(1, LEVELS + 1):
        finer = cut_lineage(finer_parts(parts, level))
        counts = finer.groupBy("prefix").agg(F.sum("times").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1")
        judged = cut_lineage(finer.join(small_side(cut_lineage(counts)), "prefix"))
        out.append(judged.where("low = high").selectExpr("of1 AS prefix", "of2 AS content", "offset AS first", "offset + windows - 1 AS last"))
        alone = judged.where(f"low <> high AND n <= {MOST_STRETCHES}")
        size = alone.agg(F.sum(F.octet_length("words").cast("long") + 40)).first()[0] or 0
        shard = F.pmod("prefix", F.lit(max(1, -(-size // SHARD_BYTES)))).alias("shard")
        out.append(cut_lineage(alone.select("*", shard).groupBy("shard").applyInPandas(resolve_parts, REPEATS)))
        parts = judged.where(f"low <> high AND n > {MOST_STRETCHES}")
        if parts.isEmpty():
            break
    return out


def packed_rows(rows: dict[int, list]) -> pa.RecordBatch:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    blobs = []
    for found in rows.values():
        found.sort(key=lambda r: r[0])  # stretches of one prefix are alike
        prefixes, contents, windows, texts = zip(*found, strict=True)
        head = np.array([len(found)], "<i8").tobytes() + b"".join(np.array(c, "<u8").tobytes() for c in (prefixes, contents))
        head += b"".join(np.array(c, "<i4").tobytes() for c in (windows, [len(t) for t in texts]))
        blobs.append(press(head + b"".join(texts)))
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "stretches"])


def unpacked_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    prefixes, contents = np.frombuffer(raw, "<u8", 2 * n, 8).reshape(2, n)
    windows, sizes = np.frombuffer(raw, "<i4", 2 * n, 8 + 16 * n).reshape(2, n)
    ends = 8 + 24 * n + np.cumsum(sizes, dtype=np.int64)
    return prefixes, contents, windows, [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def resolve_shard(group: pd.DataFrame) -> pd.DataFrame:
    """(prefix, content, first, last): the repeated windows of a shard's packed stretches as runs, from the suffix tree of each prefix."""
    rows = [unpacked_rows(blob) for blob in group["stretches"]]
    prefix, content, windows = (np.concatenate([r[k] for r in rows]) for k in range(3))
    words = [w for r in rows for w in r[3]]
    order = np.lexsort((np.array([not w for w in words]), content, prefix))  # of equal ones those with words come first
    prefix, content, windows = prefix[order], content[order], windows[order].astype(np.int64)
    fresh = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (content[1:] != content[:-1])])
    times = np.bincount(np.cumsum(fresh) - 1)
    prefix, content, windows = prefix[fresh], content[fresh], windows[fresh]
    who, first, last = repeated_runs([words[k] for k in order[fresh].tolist()], windows, prefix, times)
    return pd.DataFrame({"prefix": prefix[who].view(np.int64), "content": content[who].view(np.int64), "first": first.astype(np.int32), "last": last.astype(np.int32)})


def resolve_parts(group: pd.DataFrame) -> pd.DataFrame:
    """The same for parts of stretches, by the stretch and the offset they belong to."""
    windows, offset = (group[k].to_numpy(np.int64) for k in ("windows", "offset"))
    who, first, last = repeated_runs(group["words"].tolist(), windows, group["prefix"].to_numpy(), group["times"].to_numpy(np.int64))
    first, last = ((offset[who] + k).astype(np.int32) for k in (first, last))
    return pd.DataFrame({"prefix": group["of1"].to_numpy()[who], "content": group["of2"].to_numpy()[who], "first": first, "last": last})


def repeated_runs(words: list[bytes], windows: np.ndarray, prefix: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of windows that occur several times below their prefix: which stretch, and the offsets of the first and last window."""
    split = [w.split(b" ") for w in words]
    numbers: dict[bytes, int] = {}
    x = np.array([numbers.setdefault(w, len(numbers)) for part in split for w in part], np.int64)
    begins = np.concatenate([[0], np.cumsum([len(part) for part in split])])[:-1].astype(np.int64)
    owner = np.repeat(np.arange(len(split)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    nodes = subtrees(x, begins[owner] + offset, prefix[owner], WINDOW, times[owner])
    at = np.sort(deep_leaves(nodes, WINDOW))  # leaves are numbered by owner and offset
    breaks = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)])
    first, last = at[breaks[: len(at)]], at[np.append(breaks[1:], True)[: len(at)]]
    return owner[first], offset[first], offset[last]


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, object]:
    """(prefix, content, first, last): the repeated windows of stretches as runs of offsets, and the bit table of the prefixes to look at."""
    counts = prefix_counts(docs)
    mixed = counts.where(f"low <> high AND times <= {MOST_STRETCHES}")
    total = mixed.agg(F.sum("times")).first()[0] or 0
    shards = max(1, -(-total * STRETCH_BYTES // SHARD_BYTES))
    in_trees = cut_lineage(packed_shards(docs, bit_table(mixed.select("prefix"), "prefix"), shards).groupBy("shard").applyInPandas(resolve_shard, REPEATS))
    copies = counts.where("low = high").select("prefix", F.col("low").alias("content"), F.lit(0).alias("first"), F.lit(ALL).alias("last"))
    out = copies.unionAll(in_trees)
    hot = counts.where(f"low <> high AND times > {MOST_STRETCHES}").select("prefix")
    for more in grown(docs, bit_table(hot, "prefix")) if not hot.isEmpty() else []:
        out = out.unionAll(more)
    return out, bit_table(counts.select("prefix"), "prefix")


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(h1, h2, spans): of every text with a repeated window the maximal ranges of words to remove, as pairs of long packed in bytes."""
    repeats, seen = repeated_windows(docs)
    start, windows = F.shiftright("windows", 32), F.col("windows").bitwiseAND(0xFFFFFFFF)
    # a run's place and length, which spread a set's hashes; its two ends would nearly cancel in them
    run = F.shiftleft(start + F.col("first"), 32).bitwiseOR(F.least(F.col("last").cast("long"), windows - 1) - F.col("first"))
    found = stretches(docs, seen).join(repeats, ["prefix", "content"]).select("h1", "h2", run.alias("run"))
    gathered = found.groupBy("h1", "h2").agg(F.collect_set("run").alias("runs"))

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            flat = runs.flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            first = flat >> 32
            end = first + (flat & 0xFFFFFFFF) + WINDOW
            spans = [joined_ranges(first[a:b], end[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(spans, pa.binary())], names=["h1", "h2", "spans"])

    return gathered.mapInArrow(join_runs, "h1 long, h2 long, spans binary")


def joined_ranges(first: np.ndarray, end: np.ndarray) -> bytes:
    """The maximal ranges that overlapping or touching ranges make, as pairs of long."""
    by = np.argsort(first, kind="stable")
    first, reach = first[by], np.maximum.accumulate(end[by])
    breaks = np.flatnonzero(first[1:] > reach[:-1]) + 1
    return np.stack([first[np.concatenate([[0], breaks])], reach[np.concatenate([breaks - 1, [len(first) - 1]])]], axis=1).tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept) of every row: kept are the words that are left, joined by one space, in UTF-8."""
    ranges = cut_lineage(removed_ranges(docs)).select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), "spans")
    rows = keyed(docs)
    joined = rows.join(small_side(ranges), (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sizes, removed, counts, kept = [], [], [], []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                spans = np.frombuffer(packed or b"", np.int64).reshape(-1, 2).tolist()
                edges = [0, *(e for s in spans for e in s), len(words)]
                sizes.append(len(words))
                removed.append(sum(b - a for a, b in spans))
                counts.append(len(spans))
                kept.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]))
            columns = [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (sizes, removed, counts)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, n_spans long, kept binary")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs)
), repeated AS (
    SELECT words FROM windows GROUP BY words HAVING count(*) > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (words)
), placed AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

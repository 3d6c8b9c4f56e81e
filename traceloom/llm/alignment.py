"""Alignment of the tokens of two tokenizers over the same texts, by pointer jumping.

Both tokenizations of a text cover the same bytes. Every token points to the token of the other side that reaches farthest to the
right of those that overlap it; a token that ends where its counterpart ends is terminal. Doubling the pointers of all tokens of a
batch at once leads each to the terminal token of its component, which labels its group: the byte offsets where tokens of both sides
end cut the tokens into groups.

All pairs of tokens (a, b) of one group are links. How many texts hold a pair of ids linked is counted over the whole corpus: distinct
pairs per text are added up in the task before they move, pairs of ids are few next to tokens. The counts come back to the texts as
slices of bounded size, each sent to the tasks that read the encoded texts; a text's figures are sums over the slices.

Texts are tokenized once and written with their ids and group sizes to the shared folder. Null and empty texts, and those one side does
not give back byte by byte, have no tokens. Repeated rows count as texts of their own. Groups of any size are worked through in parts of
``MOST_LINKS`` pairs of distinct ids.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, worker_state
from traceloom.session import cut_lineage, scratch_path

SLICE = 1 << 20
MOST_LINKS = 1 << 20  # pairs in work at once
HELD_PAIRS = 1 << 21  # distinct pairs a task adds up before it gives them on
COUNT_SLICE = 2_000_000  # counted pairs sent to the tasks at once, 32 to 64 bytes each
ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, in_a binary, in_b binary"


class Side(NamedTuple):
    """One tokenizer: ids of texts, and the bytes of every id."""

    encode: Callable[[list[str]], list]
    pieces: list[bytes]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_side(data: bytes, plain_ranks: bool) -> Side:
    """A byte-level vocabulary in JSON; a space goes before each text, and special tokens in a text are plain text.

    With ``plain_ranks`` (see ``merges_follow_ranks``) the ids come from the faster library, which knows ranks only.
    """
    import public_tokenizers

    if plain_ranks:
        import tiktoken

        ranks = byte_ranks(json.loads(data))
        model = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, at in ranks.items():
            pieces[at] = piece
        return Side(lambda texts: [model.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], pieces)
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_str(data.decode())
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    letters = byte_letters()
    pieces = [b""] * library.get_vocab_size()
    for token, at in library.get_vocab().items():
        pieces[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return Side(lambda texts: [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)], pieces)


def byte_ranks(vocabulary: dict) -> dict[bytes, int]:
    """Ids of the bytes of all entries but special tokens."""
    letters = byte_letters()
    special = {t["content"] for t in vocabulary.get("added_tokens") or []}
    return {bytes(letters[c] for c in token): at for token, at in vocabulary["model"]["vocab"].items() if token not in special and all(c in letters for c in token)}


def merges_follow_ranks(data: bytes) -> bool:
    """Whether merging any two neighbours that make an entry, least id first, gives what the vocabulary's list of merges gives.

    So it is if the ids of the merged entries ascend with the list, if all entries are single bytes or merged ones, and if the entries
    of lower ids make of each entry's bytes the very two that the list merges: then no other pair can ever come to stand for it. Also the
    vocabulary must split texts by the common pattern and do nothing else to them.
    """
    vocabulary = json.loads(data)
    model, before = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    splits = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    extras = [vocabulary.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges")]
    if not splits or any(extras):
        return False
    letters, ranks = byte_letters(), byte_ranks(vocabulary)
    pairs = [tuple(bytes(letters[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    made = [ranks.get(a + b, -1) for a, b in pairs]
    if made != sorted(made) or len(set(made)) + 256 != len(ranks) or any(bytes([b]) not in ranks for b in range(256)) or min(made, default=256) < 256:
        return False
    return all(merged(a + b, ranks, at) == [a, b] for (a, b), at in zip(pairs, made, strict=True))


def merged(raw: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """What the entries below an id make of bytes."""
    parts = [raw[k : k + 1] for k in range(len(raw))]
    while True:
        found = [(ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))]
        least, k = min(found, default=(below, 0))
        if least >= below:
            return parts
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def piece_side(data: bytes) -> Side:
    """A vocabulary of pieces that puts a space before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces = []
    for at in range(model.get_piece_size()):
        piece = model.id_to_piece(at)
        pieces.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(at) else piece.replace("▁", " ").encode())
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


class Tokens(NamedTuple):
    """The tokens of one side of many texts: ids, byte offsets where they end in all texts put together, and the first token of each text."""

    ids: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def tokens_of(ids: list[list[int]] | list[np.ndarray], lengths: np.ndarray) -> Tokens:
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(i, np.int64) for i in ids)])
    return Tokens(flat, np.cumsum(lengths[flat]), np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]))


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place where each token's group ends, for the tokens of both sides, by doubling successors.

    The token of the other side that overlaps [s, e) and reaches farthest is the one that holds byte e - 1. Tokens are not empty.
    """
    n = len(a_ends)
    to_b = n + np.searchsorted(b_ends, a_ends)  # ends never lie before the byte
    to_a = np.searchsorted(a_ends, b_ends)
    ends = np.concatenate([a_ends, b_ends])
    successor = np.concatenate([to_b, to_a])
    own = np.arange(len(ends))
    successor = np.where(ends[successor] > ends, successor, own)
    open_ = np.flatnonzero(successor != own)
    while len(open_):
        further = successor[successor[open_]]
        open_, further = open_[further != successor[open_]], further[further != successor[open_]]
        successor[open_] = further
    return ends[successor[:n]], ends[successor[n:]]


class Groups(NamedTuple):
    """Groups of aligned tokens in order: the tokens of either side before each group, with the totals at the end, and the text of each group."""

    a: np.ndarray
    b: np.ndarray
    text: np.ndarray


def groups_of(a: Tokens, b: Tokens) -> Groups:
    """No group spans two texts, for both sides end with the text."""
    starts = []
    for last in terminals(a.ends, b.ends):  # groups follow each other on both sides
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])[: len(last)])
        starts.append(np.append(heads, len(last)))
    return Groups(starts[0], starts[1], np.searchsorted(a.bounds, starts[0][:-1], side="right") - 1)


def group_texts(a: Tokens, b: Tokens, groups: Groups, names: tuple[list[str], int]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text; ``names`` are those of ``Both.names``."""
    written, of_b_side = names
    x, y = np.diff(groups.a), np.diff(groups.b)
    of_a, of_b = np.repeat(np.arange(len(x)), x), np.repeat(np.arange(len(y)), y)
    code = np.empty(len(a.ids) + len(b.ids), np.int64)
    at_a, at_b = np.arange(len(a.ids)) + groups.b[of_a], np.arange(len(b.ids)) + groups.a[of_b + 1]
    code[at_a], code[at_b] = 2 * a.ids, of_b_side + 2 * b.ids
    code[at_a[groups.a[1:] - 1]] += 1  # the last of its side in a group
    code[at_b[groups.b[1:] - 1]] += 1
    flat = [written[k] for k in code.tolist()]
    bounds = (a.bounds + b.bounds).tolist()
    return ["".join(flat[s:e])[:-1] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def links_of(a: Tokens, b: Tokens, groups: Groups, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pair, times) of all links, a pair being a * ``width`` + b, in parts of about ``MOST_LINKS``.

    Small groups give each occurrence of a link, large ones each pair of distinct ids once with the number of its occurrences.
    """
    x, y = np.diff(groups.a), np.diff(groups.b)
    links = x * y
    single = np.flatnonzero(links == 1)
    if len(single):
        pair = a.ids[groups.a[single]] * width + b.ids[groups.b[single]]
        yield groups.text[single], pair, np.ones(len(single), np.int64)
    small = np.flatnonzero((links > 1) & (links <= MOST_LINKS))
    parts = np.cumsum(links[small]) // MOST_LINKS
    for first, last in _runs(parts):
        chosen = small[first:last]
        n = links[chosen]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        height = np.repeat(y[chosen], n)
        one = a.ids[np.repeat(groups.a[chosen], n) + at // height]
        two = b.ids[np.repeat(groups.b[chosen], n) + at % height]
        yield np.repeat(groups.text[chosen], n), one * width + two, np.ones(len(one), np.int64)
    for g in np.flatnonzero(links > MOST_LINKS).tolist():
        one, of_one = np.unique(a.ids[groups.a[g] : groups.a[g + 1]], return_counts=True)
        two, of_two = np.unique(b.ids[groups.b[g] : groups.b[g + 1]], return_counts=True)
        step = max(1, MOST_LINKS // len(two))
        for k in range(0, len(one), step):
            pair = (one[k : k + step, None] * width + two).ravel()
            yield np.full(len(pair), groups.text[g]), pair, (of_one[k : k + step, None] * of_two).ravel()


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    edges = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True))


def distinct_pairs(a: Tokens, b: Tokens, groups: Groups, width: int, span: int) -> np.ndarray:
    """The pairs of ids that each text links, once per text; pairs lie below ``span``."""
    keys = [np.unique(text * span + pair) for text, pair, _ in links_of(a, b, groups, width)]
    if len(keys) > 1:  # a text may lie in several parts
        keys = [np.unique(np.concatenate(keys))]
    return keys[0] % span if keys else np.zeros(0, np.int64)


class PairCounts:
    """Numbers of texts by pair, added up in sorted arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.pairs, self.times, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, pairs: np.ndarray) -> None:
        self.waiting.append(pairs)
        self.size += len(pairs)
        if self.size > HELD_PAIRS:
            self.settle()

    def settle(self) -> None:
        fresh, times = np.unique(np.concatenate([np.zeros(0, np.int64), *self.waiting]), return_counts=True)
        pairs = np.concatenate([self.pairs, fresh])
        by = np.argsort(pairs, kind="stable")
        pairs, times = pairs[by], np.concatenate([self.times, times])[by]
        heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)])
        self.pairs, self.times = pairs[heads], np.add.reduceat(times, heads) if len(heads) else times
        self.waiting, self.size = [], 0


class Both:
    """The two tokenizers of a worker."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.lengths = [np.array([len(p) for p in side.pieces], np.int64) for side in self.sides]
        self.kinds = ["<u2" if len(side.pieces) <= 1 << 16 else "<u4" for side in self.sides]
        marked = [[f"{i}{mark}" for i in range(len(side.pieces)) for mark in marks] for side, marks in ((a, ",|"), (b, ",;"))]
        self.names = marked[0] + marked[1], len(marked[0])

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Both sides' ids of each text, packed; none if the text is empty or a side does not give it back."""
        full = [k for k, t in enumerate(texts) if t]
        out = ([b""] * len(texts), [b""] * len(texts))
        found = [side.encode([texts[k] for k in full]) if full else [] for side in self.sides]
        for k, *both in zip(full, *found, strict=True):
            raw = (" " + texts[k]).encode("utf-8", "surrogatepass")
            if all(b"".join([side.pieces[i] for i in ids]) == raw for side, ids in zip(self.sides, both, strict=True)):
                for side, ids, kind in zip(out, both, self.kinds, strict=True):
                    side[k] = np.array(ids, kind).tobytes()
        return out


def sent(docs: DataFrame, a_file: str, b_file: str):
    """The two vocabulary files, read once on the driver and sent to the tasks; their size does not follow the corpus."""
    data = []
    for path in (a_file, b_file):
        with open(path, "rb") as f:
            data.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(data))


def encoded(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Every row's ids of both sides, its figures and groups, written to the shared folder and read from there. ``row`` tells rows apart."""
    from pyspark import TaskContext

    shared = sent(docs, a_file, b_file)
    plain_ranks = merges_follow_ranks(shared.value[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = worker_state(("alignment", a_file, b_file), lambda: Both(byte_level_side(shared.value[0], plain_ranks), piece_side(shared.value[1])))
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SLICE, keep_state=True):
            n = batch.num_rows
            ids = both.encode([t or "" for t in batch.column("text").to_pylist()])
            a, b = (tokens_of([np.frombuffer(i, kind) for i in side], lengths) for side, kind, lengths in zip(ids, both.kinds, both.lengths, strict=True))
            groups = groups_of(a, b)
            edges = np.searchsorted(groups.text, np.arange(n + 1)).tolist()
            links = np.bincount(groups.text, np.diff(groups.a) * np.diff(groups.b), n).astype(np.int64) if len(groups.text) else np.zeros(n, np.int64)
            written = group_texts(a, b, groups, both.names)
            columns = [
                pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(np.diff(a.bounds)), pa.array(np.diff(b.bounds)),
                pa.array(np.bincount(groups.text, minlength=n)), pa.array(links),
                pa.array([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]),
                *(pa.array(side, pa.binary()) for side in ids),
                *(pa.array([sizes[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for sizes in (np.diff(groups.a).astype("<u4"), np.diff(groups.b).astype("<u4"))),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "in_a", "in_b"])

    path = scratch_path(docs.sparkSession, "aligned")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(run, ENCODED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


class Lengths(NamedTuple):
    a: np.ndarray
    b: np.ndarray
    a_kind: str
    b_kind: str


def lengths_of(a_file: str, b_file: str) -> Lengths:
    """How many bytes each id of either side stands for."""
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        both = Both(byte_level_side(f.read(), False), piece_side(g.read()))
    return Lengths(*both.lengths, *both.kinds)


def aligned(batch: pa.RecordBatch, lengths: Lengths) -> tuple[Tokens, Tokens, Groups]:
    """The alignment of a batch of encoded rows."""
    a = tokens_of([np.frombuffer(i, lengths.a_kind) for i in batch.column("a").to_pylist()], lengths.a)
    b = tokens_of([np.frombuffer(i, lengths.b_kind) for i in batch.column("b").to_pylist()], lengths.b)
    x, y = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(s, "<u4") for s in batch.column(k).to_pylist())]).astype(np.int64) for k in ("in_a", "in_b"))
    a_first = np.concatenate([[0], np.cumsum(x)])
    return a, b, Groups(a_first, np.concatenate([[0], np.cumsum(y)]), np.searchsorted(a.bounds, a_first[:-1], side="right") - 1)


class PairTable:
    """Numbers by pair in an open hash table, looked up for many pairs at once."""

    def __init__(self, pairs: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slot = self.first(pairs)
        while len(pairs):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = pairs[free]  # of several for one slot, one gets it
            placed = self.keys[slot] == pairs
            self.values[slot[placed]] = values[placed]
            pairs, values, slot = pairs[~placed], values[~placed], slot[~placed] + 1 & (1 << self.bits) - 1

    def first(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The value of each pair, 0 if it has none."""
        out, at, slot = np.zeros(len(pairs), np.int64), np.arange(len(pairs)), self.first(pairs)
        while len(at):
            here = self.keys[slot]
            hit = here == pairs[at]
            out[at[hit]] = self.values[slot[hit]]
            on = np.flatnonzero(~hit & (here >= 0))
            at, slot = at[on], slot[on] + 1 & (1 << self.bits) - 1
        return out


def pair_counts(rows: DataFrame, lengths: Lengths) -> DataFrame:
    """(a, b, times, best) of every pair of ids that some text links: in how many texts, and whether no other pair of a is in more."""
    width, span = len(lengths.b), len(lengths.a) * len(lengths.b)
    shared = rows.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts()

        def found() -> pa.RecordBatch:
            counts.settle()
            out = pa.RecordBatch.from_arrays([pa.array(counts.pairs), pa.array(counts.times)], names=["pair", "times"])
            counts.clear()
            return out

        for batch in slices(batches, "a", SLICE):
            counts.add(distinct_pairs(*aligned(batch, shared.value), width, span))
            if len(counts.pairs) > HELD_PAIRS:
                yield found()
        yield found()

    pairs = rows.select("a", "b", "in_a", "in_b").mapInArrow(run, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("times"))
    split = pairs.select(F.floor(F.col("pair") / width).cast("int").alias("a"), F.pmod("pair", F.lit(width)).cast("int").alias("b"), "times")
    # an id of a has at most as many partners as the vocabulary of b has entries
    return cut_lineage(split.withColumn("best", F.col("times") == F.max("times").over(Window.partitionBy("a"))))


def link_sums(rows: DataFrame, lengths: Lengths, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every row, added up over slices of the counts."""
    width = len(lengths.b)
    context = rows.sparkSession.sparkContext
    total = counts.count()
    parts = max(1, -(-total // COUNT_SLICE))
    shared = context.broadcast(lengths)
    sums = None
    for part in range(parts):
        of_part = counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part) if parts > 1 else counts
        table = of_part.select((F.col("a") * F.lit(width).cast("long") + F.col("b")).alias("pair"), "times", "best").toArrow()
        slice_ = context.broadcast(PairTable(table["pair"].to_numpy(), 2 * table["times"].to_numpy() + table["best"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], slice_=slice_) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "a", SLICE):
                n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for text, pair, links in links_of(*aligned(batch, shared.value), width):
                    value = slice_.value.of(pair)
                    np.add.at(n_best, text, links * (value & 1))
                    np.add.at(count_sum, text, links * (value >> 1))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_best), pa.array(count_sum)], names=["row", "n_best", "count_sum"])

        found = rows.select("row", "a", "b", "in_a", "in_b").mapInArrow(run, "row long, n_best long, count_sum long")
        sums = found if sums is None else sums.unionAll(found)
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a, b) of every row.

    a and b are the ids of both sides as little-endian numbers of two bytes, or four for a vocabulary of over 65,536. n_best counts the
    links whose pair is in as many texts as the best pair of its a anywhere, count_sum adds up these numbers over all links.
    """
    rows = encoded(docs, a_file, b_file)
    lengths = lengths_of(a_file, b_file)
    sums = link_sums(rows, lengths, pair_counts(rows, lengths))
    own = sums.withColumnRenamed("row", "of_row")
    joined = rows.join(own, rows["row"] == own["of_row"])
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "a", "b")

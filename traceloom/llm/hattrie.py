"""Counting of short word sequences in a trie of word ids with hash containers, whose subtrees leave it as sorted runs.

The root deals sequences to slots by a hash of their prefix (the first two words; the third only spreads a prefix over a few slots, so
that no pair of words fills a slot alone). Below it a container is a hash table from sequence to count; one that outgrows ``BURST``
bursts into a node over the next bits of the word ids. A task keeps at most ``MOST_ENTRIES`` sequences; beyond that its largest slots
leave, each as one run: the run's own words in byte order, and the sequences as ranks of them, sorted, with their counts.

Ids are the task's own and exact: a sequence of up to three words is one 63-bit number. A run names its words, so runs of different
tasks merge without a common vocabulary.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 3  # in a sequence at most
BITS = 21  # of a word id
MOST_WORDS = (1 << BITS) - 1
MOST_ENTRIES = 2_000_000
BURST = 1 << 16
FANOUT_BITS = 4
SPREAD = 16  # slots a prefix can reach
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
LOW = np.int64(MOST_WORDS)
ENDS = (b"\n", b".")  # as words, they end a piece


class Node:
    """A burst container: children by the next bits, from the first word's lowest up."""

    __slots__ = ("children", "shift")

    def __init__(self, level: int):
        word, digit = divmod(level * FANOUT_BITS, BITS - BITS % FANOUT_BITS)
        self.shift = BITS * (WORDS - 1 - word) + digit
        self.children: list = [Counter() for _ in range(1 << FANOUT_BITS)]


def insert(container, level: int, keys: np.ndarray):
    """Count ``keys`` below a container or node; gives what stands there afterwards."""
    if isinstance(container, Node):
        slot = (keys >> container.shift).astype(np.uint16) & ((1 << FANOUT_BITS) - 1)
        order = np.argsort(slot, kind="stable")
        edges = np.searchsorted(slot[order], np.arange(len(container.children) + 1))
        keys = keys[order]
        for at, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if begin < end:
                container.children[at] = insert(container.children[at], level + 1, keys[begin:end])
        return container
    container.update(keys.tolist())
    # two words are told apart by their ids' bits; what shares them all stays one container
    if len(container) <= BURST or (level + 1) * FANOUT_BITS > WORDS * (BITS - BITS % FANOUT_BITS):
        return container
    node = Node(level)
    for key, times in container.items():
        node.children[key >> node.shift & (1 << FANOUT_BITS) - 1][key] = times
    return node


def containers(at) -> list[Counter]:
    return [c for child in at.children for c in containers(child)] if isinstance(at, Node) else [at]


class LocalWords(dict):
    """Ids of the words of one label, drawn from a common list of names; unseen words get the next id."""

    def __init__(self, names: list[bytes], label: bytes):
        self.names, self.label = names, label
        self.update(dict.fromkeys(ENDS, 0))

    def __missing__(self, word: bytes) -> int:
        self.names.append(word + b" " + self.label)
        self[word] = at = len(self.names) - 1
        return at


class HatTrie:
    """Counts of the sequences of one to ``WORDS`` words in streams of words."""

    def __init__(self, slots: int):
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.names: list[bytes] = [b""]  # id 0 stands for no word
        self.hashes = np.zeros(1, np.uint64)
        self.order: list[int] = []  # ids by their names' bytes, as of the last spill
        self.words: dict[bytes, LocalWords] = {}
        self.roots: list = [Counter() for _ in range(self.slots)]

    def count(self, label: bytes, words: list[bytes], before: int) -> list[tuple[int, bytes]]:
        """Count the sequences that end in ``words`` after the first ``before``; gives the runs that had to leave.

        A word of ``ENDS`` ends a piece: no sequence holds it.
        """
        out = []
        if len(self.names) + len(words) > MOST_WORDS:
            out = self.spill(0)
            self.clear()
        if label not in self.words:
            self.words[label] = LocalWords(self.names, label)
        known = self.words[label]
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        keys = []
        for size in range(1, WORDS + 1):
            n = len(ids) - size + 1
            first = max(0, before - size + 1)
            if n <= first:
                continue
            parts = [ids[first + k : k + n] for k in range(size)]
            key, whole = np.zeros(n - first, np.int64), np.ones(n - first, bool)
            for k, part in enumerate(parts):
                key |= part << BITS * (WORDS - 1 - k)
                whole &= part > 0
            keys.append(key[whole])
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        if len(flat):
            slot = self.slot_of(flat)
            order = np.argsort(slot, kind="stable")
            flat, slot = flat[order], slot[order]
            begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(flat)], strict=True):
                at = int(slot[begin])
                self.roots[at] = insert(self.roots[at], 0, flat[begin:end])
        return out + self.spill(MOST_ENTRIES)

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each sequence: a hash of its words' bytes, so the same in every task."""
        from xxhash import xxh64_intdigest

        if len(self.hashes) < len(self.names):
            fresh = [xxh64_intdigest(name) for name in self.names[len(self.hashes) :]]
            self.hashes = np.concatenate([self.hashes, np.array(fresh, np.uint64)])
        one, two, three = (self.hashes[keys >> BITS * k & LOW] for k in (2, 1, 0))
        prefix = (one * MIX[0] ^ (two * MIX[1] >> np.uint64(7))) * MIX[2]
        spread = three * MIX[0] >> np.uint64(60)  # SPREAD values
        slot = (prefix >> np.uint64(20)) + spread
        return (slot % np.uint64(self.slots)).astype(np.uint16 if self.slots <= 1 << 16 else np.uint32)

    def spill(self, most: int) -> list[tuple[int, bytes]]:
        """With more than ``most`` sequences held, runs of the largest slots until half of that is left."""
        sizes = [sum(map(len, containers(root))) for root in self.roots]
        held, out = sum(sizes), []
        if held <= most:
            return out
        self.order += range(len(self.order) + 1, len(self.names))
        self.order.sort(key=self.names.__getitem__)  # the sort goes on from what is in order already
        names = pa.array([self.names[k] for k in self.order], pa.binary())
        rank, place = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), np.int64)
        rank[self.order] = np.arange(1, len(self.names))
        for at in sorted(range(self.slots), key=lambda k: -sizes[k]):
            if held <= most // 2 or not sizes[at]:
                break
            out.append((at, run_of(self.roots[at], names, rank, place)))
            self.roots[at] = Counter()
            held -= sizes[at]
        return out


def run_of(root, names: pa.BinaryArray, rank: np.ndarray, place: np.ndarray) -> bytes:
    """A subtree as a sorted run; ``names`` are all words in byte order, ``rank`` the place there of each id. What it takes follows the
    run and not all words: ``place`` is room to number the run's own in, of which only these are touched."""
    found = containers(root)
    keys = np.concatenate([np.fromiter(c, np.int64, len(c)) for c in found])
    times = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in found])
    key = np.zeros(len(keys), np.int64)
    for shift in range(BITS * (WORDS - 1), -1, -BITS):
        key |= rank[keys >> shift & LOW] << shift
    by = np.argsort(key)
    key = key[by]
    columns = [key >> shift & LOW for shift in range(BITS * (WORDS - 1), -1, -BITS)]
    used = np.sort(np.concatenate([[0], *columns]))
    used = used[1:][used[1:] > used[:-1]]  # without 0, no word
    place[used] = np.arange(1, len(used) + 1)
    return packed_run(names.take(pa.array(used - 1)), [place[c] for c in columns], times[by])


def packed_run(names: pa.BinaryArray, columns: list[np.ndarray], times: np.ndarray) -> bytes:
    import zstandard

    kind = "<u2" if len(names) < 1 << 16 else "<u4"
    wide = np.dtype(np.min_scalar_type(int(times.max(initial=0)))).itemsize
    head = np.array([len(names), len(times), wide], "<i8").tobytes()
    ends = np.frombuffer(names.buffers()[1], "<i4", len(names) + 1, 4 * names.offset)
    sizes, letters = np.diff(ends).tobytes(), (names.buffers()[2] or b"")[ends[0] : ends[-1]]
    steps = [np.diff(columns[0], prepend=0), *columns[1:]]  # the first words ascend
    body = b"".join(s.astype(kind).tobytes() for s in steps) + times.astype(f"<u{wide}").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, sizes, letters, body]))


def unpacked_run(blob: bytes) -> tuple[pa.BinaryArray, list[np.ndarray], np.ndarray]:
    """Names in byte order, the ranks of each place (0: no word) and the counts."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    names_count, n, wide = np.frombuffer(raw, "<i8", 3).tolist()
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i4", names_count, 24))]).astype(np.int32)
    begin = 24 + 4 * names_count
    at = begin + int(ends[-1])
    names = pa.BinaryArray.from_buffers(pa.binary(), names_count, [None, pa.py_buffer(ends), pa.py_buffer(raw).slice(begin, at - begin)])
    kind = np.dtype("<u2" if names_count < 1 << 16 else "<u4")
    columns = [np.frombuffer(raw, kind, n, at + k * n * kind.itemsize) for k in range(WORDS)]
    return names, columns, np.frombuffer(raw, f"<u{wide}", n, at + WORDS * n * kind.itemsize)


def merged_runs(blobs: list[bytes]) -> tuple[pa.BinaryArray, list[np.ndarray], np.ndarray]:
    """The runs of one slot as one: sorted runs over a common ranking of words, merged, equal sequences added up."""
    runs = [unpacked_run(b) for b in blobs]
    numbered = pa.chunked_array([r[0] for r in runs]).dictionary_encode()  # the chunks share one dictionary
    names = numbered.chunk(0).dictionary
    order = pc.array_sort_indices(names)
    names = names.take(order)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(names) + 1)
    bits = max(1, len(names).bit_length())
    one_key = WORDS * bits <= 63
    keys, times, thirds = [], [], []
    for numbers, (_, columns, counts) in zip(numbered.chunks, runs, strict=True):
        to = np.concatenate([[0], rank[numbers.indices.to_numpy()]])
        pair = to[np.cumsum(columns[0], dtype=np.int64)] << bits | to[columns[1]]
        keys.append(pair << bits | to[columns[2]] if one_key else pair)
        thirds.append(np.zeros(0, np.int64) if one_key else to[columns[2]])
        times.append(counts.astype(np.int64))
    del runs, numbered, rank
    key, total = np.concatenate(keys), np.concatenate(times)
    del keys, times
    if not one_key:  # so many words that their ranks do not fit side by side: rank the pairs first
        pairs, key = np.unique(key, return_inverse=True)
        key = key << 31 | np.concatenate(thirds)
    by = np.argsort(key, kind="stable")  # a merge sort that goes on from the runs' own order
    key, total = key[by], total[by]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    key, total = key[heads], np.add.reduceat(total, heads) if len(heads) else total
    low = (1 << bits) - 1
    pair, third = (key >> bits, key & low) if one_key else (pairs[key >> 31], key & (1 << 31) - 1)
    return names, [pair >> bits, pair & low, third], total

"""Byte-level BPE encoding and decoding, contracted by recursive DuckDB queries inside each partition.

A partition's texts are cut into pattern matches; each distinct match that is no token of its own becomes rows (word, position,
token). One recursive query joins neighbouring rows with the merge table, contracts the leftmost pair of least rank of every word
and goes on until no word has a pair left. Decoding joins a word's rows with the vocabulary and concatenates in position order.

Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded each. Texts are never cut: a match of any
length is one word of the query. Memory is bounded by the slice of text in work (``batches.SLICE_BYTES``), the words per query
(``WORDS_PER_QUERY``, or one longer word) and the memo of known words (``MEMO_WORDS``, emptied when full).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, texts, worker_state

WORDS_PER_QUERY = 30_000
BYTES_PER_QUERY = 1 << 20
MEMO_WORDS = 450_000
ENCODED = "doc_id long, ids binary, decoded binary"

# A row's key is its word and its position. Rows of words that still have a pair go round; a word without one leaves as done.
# ``own`` is a pair's rank and position in one number, so its least value is the leftmost pair of least rank.
CONTRACT = """
WITH RECURSIVE state(k, tok, done) AS (
    SELECT (w::BIGINT << 32) + i, tok, false FROM start
    UNION ALL
    (
        WITH pairs AS MATERIALIZED (
            SELECT p.k, p.tok, p.before, (m.merged::BIGINT << 32) + (p.k & 4294967295) AS own
            FROM (SELECT k, tok, lead(tok) OVER o AS after, lead(k) OVER o AS next, lag(k) OVER o AS before
                  FROM state WHERE NOT done WINDOW o AS (ORDER BY k)) p
            LEFT JOIN merges m ON m.a = p.tok AND m.b = p.after AND (p.next >> 32) = (p.k >> 32)
        ), least_pair AS (
            SELECT k >> 32 AS w, min(own) AS best FROM pairs GROUP BY 1
        )
        SELECT p.k, CASE WHEN p.own = l.best THEN (p.own >> 32)::INTEGER ELSE p.tok END, l.best IS NULL
        FROM pairs p JOIN least_pair l ON (p.k >> 32) = l.w
        WHERE l.best IS NULL OR p.before IS NULL OR p.before <> (l.w << 32) + (l.best & 4294967295)
    )
)
SELECT s.k >> 32 AS w, list(s.tok ORDER BY s.k) AS ids, string_agg(v.hex, '' ORDER BY s.k) AS bytes
FROM state s JOIN vocab v ON v.tok = s.tok WHERE s.done GROUP BY 1 ORDER BY 1
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Every way to make a token of two tokens: (left, right, made)."""
    rows = []
    for token, made in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.append((left, right, made))
    return rows


class Contractor:
    """The merge table and vocabulary of one rank file in a private in-memory database."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # ids
        self.decoded: dict[str, bytes] = {}  # only of words that would not decode to themselves
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        merges = np.array(merge_rows(ranks), np.int32).reshape(-1, 3)
        self.put("merges_rows", {"a": merges[:, 0], "b": merges[:, 1], "merged": merges[:, 2]})
        self.put("vocab_rows", {"tok": np.array(list(ranks.values()), np.int32), "hex": [t.hex() for t in ranks]})
        self.db.execute("CREATE TABLE merges AS FROM merges_rows")
        self.db.execute("CREATE TABLE vocab AS FROM vocab_rows")

    def put(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def learn(self, words: list[str]) -> None:
        """Encode and decode distinct words, so that ``known`` holds the bytes of their ids."""
        rest: list[tuple[str, bytes]] = []
        size = 0
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.known[word] = rank.to_bytes(4, "little")
                continue
            rest.append((word, raw))
            size += len(raw)
            if len(rest) >= WORDS_PER_QUERY or size >= BYTES_PER_QUERY:
                self.contract(rest)
                rest, size = [], 0
        if rest:
            self.contract(rest)

    def contract(self, words: list[tuple[str, bytes]]) -> None:
        sizes = np.array([len(raw) for _, raw in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        i = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tokens = self.of_byte[np.frombuffer(b"".join(raw for _, raw in words), np.uint8)]
        self.put("start", {"w": w, "i": i.astype(np.int32), "tok": tokens})
        found = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("start")
        ids = found["ids"].combine_chunks()
        flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
        ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        begin = 0
        for (word, raw), end, text in zip(words, ends.tolist(), found["bytes"].to_pylist(), strict=True):
            self.known[word] = flat[begin:end].tobytes()
            if (decoded := bytes.fromhex(text)) != raw:
                self.decoded[word] = decoded
            begin = end

    def encode(self, batch: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text as little-endian words of four bytes, and the bytes those ids decode to."""
        pieces = [self.find(t) for t in batch]
        new = set().union(*pieces) if pieces else set()
        if len(self.known) + len(new) > MEMO_WORDS:
            self.known.clear()
            self.decoded.clear()
        self.learn([w for w in new if w not in self.known])
        known, decoded = self.known, self.decoded
        ids = [b"".join([known[w] for w in p]) for p in pieces]
        if not decoded:  # every word's ids decode to its own bytes
            return ids, ["".join(p).encode("utf-8", "surrogatepass") for p in pieces]
        return ids, [b"".join([decoded[w] if w in decoded else w.encode("utf-8", "surrogatepass") for w in p]) for p in pieces]


def contractor(rank_bytes: bytes, pattern: str) -> Contractor:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_bytes.splitlines())}
    return Contractor(ranks, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned words of four bytes.

    The rank file is read once on the driver and sent to the tasks; its size is that of the vocabulary, whatever the corpus.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(("byte bpe", rank_file, pattern), lambda: contractor(shared.value, pattern))
        for batch in slices(batches, "text", keep_state=True):
            ids, decoded = coder.encode(texts(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded bytes."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

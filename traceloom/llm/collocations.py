"""Phrase collocations per language, from exact counts of all short word sequences.

Every task counts the sequences of one to three words of its texts in a trie with hash containers (``hattrie``); what outgrows its
memory leaves as sorted runs by prefix slot, and the runs of a slot merge in one task. Slots follow the bytes of all texts, so a slot
does not grow with the corpus. A sequence of any frequency is one entry per run. From the sequences that occur often enough the scores
follow by joins.

A text, ASCII letters in lower case, is cut into pieces at ``.,;:!?`` and line ends, a piece into words at spaces and tabs. Null texts are
empty, a null lang is ``und``; repeated rows count each. Long texts are read in segments that carry the last words over, so no sequence is
lost at a cut. No rows, no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.batches import give_back, slices
from traceloom.llm.hattrie import WORDS, HatTrie, merged_runs
from traceloom.session import cut_lineage

SLOT_BYTES = 10 << 20  # text bytes per slot
SEGMENT = 2 << 20
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LETTERS = bytes(b + 32 if 65 <= b <= 90 else 10 if b in PIECE_ENDS else 32 if b == 9 else b for b in range(256))
RUNS = "slot int, run binary"
COUNTED = "lang binary, size int, phrase binary, f long"


def segments(raw: bytes) -> Iterator[bytes]:
    """Parts of at most ``SEGMENT`` bytes, cut at a separator; a longer word makes a longer part."""
    at = 0
    while len(raw) - at > SEGMENT:
        cut = max(raw.rfind(b" ", at, at + SEGMENT), raw.rfind(b"\n", at, at + SEGMENT))
        if cut <= at:
            found = [p for p in (raw.find(b" ", at + SEGMENT), raw.find(b"\n", at + SEGMENT)) if p >= 0]
            if not found:
                break
            cut = min(found)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def counted_runs(docs: DataFrame, slots: int) -> DataFrame:
    """The sorted runs (slot, run) of all tasks."""

    def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([s for s, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, by_lang, words, carried = HatTrie(slots), {}, [], []
        for batch in slices(batches, "text", SEGMENT):
            by_lang = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, found in by_lang.items():
                carried = []
                for part in segments(b"\n".join(found).translate(LETTERS)):
                    words = [*carried, *part.replace(b"\n", b" . ").split()]
                    if left := trie.count(lang, words, len(carried)):
                        yield batch_of(left)
                    carried = words[-(WORDS - 1) :]
        left = batch_of(trie.spill(0))
        trie = by_lang = words = carried = None
        give_back()  # the worker goes on to merge
        yield left

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(lang, text).mapInArrow(run, RUNS)


def sequence_counts(docs: DataFrame, min_count: int = 10) -> DataFrame:
    """(lang, size, phrase, f) of every sequence of one to three words that occurs ``min_count`` times or more in its language; size 0
    has the number of all words. Words are joined by a space, which no word holds."""
    size = F.octet_length(F.col("text").cast("string"))
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    slots = max(1, -(-total // SLOT_BYTES))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        names, columns, times = merged_runs(group["run"].tolist())
        single = np.flatnonzero(columns[1] == 0)
        of_lang: dict[bytes, int] = {}
        for name, n in zip(names.take(pa.array(columns[0][single] - 1)).to_pylist(), times[single].tolist(), strict=True):
            lang = name.split(b" ", 1)[1]
            of_lang[lang] = of_lang.get(lang, 0) + n
        often = np.flatnonzero(times >= min_count)
        places = [c[often] for c in columns]
        words = [names.take(pa.array(p - 1, mask=p == 0)).to_pylist() for p in places]
        out = {
            "lang": [w.split(b" ", 1)[1] for w in words[0]],
            "size": sum((p > 0).astype(np.int32) for p in places),
            "phrase": [b" ".join([w.split(b" ", 1)[0] for w in row if w is not None]) for row in zip(*words, strict=True)],
            "f": times[often],
        }
        sums = {"lang": list(of_lang), "size": 0, "phrase": b"", "f": np.array(list(of_lang.values()), np.int64)}
        found = pd.concat([pd.DataFrame(out), pd.DataFrame(sums)], ignore_index=True)
        names = columns = times = words = places = out = None
        give_back()  # the worker takes the next slot
        return found

    merged = counted_runs(docs, slots).groupBy("slot").applyInPandas(merge, COUNTED)
    named = cut_lineage(merged.select(F.col("lang").cast("string"), "size", F.col("phrase").cast("string"), "f"))
    totals = named.where("size = 0").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return named.where("size > 0").unionByName(totals.where("f > 0"))


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits; at most 1000000, for no phrase is more frequent than its parts."""
    whole = [f"CAST({c} AS DECIMAL(16,0))" for c in (a, left, right)]
    return F.expr("CAST(1000000 * {0} * {0} DIV ({1} * {2}) AS LONG)".format(*whole))


def collocations(docs: DataFrame, min_count: int = 10, keep_share: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's collocations, best first.

    Candidates are phrases of two or three words that occur ``min_count`` times or more (a). A cut into a first and a second part of
    frequencies l and r scores floor(1000000 a a / (l r)); a candidate's lowest-scoring cut counts, ties to the shorter first part. A
    candidate that lies inside a longer one of at least ``keep_share`` percent of its frequency goes. The first ``top`` of a language by
    score, frequency and phrase (bytes) are reported, with None all.
    """
    counted = cut_lineage(sequence_counts(docs, min_count))
    sizes = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    parts = counted.where("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    candidates = counted.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    inner = candidates.where("size > 2").select(
        "lang",
        F.col("a").alias("longer"),
        F.expr("explode(flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), s -> array_join(slice(words, s, w), ' ')))))").alias("phrase"),
    )
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.join(covered, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(keep_share)} * a")
    cuts = left.select("lang", "phrase", "size", "a", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest")
    )
    of_first = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    of_rest = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(of_first, ["lang", "first"]).join(of_rest, ["lang", "rest"]).withColumn("score", exact_score("a", "l", "r"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").join(sizes, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), sequences AS (
    SELECT lang, 1 AS size, w[i] AS phrase FROM starts
    UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM starts WHERE i < len(w)
    UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM starts WHERE i < len(w) - 1
), counted AS (
    SELECT lang, size, phrase, count(*) AS f FROM sequences GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY 1
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10
), inner_pairs AS (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3
), kept AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inner_pairs p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 50 * c.a)
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM lowest WHERE cut = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

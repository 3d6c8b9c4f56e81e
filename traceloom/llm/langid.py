"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against each: from the current place the longest
match that occurs in the language's text is one phrase, then the next phrase starts. The language that needs the fewest phrases per
letter wins; ties go to the first name. Texts are read as lower-case letters with one space for anything else between them.

Training: at most ``TRAIN_DOCS`` documents a language, drawn by the hash of their id from the rows allowed, of whose texts
``TRAIN_LETTERS`` letters are taken in that order. These bounds are parameters, so the model has the same size at any corpus; the
automata go to the tasks. Prediction reads whole texts, in blocks of ``BLOCK`` letters that each begin a new phrase, and parses many
blocks side by side in numpy.

Rows with a null text, or one without a letter, are ``und`` with score 0, and so is every row when nothing can be learned. Letters no
language has are phrases of their own everywhere. Repeated rows are predicted each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, texts

TRAIN_DOCS = 64
TRAIN_LETTERS = 24_000
MAX_LANGUAGES = 500
BLOCK = 1024
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double, phrase_rate double"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton whose paths from state 0 are the substrings of ``symbols``."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = twin
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = twin
                    at = link[at]
        last = new
    return step


def letter_table() -> np.ndarray:
    """Lower-case form of every letter's code point, 0 for all that is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


class Parser:
    """Automata of several languages as one table: state times alphabet, with the phrase ends marked in the lowest bit."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.letters = letter_table()
        read = {lang: self.symbols_of(text) for lang, text in samples.items()}
        alphabet = np.unique(np.concatenate([np.unique(s) for s in read.values()])) if read else np.zeros(0, np.uint32)
        self.width = len(alphabet) + 1  # the last column is for letters no language has
        self.column = np.full(sys.maxunicode + 1, self.width - 1, np.uint16)
        self.column[alphabet] = np.arange(len(alphabet))
        # one more state per language has nothing before it: a text begins there, and so does what follows a letter unknown to it
        tables, self.begins, base = [], [], 0
        for lang in self.languages:
            steps = suffix_automaton(self.column[read[lang]].tolist())
            table = np.zeros((len(steps) + 1, self.width), np.int64)
            again = np.array([steps[0].get(c, len(steps)) for c in range(self.width)])
            table[:] = ((again + base) * self.width) << 1 | 1
            for state, step in enumerate(steps):
                for symbol, to in step.items():
                    table[state, symbol] = (to + base) * self.width << 1
            tables.append(table.ravel())
            self.begins.append((base + len(steps)) * self.width)
            base += len(steps) + 1
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)

    def symbols_of(self, text: str) -> np.ndarray:
        """Lower-case letters, with one space (0) for each run of other characters between or after letters."""
        codes = self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        return codes[(codes != 0) | (np.concatenate([[0], codes[:-1]]) != 0)]

    def phrases(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: phrases needed in each language, symbols, letters."""
        pieces = [self.symbols_of(t) for t in batch]
        sizes = np.array([len(p) for p in pieces], np.int64)
        letters = np.array([np.count_nonzero(p) for p in pieces], np.int64)
        counts = np.zeros((len(batch), len(self.languages)), np.int64)
        flat = self.column[np.concatenate(pieces)] if len(pieces) else np.zeros(0, np.uint16)
        blocks = -(-sizes // BLOCK)
        if not blocks.sum() or not self.languages:
            return counts, sizes, letters
        owner = np.repeat(np.arange(len(batch)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + within * BLOCK
        lengths = np.minimum(BLOCK, np.repeat(sizes, blocks) - within * BLOCK)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, owner = starts[order], lengths[order], owner[order]
        alive = np.searchsorted(-lengths, -np.arange(BLOCK), side="left")  # blocks longer than t come first
        states = np.repeat(np.array(self.begins, np.int32)[:, None], len(starts), axis=1)
        ends = np.zeros(states.shape, np.int32)
        for t in range(int(lengths[0])):
            n = alive[t]
            if n == 0:
                break
            to = self.table[states[:, :n] + flat[starts[:n] + t]]
            ends[:, :n] += to & 1
            states[:, :n] = to >> 1
        for k in range(len(self.languages)):
            counts[:, k] = np.bincount(owner, weights=ends[k], minlength=len(batch)).astype(np.int64)
        return counts, sizes, letters

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (how much fewer phrases the winner needs than the next, 0 to 1) and phrases per symbol of the winner."""
        counts, sizes, letters = self.phrases(batch)
        if not self.languages:
            return [UNKNOWN] * len(batch), np.zeros(len(batch)), np.ones(len(batch))
        best = counts.argmin(axis=1)
        fewest = counts.min(axis=1)
        rest = np.partition(counts, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.maximum(sizes, 1)
        known = letters > 0
        score = np.where(known & (rest > 0), 1 - np.minimum(fewest / np.maximum(rest, 1), 1), 0.0)
        rate = np.where(known, fewest / np.maximum(sizes, 1), 1.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, rate


def training_texts(docs: DataFrame, allowed: str) -> dict[str, str]:
    """The bounded labelled text of each language from the rows where ``allowed`` holds."""
    rows = docs.where(allowed).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.octet_length("text").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = ids.where("size > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAIN_DOCS)
    places = drawn.select("doc_id", "lang", "place").limit(MAX_LANGUAGES * TRAIN_DOCS + 1).collect()
    languages = {r.lang for r in places}
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; give a larger bound")
    place = {(r.doc_id, r.lang): r.place for r in places}
    wanted = rows.where(F.col("doc_id").cast("long").isin([r.doc_id for r in places])).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.substring("text", 1, TRAIN_LETTERS).alias("text")
    )
    found = {(place[r.doc_id, r.lang], r.lang, r.text) for r in wanted.collect() if (r.doc_id, r.lang) in place}
    samples: dict[str, str] = {}
    for _, lang, text in sorted(found):
        samples[lang] = (samples.get(lang, "") + " " + text)[:TRAIN_LETTERS]
    return samples


def identify(docs: DataFrame, allowed: str = "true") -> DataFrame:
    """(doc_id, lang_pred, score, phrase_rate) of every row; the model learns from the rows where the SQL condition ``allowed`` holds.

    Only the text of a row is read to predict it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(training_texts(docs, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in slices(batches, "text"):
            parser = parser or Parser(shared.value)
            langs, score, rate = parser.predict(texts(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                names=["doc_id", "lang_pred", "score", "phrase_rate"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTED)


HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


def predict_held_out(docs: DataFrame) -> DataFrame:
    """``identify`` learned from the rows that are not held out, with a mark for those that are; a null doc_id is not held out."""
    found = identify(docs, f"NOT ({HELD_OUT})")
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")


MAX_PHRASE_RATE = 0.5  # phrases per letter: matches of two letters or less are chance in any language


def keep_identified(docs: DataFrame, allowed: str = f"NOT ({HELD_OUT})") -> DataFrame:
    """The rows of ``docs`` whose text is of a learned language, with all their columns.

    Rejected are texts without a letter (``und``) and those that need more than ``MAX_PHRASE_RATE`` phrases per letter even in
    their best language. If nothing can be learned no row is rejected for its rate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(training_texts(docs, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in slices(batches, "text"):
            parser = parser or Parser(shared.value)
            read = texts(batch, "text")
            if parser.languages:
                langs, _, rate = parser.predict(read)
                keep = [lang != UNKNOWN and r <= MAX_PHRASE_RATE for lang, r in zip(langs, rate, strict=True)]
            else:
                keep = [len(parser.symbols_of(t)) > 0 for t in read]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

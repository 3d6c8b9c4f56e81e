"""Token counts of a word-level BPE vocabulary with the whole-token shortcut.

Offline, every vocabulary string that can be a whole pre-token is merged once; those that come out as one token are proven whole.
Counting splits a text into pre-tokens as the library does, counts a proven one as one token directly, and merges only the rest
(each distinct one once per worker, in a memo that is emptied at ``MEMO_WORDS``).

Null and empty texts have no tokens. Repeated rows are counted each. Special strings inside a text count as the one special token
the library makes of them. No truncation, no padding, no begin or end tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, texts, worker_state

MEMO_WORDS = 700_000
COUNTED = "doc_id long, n_bytes long, n_tokens long"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordTokens:
    """Counts by the vocabulary file of a BPE with word ends (the ``tokenizers`` format, read from its JSON text)."""

    def __init__(self, spec_text: str, whole: frozenset[str] | None = None):
        import regex

        spec = json.loads(spec_text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("only plain BPE with word ends is counted here")
        split = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.find = regex.compile(split[0]["pattern"]["Regex"]).findall
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.letters = byte_letters()
        self.vocab = model["vocab"]
        self.whole = self.prove() if whole is None else whole
        self.known: dict[str, int] = {}

    def prove(self) -> frozenset[str]:
        """The vocabulary strings, as text of a pre-token, that merging turns into exactly one token."""
        of_letter = {letter: b for b, letter in enumerate(self.letters)}
        proven = set()
        for token in self.vocab:
            if not token.endswith(self.end):
                continue
            letters = token[: -len(self.end)]
            if not letters or any(c not in of_letter for c in letters):
                continue
            try:
                word = bytes(of_letter[c] for c in letters).decode()
            except UnicodeDecodeError:
                continue
            if self.merged(word) == 1:
                proven.add(word)
        return frozenset(proven)

    def merged(self, word: str) -> int:
        """Tokens of one pre-token by merging: the leftmost pair of least rank first, until none is left."""
        letters = self.letters
        parts = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        if len(parts) > 200:
            return self.merged_long(parts)
        ranks = self.ranks
        none = len(ranks)
        costs = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            at = costs.index(least)
            parts[at] += parts.pop(at + 1)
            costs.pop(at)
            if at:
                costs[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
            if at < len(costs):
                costs[at] = ranks.get((parts[at], parts[at + 1]), none)
        return len(parts)

    def merged_long(self, parts: list[str]) -> int:
        """The same for a long word, with the pairs in a heap: time grows as n log n."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            alive -= 1
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return alive

    def normal(self, text: str) -> str:
        """Composed form, then lower case letter by letter (a final sigma gets no form of its own)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def counts(self, batch: list[str]) -> list[int]:
        pieces, extra = [], []
        for text in batch:
            specials = 0
            if "<" in text:
                parts = self.specials.split(text)
                specials = len(parts) - 1
                found = [w for p in parts for w in self.find(self.normal(p))] if specials else self.find(self.normal(text))
            else:
                found = self.find(self.normal(text))
            pieces.append(found)
            extra.append(specials)
        new = set().union(*pieces) if pieces else set()
        known = self.known
        if len(known) + len(new) > MEMO_WORDS:
            known.clear()
        whole = self.whole
        for word in new:
            if word not in known:
                known[word] = 1 if word in whole else self.merged(word)
        return [sum([known[w] for w in p]) + e for p, e in zip(pieces, extra, strict=True)]


def count_tokens(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row's whole text.

    The vocabulary file and the proven strings go to the tasks; both are bounded by the vocabulary, whatever the corpus.
    """
    with open(vocabulary_file, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, WordTokens(spec).whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_state(("token counts", vocabulary_file), lambda: WordTokens(*shared.value))
        for batch in slices(batches, "text", keep_state=True):
            found = texts(batch, "text")
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens.counts(found), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTED)

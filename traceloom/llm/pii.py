"""Personal data by patterns and a linear-chain conditional random field over word shapes.

Patterns give the base spans of four kinds. The field reads every stretch of neighbouring words that hold a digit, ``@`` or ``+``
(all other words are outside by definition and end a stretch), sees each word's shape and its neighbours', and tags the words as
beginning, inside or outside of a span by Viterbi decoding over many stretches at once in numpy. A tagged span that touches no base
span and passes the kind's checks of digits is added; base spans always stay.

Training: a labelled table of at most ``TRAIN_DOCS`` documents, drawn by the hash of their id among those with such words, of
each the first ``TRAIN_CHARS`` characters, labelled by the base spans. These bounds are parameters of the fit alone; spans are sought
in whole texts. The field's weights are small and go to the tasks.

Null and empty texts have no spans. Repeated rows are read each. Without anything to learn from only base spans are given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, texts

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 600
TRAIN_CHARS = 20_000
EPOCHS = 120
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SPANS = "array<struct<kind: string, start: int, end: int>>"
FOUND = f"doc_id long, base {SPANS}, spans {SPANS}"

# Fixed by the contract of the base spans; written so that no match takes more than linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGNED_WORD = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+")
SIGN = re.compile(r"[0-9@+]")

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def passes(kind: str, text: str) -> bool:
    """The checks of digits that a span of this kind must pass."""
    if kind == "email":
        return bool(re.search(r"[^\s@]@[^\s@]+\.[^\s@.]", text))
    digits = digits_of(text)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(0 < len(digits_of(p)) == len(p) and int(p.lstrip("0")[:4] or 0) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def emails(text: str) -> list[Span]:
    found, free = [], 0
    for m in DOMAIN.finditer(text):
        begin = m.start()
        while begin > free and LOCAL_END.match(text[begin - 1]):
            begin -= 1
        if begin < m.start():
            found.append(("email", begin, m.end()))
            free = m.end()
    return found


def base_spans(text: str) -> list[Span]:
    """The pattern spans by kind as listed, then start; offsets count code points."""
    if not SIGN.search(text):
        return []
    found = emails(text)
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return found


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Neighbouring words that hold a digit, ``@`` or ``+``, as lists of (start, end)."""
    out: list[list[tuple[int, int]]] = []
    last = -1
    for m in SIGNED_WORD.finditer(text):
        if out and not text[last : m.start()].strip():
            out[-1].append(m.span())
        else:
            out.append([m.span()])
        last = m.end()
    return out


def shape(word: str) -> str:
    """Runs of digits as d with their length, runs of letters as x, everything else as it is."""
    out = []
    for run in re.finditer(r"[0-9]+|[^\W\d_]+|.", word, re.S):
        c = run.group()
        if "0" <= c[0] <= "9":
            out.append(f"d{len(c)}" if len(c) < 5 else "d5-12" if len(c) < 13 else "d13-19" if len(c) < 20 else "d20")
        else:
            out.append("x" if c[0].isalpha() else c)
        if len(out) == 12:
            break
    return "".join(out)


def features(text: str, words: list[tuple[int, int]]) -> list[list[str]]:
    """Names of the features of each word of a stretch."""
    shapes = [shape(text[a:b].strip(".,;:!?\"'")) for a, b in words]
    out = []
    for k, (a, b) in enumerate(words):
        word = text[a:b]
        digits = digits_of(word)
        own = ["shape=" + shapes[k], f"digits={min(len(digits), 20)}", "first=" + ("d" if word[0].isdigit() else "x" if word[0].isalpha() else word[0])]
        own.append("before=" + (shapes[k - 1] if k else "-"))
        own.append("after=" + (shapes[k + 1] if k + 1 < len(words) else "-"))
        own.append(f"at={'@' in word}")
        own.append(f"four={word.count('.') >= 3 and len(digits) >= 4}")
        if len(digits) >= 13:
            own.append(f"luhn={luhn(digits[:19])}")
        out.append(own)
    return out


def labelled(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Stretches of a text as feature names and tag numbers, tagged by the base spans; unclear ones are left out."""
    spans = base_spans(text)
    unclear = [m.span() for p in (CARD, PHONE) for m in p.finditer(text) if len(digits_of(m.group())) > 19]
    rows = []
    for words in stretches(text):
        begin, end = words[0][0], words[-1][1]
        if any(a < end and b > begin for a, b in unclear):
            continue
        tags = [0] * len(words)
        for kind, a, b in spans:
            if a >= end or b <= begin:
                continue
            inside = [k for k, (s, e) in enumerate(words) if s < b and e > a]
            if any(tags[k] for k in inside):
                continue
            for n, k in enumerate(inside):
                tags[k] = 1 + 2 * KINDS.index(kind) + (n > 0)
        rows.append((features(text, words), tags))
    return rows


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """A linear-chain conditional random field: weights of features per tag, of tag pairs, and of the first tag."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.names, self.emit, self.pairs, self.first = names, emit, pairs, first

    def padded(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (stretch, place, tag), longest stretch first is not needed: places beyond a stretch's end score 0."""
        sizes = np.array([len(r) for r in rows])
        scores = np.zeros((len(rows), int(sizes.max()), len(TAGS)))
        row, place, index = [], [], []
        for r, words in enumerate(rows):
            for p, own in enumerate(words):
                for name in own:
                    if (k := self.names.get(name)) is not None:
                        row.append(r)
                        place.append(p)
                        index.append(k)
        np.add.at(scores, (np.array(row, int), np.array(place, int)), self.emit[np.array(index, int)])
        return scores, sizes

    def decode(self, rows: list[list[list[str]]]) -> list[list[int]]:
        """The best tags of each stretch; stretches of like length are decoded side by side."""
        out: list[list[int]] = [[] for _ in rows]
        order = sorted(range(len(rows)), key=lambda r: len(rows[r]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(rows[order[stop]]) <= 2 * len(rows[order[at]]) and (stop - at) * len(rows[order[stop]]) < 50_000:
                stop += 1
            part = order[at:stop]
            scores, sizes = self.padded([rows[r] for r in part])
            for r, tags in zip(part, self.viterbi(scores, sizes), strict=True):
                out[r] = tags
            at = stop
        return out

    def viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        n, longest, k = scores.shape
        best = scores[:, 0] + self.first
        came = np.tile(np.arange(k), (n, longest, 1))
        for t in range(1, longest):
            ways = best[:, :, None] + self.pairs
            goes = (t < sizes)[:, None]
            came[:, t] = np.where(goes, ways.argmax(axis=1), came[:, t])
            best = np.where(goes, ways.max(axis=1) + scores[:, t], best)
        tags = np.zeros((n, longest), int)
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            tags[:, t] = now
            now = came[np.arange(n), t, now]
        return [tags[r, : sizes[r]].tolist() for r in range(n)]


def train(rows: list[tuple[list[list[str]], list[int]]]) -> Field | None:
    """Fit by gradient steps on the regularised log-likelihood; the same rows give the same field."""
    rows = sorted((r for r in rows if len(r[1]) <= 24), key=repr)
    if not rows or not any(any(tags) for _, tags in rows):
        return None
    names = {name: i for i, name in enumerate(sorted({n for words, _ in rows for own in words for n in own}))}
    k = len(TAGS)
    field = Field(names, np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k))
    # an inside tag only follows the same kind's tags
    banned = np.array([[b > 0 and b % 2 == 0 and a not in (b, b - 1) for b in range(k)] for a in range(k)])
    barred = np.array([b > 0 and b % 2 == 0 for b in range(k)])
    sizes = np.array([len(t) for _, t in rows])
    n, longest = len(rows), int(sizes.max())
    ids = [(r, p, names[f]) for r, (words, _) in enumerate(rows) for p, own in enumerate(words) for f in own]
    row, place, index = (np.array(x) for x in zip(*ids, strict=True))
    gold = np.zeros((n, longest), int)
    for r, (_, tags) in enumerate(rows):
        gold[r, : len(tags)] = tags
    there = np.arange(longest) < sizes[:, None]
    gold_emit, gold_pairs, gold_first = np.zeros_like(field.emit), np.zeros((k, k)), np.bincount(gold[:, 0], minlength=k).astype(float)
    np.add.at(gold_emit, (index, gold[row, place]), 1)
    np.add.at(gold_pairs, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.emit, field.pairs, field.first)]
    for epoch in range(1, EPOCHS + 1):
        pairs = np.where(banned, -1e4, field.pairs)
        first = np.where(barred, -1e4, field.first)
        scores = np.zeros((n, longest, k))
        np.add.at(scores, (row, place), field.emit[index])
        ahead, back = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        ahead[:, 0] = scores[:, 0] + first
        for t in range(1, longest):
            ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + pairs, 1) + scores[:, t]
        for t in range(longest - 2, -1, -1):
            step = log_sum(pairs + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(there[:, t + 1, None], step, 0)
        total = log_sum(ahead[np.arange(n), sizes - 1], 1)
        chance = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
        want_emit = np.zeros_like(field.emit)
        np.add.at(want_emit, index, chance[row, place])
        want_pairs = np.zeros((k, k))
        for t in range(1, longest):
            both = ahead[:, t - 1, :, None] + pairs + (scores[:, t] + back[:, t])[:, None, :] - total[:, None, None]
            want_pairs += (np.exp(both) * there[:, t, None, None]).sum(axis=0)
        slopes = (gold_emit - want_emit, gold_pairs - want_pairs, gold_first - chance[:, 0].sum(axis=0))
        for weights, slope, (mean, square) in zip((field.emit, field.pairs, field.first), slopes, moments, strict=True):
            slope = slope / n - 1e-4 * weights
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            weights += 0.2 * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-8)
    field.pairs[banned] = -1e4
    field.first[barred] = -1e4
    return field


def trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    """The range without the marks around its words."""
    while begin < end and not (text[begin].isalnum() or text[begin] in "+("):
        begin += 1
    while begin < end and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def added_spans(text: str, words: list[tuple[int, int]], tags: list[int], base: list[Span], field: Field) -> list[Span]:
    """Spans of tagged words that touch no base span and pass their kind's checks.

    Where the tagged words fail them together, the shortest run of words from the first that passes is taken, and the words after it
    are tagged anew as a stretch of their own.
    """
    out, k = [], 0
    while k < len(tags):
        if tags[k] == 0:
            k += 1
            continue
        kind, stop = KINDS[(tags[k] - 1) // 2], k + 1
        while stop < len(tags) and tags[stop] and tags[stop] % 2 == 0:
            stop += 1
        for last in (stop, *range(k + 1, stop)):
            begin, end = trimmed(text, words[k][0], words[last - 1][1])
            if begin < end and passes(kind, text[begin:end]):
                if not any(a < end and b > begin for _, a, b in base):
                    out.append((kind, begin, end))
                if last < stop:
                    words, stop = words[last:], 0
                    tags = field.decode([features(text, words)])[0]
                break
        k = stop
    return out


def find_spans(batch: list[str], field: Field | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text."""
    base, owners, words, rows = [], [], [], []
    for i, text in enumerate(batch):
        base.append(base_spans(text))
        if field is not None and SIGN.search(text):
            for stretch in stretches(text):
                owners.append(i)
                words.append(stretch)
                rows.append(features(text, stretch))
    every = [list(b) for b in base]
    if rows:
        for i, stretch, tags in zip(owners, words, field.decode(rows), strict=True):
            if any(tags):
                every[i] += added_spans(batch[i], stretch, tags, base[i], field)
    return base, [sorted(s, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) for s in every]


def labelled_table(docs: DataFrame) -> list[str]:
    """Texts of the training table: bounded in rows and characters, the same ones for the same documents."""
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = named.where(F.col("text").rlike("[0-9@+]"))
    drawn = [r.doc_id for r in some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect()]
    found = named.where(F.col("doc_id").isin(drawn)).select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text")).distinct().limit(2 * TRAIN_DOCS)
    return [r.text for r in sorted(found.collect(), key=lambda r: (r.doc_id, r.text or "")) if r.text]


def fit(docs: DataFrame) -> Field | None:
    return train([row for text in labelled_table(docs) for row in labelled(text)])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of kind, start and end in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, every = find_spans(texts(batch, "text"), shared.value)
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in doc] for doc in x], kind) for x in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind that begins first."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in text, and n_chars, where there is one, counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            read = texts(batch, "text")
            _, every = find_spans(read, shared.value)
            changed = {i: masked(read[i], s) for i, s in enumerate(every) if s}
            if changed:
                for name in ("text", "n_chars"):
                    if name in columns:
                        at = columns.index(name)
                        values = batch.column(at).to_pylist()
                        for i, text in changed.items():
                            values[i] = text if name == "text" else len(text)
                        batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the digest of the base spans and all spans written out."""

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG) AS n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))

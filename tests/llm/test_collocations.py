"""Collocations against brute force, with bursts, spills and cut texts, and on hard rows."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from traceloom.llm import collocations, hattrie

DOCS = "doc_id long, text string, lang string"


def brute(rows, min_count=10, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "日本", "x" * 50, "b\x00c", "n m", *"defghij"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary[: 4 + k % 10]) + rng.choice(["", "", "", ".", "\n", "\t", ",", "\r\n"]) for _ in range(rng.randrange(60))]
        rows.append((k, rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "de", None, "und", "a b", ""])))
    return rows + [(500, None, "en"), (501, "", None), (None, "the of a " * 40, "en"), (None, "the of a " * 40, "en"), (502, "the of " * 3000, "fr")]


def got_of(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", phrase long, rank long")
    return sorted(map(tuple, collocations.collocations(table, **more).collect()))


@pytest.mark.parametrize("tight", [False, True])
def test_collocations_meet_brute_force(spark, monkeypatch, tight):
    if tight:  # every container bursts, slots leave all the time, texts are cut and merge in several slots
        monkeypatch.setattr(hattrie, "MOST_ENTRIES", 60)
        monkeypatch.setattr(hattrie, "MOST_WORDS", 900)
        monkeypatch.setattr(hattrie, "BURST", 3)
        monkeypatch.setattr(collocations, "SEGMENT", 50)
        monkeypatch.setattr(collocations, "SLOT_BYTES", 5000)
    rows = rows_of(3, 60)
    assert got_of(spark, rows) == brute(rows)


def test_top_of_each_language(spark):
    rows = rows_of(4, 60)
    want = brute(rows)
    assert got_of(spark, rows, top=3) == [r for r in want if r[1] <= 3]
    assert got_of(spark, [], top=3) == []
    assert got_of(spark, [(1, None, None)]) == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    table = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    assert table.select(collocations.exact_score("a", "l", "r")).first()[0] == 1000000 * big * big // ((big + 1) * (big + 2))


def test_trie_bursts_and_runs_keep_every_count(monkeypatch):
    monkeypatch.setattr(hattrie, "BURST", 5)
    rng = random.Random(5)
    words = [rng.choice([b"a", b"b", b"c", b"dd", b"\n"]) for _ in range(2000)]
    trie = hattrie.HatTrie(3)
    runs = trie.count(b"x", words, 0) + trie.spill(0)
    got = Counter()
    for slot in range(3):
        names, columns, times = hattrie.merged_runs([r for s, r in runs if s == slot])
        for *ranks, n in zip(*(c.tolist() for c in columns), times.tolist(), strict=True):
            got[tuple(names[r - 1].as_py().split(b" ")[0] for r in ranks if r)] += n
    want = Counter()
    for size in (1, 2, 3):
        want.update(p for p in zip(*(words[k:] for k in range(size)), strict=False) if b"\n" not in p)
    assert got == want


def test_many_words_rank_pairs_first(monkeypatch):
    """More words in a slot than three ranks fit in 63 bits."""
    names = pa.array([b"%07d x" % k for k in range(1 << 21)], pa.binary())
    columns = [np.array([1, 2, 1 << 21]), np.array([5, 0, 7]), np.array([6, 0, 1 << 21])]
    one = hattrie.packed_run(names, columns, np.array([1, 2, 3]))
    got, merged, times = hattrie.merged_runs([one, one])
    assert got.equals(names) and [c.tolist() for c in merged] == [c.tolist() for c in columns] and times.tolist() == [2, 4, 6]


def seconds(work):
    """CPU seconds of the faster of two calls."""
    took = []
    for _ in range(2):
        began = time.process_time()
        work()
        took.append(time.process_time() - began)
    return min(took)


def test_merge_takes_no_longer_for_more_runs():
    """The same 200,000 words and sequences come in 8 runs or in 400, as more tasks and spills make more runs of a slot."""

    def dealt(n):
        runs = []
        for k in range(n):
            names = pa.array([b"%07d x" % w for w in range(k, 200_000, n)], pa.binary())
            ranks = np.arange(1, len(names) + 1)
            runs.append(hattrie.packed_run(names, [ranks, 0 * ranks, 0 * ranks], ranks))
        return runs

    few, many = dealt(8), dealt(400)
    want, got = hattrie.merged_runs(few), hattrie.merged_runs(many)
    assert got[0].equals(want[0]) and all((a == b).all() for a, b in zip(got[1], want[1], strict=True))
    assert seconds(lambda: hattrie.merged_runs(many)) < 4 * seconds(lambda: hattrie.merged_runs(few)) + 0.5


def test_spill_follows_its_runs_and_not_all_words():
    """2,000 sequences leave in as many runs, by a task that knows no other words or half a million, as it does for most of its text."""
    few = [w for k in range(4000) for w in (b"w%d" % k, b"\n")]

    def spill_after(others):
        trie = hattrie.HatTrie(2000)
        known = trie.words[b"x"] = hattrie.LocalWords(trie.names, b"x")
        assert [known[b"%d" % k] for k in range(others)] == list(range(1, others + 1))
        trie.spill(0)
        runs = trie.count(b"x", few, 0)
        began = time.process_time()
        runs += trie.spill(0)
        took = time.process_time() - began
        assert sum(hattrie.unpacked_run(r)[2].sum() for _, r in runs) == 4000
        return took

    assert min(spill_after(500_000) for _ in range(2)) < 2 * min(spill_after(0) for _ in range(2)) + 1.5


def test_piece_ends_and_words_of_one_letter():
    """Cut at ends beside one another, at the text's edges and where a segment is carried on."""
    trie = hattrie.HatTrie(1)
    part = b"\n\n a  b\nb c\n".replace(b"\n", b" . ").split()
    names, columns, times = hattrie.merged_runs([r for _, r in [*trie.count(b"x", part, 0), *trie.spill(0)]])
    got = {tuple(names[r - 1].as_py() for r in row if r): n for *row, n in zip(*(c.tolist() for c in columns), times.tolist(), strict=True)}
    a, b, c = b"a x", b"b x", b"c x"
    assert got == {(a,): 1, (b,): 2, (c,): 1, (a, b): 1, (b, c): 1}

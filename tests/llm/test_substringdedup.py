"""Substring dedup against window counts, its trees against naive ones, and hard rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from traceloom.llm import joins, substringdedup, subtrees

SIZE = substringdedup.WINDOW


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + SIZE]) for _, w in words for k in range(len(w) - SIZE + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - SIZE + 1):
            if count[tuple(w[k : k + SIZE])] > 1:
                gone[k : k + SIZE] = [True] * SIZE
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(w), sum(gone), spans, b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "é", "日本", "x" * 200, "\x1c", " ", "w", "y" * 64, "z" * 65]
    passage = [rng.choice(vocabulary) for _ in range(140)]
    rows = []
    for k in range(90):
        own = [str(rng.random()) for _ in range(rng.randrange(60))]
        cut = rng.randrange(110)
        part = passage[cut : cut + rng.randrange(25, 80)]
        if k % 5 == 0 and part:
            part[rng.randrange(len(part))] = "changed"
        sep = rng.choice([" ", "\n", "\t ", "\r\n", "\x0b"])
        rows.append((k, sep.join(own + part + own[:7] + (part if k % 9 == 0 else []))))
    rows += [(200, "a " * 200), (201, "a b " * 17 + "c"), (202, None), (203, ""), (204, " \n"), (None, rows[3][1]), (None, rows[3][1]), (3, rows[8][1]), (None, "only here " + "q " * 34)]
    return rows


@pytest.mark.parametrize("most", [4096, 5, 1])
def test_repeats_meet_window_counts(spark, monkeypatch, most):
    monkeypatch.setattr(substringdedup, "MOST_STRETCHES", most)  # with few a shard, prefixes grow up to whole windows
    monkeypatch.setattr(substringdedup, "SHARD_BYTES", 20_000)
    rows = texts(most)
    table = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, prefix string, h1 int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.n_spans, bytes(r.kept)) for r in substringdedup.remove_repeats(table).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert substringdedup.digests(substringdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_false_bits_only_cost_work(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_BITS", 6)
    monkeypatch.setattr(joins, "MOST_BITS", 6)
    monkeypatch.setattr(substringdedup, "MOST_STRETCHES", 3)
    rows = texts(9)
    got = substringdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == brute(rows)


def naive_nodes(suffixes, most):
    """(way, leaves) wherever two different words follow, or the way is full, and several leaves lie below."""
    ways = {s[:d] for s in suffixes for d in range(most + 1)}
    out = set()
    for way in ways:
        leaves = frozenset(k for k, s in enumerate(suffixes) if s[: len(way)] == way)
        if len(leaves) > 1 and (len(way) == most or len({suffixes[k][len(way)] for k in leaves}) > 1):
            out.add((len(way), leaves))
    return out


def test_trees_meet_naive_ones():
    rng = np.random.default_rng(2)
    for _ in range(40):
        most = int(rng.integers(2, 9))
        x = rng.integers(0, 3, 60)
        starts = rng.permutation(60 - most)[:40]
        prefix = x[starts]
        nodes = subtrees.subtrees(x, starts, prefix, most, np.ones(len(starts), np.int64))
        got = {(d, frozenset(nodes.leaves[a:b].tolist())) for d, a, b in zip(nodes.depth.tolist(), nodes.first.tolist(), nodes.end.tolist(), strict=True)}
        suffixes = [tuple(x[s : s + most].tolist()) for s in starts]
        assert got == {n for n in naive_nodes(suffixes, most) if n[0]}
        deep = {k for d, leaves in naive_nodes(suffixes, most) if d >= 2 for k in leaves}
        assert set(subtrees.deep_leaves(nodes, 2).tolist()) == deep


def test_suffixes_that_occur_often_stay():
    x = np.arange(20)
    nodes = subtrees.subtrees(x, np.array([0, 5]), np.array([0, 1]), 4, np.array([2, 1]))
    assert subtrees.deep_leaves(nodes, 4).tolist() == [0]


def test_cells_halve_down_to_single_places():
    for level in range(substringdedup.LEVELS + 1):
        found = [p for low, high in substringdedup.cells(level) for p in range(low, high + 1)]
        assert found == list(range(SIZE - substringdedup.GRAM + 1))
    assert all(low == high for low, high in substringdedup.cells(substringdedup.LEVELS - 1))

"""Alignment of two tokenizers against a plain walk over the tokens, and on hard rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from traceloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
HARD = [None, "", " ", "a", "<|endoftext|> x <s></s><unk>", "日本語" * 20, "\U0001f600\U0001f468‍\U0001f469", "x" * 3000, " " * 70, "\n\n\t \r\n", "é\x00ﬁ ſ", "▁a ▁▁b", "a <0x41> b", "the  cat   sat"]


def brute(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    docs = []
    for text in texts:
        a = b = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                a = b = []
        groups, own_a, own_b = [], [], []
        i = j = end_a = end_b = 0
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                own_a.append(a[i])
                end_a, i = end_a + len(bytes_a[i]), i + 1
            else:
                own_b.append(b[j])
                end_b, j = end_b + len(bytes_b[j]), j + 1
            if end_a == end_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        docs.append((a, b, groups, Counter((x, y) for xs, ys in groups for x in xs for y in ys)))
    counts = Counter(pair for *_, links in docs for pair in links)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for k, (a, b, groups, links) in enumerate(docs):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for (x, y), n in links.items() if counts[x, y] == best[x])
        total = sum(n * counts[p] for p, n in links.items())
        out.append((k, len(a), len(b), len(groups), sum(links.values()), n_best, total, hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_alignment_meets_a_plain_walk(spark, monkeypatch, tight):
    if tight:
        monkeypatch.setattr(alignment, "MOST_LINKS", 3)
        monkeypatch.setattr(alignment, "HELD_PAIRS", 10)
        monkeypatch.setattr(alignment, "COUNT_SLICE", 900)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12 if tight else 60).collect()]
    texts += [*HARD, texts[0], texts[0]]
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS + ", row int, a string")
    got = sorted(tuple(r)[:8] for r in alignment.align(table, A, B).collect())
    assert got == brute(texts)
    assert any(n_a and n_links > n_groups for _, n_a, _, n_groups, n_links, *_ in got)


def test_empty_tables_and_nulls(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).collect() == []
    got = alignment.align(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], DOCS), A, B).collect()
    assert sorted((r.doc_id is None, r.n_a, r.n_groups, r.count_sum) for r in got) == [(False, 0, 0, 0), (True, 2, 2, 4), (True, 2, 2, 4)]


def test_pointers_reach_the_end_of_each_component():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randrange(1, 200)
        a, b = (sorted({size, *(rng.randrange(1, size + 1) for _ in range(rng.randrange(60)))}) for _ in range(2))
        common = sorted(set(a) & set(b))
        got = alignment.terminals(np.array(a), np.array(b))
        for side, found in zip((a, b), got, strict=True):
            assert found.tolist() == [min(c for c in common if c >= e) for e in side]


def test_table_of_pairs():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 10**6, 5000))
    table = alignment.PairTable(pairs, pairs * 2 + 1)
    asked = rng.integers(0, 10**6, 20000)
    assert table.of(asked).tolist() == np.where(np.isin(asked, pairs), asked * 2 + 1, 0).tolist()
    assert alignment.PairTable(pairs[:0], pairs[:0]).of(asked[:3]).tolist() == [0, 0, 0]


def test_ranks_encode_as_merges():
    """Every code point in several places, and the vocabulary's own proof; a vocabulary with other merges is refused."""
    import json

    with open(A, "rb") as f:
        data = f.read()
    assert alignment.merges_follow_ranks(data)
    ranks, merges = alignment.byte_level_side(data, True), alignment.byte_level_side(data, False)
    assert ranks.pieces == merges.pieces[: len(ranks.pieces)]
    rng = random.Random(6)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for c in [*points[:3000], *rng.sample(points, 3000)]:
        x = chr(c)
        text = f"a{x}b1 {x}'s {x}{x} {x}  x\n{x}<|endoftext|> "
        assert list(ranks.encode([text])[0]) == merges.encode([text])[0]
    other = json.loads(data)
    other["model"]["merges"][5], other["model"]["merges"][6] = other["model"]["merges"][6], other["model"]["merges"][5]
    assert not alignment.merges_follow_ranks(json.dumps(other).encode())
    assert set(alignment.byte_letters().values()) == set(range(256))


def test_groups_beyond_the_bound_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_LINKS", 50)
    rng = np.random.default_rng(3)
    a = alignment.Tokens(rng.integers(0, 9, 130), np.append(np.arange(129) * 2 + 2, 1000), np.array([0, 130]))
    b = alignment.Tokens(rng.integers(0, 9, 90), np.append(np.arange(89) * 2 + 1, 1000), np.array([0, 90]))
    groups = alignment.groups_of(a, b)
    assert len(groups.text) == 1
    got = Counter()
    for _, pair, times in alignment.links_of(a, b, groups, 10):
        for p, n in zip(pair.tolist(), times.tolist(), strict=True):
            got[p] += n
    assert got == Counter(x * 10 + y for x in a.ids.tolist() for y in b.ids.tolist())
    assert alignment.distinct_pairs(a, b, groups, 10, 100).tolist() == sorted(got)

"""The pipeline's near-copy stage against all pairs of whole texts, worked out without the operator's own hashes or groups."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest

from traceloom.llm import nearcopies

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}


def groups(texts):
    """The smallest id each text is linked to, by a walk over all pairs."""
    sets = {i: shingles(t) for i, t in sorted(texts.items())}
    label = {}
    for i in sets:
        reached = [] if i in label else [i]
        for a in reached:
            label[a] = i
            near = [b for b in sets if b not in label and b not in reached and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            reached += near
    return label


@pytest.fixture(scope="module")
def edited(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rng = random.Random(8)
    for k in range(60):
        words = texts[k % 30].split(" ")
        for _ in range(rng.randrange(1, 2 + len(words) // 30)):
            words[rng.randrange(len(words))] = f"zzz{rng.randrange(99)}"
        texts[1000 + k] = " ".join(words)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for k in range(80):  # a chain: each is a near copy of the next ones only
        texts[2000 + k] = " ".join(f"c{k}_{n}" if n < 3 * k else w for n, w in enumerate(long))
    texts |= {3000: "two words", 3001: "Two\twords ", 3002: "two", 3003: "", 3004: " \n"}
    return texts


@pytest.mark.parametrize("block", [nearcopies.BLOCK, 2000])
def test_groups_meet_all_pairs(spark, monkeypatch, edited, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    got = {r.doc_id: r.component_id for r in nearcopies.group_documents(spark.createDataFrame(list(edited.items()), DOCS)).collect()}
    assert got == groups(edited)


def test_stage_leaves_no_near_copies(spark, edited):
    docs = spark.createDataFrame(list(edited.items()), DOCS)
    kept = {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {i for i, label in groups(edited).items() if i == label}


def test_rows_without_ids_repeated_and_empty(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (None, text.upper()), (4, "x"), (4, "x"), (5, "X"), (6, None), (7, "")], DOCS)
    assert sorted((r.doc_id or 0, r.text) for r in nearcopies.keep_one(docs).collect() if r.doc_id is not None) == [(4, "x"), (6, None)]
    assert nearcopies.keep_one(docs).where("doc_id IS NULL").count() == 1
    assert nearcopies.keep_one(docs.limit(0)).collect() == []
    words = [f"n{k}" for k in range(200)]
    nameless = [(None, " ".join(words)), (None, " ".join(words[:-5])), (9, " ".join(words[5:]))]
    assert [r.doc_id for r in nearcopies.keep_one(spark.createDataFrame(nameless, DOCS)).collect()] == [9]


def test_texts_under_one_id_are_judged_each(spark):
    rng = random.Random(4)
    a, b, c = ([f"{name}{rng.randrange(10**6)}" for _ in range(60)] for name in "abc")
    rows = [(1, a), (4, a), (4, b), (5, c), (5, [*b, "tail"]), (5, c), (None, c), (None, a[30:] + c[:30]), (7, b)]
    docs = spark.createDataFrame([(i, " ".join(w), i, "x") for i, w in rows], DOCS + ", own_id int, row string")
    kept = sorted((r.doc_id or 0, r.text) for r in nearcopies.keep_one(docs).collect())
    assert kept == sorted([(1, " ".join(a)), (4, " ".join(b)), (5, " ".join(c)), (0, " ".join(a[30:] + c[:30]))])


def test_segments_reach_every_pair_at_the_bound():
    rng = random.Random(3)
    missed = 0
    for n in (9, 45, 900):
        for _ in range(100):
            names = [f"v{rng.randrange(10**9)}" for _ in range(n + n // 8)]
            whole = nearcopies.shingle_sets([" ".join(names + [f"t{k}" for k in range(4)])])[0]
            a, b = whole[: len(whole) - len(whole) // 10], whole[len(whole) // 10 :]
            common = len(set(a.tolist()) & set(b.tolist()))
            assert nearcopies.alike(common, len(a), len(b))
            keys = nearcopies.segment_keys([a, b])
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_fingerprints_make_candidates(spark, monkeypatch):
    """The stage's SimHash on its own: fingerprints equal a count bit by bit, and without any table of minima close ones are linked."""
    rng = random.Random(6)
    words = [f"s{rng.randrange(10**6)}" for _ in range(4000)]
    texts = {1: " ".join(words), 2: " ".join([*words, "end"]), 3: " ".join(words[:2000]), 4: "other words here", 5: ""}
    sets = nearcopies.shingle_sets(list(texts.values()))
    want = [sum((sum(int(h) >> b & 1 for h in s) * 2 > len(s)) << b for b in range(64)) for s in sets]
    got = [int(f) % (1 << 64) for f in nearcopies.fingerprints_of(sets)]
    assert got == want
    assert bin(got[0] ^ got[1]).count("1") <= 2
    monkeypatch.setattr(nearcopies, "ties", lambda sketched: sketched.limit(0).selectExpr("fp AS a", "fp AS b"))
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    assert {r.doc_id: r.component_id for r in nearcopies.group_documents(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}

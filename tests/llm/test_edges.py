"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from traceloom.llm import bytebpe, decontam, htmltext, langid, pii, simhash, suffixdedup, tokencount, topk, urlfilter

LONG = "word " * 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "The cat sat on the mat and the dog ran off to the woods.", "en", "a", 1),
    (1, "The cat sat on the mat and the dog ran off to the woods.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, " \t\n ", None, "b", 3),
    (5, LONG, "en", "b", None),
    (None, "The cat sat on the mat and the dog ran off to the woods.", "en", None, None),
    (None, "une phrase en français, avec des mots simples et un point", "fr", None, None),
    (6, "mail a.b@example.com or +1 (323) 555-9830, 10.0.0.1", "xx", "c", 9),
    (7, "\U0001f600 日本語 \x00 ﬁ", None, None, None),
]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog"), (2, None), (3, "short"), (None, "x y z a b c d")], "item_id long, text string")


OPERATORS = {
    "langid": lambda s, d: langid.predict_held_out(d),
    "langid_keep": lambda s, d: langid.keep_identified(d),
    "simhash": lambda s, d: simhash.group_documents(d),
    "simhash_keep": lambda s, d: simhash.keep_one(d),
    "pii": lambda s, d: pii.digests(pii.find_personal_data(d)),
    "pii_mask": lambda s, d: pii.mask_documents(d),
    "decontam": lambda s, d: decontam.judge_documents(d, bench(s)),
    "decontam_drop": lambda s, d: decontam.drop_contaminated(d, bench(s)),
    "tokens": lambda s, d: tokencount.count_tokens(d, WORDS),
    "bpe": lambda s, d: bytebpe.digests(bytebpe.encode_documents(d, RANKS, public_tokenizers.PATTERN)),
    "suffix": lambda s, d: suffixdedup.digests(suffixdedup.remove_repeats(d)),
}
FILTERS = {"langid_keep", "simhash_keep", "decontam_drop"}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name in FILTERS:
        assert out.columns == docs.columns
        assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    else:
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(r[0] for r in ROWS if r[0] is not None)
        assert sum(r.doc_id is None for r in rows) == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    docs = spark.createDataFrame(ROWS, DOCS)
    extra = {c: F.lit(7) for c in ("fp", "anchor", "start", "component_id", "away_id", "text_key", "row_key", "node", "label", "ids", "spans", "score", "of_fp")}
    plain, more = OPERATORS[name](spark, docs), OPERATORS[name](spark, docs.withColumns(extra))
    assert sorted(map(repr, more.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).collect() == []


def test_empty_texts_have_defined_results(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    by = {r.doc_id: r for r in OPERATORS["langid"](spark, docs).collect()}
    assert [(by[i].lang_pred, by[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    groups = {r.doc_id: r for r in simhash.group_documents(docs).collect()}
    assert {groups[i].fingerprint for i in (2, 3, 4)} == {"0" * 16} and {groups[i].component_id for i in (2, 3, 4)} == {2}
    counted = {r.doc_id: r for r in OPERATORS["tokens"](spark, docs).collect()}
    assert [(counted[i].n_bytes, counted[i].n_tokens) for i in (2, 3, 4)] == [(0, 0), (0, 0), (4, 0)] or counted[4].n_tokens == 0
    assert {r.n_removed for r in OPERATORS["suffix"](spark, docs).collect() if r.doc_id in (2, 3, 4)} == {0}


def test_one_of_each_group_stays_once(spark):
    kept = simhash.keep_one(spark.createDataFrame(ROWS, DOCS)).collect()
    assert sum(bool(r.text) and r.text.startswith("The cat") for r in kept) == 1
    assert sum(r.doc_id is None for r in kept) == 1  # the French text, whose group has no doc_id
    nameless = spark.createDataFrame([(None, "same text here for all", "en", "s", 1)] * 3, DOCS)
    assert simhash.keep_one(nameless).count() == 1


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (1, None, None), (2, "no scheme", ""), (3, "http://A.com", "<p>x"), (None, "HTTP://a.COM/p?q#f", "<article>&lt;b&gt;</article>")],
        "page_id long, url string, html string",
    ).withColumns({c: F.lit(1) for c in ("host", "path", "node", "rule", "text", "fits")})
    judged = sorted(urlfilter.judge(pages).collect(), key=repr)
    assert [r.host for r in judged if r.page_id in (1, 2)] == [""] * 3 and {r.verdict for r in judged} == {"allow"}
    assert [(r.host, r.path) for r in judged if r.page_id is None] == [("a.com", "/p")]
    texts = {(r.page_id, r.text) for r in htmltext.extract(pages).collect()}
    assert texts == {(1, ""), (2, ""), (3, "x"), (None, "<b>")}
    assert urlfilter.judge(pages.limit(0)).collect() == [] and htmltext.extract(pages.limit(0)).collect() == []
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.25, float("nan")]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, []), (6, [1.0]), (None, [1.0, 1.0])],
        "vec_id long, embedding array<float>",
    ).withColumns({c: F.lit(1) for c in ("dim", "block", "v", "ids", "score")})
    assert [tuple(r) for r in topk.top_k(vectors).orderBy("rank").collect()] == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 2, 256 * 256 + 128 * 128)]
    assert topk.top_k(vectors.limit(0)).collect() == []


def test_filters_without_model_or_benchmark(spark):
    docs = spark.createDataFrame([(2, "abc def", None, None, None), (3, "12", None, None, None)], DOCS)
    assert {r.lang_pred for r in langid.predict_held_out(docs).collect()} == {"und"}
    assert [r.doc_id for r in langid.keep_identified(docs).collect()] == [2]
    assert decontam.drop_contaminated(docs, bench(spark).limit(0)).count() == 2
    assert {r.spans for r in pii.digests(pii.find_personal_data(docs)).collect()} == {""}

"""Operators against brute force, the libraries they must agree with, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from traceloom.llm import bytebpe, components, decontam, htmltext, langid, pii, queries, simhash, suffixdedup, suffixes, tokencount, topk, urlfilter

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def texts_of(spark, n=200):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(n).collect()}


def test_top_k_meets_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(1, 24)), 60, 0)]) * 0.2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    values = np.floor(vectors * 256).astype(int)
    want = []
    for q in range(0, len(values), 50):
        scores = values @ values[q]
        best = [i for i in np.lexsort((np.arange(len(values)), -scores)) if i != q][:5]
        want += [(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(table).collect())) == want


def test_top_k_decides_by_row(spark):
    """Repeated ids, with equal and unequal vectors, against the oracle and the contract: every row but the query's own."""
    import duckdb

    rng = np.random.default_rng(2)
    v = [rng.normal(size=6).tolist() for _ in range(9)]
    rows = [(0, v[0]), (1, v[1]), (1, v[2]), (2, v[3]), (50, v[4]), (50, v[4]), (50, v[5]), (100, v[0]), (0, v[0])] + [(7, v[6])] * 9 + [(None, v[7]), (3, None)]
    values = [(i, np.floor(np.array(x) * 256).astype(int)) for i, x in rows if i is not None and x is not None]
    want = []
    for at, (query, x) in enumerate(values):
        if query % 50 == 0:
            best = sorted((-int(y @ x), i) for k, (i, y) in enumerate(values) if k != at)[:5]
            want += [(query, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(want) == sorted(con.execute(topk.ORACLE).fetchall())


def test_bounds_never_fall_below_products():
    rng = np.random.default_rng(7)
    values = rng.integers(-200, 200, (80, 33))
    for segments in topk.SEGMENTS:
        level = topk.Resolution(values, segments)
        for q in range(5):
            assert (level.bounds(q, level, slice(None)) >= values @ values[q]).all()


def phrases(text, sample, parser):
    """Greedy longest matches by substring search."""
    there, left = ("".join(map(chr, parser.symbols_of(t))) for t in (sample, text))
    count = 0
    for block in range(0, len(left), langid.BLOCK):
        part, at = left[block : block + langid.BLOCK], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in there:
                size += 1
            at, count = at + size, count + 1
    return count


def test_phrases_meet_substring_search(spark):
    texts = list(texts_of(spark, 40).values())
    samples = {"a": texts[0][:1500], "b": texts[1][:1500] + "ß"}
    parser = langid.Parser(samples)
    tried = [t[:3000] for t in texts[2:14]] + ["", "12", "日本 x", "ß" * 2500]
    counts, _, _ = parser.phrases(tried)
    assert counts.tolist() == [[phrases(t, samples[k], parser) for k in "ab"] for t in tried]


def test_language_is_told_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges += [(7, 7), (None, 5)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}


def test_simhash_meets_all_pairs(spark):
    texts = texts_of(spark)
    rng = random.Random(2)
    for k in range(40):
        words = texts[k].split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "zzz"
        texts[1000 + k] = " ".join(words)
    got = {r.doc_id: r for r in simhash.group_documents(spark.createDataFrame(list(texts.items()), DOCS)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and group[b] < group[a]:
                    group[a], changed = group[b], True
    assert {i: r.component_id for i, r in got.items()} == group


def plain_fingerprint(text):
    import re

    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_reach_every_pair_within_two_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(20)]
    fps = sorted({b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base for _ in range(8)})
    edges = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in map(tuple, edges))
    root = {f: f for f in fps}
    for _ in fps:
        for a, b in map(tuple, edges):
            root[a] = root[b] = min(root[a], root[b])
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2:
                assert root[a] == root[b]


def test_aliases_share_blocks(spark):
    def page(i, url, target=None, kind="canonical"):
        link = f'<link rel="canonical" href="{target}">' if kind == "canonical" else f'<meta http-equiv="refresh" content="0; url={target}">'
        return (i, url, link if target else "<p>none")

    rows = [
        page(1, "http://a.org/x", "http://x.example.com/en/1"),  # alias of a blocked url
        page(2, "http://b.org/y#top", "http://A.org/x", "refresh"),  # alias of an alias
        page(3, "http://c.org/z", "http://b.org/y"),
        page(4, "http://d.org/", "/other"),
        page(5, "http://e.net/es/1", "http://www.example.com/en/1"),  # blocked itself, in a group with an allowed one
        page(6, "http://f.org/", "http://e.net/es/1"),  # explicit allow takes precedence
        page(7, "http://x.example.com/en/1"),
        page(8, "http://com/"),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"),
        5: ("net/es/", "block"), 6: (None, "allow"), 7: ("example.com/en/", "block"), 8: ("com/", "allow"),
    }


def test_alias_oracle(spark):
    import duckdb

    rows = [(k, f"http://h{k}.org/p{k}", f"<link rel=canonical href='http://h{k // 2}.org/p{k // 2}'>") for k in range(1, 40)]
    rows += [(100, "http://h3.org/p3", '<link rel="canonical" href="http://a.net/fr/">'), (101, "http://h5.org/a/b", "<link rel=canonical href=c?d>"), (102, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(urlfilter.ORACLE).fetchall()))


def test_base_spans_meet_the_plain_patterns():
    import re

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("a@.1+- ()94") for _ in range(rng.randrange(1, 50)))
        want = [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, text) if k == "email" or pii.passes(k, m.group())]
        assert pii.base_spans(text) == want


def test_field_learns_what_patterns_cannot_split():
    rng = random.Random(1)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(300):
        texts.append(f"call +1 ({number(3)}) 555-{number(4)} or mail x{number(2)}@example.com in {number(4)} at 10.{rng.randrange(255)}.3.4 no {number(6)}")
    field = pii.train([row for t in texts for row in pii.labelled(t)])
    text = "ring +1 (323) 555-9830 10.1.2.3 now in 1999"
    base, every = pii.find_spans([text, "plain words only", ""], field)
    assert base[0] == [("ip", 23, 31)] and every[0] == [("ip", 23, 31), ("phone", 5, 22)]
    assert pii.masked(text, every[0]) == "ring <PHONE> <IP> now in 1999" and every[1:] == [[], []]


def test_viterbi_meets_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    k = len(pii.TAGS)
    field = pii.Field({f"f{j}": j for j in range(4)}, rng.normal(size=(4, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    rows = [[[f"f{rng.integers(4)}"] for _ in range(n)] for n in (1, 2, 3, 3)]
    for row, got in zip(rows, field.decode(rows), strict=True):
        score = lambda tags, row=row: field.first[tags[0]] + sum(field.emit[field.names[w[0]], t] for w, t in zip(row, tags)) + sum(field.pairs[a, b] for a, b in zip(tags, tags[1:]))
        assert score(got) == pytest.approx(max(map(score, product(range(k), repeat=len(row)))))


def test_decontamination_bears_substitutions(spark):
    rng = random.Random(8)
    texts = list(texts_of(spark, 60).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(k, t) for k, t in enumerate(texts)]
    for item_id, text in items:
        words = text.split()
        for k in rng.sample(range(len(words)), len(words) // 7):
            words[k] = "zzz"
        docs.append((1000 + item_id, texts[0][:200] + " " + " ".join(words) + " " + texts[1][:200]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.judge_documents(spark.createDataFrame(docs, DOCS), benchmark).collect()}
    assert all(got[1000 + i].contaminated for i, _ in items)
    words_of = lambda t: decontam.word_hashes([t])[0].tolist()
    for k, text in enumerate(texts):  # by sliding every item over every text
        words, best = words_of(text), 0.0
        for _, item in items:
            item = words_of(item)
            size = min(len(item), decontam.WINDOW)
            for at in range(-len(item), len(words)):
                same = [0 <= at + p < len(words) and words[at + p] == w for p, w in enumerate(item)]
                best = max([best, *(sum(same[p : p + size]) / size for p in range(len(item) - size + 1))])
        assert got[k].contaminated == (best >= decontam.SIMILARITY)


def test_several_blocks_give_what_one_gives(spark, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = sorted(map(tuple, decontam.judge_documents(docs, benchmark).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    assert sorted(map(tuple, decontam.judge_documents(docs, benchmark).collect())) == one


HARD = ["", "a" * 300, "x1\x1c\x85    é\n\n  hi  \U0001f600", "<|endoftext|> a<|endoftext|>b<|STARTOFTEXT|> <", "日本語" * 50, "ΑΣ ΣΑΣ İ é ﬁ ǅ", "don't I'LL 's it\x00s"]


def test_token_counts_meet_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*texts_of(spark, 80).values(), *HARD]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, path).collect()}
    found = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == {i: (len(t.encode()), len(e.ids)) for i, (t, e) in enumerate(zip(texts, found, strict=True))}


def test_long_words_merge_as_short_ones():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = tokencount.WordTokens(f.read(), frozenset())
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("aehinorst") for _ in range(rng.randrange(1, 40)))
        parts = [words.letters[b] for b in word.encode()]
        parts[-1] += words.end
        assert words.merged_long(parts) == words.merged(word)


def test_byte_bpe_meets_the_library_and_round_trips(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    texts = [*texts_of(spark, 80).values(), *HARD]
    encoded = bytebpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), DOCS), path, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in encoded.collect()}
    for i, text in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(got[i].decoded) == text.encode()
    digest = {r.doc_id: r for r in bytebpe.digests(encoded).collect()}
    assert digest[0].ids_sha256 == hashlib.sha256(got[0].ids).hexdigest() and digest[0].n_tokens == len(got[0].ids) // 4


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        parts = [rng.integers(1, 3, int(rng.integers(1, 30))) for _ in range(4)]
        x = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int16)
        sizes = np.array([len(p) for p in parts])
        order = suffixes.suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        prefix = suffixes.common_prefixes(x, order, np.cumsum(sizes + 1) - sizes - 1, sizes, 20)
        for s in range(1, len(x)):
            a, b, k = order[s - 1], order[s], 0
            while k < 20 and max(a, b) + k < len(x) and x[a + k] == x[b + k] != 0:
                k += 1
            assert x[b] == 0 or prefix[s] == k


def repeated(texts):
    """Removed runs and kept bytes by counting every window."""
    size = suffixdedup.WINDOW
    count = Counter(t[s : s + size] for t in texts.values() for s in range(len(t) - size + 1))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for s in range(len(t) - size + 1):
            if count[t[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("most", [2048, 2])
def test_repeats_meet_window_counts(spark, monkeypatch, most):
    monkeypatch.setattr(suffixdedup, "SHARD_STRETCHES", most)
    rng = random.Random(6)
    texts = texts_of(spark, 60)
    shared, near = texts[1][:230] + "é", texts[2] * 2
    for k in range(12):
        cut = rng.randrange(len(near) - 900)
        texts[1000 + k] = near[cut : cut + 800] + str(k) + shared + near[cut + 5 : cut + 420] + chr(200 + k)
    texts[2000], texts[2001] = "ab" * 400, "a" * 250
    got = suffixdedup.remove_repeats(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == repeated({i: t.encode() for i, t in texts.items()})


def test_texts_with_equal_short_hashes_keep_their_own_ranges(spark):
    """Rows were told apart by 32 bits once: these two texts without ids have the same 32-bit hash."""
    rng = random.Random(0)
    candidates = spark.range(400_000).selectExpr("sha2(cast(id AS string), 512) AS tail")
    hashed = candidates.selectExpr("tail", "hash(encode(repeat(tail, 3), 'UTF-8')) AS h")
    pair = hashed.groupBy("h").agg({"tail": "collect_list"}).toDF("h", "tails").where("size(tails) > 1").first()
    one, two = (t * 3 for t in pair.tails[:2])
    texts = {0: one, 1: two, 2: one[:250] + "".join(rng.choice("xyz") for _ in range(100))}
    rows = [(None, one), (None, two), (2, texts[2])]
    got = {bytes(r.kept): (r.n_bytes, r.n_removed, r.n_spans) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {kept: rest for *rest, kept in [(*r[:3], r[3]) for r in repeated({i: t.encode() for i, t in texts.items()}).values()] for rest in [tuple(rest)]}


def test_main_text():
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav>"
        '<div class="ad">Buy, now. Please, do!</div><article><h1>Head &amp; line</h1><p><b>First  part<br>goes on.<br><p>Second&nbsp;part.</p>'
        '<div class="comments"><p>reader</p></div></article><aside>side</aside><footer>&copy; foot</footer></body></html>'
    )
    assert htmltext.main_text(page) == "Head & line\n\nFirst part goes on.\n\nSecond part."
    plain = "<div id=menu><a href=x>Home</a></div><div><p>Long text, with marks. And more; yes.<p>Second part of it, long too.</div><ul><li><a href=a>one</a><li><a href=b>two</a></ul>"
    assert htmltext.main_text(plain) == "Long text, with marks. And more; yes.\n\nSecond part of it, long too."
    assert [htmltext.main_text(t) for t in ("", "<p>", "a < b", "<!-- x", "<script>x")] == ["", "", "a < b", "", ""]


def test_article_text_of_whole_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inside)]
        assert htmltext.main_text(r.html) == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    import duckdb

    from tools.check_oracles import TABLES, compare

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    state, rows, _, note = compare(spark, con, SMALL, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert state in ("ok", "rows-only"), note
    assert rows > 0


def best_overlap(text, item):
    """The largest share of equal words, at equal places, of any window of the item laid over the text at any offset."""
    size = min(len(item), decontam.WINDOW)
    if not size:
        return 0.0
    padded = np.concatenate([np.zeros(len(item), np.uint64), text, np.zeros(len(item), np.uint64)])
    same = np.lib.stride_tricks.sliding_window_view(padded, len(item)) == item
    summed = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    return (summed[:, size:] - summed[:, :-size]).max() / size


def test_pipeline(spark):
    import corpus_pipeline

    from tests.llm.test_nearcopies import groups

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, SMALL)
        assert out.columns == docs.columns and 0 < out.count() <= before.count(), name
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    # every given document is in a learned language; one of each group of near copies by all pairs stays; then all offsets of all items
    first = {i for i, label in groups(texts).items() if i == label}
    items = [decontam.word_hashes([r.text])[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = {i: decontam.word_hashes([texts[i]])[0] for i in first}
    clean = {i for i in first if max(best_overlap(words[i], item) for item in items) < decontam.SIMILARITY}
    assert len(texts) > len(first) > len(clean) and set(rows) == clean
    field = pii.fit(docs)
    same = [i for i in rows if not pii.find_spans([texts[i]], field)[1][0]]
    assert len(same) > 50 and all(rows[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in same)

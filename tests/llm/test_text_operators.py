"""Encoders, decontamination, repeats and licenses against libraries and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetable.llm import bpe, decontamination, html_text, licenses, repeats, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "a" * 5000, "\n\t x  y", "🙂" * 40, "日本語テキスト" * 20, "it's WE'LL 12345 ÄÖß", "<|endoftext|>a<|startoftext|>", "ΑΣ ΣΑΣ İstanbul", "\x1ca\x85b　c", "é ́x"]


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    table = bpe.codec(RANKS, public_tokenizers.PATTERN).table
    words = list(bpe.codec(RANKS, public_tokenizers.PATTERN).ranks)
    assert sorted(table.slots(words).tolist()) == list(range(len(words)))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_the_library_and_decodes(text):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert ids == tiktoken_encoding().encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_job(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)] + [(99, None, "z"), (99, None, "z"), (None, "x", "z")], "doc_id long, text string, n_tokens string")
    enc = tiktoken_encoding()
    got = sorted(map(tuple, bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, ""), (99, ""), (None, "x")]
    want = [(i, len(e := enc.encode_ordinary(t)), sha(" ".join(map(str, e)).encode()), sha(t.encode())) for i, t in rows]
    assert got == sorted(want, key=repr)
    ids = {r["doc_id"]: r["ids"] for r in bpe.tokenized(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert ids[6] == enc.encode_ordinary(ODD[6]) and ids[99] == []
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    assert back[4] == ODD[4].encode()
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(98, None, 1), (97, "word " * 3000, 1)], "doc_id long, text string, n_bytes int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, WORDS).collect()}
    for i, t in [*enumerate(ODD), (98, ""), (97, "word " * 3000)]:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 2048), t[:20]


def test_token_counts_of_all_letters():
    from tokenizers import Tokenizer

    counter, library = token_counts.Counter(WORDS, token_counts.frequent_lengths(WORDS)), Tokenizer.from_file(WORDS)
    texts = [f"a{chr(p)}b {chr(p)}1{chr(p)}." for p in [*range(0, 0x2100), *range(0xA640, 0xA7FF), 0x32808, 0x1F600] if not 0xD800 <= p < 0xE000]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


# ---------------------------------------------------------------------- decontamination

ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (3, ""), (4, None), (12, "a a a"), (5, "!!!")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten y"),
    (2, "two three four, five-six seven eight nine ten ELEVEN short item"),
    (3, "one two three four five six seven eight nine"),
    (4, None),
    (5, ""),
    (6, "a a a a b short\nitem"),
    (6, "a a a a b short\nitem"),
    (7, "short x item shortitem"),
    (None, "short item é"),
]


@pytest.mark.parametrize("most", [100_000, 1])
def test_decontamination(spark, most):
    docs = spark.createDataFrame([(*d, "q") for d in DOCS], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, decontamination.report(decontamination.find(docs, bench, most=most)).collect()), key=repr)
    want = []
    for i, t in DOCS:
        n, hit, items = decontamination.reference_hits(t, ITEMS)
        want.append((i, n, hit, len(items), decontamination.digest(items), hit > 0))
    assert got == sorted(want, key=repr)
    assert decontamination.find(docs.limit(0), bench).count() == 0
    assert all(not r["spans"] for r in decontamination.find(docs, bench.limit(0)).collect())


def test_passages_are_cut(spark):
    docs = spark.createDataFrame([(*d, "q", 5) for d in DOCS], "doc_id long, text string, shared string, n_chars long")
    left = decontamination.cleaned(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == docs.columns and left.count() == len(DOCS)
    for r in left.collect():
        assert decontamination.reference_hits(r["text"], ITEMS)[1] == 0
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert {r["text"] for r in left.collect() if r["doc_id"] == 3} == {DOCS[2][1]}


@pytest.mark.parametrize("most", [100_000, 1])
def test_cuts_do_not_depend_on_blocks(spark, most):
    word = [f"w{k}" for k in range(40)]
    said = lambda *ks: " ".join(word[k] for k in ks)
    items = [(1, said(*range(10))), (2, said(*range(5, 15))), (3, said(20, 21)), (4, said(22, 23, 24))]
    texts = ["x " + said(*range(15)) + " y", said(20) + " " + said(22, 23, 24) + " " + said(21) + " z", said(22, 20, 21, 23, 24) + " z", "none", "", None]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, a string, n_chars long")
    left = decontamination.cleaned(docs, spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert left.columns == docs.columns
    got = {r["doc_id"]: r for r in left.collect()}
    words = [None if (t := got[i]["text"]) is None else t.split() for i in range(7)]
    assert words == [["x", "y"], ["z"], ["z"], ["none"], [], None, ["x", "y"]]
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab c", max_size=60), min_size=1, max_size=6), st.lists(st.text("ab c", max_size=12), min_size=1, max_size=5))
def test_fm_index_finds_what_brute_force_finds(texts, items):
    pairs = [(str(i), t) for i, t in enumerate(items)]
    windows = {}
    for i, t in pairs:
        for w in decontamination.item_windows(t, 3):
            windows.setdefault(w, []).append(i)
    phrases = decontamination.Phrases(list(windows), list(windows.values()))
    n, owner, first, window = decontamination.occurrences([t.encode() for t in texts], phrases)
    for d, t in enumerate(texts):
        mine = owner == d
        spans = decontamination.merged(first[mine], phrases.lengths[window[mine]]) if mine.any() else []
        got = int(n[d]), sum(b - a for a, b in spans), {i for k in window[mine] for i in phrases.items[k]}
        assert got == decontamination.reference_hits(t, pairs, 3)


# ------------------------------------------------------------------------------ repeats


def repeat_docs():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    a, b, long = word(700), word(450), word(30_000)
    texts = [a, a, a[:650] + word(200), word(50) + b + word(90), b[:420] + word(10), b[30:] + "z", "ab" * 800, "é" * 600, "", None, word(399), long + b, long[100:9000], "q" * 400]
    return [(i, t) for i, t in enumerate(texts)] + [(20, texts[3]), (20, texts[3]), (None, word(500) + a[200:])]


@pytest.mark.parametrize("options", [{}, {"dense": 2}, {"shard_bytes": 3000}, {"length": 100, "gram": 40}])
def test_repeats(spark, options):
    rows = repeat_docs()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, run int").repartition(3)
    length = options.get("length", repeats.LENGTH)
    data = [(t or "").encode() for _, t in rows]
    want = [
        (i, len(d), sum(b - a for a, b in g), len(g), hashlib.sha256(repeats.kept_bytes(d, g)).hexdigest())
        for (i, _), d, g in zip(rows, data, repeats.reference(data, length))
    ]
    assert sorted(map(tuple, repeats.digests(docs, **options).collect()), key=repr) == sorted(want, key=repr)


def test_repeats_of_nothing_and_cleaning(spark):
    rows = repeat_docs()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_chars long")
    assert repeats.digests(docs.limit(0)).count() == 0
    left = repeats.cleaned(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert kept[0] == "" and kept[9] is None and kept[10] == rows[10][1]


def passages_by_hand(texts, n):
    """Kept words of each text: those in no passage of ``n`` words that occurs twice."""
    seen = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for t in texts:
        w = t.split()
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def test_pipeline_cuts_repeated_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    fresh = iter(f"w{k:04d}" for k in rng.permutation(10_000))
    own = lambda n: " ".join(next(fresh) for _ in range(n))
    planted, short, fifty = own(51), " ".join("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"[:51]), own(50)
    assert 290 < len(planted) < 320 and len(short) == 101
    texts = [f"{own(9)} {planted} {own(4)}", f"{own(70)} {planted}", f"{short} {own(3)}", f"é {own(3)} " + short.replace(" ", "\u3000 \n") + " end", f"{own(5)} {fifty} {own(5)}", f"{fifty} {own(2)}", own(60), "", "x y " * 30]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_chars long").repartition(3)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeat_removal(spark, docs, "").collect()}
    assert [left[i].split() for i in range(len(texts))] == passages_by_hand(texts, 51) and left[len(texts)] is None
    assert planted not in left[0] and "a b c" not in left[2] and fifty in left[4] and fifty in left[5]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6))
def test_bounded_prefixes(texts):
    symbols = []
    for k, t in enumerate(texts):
        symbols += [100 + ord(x) for x in t] + [k]
    symbols = np.array(symbols)
    order = repeats.suffix_order(symbols)
    suffixes = [symbols[i:].tolist() for i in range(len(symbols))]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [-1] + [min(4, common(suffixes[i], suffixes[j])) for i, j in zip(order, order[1:])]
    assert repeats.short_prefixes(symbols, order, 4).tolist() == want


# -------------------------------------------------------------------------- licenses, html


def test_licenses(spark):
    long = licenses.TEMPLATES["MPL-2.0-header"]
    changed = long.replace("obtain", "find")
    rows = [
        (1, "intro words here. Released under the MIT license"), (2, "RELEASED UNDER THE mit LICENSE!"), (3, "released under an mit license"), (4, None), (5, ""),
        (6, "word " * 5000 + long + " more words"), (7, changed), (8, " ".join(long.split()[:12])), (9, "license license license permission"), (9, "x"), (10, licenses.TEMPLATES["CC-BY-NC-4.0-notice"]),
    ]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs).collect()}
    assert {k for k in got if k[1] == "MIT-notice"} == {(1, "MIT-notice"), (2, "MIT-notice")}
    assert got[6, "MPL-2.0-header"] == 1.0 and 0.8 <= got[7, "MPL-2.0-header"] < 1 and (8, "MPL-2.0-header") not in got
    assert (10, "CC-BY-NC-4.0-notice") in got and not {k for k in got if k[0] in (3, 4, 5, 9)}
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_licenses_equal_the_oracle(spark):
    import duckdb

    rng = np.random.default_rng(5)
    notices = list(licenses.TEMPLATES.values())
    rows = []
    for i in range(300):
        words = rng.choice(["the", "license", "of", "version", "copy", "permission", "x"], 30).tolist()
        notice = notices[i % len(notices)].split()
        if i % 3:
            notice[int(rng.integers(len(notice)))] = "changed"
        rows.append((i, " ".join(words[: i % 30] + notice + words[i % 30 :])))
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(licenses.oracle_sql()).fetchall())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now and here.</div>
<div id="cookie-notice"><p>We use cookies to make this better for you.</p></div>
<main><article><h1>Head &amp; line</h1><p><b>Bold text<br>A  long\n paragraph with <a href="#">a link</a>, caf&eacute;&nbsp;&lt;b&gt;.<p>Next</p>
<aside>Related</aside><form><label>Name</label></form><section class="comments"><p>Nice post, I liked it a lot.</p></section></article></main><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "no markup at all but a fair number of words in one block"), (5, "u", "<p>" * 30_000 + "x"), (6, "u", "<article><p>" + "word " * 50_000), (6, "u", "<article><p>a<b")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in html_text.extract(pages).orderBy("page_id", "n_chars").collect()]
    assert got[0][2] == "Head & line Bold text A long paragraph with a link, café <b>. Next"
    assert [g[2] for g in got[1:3]] == ["", ""] and got[3][2] == rows[3][2] and [g[3] for g in got[5:]] == [1, 249_999]
    assert all(g[3] == len(g[2]) for g in got) and html_text.extract(pages.limit(0)).count() == 0


def test_crc_split_is_the_usual_one(spark):
    from pyspark.sql import functions as F

    from kinetable.llm.labels import held_out

    ids = spark.range(50).select(F.col("id"), held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)

"""The near-duplicate stage: pairs against exact similarity, large groups, ids with several texts."""

import numpy as np
import pytest

import corpus_pipeline
from kinetable.llm import near_copies as nc
from kinetable.llm import simhash

SF = "/root/testdata/sf0.01"


def similarity(a, b):
    def s(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("dense", [128, 4])
def test_one_of_each_group_stays(spark, dense):
    rng = np.random.default_rng(6)
    base = [[f"w{rng.integers(4000)}" for _ in range(300)] for _ in range(8)]
    texts = [" ".join(b) for b in base] + [edited(rng, base[i % 8], 1 + i % 3) for i in range(60)] + [" ".join(f"w{rng.integers(4000)}" for _ in range(200)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(100, "Short one"), (101, "short  ONE"), (102, ""), (103, None), (104, " \n")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, fp string, node int").repartition(3)
    kept = {r["doc_id"] for r in nc.dedup(docs, dense).collect()}
    assert all(similarity(texts[i], texts[8 + j]) >= 0.8 for j in range(60) for i in [j % 8])
    assert kept == {*range(8), *range(68, 88), 100, 102}


def test_ids_with_several_texts_and_repeated_rows(spark):
    one, two, copy = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80)), " ".join(f"b{i}" for i in range(79))
    rows = [(7, one, "x"), (7, two, "x"), (7, one, "x"), (9, copy, "x"), (None, one, "x"), (None, one, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    for keep in (nc.dedup, simhash.dedup):
        got = keep(docs).collect()
        assert sorted([r["text"] for r in got if r["doc_id"] is not None])[:2] == [one, two] and sum(r["doc_id"] is None for r in got) == 2
        assert keep(docs).columns == docs.columns and keep(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in nc.dedup(docs).filter("doc_id IS NOT NULL").collect()) == [7, 7]


def test_stage_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = [r["doc_id"] for r in kept]
    assert len(left) == len(set(left)) < len(texts)
    gone = [i for i in texts if i not in set(left)]
    # what goes has a near copy; of those that stay, hardly any has one (brute force over all pairs)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    held: dict = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    pairs = set()
    for ids in held.values():
        pairs |= {(a, b) for k, a in enumerate(ids[:200]) for b in ids[k + 1 : 200]}
    alike = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} | {(a, b) for a in texts for b in texts if a < b and not sets[a] and not sets[b]}
    near = {i for p in alike for i in p}
    assert set(gone) <= near and len([1 for a, b in alike if a in set(left) and b in set(left)]) <= 0.02 * len(alike)


def test_crowded_buckets_lose_no_link_away_from_their_centre(spark):
    """A chain of texts, each alike only to its neighbours: in one bucket, all but a few links pass the centre by."""
    rng = np.random.default_rng(9)
    words, rows = [f"w{i}" for i in range(400)], []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for k in rng.choice(400, 6, replace=False):
            words[k] = f"new{i}_{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = np.array([nc.fingerprint(t) for _, t in rows], np.uint64)
    fps = [(0, 0, int(f)) for f in prints.view(np.int64)]
    texts = dict(rows)
    linked = {(a, b) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.8 and bin(int(prints[a] ^ prints[b])).count("1") <= nc.RADIUS}
    group = {i: i for i in texts}
    for _ in texts:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    for dense in (0, 2, 128):
        assert {r["doc_id"] for r in nc.dedup(docs, dense).collect()} == set(group.values())
    held = spark.createDataFrame(fps, "segment int, word int, fp long")
    groups = spark.createDataFrame([(f, i // 4) for i, (_, _, f) in enumerate(fps)], "fp long, root long")
    met = {frozenset((r["u"], r["v"])) for r in nc.apart(held, groups).collect()}
    assert met == {frozenset((fps[a][2], fps[b][2])) for a in texts for b in texts if a // 4 < b // 4 and bin(int(prints[a] ^ prints[b])).count("1") <= nc.RADIUS}


def test_a_crowd_of_texts_that_are_not_alike_is_not_paired(spark, monkeypatch):
    """Copies of one text with so many edits that hardly two are alike, though most fingerprints are near each other."""
    rng = np.random.default_rng(4)
    base = [f"w{rng.integers(4000)}" for _ in range(600)]
    texts = [" ".join(base)] + [edited(rng, base, 16 + i % 8) for i in range(80)]
    far = edited(rng, base, 22).split()
    texts += [" ".join(far), edited(rng, far, 4)]  # alike, but not to the base
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = np.array([nc.fingerprint(t) for t in texts], np.uint64)
    near = {(a, b) for b in range(len(texts)) for a in range(b) if bin(int(prints[a] ^ prints[b])).count("1") <= nc.RADIUS}
    group = {i: i for i in range(len(texts))}
    linked = [(a, b) for a, b in near if similarity(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    asked, real = [], nc.written
    monkeypatch.setattr(nc, "written", lambda df, name: asked.append((name, real(df, name))) or asked[-1][1])
    assert {r["doc_id"] for r in nc.dedup(docs, 4).collect()} == set(group.values())
    apart = [df.count() for name, df in asked if name == "apart"]
    assert len(near) > 500 and len(apart) == 1 and apart[0] < 50 and (81, 82) in linked, (len(near), apart)


def test_similar_sets_share_one_of_their_rarest_elements(spark):
    rng = np.random.default_rng(2)
    sets = [set(range(40))]
    for i in range(120):
        own = set(sets[rng.integers(len(sets))])
        own -= set(rng.choice(sorted(own), rng.integers(0, min(len(own), 8)), replace=False).tolist())
        sets.append(own | set(rng.integers(0, 90, rng.integers(1, 5)).tolist()))
    frame = spark.createDataFrame([(i, 0, sorted(s)) for i, s in enumerate(sets)], "node long, fp long, s array<long>")
    one = nc.rarest(frame)
    other = one.select("s", *[one[n].alias(f"other_{n}") for n in ("node", "size", "left")])
    met = {(r["node"], r["other_node"]) for r in one.join(other, "s").filter(nc._enough()).filter("node < other_node").collect()}
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= nc.SIMILAR * len(sets[a] | sets[b])}
    assert len(alike) > 100 and alike <= met


@pytest.mark.parametrize("dense", [128, 2])
def test_texts_of_one_fingerprint_meet_each_other(spark, monkeypatch, dense):
    """The smallest text hash of a fingerprint need not be alike to the others; these may be alike to each other."""
    texts = [" ".join(f"{n}{i}" for i in range(60)) for n in "abcd"] + [" ".join(f"d{i}" for i in range(59))]
    docs = spark.createDataFrame([*enumerate(texts), (8, ""), (9, " ")], "doc_id long, text string")
    prints = spark.createDataFrame([(r["doc_id"], r["h"], 5) for r in docs.select("doc_id", simhash._text_hash().alias("h")).collect()], "doc_id long, node long, fp long")
    monkeypatch.setattr(nc, "_prints", lambda docs: prints)
    assert {r["doc_id"] for r in nc.dedup(docs, dense).collect()} == {0, 1, 2, 3, 8}

"""Near-duplicate links against brute force, classifiers on held-out rows, and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from kinetable.llm import decontamination, near_copies, quality, simhash, toxicity, vectors
from kinetable.llm import queries as llm
from kinetable.llm.components import components

SF = "/root/testdata/sf0.01"


def reach(nodes, edges):
    """Smallest node that each node reaches."""
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, k) for k in range(601, 700)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = reach({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def simhash_docs():
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 60)) for _ in range(12)]
    texts = []
    for i in range(240):
        words = base[i % 12].split()
        for _ in range(i % 4):
            words[int(rng.integers(60))] = "zz"
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate([*texts, "", None, "one two", "ONE\ttwo", "É x y z", "a" * 9])] + [(7, texts[7]), (None, texts[5]), (None, "only here now you")]


def fp_by_hand(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("dense", [1024, 3])
def test_simhash_classes(spark, dense):
    rows = simhash_docs()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted([tuple(r) for r in simhash.classes(docs, dense=dense).collect()], key=repr)
    fps = [fp_by_hand(t) for _, t in rows]
    nodes = sorted(set(fps))
    label = reach(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == sorted([(i, signed(f), least.get(label[f])) for (i, _), f in zip(rows, fps)], key=repr)
    assert simhash.classes(docs.limit(0)).count() == 0


def test_simhash_dedup_keeps_one_of_each(spark):
    rows = simhash_docs()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    kept = simhash.dedup(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    named = {r["component_id"] for r in simhash.classes(docs).collect()} - {None}
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(named) and ids.count(None) == 2


def vector_rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    y = (base[rng.integers(0, 30, 500)] + 0.17 * rng.normal(size=(500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(y)] + [(1000 + i, y[3].tolist()) for i in range(20)]
    return rows + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, (y[3] * 2).tolist()), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, y[3].tolist())]


@pytest.mark.parametrize("block", [1024, 40])
def test_vectors(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, k1 int").repartition(3)
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x in good for b, z in good if a < b and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.9]
    label, count = reach([i for i, _ in good], links), {}
    for a, b in links:
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    want = [(i, count.get(i, 0), label.get(i, i), i is not None and label.get(i, i) == i) for i, _ in rows]
    assert sorted(map(tuple, vectors.near_duplicates(df, block=block).collect()), key=repr) == sorted(want, key=repr)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(0)
    for density in (0.02, 0.1, 0.5):
        link = rng.random((40, 30)) < density
        all_edges = [((0, int(i)), (1, int(j))) for i, j in np.argwhere(link)]
        some = [((0, i), (1, j)) for i, j in vectors.forest(link)]
        nodes = {x for e in all_edges for x in e}
        assert set(some) <= set(all_edges) and reach(nodes, some) == reach(nodes, all_edges) and len(some) < len(nodes) + 1


# ------------------------------------------------------------------------------ classifiers


def test_quality_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in llm.op7_quality(spark, SF).collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in rows])
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in llm.op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    toxic = [got[r["doc_id"]]["predicted"] for r in rows if r["toxic"] == 1]
    clean = [got[r["doc_id"]]["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


@pytest.mark.parametrize("fit, score, column", [(quality.fit, quality.score, "quality"), (toxicity.fit, toxicity.score, "toxic")])
def test_classifiers_on_odd_rows(spark, fit, score, column):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (2, "", "x"), (3, "w " * 200_000, "x"), (None, "q", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    some = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 0), (3, 0)], f"doc_id long, {column} int")
    for labels in (none, some):
        got = score(docs, fit(docs, labels)).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    z = rng.normal(size=300)
    knots, values = toxicity.isotonic(z, (z + rng.normal(size=300) > 0).astype(float), np.ones(300))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()


# -------------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality_filter(spark, docs, SF)
    judged = {r["doc_id"]: r["predicted"] for r in llm.op7_quality(spark, SF).collect()}
    assert {r["doc_id"] for r in first.select("doc_id").collect()} == {i for i, p in judged.items() if p}
    second = corpus_pipeline.near_dedup(spark, first, SF).cache()
    assert second.count() < first.count() == near_copies.dedup(second).unionByName(first.join(second.select("doc_id"), "doc_id", "left_anti").select(first.columns)).count()
    third = corpus_pipeline.repeat_removal(spark, second, SF).cache()
    fourth = corpus_pipeline.benchmark_removal(spark, third, SF)
    assert second.columns == third.columns == fourth.columns == docs.columns and fourth.count() == second.count()
    left = decontamination.find(fourth, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left.filter("size(spans) > 0").count() == 0
    last = corpus_pipeline.run(spark, SF).collect()
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert len(last) == len(texts)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in last)


def test_vectors_move_once_a_stripe(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 12))
    y = np.concatenate([base[0] + 0.02 * rng.normal(size=(300, 12)), base[rng.integers(0, 5, 200)] + 0.2 * rng.normal(size=(200, 12))])
    x = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    near = (x @ x.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    label = reach(range(len(y)), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>").repartition(4)
    edges, whole = [], vectors.components
    monkeypatch.setattr(vectors, "components", lambda e: (edges.append(e.count()), whole(e))[1])
    for stripe in (1, 5 * 20 * 12 * 8, vectors.STRIPE_BYTES):  # a block, five blocks, all blocks
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, block=20, stripe_bytes=stripe).collect()}
        assert got == {i: (int(near[i].sum()), label[i]) for i in range(len(y))}
    assert edges[-1] < 3000  # a task's forest; forests of block pairs had 7,493 edges

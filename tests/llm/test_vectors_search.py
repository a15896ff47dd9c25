"""Centroid clustering against plain integer arithmetic, and neighbours against brute force."""

import hashlib
import math

import numpy as np
import pytest

from kinetable.llm import centroids, neighbours
from kinetable.llm import queries as llm

# ------------------------------------------------------------------------------ clusters


def clusters_by_hand(rows, k=8, rounds=10, dim=64):
    """The contract in Python integers: (id, cluster, distance, cluster inertia, inertia, centroid hash), sorted."""
    held = [(i, [math.floor(v) * 1024 if abs(v) > 2.0**60 else math.floor(1024 * v) for v in x], x) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(held, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centres = [r[1] for r in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for n in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v, _ in held]
        if n < rounds:
            for j in range(len(centres)):
                part = [v for (_, v, _), o in zip(held, own) if o == j]
                centres[j] = [sum(p) // len(part) for p in zip(*part)] if part else centres[j]
    d = [min(far(v, centres[o]), 2**63 - 1) for (_, v, _), o in zip(held, own)]
    by = [min(sum(x for x, o in zip(d, own) if o == j), 2**63 - 1) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in centres]
    return sorted([(i, o, x, by[o], min(sum(d), 2**63 - 1), digest[o]) for (i, _, _), o, x in zip(held, own, d)], key=repr)


def clusters_found(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted([tuple(r[n] for n in names) for r in centroids.report(df).collect()], key=repr)


def test_clusters_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert clusters_found(df) == clusters_by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()])


@pytest.mark.parametrize("kind", ["groups", "line", "equal", "huge", "few"])
def test_clusters_of_odd_vectors(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "groups": rng.normal(size=(6, 64))[rng.integers(0, 6, 150)] + 0.05 * rng.normal(size=(150, 64)),
        "line": np.outer(rng.integers(0, 9, 120), np.ones(64)),
        "equal": np.ones((40, 64)),
        "huge": rng.normal(size=(30, 64)) * 10.0 ** rng.integers(-3, 300, (30, 1)),
        "few": rng.normal(size=(3, 64)),
    }[kind]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] + [1.0] * 63), (903, [math.inf] * 64), (904, [math.nan] * 64), (1, x[2].tolist()), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, cluster int, x int").repartition(3)
    assert clusters_found(df) == clusters_by_hand(rows)
    assert centroids.report(df.limit(0)).count() == 0 and centroids.report(df.filter("vec_id > 900")).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(0)
    x = rng.integers(-200, 200, (8, 64))[rng.integers(0, 8, 400)] + rng.integers(-20, 20, (400, 64))
    base = centroids.Simplex(centroids.choose_pivots(x[:64].tolist()))
    a = base.apexes(base.distances(x))
    true = np.sqrt(((x[:, None] - x[None, :30]) ** 2).sum(axis=2))
    flat = ((a[:, None, :-1] - a[None, :30, :-1]) ** 2).sum(axis=2)
    low, high = (np.sqrt(flat + (a[:, None, -1] + s * a[None, :30, -1]) ** 2) for s in (-1, 1))
    assert (low <= true + 1e-5).all() and (true <= high + 1e-5).all()
    _, took = centroids.nearest(x, a, x[:8].tolist(), base)
    assert took < 0.5 * len(x) * 8


# ------------------------------------------------------------------------------ neighbours


def near_by_hand(rows, k, every):
    good = [(i, np.array(x, float) / max(map(abs, x)), n) for n, (i, x) in enumerate(rows) if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    out = {}
    for i, q, n in good:
        if i % every == 0:
            out.setdefault(i, []).append(sorted((-float((q * x).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum()))), j) for j, x, o in good if o != n and len(x) == len(q))[:k])
    return out


def recall(df, k, every, **settings):
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    want = near_by_hand(rows, k, every)
    got = {}
    for r in neighbours.nearest(df, k=k, every=every, **settings).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    return want, got


def hits(want, got):
    total = sum(len(w[0]) for w in want.values())
    return sum(len({j for _, j in w[0]} & {j for _, _, j in got.get(i, [])}) for i, w in want.items()) / total


@pytest.mark.parametrize("leaf", [8192, 60])
def test_recall_on_the_given_table(spark, leaf):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want, got = recall(df, 5, 5, leaf=leaf)
    assert set(got) == set(want) and hits(want, got) >= 0.95
    assert all([r for r, _, _ in g] == [1, 2, 3, 4, 5] and g == sorted(g) for g in got.values())


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9, 12))[rng.integers(0, 9, 200)] + 0.3 * rng.normal(size=(200, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, x[5].tolist()) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 12), (410, [math.nan] * 12), (420, [None] * 12), (430, [1.0, 2.0]), (440, [2.0, 1.0]), (450, [3.0]), (460, []), (None, x[1].tolist()), (470, (x[3] * 1e200).tolist()), (480, [1e-200, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, k1 int, score string").repartition(3)
    # sure of everything: the search is exact then
    want, got = recall(df, 5, 10, sure=1 - 1e-12, leaf=30)
    for i, lists in want.items():
        assert [j for _, j in lists[0]] == [j for _, _, j in got.get(i, [])], i
        assert np.allclose([s for s, _ in lists[0]], [s for _, s, _ in got.get(i, [])], atol=1e-12)
    assert set(got) == {i for i, w in want.items() if w[0]}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_repeated_ids_leave_out_the_own_row_only(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 3)) for r in got) == sorted(2 * [(50, 1, 50, 1.0), (50, 2, 7, 0.707), (50, 3, 50, 0.0)] + [(50, 1, 7, 0.707), (50, 2, 50, 0.0), (50, 3, 50, 0.0)])


def test_stopping_test():
    for p in (0.1, 0.5, 0.98):
        assert abs(neighbours.chi_square(neighbours.quantile(p)) - p) < 1e-9
    rng = np.random.default_rng(1)
    share = ((rng.normal(size=(20_000, neighbours.M)) ** 2).sum(axis=1) <= neighbours.quantile(0.9)).mean()
    assert abs(share - 0.9) < 0.01

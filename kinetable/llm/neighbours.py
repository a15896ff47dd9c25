"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected on ``M`` Gaussian directions; a projected squared distance is the true one times a chi-square
variable with ``M`` degrees.  A kd-tree over the projections, its upper levels fitted to a bounded sample, deals all
vectors to leaves; each leaf is a kd-tree of its own with buckets.  A query takes projected neighbours in growing distance
and verifies their cosine, until the chi-square test holds: a vector nearer than the k-th found would, with probability
``SURE``, have a smaller projected distance than all that are left.

Queries first search the leaf they lie in.  The k-th cosine found there bounds the projected distance of every other
leaf worth a visit.  No leaf or query set meets as a whole: leaves are packed into blobs of bounded size, queries into
chunks, and their pairs are joined by leaf.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part.
Vectors of different lengths are never near.  Equal vectors are one point with its smallest ids; a query leaves out its
own row only, so a second row of its id is a candidate.  Fewer candidates than ``k`` are all returned, each as verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import _arrow_schema, written

c = F.col

#: Directions; an even number, for which the chi-square distribution is a short sum.
M = 8
#: Each true neighbour is passed over with a probability of at most ``1 - SURE``.
SURE = 0.98
#: Vectors in a leaf's blob, in a bucket of its tree, and queries in a chunk.
LEAF, BUCKET, CHUNK = 8192, 32, 256
#: Rows that the upper levels are fitted to, and the most leaves they may have (a broadcast table of boxes).
SAMPLE, MOST_LEAVES = 32_768, 2048


def chi_square(x: float, m: int = M) -> float:
    """The distribution function for an even number of degrees."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int = M) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng([dim, m]).normal(size=(dim, m))


def usable(column: str) -> Column:
    v = c(column)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with ``q``, the same for equal rows wherever they stand."""
    big = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    small = min(np.abs(x).max(axis=1).min(initial=1), np.abs(q).max(initial=1))
    if big > 1e150 or small < 1e-150:
        x, q = x / np.abs(x).max(axis=1, keepdims=True), q / np.abs(q).max()
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


# ---------------------------------------------------------------------------- trees


def split(y: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of a kd-tree's leaves: halves by the widest direction until at most ``most`` are left."""
    if len(rows) <= most:
        return [rows]
    part = y[rows]
    axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
    order = rows[np.argsort(part[:, axis], kind="stable")]
    half = len(order) // 2
    return split(y, order[:half], most) + split(y, order[half:], most)


def cuts(y: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Upper levels as nodes (axis, border, left, right); a child below 0 is leaf ``-1 - child``."""
    nodes: list = []
    count = 0

    def grow(rows: np.ndarray, n: int) -> int:
        nonlocal count
        part = y[rows]
        width = part.max(axis=0) - part.min(axis=0) if len(rows) > 1 else np.zeros(1)
        if n <= 1 or width.max() == 0:
            count += 1
            return -count
        axis = int(width.argmax())
        border = float(np.median(part[:, axis]))
        if border <= part[:, axis].min():
            border = float(part[part[:, axis] > border, axis].min())
        at = len(nodes)
        nodes.append(None)
        low = part[:, axis] < border
        left = grow(rows[low], n // 2)
        right = grow(rows[~low], n - n // 2)
        nodes[at] = (axis, border, left, right)
        return at

    root = grow(np.arange(len(y)), leaves)
    return nodes if root >= 0 else []


def leaf_of(y: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(y), np.int64)
    if not nodes:
        return out
    todo = [(0, np.arange(len(y)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -1 - at
        elif len(rows):
            axis, border, left, right = nodes[at]
            low = y[rows, axis] < border
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def gaps(low: np.ndarray, high: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Projected distance of a point to boxes."""
    off = np.maximum(np.maximum(low - y, y - high), 0)
    return np.sqrt((off * off).sum(axis=1))


def search(x: np.ndarray, y: np.ndarray, starts: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], q: np.ndarray, z: np.ndarray, weights: np.ndarray, k: int, bound: float, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and cosines of the nearest found among points in buckets, and how many were verified.

    ``bound``: the k-th cosine known before.  ``weights``: how many candidates a point stands for.
    Buckets are taken in growing projected distance, ever more at a time; a bucket's points that the
    test has passed over already are not verified.
    """
    away = gaps(*boxes, z)
    order = np.argsort(away, kind="stable")
    rows, found, verified, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 0, 1
    worst = bound
    while at < len(order):
        limit = math.sqrt(max(2 - 2 * worst, 0)) * reach + 1e-9 if worst > -1 else math.inf
        if away[order[at]] > limit:
            break  # the stopping test holds
        near = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in order[at : at + step] if away[b] <= limit])
        off = y[near] - z
        near = near[np.sqrt((off * off).sum(axis=1)) <= limit]
        if len(near):
            verified += len(near)
            score = cosines(x[near], q)
            rows, found = np.concatenate([rows, near]), np.concatenate([found, score])
            best = np.argsort(-found, kind="stable")
            covered = np.cumsum(weights[rows[best]])
            if covered[-1] >= k:
                kth = found[best[int(np.searchsorted(covered, k))]]
                worst = max(worst, float(kth))
                keep = best[found[best] >= worst]
                rows, found = rows[keep], found[keep]
        at, step = at + step, step * 2
    return rows, found, verified


# ---------------------------------------------------------------------------- spread work


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _points(vectors: DataFrame, id_col: str, vector_col: str, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their ``k + 1`` smallest ids, and the query rows with the key of their vector."""
    rows = vectors.select(c(id_col).cast("bigint").alias("vec_id"), c(vector_col).cast("array<double>").alias("x")).filter(usable("x") & c("vec_id").isNotNull())
    keyed = rows.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})
    low = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).filter(c("_rank") <= k + 1)
    points = low.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("x").alias("x"))
    return written(points.withColumn("dim", F.size("x")), "points"), keyed.filter(c("vec_id") % every == 0).select("vec_id", "k1", "k2")


def _dealt(points: DataFrame, dim: int, nodes: list, m: int) -> DataFrame:
    """Points with their leaf and projection."""
    ids = "k1 bigint, k2 bigint, ids array<bigint>, x array<double>, asks boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = directions(dim, m)
        for batch in batches:
            if batch.num_rows:
                y = unit(_matrix(batch.column("x"), dim)) @ base
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * m), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(y, nodes)), flat], names=[*batch.schema.names, "leaf", "y"])

    return points.select("k1", "k2", "ids", "x", "asks").mapInArrow(run, f"{ids}, leaf bigint, y array<double>")


def _packed(dealt: DataFrame, dim: int, m: int) -> DataFrame:
    """A row a blob: a leaf's points in the order of their buckets, with the buckets' boxes."""
    schema = "leaf bigint, sub bigint, low array<double>, high array<double>, k1 array<bigint>, k2 array<bigint>, ids array<array<bigint>>, xs binary, ys binary, starts array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(key, table):
        x, y = _matrix(table.column("x").combine_chunks(), dim), _matrix(table.column("y").combine_chunks(), m)
        parts = split(y, np.arange(len(x)), BUCKET)
        order, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        held = table.take(pa.array(order))
        row = [key[0].as_py(), key[1].as_py(), y.min(axis=0).tolist(), y.max(axis=0).tolist(), *[held.column(n).to_pylist() for n in ("k1", "k2", "ids")], x[order].tobytes(), y[order].tobytes(), starts.tolist()]
        return pa.Table.from_pylist([dict(zip(names, row))], schema=target)

    target = _arrow_schema(dealt.sparkSession, schema)
    return dealt.groupBy("leaf", "sub").applyInArrow(pack, schema)


def _chunks(asked: DataFrame) -> DataFrame:
    """Queries of one blob as rows of at most ``CHUNK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"leaf": held[0]["leaf"], "sub": held[0]["sub"], "asked": [{n: r[n] for n in ("k1", "k2", "x", "y", "bound")} for r in held]}], schema=target)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= CHUNK or (held[0]["leaf"], held[0]["sub"]) != (row["leaf"], row["sub"])):
                    yield told()
                    held = []
                held.append(row)
        if held:
            yield told()

    schema = "leaf bigint, sub bigint, asked array<struct<k1: bigint, k2: bigint, x: array<double>, y: array<double>, bound: double>>"
    target = _arrow_schema(asked.sparkSession, schema)
    return asked.select("leaf", "sub", "k1", "k2", "x", "y", "bound").sortWithinPartitions("leaf", "sub").mapInArrow(run, schema)


_FOUND = "q1 bigint, q2 bigint, k1 bigint, k2 bigint, ids array<bigint>, score double, verified bigint"


def _searched(chunks: DataFrame, blobs: DataFrame, dim: int, m: int, k: int, sure: float) -> DataFrame:
    """What each query finds in the blobs it visits; its own point counts as found."""
    reach = math.sqrt(quantile(sure, m))
    met = chunks.withColumnsRenamed({"leaf": "_leaf", "sub": "_sub"}).join(blobs.drop("low", "high"), (c("leaf") == c("_leaf")) & (c("sub") == c("_sub")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                x, y = np.frombuffer(row["xs"].as_py()).reshape(-1, dim), np.frombuffer(row["ys"].as_py()).reshape(-1, m)
                starts = np.array(row["starts"].as_py())
                boxes = np.minimum.reduceat(y, starts[:-1]), np.maximum.reduceat(y, starts[:-1])
                k1, k2, ids = (row[n].as_py() for n in ("k1", "k2", "ids"))
                weights = np.array([len(i) for i in ids])
                out: list[tuple] = []
                for q in row["asked"].as_py():
                    rows, found, verified = search(x, y, starts, boxes, np.array(q["x"]), np.array(q["y"]), weights, k + 1, q["bound"], reach)
                    out += [(q["k1"], q["k2"], k1[i], k2[i], ids[i], s, verified * (n == 0)) for n, (i, s) in enumerate(zip(rows.tolist(), found.tolist()))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

    kinds = [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return met.select("asked", "k1", "k2", "ids", "xs", "ys", "starts").mapInArrow(run, _FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    """A query's ``most`` nearest candidates (rows, not points): largest score, then smallest id."""
    # one task a query sees at most a few points of each blob that was visited
    rows = found.select("q1", "q2", "k1", "k2", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q1", "q2").orderBy(c("score").desc(), "vec_id", "k1", "k2")
    return rows.withColumn("place", F.row_number().over(order)).filter(c("place") <= most)


def _one_length(points: DataFrame, dim: int, k: int, m: int, sure: float, leaf: int) -> DataFrame:
    own = points.filter(c("dim") == dim)
    total = own.count()
    sample = own.orderBy("k1", "k2").limit(SAMPLE).select("x").collect()
    y = unit(np.array([r["x"] for r in sample])) @ directions(dim, m)
    nodes = cuts(y, min(MOST_LEAVES, -(-total // leaf)))
    dealt = _dealt(own, dim, nodes, m)
    counts = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_LEAVES rows
    # a leaf that outgrew its share is dealt to several blobs by hash
    subs = dealt.sparkSession.createDataFrame([(i, -(-n // (2 * leaf))) for i, n in counts.items()], "_leaf bigint, subs bigint")
    dealt = dealt.join(F.broadcast(subs), c("leaf") == c("_leaf")).drop("_leaf").withColumn("sub", F.pmod("k1", "subs"))
    dealt = written(dealt, "dealt")
    blobs = written(_packed(dealt, dim, m), "leaves")
    asked = dealt.filter("asks")
    home = _searched(_chunks(asked.withColumn("bound", F.lit(-1.0)).repartition("leaf", "sub")), blobs, dim, m, k, sure)
    home = written(home, "home")
    first = _best(home, k + 1).groupBy("q1", "q2").agg(F.min(F.when(c("place") == k + 1, c("score"))).alias("bound"))
    again = asked.join(first, (c("k1") == c("q1")) & (c("k2") == c("q2"))).select("k1", "k2", "x", "y", F.coalesce("bound", F.lit(-1.0)).alias("bound"), c("leaf").alias("home"), c("sub").alias("home_sub"))
    others = _searched(_chunks(_visits(again, blobs, sure, m).repartition("leaf", "sub")), blobs, dim, m, k, sure)
    return home.unionByName(others)


def _visits(asked: DataFrame, blobs: DataFrame, sure: float, m: int) -> DataFrame:
    """The blobs besides its own that a query has to visit; their boxes are the only broadcast, a row a blob."""
    boxes = blobs.select("leaf", "sub", "low", "high").collect()
    low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
    names = np.array([(b["leaf"], b["sub"]) for b in boxes])
    reach = math.sqrt(quantile(sure, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bound = _matrix(batch.column("y"), m), batch.column("bound").to_numpy()
            home = np.column_stack([batch.column("home").to_numpy(), batch.column("home_sub").to_numpy()])
            rows, to = [], []
            for i in range(len(y)):
                limit = math.sqrt(max(2 - 2 * bound[i], 0)) * reach + 1e-9 if bound[i] > -1 else math.inf
                near = np.flatnonzero((gaps(low, high, y[i]) <= limit) & (names != home[i]).any(axis=1))
                rows += [i] * len(near)
                to += near.tolist()
            part = batch.take(pa.array(rows, pa.int64()))
            cols = [part.column(n) for n in ("k1", "k2", "x", "y", "bound")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[to, 0], pa.int64()), pa.array(names[to, 1], pa.int64())], names=["k1", "k2", "x", "y", "bound", "leaf", "sub"])

    return asked.mapInArrow(run, "k1 bigint, k2 bigint, x array<double>, y array<double>, bound double, leaf bigint, sub bigint")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", m: int = M, sure: float = SURE, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of every row whose id is divisible by ``every``."""
    points, queries = _points(vectors, id_col, vector_col, every, k)
    asking = queries.select(c("k1").alias("_a1"), c("k2").alias("_a2")).distinct()
    points = points.join(asking, (c("k1") == c("_a1")) & (c("k2") == c("_a2")), "left").withColumn("asks", c("_a1").isNotNull()).drop("_a1", "_a2")
    lengths = sorted(r[0] for r in points.select("dim").distinct().collect())
    found = [vectors.sparkSession.createDataFrame([], _FOUND)]
    for dim in lengths:
        found.append(_one_length(points, dim, k, m, sure, leaf))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    best = _best(written(both, "found"), k + 1)
    entry = F.struct("place", "vec_id", "score", ((c("k1") == c("q1")) & (c("k2") == c("q2"))).alias("same"))
    lists = written(best.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(entry)).alias("near")), "nearest")
    met = queries.join(lists, (c("k1") == c("q1")) & (c("k2") == c("q2"))).select(c("vec_id").alias("query_id"), "near")
    # the query's own row is the first entry of its vector and id
    at = F.array_position(F.transform("near", lambda e: e["same"] & (e["vec_id"] == c("query_id"))), F.lit(True))
    others = F.slice(F.filter("near", lambda e, i: i + 1 != at), 1, k)
    return met.select("query_id", F.posexplode(others).alias("pos", "e")).select("query_id", (c("pos") + 1).alias("rank"), c("e.vec_id").alias("vec_id"), c("e.score").alias("score"))

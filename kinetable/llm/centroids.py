"""Centroid clustering of integer vectors with n-simplex bounds.

A few vectors serve as pivots.  A vector's distances to them place it as the apex of a simplex over the pivots: the
first coordinates are its projection on the pivots' span, the last one its height above it.  Between two apexes the
Euclidean distance is a lower bound of the true distance, and with the heights added an upper one.  Apexes are
computed once and kept in a table; in each round the bounds rule out centroids, and those that are left are compared by
exact integer distances.  Rounds read one table and send sums to the driver, never vectors.

The nearer centroids lie to the pivots' span, the closer the two bounds.  So the pivots are places that centroids pass
through when a bounded sample is clustered; they steer what is compared exactly, never the result.

Defined cases: only vectors with ``dim`` components, none null or non-finite, are kept; others give no row.  Rows with
a null id take part and return it; their hash is that of ``3:``.  Rows of equal hash (repeated ids) start in the order
of their components.  Fewer than ``k`` kept vectors start fewer centroids; none give no rows.  Integers are exact at any
size; a distance or sum beyond the range of long is given as the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import written

c = F.col

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: At most so many pivots, from the clustering of so many rows with the smallest hashes.
PIVOTS, SAMPLE = 32, 8192
#: Below this magnitude squared distances of 64 components fit 64-bit integers.
SMALL = 1 << 27
LONG_MAX = (1 << 63) - 1


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``, as 64-bit integers or, where some are too large for exact squares, as Python integers."""
    y = x * scale  # exact, as the scale is a power of two
    if np.abs(y).max(initial=0) < SMALL:
        return np.floor(y).astype(np.int64)
    flat = [math.floor(v) * scale if abs(v) > 2.0**60 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows as exact integers."""
    if a.dtype == object or max((abs(int(v)) for v in b.ravel()), default=0) >= SMALL:
        a, b = a.astype(object), b.astype(object)
    else:
        b = b.astype(np.int64)
    return ((a - b) ** 2).sum(axis=-1)


def as_doubles(a: np.ndarray) -> np.ndarray:
    """Integers as doubles; those beyond their range are infinite, which rules nothing out."""
    if a.dtype != object:
        return a.astype(np.float64)
    far = 1 << 1023
    return np.array([float(v) if -far < v < far else math.inf if v > 0 else -math.inf for v in a.ravel()]).reshape(a.shape)


class Simplex:
    """A base of pivots; places vectors by their distances to them."""

    def __init__(self, pivots: list[list[int]]):
        self.points = np.array(pivots, object)
        x = as_doubles(self.points)
        with np.errstate(all="ignore"):
            self.base = np.linalg.qr((x[1:] - x[0]).T)[0] if len(x) > 1 else np.zeros((x.shape[1], 0))
            self.corners = (x - x[0]) @ self.base

    def distances(self, ints: np.ndarray) -> np.ndarray:
        """A column a pivot: distances of the rows, from exact squares."""
        return np.stack([np.sqrt(as_doubles(exact_distance(ints, p))) for p in self.points], axis=1)

    def apexes(self, d: np.ndarray) -> np.ndarray:
        """Apex coordinates from distances alone: a projection on the pivots' span, then the height."""
        with np.errstate(all="ignore"):
            # |v - p0|^2 - |v - pi|^2 + |pi - p0|^2 = 2 (v - p0) . (pi - p0)
            rest = self.corners[1:]
            dots = (d[:, :1] ** 2 - d[:, 1:] ** 2 + (rest**2).sum(axis=1)) / 2
            flat = np.linalg.solve(rest, dots.T).T if len(rest) else np.zeros((len(d), 0))
            height = np.sqrt(np.maximum(d[:, 0] ** 2 - (flat**2).sum(axis=1), 0))
        return np.column_stack([flat, height])


def passed_through(sample: np.ndarray, k: int, rounds: int) -> list[list[int]]:
    """Where the centroids of a sample lie: at the end, at the start, and after each round."""
    centres = [sample[i].tolist() for i in range(min(k, len(sample)))]
    path = [centres]
    for _ in range(rounds if sample.dtype != object else 0):
        d = np.stack([exact_distance(sample, np.array(p)) for p in centres], axis=1)
        own = d.argmin(axis=1)
        centres = [[t // int((own == j).sum()) for t in sample[own == j].sum(axis=0).tolist()] if (own == j).any() else p for j, p in enumerate(centres)]
        path.append(centres)
    return [p for now in (path[-1], *path[:-1]) for p in now]


def choose_pivots(pool: list[list[int]], most: int = PIVOTS) -> list[list[int]]:
    """Places that stand high above the span of those chosen before; flat ones would spoil the arithmetic."""
    if not pool or max(abs(v) for p in pool for v in p) >= SMALL:
        return pool[:1]
    x = np.array(pool, float)
    chosen, left, longest = [0], x - x[0], None
    while len(chosen) < most:
        height = np.sqrt((left**2).sum(axis=1))
        at = int(height.argmax())
        longest = height[at] if longest is None else longest
        if height[at] <= longest * 0.01 or height[at] == 0:
            break
        chosen.append(at)
        axis = left[at] / height[at]
        left = left - np.outer(left @ axis, axis)
    return [pool[i] for i in chosen]


def open_pairs(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centroids the bounds leave for each vector: those whose lower bound is not above the least upper bound."""
    with np.errstate(all="ignore"):
        flat = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
        low = np.sqrt(flat + (apexes[:, None, -1] - centres[None, :, -1]) ** 2)
        high = np.sqrt(flat + (apexes[:, None, -1] + centres[None, :, -1]) ** 2)
        slack = 1e-5 * (1 + np.abs(apexes).max(axis=1, keepdims=True, initial=0) + np.abs(centres).max(initial=0))
        left = ~(low > high.min(axis=1, keepdims=True) + slack)  # not-a-number leaves a centroid in
    return left


def nearest(ints: np.ndarray, apexes: np.ndarray, centres: list[list[int]], base: Simplex) -> tuple[np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), and how many exact distances that took."""
    points = np.array(centres, object)
    left = open_pairs(apexes, base.apexes(base.distances(points)))
    out, best, took = left.argmax(axis=1), np.full(len(ints), -1, object), 0
    several = left.sum(axis=1) > 1
    for j in range(len(points)):
        rows = np.flatnonzero(left[:, j] & several)
        if len(rows):
            took += len(rows)
            d = exact_distance(ints[rows], points[j])
            held = best[rows]
            better = (held == -1) | (d < held)
            best[rows[better]] = d[better]
            out[rows[better]] = j
    return out, took


def kept(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = c(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.coalesce((F.size(v) == dim) & finite, F.lit(False))
    return vectors.filter(whole).select(c(id_col).alias("vec_id"), v.cast("array<double>").alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _placed(rows: DataFrame, base: Simplex, dim: int) -> DataFrame:
    """``vec_id, x, apex``: the cached coordinates."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apex = base.apexes(base.distances(whole_numbers(_matrix(batch.column(1), dim))))
                flat = pa.array(apex.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "x", "apex"])

    return rows.mapInArrow(run, f"vec_id {kind}, x array<double>, apex array<double>")


def _sums(placed: DataFrame, centres: list[list[int]], base: Simplex, dim: int) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """Of each centroid: how many vectors it is nearest to, and their exact sum; and the exact distances taken.

    A task gives one row a centroid; these are added in about as many tasks as their square root, so that few
    reach the driver.  Sums travel as text, as they may exceed any fixed width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        took = 0
        for batch in batches:
            if batch.num_rows:
                ints = whole_numbers(_matrix(batch.column(1), dim))
                own, more = nearest(ints, _matrix(batch.column(2), len(base.points)), centres, base)
                took += more
                for j in np.unique(own).tolist():
                    part = ints[own == j]
                    have = found.setdefault(j, [0, [0] * dim])
                    have[0] += len(part)
                    have[1] = [a + int(b) for a, b in zip(have[1], part.sum(axis=0).tolist())]
        found.setdefault(0, [0, [0] * dim])
        yield told(found, took)

    def told(found: dict[int, list], took: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"j": pa.array(list(found), pa.int32()), "n": pa.array([v[0] for v in found.values()], pa.int64()), "total": [",".join(map(str, v[1])) for v in found.values()], "took": pa.array([took] + [0] * (len(found) - 1), pa.int64())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        took = 0
        for batch in batches:
            for j, n, total, more in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                have = found.setdefault(j, [0, [0] * dim])
                have[0] += n
                have[1] = [a + int(b) for a, b in zip(have[1], total.split(","))]
                took += more
        if found:
            yield told(found, took)

    schema = "j int, n bigint, total string, took bigint"
    parts = placed.mapInArrow(run, schema)
    few = max(1, math.isqrt(placed.rdd.getNumPartitions()))
    out: dict[int, tuple[int, list[int]]] = {}
    took = 0
    for r in parts.repartition(few).mapInArrow(add, schema).collect():
        n, total = out.get(r["j"], (0, [0] * dim))
        out[r["j"]] = (n + r["n"], [a + int(b) for a, b in zip(total, r["total"].split(","))])
        took += r["took"]
    return out, took


def _assigned(placed: DataFrame, centres: list[list[int]], base: Simplex, dim: int) -> DataFrame:
    kind = placed.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(centres, object)
        for batch in batches:
            if batch.num_rows:
                ints = whole_numbers(_matrix(batch.column(1), dim))
                own, _ = nearest(ints, _matrix(batch.column(2), len(base.points)), centres, base)
                d = np.full(len(own), 0, object)
                for j in np.unique(own).tolist():
                    d[own == j] = exact_distance(ints[own == j], points[j])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([min(int(v), LONG_MAX) for v in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    return placed.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM) -> tuple[DataFrame, list[list[int]], list[float]]:
    """``vec_id, cluster, distance`` of every kept vector, the final centroids, and by round the share of centroid
    comparisons that took an exact distance.  On the driver are ``k`` centroids and ``SAMPLE`` rows."""
    rows = kept(vectors, id_col, vector_col, dim)
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c("vec_id").cast("string"), F.lit(""))), 256))
    first = hashed.orderBy("h", "x").select("x").limit(max(SAMPLE, k)).collect()
    if not first:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), [], []
    sample = whole_numbers(np.array([r["x"] for r in first]))
    centres = sample[:k].tolist()
    base = Simplex(choose_pivots(passed_through(sample, k, rounds)))
    placed = written(_placed(rows, base, dim), "apexes")
    shares: list[float] = []
    for _ in range(rounds):
        found, took = _sums(placed, centres, base, dim)
        shares.append(took / max(1, sum(n for n, _ in found.values()) * len(centres)))
        moved = [[t // found[j][0] for t in found[j][1]] if found.get(j, (0,))[0] else p for j, p in enumerate(centres)]
        if moved == centres:
            break  # further rounds would change nothing
        centres = moved
    return _assigned(placed, centres, base, dim), centres, shares


def report(vectors: DataFrame, **settings) -> DataFrame:
    """Every kept vector's cluster with the figures of its cluster and of all."""
    found, centres, _ = fit(vectors, **settings)
    assigned = written(found, "assigned")
    long = lambda x: F.least(F.coalesce(x, F.lit(0).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint")
    by = assigned.groupBy("cluster").agg(F.sum(c("distance").cast("decimal(28,0)")).alias("sum"))
    sums = {r["cluster"]: r["sum"] for r in by.collect()}  # a row a centroid
    rows = [(j, min(int(sums.get(j) or 0), LONG_MAX), min(int(sum(sums.values())), LONG_MAX), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for j, p in enumerate(centres)]
    figures = vectors.sparkSession.createDataFrame(rows, "_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), c("cluster") == c("_cluster")).drop("_cluster")


def oracle_sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> str:
    """The contract as plain integer arithmetic, every distance taken; exact while squares fit 64 bits."""
    far = "list_sum(list_transform(list_zip(v, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS j, v AS p FROM kept QUALIFY j < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT rid, vec_id, v, j, {far} AS d FROM kept, c{r}) GROUP BY rid)")
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM
 (SELECT j, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY j, i) GROUP BY j) m USING (j))"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (j)"""

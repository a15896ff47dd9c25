"""Grouped aggregates with the tie, rounding and empty-group rules of the domain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.scores import RELIABLE_SOURCES, SOURCES, rounded
from kinetable.operators.joins import interval_join
from kinetable.operators.lineage import stage
from kinetable.operators.onepass import Machine, PlaceIndex, ordered_pass
from kinetable.operators.ordered import Series, dim_join, next_row, prev_row, scan
from kinetable.params import DEFAULTS, VoteParams

c = F.col

# Fixed value: the joints whose mean visibility is the pose confidence.
CORE_JOINTS = tuple(f"{side}_{part}" for part in ("shoulder", "elbow", "wrist", "hip", "knee") for side in ("left", "right"))


def arg_min(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], keep: Mapping[str, str]) -> DataFrame:
    """Columns of the row with the smallest ``by``; ``ties`` make the choice total."""
    picked = F.min_by(F.struct(*[c(s).alias(d) for s, d in keep.items()]), F.struct(by, *ties))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def provenance_counts(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    good = F.count_if(c("source").isin(*RELIABLE_SOURCES))
    return points.groupBy(*keys).agg(
        *[F.count_if(c("source") == s).alias(f"num_{s}") for s in SOURCES],
        F.round(good / F.count(F.lit(1)), 3).alias("quality"),
    )


def provenance_mix(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each source; the window runs over at most four rows per key."""
    n = points.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))
    share = c("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("pct", F.round(share, 4))


def track_quality(points: DataFrame, windows: DataFrame, keys: Sequence[str], window_id: str, at: str, lo: str, hi: str) -> DataFrame:
    """Reliable share of each window's points; 0.0 for windows without points."""
    inside = interval_join(points, windows, keys, at, lo, hi)
    q = inside.groupBy(*keys, window_id).agg(F.avg(F.when(c("source").isin(*RELIABLE_SOURCES), 1.0).otherwise(0.0)).alias("q"))
    return windows.select(*keys, window_id).join(q, [*keys, window_id], "left").select(*keys, window_id, F.coalesce("q", F.lit(0.0)).alias("track_quality"))


def pose_confidence() -> Column:
    """Mean visibility of the core joints."""
    return sum((c(f"joints.{j}.visibility") for j in CORE_JOINTS), F.lit(0.0)) / F.lit(float(len(CORE_JOINTS)))


#: Pieces that splitters cut a key's values into, and the most distinct values of a key that one task ranks.
PIECES, RANKED_AT_ONCE = 64, 1 << 18


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], most: int = RANKED_AT_ONCE) -> DataFrame:
    """The values at several zero-based ranks (expressions over ``n``) of each key's sorted values: ``keys, n`` and ``ranks``.

    Equal values are counted first.  While a key has more than ``most`` distinct values, splitters taken from its own
    data by a quantile sketch cut them into pieces of like size; the pieces are counted, and only the one that holds
    a rank goes on.  What is left is ranked exactly.  Every pass keeps about one part in ``PIECES``.
    """
    k = list(keys)
    counts = stage(df.filter(c(value).isNotNull()).groupBy(*k, value).agg(F.count(F.lit(1)).alias("_k")))
    size = counts.groupBy(*k).agg(F.sum("_k").alias("n"), F.count(F.lit(1)).alias("_d"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), r.cast("long").alias("_rank")) for name, r in ranks.items()])
    targets = size.select(*k, "n", "_d", F.explode(wanted).alias("_t")).select(*k, "n", "_d", "_t.*")
    if size.filter(c("_d") > most).isEmpty():
        left = counts.join(targets.drop("_d"), k)
    else:
        left = _narrowed(counts, stage(targets), k, value, most)
    upto = F.sum("_k").over(Window.partitionBy(*k, "_name").orderBy(value))
    hit = left.withColumn("_cum", upto).filter((c("_cum") > c("_rank")) & (c("_cum") - c("_k") <= c("_rank")))
    return hit.groupBy(*k).agg(F.max("n").alias("n"), *[F.max(F.when(c("_name") == name, c(value))).alias(name) for name in ranks])


def _narrowed(counts: DataFrame, targets: DataFrame, k: list[str], value: str, most: int) -> DataFrame:
    """Counted values around each target, with the rank left to find among them; at most about ``most`` a key."""
    small = dim_join(counts, targets.filter(c("_d") <= most).drop("_d"), k, spread=[value])
    now = dim_join(counts, targets.filter(c("_d") > most).drop("_d"), k, spread=[value])
    part, out = [*k, "_name"], [small]
    while True:
        borders = now.groupBy(*part).agg(F.percentile_approx(value, [i / PIECES for i in range(1, PIECES)], 100 * PIECES).alias("_borders"))
        cut = dim_join(now, borders, part, spread=[value]).withColumn("_piece", F.size(F.filter("_borders", lambda b: b < c(value)))).drop("_borders")
        cut = stage(cut)
        piece = cut.groupBy(*part, "_piece").agg(F.sum("_k").alias("_s"), F.count(F.lit(1)).alias("_d"), F.max("_rank").alias("_r"))
        before = F.sum("_s").over(Window.partitionBy(*part).orderBy("_piece")) - c("_s")
        held = piece.withColumn("_before", before).filter((c("_before") <= c("_r")) & (c("_r") < c("_before") + c("_s")))
        held = stage(held.select(*part, "_piece", "_before", "_d"))
        kept = dim_join(cut, held, [*part, "_piece"], spread=[value]).withColumn("_rank", c("_rank") - c("_before")).drop("_before", "_piece")
        kept = stage(kept)
        out.append(kept.filter(c("_d") <= most).drop("_d"))
        now = kept.filter(c("_d") > most).drop("_d")
        if now.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def with_all_keys(found: DataFrame, spine: DataFrame, keys: Sequence[str], name: str, default: Column) -> DataFrame:
    """Keys of ``spine`` without a value get ``default`` and a count of 0."""
    every = spine.select(*keys).distinct().join(found, list(keys), "left")
    return every.select(*keys, F.coalesce(name, default).alias(name), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "upper_median", default: Column | None = None, most: int = RANKED_AT_ONCE) -> DataFrame:
    """Upper median of each key; with ``default``, keys that hold only nulls get that."""
    found = ranked_values(df, keys, value, {name: F.floor(c("n") / 2)}, most).select(*keys, name, "n")
    return found if default is None else with_all_keys(found, df, keys, name, default)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", most: int = RANKED_AT_ONCE) -> DataFrame:
    """Median of each key, the mean of the two middle values where their number is even; no value, no row."""
    found = ranked_values(df, keys, value, {"_low": F.floor((c("n") - 1) / 2), "_high": F.floor(c("n") / 2)}, most)
    return found.select(*keys, ((c("_low") + c("_high")) / 2).alias(name), "n")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.95, name: str = "p95", spine: DataFrame | None = None, most: int = RANKED_AT_ONCE) -> DataFrame:
    """Nearest-rank quantile, the rank rounded half to even; keys of ``spine`` without a value get 0."""
    rank = F.least(c("n") - 1, F.bround(F.lit(q) * (c("n") - 1), 0))
    found = ranked_values(df, keys, value, {name: rank}, most).select(*keys, name, "n")
    return found if spine is None else with_all_keys(found, spine, keys, name, F.lit(0.0))


def weighted_side(samples: DataFrame, keys: Sequence[str], floor: float = DEFAULTS.detection.landmark_floor) -> DataFrame:
    """Nearer side by visibility-weighted mean distance; null when neither side was seen."""

    def mean(side: str) -> Column:
        ok = c(f"{side}_vis") >= floor
        weight = F.sum(F.when(ok, c(f"{side}_vis")))
        return F.when(weight > 0, F.sum(F.when(ok, c(f"{side}_dist") * c(f"{side}_vis"))) / weight)

    agg = samples.groupBy(*keys).agg(mean("left").alias("left_mean"), mean("right").alias("right_mean"))
    side = (
        F.when(c("left_mean").isNull() & c("right_mean").isNull(), None)
        .when(c("left_mean").isNull(), "right")
        .when(c("right_mean").isNull() | (c("left_mean") < c("right_mean")), "left")
        .otherwise("right")
    )
    return agg.withColumn("shooting_side", side)


def coverage(dets: DataFrame, sessions: DataFrame, keys: Sequence[str], frame: str, total_frames: Column) -> DataFrame:
    """Share of frames with a detection and the mean of the per-frame best confidence.

    ``total_frames`` is an expression over ``sessions``; those without any detection have coverage 0.
    The mean is that of exact sums, so the order the frames come in does not decide how a tie is rounded.
    """
    per = dets.groupBy(*keys, frame).agg(F.max("confidence").alias("best"))
    mean = F.sum(c("best").cast("decimal(28,18)")).cast("double") / F.count("best")
    found = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames_with_detection"), rounded(mean, 4).alias("mean_best_confidence"))
    seen = F.coalesce("frames_with_detection", F.lit(0)).cast("long")
    return sessions.join(found, list(keys), "left").select(
        *keys, seen.alias("frames_with_detection"), F.round(seen / total_frames, 4).alias("coverage"), "mean_best_confidence"
    )


def detector_report(dets: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Frames with detections, with several of them, and mean and exact median confidence per key."""
    per = dets.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n"))
    multi = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames_with_detection"), F.count_if(c("n") > 1).alias("frames_with_multiple_candidates"))
    conf = dets.groupBy(*keys).agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    middle = exact_median(dets, keys, "confidence", "_median").select(*keys, F.round("_median", 4).alias("median_confidence"))
    return multi.join(conf, list(keys)).join(middle, list(keys), "left")


def window_coverage(dets: DataFrame, windows: DataFrame, keys: Sequence[str], window_id: str, frame: str, lo: str, hi: str) -> DataFrame:
    """Coverage of the flight, of its last 30 percent, and of the release frame +-2."""
    seen = dets.select(*keys, frame).distinct()
    reach = windows.withColumns({"_from": F.greatest(F.lit(0), c(lo) - 2), "_to": F.greatest(c(hi), c(lo) + 2)})
    inside = interval_join(seen, reach, keys, frame, "_from", "_to")
    near = c(lo) + F.floor(F.lit(0.7) * (c(hi) - c(lo) + 1))
    at = c(frame)
    n = inside.groupBy(*keys, window_id).agg(
        F.count_if(at.between(c(lo), c(hi))).alias("flight"),
        F.count_if(at.between(near, c(hi))).alias("near"),
        F.count_if(at <= c(lo) + 2).alias("release"),
    )
    out = windows.join(n, [*keys, window_id], "left")
    frac = lambda k, size: F.round(F.coalesce(k, F.lit(0)) / F.nullif(size, F.lit(0)), 4)
    return out.select(
        *keys, window_id, frac(c("flight"), c(hi) - c(lo) + 1).alias("flight_coverage"), frac(c("near"), c(hi) - near + 1).alias("near_rim_coverage"),
        F.coalesce("release", F.lit(0)).cast("long").alias("release_frames_seen"),
    )


def longest_gap(dets: DataFrame, windows: DataFrame, keys: Sequence[str], window_id: str, frame: str, lo: str, hi: str) -> DataFrame:
    """Longest run of frames without a detection in each window; no frame spine is built."""
    seen = dets.select(*keys, frame).distinct()
    inside = interval_join(seen, windows, keys, frame, lo, hi)
    rows = scan(inside, Series([*keys, window_id], [frame], f"floor({frame} / 4096)"), _p=prev_row(c(frame)), _n=next_row(c(frame)))
    before = c(frame) - F.coalesce(c("_p"), c(lo) - 1) - 1
    after = F.when(c("_n").isNull(), c(hi) - c(frame)).otherwise(0)
    gaps = rows.groupBy(*keys, window_id).agg(F.max(F.greatest(before, after)).alias("gap"))
    return windows.join(gaps, [*keys, window_id], "left").select(
        *keys, window_id, F.coalesce(c("gap"), c(hi) - c(lo) + 1).cast("long").alias("longest_gap")
    )


def overall_gap(dets: DataFrame, keys: Sequence[str], frame: str, first: Column, last: Column, size: int = 4096) -> DataFrame:
    """Longest run of frames without a detection between ``first`` and ``last`` (expressions over the keys).

    Each frame block gives a run summary (first and last frame seen, longest gap between); summaries of neighbours merge
    by the gap between them, so a session's frames meet only as one summary a block.
    """
    block = F.floor(c(frame) / size)
    seen = dets.select(*keys, frame).distinct().withColumn("_b", block)
    inside = seen.withColumn("_gap", c(frame) - F.lag(frame).over(Window.partitionBy(*keys, "_b").orderBy(frame)) - 1)
    runs = inside.groupBy(*keys, "_b").agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"), F.coalesce(F.max("_gap"), F.lit(0)).alias("_longest"))
    between = c("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_b")) - 1
    merged = runs.withColumn("_between", between).groupBy(*keys).agg(*[f(n).alias(n) for f, n in ((F.min, "_lo"), (F.max, "_hi"), (F.max, "_longest"), (F.max, "_between"))])
    gap = F.greatest("_longest", "_between", c("_lo") - first, last - c("_hi"))
    return merged.select(*keys, F.greatest(gap, F.lit(0)).cast("long").alias("overall_longest_gap"))


def positional_stability(cands: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean population deviation of x and y of the candidates within two radii of the target."""
    near = dim_join(cands, target, keys, spread=["x", "y"]).filter(F.hypot(c("x") - c("target_x"), c("y") - c("target_y")) < c("target_r") * 2)
    agg = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"))
    return agg.filter("n_points >= 2").select(*keys, "n_points", F.round((c("_sx") + c("_sy")) / 2, 4).alias("stability_px"))


def best_per_frame(cands: DataFrame, keys: Sequence[str], frame: str, order: str) -> DataFrame:
    """Highest confidence per frame, first in input order on ties."""
    rest = [n for n in cands.columns if n not in (*keys, frame)]
    pick = F.min_by(F.struct(*rest), F.struct((-c("confidence")).alias("a"), c(order).alias("b")))
    return cands.groupBy(*keys, frame).agg(pick.alias("_r")).select(*keys, frame, "_r.*")


class ClusterMachine(Machine):
    """Order-dependent greedy clusters: a row joins the first cluster whose running centroid is within the radius.

    Centroids lie on a grid of the radius' width, so a row looks at the clusters around it only.
    """

    def __init__(self, n_order: int, radius: float):
        self.n_order, self.radius = n_order, radius
        self.places, self.sums = PlaceIndex(radius), []

    def row(self, *values):
        ids, (x, y) = values[: self.n_order], values[self.n_order :]
        if x is None or y is None or x != x or y != y:
            return [(*ids, None)]
        held, first = self.places, None
        for i in held.around(x, y, self.radius):
            if (first is None or i < first) and ((x - held.x[i]) ** 2 + (y - held.y[i]) ** 2) ** 0.5 <= self.radius:
                first = i
        if first is None:
            self.sums.append((1, x, y))
            return [(*ids, held.add(x, y))]
        n, sx, sy = self.sums[first]
        n, sx, sy = self.sums[first] = (n + 1, sx + x, sy + y)
        held.move(first, sx / n, sy / n)
        return [(*ids, first)]


def greedy_clusters(cands: DataFrame, keys: Sequence[str], order: Sequence[str], radius: float = DEFAULTS.vote.radius_px) -> DataFrame:
    """The cluster of each candidate: ``keys``, ``order`` and ``cluster`` (null where x or y is)."""
    schema = T.StructType([*[cands.schema[o] for o in order], T.StructField("cluster", T.LongType())])
    return ordered_pass(cands, keys, order, [*order, "x", "y"], schema, lambda: ClusterMachine(len(order), radius))


def vote_location(cands: DataFrame, keys: Sequence[str], order: Sequence[str], p: VoteParams = DEFAULTS.vote) -> DataFrame:
    """Cluster candidates, keep the best per cluster and frame, and let frames vote."""
    tagged = cands.join(greedy_clusters(cands, keys, order, p.radius_px), [*keys, *order]).filter("cluster IS NOT NULL")
    best = best_per_frame(tagged, [*keys, "cluster"], order[0], order[-1])
    clusters = best.groupBy(*keys, "cluster").agg(
        F.avg("x").alias("rim_center_x"), F.avg("y").alias("rim_center_y"), F.avg("radius").alias("rim_radius_px"),
        F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("_conf"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("method"),
    )
    rank = F.struct("votes", F.round("_conf", 12), -c("cluster"))
    rest = ["rim_center_x", "rim_center_y", "rim_radius_px", "votes", "_conf", "method"]
    top = clusters.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")
    agreement = F.least(F.lit(1.0), c("votes") / F.lit(float(max(p.full_votes, 1))))
    return top.withColumn("confidence", F.round(F.lit(0.6) * agreement + F.lit(0.4) * c("_conf"), 3)).drop("_conf")


def straightness(points: DataFrame, keys: Sequence[str], min_points: int = 3) -> DataFrame:
    """Direct distance over path length of each (bounded) attempt's reliable points."""
    good = points.filter(c("source").isin(*RELIABLE_SOURCES))
    rows = scan(good, Series(keys, ["frame_index"]), _q=prev_row(F.struct("x", "y")))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.hypot(c("x") - c("_q.x"), c("y") - c("_q.y"))).alias("path"),
        F.min_by(F.struct("x", "y"), "frame_index").alias("a"), F.max_by(F.struct("x", "y"), "frame_index").alias("b"),
    )
    direct = F.hypot(c("b.x") - c("a.x"), c("b.y") - c("a.y"))
    ratio = F.when((c("n") >= min_points) & (c("path") >= 1e-9), direct / c("path"))
    return agg.select(*keys, F.round(ratio, 3).alias("straightness_ratio"))


def state_run_stats(runs: DataFrame, keys: Sequence[str], fps: float = 30.0, long_sec: float = 0.5) -> DataFrame:
    """Durations of runs: min, max, upper median, mean, number of long runs."""
    sec = c("length") / F.lit(fps)
    rows = runs.withColumn("_s", sec)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.min("_s"), 4).alias("min_sec"), F.round(F.max("_s"), 4).alias("max_sec"),
        F.round(F.avg("_s"), 9).alias("mean_sec"), F.count_if(c("_s") > long_sec).alias("long_runs"),
    )
    med = upper_median(rows, keys, "length", "_m").select(*keys, F.round(c("_m") / F.lit(fps), 4).alias("median_sec"))
    return agg.join(med, list(keys))


def longest_runs(runs: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """Top ``n`` runs by length (earlier first on ties) first within salts, then per key."""
    salted = runs.withColumn("_s", F.pmod(F.hash("start"), F.lit(16)))
    w = lambda part: Window.partitionBy(*part).orderBy(F.col("length").desc(), "start")
    local = salted.withColumn("_r", F.row_number().over(w([*keys, "_s"]))).filter(c("_r") <= n)
    return local.withColumn("rank", F.row_number().over(w(keys))).filter(c("rank") <= n).select(*keys, "start", "end", "length", "rank")


def tier_counts(rows: DataFrame, keys: Sequence[str], tier: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(c(tier) == t).alias(f"n_{t}") for t in ("high", "medium", "low")])


def motion_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary of relative motion per frame pair."""
    clean = c("mask_available") & c("mask_source").isin("detected", "none")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frame_pairs"), F.count_if(c("relative_motion") > 1.0).alias("n_elevated_pairs"),
        F.max("relative_motion").alias("max_relative_motion"), F.round(F.avg("relative_motion"), 4).alias("mean_relative_motion"),
        F.count_if(clean).alias("n_fully_clean_pairs"),
    )


def evidence_window(shots: DataFrame, frames: DataFrame, keys: Sequence[str], pad: int = 12, fallback: int = 60) -> DataFrame:
    """Frame range around all candidate frames of an attempt, clipped to the attempt."""
    reach = frames.groupBy(*keys).agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi"))
    rows = shots.join(reach, list(keys), "left")
    lo = F.coalesce(c("_lo") - pad, c("start_frame"))
    hi = F.coalesce(c("_hi") + pad, c("start_frame") + fallback)
    return rows.select(*keys, F.greatest(lo, c("start_frame") - pad).alias("lo"), F.least(hi, c("end_frame")).alias("hi"))

"""Temporal and keyed joins.

None of these emits all pairs of a group: interval joins meet in frame blocks, nearest and
bracketing joins are look-back/look-ahead scans over the merged series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.ordered import Series, first_after, last_before, scan

c = F.col


def align(left: DataFrame, right: DataFrame, on: Sequence[str] = ("sid", "frame_index")) -> DataFrame:
    """Frame-by-frame inner join."""
    return left.join(right, list(on))


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, block: int = 512, how: str = "inner") -> DataFrame:
    """Points inside ``[lo, hi]``.  Intervals are repeated once per frame block they touch,
    so the join key is ``(keys, block)`` and a hot key is cut along its time line."""
    cut = points.withColumn("_b", F.floor(c(at) / F.lit(block)))
    spread = intervals.withColumn("_w_b", F.explode(F.sequence(F.floor(c(lo) / F.lit(block)), F.floor(c(hi) / F.lit(block)))))
    spread = spread.withColumnsRenamed({k: f"_w_{k}" for k in keys})
    on = [c(k) == c(f"_w_{k}") for k in keys] + [c("_b") == c("_w_b"), c(at) >= c(lo), c(at) <= c(hi)]
    return cut.join(spread, on, how).drop("_b", *[f"_w_{k}" for k in [*keys, "b"]])


def in_windows(points: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, block: int = 512) -> DataFrame:
    """Keep points inside any window (semi-join)."""
    return interval_join(points, windows, keys, at, lo, hi, block, "left_semi")


def explode_windows(windows: DataFrame, lo: str, hi: str, name: str = "frame_index") -> DataFrame:
    return windows.withColumn(name, F.explode(F.sequence(lo, hi)))


def lookup_at(windows: DataFrame, points: DataFrame, keys: Sequence[str], frame: str, fields: Sequence[str], prefix: str) -> DataFrame:
    """Attach ``fields`` of the row at ``frame`` (left, null when missing)."""
    picked = points.select(*keys, c("frame_index").alias(frame), *[c(f).alias(f"{prefix}_{f}") for f in fields])
    return windows.join(picked, [*keys, frame], "left")


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, payload: Column, row: Column) -> DataFrame:
    l = left.select(*keys, c(lt).alias("_t"), F.lit(1).alias("_kind"), row.alias("_row"))
    r = right.select(*keys, c(rt).alias("_t"), F.lit(0).alias("_kind"), payload.alias("_hit"))
    return l.unionByName(r, allowMissingColumns=True)


def nearest(pred: DataFrame, truth: DataFrame, keys: Sequence[str], t: str, id_: str, truth_t: str, truth_id: str, block: str) -> DataFrame:
    """Nearest truth row per prediction (ties go to the smaller truth id), as ``match``/``delta``.

    ``block`` is SQL text over ``_t``.  Linear in both inputs: the nearest row is the
    closer of the last one before and the first one after.
    """
    first = truth.groupBy(*keys, truth_t).agg(F.min(truth_id).alias(truth_id))
    hit = F.struct(c(truth_t).alias("t"), c(truth_id).alias("id"))
    rows = _merged(pred, first, keys, t, truth_t, hit, F.struct(*[n for n in pred.columns if n not in keys]))
    rows = rows.withColumn("_id", F.coalesce(c(f"_row.{id_}"), F.lit(-1)))
    rows = scan(rows, Series(keys, ["_t", "_kind", "_id"], block), _b=last_before(c("_hit")), _a=first_after(c("_hit")))
    rows = rows.filter("_kind = 1")
    d_before, d_after = c("_t") - c("_b.t"), c("_a.t") - c("_t")
    first_wins = d_after.isNull() | (d_before < d_after) | ((d_before == d_after) & (c("_b.id") < c("_a.id")))
    match = F.when(d_before.isNotNull() & first_wins, c("_b")).otherwise(c("_a"))
    return rows.select(*keys, "_row.*", match.alias("match")).withColumn("delta", F.abs(c(t) - c("match.t")))


def match_nearest(pred: DataFrame, truth: DataFrame, keys: Sequence[str], t: str, id_: str, truth_t: str, truth_id: str, tol: float, block: str) -> DataFrame:
    """As-of match within ``tol`` (strict); several predictions may share a truth row."""
    rows = nearest(pred, truth, keys, t, id_, truth_t, truth_id, block)
    close = c("delta") < tol
    return rows.withColumns({"match": F.when(close, c("match")), "delta": F.when(close, c("delta"))})


def exclude_near(rows: DataFrame, excluded: DataFrame, keys: Sequence[str], t: str, id_: str, other_t: str, other_id: str, tol: float, block: str) -> DataFrame:
    """Drop rows closer than ``tol`` to any excluded time."""
    found = nearest(rows, excluded, keys, t, id_, other_t, other_id, block)
    return found.filter(c("delta").isNull() | (c("delta") >= tol)).drop("match", "delta")


def match_one_to_one(pred: DataFrame, truth: DataFrame, keys: Sequence[str], t: str, id_: str, truth_t: str, truth_id: str, tol: float, block: str) -> DataFrame:
    """Mutual nearest pairs are matched; the rest are false positives and false negatives."""
    ahead = match_nearest(pred, truth, keys, t, id_, truth_t, truth_id, tol, block)
    back = match_nearest(truth, pred, keys, truth_t, truth_id, t, id_, tol, block)
    p = ahead.select(*keys, c(id_).alias("pred_id"), c("match.id").alias("truth_id"), "delta")
    q = back.select(*keys, c(truth_id).alias("truth_id"), c("match.id").alias("pred_id"))
    pairs = p.join(q, [*keys, "pred_id", "truth_id"])
    cols = [*keys, "pred_id", "truth_id", "delta", "kind"]
    matched = pairs.withColumn("kind", F.lit("matched")).select(cols)
    extra = p.join(pairs, [*keys, "pred_id"], "left_anti").select(*keys, "pred_id", F.lit(None).cast("long").alias("truth_id"), F.lit(None).cast("double").alias("delta"), F.lit("false_positive").alias("kind"))
    missed = q.join(pairs, [*keys, "truth_id"], "left_anti").select(*keys, F.lit(None).cast("long").alias("pred_id"), "truth_id", F.lit(None).cast("double").alias("delta"), F.lit("false_negative").alias("kind"))
    return matched.unionByName(extra).unionByName(missed)


def last_at_or_before(windows: DataFrame, points: DataFrame, keys: Sequence[str], at: str, frame: str, payload: Column, block: str, name: str) -> DataFrame:
    """Attach the payload of the last point at or before ``at`` (null when none)."""
    rows = _merged(windows, points, keys, at, frame, payload, F.struct(*[n for n in windows.columns if n not in keys]))
    rows = rows.withColumn("_tie", F.xxhash64("_row"))
    rows = scan(rows, Series(keys, ["_t", "_kind", "_tie"], block), **{name: last_before(c("_hit"))})
    return rows.filter("_kind = 1").select(*keys, "_row.*", name)


def prefer_new(base: DataFrame, extra: DataFrame, on: Sequence[str]) -> DataFrame:
    """Right-wins merge."""
    return base.join(extra, list(on), "left_anti").unionByName(extra)


def agreement(a: DataFrame, b: DataFrame, on: Sequence[str], name: str = "distance") -> DataFrame:
    """Distance between two sources' points on the same frame; null where one side is missing."""
    left = a.select(*on, F.struct("x", "y").alias("_a"))
    right = b.select(*on, F.struct("x", "y").alias("_b"))
    return left.join(right, list(on), "full").select(*on, F.hypot(c("_a.x") - c("_b.x"), c("_a.y") - c("_b.y")).alias(name))


def overlay_truth(shots: DataFrame, truth: DataFrame, on: Sequence[str], label: str = "outcome") -> DataFrame:
    """Put verified labels over automatic ones; any key on one side only fails the job."""
    auto = shots.select(*on, c(label).alias("automatic_label"), F.lit(1).alias("_l"))
    ver = truth.select(*on, c(label).alias("verified_label"), F.lit(1).alias("_r"))
    both = auto.join(ver, list(on), "full")
    ok = c("_l").isNotNull() & c("_r").isNotNull()
    checked = F.when(ok, c("automatic_label")).otherwise(F.raise_error(F.concat(F.lit("truth and attempts have different keys: "), F.concat_ws("/", *on))))
    return both.select(*on, checked.alias("automatic_label"), F.when(ok, c("verified_label")).alias("verified_label"))


def foreign_key_orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*on), list(on), "left_anti")


def sessions_with_children(parent: DataFrame, child: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Parents with their child counts; ``status`` tells orphans (no parent) and empty parents."""
    per = child.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    both = parent.withColumn("_p", F.lit(1)).join(per, list(on), "full")
    status = F.when(c("_p").isNull(), "orphan").when(c(name).isNull(), "empty").otherwise("ok")
    return both.select(*on, *[n for n in parent.columns if n not in on], F.coalesce(c(name), F.lit(0)).alias(name), status.alias("status"))

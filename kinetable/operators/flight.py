"""Flight points of an attempt against the session's target.

Attempts are short (a release search plus a bounded flight), so windows run per attempt:
one shuffle on ``(session, attempt)`` serves every step below, and sessions of any size
spread over their attempts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions import rim
from kinetable.functions.scores import reliable
from kinetable.operators.ordered import Series, dim_join, first_after, last_before, next_row, prev_row, running_sum, scan, total
from kinetable.params import DEFAULTS, OutcomeParams

c = F.col


def _off_line(prev: Column, nxt: Column, span_frac: float) -> tuple[Column, Column, Column]:
    """Time span, deviation from the straight line, and tolerance for the current row."""
    dt = nxt["t"] - prev["t"]
    share = (c("timestamp_sec") - prev["t"]) / F.when(dt > rim.MIN_DT, dt)
    px = prev["x"] + share * (nxt["x"] - prev["x"])
    py = prev["y"] + share * (nxt["y"] - prev["y"])
    span = F.hypot(nxt["x"] - prev["x"], nxt["y"] - prev["y"])
    return dt, F.hypot(c("x") - px, c("y") - py), span * F.lit(span_frac)


def mark_outliers(points: DataFrame, keys: Sequence[str], p: OutcomeParams = DEFAULTS.outcome, block: str | None = None) -> DataFrame:
    """Add ``kept``: reliable and, if interpolated, near the line between its anchors.

    Anchors are the nearest detected points on both sides, else the direct neighbours in the
    unfiltered reliable list.  Detected points and both ends always stay.
    """
    at = F.struct(c("timestamp_sec").alias("t"), "x", "y")
    seen = F.when(c("source") == "detected", at)
    rows = points.withColumn("_rel", F.coalesce(reliable(c("source"), c("confidence")), F.lit(False)))
    rows = scan(
        rows, Series([*keys, "_rel"], ["frame_index"], block),
        _p=prev_row(at), _q=next_row(at), _db=last_before(seen), _da=first_after(seen),
        _rn=running_sum(F.lit(1)), _n=total(F.lit(1)),
    )
    both = c("_db").isNotNull() & c("_da").isNotNull()
    dt, deviation, by_span = _off_line(F.when(both, c("_db")).otherwise(c("_p")), F.when(both, c("_da")).otherwise(c("_q")), p.outlier_span_frac)
    inside = (
        (c("_n") < 3) | (c("source") == "detected") | (c("_rn") == 1) | (c("_rn") == c("_n")) | (dt <= rim.MIN_DT)
        | (deviation <= F.greatest(by_span, c("radius") * F.lit(p.outlier_radii)))
    )
    rows = rows.withColumn("kept", c("_rel") & F.coalesce(inside, F.lit(False)))
    return rows.drop("_p", "_q", "_db", "_da", "_rn", "_n")


def flight_rows(points: DataFrame, hoops: DataFrame, keys: Sequence[str], hoop_keys: Sequence[str], p: OutcomeParams = DEFAULTS.outcome) -> DataFrame:
    """All points with target, ``kept`` flag, band/height flags and per-attempt apex and counts."""
    attempt = list(keys)
    spread = [k for k in attempt if k not in hoop_keys]
    rows = dim_join(points, hoops, hoop_keys, "left", spread=spread)
    covered = (c("source") != "unavailable") & (c("confidence") > 0)
    rows = scan(rows, Series(attempt, ["frame_index"]), cov=running_sum(F.when(covered, 1).otherwise(0)))
    rows = mark_outliers(rows, attempt, p)
    w = Window.partitionBy(*attempt, "kept")
    rows = rows.withColumns(
        {
            "n_rel": F.count(F.lit(1)).over(w),
            "n_det": F.count_if(c("source") == "detected").over(w),
            "ball_r": F.avg("radius").over(w),
            "apex": F.min_by(F.struct(c("frame_index").alias("f"), c("timestamp_sec").alias("t")), F.struct("y", "frame_index")).over(w),
            "f_first": F.min("frame_index").over(w),
            "f_last": F.max("frame_index").over(w),
        }
    )
    tight, wide = rim.tight_band(c("hoop_r"), c("ball_r"), p), rim.wide_band(c("hoop_r"), c("ball_r"), p)
    rows = rows.withColumns(
        {
            "descent": c("kept") & (c("frame_index") >= c("apex.f")),
            "above": rim.above_rim(c("y"), c("hoop_y"), c("hoop_r"), p),
            "below": rim.below_rim(c("y"), c("hoop_y"), c("hoop_r"), p),
            "near": rim.near_height(c("y"), c("hoop_y"), c("hoop_r"), p),
            "tight": rim.in_band(c("x"), c("hoop_x"), tight),
            "wide": rim.in_band(c("x"), c("hoop_x"), wide),
            "wide_px": wide,
            "tight_px": tight,
        }
    )
    ordered = w.orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(
        {
            "out_run": F.count_if(~c("wide")).over(ordered),
            "n_above": F.count_if(c("descent") & c("above") & c("tight")).over(w),
            "n_below": F.count_if(c("descent") & c("below") & c("tight")).over(w),
            "stability": c("n_det") / c("n_rel"),
        }
    )


def with_pairs(rows: DataFrame, keys: Sequence[str], p: OutcomeParams = DEFAULTS.outcome) -> DataFrame:
    """Add ``pairs`` to each above-point: its later below-points within the crossing time.

    Every point sees only its own forward window of at most ``max_cross_sec``, so there is no
    self-join and no pair leaves its attempt.  ``first_b`` marks the earliest below-point.
    """
    look = p.max_cross_sec + 1e-3
    point = F.struct(
        c("frame_index").alias("f"), c("timestamp_sec").alias("t"), "x", "y", c("confidence").alias("conf"), "radius", "source",
        "out_run", "cov", (c("below") & c("tight")).alias("hit"),
    )
    key_sql = ", ".join([*keys, "kept"])
    ahead = F.expr(f"collect_list(_pt) OVER (PARTITION BY {key_sql} ORDER BY timestamp_sec RANGE BETWEEN CURRENT ROW AND {look}D FOLLOWING)")
    start = c("descent") & c("above") & c("tight")
    a = c("_pt")

    def pair(b: Column, i: Column) -> Column:
        lowest = F.array_min(F.transform(F.filter("_ahead", lambda q: q["f"] <= b["f"]), lambda q: q["conf"]))
        dip = rim.dip_ratio(a["conf"], b["conf"], b["f"] - a["f"] - 1, b["cov"] - a["cov"] - 1, lowest)
        drift, max_drift, gap = F.abs(b["x"] - a["x"]), c("hoop_r") * F.lit(p.max_drift_radii), b["t"] - a["t"]
        clean = (a["source"] == "detected") & (b["source"] == "detected")
        score = rim.crossing_conf(drift, max_drift, dip, c("n_above"), c("n_below"), gap, clean, c("hoop_conf"), c("stability"), p)
        return F.struct(
            a.alias("a"), b.alias("b"), (i == 0).alias("first_b"), drift.alias("drift"), max_drift.alias("max_drift"), gap.alias("gap_sec"),
            (b["out_run"] > a["out_run"]).alias("deflected"), dip.alias("dip"), (drift <= max_drift).alias("passes_drift"),
            (dip <= p.max_dip).alias("passes_dip"), score.alias("score"),
        )

    partners = F.filter("_ahead", lambda b: b["hit"] & (b["f"] > a["f"]) & (b["t"] - a["t"] <= p.max_cross_sec))
    seen = rows.withColumn("_pt", point).withColumn("_ahead", ahead)
    return seen.withColumn("pairs", F.when(start, F.transform(partners, pair))).drop("_pt", "_ahead")


def crossing_pairs(rows: DataFrame, keys: Sequence[str], p: OutcomeParams = DEFAULTS.outcome) -> DataFrame:
    """``with_pairs`` as one row per pair."""
    return with_pairs(rows, keys, p).select(*keys, "hoop_x", "hoop_y", "hoop_r", F.explode("pairs").alias("_q")).select(*keys, "hoop_x", "hoop_y", "hoop_r", "_q.*")


def attempt_evidence(rows: DataFrame, keys: Sequence[str], p: OutcomeParams = DEFAULTS.outcome, *extra: Column) -> DataFrame:
    """One row per attempt: gate counts, deflection, beside and far evidence, plus ``extra``."""
    k = list(keys)
    kept = c("kept")
    per = Window.partitionBy(*k)
    approach = kept & c("descent") & c("above") & c("wide")
    rows = rows.withColumn("_la", F.max(F.when(approach, F.struct(c("frame_index").alias("f"), c("timestamp_sec").alias("t")))).over(per))
    out_after = (
        kept & ~c("wide") & (c("frame_index") > c("_la.f")) & (c("timestamp_sec") - c("_la.t") <= p.max_deflect_sec)
    )
    soon = c("descent") & (c("timestamp_sec") - c("apex.t") <= p.max_apex_sec)
    of_kept = lambda col: F.max(F.when(kept, col))
    return rows.groupBy(*k).agg(
        F.max("hoop_conf").alias("hoop_conf"),
        F.count_if(c("_rel")).alias("n_before"),
        F.count_if(kept).alias("n_reliable"),
        F.count_if(kept & (c("source") == "detected")).alias("n_detected"),
        F.count_if(kept & (c("source") == "interpolated")).alias("n_interpolated"),
        F.count_if(c("source") == "predicted").alias("n_predicted"),
        F.count_if(c("descent")).alias("n_descent"),
        of_kept(c("apex")).alias("apex"),
        of_kept(F.when((c("apex.f") == c("f_first")) | (c("apex.f") == c("f_last")), True).otherwise(False)).alias("open_apex"),
        of_kept(c("stability")).alias("stability"),
        of_kept(c("wide_px")).alias("wide_px"),
        of_kept(c("tight_px")).alias("tight_px"),
        F.count_if(approach).alias("n_approach"),
        F.max("_la").alias("last_approach"),
        F.min(F.when(out_after, F.struct(c("frame_index").alias("f"), c("timestamp_sec").alias("t")))).alias("escape"),
        F.count_if(soon & c("near") & ~c("wide")).alias("n_beside"),
        F.count_if(soon & c("below") & ~c("wide")).alias("n_far"),
        F.coalesce(F.bool_or(kept & (c("y") <= c("hoop_y") + c("wide_px"))), F.lit(False)).alias("height_context"),
        *extra,
    )

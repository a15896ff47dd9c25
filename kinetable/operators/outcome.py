"""Outcome classification: positive evidence or abstention, as one CASE ladder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import rim
from kinetable.functions.scores import rounded
from kinetable.operators.flight import attempt_evidence, crossing_pairs, flight_rows, with_pairs
from kinetable.params import DEFAULTS, OutcomeParams

c = F.col

EVIDENCE = ("n_reliable", "n_detected", "n_interpolated", "n_predicted", "n_descent", "n_outliers_rejected", "apex_frame")


def _ladder(evidence: DataFrame, crossing_score: Column, p: OutcomeParams) -> DataFrame:
    """Apply gates, crossing, deflection, beside and far rules in order."""
    e = c
    gate = (
        F.when(e("hoop_conf").isNull() | (e("hoop_conf") < p.hoop_floor), "hoop_location_not_reliable")
        .when(e("n_reliable") < p.min_reliable, "insufficient_ball_trajectory_data")
        .when(e("open_apex") & (e("n_reliable") < p.min_reliable_open_apex), "apex_not_reliably_observed")
        .when(e("n_descent") < p.min_descent, "insufficient_descent_observation")
    )
    branch = (
        F.when(gate.isNotNull(), "gate")
        .when(crossing_score.isNotNull(), "crossing")
        .when(e("escape").isNotNull() & (e("n_approach") >= p.min_above), "deflection")
        .when(e("n_beside") > 0, "beside")
        .when((e("n_far") > 0) & e("height_context"), "far")
        .otherwise("none")
    )
    dt = e("escape.t") - e("last_approach.t")
    conf = (
        F.when(e("_branch") == "crossing", crossing_score)
        .when(e("_branch") == "deflection", rim.deflect_conf(dt, e("n_approach"), e("hoop_conf"), e("stability"), p))
        .when(e("_branch") == "beside", rim.beside_conf(e("n_beside"), e("hoop_conf"), e("stability")))
        .when(e("_branch") == "far", rim.far_conf(e("n_far"), e("hoop_conf"), e("stability")))
        .otherwise(F.lit(0.0))
    )
    sure = e("_conf") >= p.report_floor
    # Fixed values: (branch, confident reason, unsure reason).
    reasons = (
        ("crossing", "ball_crossed_rim_band_top_to_bottom", "rim_crossing_observed_but_low_confidence"),
        ("deflection", "ball_approached_rim_then_deflected_away", "possible_deflection_but_low_confidence"),
        ("beside", "ball_passed_beside_hoop_at_rim_height", "possible_miss_beside_hoop_but_low_confidence"),
        ("far", "ball_descended_well_clear_of_hoop", "trajectory_diverged_but_low_confidence"),
    )
    reason = F.when(e("_branch") == "gate", e("_gate"))
    for name, yes, no in reasons:
        reason = reason.when(e("_branch") == name, F.when(sure, yes).otherwise(no))
    reason = reason.otherwise("rim_interaction_not_sufficiently_observed")
    outcome = (
        F.when(e("_branch").isin("gate", "none") | ~sure, "unknown")
        .when(e("_branch") == "crossing", "made")
        .otherwise("missed")
    )
    out = evidence.withColumns({"_gate": gate, "_branch": branch}).withColumn("_conf", conf)
    return out.withColumns(
        {
            "outcome": outcome,
            "outcome_confidence": rounded(e("_conf"), 3),
            "outcome_reason": reason,
            "n_outliers_rejected": e("n_before") - e("n_reliable"),
            "apex_frame": e("apex.f"),
        }
    ).drop("_gate", "_conf")


def classify_outcome(points: DataFrame, hoops: DataFrame, keys: Sequence[str] = ("sid", "shot_index"), hoop_keys: Sequence[str] = ("sid",), p: OutcomeParams = DEFAULTS.outcome, flight: DataFrame | None = None) -> DataFrame:
    """First clean crossing decides; otherwise look for a miss; otherwise abstain.

    ``flight`` are the ``flight_rows`` of these points, where the caller has them already.
    """
    k = list(keys)

    rows = with_pairs(flight_rows(points, hoops, k, hoop_keys, p) if flight is None else flight, k, p)
    clean = F.filter("pairs", lambda q: q["first_b"] & q["passes_drift"] & ~q["deflected"] & q["passes_dip"])
    rows = rows.withColumn("_q", F.get(clean, F.lit(0)))
    pick = F.struct(
        *[c(f"_q.{n}").alias(n) for n in ("a", "b", "dip", "score")], "n_above", "n_below",
        rim.speed_near_rim(c("_q.a"), c("_q.b"), c("hoop_x"), c("hoop_r"), p).alias("speed"),
    )
    first = F.min_by(pick, F.when(c("_q").isNotNull(), c("frame_index"))).alias("x")
    out = _ladder(attempt_evidence(rows, k, p, first), c("x.score"), p)
    crossed = c("_branch") == "crossing"
    when = lambda col: F.when(crossed, col)
    return out.select(
        *k, "outcome", "outcome_confidence", "outcome_reason",
        F.when(crossed, c("x.n_above")).when(c("outcome_reason") == "ball_approached_rim_then_deflected_away", c("n_approach")).otherwise(0).alias("points_above"),
        F.when(crossed, c("x.n_below")).otherwise(0).alias("points_below"),
        when(c("x.b.f") - c("x.a.f")).alias("crossing_gap_frames"),
        *EVIDENCE,
        when(c("x.a.f")).alias("crossing_above_frame"),
        when(c("x.b.f")).alias("crossing_below_frame"),
        when(rounded(c("x.dip"), 3)).alias("occlusion_dip_ratio"),
        when(rounded(c("x.speed"), 2)).alias("rim_entry_speed_mps"),
        F.when(c("_branch") == "deflection", c("escape.f")).alias("deflection_frame"),
    )


def classify_outcome_weighted(points: DataFrame, hoops: DataFrame, keys: Sequence[str] = ("sid", "shot_index"), hoop_keys: Sequence[str] = ("sid",), p: OutcomeParams = DEFAULTS.outcome, flight: DataFrame | None = None) -> DataFrame:
    """Variant: every undeflected pair is scored and the best (rounded) score decides."""
    k = list(keys)

    scored = F.transform(
        F.filter("pairs", lambda q: ~q["deflected"]),
        lambda q: F.struct(rounded(F.greatest(F.lit(0.0), q["score"]), 3).alias("score"), (-q["a"]["f"]).alias("na"), (-q["b"]["f"]).alias("nb")),
    )
    rows = with_pairs(flight_rows(points, hoops, k, hoop_keys, p) if flight is None else flight, k, p).withColumn("_s", scored)
    best = F.max(F.array_max("_s")).alias("x")
    found = F.coalesce(F.sum(F.when(c("_s").isNotNull(), F.size("_s"))), F.lit(0)).cast("long").alias("n_candidates")
    out = _ladder(attempt_evidence(rows, k, p, best, found), c("x.score"), p)
    crossed = c("_branch") == "crossing"
    return out.select(
        *k, "outcome", "outcome_confidence", "outcome_reason",
        F.when(crossed, c("n_candidates")).otherwise(0).alias("n_candidates"),
        F.when(crossed, -c("x.na")).alias("crossing_above_frame"),
        F.when(crossed, -c("x.nb")).alias("crossing_below_frame"),
    )


def explain_outcome(points: DataFrame, hoops: DataFrame, keys: Sequence[str] = ("sid", "shot_index"), hoop_keys: Sequence[str] = ("sid",), p: OutcomeParams = DEFAULTS.outcome) -> DataFrame:
    """Every crossing pair with its tests, one row per pair."""
    rows = flight_rows(points, hoops, keys, hoop_keys, p).filter(c("hoop_conf").isNotNull())
    pairs = crossing_pairs(rows.filter(c("kept") & (c("n_rel") >= p.min_descent)), keys, p)
    dip = F.when(~c("deflected"), c("dip"))
    return pairs.select(
        *keys, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), F.round("drift", 1).alias("drift_px"),
        F.round("max_drift", 1).alias("max_drift_px"), "deflected", F.round(dip, 3).alias("dip_ratio"), "passes_drift",
        F.coalesce(dip <= p.max_dip, F.lit(False)).alias("passes_occlusion"),
    )


def far_descent(points: DataFrame, hoops: DataFrame, keys: Sequence[str] = ("sid", "shot_index"), hoop_keys: Sequence[str] = ("sid",), p: OutcomeParams = DEFAULTS.outcome) -> DataFrame:
    """Points that fell well clear of the target soon after the apex."""
    rows = flight_rows(points, hoops, keys, hoop_keys, p)
    since = c("timestamp_sec") - c("apex.t")
    far = c("descent") & (since <= p.max_apex_sec) & c("below") & ~c("wide") & (c("n_rel") >= p.min_descent)
    return rows.filter(far).select(*keys, "frame_index", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round(since, 3).alias("t_since_apex"), "source")


def compare_classifiers(points: DataFrame, hoops: DataFrame, base: Callable = classify_outcome, other: Callable = classify_outcome_weighted, keys: Sequence[str] = ("sid", "shot_index")) -> DataFrame:
    """Run two classifiers over identical points and mark where they disagree."""
    pick = lambda df, tag: df.select(*keys, *[c(n).alias(f"{tag}_{n}") for n in ("outcome", "outcome_confidence", "outcome_reason")])
    both = pick(base(points, hoops), "base").join(pick(other(points, hoops), "other"), list(keys))
    return both.withColumn("changed", c("base_outcome") != c("other_outcome"))

"""Registered outcome, reversal and evaluation queries over the event-derived flight points."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from kinetable.catalog.base import FRAMES_SQL, HOOPS_SQL, POINTS_SQL, flight_points, hoops, query, with_
from kinetable.functions import rim
from kinetable.functions.scores import reliable
from kinetable.operators import outcome as oc
from kinetable.operators.flight import crossing_pairs, flight_rows, mark_outliers
from kinetable.operators.lineage import stage
from kinetable.operators.reversal import post_contact_reversal

c = F.col
KEYS = ["sid", "shot_index"]
_P = "PARTITION BY sid, shot_index ORDER BY frame_index"
_DB = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_DA = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _anchor(v: str) -> str:
    det = f"CASE WHEN source = 'detected' THEN {v} END"
    return (
        f"lag({v}) OVER ({_P}) AS p_{v}, lead({v}) OVER ({_P}) AS n_{v}, "
        f"last_value({det} IGNORE NULLS) OVER ({_P} {_DB}) AS b_{v}, first_value({det} IGNORE NULLS) OVER ({_P} {_DA}) AS a_{v}"
    )


FLIGHT_SQL = with_(
    FRAMES_SQL, POINTS_SQL, HOOPS_SQL,
    """raw AS (SELECT p.*, h.hoop_x, h.hoop_y, h.hoop_r, h.hoop_conf,
  count(*) FILTER (source <> 'unavailable' AND confidence > 0) OVER (PARTITION BY p.sid, p.shot_index ORDER BY frame_index) AS cov
  FROM points p LEFT JOIN hoops h USING (sid))""",
    f"""rel AS (SELECT *, timestamp_sec AS t, row_number() OVER ({_P}) AS rn, count(*) OVER (PARTITION BY sid, shot_index) AS n0
  FROM raw WHERE source IN ('detected', 'interpolated') AND confidence > 0)""",
    f"rel1 AS (SELECT *, {_anchor('t')}, {_anchor('x')}, {_anchor('y')} FROM rel)",
    """rel2 AS (SELECT *, CASE WHEN b_t IS NOT NULL AND a_t IS NOT NULL THEN {t0: b_t, x0: b_x, y0: b_y, t1: a_t, x1: a_x, y1: a_y}
  ELSE {t0: p_t, x0: p_x, y0: p_y, t1: n_t, x1: n_x, y1: n_y} END AS k FROM rel1)""",
    """kept AS (SELECT * FROM rel2 WHERE n0 < 3 OR source = 'detected' OR rn = 1 OR rn = n0 OR k.t1 - k.t0 <= 1e-6
  OR sqrt(pow(x - (k.x0 + (t - k.t0) / (k.t1 - k.t0) * (k.x1 - k.x0)), 2) + pow(y - (k.y0 + (t - k.t0) / (k.t1 - k.t0) * (k.y1 - k.y0)), 2))
     <= greatest(0.6 * sqrt(pow(k.x1 - k.x0, 2) + pow(k.y1 - k.y0, 2)), 3 * radius))""",
    """apex AS (SELECT sid, shot_index, count(*) AS n_rel, count(*) FILTER (source = 'detected') AS n_det,
  count(*) FILTER (source = 'interpolated') AS n_int, avg(radius) AS ball_r, arg_min(frame_index, y * 1000000 + frame_index) AS af,
  min(frame_index) AS f0, max(frame_index) AS f1 FROM kept GROUP BY ALL)""",
    """fl AS (SELECT k.sid, k.shot_index, k.frame_index AS f, k.t, k.x, k.y, k.confidence AS conf, k.source, k.radius, k.cov, k.hoop_conf,
  k.hoop_x, k.hoop_y, k.hoop_r, a.n_rel, a.n_det, a.af, a.af / 30.0 AS at_, k.frame_index >= a.af AS descent,
  k.y < hoop_y - 0.35 * hoop_r AS above, k.y > hoop_y + 0.35 * hoop_r AS below, abs(k.y - hoop_y) <= 2.5 * hoop_r AS near,
  abs(k.x - hoop_x) <= 1.6 * hoop_r + ball_r AS tight, abs(k.x - hoop_x) <= 3.0 * hoop_r + ball_r AS wide, 3.0 * hoop_r + ball_r AS wide_px,
  n_det / n_rel AS stab FROM kept k JOIN apex a USING (sid, shot_index))""",
    """ab AS (SELECT sid, shot_index, count(*) FILTER (descent AND above AND tight) AS n_above, count(*) FILTER (descent AND below AND tight) AS n_below FROM fl GROUP BY ALL)""",
    """pair0 AS (SELECT a.sid, a.shot_index, a.f AS af, b.f AS bf, a.t AS ta, b.t AS tb, a.x AS xa, b.x AS xb, a.y AS ya, b.y AS yb, a.conf AS ca, b.conf AS cb,
  a.source AS sa, b.source AS sb, a.radius AS ra, b.radius AS rb, b.cov - a.cov - 1 AS covered, a.hoop_conf, a.hoop_r, a.hoop_x, a.stab, n_above, n_below
  FROM fl a JOIN fl b USING (sid, shot_index) JOIN ab USING (sid, shot_index)
  WHERE a.descent AND a.above AND a.tight AND b.descent AND b.below AND b.tight AND b.f > a.f AND b.t - a.t <= 0.75)""",
    """pair1 AS (SELECT p.*, bool_or(m.f > p.af AND m.f < bf AND NOT m.wide) AS deflected, min(m.conf) AS lowest FROM pair0 p JOIN fl m USING (sid, shot_index)
  WHERE m.f BETWEEN p.af AND bf GROUP BY ALL)""",
    """pair AS (SELECT *, abs(xb - xa) AS drift, hoop_r AS max_drift, tb - ta AS gap,
  CASE WHEN greatest(ca, cb) <= 0 THEN 1.0 WHEN covered < bf - af - 1 THEN 0.0 ELSE lowest / greatest(ca, cb) END AS dip,
  bf = min(bf) OVER (PARTITION BY sid, shot_index, af) AS first_b FROM pair1)""",
    """scored AS (SELECT *, (0.12 + 0.20 * (1 - drift / max_drift) + 0.20 * (1 - dip / 0.75) + 0.10 * least(1.0, n_above / 2.0) + 0.08 * least(1.0, n_below / 2.0)
  + 0.15 * (1 - gap / (0.75 + 1e-6)) + 0.15 * CASE WHEN sa = 'detected' AND sb = 'detected' THEN 1.0 ELSE 0.8 END)
  * (0.5 + 0.5 * hoop_conf) * (0.5 + 0.5 * stab) AS score FROM pair)""",
    """la AS (SELECT sid, shot_index, max(f) AS lf, max(t) AS lt, count(*) AS n_approach FROM fl WHERE descent AND above AND wide GROUP BY ALL)""",
    """esc AS (SELECT sid, shot_index, min(f) AS ef, min(t) AS et FROM fl JOIN la USING (sid, shot_index) WHERE NOT wide AND f > lf AND t - lt <= 0.75 GROUP BY ALL)""",
    """att AS (SELECT sid, shot_index, max(hoop_conf) AS hc, count(*) FILTER (source IN ('detected','interpolated') AND confidence > 0) AS n_before,
  count(*) FILTER (source = 'predicted') AS n_predicted FROM raw GROUP BY ALL)""",
    """mis AS (SELECT sid, shot_index, count(*) FILTER (descent) AS n_descent, count(*) FILTER (descent AND t - at_ <= 2.0 AND near AND NOT wide) AS n_beside,
  count(*) FILTER (descent AND t - at_ <= 2.0 AND below AND NOT wide) AS n_far, bool_or(y <= hoop_y + wide_px) AS ctx, any_value(stab) AS stab FROM fl GROUP BY ALL)""",
    """ev AS (SELECT att.*, coalesce(n_rel,0) AS n_reliable, coalesce(n_det,0) AS n_detected, coalesce(n_int,0) AS n_interpolated, coalesce(n_descent,0) AS n_descent,
  af = f0 OR af = f1 AS open_apex, af AS apex_frame, n_beside, n_far, ctx, stab, lt, coalesce(n_approach,0) AS n_approach, ef, et,
  CASE WHEN hc IS NULL OR hc < 0.3 THEN 'hoop_location_not_reliable' WHEN n_rel IS NULL OR n_rel < 3 THEN 'insufficient_ball_trajectory_data'
    WHEN (af = f0 OR af = f1) AND n_rel < 6 THEN 'apex_not_reliably_observed' WHEN n_descent < 3 THEN 'insufficient_descent_observation' END AS gate
  FROM att LEFT JOIN apex USING (sid, shot_index) LEFT JOIN mis USING (sid, shot_index) LEFT JOIN la USING (sid, shot_index) LEFT JOIN esc USING (sid, shot_index))""",
)


def ladder_sql(cross: str) -> str:
    return f""", br AS (SELECT ev.*, x.* EXCLUDE (sid, shot_index, hoop_conf, stab, af), x.af AS xaf, CASE WHEN gate IS NOT NULL THEN 'gate' WHEN x.score IS NOT NULL THEN 'crossing' WHEN ef IS NOT NULL AND n_approach >= 2 THEN 'deflection'
    WHEN n_beside > 0 THEN 'beside' WHEN n_far > 0 AND ctx THEN 'far' ELSE 'none' END AS branch FROM ev LEFT JOIN {cross} x USING (sid, shot_index)),
cf AS (SELECT *, CASE branch WHEN 'crossing' THEN least(1.0, score)
  WHEN 'deflection' THEN least(1.0, (0.30 + 0.30 * (1 - (et - lt) / (0.75 + 1e-6)) + 0.20 * least(1.0, n_approach / 2.0) + 0.20 * least(1.0, 0.08 * n_approach)) * (0.5 + 0.5 * hc) * (0.5 + 0.5 * stab))
  WHEN 'beside' THEN least(1.0, 0.5 + 0.05 * n_beside) * (0.5 + 0.5 * hc) * (0.5 + 0.5 * stab)
  WHEN 'far' THEN least(1.0, 0.4 + 0.05 * n_far) * (0.5 + 0.5 * hc) * (0.5 + 0.5 * stab) ELSE 0.0 END AS cconf FROM br),
res AS (SELECT *, CASE WHEN branch IN ('gate','none') OR cconf < 0.45 THEN 'unknown' WHEN branch = 'crossing' THEN 'made' ELSE 'missed' END AS outcome, round(cconf::DOUBLE, 3) AS outcome_confidence,
  CASE branch WHEN 'gate' THEN gate WHEN 'crossing' THEN CASE WHEN cconf >= 0.45 THEN 'ball_crossed_rim_band_top_to_bottom' ELSE 'rim_crossing_observed_but_low_confidence' END
   WHEN 'deflection' THEN CASE WHEN cconf >= 0.45 THEN 'ball_approached_rim_then_deflected_away' ELSE 'possible_deflection_but_low_confidence' END
   WHEN 'beside' THEN CASE WHEN cconf >= 0.45 THEN 'ball_passed_beside_hoop_at_rim_height' ELSE 'possible_miss_beside_hoop_but_low_confidence' END
   WHEN 'far' THEN CASE WHEN cconf >= 0.45 THEN 'ball_descended_well_clear_of_hoop' ELSE 'trajectory_diverged_but_low_confidence' END
   ELSE 'rim_interaction_not_sufficiently_observed' END AS outcome_reason FROM cf)
"""


BASE_SQL = FLIGHT_SQL + """, clean AS (SELECT * FROM scored WHERE first_b AND drift <= max_drift AND NOT deflected AND dip <= 0.75
  QUALIFY row_number() OVER (PARTITION BY sid, shot_index ORDER BY af) = 1)""" + ladder_sql("clean")
BEST_SQL = """, best AS (SELECT * EXCLUDE (score), round(greatest(0.0, least(1.0, score))::DOUBLE, 3) AS score, count(*) OVER (PARTITION BY sid, shot_index) AS n_candidates FROM scored WHERE NOT deflected
  QUALIFY row_number() OVER (PARTITION BY sid, shot_index ORDER BY round(greatest(0.0, least(1.0, score))::DOUBLE, 3) DESC, af, bf) = 1)"""


@query("EPI11", BASE_SQL + """SELECT sid, shot_index, outcome, outcome_confidence, outcome_reason,
  CASE WHEN branch='crossing' THEN n_above WHEN outcome_reason='ball_approached_rim_then_deflected_away' THEN n_approach ELSE 0 END AS points_above,
  CASE WHEN branch='crossing' THEN n_below ELSE 0 END AS points_below, CASE WHEN branch='crossing' THEN bf - xaf END AS crossing_gap_frames,
  n_reliable, n_detected, n_interpolated, n_predicted, n_descent, n_before - n_reliable AS n_outliers_rejected, apex_frame,
  CASE WHEN branch='crossing' THEN xaf END AS crossing_above_frame, CASE WHEN branch='crossing' THEN bf END AS crossing_below_frame,
  CASE WHEN branch='crossing' THEN round(dip::DOUBLE,3) END AS occlusion_dip_ratio,
  CASE WHEN branch='crossing' AND sa='detected' AND sb='detected' AND abs(xa - hoop_x) <= 3*hoop_r + (ra+rb)/2 AND abs(xb - hoop_x) <= 3*hoop_r + (ra+rb)/2 AND gap > 1e-6
    THEN round((sqrt(pow(xb-xa,2)+pow(yb-ya,2)) / (hoop_r/0.2286) / gap)::DOUBLE, 2) END AS rim_entry_speed_mps,
  CASE WHEN branch='deflection' THEN ef END AS deflection_frame FROM res""")
def classify(spark, sf):
    return oc.classify_outcome(flight_points(spark, sf), hoops(spark, sf))


@query("EPI12", FLIGHT_SQL + BEST_SQL + ladder_sql("best") + """SELECT sid, shot_index, outcome, outcome_confidence, outcome_reason,
  CASE WHEN branch='crossing' THEN n_candidates ELSE 0 END AS n_candidates, CASE WHEN branch='crossing' THEN xaf END AS crossing_above_frame, CASE WHEN branch='crossing' THEN bf END AS crossing_below_frame FROM res""")
def classify_weighted(spark, sf):
    return oc.classify_outcome_weighted(flight_points(spark, sf), hoops(spark, sf))


@query("JON15", BASE_SQL + BEST_SQL + ladder_sql("best").replace("br AS", "br2 AS").replace("FROM br)", "FROM br2)").replace("cf AS", "cf2 AS").replace("FROM cf)", "FROM cf2)").replace("res AS", "res2 AS") + """
SELECT sid, shot_index, a.outcome AS base_outcome, a.outcome_confidence AS base_outcome_confidence, a.outcome_reason AS base_outcome_reason,
  b.outcome AS other_outcome, b.outcome_confidence AS other_outcome_confidence, b.outcome_reason AS other_outcome_reason, a.outcome <> b.outcome AS changed
FROM res a JOIN res2 b USING (sid, shot_index)""")
def compare(spark, sf):
    pts, hp = flight_points(spark, sf), hoops(spark, sf)
    rows = stage(flight_rows(pts, hp, KEYS, ["sid"]))
    return oc.compare_classifiers(pts, hp, partial(oc.classify_outcome, flight=rows), partial(oc.classify_outcome_weighted, flight=rows))


@query("EPI21", FLIGHT_SQL + """SELECT sid, shot_index, pair.af AS a_frame, bf AS b_frame, round(drift,1) AS drift_px, round(max_drift,1) AS max_drift_px, deflected,
  CASE WHEN NOT deflected THEN round(dip::DOUBLE,3) END AS dip_ratio, drift <= max_drift AS passes_drift, NOT deflected AND dip <= 0.75 AS passes_occlusion
  FROM pair JOIN apex USING (sid, shot_index) WHERE n_rel >= 3""")
def explain(spark, sf):
    return oc.explain_outcome(flight_points(spark, sf), hoops(spark, sf))


@query("JON08", FLIGHT_SQL + "SELECT sid, shot_index, af AS a_frame, bf AS b_frame, round(gap,4) AS gap_sec, first_b FROM pair")
def crossing_pair_rows(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    return crossing_pairs(rows, KEYS).select(*KEYS, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), F.round("gap_sec", 4).alias("gap_sec"), "first_b")


@query("JON09", FLIGHT_SQL + "SELECT sid, shot_index, af AS a_frame, bf AS b_frame, deflected FROM pair")
def deflected_between(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    return crossing_pairs(rows, KEYS).select(*KEYS, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), "deflected")


@query("TOP6", FLIGHT_SQL + BEST_SQL + "SELECT sid, shot_index, af AS a_frame, bf AS b_frame, score FROM best")
def best_pair(spark, sf):
    from kinetable.operators.topk import best_row

    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    pairs = crossing_pairs(rows, KEYS).filter(~c("deflected")).withColumn("score", F.round(F.greatest(F.lit(0.0), c("score")), 3))
    slim = pairs.select(*KEYS, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), "score")
    return best_row(slim, KEYS, [-c("score"), c("a_frame"), c("b_frame")])


@query("FN07", FLIGHT_SQL + "SELECT sid, shot_index, af AS a_frame, bf AS b_frame, round(dip::DOUBLE, 4) AS dip_ratio FROM pair")
def dip_ratio(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    return crossing_pairs(rows, KEYS).select(*KEYS, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), F.round("dip", 4).alias("dip_ratio"))


@query("SET05", FLIGHT_SQL + "SELECT sid, shot_index, af AS a_frame, bf AS b_frame, covered < bf - af - 1 AS has_gap FROM pair")
def has_gap(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    gap = c("b.cov") - c("a.cov") - 1 < c("b.f") - c("a.f") - 1
    return crossing_pairs(rows, KEYS).select(*KEYS, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), gap.alias("has_gap"))


@query("FN08", FLIGHT_SQL + "SELECT sid, shot_index, af AS a_frame, bf AS b_frame, round(least(1.0, score)::DOUBLE, 4) AS crossing_conf FROM scored")
def crossing_confidence(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    return crossing_pairs(rows, KEYS).select(*KEYS, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), F.round("score", 4).alias("crossing_conf"))


@query("FN10", FLIGHT_SQL + """SELECT sid, shot_index, af AS a_frame, bf AS b_frame, CASE WHEN sa='detected' AND sb='detected' AND abs(xa - hoop_x) <= 3*hoop_r + (ra+rb)/2 AND abs(xb - hoop_x) <= 3*hoop_r + (ra+rb)/2
  AND gap > 1e-6 THEN round((sqrt(pow(xb-xa,2)+pow(yb-ya,2)) / (hoop_r/0.2286) / gap)::DOUBLE, 4) END AS speed_mps FROM pair""")
def speed_near_rim(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    speed = rim.speed_near_rim(c("a"), c("b"), c("hoop_x"), c("hoop_r"))
    return crossing_pairs(rows, KEYS).select(*KEYS, c("a.f").alias("a_frame"), c("b.f").alias("b_frame"), F.round(speed, 4).alias("speed_mps"))


@query("FN09", FLIGHT_SQL + """SELECT sid, shot_index, CASE WHEN ef IS NOT NULL THEN round(least(1.0, (0.30 + 0.30 * (1 - (et - lt) / (0.75 + 1e-6)) + 0.20 * least(1.0, n_approach / 2.0) + 0.20 * least(1.0, 0.08 * n_approach)) * (0.5 + 0.5 * hc) * (0.5 + 0.5 * stab))::DOUBLE, 11) END AS deflect_conf,
  round((least(1.0, 0.5 + 0.05 * n_beside) * (0.5 + 0.5 * hc) * (0.5 + 0.5 * stab))::DOUBLE, 11) AS beside_conf,
  round((least(1.0, 0.4 + 0.05 * n_far) * (0.5 + 0.5 * hc) * (0.5 + 0.5 * stab))::DOUBLE, 11) AS far_conf FROM ev WHERE n_reliable > 0""")
def miss_confidences(spark, sf):
    from kinetable.operators.flight import attempt_evidence

    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"])
    e = attempt_evidence(rows, KEYS).filter("n_reliable > 0")
    dt = c("escape.t") - c("last_approach.t")
    deflect = F.when(dt.isNotNull(), rim.deflect_conf(dt, c("n_approach"), c("hoop_conf"), c("stability")))
    return e.select(
        *KEYS, F.round(deflect, 11).alias("deflect_conf"),
        F.round(rim.beside_conf(c("n_beside"), c("hoop_conf"), c("stability")), 11).alias("beside_conf"),
        F.round(rim.far_conf(c("n_far"), c("hoop_conf"), c("stability")), 11).alias("far_conf"),
    )


@query("PRJ01", with_(FRAMES_SQL) + "SELECT sid, frame_index, source, round(confidence, 4) AS confidence FROM frames WHERE source IN ('detected','interpolated') AND confidence > 0")
def reliable_points(spark, sf):
    rows = flight_points(spark, sf).filter(reliable(c("source"), c("confidence")))
    return rows.select("sid", "frame_index", "source", F.round("confidence", 4).alias("confidence"))


@query("PRJ26", FLIGHT_SQL + "SELECT sid, shot_index, f AS frame_index, descent, above, below, near, tight, wide FROM fl")
def point_flags(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"]).filter("kept")
    return rows.select(*KEYS, "frame_index", "descent", "above", "below", "near", "tight", "wide")


@query("FN06", FLIGHT_SQL + """SELECT sid, shot_index, f AS frame_index, round(hoop_y - 0.35 * hoop_r, 4) AS rim_top, round(hoop_y + 0.35 * hoop_r, 4) AS rim_bottom,
  round((wide_px - 1.4 * hoop_r)::DOUBLE, 4) AS tight_px, round(wide_px::DOUBLE, 4) AS wide_px FROM fl""")
def rim_bands(spark, sf):
    rows = flight_rows(flight_points(spark, sf), hoops(spark, sf), KEYS, ["sid"]).filter("kept")
    return rows.select(
        *KEYS, "frame_index", F.round(rim.rim_top(c("hoop_y"), c("hoop_r")), 4).alias("rim_top"),
        F.round(rim.rim_bottom(c("hoop_y"), c("hoop_r")), 4).alias("rim_bottom"), F.round("tight_px", 4).alias("tight_px"), F.round("wide_px", 4).alias("wide_px"),
    )


@query("WIN05", FLIGHT_SQL + "SELECT sid, shot_index, frame_index, source FROM kept")
def reject_outliers(spark, sf):
    return mark_outliers(flight_points(spark, sf), KEYS).filter("kept").select(*KEYS, "frame_index", "source")


@query("AGG19", FLIGHT_SQL + "SELECT sid, shot_index, af AS apex_frame, (SELECT min(y) FROM kept k WHERE k.sid = apex.sid AND k.shot_index = apex.shot_index) AS apex_y FROM apex")
def apex(spark, sf):
    from kinetable.operators.aggregates import arg_min

    rows = mark_outliers(flight_points(spark, sf), KEYS).filter("kept")
    return arg_min(rows, KEYS, "y", ["frame_index"], {"frame_index": "apex_frame", "y": "apex_y"})


REVERSAL_SQL = FLIGHT_SQL + """, st AS (SELECT sid, shot_index, min(f) AS start_ FROM fl WHERE descent AND t - at_ <= 2.0 AND wide GROUP BY ALL),
ct AS (SELECT sid, shot_index, min(f) AS cfr, min(t) AS ctt FROM fl WHERE descent AND t - at_ <= 2.0 AND wide AND tight AND near GROUP BY ALL),
epi AS (SELECT fl.*, start_, cfr, ctt, coalesce(f >= cfr AND t - ctt <= 0.75, false) AS post, coalesce(f < cfr, false) AS pre
  FROM fl JOIN st USING (sid, shot_index) LEFT JOIN ct USING (sid, shot_index) WHERE descent AND t - at_ <= 2.0 AND f >= start_),
mx AS (SELECT sid, shot_index, max(y) FILTER (post) AS my FROM epi GROUP BY ALL),
dp AS (SELECT sid, shot_index, min(f) FILTER (post AND y = my) AS df, any_value(my) AS my FROM epi JOIN mx USING (sid, shot_index) GROUP BY ALL),
rv AS (SELECT sid, shot_index, any_value(start_) AS s0, max(f) AS e0, any_value(cfr) AS cfr, count(*) FILTER (pre) AS n_pre, arg_min(y, f) FILTER (pre) AS y0, arg_max(y, f) FILTER (pre) AS y1,
  count(*) FILTER (post) AS n_post, any_value(df) AS df, count(*) FILTER (post AND f > df AND y < my) AS n_c, list(f ORDER BY f) FILTER (post AND f > df AND y < my) AS fr,
  count(*) FILTER (post AND f > df AND y < my AND source = 'detected') AS nd, count(*) FILTER (post AND f > df AND y < my AND source = 'interpolated') AS ni,
  coalesce(bool_or(post AND f > df AND y < my AND NOT wide), false) AS side, coalesce(bool_or(post AND f > df AND y < my AND above), false) AS up
  FROM epi JOIN dp USING (sid, shot_index) GROUP BY ALL),
rr AS (SELECT ev.sid, ev.shot_index, rv.* EXCLUDE (sid, shot_index), CASE WHEN hc IS NULL OR hc < 0.3 THEN 'hoop_location_not_reliable' WHEN n_reliable < 3 THEN 'insufficient_ball_trajectory_data'
  WHEN n_descent < 3 THEN 'insufficient_descent_observation' WHEN s0 IS NULL THEN 'no_rim_interaction_region_observed' WHEN cfr IS NULL THEN 'no_contact_level_proximity_observed'
  WHEN n_post < 2 THEN 'insufficient_post_contact_observation' WHEN n_c = 0 THEN 'no_reversal_clean_continuation' WHEN n_c < 2 THEN 'reversal_candidate_not_sustained'
  WHEN nd = 0 THEN 'reversal_structurally_present_but_interpolated_only' WHEN side OR up THEN 'post_contact_reversal_with_escape' ELSE 'post_contact_reversal_without_confirmed_escape' END AS reason
  FROM ev LEFT JOIN rv USING (sid, shot_index)),
r2 AS (SELECT *, reason NOT IN ('hoop_location_not_reliable','insufficient_ball_trajectory_data','insufficient_descent_observation','no_rim_interaction_region_observed') AS begun FROM rr),
r3 AS (SELECT *, begun AND cfr IS NOT NULL AS touched, begun AND cfr IS NOT NULL AND n_post >= 2 AS watched, begun AND cfr IS NOT NULL AND n_post >= 2 AND n_c >= 2 AS conf FROM r2),
rev AS (SELECT sid, shot_index, reason, CASE WHEN reason IN ('no_reversal_clean_continuation','post_contact_reversal_with_escape') THEN 'strong'
  WHEN reason IN ('reversal_candidate_not_sustained','post_contact_reversal_without_confirmed_escape') THEN 'weak' ELSE 'insufficient' END AS evidence_quality,
  CASE WHEN begun THEN s0 END AS interaction_start_frame, CASE WHEN begun THEN e0 END AS interaction_end_frame, CASE WHEN touched THEN cfr END AS contact_frame,
  CASE WHEN touched AND n_pre >= 2 THEN y1 > y0 END AS pre_contact_descending, CASE WHEN touched THEN n_pre ELSE 0 END AS pre_contact_n_points, conf AS reversal_detected,
  CASE WHEN watched THEN df END AS max_depth_frame, CASE WHEN conf THEN fr[1] END AS reversal_frame, CASE WHEN conf THEN fr ELSE [] END AS reversal_confirm_frames,
  CASE WHEN conf THEN nd ELSE 0 END AS n_detected_support, CASE WHEN conf THEN ni ELSE 0 END AS n_interpolated_support,
  conf AND nd > 0 AND (side OR up) AS escape_detected, CASE WHEN conf AND nd > 0 THEN CASE WHEN side AND up THEN 'lateral_and_upward' WHEN side THEN 'lateral' WHEN up THEN 'upward' END END AS escape_direction FROM r3)
"""


@query("EPI13", REVERSAL_SQL + "SELECT * FROM rev")
def reversal(spark, sf):
    return post_contact_reversal(flight_points(spark, sf), hoops(spark, sf))


@query("EPI22", BASE_SQL.replace("WITH ", "WITH ", 1) + REVERSAL_SQL[len(FLIGHT_SQL):] + """SELECT sid, shot_index, outcome, outcome_reason, reason AS reversal_reason, evidence_quality, escape_direction
FROM res JOIN rev USING (sid, shot_index)""")
def outcome_with_reversal(spark, sf):
    pts, hp = flight_points(spark, sf), hoops(spark, sf)
    rows = stage(flight_rows(pts, hp, KEYS, ["sid"]))
    base = oc.classify_outcome(pts, hp, flight=rows).select(*KEYS, "outcome", "outcome_reason")
    rev = post_contact_reversal(pts, hp, flight=rows).select(*KEYS, c("reason").alias("reversal_reason"), "evidence_quality", "escape_direction")
    return base.join(rev, KEYS)

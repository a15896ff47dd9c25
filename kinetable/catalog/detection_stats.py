"""Registered aggregates over frames, detections, candidates and poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.base import (
    DETECTION_DAYS, DETECTIONS_SQL, FRAME_SERIES, FRAMES_SQL, POINTS_SQL, POSES_SQL, detections, flight_points, frames, poses, query, table, with_,
)
from kinetable.catalog.joins import WINDOWS_SQL, order_windows
from kinetable.functions import geometry as geo
from kinetable.operators import aggregates as ag
from kinetable.operators import windows as win

c = F.col
KEYS = ["sid", "shot_index"]


@query("AGG13", with_(FRAMES_SQL, POINTS_SQL) + """SELECT sid, shot_index, count(*) FILTER (source='detected') AS num_detected, count(*) FILTER (source='interpolated') AS num_interpolated,
 count(*) FILTER (source='predicted') AS num_predicted, count(*) FILTER (source='unavailable') AS num_unavailable,
 round(count(*) FILTER (source IN ('detected','interpolated')) / count(*), 3) AS quality FROM points GROUP BY ALL""")
def provenance_counts(spark, sf):
    return ag.provenance_counts(flight_points(spark, sf), KEYS)


@query("AGG33", with_(FRAMES_SQL) + "SELECT sid, source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY sid), 4) AS pct FROM frames GROUP BY sid, source")
def provenance_mix(spark, sf):
    return ag.provenance_mix(frames(spark, sf), ["sid"])


CONF_SQL = "(" + " + ".join(f"{j}_v" for j in ag.CORE_JOINTS) + ") / 10"


@query("AGG15", with_(POSES_SQL) + f"SELECT sid, frame_index // 12 AS shot_index, round(avg({CONF_SQL}) FILTER (detected), 6) AS pose_quality FROM poses GROUP BY ALL")
def pose_quality(spark, sf):
    p = poses(spark, sf)
    return p.groupBy("sid", F.floor(c("frame_index") / 12).alias("shot_index")).agg(F.round(F.avg(F.when(c("detected"), ag.pose_confidence())), 6).alias("pose_quality"))


@query("AGG16", with_(FRAMES_SQL) + "SELECT sid, y AS upper_median, n FROM (SELECT sid, y, row_number() OVER (PARTITION BY sid ORDER BY y) AS r, count(*) OVER (PARTITION BY sid) AS n FROM frames) WHERE r = n // 2 + 1")
def upper_median(spark, sf):
    return ag.upper_median(frames(spark, sf), ["sid"], "y")


SPEEDS_SQL = """sp AS (SELECT sid, sqrt(pow(x - px, 2) + pow(y - py, 2)) / (t - pt) AS v FROM (SELECT sid, x, y, timestamp_sec AS t, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(timestamp_sec) OVER w AS pt
 FROM frames WHERE source = 'detected' WINDOW w AS (PARTITION BY sid ORDER BY frame_index)) WHERE pt IS NOT NULL AND t - pt > 1e-6)"""


@query("AGG17", with_(FRAMES_SQL, SPEEDS_SQL) + """SELECT s.sid, coalesce(round(v, 4), 0) AS p95_speed, coalesce(n, 0) AS n FROM (SELECT DISTINCT sid FROM frames) s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY v) - 1 AS r,
 count(*) OVER (PARTITION BY sid) AS n FROM sp) WHERE r = least(n - 1, round_even(0.95 * (n - 1), 0))) q ON q.sid = s.sid""")
def p95_speed(spark, sf):
    every = frames(spark, sf)
    rows = win.consecutive_pairs(every.filter("source = 'detected'"), FRAME_SERIES, ["x", "y", "timestamp_sec"])
    dt = c("timestamp_sec") - c("a.timestamp_sec")
    v = F.hypot(c("x") - c("a.x"), c("y") - c("a.y")) / dt
    out = ag.nearest_rank(rows.filter(dt > 1e-6).withColumn("v", v), ["sid"], "v", name="p95_speed", spine=every)
    return out.withColumn("p95_speed", F.round("p95_speed", 4))


SIDE_SQL = """sd AS (SELECT sid, frame_index // 12 AS shot_index, left_wrist_v AS lv, right_wrist_v AS rv, sqrt(pow(left_wrist_x - nose_x, 2) + pow(left_wrist_y - nose_y, 2)) AS ld,
 sqrt(pow(right_wrist_x - nose_x, 2) + pow(right_wrist_y - nose_y, 2)) AS rd FROM poses),
sm AS (SELECT sid, shot_index, sum(ld * lv) FILTER (lv >= 0.4) / nullif(sum(lv) FILTER (lv >= 0.4), 0) AS l, sum(rd * rv) FILTER (rv >= 0.4) / nullif(sum(rv) FILTER (rv >= 0.4), 0) AS r FROM sd GROUP BY ALL)"""


@query("AGG18", with_(POSES_SQL, SIDE_SQL) + """SELECT sid, shot_index, round(l, 6) AS left_mean, round(r, 6) AS right_mean,
 CASE WHEN l IS NULL AND r IS NULL THEN NULL WHEN l IS NULL THEN 'right' WHEN r IS NULL OR l < r THEN 'left' ELSE 'right' END AS shooting_side FROM sm""")
def weighted_side(spark, sf):
    p = poses(spark, sf)
    nose = geo.point(c("joints.nose"))
    sample = {}
    for side in ("left", "right"):
        sample[f"{side}_vis"] = c(f"joints.{side}_wrist.visibility")
        sample[f"{side}_dist"] = geo.dist(geo.point(c(f"joints.{side}_wrist")), nose)
    rows = p.withColumns(sample).withColumn("shot_index", F.floor(c("frame_index") / 12))
    out = ag.weighted_side(rows, KEYS)
    return out.select(*KEYS, F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"), "shooting_side")


@query("AGG20", with_(DETECTIONS_SQL) + f"""SELECT sid, count(b) AS frames_with_detection, round(count(b) / {DETECTION_DAYS}, 4) AS coverage, round(avg(b), 4) AS mean_best_confidence
 FROM (SELECT sid FROM detections UNION SELECT c_custkey::BIGINT FROM customer) s LEFT JOIN (SELECT sid, frame_index, max(confidence) AS b FROM detections GROUP BY ALL) d USING (sid) GROUP BY sid""")
def coverage(spark, sf):
    dets = detections(spark, sf)
    sessions = dets.select("sid").union(table(spark, sf, "customer").select(c("c_custkey").cast("long"))).distinct()
    return ag.coverage(dets, sessions, ["sid"], "frame_index", F.lit(DETECTION_DAYS))


WIDE_SQL = WINDOWS_SQL.replace("+ 3", "+ 9") + ", ds AS (SELECT DISTINCT sid, frame_index AS f FROM detections)"


@query("AGG21", with_(DETECTIONS_SQL, WIDE_SQL) + """SELECT w.sid, shot_index, round(count(*) FILTER (f BETWEEN lo AND hi) / (hi - lo + 1), 4) AS flight_coverage,
 round(count(*) FILTER (f BETWEEN lo + 7 AND hi) / 3, 4) AS near_rim_coverage, count(*) FILTER (f BETWEEN greatest(0, lo - 2) AND lo + 2) AS release_frames_seen
 FROM windows w LEFT JOIN ds d ON d.sid = w.sid GROUP BY w.sid, shot_index, lo, hi""")
def window_coverage(spark, sf):
    return ag.window_coverage(detections(spark, sf), order_windows(spark, sf, 9), ["sid"], "shot_index", "frame_index", "lo", "hi")


@query("AGG22", with_(DETECTIONS_SQL, WIDE_SQL) + """, sp AS (SELECT sid, shot_index, unnest(range(lo, hi + 1)) AS f FROM windows),
h AS (SELECT s.sid, s.shot_index, s.f, d.f IS NOT NULL AS hit FROM sp s LEFT JOIN ds d ON d.sid = s.sid AND d.f = s.f),
g AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY sid, shot_index ORDER BY f) AS i FROM h),
pw AS (SELECT sid, shot_index, max(n)::BIGINT AS longest_gap FROM (SELECT sid, shot_index, i, count(*) FILTER (NOT hit) AS n FROM g GROUP BY ALL) GROUP BY ALL),
al AS (SELECT k.sid, k.f, d.f IS NOT NULL AS hit FROM (SELECT sid, unnest(range(1, 32)) AS f FROM (SELECT DISTINCT sid FROM ds)) k LEFT JOIN ds d ON d.sid = k.sid AND d.f = k.f),
oa AS (SELECT sid, max(n)::BIGINT AS overall_longest_gap FROM (SELECT sid, i, count(*) FILTER (NOT hit) AS n FROM (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY f) AS i FROM al) GROUP BY ALL) GROUP BY ALL)
SELECT coalesce(pw.sid, oa.sid) AS sid, shot_index, longest_gap, overall_longest_gap FROM pw FULL JOIN oa ON oa.sid = pw.sid""")
def longest_gap(spark, sf):
    """Gaps of each window beside the overall one; sessions without windows have a row of their own."""
    d = detections(spark, sf)
    per = ag.longest_gap(d, order_windows(spark, sf, 9), ["sid"], "shot_index", "frame_index", "lo", "hi")
    return per.join(ag.overall_gap(d, ["sid"], "frame_index", F.lit(1), F.lit(DETECTION_DAYS)), "sid", "full")


TARGET_SQL = "tg AS (SELECT sid, avg(x1) AS tx, avg(y1) AS ty, 30.0 AS tr FROM detections GROUP BY sid)"


@query("AGG23", with_(DETECTIONS_SQL, TARGET_SQL) + """SELECT sid, count(*) AS n_points, round((stddev_pop(x1) + stddev_pop(y1)) / 2, 4) AS stability_px FROM detections JOIN tg USING (sid)
 WHERE sqrt(pow(x1 - tx, 2) + pow(y1 - ty, 2)) < 2 * tr GROUP BY sid HAVING count(*) >= 2""")
def positional_stability(spark, sf):
    d = detections(spark, sf).select("sid", c("x1").alias("x"), c("y1").alias("y"))
    target = d.groupBy("sid").agg(F.avg("x").alias("target_x"), F.avg("y").alias("target_y"), F.lit(30.0).alias("target_r"))
    return ag.positional_stability(d, target, ["sid"])


@query("AGG24", with_(DETECTIONS_SQL) + """SELECT sid, count(*) AS frames_with_detection, count(*) FILTER (n > 1) AS frames_with_multiple_candidates, any_value(m) AS mean_confidence, any_value(md) AS median_confidence
 FROM (SELECT sid, frame_index, count(*) AS n FROM detections GROUP BY ALL) JOIN (SELECT sid, round(avg(confidence), 4) AS m, round(median(confidence), 4) AS md FROM detections GROUP BY sid) USING (sid) GROUP BY sid""")
def detector_report(spark, sf):
    return ag.detector_report(detections(spark, sf), ["sid"], "frame_index")


def candidates(spark, sf):
    d = detections(spark, sf)
    return d.select("sid", "frame_index", "event_id", c("x1").alias("x"), c("y1").alias("y"), (F.lit(5.0) + F.pmod("event_id", F.lit(7))).alias("radius"), "confidence", c("class_name").alias("source"))


CLUSTER_SQL = """cand AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY frame_index, event_id) AS i, x1 AS x, y1 AS y, 5.0::DOUBLE + event_id % 7 AS radius, class_name AS source FROM detections),
cl AS (SELECT sid, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS k, []::DOUBLE[] AS sx, []::DOUBLE[] AS sy, []::DOUBLE[] AS n FROM (SELECT DISTINCT sid FROM cand)
 UNION ALL SELECT sid, i, event_id, k,
  CASE WHEN k = len(sx) + 1 THEN list_append(sx, x) ELSE list_transform(sx, lambda v, j: CASE WHEN j = k THEN v + x ELSE v END) END,
  CASE WHEN k = len(sy) + 1 THEN list_append(sy, y) ELSE list_transform(sy, lambda v, j: CASE WHEN j = k THEN v + y ELSE v END) END,
  CASE WHEN k = len(n) + 1 THEN list_append(n, 1) ELSE list_transform(n, lambda v, j: CASE WHEN j = k THEN v + 1 ELSE v END) END FROM
  (SELECT c.sid, c.i, c.event_id, c.x, c.y, sx, sy, n, coalesce(list_position(list_transform(sx, lambda v, j: sqrt(pow(c.x - v / n[j], 2) + pow(c.y - sy[j] / n[j], 2)) <= 40), true), len(sx) + 1)::BIGINT AS k
   FROM cl JOIN cand c ON c.sid = cl.sid AND c.i = cl.i + 1)),
ck AS (SELECT c.*, cl.k - 1 AS cluster FROM cand c JOIN cl ON cl.sid = c.sid AND cl.i = c.i),
bpf AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY sid, cluster, frame_index ORDER BY confidence DESC, event_id) = 1)"""


@query("AGG25", with_(DETECTIONS_SQL, CLUSTER_SQL, recursive=True) + """, cs AS (SELECT sid, cluster, avg(x) AS cx, avg(y) AS cy, avg(radius) AS r, count(*) AS votes, avg(confidence) AS mc, string_agg(DISTINCT source, '+' ORDER BY source) AS method FROM bpf GROUP BY ALL)
SELECT sid, round(cx, 8) AS rim_center_x, round(cy, 8) AS rim_center_y, round(r, 8) AS rim_radius_px, votes, method, round(0.6 * least(1.0, votes / 4) + 0.4 * mc, 3) AS confidence FROM cs
QUALIFY row_number() OVER (PARTITION BY sid ORDER BY votes DESC, round(mc, 12) DESC, cluster) = 1""")
def vote_location(spark, sf):
    out = ag.vote_location(candidates(spark, sf), ["sid"], ["frame_index", "event_id"])
    return out.withColumns({n: F.round(n, 8) for n in ("rim_center_x", "rim_center_y", "rim_radius_px")})


@query("TOP4", with_(DETECTIONS_SQL, CLUSTER_SQL, recursive=True) + """, cs AS (SELECT sid, cluster, count(*) AS votes, avg(confidence) AS mc FROM bpf GROUP BY ALL)
SELECT sid, cluster, votes, round(mc, 4) AS mean_confidence FROM cs QUALIFY row_number() OVER (PARTITION BY sid ORDER BY votes DESC, round(mc, 12) DESC, cluster) = 1""")
def best_cluster(spark, sf):
    from kinetable.operators.topk import best_row

    cands, order = candidates(spark, sf), ["frame_index", "event_id"]
    tagged = cands.join(ag.greedy_clusters(cands, ["sid"], order), ["sid", *order])
    best = ag.best_per_frame(tagged, ["sid", "cluster"], "frame_index", "event_id")
    cl = best.groupBy("sid", "cluster").agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("mean_confidence"))
    return best_row(cl, ["sid"], [-c("votes"), -F.round("mean_confidence", 12), c("cluster")]).withColumn("mean_confidence", F.round("mean_confidence", 4))


@query("AGG26", with_(DETECTIONS_SQL) + "SELECT sid, class_name, frame_index, event_id FROM detections QUALIFY row_number() OVER (PARTITION BY sid, class_name, frame_index ORDER BY confidence DESC, event_id) = 1")
def best_per_frame(spark, sf):
    return ag.best_per_frame(detections(spark, sf), ["sid", "class_name"], "frame_index", "event_id").select("sid", "class_name", "frame_index", "event_id")


@query("AGG27", with_(FRAMES_SQL, POINTS_SQL) + """, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM points WHERE source IN ('detected','interpolated') WINDOW w AS (PARTITION BY sid, shot_index ORDER BY frame_index))
SELECT sid, shot_index, CASE WHEN count(*) >= 3 AND sum(sqrt(pow(x-px,2)+pow(y-py,2))) >= 1e-9 THEN
 round(sqrt(pow(arg_max(x, frame_index) - arg_min(x, frame_index), 2) + pow(arg_max(y, frame_index) - arg_min(y, frame_index), 2)) / sum(sqrt(pow(x-px,2)+pow(y-py,2))), 3) END AS straightness_ratio FROM s GROUP BY ALL""")
def straightness(spark, sf):
    return ag.straightness(flight_points(spark, sf), KEYS)


@query("AGG28", with_(FRAMES_SQL, POINTS_SQL) + """SELECT sid, shot_index, round((arg_min(y, frame_index) - min(y) FILTER (source IN ('detected','interpolated'))) / 400.0, 6) AS apex_height_norm FROM points GROUP BY ALL""")
def apex_height(spark, sf):
    good = F.when(c("source").isin("detected", "interpolated"), c("y"))
    height = (F.min_by("y", "frame_index") - F.min(good)) / F.lit(400.0)
    return flight_points(spark, sf).groupBy(*KEYS).agg(F.round(height, 6).alias("apex_height_norm"))


RUNS_SQL = """ch AS (SELECT *, source IS DISTINCT FROM lag(source) OVER (PARTITION BY sid ORDER BY frame_index) AS st FROM frames),
ri AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY frame_index) AS g FROM ch),
runs AS (SELECT sid, g, source, min(frame_index) AS start, max(frame_index) AS "end", count(*) AS length FROM ri GROUP BY ALL)"""


def source_runs(spark, sf):
    return win.state_runs(frames(spark, sf), FRAME_SERIES, "source")


@query("AGG29", with_(FRAMES_SQL, RUNS_SQL) + """, q AS (SELECT *, length / 30.0::DOUBLE AS s, row_number() OVER (PARTITION BY sid, source ORDER BY length) AS r, count(*) OVER (PARTITION BY sid, source) AS n FROM runs)
SELECT sid, source, count(*) AS runs, round(min(s), 4) AS min_sec, round(max(s), 4) AS max_sec, round(avg(s), 9) AS mean_sec, count(*) FILTER (s > 0.1) AS long_runs, round(max(s) FILTER (r = n // 2 + 1), 4) AS median_sec FROM q GROUP BY ALL""")
def state_run_stats(spark, sf):
    return ag.state_run_stats(source_runs(spark, sf), ["sid", "source"], long_sec=0.1)


@query("TOP10", with_(FRAMES_SQL, RUNS_SQL) + "SELECT sid, start, \"end\", length, row_number() OVER (PARTITION BY sid ORDER BY length DESC, start) AS rank FROM runs QUALIFY rank <= 10")
def longest_runs(spark, sf):
    return ag.longest_runs(source_runs(spark, sf), ["sid"])


@query("AGG34", with_(FRAMES_SQL) + "SELECT sid, count(*) FILTER (confidence >= 0.75) AS n_high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.75) AS n_medium, count(*) FILTER (confidence > 0 AND confidence < 0.5) AS n_low FROM frames GROUP BY sid")
def tier_counts(spark, sf):
    from kinetable.functions.scores import confidence_level

    return ag.tier_counts(frames(spark, sf).withColumn("tier", confidence_level(c("confidence"))), ["sid"], "tier")


@query("AGG36", with_(FRAMES_SQL, POINTS_SQL) + """SELECT sid, shot_index, count(*) AS n_frame_pairs, count(*) FILTER (sqrt(y) / 5 > 1) AS n_elevated_pairs, max(sqrt(y) / 5) AS max_relative_motion, round(avg(sqrt(y) / 5), 4) AS mean_relative_motion,
 count(*) FILTER (x > 20 AND source = 'detected') AS n_fully_clean_pairs FROM points GROUP BY ALL""")
def motion_summary(spark, sf):
    p = flight_points(spark, sf).select(*KEYS, (F.sqrt("y") / 5).alias("relative_motion"), (c("x") > 20).alias("mask_available"), c("source").alias("mask_source"))
    return ag.motion_summary(p, KEYS)


@query("AGG37", with_(FRAMES_SQL, POINTS_SQL) + """, sh AS (SELECT sid, shot_index, min(frame_index) AS s, max(frame_index) AS e, min(frame_index) FILTER (y > 100) AS lo, max(frame_index) FILTER (y > 100) AS hi FROM points GROUP BY ALL)
SELECT sid, shot_index, greatest(coalesce(lo - 12, s), s - 12) AS lo, least(coalesce(hi + 12, s + 60), e) AS hi FROM sh""")
def evidence_window(spark, sf):
    p = flight_points(spark, sf)
    sh = p.groupBy(*KEYS).agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"))
    return ag.evidence_window(sh, p.filter("y > 100").select(*KEYS, c("frame_index").alias("frame")), KEYS)


QUALITY = "CASE WHEN n_chars < 150 THEN 'unknown' WHEN n_chars < 600 THEN 'bad' ELSE 'good' END"


@query("AGG30", f"""SELECT truth, count(*) FILTER (pred='good') AS pred_good, count(*) FILTER (pred='bad') AS pred_bad, count(*) FILTER (pred='unknown') AS pred_unknown, count(*) AS n,
 round(count(*) FILTER (pred=truth)/count(*),4) AS recall, round(count(*) FILTER (pred=truth)/nullif(count(*) FILTER (pred<>'unknown'),0),4) AS committed_accuracy,
 round(count(*) FILTER (pred='unknown')/count(*),4) AS unknown_rate FROM (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS truth, {QUALITY} AS pred FROM labels JOIN documents USING (doc_id)) GROUP BY truth""")
def confusion(spark, sf):
    from kinetable.operators.evaluation import confusion as op

    rows = table(spark, sf, "documents").select("doc_id", F.expr(QUALITY).alias("pred")).join(table(spark, sf, "labels"), "doc_id")
    return op(rows.withColumn("truth", F.when(c("quality") == 1, "good").otherwise("bad")), "truth", "pred", ["good", "bad", "unknown"])


@query("AGG35", "SELECT source AS split, count(*) AS slots, count(DISTINCT md5(text)) AS unique_files FROM documents GROUP BY source")
def split_exposure(spark, sf):
    from kinetable.operators.curation import split_exposure as op

    return op(table(spark, sf, "documents").select(c("source").alias("split"), F.md5("text").alias("file_name")))



"""Registered projections, scalar functions, top-k and curation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetable.catalog.base import (
    DETECTIONS_SQL, FRAMES_SQL, POSES_SQL, SHOT_METRICS, detections, frames, poses, query, shots, shots_sql, table, with_,
)
from kinetable.catalog.detection_stats import candidates
from kinetable.functions import geometry as geo
from kinetable.functions import scores as sc
from kinetable.functions import stats, text
from kinetable.operators import curation as cu
from kinetable.operators import projections as pj
from kinetable.operators import signals as sg
from kinetable.operators.lineage import stage
from kinetable.operators.topk import best_row
from kinetable.plans.registry import melt_metrics

c = F.col
DET = with_(DETECTIONS_SQL)
POSE = with_(POSES_SQL)


def r(col, n=6):
    return F.round(col, n)


@query("PRJ02", DET + "SELECT event_id, round((x1+x2)/2, 6) AS center_x, round((y1+y2)/2, 6) AS center_y, round(x2-x1, 6) AS width, round(y2-y1, 6) AS height FROM detections")
def box_geometry(spark, sf):
    return pj.with_box_geometry(detections(spark, sf)).select("event_id", *[r(n).alias(n) for n in ("center_x", "center_y", "width", "height")])


@query("PRJ03", DET + "SELECT event_id, class_name FROM detections WHERE (class_name='view' AND confidence >= 0.35) OR (class_name='click' AND confidence >= 0.25)")
def split_detections(spark, sf):
    return pj.split_detections(detections(spark, sf), {"view": 0.35, "click": 0.25}).select("event_id", "class_name")


@query("PRJ04", DET + "SELECT event_id, round((x1+x2)/2, 6) AS x, round((y1+y2)/2, 6) AS y, round(greatest(x2-x1, y2-y1)/2, 6) AS radius, 'detector' AS source FROM detections")
def rim_candidates(spark, sf):
    return pj.rim_candidates(detections(spark, sf), "detector").select("event_id", r("x").alias("x"), r("y").alias("y"), r("radius").alias("radius"), "source")


@query("PRJ05", DET + "SELECT event_id, (y2-y1)/40 BETWEEN 0.01 AND 0.35 AS size_ok FROM detections")
def size_ok(spark, sf):
    return detections(spark, sf).select("event_id", pj.size_ok(c("y2") - c("y1"), F.lit(40.0)).alias("size_ok"))


@query("PRJ06", DET + """SELECT event_id, round(least(1.0, confidence + 0.15*(x1/100) + 0.15*((event_id%10)/20.0)), 6) AS confidence FROM detections WHERE x1/100 >= 0.55 OR (event_id%10)/20.0 >= 0.12""")
def rescore(spark, sf):
    d = detections(spark, sf).withColumns({"shape": c("x1") / 100, "color": F.pmod("event_id", F.lit(10)) / F.lit(20.0)})
    return pj.rescore(d).select("event_id", r("confidence").alias("confidence"))


@query("PRJ07", DET + "SELECT event_id, round((x1+x2)/2,6) AS x, round(y1+0.6*(y2-y1),6) AS y, round(greatest(x2-x1,y2-y1)/2, 6) AS radius FROM detections WHERE x2-x1 > 1 AND y2-y1 > 1")
def rim_from_box(spark, sf):
    return pj.rim_from_box(detections(spark, sf)).select("event_id", r("x").alias("x"), r("y").alias("y"), r("radius").alias("radius"))


@query("PRJ08", POSE + "SELECT vec_id, round((100 + nose_x*300)/960, 8) AS x, round((50 + nose_y*400)/540, 8) AS y FROM poses")
def remap(spark, sf):
    roi = [F.lit(v) for v in (100.0, 50.0, 400.0, 450.0)]
    x, y = pj.remap_point(c("joints.nose.x"), c("joints.nose.y"), roi, F.lit(960.0), F.lit(540.0))
    return poses(spark, sf).select("vec_id", r(x, 8).alias("x"), r(y, 8).alias("y"))


@query("PRJ09", DET + """SELECT event_id, greatest(0, trunc(x1-50))::BIGINT AS x1, greatest(0, trunc(y1-65))::BIGINT AS y1, least(640, trunc(x1+50))::BIGINT AS x2, least(360, trunc(y1+50))::BIGINT AS y2 FROM detections""")
def hoop_roi(spark, sf):
    box = pj.hoop_roi(c("x1"), c("y1"), F.lit(10.0), F.lit(640), F.lit(360))
    return detections(spark, sf).select("event_id", box.alias("b")).select("event_id", *[c(f"b.{n}").cast("long").alias(n) for n in ("x1", "y1", "x2", "y2")])


LEG = "least(coalesce({s}_hip_v,-1), coalesce({s}_knee_v,-1), coalesce({s}_ankle_v,-1)) >= 0.4"
L, R = LEG.format(s="left"), LEG.format(s="right")
TORSO = "least(left_shoulder_v, right_shoulder_v, left_hip_v, right_hip_v) >= 0.4"


@query("PRJ10", POSE + f"""SELECT vec_id, round(CASE WHEN {L} THEN left_knee_x WHEN {R} THEN right_knee_x END, 8) AS knee_x,
 round(CASE WHEN least(left_shoulder_v, left_elbow_v, left_wrist_v) >= 0.4 THEN left_elbow_y END, 8) AS elbow_y, round(CASE WHEN {TORSO} THEN (left_hip_x + right_hip_x)/2 END, 8) AS hip_mid_x FROM poses""")
def landmark_pick(spark, sf):
    return poses(spark, sf).select("vec_id", r(sg.leg_points()["knee"]["x"], 8).alias("knee_x"), r(sg.arm_points(F.lit("left"))["elbow"]["y"], 8).alias("elbow_y"), r(sg.torso_points()["hip"]["x"], 8).alias("hip_mid_x"))


def angle_sql(a, v, b):
    ux, uy, vx, vy = f"({a}_x-{v}_x)", f"({a}_y-{v}_y)", f"({b}_x-{v}_x)", f"({b}_y-{v}_y)"
    return f"degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({ux}*{vx}+{uy}*{vy})/(sqrt({ux}*{ux}+{uy}*{uy})*sqrt({vx}*{vx}+{vy}*{vy}))))))"


KNEE = {s: angle_sql(f"{s}_hip", f"{s}_knee", f"{s}_ankle") for s in ("left", "right")}


@query("PRJ11", POSE + f""", k AS (SELECT vec_id, CASE WHEN {L} AND {KNEE['left']} >= 90 THEN {KNEE['left']} END AS a, CASE WHEN {R} AND {KNEE['right']} >= 90 THEN {KNEE['right']} END AS b FROM poses)
SELECT vec_id, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a+b)/2 ELSE coalesce(a,b) END, 6) AS knee FROM k""")
def mean_knee_angle(spark, sf):
    return poses(spark, sf).select("vec_id", r(sg.mean_knee_angle()).alias("knee"))


@query("PRJ12", with_(shots_sql()) + "SELECT sid, count(*) AS usable FROM shots WHERE NOT excluded_from_analysis GROUP BY sid")
def usable(spark, sf):
    from kinetable.plans.session_stats import usable as op

    return op(shots(spark, sf)).groupBy("sid").agg(F.count(F.lit(1)).alias("usable"))


@query("PRJ13", with_(shots_sql()) + """SELECT sid, l_linenumber, metric_key, round(value, 6) AS value FROM (UNPIVOT (SELECT sid, l_linenumber, l_quantity AS quantity, sqrt(l_extendedprice/l_quantity) AS unit_price_root,
 sqrt(l_extendedprice*l_discount) AS discount_root, CASE WHEN l_tax > 0 THEN sqrt(l_extendedprice*l_tax) END AS tax_root FROM shots WHERE NOT excluded_from_analysis)
 ON quantity, unit_price_root, discount_root, tax_root INTO NAME metric_key VALUE value)""")
def melt(spark, sf):
    return melt_metrics(shots(spark, sf), ["sid", "l_linenumber"], SHOT_METRICS).withColumn("value", r("value"))


LEVEL = "CASE WHEN {c} >= 0.75 THEN 'high' WHEN {c} >= 0.5 THEN 'medium' WHEN {c} > 0 THEN 'low' ELSE 'excluded' END"


@query("PRJ14", with_(FRAMES_SQL) + f"SELECT event_id, {LEVEL.format(c='confidence')} AS level FROM frames")
def confidence_level(spark, sf):
    return frames(spark, sf).select("event_id", sc.confidence_level(c("confidence")).alias("level"))


@query("PRJ15", with_(shots_sql()) + f"SELECT l_orderkey, l_linenumber, l_partkey, {LEVEL.format(c='least(release_confidence, pose_quality, ball_track_quality)')} AS level FROM shots")
def overall_level(spark, sf):
    level = sc.overall_level(c("release_confidence"), c("pose_quality"), c("ball_track_quality"))
    return shots(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", level.alias("level"))


@query("PRJ16", with_(FRAMES_SQL) + "SELECT event_id, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM frames")
def display_tier(spark, sf):
    return frames(spark, sf).select("event_id", sc.display_tier(c("confidence")).alias("tier"))


@query("PRJ17", "SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, CASE WHEN n_chars < 200 THEN 'bad' ELSE 'good' END) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def verified_label(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    verified = F.when(c("quality") == 1, "good").when(c("quality") == 0, "bad")
    return rows.select("doc_id", F.coalesce(verified, F.when(c("n_chars") < 200, "bad").otherwise("good")).alias("label"))


@query("PRJ18", with_(shots_sql()) + """SELECT l_orderkey, l_linenumber, l_partkey, NOT (l_discount > 0) AS excluded_from_analysis, CASE WHEN NOT (l_discount > 0) THEN 'no_release_detected' END AS exclusion_reason,
 list_filter(['seen', CASE WHEN NOT (l_discount > 0) THEN 'release_could_not_be_estimated' WHEN pose_quality < 0.35 THEN 'low_pose_confidence_for_this_shot' END], lambda x: x IS NOT NULL) AS warnings FROM shots""")
def apply_exclusion(spark, sf):
    out = pj.apply_exclusion(c("l_discount") > 0, c("pose_quality"), F.array(F.lit("seen")))
    return shots(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", out.alias("e")).select("l_orderkey", "l_linenumber", "l_partkey", "e.*")


@query("PRJ19", with_(FRAMES_SQL) + "SELECT sid, round(max(timestamp_sec) - min(timestamp_sec), 3) AS duration_sec FROM frames GROUP BY sid")
def duration(spark, sf):
    return frames(spark, sf).groupBy("sid").agg(F.round(F.max("timestamp_sec") - F.min("timestamp_sec"), 3).alias("duration_sec"))


BOXES_SQL = "boxes AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'ball' WHEN 'click' THEN 'basketball' WHEN 'signup' THEN 'rim' ELSE event_type END AS label, CAST(json_extract(props,'$.k') AS DOUBLE) AS cx, value AS cy, 8.0::DOUBLE + event_id % 9 AS w, 6.0::DOUBLE + event_id % 5 AS h, user_id FROM events)"


def boxes(spark, sf):
    label = F.when(c("event_type") == "view", "ball").when(c("event_type") == "click", "basketball").when(c("event_type") == "signup", "rim").otherwise(c("event_type"))
    return table(spark, sf, "events").select(
        "event_id", label.alias("label"), F.from_json("props", "k INT")["k"].cast("double").alias("cx"), c("value").alias("cy"),
        (F.lit(8.0) + F.pmod("event_id", F.lit(9))).alias("w"), (F.lit(6.0) + F.pmod("event_id", F.lit(5))).alias("h"), "user_id",
    )


@query("PRJ20", with_(BOXES_SQL) + """SELECT event_id, CASE label WHEN 'rim' THEN 2 ELSE 1 END AS category_id, round(cx-w/2,2) AS bbox_x, round(cy-h/2,2) AS bbox_y, w AS bbox_w, h AS bbox_h, w*h AS area
 FROM boxes WHERE label IN ('ball','basketball','rim')""")
def to_coco_boxes(spark, sf):
    return pj.to_coco_boxes(boxes(spark, sf)).drop("label", "user_id")


@query("PRJ21", with_(BOXES_SQL) + """SELECT user_id, count(*) AS kept FROM boxes WHERE label IN ('ball','rim') GROUP BY user_id""")
def keep_relevant(spark, sf):
    # one image per event: its box list holds the event's own box
    b = boxes(spark, sf).select("user_id", F.array(F.struct("label", "cx", "cy")).alias("boxes"))
    return pj.keep_relevant(b, "boxes", ["ball", "rim"]).groupBy("user_id").agg(F.sum(F.size("boxes")).alias("kept"))


@query("PRJ22", """SELECT doc_id, list_filter([n_chars || ' shot(s) could not be classified', lang || ' kept'], lambda w: NOT regexp_matches(w, '^\\d+ shot\\(s\\) could not be')) AS warnings FROM documents""")
def drop_warnings(spark, sf):
    w = F.array(F.concat(c("n_chars").cast("string"), F.lit(" shot(s) could not be classified")), F.concat("lang", F.lit(" kept")))
    return table(spark, sf, "documents").select("doc_id", pj.drop_warnings(w, r"^\d+ shot\(s\) could not be").alias("warnings"))


@query("PRJ23", """SELECT doc_id, pattern FROM documents, (SELECT unnest(['http', '@', 'the ', 'password', 'key']) AS pattern) p WHERE contains(text, pattern) AND NOT (lang = 'en' AND pattern IN ('the ', 'key'))""")
def pattern_scan(spark, sf):
    docs = table(spark, sf, "documents")
    return pj.pattern_scan(spark, docs, "doc_id", "text", ["http", "@", "password"], ["the ", "key"], c("lang") == "en")


@query("PRJ25", with_(FRAMES_SQL) + "SELECT event_id, CASE WHEN source = 'predicted' THEN 'fallback' ELSE 'primary' END AS trigger FROM frames")
def trigger_type(spark, sf):
    w = F.array(F.lit("short_duration"), F.when(c("source") == "predicted", "load_phase_inferred_from_pose").otherwise("none"))
    return frames(spark, sf).select("event_id", pj.trigger_type(w).alias("trigger"))


# ------------------------------------------------------------------------ scalars


@query("FN01", POSE + "SELECT vec_id, round(sqrt(pow(left_hip_x-right_hip_x,2)+pow(left_hip_y-right_hip_y,2)),6) AS dist, round((left_hip_x+right_hip_x)/2,8) AS mid_x FROM poses")
def distance(spark, sf):
    a, b = geo.point(c("joints.left_hip")), geo.point(c("joints.right_hip"))
    return poses(spark, sf).select("vec_id", r(geo.dist(a, b)).alias("dist"), r(geo.mid(a, b)[0], 8).alias("mid_x"))


@query("FN02", POSE + f"SELECT vec_id, round({angle_sql('left_shoulder', 'left_elbow', 'left_wrist')}, 6) AS elbow_deg FROM poses")
def angle(spark, sf):
    return poses(spark, sf).select("vec_id", r(geo.angle_deg(*[geo.point(c(f"joints.left_{j}")) for j in ("shoulder", "elbow", "wrist")])).alias("elbow_deg"))


@query("FN03", POSE + "SELECT vec_id, round(degrees(atan2(left_shoulder_x-left_hip_x, left_hip_y-left_shoulder_y)),6) AS lean_deg FROM poses")
def lean(spark, sf):
    return poses(spark, sf).select("vec_id", r(geo.lean_deg(geo.point(c("joints.left_shoulder")), geo.point(c("joints.left_hip")))).alias("lean_deg"))


@query("FN04", POSE + ", t AS (SELECT *, sqrt(pow(left_shoulder_x-left_hip_x,2)+pow(left_shoulder_y-left_hip_y,2)) AS l FROM poses) SELECT vec_id, round(l,6) AS torso, round((left_hip_y-left_wrist_y)/l,6) AS norm FROM t")
def torso(spark, sf):
    length = geo.torso_len(geo.point(c("joints.left_shoulder")), geo.point(c("joints.left_hip")))
    reach = c("joints.left_hip.y") - c("joints.left_wrist.y")
    return poses(spark, sf).select("vec_id", r(length).alias("torso"), r(geo.normalize(reach, length)).alias("norm"))


@query("FN05", with_(FRAMES_SQL) + "SELECT event_id, CASE WHEN x > 0 THEN round((y-50)/sqrt(x),6) END AS vvel FROM frames")
def vertical_velocity(spark, sf):
    return frames(spark, sf).select("event_id", r(geo.vvel(F.lit(50.0), c("y"), F.sqrt("x"))).alias("vvel"))


@query("FN11", with_(FRAMES_SQL) + "SELECT event_id, round(0.3*greatest(0.0, 1-(frame_index%9)/7.0)::DOUBLE,6) AS conf FROM frames")
def decay(spark, sf):
    return frames(spark, sf).select("event_id", r(sc.decay_conf(F.pmod("frame_index", F.lit(9)))).alias("conf"))


@query("FN12", with_(FRAMES_SQL) + """, f AS (SELECT event_id, y > 40 AS p, x > 50 AS u, y + 100 >= 140 AND event_id % 3 <> 0 AS e FROM frames)
SELECT event_id, round(least(1.0, 0.4+CASE WHEN p THEN 0.3 ELSE 0 END+CASE WHEN u THEN 0.15 ELSE 0 END+CASE WHEN e THEN 0.15 ELSE 0 END)::DOUBLE,6) AS score,
 CASE WHEN p OR u OR e THEN concat_ws(',', CASE WHEN p THEN 'hand_ball_separation' END, CASE WHEN u THEN 'upward_velocity' END, CASE WHEN e THEN 'elbow_extension' END) ELSE 'state_machine_candidate_only' END AS basis FROM f""")
def release_score(spark, sf):
    elbow = F.when(F.pmod("event_id", F.lit(3)) != 0, c("y") + 100)
    score, basis = sc.release_score(c("y") > 40, c("x") > 50, elbow)
    return frames(spark, sf).select("event_id", r(score).alias("score"), basis.alias("basis"))


@query("FN13", with_(FRAMES_SQL) + "SELECT event_id, round(least(1.0, CASE source WHEN 'detected' THEN 0.75 WHEN 'interpolated' THEN 0.6 ELSE 0.55 END + 0.05*(event_id%7))::DOUBLE,6) AS conf FROM frames")
def event_confidence(spark, sf):
    path = F.when(c("source") == "detected", "strong").when(c("source") == "interpolated", "soft").otherwise("strong_override")
    return frames(spark, sf).select("event_id", r(sc.event_conf(path, F.pmod("event_id", F.lit(7)) + 3)).alias("conf"))


@query("FN14", with_(FRAMES_SQL) + "SELECT event_id, CASE WHEN y >= 60 THEN 'low' WHEN x < 40 THEN 'medium' ELSE 'high' END AS tier FROM frames")
def evidence_tier(spark, sf):
    target = F.when(c("y") < 60, "hoop_corroborated").otherwise("no_hoop_evidence")
    pose = F.when(c("x") < 40, "no_pose_evidence").when(c("x") < 70, "pose_corroborated").otherwise("no_pose_data")
    return frames(spark, sf).select("event_id", sc.evidence_tier(target, pose).alias("tier"))


@query("FN16", with_(shots_sql()) + "SELECT l_orderkey, l_linenumber, l_partkey, 'attempt ' || l_linenumber || ' was ' || outcome || ' at ' || printf('%.3f', start_time_sec) AS told FROM shots")
def render(spark, sf):
    told = F.format_string("attempt %d was %s at %s", c("l_linenumber"), c("outcome"), text.number(c("start_time_sec")))
    return shots(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", told.alias("told"))


_QUOTED = lambda v: "'" + v.replace("'", "''") + "'"
WORDING_SQL = "wd(metric_key, " + ", ".join(text.KINDS) + ") AS (VALUES " + ", ".join("(" + ", ".join(map(_QUOTED, (k, *v))) + ")" for k, v in text.WORDING.items()) + ")"
_KEYS = list(text.WORDING)


@query("FN17", with_(shots_sql(), WORDING_SQL) + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, wd.* FROM shots JOIN wd ON wd.metric_key = {[*_KEYS]}[(l_orderkey + l_linenumber) % {len(_KEYS)} + 1]""")
def wording(spark, sf):
    """Every attempt with all texts of one of the thirteen metrics."""
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.pmod(c("l_orderkey") + c("l_linenumber"), F.lit(len(_KEYS))) + 1).cast("int"))
    rows = shots(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", key.alias("metric_key"))
    return rows.join(F.broadcast(text.copy_table(spark)), "metric_key")  # a row a metric


@query("FN18", "SELECT o_orderkey, replace(lower(o_orderpriority), '-', ' ') AS told FROM orders")
def humanize(spark, sf):
    code = F.replace(F.lower("o_orderpriority"), F.lit("-"), F.lit("_"))
    return table(spark, sf, "orders").select("o_orderkey", text.humanize(code).alias("told"))


@query("FN19", "SELECT c_custkey, true AS id_is_hex, true AS time_is_iso_utc, 1::BIGINT AS rows_with_id FROM customer")
def session_id(spark, sf):
    """Fresh ids and timestamps; their values can't repeat, so their form and uniqueness are reported."""
    rows = table(spark, sf, "customer").select("c_custkey", text.new_session_id().alias("sid"), text.utc_now().alias("created_at"))
    return stage(rows).select(
        "c_custkey", c("sid").rlike("^[0-9a-f]{16}$").alias("id_is_hex"), c("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|\+00:00)$").alias("time_is_iso_utc"),
        F.count(F.lit(1)).over(Window.partitionBy("sid")).alias("rows_with_id"),
    )


@query("FN20", "SELECT event_id, CAST(json_extract(props,'$.k') AS INTEGER) AS k, '{\"k\":' || json_extract(props,'$.k') || '}' AS again FROM events")
def json_get(spark, sf):
    parsed = F.from_json("props", "k INT")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


FIT = with_(FRAMES_SQL) + """, m AS (SELECT sid, count(*) AS n, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(y) AS b0, sum(t*y) AS b1, sum(t*t*y) AS b2, regr_slope(x, t) AS sl, regr_intercept(x, t) AS ic
 FROM (SELECT *, timestamp_sec AS t FROM frames) GROUP BY sid),
d AS (SELECT *, s4*(s2*n-s1*s1)-s3*(s3*n-s1*s2)+s2*(s3*s1-s2*s2) AS det FROM m)"""


@query("FN21", FIT + """SELECT sid, round(sl,4) AS slope, round(ic,4) AS intercept, round((b2*(s2*n-s1*s1)-s3*(b1*n-s1*b0)+s2*(b1*s1-s2*b0))/det,3) AS quad FROM d""")
def least_squares(spark, sf):
    lin = stats.fit_line(c("timestamp_sec"), c("x"))
    quad = stats.fit_parabola(c("timestamp_sec"), c("y"))
    return frames(spark, sf).groupBy("sid").agg(r(lin[0], 4).alias("slope"), r(lin[1], 4).alias("intercept"), r(quad, 3).alias("quad"))


@query("FN22", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_extendedprice),1) AS r1, round(sqrt(l_extendedprice),2) AS r2, round(sqrt(l_extendedprice),3) AS r3, round(sqrt(l_extendedprice),4) AS r4 FROM lineitem")
def rounding(spark, sf):
    v = F.sqrt("l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(v, n).alias(f"r{n}") for n in (1, 2, 3, 4)])


@query("EPI20", "SELECT c_custkey AS sid, CASE WHEN c_acctbal < 0 THEN 'target_not_located' WHEN c_acctbal / 10000 < 0.4 THEN 'target_location_low_confidence' END AS warning FROM customer")
def hoop_warnings(spark, sf):
    conf = F.when(c("c_acctbal") >= 0, c("c_acctbal") / 10000)
    return table(spark, sf, "customer").select(c("c_custkey").alias("sid"), sc.coverage_warning(conf).alias("warning"))


# -------------------------------------------------------------------------- top-k


@query("TOP5", with_(FRAMES_SQL) + "SELECT sid, min(frame_index) AS first_frame FROM frames WHERE y > 100 AND source = 'detected' GROUP BY sid")
def first_where(spark, sf):
    from kinetable.operators.topk import first_where as op

    return op(frames(spark, sf), ["sid"], "frame_index", (c("y") > 100) & (c("source") == "detected")).select("sid", c("first").alias("first_frame"))


@query("TOP7", DET + "SELECT sid, frame_index, event_id FROM detections QUALIFY row_number() OVER (PARTITION BY sid, frame_index ORDER BY abs(x1-50), -confidence, event_id) = 1")
def best_candidate(spark, sf):
    rows = candidates(spark, sf).select("sid", "frame_index", "event_id", "x", "confidence")
    return best_row(rows, ["sid", "frame_index"], [F.abs(c("x") - 50), -c("confidence"), c("event_id")]).select("sid", "frame_index", "event_id")


@query("TOP8", with_(FRAMES_SQL) + "SELECT sid, frame_index FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM frames) WHERE frame_index % greatest(1, n // 40) = 0")
def even_sample(spark, sf):
    from kinetable.catalog.base import FRAME_SERIES

    return cu.even_sample(frames(spark, sf), FRAME_SERIES, 40).select("sid", "frame_index")


@query("TOP9", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders")
def newest_first(spark, sf):
    o = table(spark, sf, "orders").withColumn("age", -F.unix_date(F.to_date("o_orderdate")))
    return cu.number_rows(o, ["age", "o_orderkey"], "floor(age / 64)", "rank").select("o_orderkey", "rank")


# ----------------------------------------------------------------------- curation


@query("SET01", "SELECT doc_id AS id, 'docs' AS source, length(text) AS size FROM documents UNION ALL SELECT item_id, 'bench', length(text) FROM benchmark UNION ALL SELECT page_id, 'pages', length(html) FROM pages")
def pool(spark, sf):
    read = lambda t, i, x: table(spark, sf, t).select(c(i).alias("id"), F.char_length(x).cast("long").alias("size"))
    return cu.pool({"docs": read("documents", "doc_id", "text"), "bench": read("benchmark", "item_id", "text"), "pages": read("pages", "page_id", "html")})


SPLIT = "CASE {i} % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' WHEN 2 THEN 'weird' ELSE 'train' END"
NORM = f"CASE WHEN {SPLIT} IN ('train','valid','test') THEN {SPLIT} ELSE 'train' END"


@query("SET02", f"""WITH im AS (SELECT 'docs' AS source, 0 AS p, doc_id AS image_id, {NORM.format(i='doc_id')} AS split, 'd' || doc_id AS file_name FROM documents
 UNION ALL SELECT 'bench', 1, item_id, {NORM.format(i='item_id')}, 'bench_b' || item_id FROM benchmark WHERE {NORM.format(i='item_id')} = 'train'),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY p, image_id) AS new_image_id FROM im)
SELECT k.split, k.source, k.image_id, k.new_image_id, k.file_name, count(l.doc_id) AS annotations FROM k LEFT JOIN labels l ON k.source = 'docs' AND l.doc_id = k.image_id GROUP BY ALL""")
def merge_datasets(spark, sf):
    def images(t, i, prefix):
        split = cu.normalize_split(F.expr(SPLIT.format(i=i)))
        return table(spark, sf, t).select(c(i).alias("image_id"), split.alias("split"), F.concat(F.lit(prefix), c(i).cast("string")).alias("file_name"))

    notes = table(spark, sf, "labels").select(c("doc_id").alias("image_id"), "quality")
    merged, remapped = cu.merge_datasets(
        [images("documents", "doc_id", "d"), images("benchmark", "item_id", "b")], [notes, notes.filter(F.lit(False))], ["docs", "bench"], "source_pos * 1000000000000 + floor(image_id / 1024)"
    )
    n = remapped.groupBy("split", "new_image_id").agg(F.count(F.lit(1)).alias("annotations"))
    out = merged.join(n, ["split", "new_image_id"], "left")
    return out.select("split", "source", "image_id", "new_image_id", "file_name", F.coalesce("annotations", F.lit(0)).cast("long").alias("annotations"))


@query("SET03", "SELECT doc_id, unnest(range(1, 2 + (doc_id % 3)))::INTEGER AS copy FROM documents")
def oversample(spark, sf):
    return cu.oversample(table(spark, sf, "documents").select("doc_id"), F.pmod("doc_id", F.lit(3)) + 1)


@query("SET04", "SELECT md5(text) AS k, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def dedupe_last(spark, sf):
    return cu.dedupe_last(table(spark, sf, "documents").select(F.md5("text").alias("k"), "doc_id"), ["k"], ["doc_id"])


@query("SET06", with_(shots_sql()) + "SELECT sid, list_filter(['made','missed','unknown'], lambda o: list_contains(s, o)) AS labels FROM (SELECT sid, list(DISTINCT outcome) AS s FROM shots GROUP BY sid)")
def present_labels(spark, sf):
    return cu.present_labels(shots(spark, sf), ["sid"], "outcome", ["made", "missed", "unknown"])


@query("SET07", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def key_differences(spark, sf):
    return cu.key_differences(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("SET08", with_(FRAMES_SQL) + "SELECT sid, frame_index FROM frames f WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = f.sid AND frame_index BETWEEN c_nationkey AND c_nationkey + 10)")
def exclude_held_out(spark, sf):
    ranges = table(spark, sf, "customer").select(c("c_custkey").alias("sid"), c("c_nationkey").cast("long").alias("lo"), (c("c_nationkey") + 10).cast("long").alias("hi"))
    return cu.exclude_held_out(frames(spark, sf), ranges, ["sid"], "frame_index", "lo", "hi").select("sid", "frame_index")


@query("SET09", f"SELECT doc_id, {NORM.format(i='doc_id')} AS split FROM documents")
def normalize_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cu.normalize_split(F.expr(SPLIT.format(i="doc_id"))).alias("split"))


@query("SRC04", f"""SELECT p_id AS page_id, CASE WHEN NOT lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) IN ('.mp4','.mov','.m4v','.avi') THEN 'unsupported_extension' WHEN size_bytes/(1024*1024) > 500 THEN 'file_too_large'
 WHEN NOT readable THEN 'unreadable_video' WHEN width <= 0 OR height <= 0 THEN 'no_frames' WHEN width < 320 OR height < 240 THEN 'resolution_too_low' WHEN fps <= 0 OR fc <= 0 THEN 'bad_metadata' WHEN fc/fps < 1.5 THEN 'too_short' WHEN fc/fps > 300 THEN 'too_long' END AS code
FROM (SELECT page_id AS p_id, 'clip' || page_id || CASE page_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.MOV' ELSE '.mp4' END AS path, length(html) * 100000 AS size_bytes, page_id % 11 <> 0 AS readable, (page_id % 13) * 60 AS width, (page_id % 17) * 40 AS height, (page_id % 5) * 10.0 AS fps, length(html) AS fc FROM pages)""")
def validate_media(spark, sf):
    i = c("page_id")
    m = lambda n: F.pmod(i, F.lit(n))
    ext = F.when(m(7) == 0, ".txt").when(m(7) == 1, ".MOV").otherwise(".mp4")
    n = F.char_length("html").cast("long")
    media = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("clip"), i.cast("string"), ext).alias("path"), (n * 100000).alias("size_bytes"), (m(11) != 0).alias("readable"),
        (m(13) * 60).alias("width"), (m(17) * 40).alias("height"), (m(5) * F.lit(10.0)).alias("fps"), n.alias("frame_count"),
    )
    return pj.validate_media(media).select("page_id", "code")


@query("SRC05", with_(FRAMES_SQL) + """SELECT sid, src AS source_frame_index, src // st AS frame_index, round(src / fps, 6) AS timestamp_sec FROM
 (SELECT sid, frame_index AS src, fps, greatest(1, round_even(fps / 30.0, 0)::INTEGER) AS st FROM (SELECT *, 24.0 + (sid % 5) * 18 AS fps FROM frames)) WHERE src % st = 0""")
def subsample(spark, sf):
    f = frames(spark, sf).select("sid", c("frame_index").alias("source_frame_index"), (F.lit(24.0) + F.pmod("sid", F.lit(5)) * 18).alias("fps"))
    return pj.subsample(f).select("sid", "source_frame_index", "frame_index", F.round("timestamp_sec", 6).alias("timestamp_sec"))


"""Registered track, segmentation, release, recovery and pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.base import (
    DETECTIONS_SQL, FRAMES_SQL, HOOPS_SQL, POSES_SQL, SIGNALS_SQL, TORSO_PX, detections, frames, hoops, poses, query, signals, table, with_,
)
from kinetable.catalog.joins import ATTEMPTS_SQL, attempts
from kinetable.catalog.projections import KNEE, L, R, TORSO, angle_sql
from kinetable.catalog.windows import TRUSTED_SQL as _TRUSTED
from kinetable.operators import releases as rl
from kinetable.operators import signals as sg
from kinetable.operators.lineage import scratch_folder, stage
from kinetable.operators.mechanics import FIELDS, mechanics
from kinetable.operators.ordered import Series
from kinetable.operators.recovery import recover_points
from kinetable.operators.roi_motion import roi_motion
from kinetable.operators.segment import segment_shots, segment_trace
from kinetable.operators.track import gather_candidates, select_primary, track
from kinetable.plans import session_pipeline as sp
from kinetable.sources import images

c = F.col
TRUSTED_S = _TRUSTED.replace("FROM frames", "FROM sframes")
_P = "PARTITION BY sid ORDER BY frame_index"

OBSERVED_SQL = "obs AS (SELECT sid, frame_index AS i, timestamp_sec AS t, x AS zx, y AS zy, radius AS zr, confidence AS zc, source = 'detected' AS seen FROM frames)"
TRACK_SQL = """kf AS (SELECT sid, i, t, seen AS live, seen AS ok, zx AS x, zy AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 50.0::DOUBLE AS a, 0.0::DOUBLE AS b, 50.0::DOUBLE AS d, 0 AS m, CASE WHEN seen THEN zr END AS r, zc FROM obs WHERE i = 0
 UNION ALL SELECT sid, i, t, live OR seen, ok, CASE WHEN NOT live THEN zx WHEN ok THEN px + k0 * (zx - px) ELSE px END, CASE WHEN NOT live THEN zy WHEN ok THEN py + k0 * (zy - py) ELSE py END,
   CASE WHEN NOT live THEN 0.0 WHEN ok THEN vx + k1 * (zx - px) ELSE vx END, CASE WHEN NOT live THEN 0.0 WHEN ok THEN vy + k1 * (zy - py) ELSE vy END,
   CASE WHEN NOT live THEN 50.0 WHEN ok THEN (1 - k0) * a2 ELSE a2 END, CASE WHEN NOT live THEN 0.0 WHEN ok THEN (1 - k0) * b2 ELSE b2 END, CASE WHEN NOT live THEN 50.0 WHEN ok THEN d2 - k1 * b2 ELSE d2 END,
   CASE WHEN NOT live OR ok THEN 0 ELSE m + 1 END, CASE WHEN seen THEN CASE WHEN r IS NULL THEN zr ELSE 0.7 * r + 0.3 * zr END ELSE r END, zc
 FROM (SELECT *, CASE WHEN live THEN seen AND sqrt(pow(zx - px, 2) + pow(zy - py, 2)) <= 140 * (m + 1) ELSE seen END AS ok, a2 / (a2 + 4) AS k0, b2 / (a2 + 4) AS k1 FROM
  (SELECT o.*, k.live, k.vx, k.vy, k.m, k.r, k.x + k.vx * dt AS px, k.y + k.vy * dt AS py, k.a + 2 * dt * k.b + dt * dt * k.d + 8 * pow(dt, 4) / 4 AS a2, k.b + dt * k.d + 8 * pow(dt, 3) / 2 AS b2, k.d + 8 * dt * dt AS d2
   FROM (SELECT o.*, k.*  EXCLUDE (sid, i, t, zc, ok), greatest(0.001, o.t - k.t) AS dt FROM kf k JOIN obs o ON o.sid = k.sid AND o.i = k.i + 1) k JOIN obs o ON o.sid = k.sid AND o.i = k.i)))"""


@query("EPI01", with_(FRAMES_SQL, OBSERVED_SQL, TRACK_SQL, recursive=True) + """SELECT sid, i AS frame_index, CASE WHEN NOT live OR m > 6 THEN 'unavailable' WHEN ok THEN 'detected' WHEN m <= 3 THEN 'interpolated' ELSE 'predicted' END AS source,
 CASE WHEN live AND m <= 6 THEN round(CASE WHEN ok THEN o.zx ELSE x END, 4) END AS x, CASE WHEN live AND m <= 6 THEN round(CASE WHEN ok THEN o.zy ELSE y END, 4) END AS y,
 round(CASE WHEN NOT live OR m > 6 THEN 0.0 WHEN ok THEN zc ELSE 0.3 * (1 - m / 7.0) END::DOUBLE, 4) AS confidence, round(coalesce(r, 8.0), 7) AS radius FROM kf JOIN (SELECT sid, i, zx, zy FROM obs) o USING (sid, i)""")
def tracks(spark, sf):
    f = frames(spark, sf)
    seen = f.filter("source = 'detected'").select("sid", "frame_index", "event_id", "x", "y", "radius", "confidence")
    spine = gather_candidates(f.select("sid", "frame_index", "timestamp_sec"), seen, ["sid"], "event_id")
    t = track(spine)
    return t.select("sid", "frame_index", "source", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("confidence", 4).alias("confidence"), F.round("radius", 7).alias("radius"))


SLOTS_SQL = """bx AS (SELECT sid, frame_index, event_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, row_number() OVER (PARTITION BY sid ORDER BY frame_index, event_id) AS i FROM detections),
pm AS (SELECT DISTINCT sid, 0::BIGINT AS i, NULL::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE, a DOUBLE[])[] AS slots FROM detections
 UNION ALL SELECT sid, i, k, CASE WHEN k > len(slots) THEN list_append(slots, {'x': cx, 'y': cy, 'a': [w * h]})
   ELSE list_transform(slots, lambda s, j: CASE WHEN j = k THEN {'x': cx, 'y': cy, 'a': list_append(s.a, w * h)[-30:]} ELSE s END) END FROM
 (SELECT *, (CASE WHEN near IS NULL OR ds[near] >= 1.5 * greatest(w, h) THEN len(slots) + 1 ELSE near END)::BIGINT AS k FROM (SELECT *, list_position(ds, list_min(ds)) AS near FROM
  (SELECT b.*, q.slots, list_transform(q.slots, lambda s: sqrt(pow(b.cx - s.x, 2) + pow(b.cy - s.y, 2))) AS ds FROM pm q JOIN bx b ON b.sid = q.sid AND b.i = q.i + 1)))),
placed AS (SELECT bx.sid, frame_index, event_id, k, slots, bx.i FROM bx JOIN pm ON pm.sid = bx.sid AND pm.i = bx.i),
done AS (SELECT sid, frame_index, slots FROM placed QUALIFY row_number() OVER (PARTITION BY sid, frame_index ORDER BY i DESC) = 1),
held AS (SELECT sid, frame_index, k, max(event_id) AS box_id FROM placed GROUP BY ALL)"""


@query("EPI02", with_(DETECTIONS_SQL, SLOTS_SQL, recursive=True) + """SELECT sid, frame_index, box_id, k - 1 AS slot FROM held JOIN done USING (sid, frame_index)
QUALIFY row_number() OVER (PARTITION BY sid, frame_index ORDER BY list_sum(slots[k].a) / len(slots[k].a) DESC, k) = 1""")
def primary(spark, sf):
    return select_primary(detections(spark, sf).withColumnRenamed("event_id", "id"), ["sid"])


EPI03_SQL = """sc AS (SELECT sid, coalesce(max(l) FILTER (r = n // 2 + 1), 79.2) AS torso_px FROM (SELECT sid, l, row_number() OVER (PARTITION BY sid ORDER BY l) AS r, count(*) OVER (PARTITION BY sid) AS n FROM
 (SELECT sid, sqrt(pow(((left_shoulder_x + right_shoulder_x) / 2 - (left_hip_x + right_hip_x) / 2) * 640, 2) + pow(((left_shoulder_y + right_shoulder_y) / 2 - (left_hip_y + right_hip_y) / 2) * 360, 2)) AS l FROM poses WHERE detected)) GROUP BY sid),
pj AS (SELECT p.* EXCLUDE (timestamp_sec), f.timestamp_sec, f.x, f.y, f.source, torso_px, source <> 'unavailable' AS ok FROM poses p JOIN frames f USING (sid, frame_index) JOIN sc USING (sid))"""


@query("EPI03", with_(FRAMES_SQL, POSES_SQL, EPI03_SQL) + f"""SELECT sid, frame_index, ok AS ball_available,
 CASE WHEN ok AND detected THEN round(least(sqrt(pow(x - left_wrist_x * 640, 2) + pow(y - left_wrist_y * 360, 2)), sqrt(pow(x - right_wrist_x * 640, 2) + pow(y - right_wrist_y * 360, 2))) / torso_px, 6) END AS hand_dist,
 round(CASE WHEN ok AND lag(ok) OVER w THEN (y - lag(y) OVER w) / (timestamp_sec - lag(timestamp_sec) OVER w) / torso_px END, 6) AS velocity,
 CASE WHEN detected THEN round(CASE WHEN ({L} AND {KNEE['left']} >= 90) AND ({R} AND {KNEE['right']} >= 90) THEN ({KNEE['left']} + {KNEE['right']}) / 2 WHEN {L} AND {KNEE['left']} >= 90 THEN {KNEE['left']} WHEN {R} AND {KNEE['right']} >= 90 THEN {KNEE['right']} END, 6) END AS knee,
 CASE WHEN ok THEN round((left_shoulder_y + right_shoulder_y) / 2 * 360, 6) END AS shoulder_y, CASE WHEN detected THEN round((left_hip_x + right_hip_x) / 2 * 640 / torso_px, 6) END AS hip_x FROM pj WINDOW w AS ({_P})""")
def frame_signals(spark, sf):
    from kinetable.operators.aggregates import upper_median

    p = poses(spark, sf)
    lengths = p.filter("detected").select("sid", sg.torso_px(F.lit(640.0), F.lit(360.0)).alias("l"))
    scale = upper_median(lengths, ["sid"], "l", "torso_px").select("sid", "torso_px")
    s = sg.frame_signals(p, frames(spark, sf), scale, 640.0, 360.0)
    r = lambda n, a: F.round(n, 6).alias(a)
    return s.select(
        "sid", "frame_index", "ball_available", r("ball_hand_dist_norm", "hand_dist"), r("ball_vertical_velocity_norm", "velocity"),
        r("knee_angle_deg", "knee"), r("shoulder_y", "shoulder_y"), r("hip_x_norm", "hip_x"),
    )


# One step of the segmentation per row and session: ``rws`` are the look-back rows after the last
# attempt, ``bent`` is their knee dip and hip range test, ``why`` tells how an attempt was closed.
PREDICATES_SQL = """sr0 AS (SELECT sid, f, i, av, near, burst, burst AND high AS rising, off AND high AS apart, observed, knee, hip FROM (SELECT sid, frame_index AS f, row_number() OVER (PARTITION BY sid ORDER BY frame_index) AS i,
  ball_available AS av, coalesce(ball_available AND dist <= 0.18, false) AS near, coalesce(ball_available AND v <= -0.35, false) AS burst, coalesce(ball_y <= shoulder_y, true) AS high, coalesce(ball_available AND dist > 0.18, false) AS off, observed, knee, hip FROM signals))"""
SEGMENT_SQL = """sr AS (SELECT *, i >= 3 AND bool_and(rising) OVER w3 AND bool_or(observed) OVER w3 AS lifted, lag(f, 2) OVER w AS f2,
  list({'f': f, 'i': i, 'k': knee, 'h': hip}) OVER (w ROWS BETWEEN 44 PRECEDING AND CURRENT ROW) AS la, list({'f': f, 'i': i, 'k': knee, 'h': hip}) OVER (w ROWS BETWEEN 47 PRECEDING AND 3 PRECEDING) AS lb
  FROM sr0 WINDOW w AS (PARTITION BY sid ORDER BY i), w3 AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
sm AS (SELECT DISTINCT sid, 0::BIGINT AS i, NULL::BIGINT AS f, 'idle' AS ph0, 'idle' AS ph, NULL::BIGINT AS le, NULL::BIGINT AS hold, 0::BIGINT AS fb, NULL::BIGINT AS ld, NULL::BIGINT AS up, NULL::BIGINT AS bg, NULL::BIGINT AS rel,
   0::BIGINT AS sep, 0::BIGINT AS st, 0::BIGINT AS gone, false AS inf, NULL::VARCHAR AS why FROM sr0
 UNION ALL SELECT sid, i, f, ph, nph, CASE WHEN why IS NOT NULL THEN f ELSE le END, CASE WHEN why IN ('dropout', 'long') THEN f + 90 ELSE hold END,
   CASE WHEN ph = 'idle' THEN CASE WHEN cool THEN fb WHEN nph = 'load' OR held THEN 0 ELSE fb1 END WHEN nph = 'idle' THEN 0 ELSE fb END,
   CASE WHEN nph = 'idle' THEN NULL WHEN ph = 'idle' THEN CASE WHEN nph = 'load' THEN f ELSE coalesce(dip_f, f2) END ELSE ld END,
   CASE WHEN nph = 'idle' THEN NULL WHEN nph = 'upward' AND ph = 'idle' THEN f2 WHEN nph = 'upward' AND ph = 'load' THEN f ELSE up END,
   CASE WHEN nph = 'idle' THEN NULL WHEN ph = 'idle' THEN CASE WHEN nph = 'load' THEN f ELSE coalesce(dip_f, f2) END ELSE bg END,
   CASE WHEN nph = 'idle' THEN NULL WHEN ph = 'upward' AND nph = 'flight' THEN greatest(f - 1, up) ELSE rel END,
   CASE WHEN nph = 'idle' OR ph = 'idle' THEN 0 WHEN ph = 'upward' THEN sep1 ELSE sep END, CASE WHEN ph = 'flight' AND nph = 'flight' THEN st1 ELSE 0 END, CASE WHEN ph = 'flight' AND nph = 'flight' THEN gone1 ELSE 0 END,
   CASE WHEN nph = 'idle' THEN false WHEN ph = 'idle' THEN nph = 'upward' ELSE inf END, why FROM
 (SELECT *, CASE ph WHEN 'idle' THEN CASE WHEN cool THEN 'idle' WHEN near AND knee IS NOT NULL THEN 'load' WHEN held OR fb1 < 3 OR NOT lifted OR NOT bent THEN 'idle' ELSE 'upward' END
    WHEN 'load' THEN CASE WHEN burst AND bent THEN 'upward' WHEN NOT near OR f - bg > 300 THEN 'idle' ELSE 'load' END
    WHEN 'upward' THEN CASE WHEN f - bg > 300 THEN 'idle' WHEN sep1 >= 2 THEN 'flight' ELSE 'upward' END ELSE CASE WHEN why IS NULL THEN 'flight' ELSE 'idle' END END AS nph FROM
 (SELECT *, (hips IS NULL OR hips <= 4) AND (low IS NULL OR coalesce(list_max(list_transform(list_filter(kn, lambda r: r.i < dip.i), lambda r: r.k)) - low >= 12, false)) AS bent, dip.f AS dip_f,
   CASE WHEN ph = 'flight' THEN CASE WHEN st1 >= 5 THEN 'settled' WHEN gone1 >= 45 THEN 'dropout' WHEN f - rel > 150 THEN 'long' END END AS why FROM
 (SELECT *, list_filter(kn, lambda r: r.k = low)[1] AS dip FROM
 (SELECT *, list_min(list_transform(kn, lambda r: r.k)) AS low FROM
 (SELECT *, list_filter(rws, lambda r: r.k IS NOT NULL) AS kn, list_max(list_transform(rws, lambda r: r.h)) - list_min(list_transform(rws, lambda r: r.h)) AS hips FROM
 (SELECT p.*, q.ph, q.le, q.hold, q.fb, q.ld, q.up, q.bg, q.rel, q.sep, q.st, q.gone, q.inf, coalesce(p.f - q.le < 10, false) AS cool, coalesce(p.f < q.hold, false) AS held, CASE WHEN p.rising THEN q.fb + 1 ELSE 0 END AS fb1,
   CASE WHEN p.av THEN CASE WHEN p.apart THEN q.sep + 1 ELSE 0 END WHEN q.sep > 0 THEN q.sep + 1 ELSE 0 END AS sep1, CASE WHEN p.near THEN q.st + 1 ELSE 0 END AS st1, CASE WHEN p.av THEN 0 ELSE q.gone + 1 END AS gone1,
   list_filter(CASE WHEN q.ph = 'load' THEN p.la ELSE p.lb END, lambda r: r.f > coalesce(q.le, -1)) AS rws FROM sm q JOIN sr p ON p.sid = q.sid AND p.i = q.i + 1)))))))"""
SHORT = "CASE WHEN f - rel < 6 THEN ['short_duration'] ELSE [] END"
CLOSED_SQL = f"""prior AS (SELECT sid, i, f, why, lag(bg) OVER w AS bg, lag(ld) OVER w AS ld, lag(up) OVER w AS up, lag(rel) OVER w AS rel, lag(inf) OVER w AS inf FROM sm WINDOW w AS (PARTITION BY sid ORDER BY i)),
closed AS (SELECT sid, f, bg, ld, up, rel, inf, CASE why WHEN 'settled' THEN {SHORT} WHEN 'dropout' THEN list_concat(['closed_after_prolonged_ball_tracking_dropout'], {SHORT}) ELSE ['max_duration_exceeded'] END AS tags FROM prior WHERE why IS NOT NULL
 UNION ALL SELECT sid, f, bg, ld, up, rel, inf, ['video_ended_during_flight'] FROM (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY sid ORDER BY i DESC) = 1) WHERE ph = 'flight')"""


@query("EPI04", with_(FRAMES_SQL, SIGNALS_SQL, PREDICATES_SQL, SEGMENT_SQL, CLOSED_SQL, recursive=True) + """SELECT sid, bg AS start_frame, f AS end_frame, ld AS load_start_frame, up AS upward_start_frame, rel AS release_candidate_frame, f AS flight_end_frame,
 CASE WHEN inf THEN list_append(tags, 'load_phase_inferred_from_pose_only_ball_not_tracked_near_hand') ELSE tags END AS warnings, row_number() OVER (PARTITION BY sid ORDER BY bg) AS shot_index FROM closed""")
def segment(spark, sf):
    return segment_shots(signals(spark, sf, True))


@query("EPI23", with_(FRAMES_SQL, SIGNALS_SQL, PREDICATES_SQL, SEGMENT_SQL, recursive=True) + """SELECT sid, f AS frame_index, ph0 AS phase_before, ph AS phase_after, fb AS fallback_run, sep AS separation_run, st AS settled_run, gone AS missing_run FROM sm WHERE i > 0""")
def trace(spark, sf):
    return segment_trace(signals(spark, sf, True))


@query("EPI05", with_(FRAMES_SQL, SIGNALS_SQL, ATTEMPTS_SQL) + """, w AS (SELECT a.*, s.frame_index AS f, s.dist, s.v, s.timestamp_sec AS t FROM attempts a JOIN signals s ON s.sid = a.sid AND s.frame_index BETWEEN greatest(start_frame, release_frame - 8) AND least(end_frame, release_frame + 8)),
b AS (SELECT sid, shot_index, any_value(start_frame) AS sf, any_value(end_frame) AS ef, min(f) FILTER (dist >= 0.22 AND v <= -0.15) AS clear, max(release_frame) FILTER (f = release_frame) AS cand FROM w GROUP BY ALL)
SELECT b.sid, b.shot_index, w.f AS release_frame, round(w.t, 4) AS release_time_sec, greatest(sf, w.f - 2) AS window_start_frame, least(ef, w.f + 2) AS window_end_frame,
 round(0.4 + CASE WHEN clear IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN coalesce(w.v <= -0.15, false) THEN 0.15 ELSE 0 END, 3)::DOUBLE AS release_confidence,
 CASE WHEN clear IS NOT NULL THEN 'hand_ball_separation,upward_velocity' WHEN coalesce(w.v <= -0.15, false) THEN 'upward_velocity' ELSE 'state_machine_candidate_only' END AS basis
FROM b JOIN w ON w.sid = b.sid AND w.shot_index = b.shot_index AND w.f = coalesce(clear, cand)""")
def refine(spark, sf):
    a = attempts(spark, sf).withColumnRenamed("release_frame", "release_candidate_frame")
    return rl.refine_release(a, signals(spark, sf)).drop("elbow_deg").withColumn("release_time_sec", F.round("release_time_sec", 4))


def _pairs_sql() -> str:
    return f"""tr AS (SELECT t.sid, t.frame_index AS f, t.timestamp_sec AS t, t.x, t.y, s.lx, s.ly, s.rx, s.ry, sqrt(pow(t.x - s.lx, 2) + pow(t.y - s.ly, 2)) / {TORSO_PX} AS dl, sqrt(pow(t.x - s.rx, 2) + pow(t.y - s.ry, 2)) / {TORSO_PX} AS dr,
  row_number() OVER (PARTITION BY t.sid ORDER BY t.frame_index) AS i FROM trusted t JOIN signals s ON s.sid = t.sid AND s.frame_index = t.frame_index),
pr0 AS (SELECT *, lag(t) OVER w AS t0, lag(y) OVER w AS y0, lag(ly) OVER w AS ly0, lag(ry) OVER w AS ry0, least(dl, dr) AS sep, dr IS NULL OR dl <= dr AS by_left FROM tr WINDOW w AS (PARTITION BY sid ORDER BY i)),
pr1 AS (SELECT *, coalesce(t - t0 > 1e-6 AND t - t0 <= 0.15, false) AS linked, sep > 0.18 AS apart, ry IS NOT NULL AND y < least(ly, ry) AS above FROM pr0),
pr2 AS (SELECT *, CASE WHEN linked THEN (y - y0) / (t - t0) / {TORSO_PX} END AS v, CASE WHEN linked THEN abs((y - y0) / (t - t0) / {TORSO_PX} - CASE WHEN by_left THEN ly - ly0 ELSE ry - ry0 END / (t - t0) / {TORSO_PX}) END AS rel FROM pr1),
pr AS (SELECT *, coalesce(NOT apart AND rel <= 0.175, false) AS ctrl, CASE WHEN v <= -0.35 THEN CASE WHEN apart THEN 'strong' END WHEN apart AND above AND v <= -0.21 THEN 'soft' END AS path,
  coalesce(v <= -0.35, false) AS strong, coalesce(v <= -0.35 AND NOT apart, false) AS veto, coalesce(v <= 0, false) AS flat FROM pr2)"""


PAIRS_SQL = _pairs_sql()
SEP = "CASE WHEN {s} IS NULL THEN NULL ELSE round({s}, 3) END"
CTRL_SQL = """ct AS (SELECT sid, i, 'uncontrolled' AS st, 0 AS n, 0 AS veto_n, NULL::BIGINT AS rf, NULL::DOUBLE AS rt, NULL::VARCHAR AS rp, NULL::DOUBLE AS rs, false AS emit FROM pr WHERE i = 1
 UNION ALL SELECT sid, i, nst, CASE WHEN nst = 'separating' THEN CASE WHEN opened THEN 1 ELSE n + 1 END ELSE 0 END, nv,
   CASE WHEN opened THEN f ELSE rf END, CASE WHEN opened THEN t ELSE rt END, CASE WHEN opened THEN CASE WHEN path IS NULL THEN 'strong_override' ELSE path END ELSE rp END, CASE WHEN opened THEN sep ELSE rs END, emit FROM
 (SELECT *, (st IN ('controlled','transition') AND nst = 'separating') OR (st = 'separating' AND n = 0 AND nst = 'separating') AS opened FROM (SELECT p.*, c.st, c.n, c.rf, c.rt, c.rp, c.rs,
   coalesce(p.linked AND c.st = 'separating' AND go AND c.n + 1 >= 3, false) AS emit,
   CASE WHEN NOT p.linked THEN 'uncontrolled' WHEN c.st = 'uncontrolled' THEN CASE WHEN ctrl THEN 'controlled' ELSE 'uncontrolled' END
    WHEN c.st = 'controlled' THEN CASE WHEN ctrl THEN 'controlled' WHEN path IS NOT NULL THEN 'separating' WHEN flat THEN 'transition' ELSE 'uncontrolled' END
    WHEN c.st = 'transition' THEN CASE WHEN ctrl THEN 'controlled' WHEN path IS NOT NULL THEN 'separating' WHEN p.veto THEN CASE WHEN c.veto_n + 1 >= 8 THEN 'separating' ELSE 'transition' END WHEN flat THEN 'transition' ELSE 'uncontrolled' END
    ELSE CASE WHEN go THEN CASE WHEN c.n + 1 >= 3 THEN 'uncontrolled' ELSE 'separating' END WHEN ctrl THEN 'controlled' WHEN flat THEN 'transition' ELSE 'uncontrolled' END END AS nst,
   CASE WHEN NOT p.linked THEN 0 WHEN c.st = 'controlled' AND NOT ctrl AND path IS NULL AND flat THEN CASE WHEN p.veto THEN 1 ELSE 0 END
    WHEN c.st = 'transition' AND NOT ctrl AND path IS NULL AND p.veto AND c.veto_n + 1 < 8 THEN c.veto_n + 1 WHEN c.st = 'transition' AND NOT ctrl AND path IS NULL AND NOT p.veto AND flat THEN c.veto_n ELSE 0 END AS nv
   FROM (SELECT p.*, CASE WHEN c.n > 0 AND c.rp = 'strong_override' THEN strong ELSE path IS NOT NULL END AS go FROM ct c JOIN pr p ON p.sid = c.sid AND p.i = c.i + 1) p JOIN ct c ON c.sid = p.sid AND c.i = p.i - 1)))"""


@query("EPI06", with_(FRAMES_SQL, SIGNALS_SQL, TRUSTED_S, PAIRS_SQL, CTRL_SQL, recursive=True) + f"""SELECT sid, rf AS release_frame, round(rt, 4) AS release_time_sec,
 CASE rp WHEN 'strong' THEN 0.75 WHEN 'soft' THEN 0.6 ELSE 0.55 END::DOUBLE AS confidence, rp AS path, 3::BIGINT AS consecutive, round(rs, 3) AS separation_norm FROM ct WHERE emit""")
def release_events(spark, sf):
    out = rl.release_events(signals(spark, sf, True), F.lit(TORSO_PX))
    return out.withColumn("release_time_sec", F.round("release_time_sec", 4))


POSS_SQL = """ps AS (SELECT sid, i, 'uncontrolled' AS st, 0 AS n, NULL::DOUBLE AS last, NULL::BIGINT AS rf, NULL::DOUBLE AS rt, NULL::VARCHAR AS rp, NULL::DOUBLE AS rs, false AS emit FROM pr WHERE i = 1
 UNION ALL SELECT sid, i, nst, CASE WHEN nst <> 'separated' THEN 0 WHEN path IS NULL THEN 0 ELSE CASE WHEN st = 'possession' THEN 1 ELSE n + 1 END END,
  CASE WHEN nst = 'approaching' THEN rel END, CASE WHEN nst = 'separated' AND (st = 'possession' OR n = 0) THEN f ELSE rf END, CASE WHEN nst = 'separated' AND (st = 'possession' OR n = 0) THEN t ELSE rt END,
  CASE WHEN nst = 'separated' AND (st = 'possession' OR n = 0) THEN path ELSE rp END, CASE WHEN nst = 'separated' AND (st = 'possession' OR n = 0) THEN sep ELSE rs END, emit FROM
 (SELECT p.*, c.st, c.n, c.rf, c.rt, c.rp, c.rs, coalesce(linked AND c.st = 'separated' AND path IS NOT NULL AND c.n + 1 >= 3, false) AS emit,
  CASE WHEN NOT linked THEN 'uncontrolled' WHEN c.st = 'uncontrolled' THEN CASE WHEN NOT apart THEN 'approaching' ELSE 'uncontrolled' END
   WHEN c.st = 'approaching' THEN CASE WHEN apart THEN 'uncontrolled' WHEN rel >= c.last THEN 'possession' ELSE 'approaching' END
   WHEN c.st = 'possession' THEN CASE WHEN NOT apart THEN 'possession' ELSE 'separated' END
   WHEN path IS NOT NULL THEN CASE WHEN c.n + 1 >= 3 THEN 'uncontrolled' ELSE 'separated' END WHEN NOT apart THEN 'approaching' ELSE 'uncontrolled' END AS nst
  FROM ps c JOIN pr p ON p.sid = c.sid AND p.i = c.i + 1))"""


@query("EPI07", with_(FRAMES_SQL, SIGNALS_SQL, TRUSTED_S, PAIRS_SQL, POSS_SQL, recursive=True) + """SELECT sid, rf AS release_frame, round(rt, 4) AS release_time_sec,
 CASE rp WHEN 'strong' THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence, rp AS path, 3::BIGINT AS consecutive, round(rs, 3) AS separation_norm FROM ps WHERE emit""")
def possession_releases(spark, sf):
    out = rl.possession_releases(signals(spark, sf, True), F.lit(TORSO_PX))
    return out.withColumn("release_time_sec", F.round("release_time_sec", 4))


# A row's ``ends`` closes the rise that the row before it followed; ``lag`` then reads that rise.
RISE_SQL = """tj AS (SELECT sid, i, 0 AS n, 0 AS v, false AS o, false AS rise, 0 AS rn, NULL::BIGINT AS af, NULL::DOUBLE AS at_, NULL::DOUBLE AS ay, NULL::VARCHAR AS ap, NULL::BIGINT AS xf, NULL::DOUBLE AS xt, NULL::DOUBLE AS xy, false AS ends, NULL::BIGINT AS df FROM pr WHERE i = 1
 UNION ALL SELECT sid, i, CASE WHEN goes OR arms THEN 0 ELSE nn END, CASE WHEN goes OR arms THEN 0 ELSE nv END, NOT goes AND NOT arms AND no, goes OR arms, CASE WHEN goes THEN rn + 1 WHEN arms THEN 3 ELSE 0 END,
  CASE WHEN NOT goes AND nn = 1 THEN f ELSE af END, CASE WHEN NOT goes AND nn = 1 THEN t ELSE at_ END, CASE WHEN NOT goes AND nn = 1 THEN y ELSE ay END, CASE WHEN NOT goes AND nn = 1 THEN how ELSE ap END, f, t, y, rise AND NOT goes,
  CASE WHEN rise AND NOT goes AND t - xt > 1e-6 AND t - xt <= 0.15 AND y > xy THEN f END FROM
 (SELECT *, NOT goes AND nn >= 3 AS arms FROM (SELECT *, CASE WHEN NOT linked OR how IS NULL THEN 0 ELSE n + 1 END AS nn, linked AND how IS NOT NULL AND (o OR how = 'strong_veto_override') AS no,
   CASE WHEN NOT linked THEN 0 WHEN o THEN v WHEN NOT strong OR NOT veto OR v + 1 >= 8 THEN 0 ELSE v + 1 END AS nv FROM
  (SELECT p.sid, p.i, p.f, p.t, p.y, p.linked, p.strong, p.veto, q.n, q.v, q.o, q.rise, q.rn, q.af, q.at_, q.ay, q.ap, q.xt, q.xy, q.rise AND p.linked AND p.y < q.xy AS goes,
    CASE WHEN q.o THEN CASE WHEN p.strong THEN 'strong_veto_override' END WHEN NOT p.strong THEN CASE WHEN p.path = 'soft' THEN 'soft' END WHEN p.veto THEN CASE WHEN q.v + 1 >= 8 THEN 'strong_veto_override' END ELSE 'strong' END AS how
   FROM tj q JOIN pr p ON p.sid = q.sid AND p.i = q.i + 1)))),
rises AS (SELECT sid, ends, df, lag(af) OVER w AS af, lag(at_) OVER w AS at_, lag(ay) OVER w AS ay, lag(ap) OVER w AS ap, lag(xf) OVER w AS xf, lag(xt) OVER w AS xt, lag(xy) OVER w AS xy, lag(rn) OVER w AS rn FROM tj WINDOW w AS (PARTITION BY sid ORDER BY i)),
found AS (SELECT * EXCLUDE (ends) FROM rises WHERE ends UNION ALL SELECT sid, NULL, af, at_, ay, ap, xf, xt, xy, rn FROM tj WHERE rise QUALIFY row_number() OVER (PARTITION BY sid ORDER BY i DESC) = 1 AND i = (SELECT max(i) FROM pr WHERE pr.sid = tj.sid))"""


@query("EPI08", with_(FRAMES_SQL, SIGNALS_SQL, TRUSTED_S, PAIRS_SQL, RISE_SQL, recursive=True) + f"""SELECT sid, af AS arm_frame, at_ AS arm_time_sec, ap AS arm_path, rn >= 6 AND df IS NOT NULL AS confirmed,
 CASE WHEN rn < 6 THEN 'rise_phase_too_short' WHEN df IS NULL THEN 'no_descent_observed' END AS discard_reason, xf AS apex_frame, xt AS apex_time_sec, rn::BIGINT AS rise_steps, df AS descent_frame, round((ay - xy) / {TORSO_PX}, 3) AS height_gained_norm FROM found""")
def trajectory_shots(spark, sf):
    return rl.trajectory_shots(signals(spark, sf, True), F.lit(TORSO_PX))


CORR_SQL = f"""tp AS (SELECT *, lag(timestamp_sec) OVER ({_P}) AS pt FROM trusted),
tc AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND NOT (timestamp_sec - pt > 1e-6 AND timestamp_sec - pt <= 0.15) THEN 1 ELSE 0 END) OVER ({_P}) AS ch FROM tp),
td AS (SELECT tc.sid, tc.frame_index, ch, min(least(sqrt(pow(tc.x - lx, 2) + pow(tc.y - ly, 2)), sqrt(pow(tc.x - rx, 2) + pow(tc.y - ry, 2))) / {TORSO_PX}) OVER (PARTITION BY tc.sid ORDER BY tc.frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS pose, tc.x, tc.y
  FROM tc JOIN signals s ON s.sid = tc.sid AND s.frame_index = tc.frame_index),
cr AS (SELECT a.sid, a.frame_index AS arm_frame, a.pose, hc.hoop_conf, (SELECT min(sqrt(pow(b.x - hoop_x, 2) + pow(b.y - hoop_y, 2)) / hoop_r) FROM td b WHERE b.sid = a.sid AND b.ch = a.ch AND b.frame_index BETWEEN a.frame_index AND a.frame_index + 150) AS d
  FROM td a JOIN hoops hc USING (sid))"""


@query("EPI09", with_(FRAMES_SQL, SIGNALS_SQL, TRUSTED_S, HOOPS_SQL, CORR_SQL) + """SELECT sid, arm_frame, CASE WHEN hoop_conf < 0.3 THEN 'no_hoop_location' WHEN d <= 3 THEN 'hoop_corroborated' ELSE 'no_hoop_evidence' END AS hoop_tier,
 CASE WHEN hoop_conf >= 0.3 THEN round(d, 2) END AS min_distance_rim_radii, CASE WHEN pose IS NULL THEN 'no_pose_data' WHEN pose <= 0.18 THEN 'pose_corroborated' ELSE 'no_pose_evidence' END AS pose_tier, round(pose, 3) AS min_distance_norm,
 CASE WHEN hoop_conf < 0.3 OR d > 3 THEN 'low' WHEN pose > 0.18 THEN 'medium' ELSE 'high' END AS tier FROM cr""")
def corroborate(spark, sf):
    from kinetable.catalog.base import FRAME_SERIES
    from kinetable.operators.windows import trusted

    s = signals(spark, sf, True)
    seen = stage(trusted(s, FRAME_SERIES))
    armed = seen.select("sid", c("frame_index").alias("arm_frame"))
    return rl.corroborate(armed, s, hoops(spark, sf), F.lit(TORSO_PX), seen=seen)


@query("EPI10")
def recover(spark, sf):
    """Greedy chain with a pruned fit; tests check it on planted flights."""
    f = stage(frames(spark, sf))
    cands = f.filter("source IN ('predicted', 'unavailable')").select("sid", "frame_index", "timestamp_sec", "x", "y", "radius", "confidence", c("event_id").alias("cand_id"))
    return recover_points(attempts(spark, sf, f), f, cands, hoops(spark, sf))


#: Vectors as 8 x 8 images of 16-bit gray values.
GRAY_SQL = "list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 20000))"


def gray_frames(spark, sf):
    """Frames of every session, written as images to a frame store and decoded from it."""
    p = poses(spark, sf).select("sid", "frame_index", "timestamp_sec", "vec_id")
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 20000).cast("int")).alias("gray"), F.lit(8).alias("width"))
    rows = stage(p.join(e, "vec_id"))
    path = scratch_folder(spark, "frames")
    images.write_frames(rows, path)
    decoded = images.read_frames(spark, path)
    return decoded.join(rows.select("sid", "frame_index", "vec_id"), ["sid", "frame_index"])


@query("SRC06", with_(POSES_SQL) + f"""SELECT p.sid, p.frame_index, 8::INTEGER AS width, 8::INTEGER AS height, true AS valid, round(list_sum({GRAY_SQL}) / 64, 6) AS mean_gray, list_max({GRAY_SQL}) AS brightest
FROM poses p JOIN (SELECT vec_id, embedding FROM embeddings) e USING (vec_id)""")
def frame_pixels(spark, sf):
    """Every frame's image, decoded from the store."""
    mean = F.round(F.aggregate("gray", F.lit(0.0), lambda a, v: a + v) / F.size("gray"), 6)
    return gray_frames(spark, sf).select("sid", "frame_index", "width", "height", "valid", mean.alias("mean_gray"), F.array_max("gray").alias("brightest"))


ROI_SQL = f"""g AS (SELECT p.sid, p.frame_index, vec_id, {GRAY_SQL} AS g FROM poses p JOIN embeddings USING (vec_id)),
pairs AS (SELECT sid, frame_index, vec_id, unnest(range(0, 64)) AS i, unnest(g) AS a, unnest(lag(g) OVER w) AS b, CASE WHEN vec_id % 3 = 0 THEN vec_id WHEN lag(vec_id) OVER w % 3 = 0 THEN lag(vec_id) OVER w END AS ball,
  CASE WHEN vec_id % 4 = 0 THEN true ELSE lag(vec_id) OVER w % 4 = 0 END AS person, lag(g) OVER w IS NOT NULL AS has FROM g WINDOW w AS (PARTITION BY sid ORDER BY frame_index)),
px AS (SELECT *, i % 8 AS x, i // 8 AS y, abs(a - b) AS d FROM pairs WHERE has),
kept AS (SELECT *, NOT coalesce(pow(x - ball % 8, 2) + pow(y - 4, 2) <= 1, false) AND NOT (person AND x BETWEEN 0 AND 1 AND y BETWEEN 5 AND 7) AS keep FROM px),
m AS (SELECT sid, frame_index, any_value(ball) AS ball, any_value(person) AS person, coalesce(avg(d) FILTER (keep AND x >= 3 AND x < 5 AND y >= 2 AND y < 6), 0) AS tm,
  (coalesce(avg(d) FILTER (keep AND x >= 0 AND x < 2 AND y >= 2 AND y < 6), 0) + coalesce(avg(d) FILTER (keep AND x >= 6 AND x < 8 AND y >= 2 AND y < 6), 0)) / 2 AS cm FROM kept GROUP BY ALL)"""


@query("EPI14", with_(POSES_SQL, ROI_SQL) + """SELECT sid, frame_index, round(tm, 4) AS target_motion, round(cm, 4) AS control_motion, round(tm / greatest(cm, 1e-6), 4) AS relative_motion, person AS mask_available,
 CASE WHEN ball IS NULL THEN 'none' ELSE 'detected' END AS mask_source FROM m""")
def roi(spark, sf):
    box = lambda *v: [F.lit(i) for i in v]
    ball = F.when(F.pmod("vec_id", F.lit(3)) == 0, F.struct(F.pmod("vec_id", F.lit(8)).alias("x"), F.lit(4).alias("y"), F.lit(1.0).alias("r"), F.lit("detected").alias("source")))
    person = F.when(F.pmod("vec_id", F.lit(4)) == 0, F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0, 5, 1, 7))]))
    return roi_motion(gray_frames(spark, sf), Series.frames(["sid"]), "gray", 8, box(3, 2, 5, 6), [box(0, 2, 2, 6), box(6, 2, 8, 6)], ball, person)


def pose_attempts(spark, sf):
    p = poses(spark, sf)
    return p.groupBy("sid", F.floor(c("frame_index") / 12).alias("shot_index")).agg(
        F.min("frame_index").alias("load_start_frame"), (F.min("frame_index") + 3).alias("upward_start_frame"), (F.min("frame_index") + 6).alias("release_frame"), F.lit("left").alias("shooting_side")
    )


ARM = "least(left_shoulder_v, left_elbow_v, left_wrist_v) >= 0.4"
_SM = "((left_shoulder_x + right_shoulder_x) / 2)", "((left_shoulder_y + right_shoulder_y) / 2)"
_HM = "((left_hip_x + right_hip_x) / 2)", "((left_hip_y + right_hip_y) / 2)"
MECH_SQL = f"""wa AS (SELECT sid, frame_index // 12 AS shot_index, min(frame_index) AS lo FROM poses GROUP BY ALL),
mf AS (SELECT w.sid, w.shot_index, w.lo, frame_index AS f, timestamp_sec AS t, detected, {'(' + ' + '.join(f'{s}_{j}_v' for j in ('shoulder', 'elbow', 'wrist', 'hip', 'knee') for s in ('left', 'right')) + ') / 10'} AS conf,
  CASE WHEN {L} THEN {KNEE['left']} END AS knee, CASE WHEN {ARM} THEN {angle_sql('left_shoulder', 'left_elbow', 'left_wrist')} END AS elbow, CASE WHEN {TORSO} THEN degrees(atan2({_SM[0]} - {_HM[0]}, {_HM[1]} - {_SM[1]})) END AS lean,
  CASE WHEN {TORSO} AND {ARM} THEN ({_HM[1]} - left_wrist_y) / sqrt(pow({_SM[0]} - {_HM[0]}, 2) + pow({_SM[1]} - {_HM[1]}, 2)) END AS height FROM wa w JOIN poses p ON p.sid = w.sid AND frame_index BETWEEN lo AND lo + 6),
mg AS (SELECT sid, shot_index, lo, round(avg(conf) FILTER (detected), 3) AS q, count(*) FILTER (detected) AS nd, min(f) FILTER (detected AND knee = mk) AS lf, max(t) FILTER (f = lo) AS tl, max(t) FILTER (f = lo + 3) AS tu, max(t) FILTER (f = lo + 6) AS tr
  FROM (SELECT *, min(knee) FILTER (detected) OVER (PARTITION BY sid, shot_index) AS mk FROM mf) GROUP BY ALL)"""


@query("EPI15", with_(POSES_SQL, MECH_SQL) + """SELECT g.sid, g.shot_index, coalesce(q, 0.0) AS pose_quality, lf AS load_frame, round(d.knee, 1) AS knee_load, round(d.elbow, 1) AS elbow_load, round(d.lean, 1) AS lean_load,
 CASE WHEN nd > 0 AND r.detected THEN round(r.knee, 1) END AS knee_release, CASE WHEN nd > 0 AND r.detected THEN round(r.elbow, 1) END AS elbow_release, CASE WHEN nd > 0 AND r.detected THEN round(r.height, 3) END AS height,
 CASE WHEN nd > 0 THEN round(tu - tl, 3) END AS load_sec, CASE WHEN nd > 0 THEN round(tr - tl, 3) END AS total_sec FROM mg g LEFT JOIN mf d ON d.sid = g.sid AND d.shot_index = g.shot_index AND d.f = g.lf LEFT JOIN mf r ON r.sid = g.sid AND r.shot_index = g.shot_index AND r.f = g.lo + 6""")
def mechanics_rows(spark, sf):
    m = mechanics(poses(spark, sf), pose_attempts(spark, sf))
    names = dict(zip(FIELDS, ("knee_load", "knee_release", "elbow_load", "elbow_release", "lean_load", None, "height", None, "load_sec", None, "total_sec")))
    return m.select("sid", "shot_index", "pose_quality", "load_frame", *[c(f"mechanics.{f}").alias(a) for f, a in names.items() if a])


WIDTH, HEIGHT = 100.0, 500.0


def session_inputs(spark, sf):
    """Detections and poses as a detector would give them: the object rests at a wrist for six frames, then rises
    away from it; frames whose event is no sighting have none, some get one from the second search."""
    step, n = F.pmod("frame_index", F.lit(12)), F.pmod("event_id", F.lit(7)).cast("double")
    height = F.lit(60.0) - F.when(step >= 6, F.lit(7.0) * (step - 5)).otherwise(F.lit(0.0)) + c("y") / 40
    f = stage(frames(spark, sf).withColumns({"x": c("x") / 4, "y": height, "n": n, "held": step < 6}))
    seen = f.select("sid", "frame_index", "timestamp_sec", c("event_id").alias("id"), "x", "y", "radius", "confidence", "source")
    wrist = F.when(c("held"), c("n")).otherwise(F.lit(150.0))
    bend = F.radians(F.pmod(c("event_id") * 13, F.lit(60)).cast("double"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"), F.lit(0.9).alias("visibility"))
    hip = c("n") / 100
    joints = {"nose": (F.lit(0.5), F.lit(0.05))}
    for side, off in (("left", 0.0), ("right", 0.9)):
        joints[f"{side}_shoulder"] = (F.lit(0.3 + off / 9), F.lit(0.116))
        joints[f"{side}_elbow"] = (F.lit(0.25 + off), F.lit(0.15))
        joints[f"{side}_wrist"] = ((c("x") + wrist) / WIDTH + off, (c("y") + wrist) / HEIGHT)
        joints[f"{side}_hip"] = (F.lit(0.3 + off / 9) + hip, F.lit(0.9))
        joints[f"{side}_knee"] = (F.lit(0.3 + off / 9) + hip, F.lit(1.1))
        joints[f"{side}_ankle"] = (F.lit(0.3 + off / 9) + hip + F.sin(bend) / 5, F.lit(1.1) + F.cos(bend) / 5)
    pose = f.select("sid", "frame_index", "timestamp_sec", (F.pmod("event_id", F.lit(11)) != 0).alias("detected"), F.struct(*[at(x, y).alias(j) for j, (x, y) in joints.items()]).alias("joints"))
    goal = f.filter(F.pmod("event_id", F.lit(5)) == 0).select(
        "sid", "frame_index", c("event_id").alias("id"), (F.lit(50.0) + F.pmod("event_id", F.lit(9))).alias("x"), (F.lit(30.0) + F.pmod("event_id", F.lit(11))).alias("y"),
        F.lit(12.0).alias("radius"), "confidence", c("source"),
    )
    sightings = seen.filter("source IN ('detected', 'interpolated')").drop("source")
    return sp.Inputs(f.select("sid", "frame_index", "timestamp_sec"), sightings, pose, goal, WIDTH, HEIGHT, gaps=seen.filter("source = 'predicted'").drop("source"))


@query("EPI16")
def attempt_records(spark, sf):
    """Attempt records with the recovered points merged into their flights."""
    return sp.run_sessions(session_inputs(spark, sf)).shots


@query("EPI19")
def session_reports(spark, sf):
    """Every report table of a session as one row, from detections and poses on."""
    given = session_inputs(spark, sf)
    return sp.session_report(sp.run_sessions(given), given.frames)

"""Registered join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.base import (
    FRAME_SERIES, FRAMES_SQL, POSES_SQL, SIGNALS_SQL, frames, poses, query, shots, signals, table, with_,
)
from kinetable.catalog.aggregates import COACH
from kinetable.operators import joins as jn
from kinetable.operators.ordered import dim_join
from kinetable.operators.topk import best_row

c = F.col
DAY_SECONDS = 86400


@query("JON01", with_(FRAMES_SQL, POSES_SQL) + "SELECT p.sid, p.frame_index, p.detected, f.source FROM poses p JOIN frames f USING (sid, frame_index)")
def align(spark, sf):
    return jn.align(poses(spark, sf), frames(spark, sf).drop("timestamp_sec")).select("sid", "frame_index", "detected", "source")


def order_windows(spark, sf, span=3):
    o = table(spark, sf, "orders")
    return o.select(c("o_custkey").alias("sid"), c("o_orderkey").alias("shot_index"), F.dayofmonth("o_orderdate").cast("long").alias("lo"), (F.dayofmonth("o_orderdate") + span).cast("long").alias("hi"))


def day_points(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(c("user_id").alias("sid"), F.dayofmonth("ts").cast("long").alias("frame_index"), "event_id", "event_type", "value")


WINDOWS_SQL = "windows AS (SELECT o_custkey AS sid, o_orderkey AS shot_index, day(o_orderdate)::BIGINT AS lo, (day(o_orderdate) + 3)::BIGINT AS hi FROM orders)"
DAYS_SQL = "days AS (SELECT user_id AS sid, day(ts)::BIGINT AS frame_index, event_id, event_type, value FROM events)"


@query("JON02", with_(WINDOWS_SQL, DAYS_SQL) + "SELECT d.sid, shot_index, event_id, frame_index FROM days d JOIN windows w ON d.sid = w.sid AND frame_index BETWEEN lo AND hi")
def points_in_shots(spark, sf):
    out = jn.interval_join(day_points(spark, sf), order_windows(spark, sf), ["sid"], "frame_index", "lo", "hi", block=8)
    return out.select("sid", "shot_index", "event_id", "frame_index")


ATTEMPTS_SQL = "attempts AS (SELECT sid, frame_index // 12 AS shot_index, min(frame_index) AS start_frame, max(frame_index) AS end_frame, min(frame_index) + 5 AS release_frame FROM frames GROUP BY ALL)"


def attempts(spark, sf, f=None):
    f = frames(spark, sf) if f is None else f
    return f.groupBy("sid", F.floor(c("frame_index") / 12).alias("shot_index")).agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), (F.min("frame_index") + 5).alias("release_frame")
    )


@query("JON03", with_(FRAMES_SQL, ATTEMPTS_SQL) + "SELECT a.sid, a.shot_index, a.release_frame, f.x AS release_x, f.y AS release_y FROM attempts a LEFT JOIN frames f ON f.sid = a.sid AND f.frame_index = a.release_frame")
def lookup_at(spark, sf):
    out = jn.lookup_at(attempts(spark, sf), frames(spark, sf), ["sid"], "release_frame", ["x", "y"], "release")
    return out.select("sid", "shot_index", "release_frame", "release_x", "release_y")


@query("JON04", with_(FRAMES_SQL, ATTEMPTS_SQL) + """, first AS (SELECT sid, min(timestamp_sec) AS t0 FROM frames GROUP BY sid)
SELECT a.sid, a.shot_index, round(coalesce(f.timestamp_sec, t0), 6) AS time_sec FROM attempts a JOIN first USING (sid) LEFT JOIN frames f ON f.sid = a.sid AND f.frame_index = a.release_frame""")
def lookup_with_fallback(spark, sf):
    f = frames(spark, sf)
    at = jn.lookup_at(attempts(spark, sf), f, ["sid"], "release_frame", ["timestamp_sec"], "r")
    first = f.groupBy("sid").agg(F.min("timestamp_sec").alias("t0"))
    return dim_join(at, first, ["sid"], spread=["shot_index"]).select("sid", "shot_index", F.round(F.coalesce("r_timestamp_sec", "t0"), 6).alias("time_sec"))


def timed(spark, sf, kind):
    ev = table(spark, sf, "events").filter(c("event_type") == kind)
    return ev.select(c("user_id").alias("sid"), c("event_id").alias(f"{kind}_id"), (F.unix_micros(c("ts").cast("timestamp")) / F.lit(1e6)).alias(f"{kind}_t"))


TIMED_SQL = """pred AS (SELECT user_id AS sid, event_id AS pid, epoch_us(ts) / 1e6 AS pt FROM events WHERE event_type = 'purchase'),
truth AS (SELECT user_id AS sid, event_id AS tid, epoch_us(ts) / 1e6 AS tt FROM events WHERE event_type = 'view'),
cand AS (SELECT sid, pid, tid, abs(pt - tt) AS delta, row_number() OVER (PARTITION BY sid, pid ORDER BY abs(pt - tt), tid) AS rp, row_number() OVER (PARTITION BY sid, tid ORDER BY abs(pt - tt), pid) AS rt
  FROM pred JOIN truth USING (sid))"""
TOL = 21600.0
BLOCK = f"floor(_t / {DAY_SECONDS})"
MATCH = ("purchase_t", "purchase_id", "view_t", "view_id")


@query("JON05", with_(TIMED_SQL) + f"SELECT p.sid, p.pid AS purchase_id, c.tid AS view_id, round(c.delta, 3) AS delta FROM pred p LEFT JOIN cand c ON c.sid = p.sid AND c.pid = p.pid AND rp = 1 AND c.delta < {TOL}")
def match_nearest(spark, sf):
    out = jn.match_nearest(timed(spark, sf, "purchase"), timed(spark, sf, "view"), ["sid"], *MATCH, TOL, BLOCK)
    return out.select("sid", "purchase_id", c("match.id").alias("view_id"), F.round("delta", 3).alias("delta"))


ONE_SQL = TIMED_SQL + f""", one AS (SELECT sid, pid, tid, delta FROM cand WHERE rp = 1 AND rt = 1 AND delta < {TOL})"""


@query("JON06", with_(ONE_SQL) + """SELECT sid, pid AS pred_id, tid AS truth_id, round(delta, 3) AS delta, 'matched' AS kind FROM one
UNION ALL SELECT sid, pid, NULL, NULL, 'false_positive' FROM pred WHERE (sid, pid) NOT IN (SELECT sid, pid FROM one)
UNION ALL SELECT sid, NULL, tid, NULL, 'false_negative' FROM truth WHERE (sid, tid) NOT IN (SELECT sid, tid FROM one)""")
def match_one_to_one(spark, sf):
    out = jn.match_one_to_one(timed(spark, sf, "purchase"), timed(spark, sf, "view"), ["sid"], *MATCH, TOL, BLOCK)
    return out.withColumn("delta", F.round("delta", 3))


@query("AGG31", with_(ONE_SQL) + "SELECT sid, count(*) AS n, round(avg(delta), 4) AS mean_error, round(max(delta), 4) AS max_error FROM one GROUP BY sid")
def timing_error(spark, sf):
    from kinetable.operators.evaluation import timing_error as op

    out = jn.match_one_to_one(timed(spark, sf, "purchase"), timed(spark, sf, "view"), ["sid"], *MATCH, TOL, BLOCK)
    return op(out.filter("kind = 'matched'"), ["sid"])


@query("JON07", with_(TIMED_SQL) + f"SELECT sid, pid AS purchase_id FROM pred p WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.sid = p.sid AND abs(pt - tt) < {TOL})")
def exclude_near(spark, sf):
    out = jn.exclude_near(timed(spark, sf, "purchase"), timed(spark, sf, "view"), ["sid"], *MATCH, TOL, BLOCK)
    return out.select("sid", "purchase_id")


@query("JON11", with_(WINDOWS_SQL) + "SELECT sid, shot_index, unnest(range(lo, hi + 1)) AS frame_index FROM windows")
def explode_windows(spark, sf):
    return jn.explode_windows(order_windows(spark, sf), "lo", "hi").select("sid", "shot_index", "frame_index")


@query("JON12", with_(FRAMES_SQL) + """SELECT sid, frame_index, 'base' AS origin, y FROM frames WHERE source IN ('detected', 'interpolated')
UNION ALL SELECT sid, frame_index, 'extra', y + 1 FROM frames WHERE source <> 'detected'
EXCEPT ALL SELECT sid, frame_index, 'base', y FROM frames WHERE source = 'interpolated'""")
def prefer_new(spark, sf):
    f = frames(spark, sf)
    base = f.filter("source IN ('detected', 'interpolated')").select("sid", "frame_index", F.lit("base").alias("origin"), "y")
    extra = f.filter("source <> 'detected'").select("sid", "frame_index", F.lit("extra").alias("origin"), (c("y") + 1).alias("y"))
    return jn.prefer_new(base, extra, ["sid", "frame_index"])


LABEL_RULE = "CASE WHEN n_chars < 200 THEN 'missed' WHEN n_chars < 400 THEN 'unknown' ELSE 'made' END"
TRUTH_RULE = "CASE WHEN quality = 1 THEN 'made' ELSE 'missed' END"
# Three documents are a session; the labels cover only some, so most sessions are refused.
TRUTH_SQL = f"""ck AS (SELECT coalesce(a.sid, b.sid) AS sid, coalesce(a.doc_id, b.doc_id) AS doc_id, automatic_outcome, verified_outcome, CASE WHEN b.doc_id IS NULL THEN 'no_truth' WHEN a.doc_id IS NULL THEN 'no_attempt' ELSE 'both' END AS status FROM
 (SELECT doc_id // 3 AS sid, doc_id, {LABEL_RULE} AS automatic_outcome FROM documents) a FULL JOIN (SELECT doc_id // 3 AS sid, doc_id, {TRUTH_RULE} AS verified_outcome FROM labels) b ON a.sid = b.sid AND a.doc_id = b.doc_id),
sm AS (SELECT sid, count(*) FILTER (status <> 'both') AS n_mismatched, count(*) FILTER (automatic_outcome = 'made') AS am, count(*) FILTER (automatic_outcome = 'missed') AS ai, count(*) FILTER (automatic_outcome = 'unknown') AS au,
 count(*) FILTER (verified_outcome = 'made') AS vm, count(*) FILTER (verified_outcome = 'missed') AS vi FROM ck GROUP BY sid),
ov AS (SELECT sid, n_mismatched, n_mismatched = 0 AS outcomes_verified, am AS automatic_made, ai AS automatic_missed, au AS automatic_unknown, round(100.0::DOUBLE * am / nullif(am + ai, 0), 1) AS automatic_shooting_percentage,
 CASE WHEN n_mismatched = 0 THEN vm ELSE am END AS made, CASE WHEN n_mismatched = 0 THEN vi ELSE ai END AS missed, CASE WHEN n_mismatched = 0 THEN 0 ELSE au END AS unknown FROM sm)"""


@query("JON13", with_(TRUTH_SQL) + """SELECT sid, doc_id, automatic_outcome, verified_outcome, status, ov.* EXCLUDE (sid), round(100.0::DOUBLE * made / nullif(made + missed, 0), 1) AS shooting_percentage FROM ck JOIN ov USING (sid)""")
def overlay_truth(spark, sf):
    """Labels of both sides, mismatching keys included, with the figures of their session."""
    from kinetable.operators.evaluation import truth_keys, truth_summary
    from kinetable.operators.lineage import stage

    sid = F.floor(c("doc_id") / 3).alias("sid")
    auto = table(spark, sf, "documents").select(sid, "doc_id", F.expr(LABEL_RULE).alias("outcome"))
    truth = table(spark, sf, "labels").select(sid, "doc_id", F.expr(TRUTH_RULE).alias("outcome"))
    rows = stage(truth_keys(auto, truth, ["sid"], ["doc_id"]))
    return rows.join(truth_summary(rows, ["sid"]), "sid")


@query("JON14", """SELECT sid, frame_index, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance FROM
(SELECT label AS sid, vec_id AS frame_index, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE vec_id % 5 <> 0) a FULL JOIN
(SELECT label AS sid, vec_id AS frame_index, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings WHERE vec_id % 7 <> 0) b USING (sid, frame_index)""")
def agreement(spark, sf):
    e = table(spark, sf, "embeddings")

    def source(i, drop):
        at = lambda j: F.element_at("embedding", j).cast("double")
        return e.filter(F.pmod("vec_id", F.lit(drop)) != 0).select(c("label").alias("sid"), c("vec_id").alias("frame_index"), at(i).alias("x"), at(i + 1).alias("y"))

    return jn.agreement(source(1, 5), source(3, 7), ["sid", "frame_index"]).withColumn("distance", F.round("distance", 4))


@query("JON16", with_(DAYS_SQL) + """, tracks AS (SELECT sid, frame_index, avg(value) AS mid FROM days GROUP BY ALL)
SELECT sid, frame_index, event_id, round(abs(value - mid), 8) AS dist FROM days JOIN tracks USING (sid, frame_index)
QUALIFY row_number() OVER (PARTITION BY sid, frame_index ORDER BY round(abs(value - mid), 9), -value, event_id) = 1""")
def nearest_candidate(spark, sf):
    d = day_points(spark, sf)
    at = d.groupBy("sid", "frame_index").agg(F.avg("value").alias("at"))
    rows = d.join(at, ["sid", "frame_index"]).withColumn("dist", F.abs(c("value") - c("at")))
    best = best_row(rows.select("sid", "frame_index", "event_id", "dist", "value"), ["sid", "frame_index"], [F.round("dist", 9), -c("value"), c("event_id")])
    return best.select("sid", "frame_index", "event_id", F.round("dist", 8).alias("dist"))


@query("JON17", """SELECT coalesce(s.s_suppkey, l.sid) AS sid, s.s_nationkey, coalesce(l.shots, 0) AS shots, CASE WHEN s.s_suppkey IS NULL THEN 'orphan' WHEN l.sid IS NULL THEN 'empty' ELSE 'ok' END AS status
FROM supplier s FULL JOIN (SELECT l_suppkey AS sid, count(*) AS shots FROM lineitem GROUP BY ALL) l ON l.sid = s.s_suppkey""")
def sessions_with_shots(spark, sf):
    parent = table(spark, sf, "supplier").select(c("s_suppkey").alias("sid"), "s_nationkey")
    return jn.sessions_with_children(parent, table(spark, sf, "lineitem").select(c("l_suppkey").alias("sid")), ["sid"], "shots")


@query("JON18", with_(FRAMES_SQL) + """SELECT f.sid, frame_index, round(y / (c_acctbal + 2000), 6) AS scaled FROM frames f JOIN customer c ON c.c_custkey = f.sid""")
def dimension(spark, sf):
    dim = table(spark, sf, "customer").select(c("c_custkey").alias("sid"), (c("c_acctbal") + 2000).alias("scale"))
    rows = dim_join(frames(spark, sf), dim, ["sid"], spread=["frame_index"])
    return rows.select("sid", "frame_index", F.round(c("y") / c("scale"), 6).alias("scaled"))


@query("JON19", with_(WINDOWS_SQL, DAYS_SQL) + """SELECT d.sid, event_id, min(shot_index) AS active_shot FROM days d LEFT JOIN windows w ON d.sid = w.sid AND frame_index BETWEEN lo AND hi GROUP BY ALL""")
def active_shot(spark, sf):
    pts, wins = day_points(spark, sf), order_windows(spark, sf)
    hit = jn.interval_join(pts, wins, ["sid"], "frame_index", "lo", "hi", block=8).groupBy("sid", "event_id").agg(F.min("shot_index").alias("active_shot"))
    return pts.select("sid", "event_id").join(hit, ["sid", "event_id"], "left")


@query("JON20", with_(FRAMES_SQL, SIGNALS_SQL, ATTEMPTS_SQL) + """SELECT sid, shot_index, list({frame: s.fr, src: g.source, dist: round(g.dist, 6), x: f.x} ORDER BY s.fr) AS timeline FROM
 (SELECT sid, shot_index, unnest(range(start_frame, start_frame + 13)) AS fr FROM attempts) s LEFT JOIN frames f USING (sid) LEFT JOIN signals g USING (sid)
 WHERE f.frame_index = s.fr AND g.frame_index = s.fr GROUP BY ALL""".replace("LEFT JOIN frames f USING (sid) LEFT JOIN signals g USING (sid)\n WHERE f.frame_index = s.fr AND g.frame_index = s.fr", "LEFT JOIN frames f ON f.sid = s.sid AND f.frame_index = s.fr LEFT JOIN signals g ON g.sid = s.sid AND g.frame_index = s.fr").replace("SELECT sid, shot_index, list(", "SELECT s.sid, s.shot_index, list("))
def timeline(spark, sf):
    spine = jn.explode_windows(attempts(spark, sf).withColumn("hi", c("start_frame") + 12), "start_frame", "hi", "frame_index").select("sid", "shot_index", "frame_index")
    f = frames(spark, sf).select("sid", "frame_index", c("x").alias("fx"))
    g = signals(spark, sf).select("sid", "frame_index", "source", F.round("ball_hand_dist_norm", 6).alias("dist"))
    rows = spine.join(f, ["sid", "frame_index"], "left").join(g, ["sid", "frame_index"], "left")
    entry = F.struct(c("frame_index").alias("frame"), c("source").alias("src"), "dist", c("fx").alias("x"))
    return rows.groupBy("sid", "shot_index").agg(F.array_sort(F.collect_list(entry)).alias("timeline"))


@query("PRJ24", with_(WINDOWS_SQL, DAYS_SQL) + "SELECT sid, event_id FROM days d WHERE EXISTS (SELECT 1 FROM windows w WHERE w.sid = d.sid AND frame_index BETWEEN lo AND hi)")
def in_windows(spark, sf):
    return jn.in_windows(day_points(spark, sf), order_windows(spark, sf), ["sid"], "frame_index", "lo", "hi", block=8).select("sid", "event_id")


@query("AGG14", with_(WINDOWS_SQL, DAYS_SQL) + """SELECT w.sid, shot_index, round(coalesce(avg(CASE WHEN event_type IN ('view','purchase','click') THEN 1.0 WHEN event_type IS NULL THEN NULL ELSE 0.0 END), 0), 6) AS track_quality
FROM windows w LEFT JOIN days d ON d.sid = w.sid AND frame_index BETWEEN lo AND hi GROUP BY ALL""")
def track_quality(spark, sf):
    from kinetable.operators.aggregates import track_quality as op

    pts = day_points(spark, sf).withColumn("source", F.when(c("event_type").isin("view", "purchase"), "detected").when(c("event_type") == "click", "interpolated").otherwise("predicted"))
    out = op(pts, order_windows(spark, sf), ["sid"], "shot_index", "frame_index", "lo", "hi")
    return out.withColumn("track_quality", F.round("track_quality", 6))


SEED_SQL = """anch AS (SELECT sid, frame_index, y, lag(frame_index) OVER (PARTITION BY sid ORDER BY frame_index) AS pf, lag(y) OVER (PARTITION BY sid ORDER BY frame_index) AS py FROM frames WHERE source IN ('detected','interpolated'))"""


@query("WIN17", with_(FRAMES_SQL, ATTEMPTS_SQL, SEED_SQL) + """SELECT sid, shot_index, n.frame_index AS seed_frame, n.pf AS prev_frame, round(n.y, 4) AS seed_y, round(n.y - n.py, 4) AS step_y FROM
 (SELECT a.sid, a.shot_index, (SELECT max(frame_index) FROM anch WHERE anch.sid = a.sid AND anch.frame_index <= a.start_frame) AS sf FROM attempts a) q LEFT JOIN anch n ON n.sid = q.sid AND n.frame_index = q.sf""".replace("SELECT sid, shot_index, n.frame", "SELECT q.sid, q.shot_index, n.frame"))
def seed_state(spark, sf):
    from kinetable.operators.ordered import prev_row, scan

    anchors = frames(spark, sf).filter("source IN ('detected', 'interpolated')").select("sid", "frame_index", "y")
    anchors = scan(anchors, FRAME_SERIES, _p=prev_row(F.struct("frame_index", "y")))
    payload = F.struct("frame_index", "y", c("_p.frame_index").alias("pf"), c("_p.y").alias("py"))
    out = jn.last_at_or_before(attempts(spark, sf), anchors, ["sid"], "start_frame", "frame_index", payload, "floor(_t / 4096)", "seed")
    return out.select(
        "sid", "shot_index", c("seed.frame_index").alias("seed_frame"), c("seed.pf").alias("prev_frame"),
        F.round("seed.y", 4).alias("seed_y"), F.round(c("seed.y") - c("seed.py"), 4).alias("step_y"),
    )


@query("AGG38", COACH + """, rs AS (SELECT sid, count(*) AS n_shots, count(*) FILTER (NOT excluded_from_analysis AND outcome = 'made') AS made, count(*) FILTER (NOT excluded_from_analysis AND outcome = 'missed') AS missed,
 count(*) FILTER (NOT excluded_from_analysis AND outcome = 'unknown') AS unknown, count(*) FILTER (excluded_from_analysis) AS excluded,
 list(outcome ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS outcomes FROM shots GROUP BY sid)
SELECT rs.*, round(100.0::DOUBLE * made / nullif(made + missed, 0), 1) AS shooting_percentage, ok AS eligible, CASE WHEN NOT ok THEN 'low' WHEN tracking = 'medium' THEN 'medium' ELSE coalesce(pc, 'low') END AS confidence,
 CASE WHEN ok AND NOT clash THEN bk END AS strength_key, CASE WHEN ok THEN pk END AS priority_key FROM rs LEFT JOIN j4 USING (sid)""")
def regression_summary(spark, sf):
    from kinetable.catalog.base import SHOT_METRICS, SHOT_ORDER
    from kinetable.operators.evaluation import regression_summary as op
    from kinetable.plans.coaching import coaching

    s = shots(spark, sf)
    return op(s, coaching(s, ["sid"], SHOT_METRICS), ["sid"], SHOT_ORDER, "year(l_shipdate) * 12 + month(l_shipdate)")

"""Registered window queries over the event-derived frame series."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.base import FRAME_SERIES, FRAMES_SQL, POSES_SQL, SIGNALS_SQL, frames, poses, query, signals, table, with_
from kinetable.operators import windows as win
from kinetable.operators.ordered import Series, positions
from kinetable.operators.reversal import reversal_scan
from kinetable.operators.signals import is_burst, is_flight

c = F.col
KEYS = ["sid"]
_P = "PARTITION BY sid ORDER BY frame_index"

def block():
    return F.floor(c("frame_index") / 4096)


@query("WIN01", with_(FRAMES_SQL, SIGNALS_SQL) + "SELECT sid, frame_index, round(v, 10) AS velocity FROM signals")
def velocity(spark, sf):
    return signals(spark, sf).select("sid", "frame_index", F.round("ball_vertical_velocity_norm", 10).alias("velocity"))


@query("WIN02", with_(FRAMES_SQL, SIGNALS_SQL) + "SELECT sid, frame_index, round(dist, 4) AS distance FROM signals")
def wrist_distance(spark, sf):
    return signals(spark, sf).select("sid", "frame_index", F.round("ball_hand_dist_norm", 4).alias("distance"))


_DB = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_DA = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _around(flag: str) -> str:
    parts = []
    for v in ("timestamp_sec", "x", "y"):
        e = f"CASE WHEN {flag} THEN {v} END"
        s = "t" if v == "timestamp_sec" else v
        parts.append(f"last_value({e} IGNORE NULLS) OVER ({_P} {_DB}) AS b{s}, first_value({e} IGNORE NULLS) OVER ({_P} {_DA}) AS a{s}")
    return ", ".join(parts)


_LINE = """(at_ - bt <= 1e-6 OR sqrt(pow(x - (bx + (timestamp_sec - bt) / (at_ - bt) * (ax - bx)), 2) + pow(y - (by_ + (timestamp_sec - bt) / (at_ - bt) * (ay - by_)), 2))
  <= greatest(0.6 * sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)), 15))""".replace("at_", '"at"').replace("by_", '"by"')
TRUSTED_SQL = f"""tr0 AS (SELECT *, {_around("source = 'detected'")} FROM frames WHERE source IN ('detected', 'interpolated')),
tr1 AS (SELECT * EXCLUDE (bt, "at", bx, ax, "by", ay), source = 'detected' AND (bt IS NULL OR "at" IS NULL OR {_LINE}) AS ok FROM tr0),
tr2 AS (SELECT *, {_around("ok")}, count(*) FILTER (ok) OVER (PARTITION BY sid) AS n_ok FROM tr1),
trusted AS (SELECT * EXCLUDE (bt, "at", bx, ax, "by", ay) FROM tr2 WHERE ok OR (source = 'interpolated' AND n_ok >= 2 AND bt IS NOT NULL AND "at" IS NOT NULL AND {_LINE}))"""


@query("WIN03", with_(FRAMES_SQL, TRUSTED_SQL) + f"SELECT * FROM (SELECT sid, lag(frame_index) OVER ({_P}) AS a_frame, frame_index AS b_frame FROM trusted) WHERE a_frame IS NOT NULL")
def consecutive_pairs(spark, sf):
    rows = win.consecutive_pairs(win.trusted(frames(spark, sf), FRAME_SERIES), FRAME_SERIES, ["frame_index"])
    return rows.select("sid", c("a.frame_index").alias("a_frame"), c("frame_index").alias("b_frame"))


@query("WIN04", with_(FRAMES_SQL, TRUSTED_SQL) + "SELECT sid, frame_index, source, y FROM trusted")
def trusted(spark, sf):
    return win.trusted(frames(spark, sf), FRAME_SERIES).select("sid", "frame_index", "source", "y")


@query("WIN06", with_(FRAMES_SQL, TRUSTED_SQL) + """SELECT sid, frame_index, round(bx + (timestamp_sec - bt) / ("at" - bt) * (ax - bx), 4) AS x_line,
  round("by" + (timestamp_sec - bt) / ("at" - bt) * (ay - "by"), 4) AS y_line FROM tr0 WHERE source = 'interpolated' AND bt IS NOT NULL AND "at" IS NOT NULL""")
def lerp(spark, sf):
    from kinetable.functions.geometry import lerp as op

    placed = frames(spark, sf).filter(c("source").isin("detected", "interpolated"))
    rows = win.bracket(placed, FRAME_SERIES, c("source") == "detected", ["timestamp_sec", "x", "y"])
    rows = rows.filter((c("source") == "interpolated") & c("anchor_before").isNotNull() & c("anchor_after").isNotNull())
    b, a = c("anchor_before"), c("anchor_after")
    at = lambda v: F.round(op(c("timestamp_sec"), b["timestamp_sec"], b[v], a["timestamp_sec"], a[v]), 4)
    return rows.select("sid", "frame_index", at("x").alias("x_line"), at("y").alias("y_line"))


@query("JON10", with_(FRAMES_SQL, TRUSTED_SQL) + """SELECT sid, frame_index, round(bt, 4) AS t_before, round("at", 4) AS t_after FROM tr0""")
def bracket(spark, sf):
    placed = frames(spark, sf).filter(c("source").isin("detected", "interpolated"))
    rows = win.bracket(placed, FRAME_SERIES, c("source") == "detected", ["timestamp_sec"])
    return rows.select("sid", "frame_index", F.round("anchor_before.timestamp_sec", 4).alias("t_before"), F.round("anchor_after.timestamp_sec", 4).alias("t_after"))


@query("WIN07", with_(FRAMES_SQL) + f"""SELECT sid, min(frame_index) AS start, max(frame_index) AS "end", count(*) AS length FROM
  (SELECT *, frame_index - row_number() OVER ({_P}) AS g FROM frames WHERE y < 40) GROUP BY sid, g HAVING count(*) >= 3""")
def streaks(spark, sf):
    return win.streaks(frames(spark, sf), FRAME_SERIES, c("y") < 40, 3)


CHAINS_SQL = f"""seen AS (SELECT *, timestamp_sec - lag(timestamp_sec) OVER ({_P}) AS dt FROM frames WHERE source = 'detected'),
chains AS (SELECT *, sum(CASE WHEN dt IS NOT NULL AND NOT (dt > 1e-6 AND dt <= 0.05) THEN 1 ELSE 0 END) OVER ({_P})::BIGINT AS chain FROM seen)"""


@query("WIN08", with_(FRAMES_SQL, CHAINS_SQL) + "SELECT sid, chain, min(frame_index) AS start, max(frame_index) AS \"end\", count(*) AS n FROM chains GROUP BY ALL")
def chains(spark, sf):
    rows = win.chains(frames(spark, sf).filter("source = 'detected'"), FRAME_SERIES, "timestamp_sec", 0.05)
    return rows.groupBy("sid", "chain").agg(F.min("frame_index").alias("start"), F.max("frame_index").alias("end"), F.count(F.lit(1)).alias("n"))


DIP_SQL = f"""knees AS (SELECT sid, frame_index, list({{v: knee, i: frame_index}}) FILTER (knee IS NOT NULL) OVER ({_P} ROWS BETWEEN 44 PRECEDING AND CURRENT ROW) AS seen FROM signals),
dips AS (SELECT sid, frame_index, CASE WHEN seen IS NULL OR len(seen) = 0 THEN true ELSE
  coalesce(list_max(list_transform(list_filter(seen, lambda e: e.i < list_min(seen).i), lambda e: e.v)) - list_min(seen).v >= 12, false) END AS dip_ok FROM knees)"""


@query("WIN09", with_(FRAMES_SQL, SIGNALS_SQL, DIP_SQL) + "SELECT * FROM dips")
def genuine_dip(spark, sf):
    return win.genuine_dip(signals(spark, sf).select("sid", "frame_index", "knee_angle_deg"), KEYS, "frame_index", "knee_angle_deg").select("sid", "frame_index", "dip_ok")


@query("WIN10", with_(FRAMES_SQL, SIGNALS_SQL) + f"""SELECT sid, frame_index, coalesce(max(hip) OVER w - min(hip) OVER w <= 4, true) AS stationary_ok FROM signals
  WINDOW w AS ({_P} ROWS BETWEEN 44 PRECEDING AND CURRENT ROW)""")
def stationary(spark, sf):
    return win.stationary(signals(spark, sf).select("sid", "frame_index", "hip_x_norm"), KEYS, "frame_index", "hip_x_norm").select("sid", "frame_index", "stationary_ok")


@query("WIN11", with_(FRAMES_SQL, SIGNALS_SQL) + """SELECT sid, frame_index, coalesce(ball_available AND v <= -0.35, false) AS burst,
  coalesce(ball_available AND v <= -0.35, false) AND coalesce(ball_y <= shoulder_y, true) AS flight FROM signals""")
def upward_predicates(spark, sf):
    s = signals(spark, sf)
    return s.select("sid", "frame_index", is_burst().alias("burst"), is_flight().alias("flight"))


EMA_SQL = """RECURSIVE_EMA AS (SELECT sid, frame_index, sqrt(x) AS r FROM frames WHERE frame_index = 0
  UNION ALL SELECT f.sid, f.frame_index, 0.7 * e.r + 0.3 * sqrt(f.x) FROM RECURSIVE_EMA e JOIN frames f ON f.sid = e.sid AND f.frame_index = e.frame_index + 1)"""


@query("WIN12", with_(FRAMES_SQL, EMA_SQL, recursive=True) + "SELECT sid, frame_index, round(r, 8) AS radius_ema FROM RECURSIVE_EMA")
def ema(spark, sf):
    rows = win.ema(frames(spark, sf).withColumn("r", F.sqrt("x")), KEYS, ["frame_index"], "r", block(), name="radius_ema")
    return rows.select("sid", "frame_index", F.round("radius_ema", 8).alias("radius_ema"))


SMOOTH_SQL = """sm AS (SELECT sid, frame_index, CASE WHEN detected THEN nose_x END AS x, CASE WHEN detected THEN nose_y END AS y FROM poses WHERE frame_index = 0
  UNION ALL SELECT p.sid, p.frame_index, CASE WHEN p.detected THEN CASE WHEN s.x IS NULL THEN p.nose_x ELSE 0.35 * p.nose_x + 0.65 * s.x END END,
    CASE WHEN p.detected THEN CASE WHEN s.y IS NULL THEN p.nose_y ELSE 0.35 * p.nose_y + 0.65 * s.y END END
  FROM sm s JOIN poses p ON p.sid = s.sid AND p.frame_index = s.frame_index + 1)"""


@query("WIN13", with_(POSES_SQL, SMOOTH_SQL, recursive=True) + "SELECT sid, frame_index, round(x, 4) AS nose_x, round(y, 4) AS nose_y FROM sm")
def smooth_landmarks(spark, sf):
    flat = poses(spark, sf).select("sid", "frame_index", "detected", c("joints.nose.x").alias("nose_x"), c("joints.nose.y").alias("nose_y"))
    rows = win.smooth_landmarks(flat, KEYS, "frame_index", "detected", ["nose_x", "nose_y"], block())
    return rows.select("sid", "frame_index", F.round("nose_x", 4).alias("nose_x"), F.round("nose_y", 4).alias("nose_y"))


@query("WIN14", with_(FRAMES_SQL) + f""", m AS (SELECT *, max(y) OVER ({_P}) AS mx, coalesce(y > max(y) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS nm FROM frames),
g AS (SELECT *, sum(CASE WHEN nm THEN 1 ELSE 0 END) OVER ({_P}) AS isl FROM m)
SELECT sid, frame_index, round(mx, 4) AS running_max, (count(*) FILTER (NOT nm AND y < mx) OVER (PARTITION BY sid, isl ORDER BY frame_index))::BIGINT AS lower_since_max FROM g""")
def running_reversal(spark, sf):
    rows = reversal_scan(frames(spark, sf), FRAME_SERIES, "y")
    return rows.select("sid", "frame_index", F.round("running_max", 4).alias("running_max"), "lower_since_max")


@query("WIN15", with_(FRAMES_SQL) + f"SELECT sid, frame_index, round(avg(x * y) OVER ({_P} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 7) AS trailing_mean FROM frames")
def trailing_mean(spark, sf):
    area = frames(spark, sf).select("sid", "frame_index", (c("x") * c("y")).alias("area"))
    return win.trailing_mean(area, KEYS, "frame_index", "area").select("sid", "frame_index", F.round("trailing_mean", 7).alias("trailing_mean"))


@query("WIN16", """SELECT o_custkey AS sid, o_orderkey AS shot_index, s AS start_day, least(e + 60, lead(s) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) - 1)::INTEGER AS hi
  FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::INTEGER AS s, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::INTEGER + 14 AS e FROM orders)""")
def bounded_windows(spark, sf):
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    w = table(spark, sf, "orders").select(c("o_custkey").alias("sid"), c("o_orderkey").alias("shot_index"), day.alias("start_day"), (day + 14).alias("end_day"))
    out = win.bounded_windows(w, Series(["sid"], ["start_day", "shot_index"], "floor(start_day / 90)"), "end_day", 60)
    return out.select("sid", "shot_index", "start_day", "hi")


@query("WIN18", with_(FRAMES_SQL, SIGNALS_SQL) + f"SELECT sid, frame_index, round(min(dist) OVER ({_P} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3_min FROM signals")
def last_k_min(spark, sf):
    s = signals(spark, sf).select("sid", "frame_index", "ball_hand_dist_norm")
    return win.trailing_min(s, KEYS, "frame_index", "ball_hand_dist_norm", 3, "last3_min").select("sid", "frame_index", F.round("last3_min", 4).alias("last3_min"))


@query("WIN19", with_(FRAMES_SQL) + f"SELECT sid, frame_index, list(y) OVER ({_P} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS trail FROM frames")
def trail(spark, sf):
    rows = win.trail(frames(spark, sf).select("sid", "frame_index", "y"), KEYS, "frame_index", ["y"])
    return rows.select("sid", "frame_index", F.transform("trail", lambda s: s["y"]).alias("trail"))


@query("WIN20", "SELECT l_suppkey AS sid, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS shot_index FROM lineitem")
def ordinal(spark, sf):
    series = Series(["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "year(l_shipdate) * 12 + month(l_shipdate)")
    rows = positions(table(spark, sf, "lineitem"), series, "shot_index")
    return rows.select(c("l_suppkey").alias("sid"), "l_orderkey", "l_linenumber", "l_partkey", "shot_index")


COOL_SQL = """ev AS (SELECT sid, frame_index, row_number() OVER (PARTITION BY sid ORDER BY frame_index) AS i, y > 100 AS weak FROM frames WHERE y < 20 OR y > 100),
cool AS (SELECT sid, i, frame_index, true AS kept, frame_index AS last, CASE WHEN weak THEN frame_index + 90 END AS until FROM ev WHERE i = 1
  UNION ALL SELECT e.sid, e.i, e.frame_index, NOT (e.frame_index - c.last < 10 OR coalesce(e.frame_index < c.until, false)),
   CASE WHEN NOT (e.frame_index - c.last < 10 OR coalesce(e.frame_index < c.until, false)) THEN e.frame_index ELSE c.last END,
   CASE WHEN NOT (e.frame_index - c.last < 10 OR coalesce(e.frame_index < c.until, false)) THEN CASE WHEN e.weak THEN e.frame_index + 90 END ELSE c.until END
  FROM cool c JOIN ev e ON e.sid = c.sid AND e.i = c.i + 1)"""


@query("WIN21", with_(FRAMES_SQL, COOL_SQL, recursive=True) + "SELECT sid, frame_index FROM cool WHERE kept")
def cooldown(spark, sf):
    events = frames(spark, sf).filter("y < 20 OR y > 100").select("sid", "frame_index", (c("y") > 100).alias("weak"))
    return win.cooldown(events, KEYS, "frame_index", "weak", block())


@query("WIN22", with_(FRAMES_SQL) + f"SELECT sid, frame_index, count(*) FILTER (abs(x - 50) > 40) OVER ({_P}) AS prefix_count FROM frames")
def prefix_count(spark, sf):
    return win.prefix_count(frames(spark, sf), FRAME_SERIES, F.abs(c("x") - 50) > 40).select("sid", "frame_index", "prefix_count")


STATIC_SQL = f"""rep AS (SELECT *, coalesce(abs(x - lag(x) OVER ({_P})) < 30 AND abs(y - lag(y) OVER ({_P})) < 30, false) AS r FROM frames),
isl AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER ({_P}) AS g FROM rep),
run AS (SELECT *, count(*) FILTER (r) OVER (PARTITION BY sid, g ORDER BY frame_index) AS n FROM isl)"""


@query("WIN23", with_(FRAMES_SQL, STATIC_SQL) + "SELECT sid, frame_index FROM run r WHERE frame_index < coalesce((SELECT min(frame_index) FROM run q WHERE q.sid = r.sid AND q.n > 2), 1e12)")
def static_run_cut(spark, sf):
    return win.static_run_cut(frames(spark, sf), FRAME_SERIES, eps=30).select("sid", "frame_index")


@query("STR03", """SELECT sid, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT user_id AS sid, ts,
  sum(CASE WHEN gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM
  (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY sid, g""")
def gap_sessions(spark, sf):
    ev = table(spark, sf, "events").withColumnRenamed("user_id", "sid")
    return win.session_windows(ev, ["sid"], "ts", "6 hours").select("sid", c("start").cast("timestamp_ntz").alias("start"), c("end").cast("timestamp_ntz").alias("end"), "n")

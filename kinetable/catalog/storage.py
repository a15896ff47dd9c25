"""Registered sources, sinks, maintenance jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.aggregates import COACH
from kinetable.catalog.base import _SOURCE, FRAMES_SQL, SHOT_METRICS, SIGNALS_SQL, TORSO_PX, frames, query, shot_series, shots, shots_sql, signals, table, with_
from kinetable.catalog.episodes import CTRL_SQL, PAIRS_SQL, SEGMENT_SQL, TRACK_SQL, TRUSTED_S
from kinetable.catalog.projections import NORM, SPLIT
from kinetable.operators.curation import normalize_split
from kinetable.operators.lineage import scratch_folder
from kinetable.operators.ordered import positions
from kinetable.plans.coaching import coaching
from kinetable.plans.session_stats import consistency, session_summary
from kinetable.sources import readers, store, writers
from kinetable.streaming import streams
from kinetable.streaming.stateful import fold_stream

c = F.col


def trace_points(spark, sf):
    return frames(spark, sf).withColumns({"pose_detected": F.pmod("event_id", F.lit(4)) != 0, "pose_confidence": c("confidence")})


@query("SNK01", with_(FRAMES_SQL) + """SELECT sid, frame_index, round(timestamp_sec, 4) AS timestamp_sec, event_id % 4 <> 0 AS pose_detected, round(confidence, 3) AS pose_confidence, source AS ball_source,
 CASE WHEN source <> 'unavailable' THEN round(x, 1) END AS ball_x, CASE WHEN source <> 'unavailable' THEN round(y, 1) END AS ball_y, round(confidence, 3) AS ball_confidence FROM frames""")
def frame_trace(spark, sf):
    return writers.frame_trace_rows(trace_points(spark, sf), ["sid"])


@query("SRC01", with_(FRAMES_SQL) + """SELECT sid, frame_index, round(timestamp_sec, 4) AS timestamp_sec, round(x, 1) AS x, round(y, 1) AS y, 10.0 AS radius, round(confidence, 3) AS confidence, source FROM frames WHERE source <> 'unavailable'""".replace("10.0 AS", "10.0::DOUBLE AS"))
def read_trace(spark, sf):
    path = scratch_folder(spark, "trace")
    points = trace_points(spark, sf).withColumn("bucket", writers.bucket_of(["sid"], 8))
    rows = writers.frame_trace_rows(points, ["bucket", "sid"])
    rows.select(*[n for n in rows.columns if n not in ("bucket", "sid")], "sid", "bucket").write.option("header", True).partitionBy("bucket").csv(path)
    return readers.read_frame_trace(spark, path, ", sid BIGINT, bucket INT").drop("bucket")


@query("SNK02", with_(FRAMES_SQL, SIGNALS_SQL) + "SELECT sid, count(*) AS n, count(*) FILTER (ball_available) AS available, round(sum(dist), 6) AS dist_sum FROM signals GROUP BY sid")
def write_signals(spark, sf):
    path = scratch_folder(spark, "signals")
    writers.write_signals(signals(spark, sf), path, 8)
    back = spark.read.option("header", True).schema(
        "sid BIGINT, frame_index BIGINT, timestamp_sec DOUBLE, ball_available BOOLEAN, ball_x DOUBLE, ball_y DOUBLE, ball_hand_dist_norm DOUBLE, ball_vertical_velocity_norm DOUBLE, knee_angle_deg DOUBLE, shoulder_y DOUBLE, hip_x_norm DOUBLE, ball_source STRING"
    ).csv(path)
    return back.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count_if("ball_available").alias("available"), F.round(F.sum("ball_hand_dist_norm"), 6).alias("dist_sum"))


LEVEL = "CASE WHEN {c} >= 0.75 THEN 'high' WHEN {c} >= 0.5 THEN 'medium' WHEN {c} > 0 THEN 'low' ELSE 'excluded' END".format(c="least(release_confidence, pose_quality, ball_track_quality)")
REPORT_SHOT = (
    "shot_index: BIGINT, outcome: STRING, start_time_sec: DOUBLE, end_time_sec: DOUBLE, release_confidence: DOUBLE, pose_quality: DOUBLE, ball_track_quality: DOUBLE, hoop_confidence: DOUBLE, "
    "mechanics: STRUCT<quantity: DOUBLE, unit_price_root: DOUBLE>, trajectory: STRUCT<discount_root: DOUBLE, tax_root: DOUBLE>, excluded_from_analysis: BOOLEAN, overall_confidence_level: STRING"
)


def report_tables(spark, sf):
    """Whole reports over the attempts of the items: summary, metric table, coaching, warnings, and every attempt."""
    s = shots(spark, sf)
    metric = lambda i: F.expr(SHOT_METRICS[i].expr).alias(SHOT_METRICS[i].key)
    placed = positions(s, shot_series(), "shot_index")
    attempts = placed.select(
        "sid", "shot_index", "outcome", "start_time_sec", "end_time_sec", "release_confidence", "pose_quality", "ball_track_quality", "hoop_confidence",
        F.struct(metric(0), metric(1)).alias("mechanics"), F.struct(metric(2), metric(3)).alias("trajectory"), "excluded_from_analysis",
    )
    summary, told, table_ = session_summary(s, ["sid"], SHOT_METRICS), coaching(s, ["sid"], SHOT_METRICS), consistency(s, ["sid"], SHOT_METRICS)
    nested = lambda df, name: df.select("sid", F.struct(*[n for n in df.columns if n != "sid"]).alias(name))
    listed = table_.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(*[n for n in table_.columns if n != "sid"]))).alias("consistency"))
    return nested(summary, "summary").join(nested(told, "coaching"), "sid").join(listed, "sid"), attempts


def written_report(spark, sf):
    path = scratch_folder(spark, "reports")
    writers.write_session_report(*report_tables(spark, sf), path)
    session = f"summary: STRUCT<{readers.SUMMARY}>, coaching: STRUCT<{readers.COACHING}>, consistency: ARRAY<STRUCT<{readers.METRIC}, {readers.METRICS['consistency']}>>"
    return readers.read_session_report(spark, path, "sid BIGINT", session, REPORT_SHOT)


REPORT_SQL = COACH + """, pos AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM shots),
rp AS (SELECT sid, count(*) AS n_shots, count(*) FILTER (NOT excluded_from_analysis AND outcome = 'made') AS made, count(*) FILTER (NOT excluded_from_analysis AND outcome = 'missed') AS missed,
 max(outcome) FILTER (p = 1) AS first_outcome, max(""" + LEVEL + """) FILTER (p = 1) AS first_level, max(end_time_sec) AS last_end, round(sum(l_quantity), 4)::DOUBLE AS quantity, count(*) FILTER (l_tax > 0) AS with_tax FROM pos GROUP BY sid)"""


@query("SNK03", REPORT_SQL + """SELECT rp.sid, n_shots, n_shots + 1 AS lines, made, missed, round(100.0::DOUBLE * made / nullif(made + missed, 0), 1) AS shooting_percentage, first_outcome, first_level,
 CASE WHEN ok THEN pk END AS priority_key, CASE WHEN ok AND NOT clash THEN bk END AS strength_key, (SELECT list({k: metric_key, n: n, m: round(mean, 3), cv: cv} ORDER BY metric_pos) FROM full_ WHERE full_.sid = rp.sid) AS consistency FROM rp JOIN j4 USING (sid)""")
def report_json(spark, sf):
    """The written lines, parsed again as plain JSON."""
    path = scratch_folder(spark, "reports")
    writers.write_session_report(*report_tables(spark, sf), path)
    text = spark.read.text(path)
    at = lambda p: F.get_json_object("value", p)
    head = lambda p, kind: F.max(F.when(at("$.kind") == "session", at(p))).cast(kind)
    first = lambda p: F.max(F.when(at("$.line_no") == "1", at(p)))
    metrics = F.from_json(head("$.session.consistency", "string"), "array<struct<metric_key: string, n: bigint, mean_value: double, coefficient_of_variation: double>>")
    rows = text.groupBy(at("$.sid").cast("bigint").alias("sid")).agg(
        F.count_if(at("$.kind") == "shot").alias("n_shots"), F.count(F.lit(1)).alias("lines"), *[head(f"$.session.summary.{n}", t).alias(n) for n, t in (("made", "bigint"), ("missed", "bigint"), ("shooting_percentage", "double"))],
        first("$.shot.outcome").alias("first_outcome"), first("$.shot.overall_confidence_level").alias("first_level"), head("$.session.coaching.priority_key", "string").alias("priority_key"),
        head("$.session.coaching.strength_key", "string").alias("strength_key"), metrics.alias("consistency"),
    )
    short = F.transform("consistency", lambda m: F.struct(m["metric_key"].alias("k"), m["n"].alias("n"), m["mean_value"].alias("m"), m["coefficient_of_variation"].alias("cv")))
    return rows.withColumn("consistency", short)


@query("SRC02", REPORT_SQL + """SELECT rp.sid, n_shots AS shots, rp.made, last_end, quantity, with_tax, round(100.0::DOUBLE * made / nullif(made + missed, 0), 1) AS shooting_percentage, CASE WHEN ok THEN pk END AS priority_key, len([1, 2, 3, 4])::INTEGER AS metrics FROM rp JOIN j4 USING (sid)""")
def read_sessions(spark, sf):
    """Reports read back as typed sessions and attempts."""
    heads, attempts = written_report(spark, sf)
    per = attempts.groupBy("sid").agg(
        F.count(F.lit(1)).alias("shots"), F.max("end_time_sec").alias("last_end"), F.round(F.sum("mechanics.quantity"), 4).alias("quantity"), F.count("trajectory.tax_root").alias("with_tax")
    )
    told = heads.select("sid", c("summary.made").alias("made"), c("summary.shooting_percentage").alias("shooting_percentage"), c("coaching.priority_key").alias("priority_key"), F.size("consistency").alias("metrics"))
    return per.join(told, "sid")


def manifest(spark, sf):
    split = F.expr(SPLIT.format(i="doc_id"))
    box = lambda label, i: F.struct(F.lit(label).alias("label"), (c("doc_id") % i).cast("double").alias("cx"), F.lit(5.0).alias("cy"), F.lit(4.0).alias("w"), F.lit(2.0).alias("h"))
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.select(
        c("doc_id").alias("image_id"), F.concat(F.lit("d"), c("doc_id").cast("string")).alias("file_name"), F.lit(640).alias("width"), F.lit(360).alias("height"),
        split.alias("split"), F.array(box("ball", 50), box("rim", 70)).alias("boxes"),
    )


@query("SRC03", f"SELECT {NORM.format(i='doc_id')} AS split, count(*) AS images, count(*) * 2 AS boxes, sum(doc_id % 50 + doc_id % 70)::DOUBLE AS cx_sum FROM documents GROUP BY 1")
def read_manifest(spark, sf):
    path = scratch_folder(spark, "manifest")
    part = F.floor(c("image_id") / 256)
    files = manifest(spark, sf).groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]")).alias("value"))
    files.repartition("part").write.partitionBy("part").text(path)
    back = readers.read_manifest(spark, path)
    sum_cx = F.sum(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["cx"]))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum(F.size("boxes")).alias("boxes"), sum_cx.alias("cx_sum"))


def session_store(spark, name):
    """A store in the scratch folder; small leaves, so that they split at small scales too."""
    return store.SessionStore(spark, scratch_folder(spark, name), max_rows=1 << 14)


@query("SNK04", with_(shots_sql("l_suppkey")) + "SELECT sid, count(*) AS shots, count(*) FILTER (outcome = 'made') AS made FROM shots GROUP BY sid")
def save_session(spark, sf):
    held = session_store(spark, "shots")
    held.replace(shots(spark, sf, "l_suppkey").select("sid", "outcome", "start_time_sec"))
    return held.rows().groupBy("sid").agg(F.count(F.lit(1)).alias("shots"), F.count_if(c("outcome") == "made").alias("made"))


@query("SNK05", with_(shots_sql()) + "SELECT l_orderkey, l_linenumber, l_partkey, round(pose_quality, 6) AS pose_quality FROM shots")
def finite(spark, sf):
    rows = shots(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.round("pose_quality", 6).alias("pose_quality"))
    return writers.assert_finite(rows)


@query("SNK06", f"""WITH im AS (SELECT {NORM.format(i='doc_id')} AS split, doc_id, row_number() OVER (PARTITION BY {NORM.format(i='doc_id')} ORDER BY doc_id) AS image_no FROM documents)
SELECT split, doc_id AS image_id, image_no, 2 * (image_no - 1) + b AS id, CASE b WHEN 1 THEN 1 ELSE 2 END AS category_id, round(CASE b WHEN 1 THEN doc_id % 50 ELSE doc_id % 70 END - 2.0, 2)::DOUBLE AS bbox_x FROM im, (SELECT unnest([1, 2]) AS b)""")
def coco(spark, sf):
    from kinetable.operators.projections import to_coco_boxes

    m = manifest(spark, sf).withColumn("split", normalize_split(c("split")))
    boxes = to_coco_boxes(m.select("image_id", F.posexplode("boxes").alias("box_no", "b")).select("image_id", "box_no", "b.*"))
    _, notes = writers.coco_tables(m.drop("boxes"), boxes, "floor(image_id / 1024)")
    return notes.select("split", "image_id", "image_no", "id", "category_id", "bbox_x")


@query("SNK07", with_(FRAMES_SQL) + "SELECT source, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM frames GROUP BY source")
def report(spark, sf):
    path = scratch_folder(spark, "report")
    rows = frames(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    writers.write_report(rows.select("source", F.struct("n", "mean_confidence").alias("metrics")), path)
    return spark.read.schema("source string, metrics struct<n: bigint, mean_confidence: double>").json(path).select("source", "metrics.*")


STATUS = "CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'completed' ELSE 'failed' END"


def sessions(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        c("o_orderkey").alias("sid"), c("o_orderdate").alias("created_at"), F.expr(STATUS).alias("status"), F.lit(None).cast("string").alias("error_message"),
        (c("o_totalprice") > 100000).alias("has_report"), (F.pmod("o_custkey", F.lit(3)) == 0).alias("has_key"),
    )


@query("SNK08", f"SELECT o_orderkey AS sid, o_orderdate AS created_at, {STATUS} AS status, NULL::VARCHAR AS error_message FROM orders ORDER BY created_at DESC, sid")
def list_sessions(spark, sf):
    return writers.list_sessions(sessions(spark, sf))


@query("SNK09", with_(shots_sql("l_suppkey")) + "SELECT sid, outcome, count(*) AS n FROM shots WHERE sid = 7 GROUP BY ALL")
def get_session(spark, sf):
    held = session_store(spark, "shots")
    held.replace(shots(spark, sf, "l_suppkey").select("sid", "outcome"))
    return held.get(7).groupBy("sid", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SNK10", f"""SELECT o_orderkey AS sid, coalesce(n, 0)::BIGINT AS shots, (SELECT count(*) FROM orders WHERE {STATUS} = 'failed') AS sessions_deleted,
 (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {STATUS} = 'failed') AS shots_deleted
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey WHERE {STATUS} <> 'failed'""")
def delete_session(spark, sf):
    """Both tables are written, the failed sessions deleted from them, and the tables read back."""
    kept, attempts = session_store(spark, "sessions"), session_store(spark, "shots")
    kept.replace(sessions(spark, sf))
    attempts.replace(shots(spark, sf).select("sid", "outcome"))
    n_sessions, n_shots = store.delete_sessions(kept, attempts, kept.rows().filter("status = 'failed'"))
    left = attempts.rows().groupBy("sid").agg(F.count(F.lit(1)).alias("shots"))
    rows = kept.rows().select("sid").join(left, "sid", "full")
    return rows.select("sid", F.coalesce("shots", F.lit(0)).cast("long").alias("shots"), F.lit(n_sessions).cast("long").alias("sessions_deleted"), F.lit(n_shots).cast("long").alias("shots_deleted"))


@query("SNK11", f"""WITH s AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE {STATUS} END AS status, o_orderkey % 10 = 0 AS told FROM orders)
SELECT CASE WHEN status = 'processing' THEN 'interrupted' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'reconciled' WHEN told THEN 'unreadable media' END AS message, count(*) AS n,
 (SELECT count(*) FROM s WHERE told) AS marked, (SELECT count(*) FROM s WHERE status = 'processing') AS reconciled FROM s GROUP BY 1, 2""")
def reconcile(spark, sf):
    """Failure marks, then the orphans, both written to the session table, which is read back."""
    held = session_store(spark, "sessions")
    held.replace(sessions(spark, sf))
    lost = held.rows().filter("sid % 10 = 0").select("sid", F.lit("unreadable media").alias("error_message"))
    marked = store.mark_failed(held, lost)
    reconciled = store.reconcile_table(held)
    message = F.when(c("error_message") == store.INTERRUPTED, "reconciled").otherwise(c("error_message")).alias("message")
    rows = held.rows().groupBy("status", message).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns({"marked": F.lit(marked).cast("long"), "reconciled": F.lit(reconciled).cast("long")})


@query("SNK12", f"""SELECT CASE WHEN {STATUS} <> 'completed' THEN 'skipped_not_completed' WHEN NOT o_totalprice > 100000 THEN 'skipped_no_report' WHEN o_custkey % 3 = 0 THEN 'already_done' ELSE 'updated' END AS backfill, count(*) AS sessions,
 count(*) FILTER ({STATUS} = 'completed' AND o_totalprice > 100000 AND o_custkey % 3 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS recomputed FROM orders GROUP BY 1""")
def backfill(spark, sf):
    s = sessions(spark, sf)
    done = writers.backfill(s, shots(spark, sf), lambda rows: coaching(rows, ["sid"], SHOT_METRICS)).select("sid", F.lit(1).alias("_d"))
    plan = writers.backfill_plan(s).join(done, "sid", "left")
    return plan.groupBy("backfill").agg(F.count(F.lit(1)).alias("sessions"), F.count("_d").alias("recomputed"))


@query("SNK13", "SELECT o_orderkey AS sid, replace(lower(o_orderpriority), ' ', '_') AS told, 0::BIGINT AS changed_elsewhere FROM orders")
def regenerate(spark, sf):
    before = table(spark, sf, "orders").select(c("o_orderkey").alias("sid"), "o_orderdate", c("o_orderpriority").alias("told"))
    after = writers.regenerate_field(before, "told", F.replace(F.lower("told"), F.lit(" "), F.lit("_")))
    touched = writers.changed_elsewhere(before, after, "told").groupBy("sid").agg(F.count(F.lit(1)).alias("changed_elsewhere"))
    return after.select("sid", "told").join(touched, "sid", "left").select("sid", "told", F.coalesce("changed_elsewhere", F.lit(0)).cast("long").alias("changed_elsewhere"))


# ------------------------------------------------------------------------- streams


def event_stream(spark, sf):
    ev = streams.read_table_stream(spark, sf, "events")
    return ev.select(c("user_id").alias("sid"), "event_id", c("ts").cast("timestamp").alias("event_ts"), "value", F.expr(_SOURCE).alias("source"), F.from_json("props", "k INT")["k"].cast("double").alias("x"))


#: What a drained stream has handed out: rows up to the watermark, one day before the last row.
PASSED_SQL = f"passed AS (SELECT user_id AS sid, *, {_SOURCE} AS source FROM events WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 86400000 FROM events))"
PASSED_OBS_SQL = """ob AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) - 1 AS i FROM passed),
obs AS (SELECT sid, i, epoch_us(ts) / 1e6::DOUBLE AS t, CAST(json_extract(props, '$.k') AS DOUBLE) AS zx, value AS zy, 8.0::DOUBLE AS zr, 0.5::DOUBLE AS zc, source = 'detected' AS seen FROM ob)"""


@query("STR01", with_(PASSED_SQL, PASSED_OBS_SQL, TRACK_SQL, recursive=True) + """SELECT sid, event_id AS frame_index, t AS timestamp_sec, CASE WHEN NOT live OR m > 6 THEN 'unavailable' WHEN ok THEN 'detected' WHEN m <= 3 THEN 'interpolated' ELSE 'predicted' END AS source,
 CASE WHEN live AND m <= 6 THEN round(CASE WHEN ok THEN zx ELSE x END, 4) END AS x, CASE WHEN live AND m <= 6 THEN round(CASE WHEN ok THEN zy ELSE y END, 4) END AS y,
 round(CASE WHEN NOT live OR m > 6 THEN 0.0 WHEN ok THEN zc ELSE 0.3 * (1 - m / 7.0) END::DOUBLE, 4) AS confidence, round(coalesce(r, 8.0), 7) AS radius
FROM (SELECT sid, i, live, ok, m, x, y, r FROM kf) JOIN (SELECT sid, i, t, zx, zy, zc FROM obs) USING (sid, i) JOIN (SELECT sid, i, event_id FROM ob) USING (sid, i)""")
def stream_track(spark, sf):
    """Stateful tracking per user; the batch operator EPI01 runs the same fold."""
    from kinetable.operators.track import TrackFold

    ev = event_stream(spark, sf)
    box = F.array(F.struct("x", c("value").alias("y"), F.lit(8.0).alias("radius"), F.lit(0.5).alias("confidence")))
    rows = ev.select("sid", "event_ts", c("event_id").alias("frame_index"), (F.unix_micros("event_ts") / F.lit(1e6)).alias("timestamp_sec"), F.when(c("source") == "detected", box).alias("candidates"))
    out = streams.run_to_table(fold_stream(rows, TrackFold(), ["sid"], "timestamp_sec", "1 day", 86_400_000), "append", "track")
    return out.select("sid", "frame_index", "timestamp_sec", "source", *[F.round(n, d).alias(n) for n, d in (("x", 4), ("y", 4), ("confidence", 4), ("radius", 7))])


PASSED_ROWS_SQL = """sr0 AS (SELECT sid, epoch_us(ts) // 3600000000 AS f, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS i, source <> 'unavailable' AS av, held AS near, value < 40 AS burst, value < 20 AS rising, NOT held AS apart,
  source IN ('detected', 'interpolated') AS observed, (180 - (event_id * 13) % 60)::DOUBLE AS knee, 0.0::DOUBLE AS hip FROM (SELECT *, (epoch_us(ts) // 86400000000) % 2 = 0 AS held FROM passed))"""
OPEN_SQL = """prior AS (SELECT sid, f, why, lag(bg) OVER w AS bg, lag(ld) OVER w AS ld, lag(up) OVER w AS up, lag(rel) OVER w AS rel, lag(inf) OVER w AS inf FROM sm WINDOW w AS (PARTITION BY sid ORDER BY i)),
tagged AS (SELECT *, CASE WHEN f - rel < 6 AND why <> 'long' THEN ['short_duration'] ELSE [] END AS short FROM prior WHERE why IS NOT NULL)"""


@query("STR02", with_(PASSED_SQL, PASSED_ROWS_SQL, SEGMENT_SQL, OPEN_SQL, recursive=True) + """SELECT sid, bg AS start_frame, f AS end_frame, ld AS load_start_frame, up AS upward_start_frame, rel AS release_candidate_frame, f AS flight_end_frame,
 list_concat(CASE why WHEN 'settled' THEN [] WHEN 'dropout' THEN ['closed_after_prolonged_ball_tracking_dropout'] ELSE ['max_duration_exceeded'] END, short, CASE WHEN inf THEN ['load_phase_inferred_from_pose_only_ball_not_tracked_near_hand'] ELSE [] END) AS warnings FROM tagged""")
def stream_segment(spark, sf):
    """Stateful segmentation; rows are derived per event, without look-back columns."""
    from kinetable.operators.segment import SegmentFold

    ev = event_stream(spark, sf)
    held = F.pmod(F.floor(F.unix_seconds("event_ts") / 86400), F.lit(2)) == 0
    rows = ev.select(
        "sid", "event_ts", F.unix_micros("event_ts").alias("order"), (F.unix_seconds("event_ts") / 3600).cast("long").alias("frame_index"), (c("source") != "unavailable").alias("ball_available"),
        held.alias("near"), (c("value") < 40).alias("burst"), (c("value") < 20).alias("rising"), (~held).alias("apart"), c("source").isin("detected", "interpolated").alias("ball_is_observed"),
        (F.lit(180.0) - F.pmod(c("event_id") * 13, F.lit(60))).alias("knee_angle_deg"), F.lit(0.0).alias("hip_x_norm"),
    )
    return streams.run_to_table(fold_stream(rows, SegmentFold(), ["sid"], "order", "1 day", 86_400_000), "append", "segment")


@query("STR04", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", CASE event_type WHEN 'view' THEN 'detected' WHEN 'purchase' THEN 'detected' WHEN 'click' THEN 'interpolated' WHEN 'signup' THEN 'predicted' ELSE 'unavailable' END AS source, count(*) AS n FROM events GROUP BY ALL""")
def stream_windows(spark, sf):
    out = streams.run_to_table(streams.window_mix(event_stream(spark, sf), "event_ts", [], "1 day"), "complete", "mix")
    return out.withColumns({"start": c("start").cast("timestamp_ntz"), "end": c("end").cast("timestamp_ntz")})


@query("STR05", """WITH w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 DAY AS watermark FROM events WHERE event_id % 4 <> 0)
SELECT user_id AS sid, count(*) AS rows_kept, min(event_id) AS first_id, max(event_id) AS last_id, count(*) FILTER (event_id % 4 = 0) AS second_kept FROM events, w WHERE event_id % 4 <> 0 OR ts > watermark GROUP BY user_id""")
def stream_late(spark, sf):
    """Two deliveries: the second brings rows of all days and repeats of the first.

    Of the second, what lies behind the watermark that the first one left (its last time less ten
    days) is late and dropped, and repeats are dropped by their key.
    """
    folder, path = scratch_folder(spark, "deliveries"), scratch_folder(spark, "late")
    ev = table(spark, sf, "events").select(c("user_id").alias("sid"), "event_id", c("ts").cast("timestamp").alias("event_ts"))
    part = F.pmod("event_id", F.lit(4))
    for delivery in (ev.filter(part != 0), ev.filter(part <= 1)):
        delivery.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ev.schema).parquet(folder)
        out = streams.run_to_table(streams.dedupe_frames(stream, "event_ts", ["event_id"], "10 days"), "append", path=path)
    return out.groupBy("sid").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_if(F.pmod("event_id", F.lit(4)) == 0).alias("second_kept")
    )


@query("STR06", "SELECT user_id AS sid, day(ts)::INTEGER AS day, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL")
def stream_dedupe(spark, sf):
    kinds = streams.read_table_stream(spark, sf, "events").select(c("user_id").alias("sid"), F.dayofmonth("ts").alias("day"), "event_type", c("ts").cast("timestamp").alias("event_ts"))
    out = streams.run_to_table(streams.dedupe_frames(kinds, "event_ts", ["sid", "day", "event_type"], "60 days"), "append", "dedupe")
    return out.groupBy("sid", "day").agg(F.count(F.lit(1)).alias("kinds"))


@query("STR07", "SELECT user_id AS sid, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY user_id")
def stream_upsert(spark, sf):
    return streams.upsert_summary(
        event_stream(spark, sf), ["sid"], {"n": F.count(F.lit(1)), "top": F.max("value")}, {"n": F.sum("n"), "top": F.max("top")}
    ).withColumn("top", F.round("top", 4))


@query("STR08", "SELECT e.event_id, c.c_nationkey FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def stream_dimension(spark, sf):
    dim = table(spark, sf, "customer").select(c("c_custkey").alias("sid"), "c_nationkey")
    out = streams.run_to_table(streams.join_dimension(event_stream(spark, sf), dim, ["sid"]), "append", "dim")
    return out.select("event_id", "c_nationkey")


# ------------------------------------------------------------------ extension points


@query("UDF1", with_(shots_sql("l_suppkey")) + "SELECT sid, count(*) AS n, round(avg(sqrt(l_extendedprice * l_quantity)), 3) AS mean_value FROM shots WHERE NOT excluded_from_analysis GROUP BY sid")
def added_metric(spark, sf):
    """A metric added to the registry is picked up by the statistics."""
    from kinetable.plans.registry import Metric
    from kinetable.plans.session_stats import consistency

    extra = Metric("volume_root", "Volume root", "units", "sqrt(l_extendedprice * l_quantity)")
    rows = consistency(shots(spark, sf, "l_suppkey"), ["sid"], [*SHOT_METRICS, extra])
    return rows.filter("metric_key = 'volume_root'").select("sid", "n", "mean_value")


@query("UDF2", "SELECT CASE WHEN event_type IN ('view','click') THEN 'first' ELSE 'second' END AS source, count(*) AS n, round(avg(value), 4) AS mean_y FROM events GROUP BY 1")
def pluggable_source(spark, sf):
    """Two candidate sources with one row format are pooled."""
    from kinetable.operators.curation import pool

    ev = table(spark, sf, "events")
    first = c("event_type").isin("view", "click")
    pooled = pool({"first": ev.filter(first).select("event_id", "value"), "second": ev.filter(~first).select("event_id", "value")})
    return pooled.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_y"))


@query("UDF3", with_(FRAMES_SQL) + "SELECT sid, frame_index // 12 AS shot_index, CASE WHEN min(y) < 20 THEN 'made' ELSE 'missed' END AS base_outcome, CASE WHEN min(x) < 20 THEN 'made' ELSE 'missed' END AS other_outcome, (min(y) < 20) <> (min(x) < 20) AS changed FROM frames GROUP BY ALL")
def pluggable_classifier(spark, sf):
    """Any two functions from points to outcomes can be compared."""
    from kinetable.catalog.base import flight_points, hoops
    from kinetable.operators.outcome import compare_classifiers

    def rule(column):
        def classify(points, _hoops):
            made = F.when(F.min(column) < 20, "made").otherwise("missed").alias("outcome")
            return points.groupBy("sid", "shot_index").agg(made).withColumns({"outcome_confidence": F.lit(1.0), "outcome_reason": F.lit(column)})

        return classify

    out = compare_classifiers(flight_points(spark, sf), hoops(spark, sf), rule("y"), rule("x"))
    return out.select("sid", "shot_index", "base_outcome", "other_outcome", "changed")


@query("UDF4", with_(FRAMES_SQL, SIGNALS_SQL, TRUSTED_S, PAIRS_SQL, CTRL_SQL, recursive=True) + """SELECT ct.sid, f AS frame_index,
 coalesce(lag(st) OVER (PARTITION BY ct.sid ORDER BY ct.i), 'uncontrolled') AS state_before, st AS state_after FROM ct JOIN pr ON pr.sid = ct.sid AND pr.i = ct.i""")
def traced_release(spark, sf):
    """Optional trace output of the release detector."""
    from kinetable.operators.releases import release_trace

    return release_trace(signals(spark, sf, True), F.lit(TORSO_PX))


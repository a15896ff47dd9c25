"""Joins with failure rules, recovery, ROI motion, storage and streams."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from kinetable.operators import curation as cu
from kinetable.operators import joins as jn
from kinetable.operators.ordered import Series
from kinetable.operators.recovery import enrich, recover_points
from kinetable.operators.roi_motion import roi_motion
from kinetable.operators.track import TrackFold, track
from kinetable.sources import readers, store, writers
from kinetable.streaming import streams
from kinetable.streaming.stateful import fold_stream


def test_overlay_truth_counts_and_mismatch(spark):
    auto = spark.createDataFrame([(i, "made" if i < 6 else "unknown") for i in range(11)], "shot_index long, outcome string")
    truth = spark.createDataFrame([(i, "made" if i < 8 else "missed") for i in range(11)], "shot_index long, outcome string")
    out = jn.overlay_truth(auto, truth, ["shot_index"])
    made = out.filter("verified_label = 'made'").count()
    assert made == 8 and round(100 * made / 11, 1) == 72.7 and out.filter("automatic_label = 'made'").count() == 6
    with pytest.raises(Exception, match="different keys"):
        jn.overlay_truth(auto, truth.filter("shot_index < 10"), ["shot_index"]).collect()


def test_one_to_one_keeps_the_nearer(spark):
    pred = spark.createDataFrame([("v", 1, 10.0), ("v", 2, 10.9), ("v", 3, 50.0)], "sid string, p long, pt double")
    truth = spark.createDataFrame([("v", 1, 10.8), ("v", 2, 90.0)], "sid string, t long, tt double")
    rows = jn.match_one_to_one(pred, truth, ["sid"], "pt", "p", "tt", "t", 5.0, "floor(_t / 20)").collect()
    assert sorted((r["kind"], r["pred_id"], r["truth_id"]) for r in rows if r["kind"] == "matched") == [("matched", 2, 1)]
    assert {r["pred_id"] for r in rows if r["kind"] == "false_positive"} == {1, 3}
    assert {r["truth_id"] for r in rows if r["kind"] == "false_negative"} == {2}


def test_nearest_equals_brute_force_across_blocks(spark):
    pred = [("v", i, float((i * 37) % 101)) for i in range(40)]
    truth = [("v", i, float((i * 53) % 97) + 0.5) for i in range(25)]
    got = jn.match_nearest(
        spark.createDataFrame(pred, "sid string, p long, pt double"), spark.createDataFrame(truth, "sid string, t long, tt double"),
        ["sid"], "pt", "p", "tt", "t", 3.0, "floor(_t / 7)",
    ).collect()
    for r in got:
        best = min(truth, key=lambda q: (abs(q[2] - r["pt"]), q[1]))
        want = best[1] if abs(best[2] - r["pt"]) < 3.0 else None
        assert (r["match"]["id"] if r["match"] else None) == want


def test_interval_join_equals_brute_force(spark):
    pts = [("s", i) for i in range(60)]
    wins = [("s", k, 7 * k, 7 * k + 12) for k in range(8)]
    got = jn.interval_join(spark.createDataFrame(pts, "sid string, f long"), spark.createDataFrame(wins, "sid string, w long, lo long, hi long"), ["sid"], "f", "lo", "hi", block=5)
    assert sorted((r["f"], r["w"]) for r in got.collect()) == sorted((f, w) for _, f in pts for _, w, lo, hi in wins if lo <= f <= hi)


BALL = "sid string, frame_index long, timestamp_sec double, x double, y double, radius double, confidence double, source string"


def test_recovery_finds_planted_flight(spark):
    place = lambda f: (100 + 4.0 * f, 200 - 10.0 * f + 0.35 * f * f)
    known = [("s", f, f / 30, *place(f), 6.0, 0.9, "detected") for f in range(10)]
    hidden = [("s", f, f / 30, None, None, 6.0, 0.0, "unavailable") for f in range(10, 20)]
    cands = [("s", f, f / 30, *place(f), 6.0, 0.4, f) for f in range(10, 20)] + [("s", f, f / 30, 600.0, 20.0, 6.0, 0.9, 100 + f) for f in range(10, 20)]
    ball = spark.createDataFrame(known + hidden, BALL)
    windows = spark.createDataFrame([("s", 1, 5, 19)], "sid string, shot_index long, start_frame long, end_frame long")
    candidates = spark.createDataFrame(cands, "sid string, frame_index long, timestamp_sec double, x double, y double, radius double, confidence double, cand_id long")
    hoops = spark.createDataFrame([("s", 18.0)], "sid string, hoop_r double")
    got = recover_points(windows, ball, candidates, hoops)
    rows = got.orderBy("frame_index").collect()
    assert [r["frame_index"] for r in rows] == list(range(10, 20)) and all(r["x"] < 300 for r in rows)
    assert rows[0]["confidence"] == pytest.approx(0.6)
    base = ball.withColumn("shot_index", F.lit(1).cast("long"))
    assert enrich(base, got).filter("source = 'detected'").count() == 20


def test_recovery_rejects_static_repeats(spark):
    known = [("s", f, f / 30, 100.0 + 4 * f, 100.0, 6.0, 0.9, "detected") for f in range(5)]
    cands = [("s", f, f / 30, 120.0, 100.0, 6.0, 0.4, f) for f in range(5, 12)]
    ball = spark.createDataFrame(known, BALL)
    windows = spark.createDataFrame([("s", 1, 3, 12)], "sid string, shot_index long, start_frame long, end_frame long")
    candidates = spark.createDataFrame(cands, "sid string, frame_index long, timestamp_sec double, x double, y double, radius double, confidence double, cand_id long")
    out = recover_points(windows, ball, candidates, spark.createDataFrame([("s", 18.0)], "sid string, hoop_r double"))
    assert out.count() in (0, 3)


def test_roi_motion_is_relative(spark):
    base = [10.0] * 64
    local, everywhere = list(base), [v + 20 for v in base]
    for i in (19, 20, 27, 28, 35, 36, 43, 44):
        local[i] += 30
    rows = [("local", 0, base), ("local", 1, local), ("bright", 0, base), ("bright", 1, everywhere), ("still", 0, base), ("still", 1, base)]
    df = spark.createDataFrame(rows, "sid string, frame_index long, gray array<double>")
    box = lambda *v: [F.lit(i) for i in v]
    none = F.lit(None).cast("struct<x: int, y: int, r: double, source: string>"), F.lit(None).cast("struct<x1: int, y1: int, x2: int, y2: int>")
    got = {r["sid"]: r for r in roi_motion(df, Series.frames(["sid"]), "gray", 8, box(3, 2, 5, 6), [box(0, 2, 2, 6), box(6, 2, 8, 6)], *none).collect()}
    assert got["local"]["relative_motion"] > 1 and got["bright"]["relative_motion"] == pytest.approx(1.0) and got["still"]["target_motion"] == 0
    ball = F.struct(F.lit(4).alias("x"), F.lit(4).alias("y"), F.lit(9.0).alias("r"), F.lit("detected").alias("source"))
    masked = roi_motion(df, Series.frames(["sid"]), "gray", 8, box(3, 2, 5, 6), [box(0, 2, 2, 6)], ball, none[1]).filter("sid = 'local'").first()
    assert masked["target_motion"] == 0 and masked["mask_source"] == "detected" and masked["mask_available"] is False


def test_finite_guard(spark):
    ok = spark.createDataFrame([(1.0, (2.0,))], "a double, s struct<b: double>")
    assert writers.assert_finite(ok).count() == 1
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="NaN or infinity"):
            writers.assert_finite(spark.createDataFrame([(1.0, (bad,))], "a double, s struct<b: double>")).collect()


def test_reports_have_one_shape(spark):
    rows = spark.createDataFrame([("a", i, 0.9, 0.8, 0.7) for i in range(5000)] + [("b", 0, 0.9, 0.8, None)], "sid string, t long, release_confidence double, pose_quality double, ball_track_quality double")
    lines = writers.to_report_json(rows, Series(["sid"], ["t"], "floor(t / 1000)"), ["t"])
    counts = {r["sid"]: r["count"] for r in lines.groupBy("sid").count().collect()}
    assert counts == {"a": 5001, "b": 2}
    assert lines.filter("line_no = 0 AND sid = 'a'").collect()[0]["line"] == '{"kind":"session","n_shots":5000}'


def test_orphans_and_backfill(spark):
    s = spark.createDataFrame(
        [(1, "processing", None, True, False), (2, "completed", None, True, False), (3, "failed", "x", True, False), (4, "completed", None, False, False), (5, "completed", None, True, True)],
        "sid long, status string, error_message string, has_report boolean, has_key boolean",
    )
    out = {r["sid"]: r for r in store.reconcile_orphans(s).collect()}
    assert out[1]["status"] == "interrupted" and out[3]["error_message"] == "x" and sum(r["changed"] for r in out.values()) == 1
    assert {r["sid"]: r["backfill"] for r in writers.backfill_plan(s).collect()}[2] == "updated"


def png(path, w, h, value):
    raw = b"".join(b"\x00" + bytes([value, value, value] * w) for _ in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_frames_and_media_inventory(spark, tmp_path):
    png(tmp_path / "a.png", 3, 2, 77)
    (row,) = readers.read_frames(spark, str(tmp_path)).collect()
    assert (row["width"], row["height"]) == (3, 2) and row["gray"] == [77.0] * 6 and row["valid"]
    (item,) = readers.media_inventory(spark, str(tmp_path)).collect()
    assert item["size_bytes"] > 0
    png(tmp_path / "large.png", 1920, 1080, 5)
    (tmp_path / "broken.png").write_bytes(b"not an image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_frames(spark, str(tmp_path)).selectExpr("path", "valid", "size(gray) AS n").collect()}
    assert got["large.png"]["n"] == 1920 * 1080 and not got["broken.png"]["valid"] and len(got) == 3


def test_trace_reader_drops_unavailable(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("frame_index,timestamp_sec,pose_detected,pose_confidence,ball_source,ball_x,ball_y,ball_confidence\n0,0.0,true,0.9,detected,1.0,2.0,0.8\n1,0.03,true,0.9,strange,1.0,2.0,0.8\n2,0.07,true,0.9,predicted,,,0.1\n")
    (row,) = readers.read_frame_trace(spark, str(p)).collect()
    assert (row["frame_index"], row["source"], row["radius"]) == (0, "detected", 10.0)


def test_sample_frames_forces_last(spark):
    df = spark.createDataFrame([(0, 100), (5, 5), (0, 10)], "lo int, hi int")
    got = [r[0] for r in df.select(cu.sample_frames(F.col("lo"), F.col("hi"))).collect()]
    assert got[0][-1] == 100 and len(got[0]) <= 27 and got[1] == [5] and got[2] == list(range(11))


def test_stream_track_equals_batch(spark, tmp_path):
    rows = [("a", i, i / 30, (50.0 + i, 60.0) if i % 4 else None) for i in range(60)] + [("b", i, i / 30, (10.0, 20.0 + i)) for i in range(60)]
    data = [(s, f, t, None if p is None else [(p[0], p[1], 5.0, 0.5)]) for s, f, t, p in rows]
    df = spark.createDataFrame(data, "sid string, frame_index long, timestamp_sec double, candidates array<struct<x: double, y: double, radius: double, confidence: double>>")
    stamped = df.withColumn("event_ts", F.timestamp_millis((F.col("timestamp_sec") * 1000).cast("long") + 1_700_000_000_000))
    src = str(tmp_path / "in")
    stamped.orderBy(F.rand(3)).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(stamped.schema).parquet(src)
    out = streams.run_to_table(fold_stream(stream, TrackFold(), ["sid"], "frame_index", "0 seconds", 60_000))
    want = {(r["sid"], r["frame_index"]): r for r in track(df).collect()}
    got = {(r["sid"], r["frame_index"]): r for r in out.collect()}
    assert len(got) >= 118 and all(got[k]["source"] == want[k]["source"] and got[k]["x"] == want[k]["x"] for k in got)


def test_stream_gap_sessions(spark, tmp_path):
    ts = [0, 5, 8, 100, 103, 400]
    df = spark.createDataFrame([("a", t) for t in ts], "sid string, s long").select("sid", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("event_ts"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = streams.run_to_table(streams.gap_sessions(stream, "event_ts", ["sid"], "30 seconds", "0 seconds"))
    assert sorted(r["n"] for r in out.collect()) == [2, 3]


def test_late_and_repeated_rows_of_a_second_delivery(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda rows: spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("event_ts"))
    for rows in ([(1, 0), (2, 500), (3, 1000)], [(2, 500), (4, 100), (5, 950), (6, 2000)]):
        at(rows).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(at(rows).schema).parquet(folder)
        got = streams.run_to_table(streams.dedupe_frames(stream, "event_ts", ["k"], "600 seconds"), path=out)
    assert sorted(r["k"] for r in got.collect()) == [1, 2, 3, 5, 6]


def test_recovery_chain_does_not_slice_tables_by_frame(monkeypatch):
    import pandas as pd

    from kinetable.operators.recovery import chain

    rows = [(f, f / 30, 10.0 * f + off, 50.0, 5.0, 0.5, i) for f in range(1, 6) for i, off in enumerate((0.0, 90.0))]
    cands = pd.DataFrame(rows, columns=["frame_index", "timestamp_sec", "x", "y", "radius", "confidence", "cand_id"]).sample(frac=1, random_state=2)
    cands = cands.assign(seed_t=0.0, seed_x=0.0, seed_y=50.0, prev_t=-1 / 30, prev_x=-10.0, prev_y=50.0, hoop_r=12.0, vmax=300.0)
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    assert [(f, x) for _, x, _, f, _, _ in chain(cands)] == [(f, 10.0 * f) for f in range(1, 6)]


def test_report_lines_are_compressed(spark, tmp_path):
    from kinetable.sources import writers

    shots = spark.createDataFrame([(1, 1, 0.9, 0.8, 0.7)], "sid long, shot_index long, release_confidence double, pose_quality double, ball_track_quality double")
    writers.write_session_report(spark.createDataFrame([(1, "x")], "sid long, note string"), shots, str(tmp_path / "r"))
    assert {p.suffix for p in (tmp_path / "r").glob("part-*")} == {".gz"} and spark.read.text(str(tmp_path / "r")).count() == 2


def test_recovery_streams_many_attempts_without_a_table_each(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    import numpy as np

    from kinetable.operators.recovery import ChainMachine, _misfit

    place = lambda s, f: (100 + s + 4.0 * f, 200 - 10.0 * f + 0.35 * f * f)
    known = [(s, f, f / 30, *place(s, f), 6.0, 0.9, "detected") for s in range(40) for f in range(10)]
    cands = [(s, f, f / 30, *place(s, f), None if s == 1 else 6.0, 0.4, f) for s in range(40) for f in range(10, 20 if s else 12)] + [(2, 12, 12 / 30, None, 0.0, 6.0, 0.9, 0), (3, 15, 15 / 30, *place(3, 15), 6.0, None, 99)]
    ball = spark.createDataFrame(known, BALL.replace("sid string", "sid long"))
    windows = spark.createDataFrame([(s, 1, 5, 19) for s in range(40)], "sid long, shot_index long, start_frame long, end_frame long")
    candidates = spark.createDataFrame(cands, "sid long, frame_index long, timestamp_sec double, x double, y double, radius double, confidence double, cand_id long")
    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rows = recover_points(windows, ball, candidates, spark.createDataFrame([(s, 18.0) for s in range(40)], "sid long, hoop_r double")).collect()
    frames = {s: sorted(r["frame_index"] for r in rows if r["sid"] == s) for s in range(40)}
    assert frames[0] == [] and all(frames[s] == list(range(10, 20)) for s in range(1, 40) if s != 2)
    assert frames[2] == [10, 11, *range(13, 20)]  # a frame with a candidate that has no place is passed over
    assert {r["radius"] for r in rows if r["sid"] == 1} == {None} and {r["x"] for r in rows if r["frame_index"] == 15} == {place(s, 15)[0] for s in range(1, 40)}
    assert ChainMachine().end() == []
    rng = np.random.default_rng(5)
    for n in range(5, 20):
        t, x, y = np.arange(n) / 30, rng.uniform(0, 100, n), rng.exponential(50, n)
        assert (_misfit(t, x, y) == np.hypot(x - np.polyval(np.polyfit(t, x, 1), t), y - np.polyval(np.polyfit(t, y, 2), t))).all()

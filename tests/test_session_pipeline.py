"""Detections and poses to every report table, on planted sessions."""

import pytest

from kinetable.plans import session_pipeline as sp
from kinetable.sources import readers, writers

W, H, FPS = 640, 360, 30.0
HOOP = (500.0, 80.0, 18.0)
JOINTS = (
    "nose", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
    "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
JOINT = "struct<x: double, y: double, z: double, visibility: double>"
POSE = f"sid string, frame_index long, timestamp_sec double, detected boolean, joints struct<{', '.join(f'{j}: {JOINT}' for j in JOINTS)}>, box_id long"
BALL = "sid string, frame_index long, timestamp_sec double, id long, x double, y double, radius double, confidence double"


def body(wrist, knee_y):
    """One pose: the right arm holds the object, the legs bend with the knees' height."""
    at = {j: (0.31, 0.1, 0.9) for j in JOINTS}
    for side, x in (("left", 0.28), ("right", 0.34)):
        at |= {f"{side}_shoulder": (x, 0.35, 0.9), f"{side}_hip": (x, 0.55, 0.9), f"{side}_knee": (x + 0.06, knee_y, 0.9), f"{side}_ankle": (x, 0.95, 0.9)}
    at |= {"right_elbow": (0.4, 0.4, 0.9), "right_wrist": (*wrist, 0.9), "left_elbow": (0.22, 0.4, 0.3), "left_wrist": (0.18, 0.4, 0.3)}
    return tuple((x, y, 0.0, v) for x, y, v in (at[j] for j in JOINTS))


def attempt(flight, dips):
    """Poses and object places, frame by frame: held, bent, raised, flown, held again."""
    hand = (0.36 * W, 0.42 * H)
    rows = [((0.36, 0.42), 0.75, hand, 0.85)] * 3
    rows += [((0.36, 0.42), k, hand, 0.85) for k in dips]
    rows += [((0.36, 0.30), 0.7, (hand[0], hand[1] - 15), 0.85)] * 4
    rows += [((0.36, 0.30), 0.7, (x, y), conf) for x, y, conf in flight]
    return rows + [((0.36, 0.42), 0.75, hand, 0.85)] * 8


HAND = (0.36 * W, 0.42 * H)
TOP, STEPS = 9, 16


def arc(speed):
    """A parabola from the hand, its top at the ninth frame."""
    return [(HAND[0] + speed * t, 10 + 1.74 * (t - TOP) ** 2, 0.85) for t in range(1, STEPS)]


# Through the rim the object slows down and falls; one point is half hidden.
MADE = arc(17.8) + [(502.0, 97.0, 0.35), (504.0, 120.0, 0.85), (505.0, 145.0, 0.85), (506.0, 172.0, 0.85)]
FAR = arc(24.0) + [(622.0, 97.0, 0.85), (646.0, 122.0, 0.85), (670.0, 151.0, 0.85), (694.0, 183.0, 0.85)]


def inputs(spark, drop=(), people=False):
    """Session ``s`` with two attempts, ``t`` without a target.  ``drop`` are flight frames of the first attempt that only the second search sees."""
    frames, balls, poses, gaps, boxes = [], [], [], [], []
    for sid in ("s", "t"):
        rows = attempt(MADE, (0.78, 0.84, 0.90, 0.84, 0.78)) + attempt([], (0.75,) * 5) + attempt(FAR, (0.77, 0.82, 0.87, 0.82, 0.77))
        for i, (wrist, knee, (x, y), conf) in enumerate(rows):
            t, own = i / FPS, 12 <= i < 12 + len(MADE)
            frames.append((sid, i, t))
            row = (sid, i, t, i, float(x), float(y), 10.0, conf)
            (gaps if own and i - 12 in drop else balls).append(row)
            poses.append((sid, i, t, True, body(wrist, knee), 1))
            if people:
                poses.append((sid, i, t, True, body((0.9, 0.9), 0.7), 2))
                boxes += [(sid, i, 1, 150.0, 60.0, 260.0, 350.0), (sid, i, 2, 500.0, 200.0, 540.0, 300.0)]
    targets = [("s", i * 5, i, HOOP[0] + i % 3 - 1, HOOP[1] + i % 2, HOOP[2], 0.75, "learned") for i in range(8)]
    df = spark.createDataFrame
    return sp.Inputs(
        df(frames, "sid string, frame_index long, timestamp_sec double"), df(balls, BALL), df(poses, POSE), df(targets, "sid string, frame_index long, id long, x double, y double, radius double, confidence double, source string"),
        W, H, df(boxes, "sid string, frame_index long, id long, x1 double, y1 double, x2 double, y2 double") if people else None, df(gaps, BALL),
    )


def test_planted_attempts_reach_the_report(spark, tmp_path):
    given = inputs(spark, people=True)
    out = sp.run_sessions(given)
    shots = {(r["sid"], r["shot_index"]): r for r in out.shots.collect()}
    assert {k for k in shots if k[0] == "s"} == {("s", 1), ("s", 2)}
    assert (shots["s", 1]["outcome"], shots["s", 2]["outcome"]) == ("made", "missed")
    assert all(r["shooting_side"] == "right" and r["release_frame"] is not None for r in shots.values())
    # the second person's pose, far from the object, is never used
    assert shots["s", 1]["mechanics"]["knee_angle_at_load_deg"] < 170
    # the apex is measured by the torso in the release frame
    torso = 0.2 * H
    first = shots["s", 1]
    y = {r["frame_index"]: r["y"] for r in out.track.filter("sid = 's'").collect()}
    top = min(v for f, v in y.items() if first["release_frame"] <= f <= first["end_frame"] and v is not None)
    assert first["trajectory"]["apex_height_norm"] == pytest.approx((y[first["release_frame"]] - top) / torso, abs=2e-3)
    # without a target nothing is decided, and the session is told so
    assert all(shots[k]["outcome"] == "unknown" for k in shots if k[0] == "t")
    report = {r["sid"]: r for r in sp.session_report(out, given.frames).collect()}
    assert report["t"]["target"] is None and "target_not_located" in report["t"]["warnings"] and "target_not_located" not in report["s"]["warnings"]
    s = report["s"]
    assert s["summary"]["total_shots_detected"] == 2 and s["summary"]["shooting_percentage"] == 50.0 and s["target"]["votes"] == 8
    assert [m["metric_pos"] for m in s["consistency"]] == list(range(13)) == [m["metric_pos"] for m in s["makes_vs_misses"]]
    # the written report reads back as it was
    path = str(tmp_path / "report")
    whole = sp.session_report(out, given.frames)
    writers.write_session_report(whole, out.shots, path)
    heads, lines = readers.read_session_report(spark, path, "sid STRING")
    rows = lambda df: sorted((r.asDict(True) for r in df.collect()), key=lambda r: (r["sid"], r.get("shot_index", 0)))
    assert rows(heads) == rows(whole)
    assert [{k: v for k, v in r.items() if k != "overall_confidence_level"} for r in rows(lines)] == rows(out.shots)
    assert s["trends"] == [] and s["findings"] and s["coaching"]["eligible"] is not None


def test_recovered_points_decide_the_outcome_and_nothing_else(spark):
    given = inputs(spark, drop=range(9, 18))
    out = sp.run_sessions(given)
    back = out.recovered.filter("sid = 's'").collect()
    # the track bridges three frames by itself
    assert {r["frame_index"] for r in back} <= set(range(24, 30)) and len(back) >= 3 and all(r["source"] == "detected" and r["confidence"] <= 0.6 for r in back)
    assert out.recovered.filter("sid = 't'").count() == 0  # no target, nothing to search around
    blind = sp.build_shots(out.signals, given.poses, out.track, out.hoops, None, W, H, windows=out.windows)
    first = lambda shots: next(r for r in shots.collect() if (r["sid"], r["shot_index"]) == ("s", 1))
    with_, without = first(out.shots), first(blind)
    assert with_["trajectory"]["num_detected_points"] > without["trajectory"]["num_detected_points"]
    assert with_["ball_track_quality"] == without["ball_track_quality"] and with_["mechanics"] == without["mechanics"]
    assert without["outcome"] != "made"


def test_no_frames_give_no_sessions(spark):
    given = inputs(spark)
    for name in ("frames", "balls", "poses", "targets", "gaps"):
        setattr(given, name, getattr(given, name).limit(0))
    out = sp.run_sessions(given)
    assert out.shots.count() == 0 and sp.session_report(out, given.frames).count() == 0

"""Folds: block-wise runs equal whole-series runs; detectors against direct scans."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators import releases as rl
from kinetable.operators import segment as sg
from kinetable.operators import track as tr
from kinetable.operators import windows as win
from kinetable.operators.fold import Fold, fold_call, keyed_fold

LONG = "long"


def rows_of(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


def track_rows(n, seed):
    rng, out = random.Random(seed), []
    x, y = 50.0, 50.0
    for i in range(n):
        x, y = x + rng.uniform(-3, 5), y + rng.uniform(-3, 3)
        seen = rng.random() < 0.55
        cands = [dict(o=0, x=x, y=y, radius=5.0 + rng.random(), confidence=0.5)] if seen else None
        if seen and rng.random() < 0.2:
            cands.append(dict(o=1, x=x + 400, y=y, radius=4.0, confidence=0.9))
        out.append(("s", i, i / 30, cands))
    return out


TRACK = "sid string, frame_index long, timestamp_sec double, candidates array<struct<o: int, x: double, y: double, radius: double, confidence: double>>"


def test_track_in_blocks_equals_whole(spark):
    df = spark.createDataFrame(track_rows(120, 5), TRACK)
    whole = tr.track(df, block=F.lit(0)).orderBy("frame_index").toPandas()
    cut = tr.track(df, block=F.floor(F.col("frame_index") / 45)).orderBy("frame_index").toPandas()
    assert whole["source"].tolist() == cut["source"].tolist()
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-7)
    assert set(whole["source"]) >= {"detected", "interpolated"}


def signal_rows(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        phase = (i // 9) % 3
        near = phase == 0 or rng.random() < 0.1
        up = phase == 1
        out.append(
            ("s", i, rng.random() < 0.93, near, up and rng.random() < 0.8, up and rng.random() < 0.7, not near, rng.random() < 0.7,
             None if rng.random() < 0.1 else 175.0 - (30.0 if phase == 0 and i % 9 > 4 else 0.0) + rng.random(), rng.random())
        )
    return out


SEGMENT = "sid string, frame_index long, ball_available boolean, near boolean, burst boolean, rising boolean, apart boolean, ball_is_observed boolean, knee_angle_deg double, hip_x_norm double"


@pytest.mark.parametrize("seed", [1])
def test_segment_in_blocks_equals_whole(spark, seed):
    df = spark.createDataFrame(signal_rows(600, seed), SEGMENT)
    order = ["frame_index"]
    whole = keyed_fold(df, ["sid"], order, F.lit(0), sg.SegmentFold())
    cut = keyed_fold(df, ["sid"], order, F.floor(F.col("frame_index") / 200), sg.SegmentFold())
    assert rows_of(whole) == rows_of(cut)
    assert whole.count() > 3


class Echo(Fold):
    columns = ("frame_index", "id")
    schema = T.StructType([T.StructField("frame_index", T.LongType()), T.StructField("id", T.LongType())])

    def start(self):
        return 0

    def step(self, state, row):
        return state + 1, [row]


def test_large_integers_with_nulls_stay_exact(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([("s", i, None if i % 3 == 0 else big + i) for i in range(40)], "sid string, frame_index long, id long")
    for block in (F.lit(0), F.floor(F.col("frame_index") / 10)):
        got = {r["frame_index"]: r["id"] for r in keyed_fold(df, ["sid"], ["frame_index"], block, Echo()).collect()}
        assert got == {i: None if i % 3 == 0 else big + i for i in range(40)}


def test_ema_and_cooldown(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(25)], "sid string, frame_index long, v double")
    got = win.ema(df, ["sid"], ["frame_index"], "v", F.floor(F.col("frame_index") / 8)).orderBy("frame_index").collect()
    want = 0.0
    for r in got[1:]:
        want = 0.7 * want + 0.3 * r["frame_index"]
        assert r["ema"] == pytest.approx(want)
    ev = spark.createDataFrame([("s", f, w) for f, w in ((0, False), (5, False), (12, True), (60, False), (101, False), (103, False))], "sid string, frame_index long, weak boolean")
    kept = win.cooldown(ev, ["sid"], "frame_index", "weak", F.lit(0)).collect()
    assert sorted(r["frame_index"] for r in kept) == [0, 12, 103]


def pair_rows(n, seed):
    """Random pair evidence in the detectors' column order."""
    rng, out, y = random.Random(seed), [], 100.0
    for i in range(n):
        linked = rng.random() < 0.93
        v = rng.choice([-0.6, -0.4, -0.25, -0.1, 0.1, 0.3])
        sep = rng.choice([None, 0.1, 0.1, 0.3, 0.3, 0.3])
        apart = None if sep is None else sep > 0.18
        strong = linked and v <= -0.35
        above = rng.random() < 0.7
        path = ("strong" if apart else None) if strong else ("soft" if linked and apart and above and v <= -0.21 else None)
        y += v * 10
        out.append((i, i / 30, linked, v if linked else None, sep, apart, linked and apart is False and rng.random() < 0.6, path, strong, bool(strong and apart is False), linked and v <= 0, rng.random(), y))
    return pd.DataFrame(out, columns=rl.PAIR_COLUMNS).astype(object)


def direct_trajectories(p):
    """Index-based scan: arm on three qualifying pairs, follow the rise, resume after it."""
    r, out, streak, veto, override, i = p.to_dict("records"), [], [], 0, False, 0
    while i < len(r):
        e = r[i]
        if not e["linked"]:
            streak, veto, override, i = [], 0, False, i + 1
            continue
        how = None
        if override:
            how = "strong_veto_override" if e["strong"] else None
        elif e["strong"] and e["separated"] is False:
            veto += 1
            if veto >= 8:
                how, veto = "strong_veto_override", 0
        elif e["strong"]:
            how, veto = "strong", 0
        else:
            how, veto = (e["path"] if e["path"] == "soft" else None), 0
        if how is None:
            streak, override, i = [], False, i + 1
            continue
        override = override or how == "strong_veto_override"
        streak.append((i, how))
        if len(streak) < 3:
            i += 1
            continue
        apex, j, steps = i, i + 1, 3
        while j < len(r) and r[j]["linked"] and r[j]["y"] < r[apex]["y"]:
            apex, j, steps = j, j + 1, steps + 1
        fell = j < len(r) and r[j]["timestamp_sec"] - r[apex]["timestamp_sec"] <= 0.15 and r[j]["y"] > r[apex]["y"]
        out.append((streak[0][0], streak[0][1], steps >= 6 and fell, apex, steps, j if fell else None))
        streak, veto, override, i = [], 0, False, max(j, i + 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_trajectory_fold_equals_direct_scan(seed):
    p = pair_rows(800, seed)
    got = [(o[0], o[2], o[3], o[5], o[7], o[9]) for o in fold_call(rl.TrajectoryFold())(p)]
    want = direct_trajectories(p)
    assert got == want and got


def test_release_folds_in_blocks(spark):
    p = pair_rows(500, 11)
    schema = (
        "frame_index long, timestamp_sec double, linked boolean, vvel double, sep_norm double, separated boolean, controlled boolean, path string, "
        "strong boolean, veto boolean, falling_or_flat boolean, rel_vel double, y double"
    )
    df = spark.createDataFrame(p, schema).withColumn("sid", F.lit("s"))
    for fold in (rl.ControlFold(), rl.PossessionFold(), rl.TrajectoryFold()):
        whole = keyed_fold(df, ["sid"], ["frame_index"], F.lit(0), fold)
        cut = keyed_fold(df, ["sid"], ["frame_index"], F.floor(F.col("frame_index") / 250), fold)
        assert rows_of(whole) == rows_of(cut)
    assert whole.count() > 0  # the last of the three emits the most


def test_track_provenance_rules():
    seen = lambda x: [dict(o=0, x=x, y=20.0, radius=5.0, confidence=0.8)]
    frames = [seen(10.0 + 2 * i) for i in range(10)] + [None] * 9 + [seen(900.0)]
    pdf = pd.DataFrame({"frame_index": range(20), "timestamp_sec": [i / 30 for i in range(20)], "candidates": frames})
    out = fold_call(tr.TrackFold())(pdf)
    sources = [o[6] for o in out]
    assert sources[:10] == ["detected"] * 10
    assert sources[10:16] == ["interpolated"] * 3 + ["predicted"] * 3
    assert sources[16:19] == ["unavailable"] * 3 and out[16][2] is None
    assert 20.0 < out[10][2] < 30.0  # coasts on, behind the last detection's speed


def clip(*parts):
    """Signal rows from (count, near, burst, rising, apart, available, knee) parts."""
    rows, i = [], 0
    for count, near, burst, rising, apart, available, knee in parts:
        for j in range(count):
            rows.append((i, available, near, burst, rising, apart, True, knee(j) if callable(knee) else knee, 0.5))
            i += 1
    return pd.DataFrame(rows, columns=sg.SegmentFold.columns).astype(object)


HELD = (30, True, False, False, False, True, lambda j: 175.0 - (25.0 if 10 < j < 25 else 0.0))
RISE = (1, True, True, False, False, True, 160.0)
FLY = (8, False, True, True, True, True, 170.0)
SETTLE = (6, True, False, False, False, True, 172.0)


def shots_of(*parts):
    return fold_call(sg.SegmentFold())(clip(*parts))


def test_clean_attempt():
    (shot,) = shots_of(HELD, RISE, FLY, SETTLE)
    start, end, load, up, release, flight_end, tags = shot
    assert (start, load, up, release) == (0, 0, 30, 31) and end == flight_end and tags == []


def test_no_attempt_without_knee_dip_or_with_walking():
    flat = (30, True, False, False, False, True, 175.0)
    assert shots_of(flat, RISE[:6] + (175.0,), FLY[:6] + (175.0,), SETTLE) == []
    walk = clip(HELD, RISE, FLY, SETTLE)
    walk["hip_x_norm"] = [0.3 * i for i in range(len(walk))]
    assert fold_call(sg.SegmentFold())(walk) == []


def test_blackout_max_duration_and_end_of_data():
    gone = (45, False, False, False, False, False, None)
    (shot,) = shots_of(HELD, RISE, FLY, gone)
    assert shot[6] == ["closed_after_prolonged_ball_tracking_dropout"]
    (shot,) = shots_of(HELD, RISE, FLY, (200, False, False, False, True, True, 170.0))
    assert shot[6] == ["max_duration_exceeded"]
    (shot,) = shots_of(HELD, RISE, FLY)
    assert shot[6] == ["video_ended_during_flight"]


def test_fallback_trigger_and_suppression():
    away = (20, False, False, False, False, True, lambda j: 175.0 - (30.0 if 8 < j < 16 else 0.0))
    (shot,) = shots_of(away, FLY, SETTLE)
    assert shot[6][-1] == sg.INFERRED and shot[3] == 20
    # after an unconfirmed close the fallback stays silent for a while
    shots = shots_of(HELD, RISE, FLY, (151, False, False, False, True, True, 170.0), (20, False, False, False, False, True, lambda j: 175.0 - (30.0 if 8 < j < 16 else 0.0)), FLY, SETTLE)
    assert len(shots) == 1


def test_short_flight_is_tagged():
    (shot,) = shots_of(HELD, RISE, (2, False, True, True, True, True, 170.0), SETTLE)
    assert shot[6] in ([], ["short_duration"]) and shot[1] - shot[4] < 7

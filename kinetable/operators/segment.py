"""Attempt segmentation: a keyed fold over frame signals.

Row predicates are Columns, so the fold only branches.  Its look-back is a bounded buffer in
the state, and what can no longer matter is dropped from the state; that lets long sessions
be cut into blocks (see ``fold``) and lets the same fold serve the streaming operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators.fold import Fold, keyed_fold
from kinetable.operators.ordered import Series, positions
from kinetable.operators.signals import is_burst, is_flight
from kinetable.params import DEFAULTS, SegmentParams

c = F.col

INFERRED = "load_phase_inferred_from_pose_only_ball_not_tracked_near_hand"
WINDOW_FIELDS = [
    T.StructField("start_frame", T.LongType()), T.StructField("end_frame", T.LongType()), T.StructField("load_start_frame", T.LongType()),
    T.StructField("upward_start_frame", T.LongType()), T.StructField("release_candidate_frame", T.LongType()),
    T.StructField("flight_end_frame", T.LongType()), T.StructField("warnings", T.ArrayType(T.StringType())),
]
TRACE_FIELDS = [
    T.StructField("frame_index", T.LongType()), T.StructField("phase_before", T.StringType()), T.StructField("phase_after", T.StringType()),
    T.StructField("fallback_run", T.LongType()), T.StructField("separation_run", T.LongType()),
    T.StructField("settled_run", T.LongType()), T.StructField("missing_run", T.LongType()),
]
IDLE, LOAD, UPWARD, FLIGHT = "idle", "load", "upward", "flight"


def row_predicates(signals: DataFrame, p: SegmentParams = DEFAULTS.segment) -> DataFrame:
    dist = c("ball_hand_dist_norm")
    off = lambda col: F.coalesce(col, F.lit(False))
    return signals.withColumns(
        {
            "near": off(c("ball_available") & (dist <= p.near_norm)),
            "burst": is_burst(p),
            "rising": is_flight(p),
            "apart": off(c("ball_available") & (dist > p.near_norm)) & F.coalesce(c("ball_y") <= c("shoulder_y"), F.lit(True)),
        }
    )


class SegmentFold(Fold):
    columns = ("frame_index", "ball_available", "near", "burst", "rising", "apart", "ball_is_observed", "knee_angle_deg", "hip_x_norm")

    def __init__(self, p: SegmentParams = DEFAULTS.segment, trace: bool = False):
        self.p, self.trace = p, trace
        self.schema = T.StructType(TRACE_FIELDS if trace else WINDOW_FIELDS)
        self.memory = p.lookback_rows + p.fallback_frames

    def start(self):
        return {"phase": IDLE, "recent": [], "last_end": None, "hold": None, "fb": 0, **self._cleared()}

    @staticmethod
    def _cleared():
        return {"load": None, "up": None, "begin": None, "rel": None, "sep": 0, "settled": 0, "gone": 0, "inferred": False}

    def _idle(self, s):
        s.update(self._cleared(), phase=IDLE, fb=0)

    def _bent_and_still(self, s, rows):
        """Knee dip and small hip range over ``rows``, not reaching into the previous attempt."""
        floor = -1 if s["last_end"] is None else s["last_end"]
        rows = [r for r in rows if r[0] > floor]
        knees = [(r[1], i) for i, r in enumerate(rows) if r[1] is not None]
        hips = [r[2] for r in rows if r[2] is not None]
        if hips and max(hips) - min(hips) > self.p.max_hip_range:
            return False, knees, rows
        if knees:
            low, at = min(knees)
            before = [k for k, i in knees if i < at]
            if not before or max(before) - low < self.p.knee_drop_deg:
                return False, knees, rows
        return True, knees, rows

    def _close(self, s, end, tags, settled, out):
        tags = [*tags, INFERRED] if s["inferred"] else tags
        out.append((s["begin"], end, s["load"], s["up"], s["rel"], end, tags))
        s["last_end"] = end
        if not settled:
            s["hold"] = end + self.p.ownership_frames
        self._idle(s)

    def _forget(self, s, frame):
        """Drop memory that no rule can read any more, so equal futures have equal states."""
        oldest = s["recent"][0][0] if s["recent"] else frame
        if s["last_end"] is not None and oldest > s["last_end"] and frame - s["last_end"] >= self.p.cooldown_frames:
            s["last_end"] = None
        if s["hold"] is not None and frame >= s["hold"]:
            s["hold"] = None

    def step(self, s, row):
        frame, available, near, burst, rising, apart, observed, knee, hip = row
        out, before = [], s["phase"]
        s["recent"] = (s["recent"] + [[frame, knee, hip, bool(rising), bool(observed)]])[-self.memory:]
        self._forget(s, frame)
        getattr(self, "_in_" + before)(s, frame, bool(available), bool(near), bool(burst), bool(rising), bool(apart), knee, out)
        if self.trace:
            return s, [(frame, before, s["phase"], s["fb"], s["sep"], s["settled"], s["gone"])]
        return s, out

    def _in_idle(self, s, frame, available, near, burst, rising, apart, knee, out):
        p = self.p
        if s["last_end"] is not None and frame - s["last_end"] < p.cooldown_frames:
            return
        if near and knee is not None:
            s.update(phase=LOAD, load=frame, begin=frame, fb=0)
            return
        if s["hold"] is not None and frame < s["hold"]:
            s["fb"] = 0
            return
        s["fb"] = s["fb"] + 1 if rising else 0
        n = p.fallback_frames
        window = s["recent"][-n:]
        if s["fb"] < n or len(window) < n or not all(r[3] for r in window) or not any(r[4] for r in window):
            return
        ok, knees, rows = self._bent_and_still(s, s["recent"][:-n][-p.lookback_rows:])
        if ok:
            loaded = rows[min(knees)[1]][0] if knees else window[0][0]
            s.update(phase=UPWARD, up=window[0][0], load=loaded, begin=loaded, inferred=True, sep=0)

    def _in_load(self, s, frame, available, near, burst, rising, apart, knee, out):
        p = self.p
        if burst and self._bent_and_still(s, s["recent"][-p.lookback_rows:])[0]:
            s.update(phase=UPWARD, up=frame)
        elif not near or frame - s["begin"] > p.max_pre_release_frames:
            self._idle(s)

    def _in_upward(self, s, frame, available, near, burst, rising, apart, knee, out):
        p = self.p
        if available:
            s["sep"] = s["sep"] + 1 if apart else 0
        elif s["sep"]:
            s["sep"] += 1
        if s["sep"] >= p.separation_frames:
            s.update(phase=FLIGHT, rel=max(frame - p.separation_frames + 1, s["up"]))
        if frame - s["begin"] > p.max_pre_release_frames:
            self._idle(s)

    def _in_flight(self, s, frame, available, near, burst, rising, apart, knee, out):
        p = self.p
        s["settled"] = s["settled"] + 1 if near else 0
        s["gone"] = 0 if available else s["gone"] + 1
        flown = frame - s["rel"]
        short = ["short_duration"] if flown < p.min_shot_frames else []
        if s["settled"] >= p.settled_frames:
            self._close(s, frame, short, True, out)
        elif s["gone"] >= p.blackout_frames:
            self._close(s, frame, ["closed_after_prolonged_ball_tracking_dropout", *short], False, out)
        elif flown > p.max_flight_frames:
            self._close(s, frame, ["max_duration_exceeded"], False, out)

    def finish(self, s):
        out = []
        if s["phase"] == FLIGHT and not self.trace:
            self._close(s, s["recent"][-1][0], ["video_ended_during_flight"], False, out)
        return out


def segment_shots(signals: DataFrame, keys: Sequence[str] = ("sid",), block: Column | None = None, p: SegmentParams = DEFAULTS.segment) -> DataFrame:
    """Attempt windows per key, numbered from 1 in time order."""
    cut = F.floor(c("frame_index") / 4096) if block is None else block
    found = keyed_fold(row_predicates(signals, p), keys, ["frame_index"], cut, SegmentFold(p))
    return positions(found, Series.frames(keys, "start_frame"), "shot_index")


def segment_trace(signals: DataFrame, keys: Sequence[str] = ("sid",), block: Column | None = None, p: SegmentParams = DEFAULTS.segment) -> DataFrame:
    """One row per frame with the phase before and after it."""
    cut = F.floor(c("frame_index") / 4096) if block is None else block
    return keyed_fold(row_predicates(signals, p), keys, ["frame_index"], cut, SegmentFold(p, trace=True))

"""Release detectors: refinement of a window's release, and three detectors on trusted pairs.

Per-pair evidence is computed with Columns; the folds keep only a phase and a short streak.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions import scores as sc
from kinetable.operators.fold import Fold, keyed_fold
from kinetable.operators.joins import interval_join
from kinetable.operators.lineage import stage
from kinetable.operators.ordered import Series, dim_join, positions, prev_row, scan
from kinetable.operators.windows import MIN_DT, chains, trailing_min, trusted
from kinetable.params import DEFAULTS, OutcomeParams, ReleaseEventParams, ReleaseParams, SegmentParams

c = F.col


def refine_release(windows: DataFrame, signals: DataFrame, keys: Sequence[str] = ("sid",), elbow: DataFrame | None = None, p: ReleaseParams = DEFAULTS.release) -> DataFrame:
    """First clearly separated, rising frame near the candidate; else the candidate itself.

    ``elbow`` optionally gives ``(keys, shot_index, frame_index, elbow_deg)``.
    """
    k = [*keys, "shot_index"]
    cand = c("release_candidate_frame")
    reach = windows.filter(cand.isNotNull()).select(
        *k, "start_frame", "end_frame", "release_candidate_frame",
        F.greatest("start_frame", cand - p.search_frames).alias("_lo"), F.least("end_frame", cand + p.search_frames).alias("_hi"),
    )
    seen = signals.select(*keys, "frame_index", "timestamp_sec", "ball_hand_dist_norm", "ball_vertical_velocity_norm")
    rows = interval_join(seen, reach, keys, "frame_index", "_lo", "_hi")
    if elbow is not None:
        rows = rows.join(elbow, [*k, "frame_index"], "left")
    else:
        rows = rows.withColumn("elbow_deg", F.lit(None).cast("double"))
    rising = F.coalesce(c("ball_vertical_velocity_norm") <= -p.min_speed, F.lit(False))
    clear = rising & F.coalesce(c("ball_hand_dist_norm") >= p.separated_norm, F.lit(False))
    at = F.struct(c("frame_index").alias("f"), c("timestamp_sec").alias("t"), rising.alias("up"), "elbow_deg")
    agg = rows.groupBy(*k).agg(
        F.min(F.when(clear, at)).alias("_clear"), F.min(F.when(c("frame_index") == cand, at)).alias("_cand"),
        F.max("start_frame").alias("_s"), F.max("end_frame").alias("_e"),
    )
    best = F.coalesce(c("_clear"), c("_cand"))
    score, basis = sc.release_score(c("_clear").isNotNull(), best["up"], best["elbow_deg"], p)
    return agg.filter(best.isNotNull()).select(
        *k, best["f"].alias("release_frame"), best["t"].alias("release_time_sec"),
        F.greatest(c("_s"), best["f"] - p.window_frames).alias("window_start_frame"),
        F.least(c("_e"), best["f"] + p.window_frames).alias("window_end_frame"),
        F.round(score, 3).alias("release_confidence"), best["elbow_deg"].alias("elbow_deg"), basis.alias("basis"),
    )


def trusted_pairs(signals: DataFrame, series: Series, scale: Column, p: ReleaseEventParams = DEFAULTS.event) -> DataFrame:
    """Evidence for every consecutive trusted pair; the first row of a key has no pair.

    Needs ``x, y, source, timestamp_sec, left_wrist, right_wrist``.
    """
    rows = stage(trusted(signals, series, p))
    rows = scan(rows, series, a=prev_row(F.struct("frame_index", "timestamp_sec", "x", "y", "left_wrist", "right_wrist")))
    dist = lambda w: F.when(w.isNotNull(), F.hypot(c("x") - w["x"], c("y") - w["y"]) / scale)
    left, right = dist(c("left_wrist")), dist(c("right_wrist"))
    by_left = left.isNotNull() & (right.isNull() | (left <= right))
    gap = c("timestamp_sec") - c("a.timestamp_sec")
    hand = F.when(by_left, c("left_wrist")).otherwise(c("right_wrist"))
    hand_before = F.when(by_left, c("a.left_wrist")).otherwise(c("a.right_wrist"))
    rows = rows.withColumns(
        {
            "linked": F.coalesce((gap > MIN_DT) & (gap <= p.max_gap_sec), F.lit(False)),
            "gap": gap,
            "sep_norm": F.least(left, right),
            "above_both": c("y") < F.when(c("left_wrist").isNotNull() & c("right_wrist").isNotNull(), F.least("left_wrist.y", "right_wrist.y")),
            "_h": hand["y"], "_h0": hand_before["y"],
        }
    )
    linked = c("linked")
    vvel = F.when(linked, (c("y") - c("a.y")) / c("gap") / scale)
    hand_v = (c("_h") - c("_h0")) / c("gap") / scale
    rows = rows.withColumns({"vvel": vvel, "separated": c("sep_norm") > p.separation_norm, "rel_vel": F.when(linked, F.abs(vvel - hand_v))})
    controlled = F.coalesce((c("sep_norm") <= p.separation_norm) & (c("rel_vel") <= p.control_speed), F.lit(False))
    strong = c("vvel") <= -p.strong_speed
    apart = F.coalesce(c("separated"), F.lit(False))
    path = F.when(strong, F.when(apart, "strong")).when(apart & F.coalesce(c("above_both"), F.lit(False)) & (c("vvel") <= -p.soft_speed), "soft")
    return rows.withColumns(
        {
            "controlled": controlled, "path": path, "strong": F.coalesce(strong, F.lit(False)),
            "veto": F.coalesce(strong & ~c("separated"), F.lit(False)), "falling_or_flat": F.coalesce(c("vvel") <= 0, F.lit(False)),
        }
    ).drop("_h", "_h0")


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("release_frame", T.LongType()), T.StructField("release_time_sec", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("path", T.StringType()), T.StructField("consecutive", T.LongType()), T.StructField("separation_norm", T.DoubleType()),
    ]
)
PAIR_COLUMNS = ("frame_index", "timestamp_sec", "linked", "vvel", "sep_norm", "separated", "controlled", "path", "strong", "veto", "falling_or_flat", "rel_vel", "y")


def _event(streak, need):
    frame, t, path, sep = streak[0]
    conf = min(1.0, sc.EVENT_BASE[path] + 0.05 * (len(streak) - need))
    return (frame, t, round(conf, 3), path, len(streak), None if sep is None else round(sep, 3))


class ControlFold(Fold):
    """uncontrolled -> controlled -> transition -> separating, with veto override."""

    columns = PAIR_COLUMNS
    schema = EVENT_SCHEMA

    def __init__(self, p: ReleaseEventParams = DEFAULTS.event, trace: bool = False):
        self.p, self.trace = p, trace
        if trace:
            self.schema = T.StructType([T.StructField("frame_index", T.LongType()), T.StructField("state_before", T.StringType()), T.StructField("state_after", T.StringType())])

    def start(self):
        return ["uncontrolled", [], 0]

    def step(self, state, row):
        frame, t, linked, vvel, sep, separated, controlled, path, strong, veto, flat, rel, y = row
        before = state[0]
        state, out = self._next(state, frame, t, linked, sep, controlled, path, strong, veto, flat)
        return state, [(frame, before, state[0])] if self.trace else out

    def _next(self, state, frame, t, linked, sep, controlled, path, strong, veto, flat):
        phase, streak, vetoed = state
        if not linked:
            return self.start(), []
        drift = "transition" if flat else "uncontrolled"
        opened = ["separating", [[frame, t, path, sep]], 0]
        if phase == "uncontrolled":
            return ["controlled" if controlled else phase, streak, 0], []
        if phase == "controlled":
            if controlled:
                return state, []
            if path:
                return opened, []
            return [drift, streak, 1 if veto and flat else 0], []
        if phase == "transition":
            if controlled:
                return ["controlled", streak, 0], []
            if path:
                return opened, []
            if veto:
                if vetoed + 1 >= self.p.veto_frames:
                    return ["separating", [[frame, t, "strong_override", sep]], 0], []
                return [phase, streak, vetoed + 1], []
            return ([phase, streak, vetoed] if flat else ["uncontrolled", streak, 0]), []
        forced = bool(streak) and streak[-1][2] == "strong_override"
        if strong if forced else path:
            streak = [*streak, [frame, t, "strong_override" if forced else path, sep]]
            if len(streak) >= self.p.streak:
                return self.start(), [_event(streak, self.p.streak)]
            return [phase, streak, vetoed], []
        return ["controlled" if controlled else drift, [], 0], []


class PossessionFold(Fold):
    """uncontrolled -> approaching -> possession -> separated.

    Possession is confirmed when the relative velocity stops falling (a local minimum).
    """

    columns = PAIR_COLUMNS
    schema = EVENT_SCHEMA

    def __init__(self, p: ReleaseEventParams = DEFAULTS.event):
        self.p = p

    def start(self):
        return ["uncontrolled", [], None]

    def step(self, state, row):
        frame, t, linked, vvel, sep, separated, controlled, path, strong, veto, flat, rel, y = row
        phase, streak, last = state
        if not linked:
            return self.start(), []
        close = separated is not None and not separated
        near = ["approaching", [], rel] if close else ["uncontrolled", [], None]
        if phase == "uncontrolled":
            return near, []
        if phase == "approaching":
            if not close:
                return self.start(), []
            settled = rel is not None and last is not None and rel >= last
            return (["possession", [], None] if settled else ["approaching", [], rel]), []
        if phase == "possession":
            if close:
                return state, []
            return ["separated", [[frame, t, path, sep]] if path else [], None], []
        if path:
            streak = [*streak, [frame, t, path, sep]]
            if len(streak) >= self.p.streak:
                return self.start(), [_event(streak, self.p.streak)]
            return [phase, streak, last], []
        return near, []


class TrajectoryFold(Fold):
    """Arm on a rising streak, then follow the rise to its apex and look for descent."""

    columns = PAIR_COLUMNS
    schema = T.StructType(
        [
            T.StructField("arm_frame", T.LongType()), T.StructField("arm_time_sec", T.DoubleType()), T.StructField("arm_path", T.StringType()),
            T.StructField("confirmed", T.BooleanType()), T.StructField("discard_reason", T.StringType()), T.StructField("apex_frame", T.LongType()),
            T.StructField("apex_time_sec", T.DoubleType()), T.StructField("rise_steps", T.LongType()), T.StructField("rise_px", T.DoubleType()),
            T.StructField("descent_frame", T.LongType()),
        ]
    )

    def __init__(self, p: ReleaseEventParams = DEFAULTS.event):
        self.p = p

    def start(self):
        # streak of [frame, t, y, path], vetoes in a row, override, rise {arm, apex, steps}
        return {"s": [], "v": 0, "o": False, "rise": None}

    def _candidate(self, rise, descent):
        arm, apex, steps = rise["arm"], rise["apex"], rise["n"]
        long_enough = steps >= 2 * self.p.streak
        reason = None if long_enough and descent is not None else ("no_descent_observed" if long_enough else "rise_phase_too_short")
        return (arm[0], arm[1], arm[3], reason is None, reason, apex[0], apex[1], steps, arm[2] - apex[2], descent)

    def _qualify(self, state, separated, path, strong, soft):
        if state["o"]:
            return "strong_veto_override" if strong else None
        if not strong:
            state["v"] = 0
            return soft
        if separated is not None and not separated:
            state["v"] += 1
            if state["v"] < self.p.veto_frames:
                return None
            state["v"] = 0
            return "strong_veto_override"
        state["v"] = 0
        return "strong"

    def step(self, state, row):
        frame, t, linked, vvel, sep, separated, controlled, path, strong, veto, flat, rel, y = row
        out = []
        rise = state["rise"]
        if rise is not None:
            if linked and y < rise["apex"][2]:
                rise["apex"], rise["n"] = [frame, t, y], rise["n"] + 1
                return state, []
            gap = t - rise["apex"][1]
            falls = MIN_DT < gap <= self.p.max_gap_sec and y > rise["apex"][2]
            out.append(self._candidate(rise, frame if falls else None))
            state = self.start()  # the same pair is then scanned afresh
        if not linked:
            return self.start(), out
        how = self._qualify(state, separated, path, strong, path if path == "soft" else None)
        if how is None:
            state.update(s=[], o=False)
            return state, out
        state["o"] = state["o"] or how == "strong_veto_override"
        state["s"] = [*state["s"], [frame, t, y, how]]
        if len(state["s"]) >= self.p.streak:
            last = state["s"][-1]
            state = {**self.start(), "rise": {"arm": state["s"][0], "apex": last[:3], "n": self.p.streak}}
        return state, out

    def finish(self, state):
        return [self._candidate(state["rise"], None)] if state["rise"] else []


def _fold(signals: DataFrame, keys: Sequence[str], scale: Column, fold: Fold, p: ReleaseEventParams) -> DataFrame:
    pairs = stage(trusted_pairs(signals, Series.frames(keys), scale, p).select(*keys, *fold.columns))
    return keyed_fold(pairs, keys, ["frame_index"], F.floor(c("frame_index") / 4096), fold)


def release_events(signals: DataFrame, scale: Column, keys: Sequence[str] = ("sid",), p: ReleaseEventParams = DEFAULTS.event) -> DataFrame:
    return _fold(signals, keys, scale, ControlFold(p), p)


def release_trace(signals: DataFrame, scale: Column, keys: Sequence[str] = ("sid",), p: ReleaseEventParams = DEFAULTS.event) -> DataFrame:
    return _fold(signals, keys, scale, ControlFold(p, trace=True), p)


def possession_releases(signals: DataFrame, scale: Column, keys: Sequence[str] = ("sid",), p: ReleaseEventParams = DEFAULTS.event) -> DataFrame:
    return _fold(signals, keys, scale, PossessionFold(p), p)


def trajectory_shots(signals: DataFrame, scale: Column, keys: Sequence[str] = ("sid",), p: ReleaseEventParams = DEFAULTS.event) -> DataFrame:
    """Armed candidates, confirmed or with a discard reason; ``height_gained_norm`` over ``scale``."""
    found = _fold(signals, keys, scale, TrajectoryFold(p), p)
    return found.withColumn("height_gained_norm", F.round(c("rise_px") / scale, 3)).drop("rise_px")


def corroborate(cands: DataFrame, signals: DataFrame, hoops: DataFrame, scale: Column, keys: Sequence[str] = ("sid",), p: ReleaseEventParams = DEFAULTS.event, op: OutcomeParams = DEFAULTS.outcome, sp: SegmentParams = DEFAULTS.segment, seen: DataFrame | None = None) -> DataFrame:
    """Target and pose evidence tiers for armed candidates.

    ``seen`` are the trusted rows of ``signals``, where the caller has them already.

    The target tier looks along the candidate's own gap-bounded chain of trusted points; the
    pose tier looks at the last few trusted rows up to the arm frame.
    """
    k = list(keys)
    series = Series.frames(k)
    rows = stage(trusted(signals, series, p)) if seen is None else seen
    rows = chains(rows, series, "timestamp_sec", p.max_gap_sec, "_chain")
    dist = lambda w: F.when(w.isNotNull(), F.hypot(c("x") - w["x"], c("y") - w["y"]) / scale)
    rows = positions(rows.withColumn("_wd", F.least(dist(c("left_wrist")), dist(c("right_wrist")))), series, "_tp")
    rows = trailing_min(rows, k, "_tp", "_wd", p.streak, "_pose")
    rows = stage(rows.select(*k, "frame_index", "x", "y", "_chain", "_pose"))
    arm = rows.select(*k, c("frame_index").alias("arm_frame"), c("_chain").alias("_arm_chain"), "_pose")
    armed = cands.join(arm, [*k, "arm_frame"]).withColumn("_until", c("arm_frame") + sp.max_flight_frames)
    points = dim_join(rows.drop("_pose"), hoops, k, "left", spread=["frame_index"])
    span = interval_join(points, armed.select(*k, "arm_frame", "_until", "_arm_chain"), k, "frame_index", "arm_frame", "_until")
    near = span.filter(c("_chain") == c("_arm_chain")).groupBy(*k, "arm_frame").agg(
        F.min(F.hypot(c("x") - c("hoop_x"), c("y") - c("hoop_y")) / c("hoop_r")).alias("_d"), F.max("hoop_conf").alias("_hc"), F.max("hoop_r").alias("_hr")
    )
    out = armed.join(near, [*k, "arm_frame"], "left")
    lost = F.coalesce((c("_hc") < op.hoop_floor) | (c("_hr") <= 0), F.lit(True))
    target = F.when(lost, "no_hoop_location").when(c("_d") <= op.wide_radii, "hoop_corroborated").otherwise("no_hoop_evidence")
    pose = F.when(c("_pose").isNull(), "no_pose_data").when(c("_pose") <= p.separation_norm, "pose_corroborated").otherwise("no_pose_evidence")
    return out.select(
        *cands.columns, target.alias("hoop_tier"), F.when(~lost, F.round("_d", 2)).alias("min_distance_rim_radii"),
        pose.alias("pose_tier"), F.round("_pose", 3).alias("min_distance_norm"),
    ).withColumn("tier", sc.evidence_tier(c("hoop_tier"), c("pose_tier")))


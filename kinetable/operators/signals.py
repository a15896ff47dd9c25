"""Normalised frame signals from poses and a tracked object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import geometry as geo
from kinetable.operators.ordered import Series, dim_join
from kinetable.operators.windows import min_distance, velocity
from kinetable.params import DEFAULTS, DetectionParams, SegmentParams

c = F.col


def is_burst(p: SegmentParams = DEFAULTS.segment) -> Column:
    return F.coalesce(c("ball_available") & (c("ball_vertical_velocity_norm") <= -p.burst_speed), F.lit(False))


def is_flight(p: SegmentParams = DEFAULTS.segment) -> Column:
    """Burst at or above shoulder height; unknown heights pass."""
    return is_burst(p) & F.coalesce(c("ball_y") <= c("shoulder_y"), F.lit(True))


def joint(name: str) -> Column:
    return c(f"joints.{name}")


def _visible(names: Sequence[str], p: DetectionParams) -> Column:
    return F.least(*[F.coalesce(joint(n)["visibility"], F.lit(-1.0)) for n in names]) >= p.landmark_floor


def _triple(side: str, parts: Sequence[str], p: DetectionParams) -> Column:
    names = [f"{side}_{part}" for part in parts]
    ok = _visible(names, p)
    return F.when(ok, F.struct(*[F.struct(joint(n)["x"].alias("x"), joint(n)["y"].alias("y")).alias(part) for n, part in zip(names, parts)]))


def leg_points(side: Column | None = None, p: DetectionParams = DEFAULTS.detection) -> Column:
    """Hip, knee, ankle of the asked side; without a side the left leg wins, then the right."""
    left, right = _triple("left", ("hip", "knee", "ankle"), p), _triple("right", ("hip", "knee", "ankle"), p)
    if side is None:
        return F.coalesce(left, right)
    return F.when(side == "left", left).when(side == "right", right).otherwise(F.coalesce(left, right))


def arm_points(side: Column, p: DetectionParams = DEFAULTS.detection) -> Column:
    left, right = _triple("left", ("shoulder", "elbow", "wrist"), p), _triple("right", ("shoulder", "elbow", "wrist"), p)
    return F.when(side == "left", left).when(side == "right", right)


def torso_points(p: DetectionParams = DEFAULTS.detection) -> Column:
    """Shoulder and hip midpoints, only when all four landmarks are visible."""
    names = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")

    def middle(part: str) -> Column:
        l, r = joint(f"left_{part}"), joint(f"right_{part}")
        return F.struct(((l["x"] + r["x"]) / 2).alias("x"), ((l["y"] + r["y"]) / 2).alias("y")).alias(part)

    return F.when(_visible(names, p), F.struct(middle("shoulder"), middle("hip")))


def angle_of(triple: Column, parts: Sequence[str]) -> Column:
    return geo.angle_deg(*[geo.point(triple[part]) for part in parts])


def mean_knee_angle(p: DetectionParams = DEFAULTS.detection) -> Column:
    """Mean over the legs that are visible and plausibly bent."""
    parts = ("hip", "knee", "ankle")
    angles = [angle_of(_triple(side, parts, p), parts) for side in ("left", "right")]
    good = [F.when(a >= p.min_knee_deg, a) for a in angles]
    n = sum((F.when(g.isNotNull(), 1).otherwise(0) for g in good), F.lit(0))
    return sum((F.coalesce(g, F.lit(0.0)) for g in good), F.lit(0.0)) / F.nullif(n, F.lit(0))


def wrist_px(side: str, width: Column, height: Column) -> Column:
    w = joint(f"{side}_wrist")
    return F.when(w["x"].isNotNull(), F.struct((w["x"] * width).alias("x"), (w["y"] * height).alias("y")))


def torso_px(width: Column, height: Column) -> Column:
    """Per-frame torso length in pixels from whichever shoulders and hips exist."""

    def centre(part: str) -> tuple[Column, Column]:
        l, r = joint(f"left_{part}"), joint(f"right_{part}")
        both = lambda f: F.coalesce((l[f] + r[f]) / 2, l[f], r[f])
        return both("x") * width, both("y") * height

    return geo.torso_len(centre("shoulder"), centre("hip"))


def frame_signals(pose: DataFrame, ball: DataFrame, scale: DataFrame, width: float, height: float, keys: Sequence[str] = ("sid",), p: DetectionParams = DEFAULTS.detection) -> DataFrame:
    """Join pose and object frame by frame and normalise by the session's torso scale.

    ``scale`` has one row per session with ``torso_px``.
    """
    w, h = F.lit(width), F.lit(height)
    k = list(keys)
    rows = pose.join(ball.drop("timestamp_sec"), [*k, "frame_index"])
    rows = dim_join(rows, scale, k, spread=["frame_index"])
    available = c("source") != "unavailable"
    left, right = (F.when(c("detected"), wrist_px(s, w, h)) for s in ("left", "right"))
    rows = rows.withColumns({"left_wrist": left, "right_wrist": right})
    rows = velocity(rows, Series.frames(k), "y", "timestamp_sec", available, c("torso_px"), "ball_vertical_velocity_norm")
    mean = lambda part, f: (joint(f"left_{part}")[f] + joint(f"right_{part}")[f]) / 2
    dist = min_distance(c("x"), c("y"), [c("left_wrist"), c("right_wrist")], c("torso_px"))
    return rows.select(
        *k, "frame_index", "timestamp_sec", available.alias("ball_available"),
        F.when(available, c("x")).alias("ball_x"), F.when(available, c("y")).alias("ball_y"),
        F.when(available, dist).alias("ball_hand_dist_norm"), "ball_vertical_velocity_norm",
        F.when(c("detected"), mean_knee_angle(p)).alias("knee_angle_deg"),
        F.when(available, mean("shoulder", "y") * h).alias("shoulder_y"),
        F.when(c("detected"), mean("hip", "x") * w / c("torso_px")).alias("hip_x_norm"),
        c("source").isin("detected", "interpolated").alias("ball_is_observed"),
        "left_wrist", "right_wrist", c("source").alias("ball_source"), "x", "y", "source", "confidence", "radius",
    )

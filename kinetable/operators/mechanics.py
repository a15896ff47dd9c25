"""Per-attempt mechanics from poses: one interval join and one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import geometry as geo
from kinetable.operators.aggregates import pose_confidence
from kinetable.operators.joins import interval_join
from kinetable.operators.signals import angle_of, arm_points, leg_points, torso_points
from kinetable.params import DEFAULTS, DetectionParams

c = F.col

LEG, ARM = ("hip", "knee", "ankle"), ("shoulder", "elbow", "wrist")
FIELDS = (
    "knee_angle_at_load_deg", "knee_angle_at_release_deg", "elbow_angle_at_load_deg", "elbow_angle_at_release_deg", "torso_lean_at_load_deg",
    "torso_lean_at_release_deg", "release_height_norm", "release_horizontal_offset_norm", "load_duration_sec", "upward_duration_sec", "total_prep_duration_sec",
)


def pose_facts(pose: DataFrame, keys: Sequence[str], p: DetectionParams = DEFAULTS.detection) -> DataFrame:
    """Every angle and offset of a pose frame for both sides, as plain numbers.

    Only these few numbers are shuffled to the attempts, not the joints.
    """
    torso = torso_points(p)
    shoulder, hip = geo.point(torso["shoulder"]), geo.point(torso["hip"])
    length = geo.torso_len(shoulder, hip)
    cols = [geo.lean_deg(shoulder, hip).alias("lean"), pose_confidence().alias("conf")]
    for name in ("left", "right"):
        legs, arm = leg_points(F.lit(name), p), arm_points(F.lit(name), p)
        wrist = geo.point(arm["wrist"])
        cols += [
            legs.isNotNull().alias(f"legs_{name}"), angle_of(legs, LEG).alias(f"knee_{name}"),
            arm.isNotNull().alias(f"arm_{name}"), angle_of(arm, ARM).alias(f"elbow_{name}"),
            geo.normalize(hip[1] - wrist[1], length).alias(f"height_{name}"), geo.normalize(wrist[0] - shoulder[0], length).alias(f"offset_{name}"),
        ]
    return pose.select(*keys, "frame_index", "timestamp_sec", "detected", *cols)


def _of_side(name: str) -> Column:
    return F.when(c("shooting_side") == "left", c(f"{name}_left")).when(c("shooting_side") == "right", c(f"{name}_right"))


def _facts() -> Column:
    """The chosen side's facts; without a side the left leg counts if seen, else the right."""
    known = F.coalesce(c("shooting_side").isin("left", "right"), F.lit(False))
    knee = F.when(known, _of_side("knee")).when(c("legs_left"), c("knee_left")).otherwise(c("knee_right"))
    return F.struct(
        knee.alias("knee"), _of_side("elbow").alias("elbow"), "lean", _of_side("height").alias("height"), _of_side("offset").alias("offset"),
        F.coalesce(_of_side("arm"), F.lit(False)).alias("arm_seen"), "detected", c("timestamp_sec").alias("t"), c("frame_index").alias("f"),
    )


def mechanics(pose: DataFrame, shots: DataFrame, keys: Sequence[str] = ("sid",), p: DetectionParams = DEFAULTS.detection, facts: DataFrame | None = None) -> DataFrame:
    """``shots`` has ``load_start_frame, upward_start_frame, release_frame, shooting_side``.

    ``facts`` are the ``pose_facts`` of these poses, where the caller has them already.
    """
    per = [*keys, "shot_index"]
    load, up, release = c("load_start_frame"), c("upward_start_frame"), c("release_frame")
    spans = shots.select(
        *per, "load_start_frame", "upward_start_frame", "release_frame", "shooting_side",
        F.coalesce(load, up, release).alias("_lo"), F.coalesce(release, up).alias("_hi"),
    )
    rows = interval_join(pose_facts(pose, keys, p) if facts is None else facts, spans.filter("_lo IS NOT NULL AND _hi IS NOT NULL"), keys, "frame_index", "_lo", "_hi")
    rows = rows.withColumns({"m": _facts(), "_conf": c("conf")})
    at = lambda frame: F.max(F.when(c("m.f") == frame, c("m")))
    bent = c("detected") & c("m.knee").isNotNull()
    agg = rows.groupBy(*per).agg(
        F.count_if("detected").alias("n_detected"), F.avg(F.when(c("detected"), c("_conf"))).alias("_quality"),
        F.min_by("m", F.when(bent, F.struct("m.knee", "m.f"))).alias("deep"),
        at(release).alias("rel"), at(load).alias("at_load"), at(up).alias("at_up"),
    )
    out = spans.join(agg, per, "left")
    seen = F.coalesce(c("n_detected"), F.lit(0)) > 0
    rel = F.when(c("rel.detected"), c("rel"))
    r1, r3 = (lambda col: F.round(F.when(seen, col), 1)), (lambda col: F.round(F.when(seen, col), 3))
    warn = F.array_compact(
        F.array(
            F.when(c("_lo").isNull() | c("_hi").isNull(), "shot_window_incomplete").when(~seen, "no_detected_pose_frames_in_window"),
            F.when(seen & c("deep").isNull(), "knee_angle_unavailable_at_load"),
            F.when(seen & rel.isNull(), "pose_unavailable_at_release").when(seen & ~rel["arm_seen"], "shooting_arm_landmarks_low_confidence_at_release"),
        )
    )
    return out.select(
        *per, F.coalesce(F.round(F.when(seen, c("_quality")), 3), F.lit(0.0)).alias("pose_quality"), F.when(seen, c("deep.f")).alias("load_frame"),
        F.struct(
            r1(c("deep.knee")).alias(FIELDS[0]), r1(rel["knee"]).alias(FIELDS[1]), r1(c("deep.elbow")).alias(FIELDS[2]), r1(rel["elbow"]).alias(FIELDS[3]),
            r1(c("deep.lean")).alias(FIELDS[4]), r1(rel["lean"]).alias(FIELDS[5]), r3(rel["height"]).alias(FIELDS[6]), r3(rel["offset"]).alias(FIELDS[7]),
            r3(c("at_up.t") - c("at_load.t")).alias(FIELDS[8]), r3(c("rel.t") - c("at_up.t")).alias(FIELDS[9]), r3(c("rel.t") - c("at_load.t")).alias(FIELDS[10]),
        ).alias("mechanics"),
        warn.alias("mechanics_warnings"),
    )

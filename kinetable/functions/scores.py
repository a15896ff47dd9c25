"""Confidence buckets, tiers and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.params import DEFAULTS, ReleaseParams, TrackParams

# Fixed values.
RELIABLE_SOURCES = ("detected", "interpolated")
SOURCES = ("detected", "interpolated", "predicted", "unavailable")
EVENT_BASE = {"strong": 0.75, "soft": 0.6, "strong_override": 0.55}


def rounded(value: Column, digits: int) -> Column:
    """``value`` rounded half away from zero as SQL's ``round`` on doubles does: the scaled double decides, not its shortest decimal text."""
    scale = F.lit(float(10**digits))
    out = F.round(value * scale) / scale
    return F.when(F.isnan(out) | (F.abs(out) == F.lit(float("inf"))), value).otherwise(out)


def reliable(source: Column, confidence: Column) -> Column:
    return source.isin(*RELIABLE_SOURCES) & (confidence > 0)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score > 0, "low").otherwise("excluded")


def overall_level(release: Column, pose: Column, track: Column) -> Column:
    return confidence_level(F.least(release, pose, track))


def display_tier(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def decay_conf(misses: Column, p: TrackParams = DEFAULTS.track) -> Column:
    return F.lit(p.coast_confidence) * F.greatest(F.lit(0.0), F.lit(1.0) - misses / F.lit(p.max_misses + 1.0))


def release_score(precise: Column, upward: Column, elbow_deg: Column, p: ReleaseParams = DEFAULTS.release) -> tuple[Column, Column]:
    """``(score, basis)`` from the three release flags."""
    extended = F.coalesce(elbow_deg >= p.elbow_deg, F.lit(False))
    score = (
        F.lit(0.4)
        + F.when(precise, 0.3).otherwise(0.0)
        + F.when(upward, 0.15).otherwise(0.0)
        + F.when(extended, 0.15).otherwise(0.0)
    )
    basis = F.concat_ws(
        ",",
        F.when(precise, F.lit("hand_ball_separation")),
        F.when(upward, F.lit("upward_velocity")),
        F.when(extended, F.lit("elbow_extension")),
    )
    return F.least(F.lit(1.0), score), F.when(basis == "", F.lit("state_machine_candidate_only")).otherwise(basis)


def event_conf(path: Column, streak: Column, need: int = DEFAULTS.event.streak) -> Column:
    base = F.when(path == "strong", EVENT_BASE["strong"]).when(path == "soft", EVENT_BASE["soft"]).when(path == "strong_override", EVENT_BASE["strong_override"])
    return F.least(F.lit(1.0), base + F.lit(0.05) * (streak - F.lit(need)))


def evidence_tier(target: Column, pose: Column) -> Column:
    """Low without target evidence; a pose contradiction lowers high to medium."""
    return (
        F.when(target != "hoop_corroborated", "low")
        .when(pose == "no_pose_evidence", "medium")
        .otherwise("high")
    )


def finding_conf(label: Column, n: Column) -> Column:
    return (
        F.when((label == "large") & (n >= 5), "high")
        .when(label.isin("large", "medium") & (n >= 3), "medium")
        .otherwise("low")
    )


def coverage_warning(hoop_conf: Column, floor: float = DEFAULTS.vote.accept_confidence) -> Column:
    """Session warning for a target that was not found or is uncertain; null when fine."""
    return (
        F.when(hoop_conf.isNull(), "target_not_located")
        .when(hoop_conf < floor, "target_location_low_confidence")
    )

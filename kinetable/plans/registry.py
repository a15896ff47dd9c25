"""Metric registry: add one entry and every statistic picks it up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    unit: str
    expr: str  # SQL expression over the attempt row
    lower_is_better: bool | None = None


# The standard metrics, in registry order (ties are broken by this order).
STANDARD = (
    Metric("knee_angle_at_load_deg", "Knee angle at load (deepest bend)", "deg", "mechanics.knee_angle_at_load_deg"),
    Metric("knee_angle_at_release_deg", "Knee angle at release", "deg", "mechanics.knee_angle_at_release_deg"),
    Metric("elbow_angle_at_load_deg", "Elbow angle at load", "deg", "mechanics.elbow_angle_at_load_deg"),
    Metric("elbow_angle_at_release_deg", "Elbow angle at release", "deg", "mechanics.elbow_angle_at_release_deg"),
    Metric("torso_lean_at_load_deg", "Torso lean at load", "deg", "mechanics.torso_lean_at_load_deg"),
    Metric("torso_lean_at_release_deg", "Torso lean at release", "deg", "mechanics.torso_lean_at_release_deg"),
    Metric("release_height_norm", "Release height (relative to hip, body-lengths)", "body-lengths", "mechanics.release_height_norm"),
    Metric("release_horizontal_offset_norm", "Release horizontal offset from shoulder", "body-lengths", "mechanics.release_horizontal_offset_norm"),
    Metric("load_duration_sec", "Load phase duration", "sec", "mechanics.load_duration_sec"),
    Metric("upward_duration_sec", "Upward-motion duration", "sec", "mechanics.upward_duration_sec"),
    Metric("total_prep_duration_sec", "Total prep-to-release duration", "sec", "mechanics.total_prep_duration_sec"),
    Metric("apex_height_norm", "Trajectory apex height (body-lengths above release)", "body-lengths", "trajectory.apex_height_norm"),
    Metric("trajectory_straightness_ratio", "Trajectory straightness (1.0 = perfectly straight)", "ratio", "trajectory.straightness_ratio"),
)


def metric_array(metrics: Sequence[Metric]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("metric_pos"),
                F.lit(m.key).alias("metric_key"),
                F.lit(m.label).alias("label"),
                F.lit(m.unit).alias("unit"),
                F.expr(m.expr).cast("double").alias("value"),
            )
            for i, m in enumerate(metrics)
        ]
    )


def metric_rows(shots: DataFrame, carry: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """One row per attempt and metric, nulls kept, so that empty groups still show up."""
    return shots.select(*carry, F.explode(metric_array(metrics)).alias("m")).select(*carry, "m.*")


def melt_metrics(shots: DataFrame, carry: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Long form of the usable attempts' metrics, nulls dropped."""
    usable = shots.filter(~F.col("excluded_from_analysis"))
    wide = usable.select(*carry, *[F.expr(m.expr).cast("double").alias(m.key) for m in metrics])
    return wide.unpivot(list(carry), [m.key for m in metrics], "metric_key", "value").filter("value IS NOT NULL")

"""Typed parameters.  Every threshold is bound as a literal into Column expressions.

The defaults below are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MediaParams:
    extensions: tuple[str, ...] = (".mp4", ".mov", ".m4v", ".avi")
    max_size_mb: float = 500.0
    min_width: int = 320
    min_height: int = 240
    min_sec: float = 1.5
    max_sec: float = 300.0
    target_fps: float = 30.0


@dataclass(frozen=True)
class DetectionParams:
    person_floor: float = 0.35
    ball_floor: float = 0.25
    min_rel_height: float = 0.01
    max_rel_height: float = 0.35
    shape_floor: float = 0.55
    color_floor: float = 0.12
    landmark_floor: float = 0.4
    min_knee_deg: float = 90.0
    smoothing_alpha: float = 0.35


@dataclass(frozen=True)
class VoteParams:
    radius_px: float = 40.0
    full_votes: int = 4
    accept_confidence: float = 0.4


@dataclass(frozen=True)
class TrackParams:
    process_noise: float = 8.0
    measurement_noise: float = 4.0
    initial_variance: float = 50.0
    max_jump_px: float = 140.0
    interpolated_misses: int = 3
    max_misses: int = 6
    min_dt: float = 1e-3
    coast_confidence: float = 0.3
    radius_decay: float = 0.7
    default_radius: float = 8.0


@dataclass(frozen=True)
class SegmentParams:
    near_norm: float = 0.18
    knee_drop_deg: float = 12.0
    burst_speed: float = 0.35
    separation_frames: int = 2
    min_shot_frames: int = 6
    max_pre_release_frames: int = 300
    max_flight_frames: int = 150
    cooldown_frames: int = 10
    settled_frames: int = 5
    blackout_frames: int = 45
    ownership_frames: int = 90
    fallback_frames: int = 3
    lookback_rows: int = 45
    max_hip_range: float = 4.0


@dataclass(frozen=True)
class ReleaseParams:
    search_frames: int = 8
    separated_norm: float = 0.22
    min_speed: float = 0.15
    window_frames: int = 2
    elbow_deg: float = 140.0


@dataclass(frozen=True)
class ReleaseEventParams:
    streak: int = 3
    strong_speed: float = 0.35
    soft_speed: float = 0.21
    separation_norm: float = 0.18
    veto_frames: int = 8
    control_speed: float = 0.175
    max_gap_sec: float = 0.15
    span_frac: float = 0.6
    min_tolerance_px: float = 15.0


@dataclass(frozen=True)
class RecoveryParams:
    min_chain: int = 3
    gate_factor: float = 1.6
    min_confidence: float = 0.15
    static_eps_px: float = 2.0
    max_static: int = 2
    fit_min_points: int = 5
    fit_max_rounds: int = 8
    residual_floor_px: float = 12.0


@dataclass(frozen=True)
class OutcomeParams:
    tight_radii: float = 1.6
    wide_radii: float = 3.0
    near_height_radii: float = 2.5
    rim_half_height: float = 0.35
    min_above: int = 2
    min_below: int = 2
    max_cross_sec: float = 0.75
    max_drift_radii: float = 1.0
    max_dip: float = 0.75
    max_deflect_sec: float = 0.75
    max_apex_sec: float = 2.0
    report_floor: float = 0.45
    min_reliable: int = 3
    min_reliable_open_apex: int = 6
    min_descent: int = 3
    hoop_floor: float = 0.3
    outlier_span_frac: float = 0.6
    outlier_radii: float = 3.0
    rim_radius_m: float = 0.2286


@dataclass(frozen=True)
class StatsParams:
    min_usable: int = 4
    min_each: int = 2
    min_consistency: int = 4
    min_trend: int = 6
    effect_cuts: tuple[float, float, float] = (0.2, 0.5, 0.8)


@dataclass(frozen=True)
class Params:
    media: MediaParams = field(default_factory=MediaParams)
    detection: DetectionParams = field(default_factory=DetectionParams)
    vote: VoteParams = field(default_factory=VoteParams)
    track: TrackParams = field(default_factory=TrackParams)
    segment: SegmentParams = field(default_factory=SegmentParams)
    release: ReleaseParams = field(default_factory=ReleaseParams)
    event: ReleaseEventParams = field(default_factory=ReleaseEventParams)
    recovery: RecoveryParams = field(default_factory=RecoveryParams)
    outcome: OutcomeParams = field(default_factory=OutcomeParams)
    stats: StatsParams = field(default_factory=StatsParams)


DEFAULTS = Params()

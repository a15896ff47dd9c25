"""The session pipeline: detections and poses to tracks, signals, attempts and every report table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import geometry as geo
from kinetable.functions.scores import RELIABLE_SOURCES
from kinetable.operators.aggregates import upper_median, vote_location, weighted_side
from kinetable.operators.joins import interval_join
from kinetable.operators.lineage import stage
from kinetable.operators.mechanics import mechanics, pose_facts
from kinetable.operators.ordered import Series, dim_join
from kinetable.operators.outcome import classify_outcome
from kinetable.operators.projections import apply_exclusion
from kinetable.operators.recovery import enrich, recover_points
from kinetable.operators.releases import refine_release
from kinetable.operators.segment import segment_shots
from kinetable.operators.signals import frame_signals, joint, torso_points, torso_px
from kinetable.operators.track import gather_candidates, select_primary, track
from kinetable.operators.windows import bounded_windows
from kinetable.params import DEFAULTS, VoteParams
from kinetable.plans.coaching import coaching
from kinetable.plans.registry import STANDARD
from kinetable.plans.session_stats import compare_groups, consistency, findings, session_summary, trend_thirds

c = F.col

#: Frames behind a window's end that recovered points may lie in (half a second), and the torso's share of the height
#: where no pose shows one.
MARGIN_FRAMES, NO_TORSO_SHARE = 15, 0.22


def shooting_sides(pose: DataFrame, points: DataFrame, windows: DataFrame, width: float, height: float, keys: Sequence[str] = ("sid",)) -> DataFrame:
    """Hand nearer to the object over each window; both in pixels."""
    k = list(keys)
    seen = points.filter(c("source") != "unavailable").select(*k, "frame_index", "x", "y")
    rows = pose.join(seen, [*k, "frame_index"])
    for side in ("left", "right"):
        w = joint(f"{side}_wrist")
        rows = rows.withColumns({f"{side}_vis": w["visibility"], f"{side}_dist": F.hypot(w["x"] * width - c("x"), w["y"] * height - c("y"))})
    slim = rows.select(*k, "frame_index", "left_vis", "right_vis", "left_dist", "right_dist")
    inside = interval_join(slim, windows.select(*k, "shot_index", "start_frame", "end_frame"), k, "frame_index", "start_frame", "end_frame")
    return weighted_side(inside, [*k, "shot_index"]).select(*k, "shot_index", "shooting_side")


def elbow_angles(facts: DataFrame, sided: DataFrame, keys: Sequence[str] = ("sid",)) -> DataFrame:
    """Elbow angle of the shooting arm in every pose frame of an attempt; ``facts`` are ``pose_facts``."""
    k = list(keys)
    inside = interval_join(facts.select(*k, "frame_index", "elbow_left", "elbow_right"), sided.select(*k, "shot_index", "shooting_side", "start_frame", "end_frame"), k, "frame_index", "start_frame", "end_frame")
    angle = F.when(c("shooting_side") == "left", c("elbow_left")).when(c("shooting_side") == "right", c("elbow_right"))
    return inside.select(*k, "shot_index", "frame_index", angle.alias("elbow_deg"))


def flight_of(points: DataFrame, windows: DataFrame, keys: Sequence[str] = ("sid",), recovered: DataFrame | None = None, hoops: DataFrame | None = None, margin: int = MARGIN_FRAMES) -> DataFrame:
    """Points from the release (or the best known start) to the end of each attempt.

    With ``recovered`` points, these replace base points of the same frame, and where the session has a target the
    flight goes on for ``margin`` frames behind the window's end, but never into the next attempt.
    """
    k, per = list(keys), [*keys, "shot_index"]
    start = F.coalesce("release_frame", "release_candidate_frame", "upward_start_frame", "start_frame")
    spans = windows.select(*per, start.alias("_from"), "start_frame", "end_frame")
    if recovered is None:
        return interval_join(points, spans.select(*per, "_from", c("end_frame").alias("_to")), k, "frame_index", "_from", "_to").drop("_from", "_to")
    reach = bounded_windows(spans, Series.frames(k, "start_frame"), "end_frame", margin)
    known = hoops.select(*k, F.lit(True).alias("_known"))
    reach = dim_join(reach, known, k, "left", spread=["shot_index"])
    spans = reach.select(*per, "_from", F.when(c("_known"), c("hi")).otherwise(c("end_frame")).alias("_to"))
    base = interval_join(points, spans, k, "frame_index", "_from", "_to").drop("_from", "_to")
    found = recovered.join(spans.drop("_to"), per).filter(c("frame_index") >= c("_from")).drop("_from")
    return enrich(base, found, per)


def torso_at_release(pose: DataFrame, released: DataFrame, width: float, height: float, keys: Sequence[str]) -> DataFrame:
    """Torso length in pixels in each attempt's release frame; null where its landmarks are not all visible."""
    torso = torso_points()
    at = lambda part: (torso[part]["x"] * width, torso[part]["y"] * height)
    lengths = pose.filter("detected").select(*keys, c("frame_index").alias("release_frame"), geo.torso_len(at("shoulder"), at("hip")).alias("torso_px"))
    return released.select(*keys, "shot_index", "release_frame").join(lengths, [*keys, "release_frame"]).drop("release_frame")


def trajectory(flight: DataFrame, release_y: DataFrame, torso_px: Column, keys: Sequence[str]) -> DataFrame:
    """Provenance counts, quality, straightness and apex height of each flight."""
    from kinetable.operators.aggregates import straightness

    good = c("source").isin(*RELIABLE_SOURCES)
    agg = flight.groupBy(*keys).agg(
        *[F.count_if(c("source") == s).alias(f"num_{s}_points") for s in ("detected", "interpolated", "predicted")],
        F.round(F.count_if(good) / F.count(F.lit(1)), 3).alias("quality"), F.min(F.when(good, c("y"))).alias("_top"),
    )
    rows = agg.join(straightness(flight, keys), list(keys), "left").join(release_y, list(keys), "left")
    apex = F.round((c("release_y") - c("_top")) / F.when(torso_px > 1e-6, torso_px), 3)
    fields = [f"num_{s}_points" for s in ("detected", "interpolated", "predicted")]
    return rows.select(*keys, F.struct(*fields, "quality", "straightness_ratio", apex.alias("apex_height_norm")).alias("trajectory"))


def build_shots(
    signals: DataFrame, pose: DataFrame, points: DataFrame, hoops: DataFrame, torso_px: float | None, width: float, height: float, keys: Sequence[str] = ("sid",),
    windows: DataFrame | None = None, recovered: DataFrame | None = None,
) -> DataFrame:
    """Attempt records.  ``points`` carries ``frame_index, timestamp_sec, x, y, radius, confidence, source``.

    Every join after segmentation is on ``(session, attempt)`` or on frame blocks, so a long
    session is spread over its attempts.  Without ``torso_px`` each attempt is measured by the torso in its release
    frame.  ``recovered`` points count for outcome and trajectory only.
    """
    k, per = list(keys), [*keys, "shot_index"]
    windows = stage(segment_shots(signals, k)) if windows is None else windows
    sides = stage(shooting_sides(pose, points, windows, width, height, k))
    facts = stage(pose_facts(pose, k))
    release = refine_release(windows, signals, k, elbow_angles(facts, windows.join(sides, per, "left"), k))
    known = stage(windows.join(release, per, "left").join(sides, per, "left"))
    flight = stage(flight_of(points, known, k, recovered, hoops))
    outcome = classify_outcome(flight, hoops, per, k).select(*per, "outcome", "outcome_confidence", "outcome_reason")
    body = mechanics(pose, known, k, facts=facts)
    inside = interval_join(points, windows.select(*per, "start_frame", "end_frame"), k, "frame_index", "start_frame", "end_frame")
    own = inside.join(known.select(*per, "release_frame"), per)
    times = own.groupBy(*per).agg(
        F.round(F.min("timestamp_sec"), 3).alias("start_time_sec"), F.round(F.max("timestamp_sec"), 3).alias("end_time_sec"),
        F.round(F.avg(F.when(c("source").isin(*RELIABLE_SOURCES), 1.0).otherwise(0.0)), 3).alias("ball_track_quality"),
        F.max(F.when(c("frame_index") == c("release_frame"), c("y"))).alias("release_y"),
    )
    at_release = times.select(*per, "release_y")
    if torso_px is None:
        at_release = at_release.join(torso_at_release(pose, known, width, height, k), per, "left")
    path = trajectory(flight, at_release, F.lit(torso_px) if torso_px is not None else c("torso_px"), per)
    rows = known.join(times, per, "left").join(outcome, per, "left").join(body, per, "left").join(path, per, "left")
    rows = dim_join(rows, hoops.select(*k, c("hoop_conf").alias("hoop_confidence")), k, "left", spread=["shot_index"])
    quality = F.coalesce("pose_quality", F.lit(0.0))
    gate = apply_exclusion(c("release_frame").isNotNull(), quality, c("warnings"))
    return rows.withColumn("_g", gate).select(
        *per, "start_frame", "end_frame", "release_frame", "start_time_sec", F.round("release_time_sec", 3).alias("release_time_sec"), "end_time_sec",
        F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.coalesce("outcome_confidence", F.lit(0.0)).alias("outcome_confidence"), "outcome_reason",
        F.coalesce("release_confidence", F.lit(0.0)).alias("release_confidence"), quality.alias("pose_quality"),
        F.coalesce("ball_track_quality", F.lit(0.0)).alias("ball_track_quality"), F.coalesce("hoop_confidence", F.lit(0.0)).alias("hoop_confidence"),
        "shooting_side", "mechanics", "trajectory", "_g.*",
    )


def analyze(shots: DataFrame, keys: Sequence[str] = ("sid",)) -> DataFrame:
    """Session summary and coaching selection in one row per session."""
    shots = stage(shots)
    summary = session_summary(shots, keys, STANDARD)
    told = coaching(shots, keys, STANDARD)
    return summary.join(told.withColumnRenamed("confidence", "coaching_confidence"), list(keys))


# ---------------------------------------------------------------- from detections on


@dataclass
class Inputs:
    """What a session starts from, all by ``sid`` and ``frame_index``.

    ``frames``: every analysed frame with its ``timestamp_sec``.  ``balls``: ``x, y, radius, confidence`` and an ``id`` for
    the order of detections of one frame.  ``poses``: ``timestamp_sec, detected, joints``, and ``box_id`` if ``people`` are
    given.  ``people``: ``id, x1, y1, x2, y2``.  ``targets``: ``x, y, radius, confidence, source, id``.  ``gaps``: like
    ``balls``, from a second search, for frames without a reliable point.
    """

    frames: DataFrame
    balls: DataFrame
    poses: DataFrame
    targets: DataFrame
    width: float
    height: float
    people: DataFrame | None = None
    gaps: DataFrame | None = None


@dataclass
class Outputs:
    """Tables of a run.  Each was written once, and all later ones read the written table."""

    track: DataFrame
    hoops: DataFrame
    signals: DataFrame
    windows: DataFrame
    recovered: DataFrame | None
    shots: DataFrame
    summary: DataFrame
    consistency: DataFrame
    comparison: DataFrame
    trends: DataFrame
    findings: DataFrame
    coaching: DataFrame
    warnings: DataFrame


def own_poses(poses: DataFrame, people: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Poses of the primary subject; in frames without one nothing is detected."""
    chosen = select_primary(people, keys).select(*keys, "frame_index", c("box_id").alias("_box"))
    met = poses.join(chosen, [*keys, "frame_index"], "left")
    mine = F.coalesce(c("box_id") == c("_box"), F.lit(False))
    # one row a frame: the subject's pose where it is there, else any, as not detected
    pick = F.max_by(F.struct("timestamp_sec", (c("detected") & mine).alias("detected"), "joints"), F.struct(mine, c("box_id")))
    return met.groupBy(*keys, "frame_index").agg(pick.alias("_p")).select(*keys, "frame_index", "_p.*")


def target_warnings(sessions: DataFrame, hoops: DataFrame, keys: Sequence[str], p: VoteParams = DEFAULTS.vote) -> DataFrame:
    """``code`` of sessions whose target was not found or is uncertain."""
    found = sessions.join(hoops, list(keys), "left")
    code = F.when(c("hoop_conf").isNull(), "target_not_located").when(c("hoop_conf") < p.accept_confidence, "target_confidence_low")
    return found.select(*keys, code.alias("code")).filter("code IS NOT NULL")


def run_sessions(given: Inputs, keys: Sequence[str] = ("sid",)) -> Outputs:
    """Detections and poses to every report table.

    Track, votes, signals, windows, recovery, records, statistics: each step's table is written once, in the shared
    folder, and read by all steps behind it, so nothing is computed twice and a lost executor costs no step again.
    """
    k = list(keys)
    poses = stage(given.poses if given.people is None else own_poses(given.poses, given.people, k))
    spine = gather_candidates(given.frames.select(*k, "frame_index", "timestamp_sec"), given.balls, k, "id")
    ball = stage(track(spine, k))
    votes = vote_location(given.targets, k, ["frame_index", "id"])
    hoops = stage(votes.select(*k, c("rim_center_x").alias("hoop_x"), c("rim_center_y").alias("hoop_y"), c("rim_radius_px").alias("hoop_r"), c("confidence").alias("hoop_conf"), "votes", "method"))
    sessions = given.frames.select(*k).distinct()

    w, h = F.lit(given.width), F.lit(given.height)
    lengths = poses.filter("detected").select(*k, torso_px(w, h).alias("l"))
    scale = upper_median(lengths, k, "l", "torso_px").select(*k, "torso_px")
    # a session without any torso is scaled by a share of the height
    scale = sessions.join(scale, k, "left").withColumn("torso_px", F.coalesce("torso_px", h * F.lit(NO_TORSO_SHARE)))
    signals = stage(frame_signals(poses, ball, scale, given.width, given.height, k))
    windows = stage(segment_shots(signals, k))

    recovered = None
    if given.gaps is not None:
        recovered = stage(recover_points(windows, ball, given.gaps.withColumnRenamed("id", "cand_id"), hoops, k, MARGIN_FRAMES))
    shots = stage(build_shots(signals, poses, ball, hoops, None, given.width, given.height, k, windows, recovered))

    series = Series(k, ["shot_index"], "floor(shot_index / 4096)")
    summary = stage(session_summary(shots, k, STANDARD))
    from_target = target_warnings(sessions, hoops, k)
    told = summary.select(*k, F.explode("warnings").alias("code"))
    return Outputs(
        ball, hoops, signals, windows, recovered, shots, summary, stage(consistency(shots, k, STANDARD)), stage(compare_groups(shots, k, STANDARD)),
        stage(trend_thirds(shots, series, STANDARD)), stage(findings(shots, series, STANDARD)), stage(coaching(shots, k, STANDARD)), from_target.unionByName(told),
    )


def session_report(out: Outputs, sessions: DataFrame, keys: Sequence[str] = ("sid",)) -> DataFrame:
    """One row a session, with or without attempts: target, summary, metric tables, findings, coaching and warnings.

    The lists are bounded by the metric registry and the number of findings; attempts stay a table of their own.
    """
    k = list(keys)

    def listed(rows: DataFrame, order: str, name: str) -> DataFrame:
        fields = [n for n in rows.columns if n not in k]
        return rows.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(order, *[n for n in fields if n != order]))).alias(name))

    def nested(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*k, F.struct(*[n for n in rows.columns if n not in k]).alias(name))

    rows = sessions.select(*k).distinct()
    parts = [
        nested(out.hoops, "target"), nested(out.summary, "summary"), nested(out.coaching, "coaching"), listed(out.consistency, "metric_pos", "consistency"),
        listed(out.comparison, "metric_pos", "makes_vs_misses"), listed(out.trends, "metric_pos", "trends"), listed(out.findings, "ord", "findings"),
        out.warnings.groupBy(*k).agg(F.sort_array(F.collect_list("code")).alias("warnings")),
    ]
    for part in parts:
        rows = rows.join(part, k, "left")
    empty = lambda n: F.coalesce(c(n), F.array().cast(rows.schema[n].dataType)).alias(n)
    lists = ("consistency", "makes_vs_misses", "trends", "findings", "warnings")
    return rows.select(*[empty(n) if n in lists else c(n) for n in rows.columns])

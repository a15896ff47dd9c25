"""Readers with explicit schemas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions.scores import SOURCES
from kinetable.operators.curation import normalize_split
from kinetable.operators.mechanics import FIELDS

c = F.col

TRACE_SCHEMA = (
    "frame_index BIGINT, timestamp_sec DOUBLE, pose_detected BOOLEAN, pose_confidence DOUBLE, ball_source STRING, "
    "ball_x DOUBLE, ball_y DOUBLE, ball_confidence DOUBLE"
)
SESSION_SCHEMA = (
    "sid BIGINT, hoop STRUCT<rim_center_x: DOUBLE, rim_center_y: DOUBLE, rim_radius_px: DOUBLE, confidence: DOUBLE>, "
    "shots ARRAY<STRUCT<shot_index: BIGINT, outcome: STRING, outcome_confidence: DOUBLE, start_time_sec: DOUBLE, end_time_sec: DOUBLE>>"
)
MANIFEST_SCHEMA = (
    "image_id BIGINT, file_name STRING, width INT, height INT, split STRING, "
    "boxes ARRAY<STRUCT<label: STRING, cx: DOUBLE, cy: DOUBLE, w: DOUBLE, h: DOUBLE>>"
)
DEFAULT_RADIUS = 10.0


def read_frame_trace(spark: SparkSession, path: str, keys_schema: str = "") -> DataFrame:
    """Frame-trace CSV as points: unknown sources count as unavailable, and those rows go.

    ``keys_schema`` names partition columns of the folder, e.g. ``", sid BIGINT"``.
    """
    raw = spark.read.schema(TRACE_SCHEMA + keys_schema).option("header", True).csv(path)
    source = F.when(c("ball_source").isin(*SOURCES), c("ball_source")).otherwise("unavailable")
    kept = raw.withColumn("source", source).filter((c("source") != "unavailable") & c("ball_x").isNotNull())
    keys = [n for n in raw.columns if n not in ("frame_index", "timestamp_sec") and not n.startswith(("ball_", "pose_"))]
    return kept.select(
        *keys, "frame_index", "timestamp_sec", c("ball_x").alias("x"), c("ball_y").alias("y"),
        F.lit(DEFAULT_RADIUS).alias("radius"), c("ball_confidence").alias("confidence"), "source",
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session reports (JSON lines) as nested rows."""
    return spark.read.schema(SESSION_SCHEMA).json(path)


METRIC = "metric_pos: INT, metric_key: STRING, label: STRING, unit: STRING"
METRICS = {
    "consistency": "n: BIGINT, mean_value: DOUBLE, std_dev: DOUBLE, coefficient_of_variation: DOUBLE, sufficient_sample: BOOLEAN",
    "makes_vs_misses": "made_n: BIGINT, missed_n: BIGINT, made_mean: DOUBLE, missed_mean: DOUBLE, made_std: DOUBLE, missed_std: DOUBLE, difference: DOUBLE, effect_size: DOUBLE, "
    "effect_label: STRING, sufficient_sample: BOOLEAN, p_value: DOUBLE",
    "trends": "early_mean: DOUBLE, late_mean: DOUBLE, change: DOUBLE, early_n: BIGINT, late_n: BIGINT, early_shooting_pct: DOUBLE, late_shooting_pct: DOUBLE, "
    "early_n_classified: BIGINT, late_n_classified: BIGINT",
}
SUMMARY = (
    "total_shots_detected: BIGINT, made: BIGINT, missed: BIGINT, unknown: BIGINT, excluded: BIGINT, shooting_percentage: DOUBLE, session_duration_sec: DOUBLE, mean_pose_quality: DOUBLE, "
    "mean_ball_track_quality: DOUBLE, hoop_confidence: DOUBLE, strongest_consistency_label: STRING, biggest_differentiator_label: STRING, warnings: ARRAY<STRING>"
)
COACHING = (
    "eligible: BOOLEAN, strength_key: STRING, priority_key: STRING, priority_source: STRING, priority_confidence: STRING, priority_evidence: STRING, makes_vs_misses_reason: STRING, "
    "consistency_reason: STRING, confidence: STRING, data_quality_notes: ARRAY<STRING>, coach_note_code: STRING"
)
#: The session's part of a report, as the session pipeline makes it.
REPORT_SESSION = (
    "target: STRUCT<hoop_x: DOUBLE, hoop_y: DOUBLE, hoop_r: DOUBLE, hoop_conf: DOUBLE, votes: BIGINT, method: STRING>, "
    f"summary: STRUCT<{SUMMARY}>, coaching: STRUCT<{COACHING}>, "
    + ", ".join(f"{n}: ARRAY<STRUCT<{METRIC}, {fields}>>" for n, fields in METRICS.items())
    + ", findings: ARRAY<STRUCT<ord: INT, finding: STRING, evidence: STRING, confidence: STRING>>, warnings: ARRAY<STRING>"
)
#: An attempt's part.
REPORT_SHOT = (
    "shot_index: BIGINT, start_frame: BIGINT, end_frame: BIGINT, release_frame: BIGINT, start_time_sec: DOUBLE, release_time_sec: DOUBLE, end_time_sec: DOUBLE, outcome: STRING, outcome_confidence: DOUBLE, "
    "outcome_reason: STRING, release_confidence: DOUBLE, pose_quality: DOUBLE, ball_track_quality: DOUBLE, hoop_confidence: DOUBLE, shooting_side: STRING, "
    f"mechanics: STRUCT<{', '.join(f'{n}: DOUBLE' for n in FIELDS)}>, "
    "trajectory: STRUCT<num_detected_points: BIGINT, num_interpolated_points: BIGINT, num_predicted_points: BIGINT, quality: DOUBLE, straightness_ratio: DOUBLE, apex_height_norm: DOUBLE>, "
    "excluded_from_analysis: BOOLEAN, exclusion_reason: STRING, warnings: ARRAY<STRING>, overall_confidence_level: STRING"
)


def read_session_report(spark: SparkSession, path: str, keys: str = "sid BIGINT", session: str = REPORT_SESSION, shot: str = REPORT_SHOT) -> tuple[DataFrame, DataFrame]:
    """Sessions and attempts of a report's JSON lines, all fields typed; only the asked kind's lines and fields are kept."""
    rows = spark.read.schema(f"{keys}, line_no BIGINT, kind STRING, session STRUCT<{session}>, shot STRUCT<{shot}>").json(path)
    names = rows.columns[: rows.columns.index("line_no")]
    return tuple(rows.filter(c("kind") == kind).select(*names, f"{kind}.*") for kind in ("session", "shot"))


def parse_sessions(df: DataFrame, column: str) -> DataFrame:
    """Same from a JSON text column."""
    return df.withColumn(column, F.from_json(column, SESSION_SCHEMA))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Folder of per-image JSON files (one object or an array each); unknown splits are train."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return raw.withColumn("split", normalize_split(c("split")))


def media_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of media files; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", c("length").alias("size_bytes"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Image files decoded by the JVM, as gray-value arrays in row order.

    Files that can't be decoded keep their row, with ``valid`` false and no pixels.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return with_gray(img.select(c("origin").alias("path"), "width", "height", "nChannels", "data"))


def with_gray(images: DataFrame) -> DataFrame:
    """``path, width, height, valid, gray``: the mean of the first three channels of interleaved bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                wide, high, deep = row["width"] or 0, row["height"] or 0, row["nChannels"] or 0
                valid = wide > 0 and high > 0 and deep > 0 and len(row["data"] or b"") == wide * high * deep
                pixels = np.frombuffer(row["data"], np.uint8).reshape(-1, deep)[:, :3].mean(axis=1) if valid else None
                out.append({"path": row["path"], "width": wide, "height": high, "valid": valid, "gray": pixels})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    target = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("valid", pa.bool_()), ("gray", pa.list_(pa.float64()))])
    return images.mapInArrow(run, "path string, width int, height int, valid boolean, gray array<double>")

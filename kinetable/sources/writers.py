"""Writers and maintenance jobs; session tables that change are in ``store``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.scores import overall_level
from kinetable.operators.curation import number_rows
from kinetable.operators.ordered import Series, positions
from kinetable.operators.projections import CATEGORY_IDS

c = F.col
BUCKETS = 64


def frame_trace_rows(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The trace's columns and rounding; blanks where the object is unavailable."""
    seen = c("source") != "unavailable"
    return points.select(
        *keys, "frame_index", F.round("timestamp_sec", 4).alias("timestamp_sec"), "pose_detected", F.round("pose_confidence", 3).alias("pose_confidence"),
        c("source").alias("ball_source"), F.when(seen, F.round("x", 1)).alias("ball_x"), F.when(seen, F.round("y", 1)).alias("ball_y"),
        F.round("confidence", 3).alias("ball_confidence"),
    )


def write_frame_trace(points: DataFrame, path: str, keys: Sequence[str] = ("sid",)) -> None:
    frame_trace_rows(points, keys).write.mode("overwrite").option("header", True).partitionBy(*keys).csv(path)


def write_signals(signals: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Flat signal columns as CSV in hash buckets of the session."""
    flat = signals.select(
        "sid", "frame_index", "timestamp_sec", "ball_available", "ball_x", "ball_y", "ball_hand_dist_norm", "ball_vertical_velocity_norm", "knee_angle_deg", "shoulder_y", "hip_x_norm", "ball_source"
    )
    flat.withColumn("bucket", bucket_of(["sid"], buckets)).write.mode("overwrite").option("header", True).partitionBy("bucket").csv(path)


def to_report_json(shots: DataFrame, series: Series, fields: Sequence[str]) -> DataFrame:
    """Session reports as JSON lines: ``keys, line_no, line``; per-frame arrays stay out, the overall level is added.

    Line 0 is the session's header with its number of attempts; each attempt is a line of its own,
    so a session of any length has the same shape and is never gathered into one row.
    """
    level = overall_level(c("release_confidence"), c("pose_quality"), c("ball_track_quality"))
    placed = positions(shots, series, "_pos")
    entry = F.struct(c("_pos").alias("shot_index"), *fields, level.alias("overall_confidence_level"))
    told = lambda kind, body: F.to_json(F.struct(F.lit(kind).alias("kind"), body), {"ignoreNullFields": "false"}).alias("line")
    heads = placed.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("n_shots"))
    head_lines = heads.select(*series.keys, F.lit(0).cast("long").alias("line_no"), told("session", c("n_shots")))
    return head_lines.unionByName(placed.select(*series.keys, c("_pos").cast("long").alias("line_no"), told("shot", entry.alias("shot"))))


def report_rows(report: DataFrame, shots: DataFrame, keys: Sequence[str] = ("sid",)) -> DataFrame:
    """A whole session report as rows: line 0 is the session (target, summary, metric tables, findings, coaching,
    warnings), and each attempt is a line of its own, with all its fields and the overall level.

    Attempts without a session get none; every line has the same shape, so a session of any length stays in parts.
    """
    k = list(keys)
    level = overall_level(c("release_confidence"), c("pose_quality"), c("ball_track_quality")).alias("overall_confidence_level")
    session = F.struct(*[n for n in report.columns if n not in k])
    shot = F.struct(*[n for n in shots.columns if n not in k], level)
    heads = report.select(*k, F.lit(0).cast("long").alias("line_no"), F.lit("session").alias("kind"), session.alias("session"))
    lines = shots.select(*k, c("shot_index").cast("long").alias("line_no"), F.lit("shot").alias("kind"), shot.alias("shot"))
    return heads.unionByName(lines, allowMissingColumns=True)


def write_session_report(report: DataFrame, shots: DataFrame, path: str, keys: Sequence[str] = ("sid",), mode: str = "errorifexists") -> None:
    """The rows of ``report_rows`` as gzipped JSON lines (names repeat in every one), checked for non-finite numbers."""
    assert_finite(report_rows(report, shots, keys)).write.mode(mode).option("compression", "gzip").json(path)


def _double_leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += _double_leaves(f.dataType, f"{name}.")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            out.append(name)
    return out


def assert_finite(df: DataFrame) -> DataFrame:
    """Fail the job if any number of any row is NaN or infinite."""
    bad = F.lit(False)
    for leaf in _double_leaves(df.schema):
        v = c(leaf)
        bad = bad | F.coalesce(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(False))
    return df.filter(F.when(bad, F.raise_error(F.lit("export contains NaN or infinity")).cast("boolean")).otherwise(F.lit(True)))


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash(*keys), F.lit(buckets))


def list_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select("sid", "created_at", "status", "error_message").orderBy(c("created_at").desc(), "sid")


def delete_session(sessions: DataFrame, shots: DataFrame, gone: DataFrame, keys: Sequence[str] = ("sid",)) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of ``gone``; attempts go first."""
    ids = gone.select(*keys).distinct()
    return sessions.join(ids, list(keys), "left_anti"), shots.join(ids, list(keys), "left_anti")


def backfill_plan(sessions: DataFrame) -> DataFrame:
    """Why each session is (not) recomputed: needs ``status, has_report, has_key``."""
    reason = (
        F.when(c("status") != "completed", "skipped_not_completed")
        .when(~c("has_report"), "skipped_no_report")
        .when(c("has_key"), "already_done")
        .otherwise("updated")
    )
    return sessions.withColumn("backfill", reason)


def backfill(sessions: DataFrame, shots: DataFrame, compute, keys: Sequence[str] = ("sid",)) -> DataFrame:
    """Run ``compute(shots)`` for the sessions that need it; returns their new rows."""
    todo = backfill_plan(sessions).filter("backfill = 'updated'").select(*keys)
    return compute(shots.join(todo, list(keys), "left_semi"))


def regenerate_field(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace one field; the others are taken over untouched."""
    return df.withColumn(name, value)


def changed_elsewhere(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """Rows whose other columns differ; empty proves a targeted regeneration."""
    rest = [n for n in before.columns if n != name]
    return before.select(rest).exceptAll(after.select(rest)).unionByName(after.select(rest).exceptAll(before.select(rest)))


def coco_tables(images: DataFrame, boxes: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations with ids numbered per split."""
    img = number_rows(images, ["image_id"], block, "id", ["split"])
    notes = boxes.join(img.select("image_id", "split", c("id").alias("image_no")), "image_id")
    notes = number_rows(notes, ["image_no", "box_no"], "floor(image_no / 1024)", "id", ["split"])
    return img, notes


def write_coco(images: DataFrame, boxes: DataFrame, path: str, block: str) -> None:
    """JSON lines per split: images, annotations and categories."""
    img, notes = coco_tables(images, boxes, block)
    img.write.mode("overwrite").partitionBy("split").json(f"{path}/images")
    notes.write.mode("overwrite").partitionBy("split").json(f"{path}/annotations")
    spark = images.sparkSession
    cats = spark.createDataFrame([(i, n, "none") for n, i in CATEGORY_IDS.items()], "id int, name string, supercategory string")
    cats.write.mode("overwrite").json(f"{path}/categories")


def write_report(report: DataFrame, path: str) -> None:
    """Nested metrics report as JSON, checked for non-finite numbers."""
    assert_finite(report).write.mode("overwrite").json(path)

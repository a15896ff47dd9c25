"""Row-wise projections and filters on detections, candidates and attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions.geometry import box_center, box_radius
from kinetable.params import DEFAULTS, DetectionParams, MediaParams

c = F.col
BOX = ("x1", "y1", "x2", "y2")

# Label remaps of the curation jobs.
LABELS = {"ball": "ball", "basketball": "ball", "rim": "rim"}
CATEGORY_IDS = {"ball": 1, "rim": 2}


def lookup(col: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def with_box_geometry(df: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = (c(n) for n in BOX)
    cx, cy = box_center(x1, y1, x2, y2)
    return df.withColumns({"center_x": cx, "center_y": cy, "width": x2 - x1, "height": y2 - y1})


def split_detections(df: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Keep known classes at or above their own confidence floor."""
    return df.filter(c("confidence") >= lookup(c("class_name"), floors))


def rim_candidates(df: DataFrame, source: str) -> DataFrame:
    x1, y1, x2, y2 = (c(n) for n in BOX)
    cx, cy = box_center(x1, y1, x2, y2)
    return df.select(*[n for n in df.columns if n not in BOX], cx.alias("x"), cy.alias("y"), box_radius(x1, y1, x2, y2).alias("radius"), F.lit(source).alias("source"))


def rim_from_box(df: DataFrame) -> DataFrame:
    """Target prior from a box that may span the board: it sits at 60 percent of the height."""
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    kept = df.filter((w > 1) & (h > 1))
    return kept.select(
        *[n for n in df.columns if n not in BOX], ((c("x1") + c("x2")) / 2).alias("x"), (c("y1") + F.lit(0.6) * h).alias("y"), (F.greatest(w, h) / 2).alias("radius")
    )


def size_ok(height: Column, frame_height: Column, p: DetectionParams = DEFAULTS.detection) -> Column:
    return (height / frame_height).between(p.min_rel_height, p.max_rel_height)


def rescore(df: DataFrame, p: DetectionParams = DEFAULTS.detection) -> DataFrame:
    """Drop candidates without shape or colour support and raise the others' confidence."""
    kept = df.filter((c("shape") >= p.shape_floor) | (c("color") >= p.color_floor))
    return kept.withColumn("confidence", F.least(F.lit(1.0), c("confidence") + F.lit(0.15) * c("shape") + F.lit(0.15) * c("color")))


def remap_point(x: Column, y: Column, roi: Sequence[Column], width: Column, height: Column) -> tuple[Column, Column]:
    """Crop coordinates in [0, 1] to full-frame coordinates in [0, 1]."""
    x1, y1, x2, y2 = roi
    return (x1 + x * (x2 - x1)) / width, (y1 + y * (y2 - y1)) / height


def hoop_roi(cx: Column, cy: Column, r: Column, width: Column, height: Column, factor: float = 5.0) -> Column:
    """Clipped search box around the target, with more room above it."""
    half = r * F.lit(factor)
    whole = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    return F.struct(
        F.greatest(F.lit(0), whole(cx - half)).alias("x1"), F.greatest(F.lit(0), whole(cy - half * F.lit(1.3))).alias("y1"),
        F.least(width, whole(cx + half)).alias("x2"), F.least(height, whole(cy + half)).alias("y2"),
    )


def keep_relevant(images: DataFrame, boxes: str, labels: Sequence[str]) -> DataFrame:
    """Filter each image's boxes by label and drop images left with none."""
    kept = images.withColumn(boxes, F.filter(boxes, lambda b: b["label"].isin(*labels)))
    return kept.filter(F.size(boxes) > 0)


def to_coco_boxes(boxes: DataFrame) -> DataFrame:
    """Centre boxes to corner boxes with area and category."""
    label = lookup(c("label"), LABELS)
    return boxes.withColumns(
        {
            "category_id": lookup(label, CATEGORY_IDS),
            "bbox_x": F.round(c("cx") - c("w") / 2, 2), "bbox_y": F.round(c("cy") - c("h") / 2, 2),
            "bbox_w": F.round("w", 2), "bbox_h": F.round("h", 2), "area": F.round(c("w") * c("h"), 2),
        }
    ).filter(c("category_id").isNotNull()).drop("cx", "cy", "w", "h")


def drop_warnings(col: Column, pattern: str) -> Column:
    return F.filter(col, lambda w: ~w.rlike(pattern))


def trigger_type(warnings: Column) -> Column:
    inferred = F.exists(warnings, lambda w: w.contains("load_phase_inferred"))
    return F.when(inferred, "fallback").otherwise("primary")


def apply_exclusion(release_found: Column, pose_quality: Column, warnings: Column, floor: float = 0.35) -> Column:
    """Exclusion flag, reason and extended warnings as one struct."""
    tag = F.when(~release_found, "release_could_not_be_estimated").when(pose_quality < floor, "low_pose_confidence_for_this_shot")
    return F.struct(
        (~release_found).alias("excluded_from_analysis"),
        F.when(~release_found, "no_release_detected").alias("exclusion_reason"),
        F.array_compact(F.concat(warnings, F.array(tag))).alias("warnings"),
    )


def pattern_scan(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, hard: Sequence[str], soft: Sequence[str], exempt: Column | None = None) -> DataFrame:
    """Forbidden patterns per document; soft ones are waived where ``exempt`` holds.

    The pattern list is part of the plan, so each text is read once and nothing is joined.
    """
    always = F.array(*[F.lit(p) for p in hard]) if hard else F.array().cast("array<string>")
    waived = F.array(*[F.lit(p) for p in soft]) if soft else F.array().cast("array<string>")
    checks = F.concat(always, waived) if exempt is None else F.when(exempt, always).otherwise(F.concat(always, waived))
    found = F.filter(checks, lambda p: F.contains(c(text), p))
    return docs.select(doc_id, F.explode(found).alias("pattern"))


def require_none(df: DataFrame, message: str) -> DataFrame:
    """Fail the job as soon as any row shows up."""
    return df.filter(F.raise_error(F.lit(message)).isNull())


def validate_media(df: DataFrame, p: MediaParams = DEFAULTS.media) -> DataFrame:
    """Add ``code``: the first failed rule of a media inventory row, null when fine."""
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    duration = F.when(c("fps") > 0, c("frame_count") / c("fps")).otherwise(0.0)
    rules = (
        ("unsupported_extension", ~ext.isin(*p.extensions)),
        ("file_too_large", c("size_bytes") / (1024 * 1024) > p.max_size_mb),
        ("unreadable_video", ~c("readable")),
        ("no_frames", (c("width") <= 0) | (c("height") <= 0)),
        ("resolution_too_low", (c("width") < p.min_width) | (c("height") < p.min_height)),
        ("bad_metadata", (c("fps") <= 0) | (c("frame_count") <= 0)),
        ("too_short", duration < p.min_sec),
        ("too_long", duration > p.max_sec),
    )
    code = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        code = F.when(fails, name).otherwise(code)
    return df.withColumn("code", code)


def subsample(frames: DataFrame, target_fps: float = DEFAULTS.media.target_fps) -> DataFrame:
    """Keep every stride-th source frame; needs ``fps`` and ``source_frame_index``."""
    stride = F.greatest(F.lit(1), F.bround(c("fps") / F.lit(target_fps), 0).cast("int"))
    kept = frames.withColumn("_stride", stride).filter(F.pmod("source_frame_index", "_stride") == 0)
    return kept.withColumns(
        {"frame_index": F.floor(c("source_frame_index") / c("_stride")), "timestamp_sec": c("source_frame_index") / c("fps")}
    ).drop("_stride")

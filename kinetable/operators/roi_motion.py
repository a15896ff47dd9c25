"""Motion inside a target region relative to control regions, from gray images.

Each frame pair gives one summed-area table of its pixel differences; a region's sum is then four lookups.  Masks are
taken out as spans: the person's box is one more rectangle, the object's disk one span a row.  The work of a pair is that
of its table, whatever the regions' number and size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.ordered import Series, prev_row, scan

c = F.col
EPS = 1e-6


class AreaTable:
    """Sums and pixel counts of rectangles ``[x0, x1) x [y0, y1)`` of one difference image."""

    def __init__(self, diff: np.ndarray):
        self.height, self.width = diff.shape
        self.sums = np.zeros((self.height + 1, self.width + 1))
        np.cumsum(np.cumsum(diff, axis=0), axis=1, out=self.sums[1:, 1:])

    def box(self, x0: int, y0: int, x1: int, y1: int) -> tuple[float, int]:
        x0, x1, y0, y1 = max(x0, 0), min(x1, self.width), max(y0, 0), min(y1, self.height)
        if x1 <= x0 or y1 <= y0:
            return 0.0, 0
        s = self.sums
        return float(s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]), (x1 - x0) * (y1 - y0)

    def mean(self, region: tuple, person: tuple | None, spans: list[tuple[int, int, int]]) -> float | None:
        """Mean over the region's kept pixels: 0 when none is left, null for an empty region."""
        x0, y0, x1, y1 = region
        if x1 <= x0 or y1 <= y0:
            return None
        total, n = self.box(*region)
        parts = []
        if person is not None:
            px0, py0, px1, py1 = person
            parts.append((max(x0, px0), max(y0, py0), min(x1, px1), min(y1, py1)))
        for y, a, b in spans:
            if y0 <= y < y1:
                a, b = max(a, x0), min(b, x1)
                if person is not None and py0 <= y < py1:  # what the person's box has taken out already
                    parts += [(a, y, min(b, px0), y + 1), (max(a, px1), y, b, y + 1)]
                else:
                    parts.append((a, y, b, y + 1))
        for part in parts:
            s, k = self.box(*part)
            total, n = total - s, n - k
        return total / n if n else 0.0


def disk_spans(x: float, y: float, r: float, height: int) -> list[tuple[int, int, int]]:
    """The pixels within ``r`` of a point, as ``(row, first, behind last)``."""
    out = []
    for row in range(max(0, ceil(y - r)), min(height, floor(y + r) + 1)):
        left = r * r - (row - y) ** 2
        half = sqrt(max(left, 0.0))
        a, b = ceil(x - half), floor(x + half)
        a -= (a - 1 - x) ** 2 <= left
        b += (b + 1 - x) ** 2 <= left
        if a <= b:
            out.append((row, a, b + 1))
    return out


def _pair_motion(now: np.ndarray, before: np.ndarray, width: int, regions: list[tuple], ball: dict | None, person: dict | None) -> list[float | None]:
    table = AreaTable(np.abs(now - before).reshape(-1, width))
    box = None if person is None else (ceil(person["x1"]), ceil(person["y1"]), floor(person["x2"]) + 1, floor(person["y2"]) + 1)
    box = box if box and box[0] < box[2] and box[1] < box[3] else None
    spans = [] if ball is None else disk_spans(ball["x"], ball["y"], ball["r"], table.height)
    return [table.mean(r, box, spans) for r in regions]


def roi_motion(frames: DataFrame, series: Series, gray: str, width: int | Column, target: Sequence[Column], controls: Sequence[Sequence[Column]], ball: Column, person: Column) -> DataFrame:
    """Per frame pair: target motion, mean control motion and their ratio.

    ``ball`` is a nullable struct ``{x, y, r, source}``, ``person`` a nullable ``{x1, y1, x2, y2}``;
    the pixels of both are left out, using the previous frame's where this one has none.
    """
    rows = frames.withColumns({"_ball": ball, "_person": person, "_w": F.lit(width) if isinstance(width, int) else width})
    rows = scan(rows, series, _q=prev_row(F.struct(c(gray).alias("g"), "_ball", "_person"))).filter(c("_q").isNotNull())
    rows = rows.withColumns({"_b": F.coalesce("_ball", "_q._ball"), "_m": F.coalesce("_person", "_q._person")})
    keys = [*series.keys, *series.order]
    areas = F.array(*[F.array(*[v.cast("int") for v in region]) for region in (target, *controls)])
    source = F.coalesce(c("_b")["source"], F.lit("none")).alias("mask_source")
    given = rows.select(*keys, c(gray).alias("_now"), c("_q.g").alias("_before"), "_w", areas.alias("_areas"), "_b", "_m", c("_m").isNotNull().alias("mask_available"), source)
    schema = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in keys) + ", motions array<double>, mask_available boolean, mask_source string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for i in range(batch.num_rows):
                now, before = (held[n][i].values for n in ("_now", "_before"))
                areas_, b, m = (held[n][i].as_py() for n in ("_areas", "_b", "_m"))
                if now is None or before is None or len(now) != len(before):
                    out.append([None] * len(areas_))
                    continue
                pixels = [v.to_numpy(zero_copy_only=False).astype(np.float64) for v in (now, before)]
                out.append(_pair_motion(*pixels, held["_w"][i].as_py(), [tuple(a) for a in areas_], b, m))
            yield pa.RecordBatch.from_arrays([*[held[n] for n in keys], pa.array(out, pa.list_(pa.float64())), held["mask_available"], held["mask_source"]], names=[*keys, "motions", "mask_available", "mask_source"])

    found = given.mapInArrow(run, schema)
    sides = F.array_compact(F.slice("motions", 2, max(1, len(controls))))
    control = F.when(F.size(sides) > 0, F.aggregate(sides, F.lit(0.0), lambda a, v: a + v) / F.size(sides)).otherwise(F.lit(0.0))
    own = F.get("motions", F.lit(0))
    return found.select(
        *keys, F.round(own, 4).alias("target_motion"), F.round(control, 4).alias("control_motion"),
        F.round(own / F.greatest(control, F.lit(EPS)), 4).alias("relative_motion"), "mask_available", "mask_source",
    )

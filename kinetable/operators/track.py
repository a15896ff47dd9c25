"""Object tracks with provenance as an ordered fold, and primary-subject selection in one pass."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from functools import reduce
from math import hypot, sqrt
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators.fold import Fold, keyed_fold
from kinetable.operators.onepass import Machine, PlaceIndex, ordered_pass
from kinetable.params import DEFAULTS, TrackParams

c = F.col


class TrackFold(Fold):
    """Constant-velocity filter with gating.

    Both axes share one 2x2 covariance, so the state is ten scalars: position and velocity
    per axis, covariance, misses in a row, last time, smoothed radius.
    """

    columns = ("frame_index", "timestamp_sec", "candidates")
    schema = T.StructType(
        [
            T.StructField("frame_index", T.LongType()), T.StructField("timestamp_sec", T.DoubleType()),
            T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("radius", T.DoubleType()),
            T.StructField("confidence", T.DoubleType()), T.StructField("source", T.StringType()),
        ]
    )

    def __init__(self, p: TrackParams = DEFAULTS.track):
        self.p = p

    def start(self):
        return {"m": None, "r": None, "t": None}

    def _choose(self, model, candidates):
        if candidates is None or len(candidates) == 0:
            return None
        if model is None:
            return max(candidates, key=lambda d: d["confidence"])
        x, y = model[0], model[1]
        return min(candidates, key=lambda d: (hypot(d["x"] - x, d["y"] - y), -d["confidence"]))

    def _advance(self, model, dt):
        x, y, vx, vy, a, b, d, misses = model
        q = self.p.process_noise
        a, b, d = a + 2 * dt * b + dt * dt * d + q * dt**4 / 4, b + dt * d + q * dt**3 / 2, d + q * dt * dt
        return [x + vx * dt, y + vy * dt, vx, vy, a, b, d, misses]

    def _correct(self, model, zx, zy):
        x, y, vx, vy, a, b, d, _ = model
        gain_p, gain_v = a / (a + self.p.measurement_noise), b / (a + self.p.measurement_noise)
        ex, ey = zx - x, zy - y
        return [x + gain_p * ex, y + gain_p * ey, vx + gain_v * ex, vy + gain_v * ey, (1 - gain_p) * a, (1 - gain_p) * b, d - gain_v * b, 0]

    def step(self, state, row):
        frame, t, candidates = row
        p, model, last = self.p, state["m"], state["t"]
        best = self._choose(model, candidates)
        if model is None:
            if best is not None:
                model = [best["x"], best["y"], 0.0, 0.0, p.initial_variance, 0.0, p.initial_variance, 0]
            seen = best is not None
        else:
            model = self._advance(model, max(p.min_dt, t - last))
            reach = p.max_jump_px * (model[7] + 1)
            seen = best is not None and hypot(best["x"] - model[0], best["y"] - model[1]) <= reach
            if seen:
                model = self._correct(model, best["x"], best["y"])
            else:
                model[7] += 1
        radius = state["r"]
        if best is not None:
            radius = best["radius"] if radius is None else p.radius_decay * radius + (1 - p.radius_decay) * best["radius"]
        shown = radius or p.default_radius
        if seen:
            out = (frame, t, best["x"], best["y"], shown, best["confidence"], "detected")
        elif model is None or model[7] > p.max_misses:
            out = (frame, t, None, None, shown, 0.0, "unavailable")
        else:
            fade = max(0.0, 1.0 - model[7] / (p.max_misses + 1))
            source = "interpolated" if model[7] <= p.interpolated_misses else "predicted"
            out = (frame, t, model[0], model[1], shown, p.coast_confidence * fade, source)
        return {"m": model, "r": radius, "t": t}, [out]


def gather_candidates(spine: DataFrame, dets: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per frame of the spine with its (few) candidates in input order."""
    entry = F.struct(c(order).alias("o"), "x", "y", "radius", "confidence")
    per = dets.groupBy(*keys, "frame_index").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    return spine.join(per, [*keys, "frame_index"], "left")


def track(frames: DataFrame, keys: Sequence[str] = ("sid",), block: Column | None = None, p: TrackParams = DEFAULTS.track) -> DataFrame:
    """Track per key; ``frames`` has ``frame_index, timestamp_sec, candidates`` (array or null)."""
    cut = F.floor(c("frame_index") / 4096) if block is None else block
    return keyed_fold(frames, keys, ["frame_index"], cut, TrackFold(p))


class PrimaryMachine(Machine):
    """Greedy nearest-centre slots; the present slot with the largest recent mean area wins.

    Rows are boxes in the order of frame and id; a row without an id is a frame without boxes.  Slots lie on a grid
    and keep a ring of their last areas.  Distances and sums are those of SQL to the last bit (``hypot`` and ``sum``
    round better), as boxes with equal distances or areas are frequent.
    """

    columns = ("frame_index", "id", "x1", "y1", "x2", "y2")
    schema = T.StructType([T.StructField("frame_index", T.LongType()), T.StructField("box_id", T.LongType()), T.StructField("slot", T.LongType())])

    def __init__(self, reach: float = 1.5, recent: int = 30, cell: float = 64.0):
        self.reach, self.recent = reach, recent
        self.places, self.areas = PlaceIndex(cell), []
        self.frame, self.holder = None, {}

    def row(self, frame, box, x1, y1, x2, y2):
        out = self.end() if frame != self.frame else []
        self.frame = frame
        if box is None:
            return out
        w, h, cx, cy = x2 - x1, y2 - y1, (x1 + x2) / 2, (y1 + y2) / 2
        held, far = self.places, self.reach * max(w, h)
        near = min(((sqrt((cx - held.x[i]) ** 2 + (cy - held.y[i]) ** 2), i) for i in held.around(cx, cy, far)), default=None)
        if near is None or near[0] >= far:
            at = held.add(cx, cy)
            self.areas.append(deque(maxlen=self.recent))
        else:
            at = near[1]
            held.move(at, cx, cy)
        self.areas[at].append(w * h)
        self.holder[at] = box
        return out

    def end(self):
        if self.frame is None:
            return []
        best = max(sorted(self.holder), key=lambda i: reduce(add, self.areas[i]) / len(self.areas[i]), default=None)
        out = [(self.frame, self.holder.get(best), best)]
        self.frame, self.holder = None, {}
        return out


def select_primary(boxes: DataFrame, keys: Sequence[str], reach: float = 1.5, recent: int = 30) -> DataFrame:
    """Primary box per frame; ``boxes`` has ``frame_index, id, x1, y1, x2, y2``, a row a box."""
    m = PrimaryMachine
    return ordered_pass(boxes, keys, ["frame_index", "id"], m.columns, m.schema, lambda: m(reach, recent))

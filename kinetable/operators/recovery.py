"""Gap recovery: extend an attempt's track through frames without a reliable point.

Seeds, the speed bound and the candidates are joined with Spark; the chain itself is a machine
that each task's sorted candidates stream through, an attempt after the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.scores import RELIABLE_SOURCES
from kinetable.operators.aggregates import nearest_rank
from kinetable.operators.joins import interval_join, last_at_or_before, prefer_new
from kinetable.operators.lineage import stage
from kinetable.operators.onepass import Machine, ordered_pass
from kinetable.operators.ordered import Series, dim_join, prev_row, scan
from kinetable.operators.windows import MIN_DT, bounded_windows
from kinetable.params import DEFAULTS, RecoveryParams

c = F.col


def speed_bound(ball: DataFrame, keys: Sequence[str]) -> DataFrame:
    """95th percentile speed between consecutive detected points of each key."""
    seen = scan(ball.filter(c("source") == "detected"), Series.frames(keys), _p=prev_row(F.struct("timestamp_sec", "x", "y")))
    dt = c("timestamp_sec") - c("_p.timestamp_sec")
    moving = seen.filter(dt > MIN_DT).withColumn("v", F.hypot(c("x") - c("_p.x"), c("y") - c("_p.y")) / dt)
    return nearest_rank(moving, keys, "v", name="vmax").drop("n")


def _misfit(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances to a line in ``x`` and a parabola in ``y`` over ``t``, fitted as ``np.polyfit`` does from one set of powers."""
    powers = np.column_stack([t * t, t, np.ones(len(t))])
    scale, few = np.sqrt((powers * powers).sum(axis=0)), len(t) * np.finfo(float).eps
    powers /= scale
    a, b = np.linalg.lstsq(powers[:, 1:], x, few)[0] / scale[1:]
    d, e, f = np.linalg.lstsq(powers, y, few)[0] / scale
    return np.hypot(x - (a * t + b), y - ((d * t + e) * t + f))


def prune_by_fit(points: list[tuple], radius: float, p: RecoveryParams) -> list[tuple]:
    """Drop the worst point against a constant-acceleration fit until all are close; the seed stays."""
    for _ in range(p.fit_max_rounds):
        if len(points) < p.fit_min_points:
            break
        t, x, y = (np.array([q[i] for q in points], dtype=float) for i in range(3))
        t = t - t[0]
        off = _misfit(t, x, y)
        worst = 1 + int(np.argmax(off[1:]))
        if off[worst] <= p.residual_floor_px or off[worst] <= max(p.residual_floor_px, min(radius * 1.5, 2.5 * float(np.median(off)))):
            break
        points = points[:worst] + points[worst + 1 :]
    return points


NAN = float("nan")


def _number(v) -> float:
    return NAN if v is None else float(v)


def _length(x: float, y: float) -> float:
    """The C library's ``hypot``, as numpy has it, to the last bit."""
    try:
        return abs(complex(x, y))
    except OverflowError:
        return float("inf")


class ChainMachine(Machine):
    """Candidates of one attempt by frame: the accepted ones, pruned, once the attempt ends.

    Every frame offers its candidates; the one nearest to the predicted place wins if it is inside a gate that
    grows with the time since the last accepted point.  A missing number compares as NaN.
    """

    columns = ("frame_index", "timestamp_sec", "x", "y", "radius", "confidence", "seed_t", "seed_x", "seed_y", "prev_t", "prev_x", "prev_y", "hoop_r", "vmax")
    schema = T.StructType(
        [T.StructField("frame_index", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("timestamp_sec", "x", "y", "radius", "confidence")], T.StructField("source", T.StringType())]
    )

    def __init__(self, p: RecoveryParams = DEFAULTS.recovery):
        self.p, self.kept, self.repeats, self.frame, self.best = p, [], 0, None, None
        self.stopped = False

    def row(self, frame, time, x, y, radius, confidence, *seed) -> list[tuple]:
        if not self.kept:
            self._seed(*map(_number, seed))
        if frame != self.frame:
            self._accept()
            self.frame = frame
        time, confidence = _number(time), _number(confidence)
        if self.stopped or not (confidence >= self.p.min_confidence and time > self.last):
            return []
        dt, x, y = time - self.last, _number(x), _number(y)
        miss = _length(x - (self.x + dt * self.vx), y - (self.y + dt * self.vy))
        if miss > self.vmax * self.p.gate_factor * dt * 0.5 + self.hoop_r * 0.75:
            miss = float("inf")
        if self.best is None or miss < self.best[0] or (miss != miss and self.best[0] == self.best[0]):  # a NaN is taken first, and is no match
            self.best = (miss, time, x, y, _number(radius), confidence)
        return []

    def _seed(self, t, x, y, before, px, py, hoop_r, vmax) -> None:
        self.x, self.y, self.vx, self.vy, self.last, self.hoop_r, self.vmax = x, y, 0.0, 0.0, t, hoop_r, vmax
        if t - before > MIN_DT:
            self.vx, self.vy = (x - px) / (t - before), (y - py) / (t - before)
        self.kept.append((t, x, y, -1, 0.0, 0.0))

    def _accept(self) -> None:
        """The best candidate of the frame that ends, if it has one."""
        if self.best is None:
            return
        (miss, time, x, y, radius, confidence), self.best = self.best, None
        if not isfinite(miss):
            return
        static = abs(x - self.x) < self.p.static_eps_px and abs(y - self.y) < self.p.static_eps_px
        self.repeats = self.repeats + 1 if static else 0
        if self.repeats > self.p.max_static:
            self.stopped = True
            return
        dt = time - self.last
        if dt > MIN_DT:
            self.vx, self.vy = (x - self.x) / dt, (y - self.y) / dt
        self.x, self.y, self.last = x, y, time
        self.kept.append((time, x, y, self.frame, radius, confidence))

    def chain(self) -> list[tuple]:
        """Accepted ``(t, x, y, frame, radius, confidence)`` in frame order."""
        self._accept()
        return prune_by_fit(self.kept, self.hoop_r, self.p)[1:]

    def end(self) -> list[tuple]:
        self._accept()
        if len(self.kept) <= self.p.min_chain:  # pruning only takes points away
            return []
        found = self.chain()
        n = len(found)
        if n < self.p.min_chain:
            return []
        return [(f, t, x, y, r if r == r else None, min(0.6, conf + 0.05 * n), "detected") for t, x, y, f, r, conf in found]


def chain(cands: pd.DataFrame, p: RecoveryParams = DEFAULTS.recovery) -> list[tuple]:
    """Accepted ``(t, x, y, frame, radius, confidence)`` of one attempt, in frame order."""
    machine = ChainMachine(p)
    for row in cands.sort_values("frame_index", kind="stable")[list(machine.columns)].itertuples(index=False):
        machine.row(*row)
    return machine.chain()


def recover_points(windows: DataFrame, ball: DataFrame, candidates: DataFrame, hoops: DataFrame, keys: Sequence[str] = ("sid",), margin_frames: int = 15, p: RecoveryParams = DEFAULTS.recovery) -> DataFrame:
    """New points per attempt: ``(keys, shot_index, frame_index, timestamp_sec, x, y, radius, confidence, source)``."""
    k, per = list(keys), [*keys, "shot_index"]
    wins = bounded_windows(windows.select(*per, "start_frame", "end_frame"), Series.frames(k, "start_frame"), "end_frame", margin_frames)
    ball = stage(ball.select(*k, "frame_index", "timestamp_sec", "x", "y", "source"))
    solid = ball.filter(c("source").isin(*RELIABLE_SOURCES)).select(*k, "frame_index", "timestamp_sec", "x", "y")
    anchors = scan(solid, Series.frames(k), _p=prev_row(F.struct("timestamp_sec", "x", "y")))
    seed = F.struct(
        c("timestamp_sec").alias("seed_t"), c("x").alias("seed_x"), c("y").alias("seed_y"),
        c("_p.timestamp_sec").alias("prev_t"), c("_p.x").alias("prev_x"), c("_p.y").alias("prev_y"),
    )
    seeded = last_at_or_before(wins, anchors, k, "start_frame", "frame_index", seed, "floor(_t / 4096)", "seed")
    seeded = dim_join(seeded.filter(c("seed").isNotNull()), hoops.select(*k, "hoop_r"), k, spread=["shot_index"])
    seeded = dim_join(seeded, speed_bound(ball, k), k, spread=["shot_index"]).filter("vmax > 0")
    seeded = stage(seeded).select(*per, "start_frame", "hi", "seed.*", "hoop_r", "vmax")
    gaps = candidates.join(solid.select(*k, "frame_index"), [*k, "frame_index"], "left_anti")
    offered = interval_join(gaps.select(*k, "frame_index", "timestamp_sec", "x", "y", "radius", "confidence", "cand_id"), seeded, k, "frame_index", "start_frame", "hi")
    offered = offered.withColumn("_nameless", c("cand_id").isNull())
    return ordered_pass(offered, per, ["frame_index", "_nameless", "cand_id"], ChainMachine.columns, ChainMachine.schema, lambda: ChainMachine(p))


def enrich(points: DataFrame, recovered: DataFrame, keys: Sequence[str] = ("sid", "shot_index")) -> DataFrame:
    """Recovered points replace the base points of the same frame."""
    cols = [*keys, "frame_index", "timestamp_sec", "x", "y", "radius", "confidence", "source"]
    return prefer_new(points.select(cols), recovered.select(cols), [*keys, "frame_index"])

"""Window operators over ordered series, built on block scans and halos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators.fold import Fold, keyed_fold
from kinetable.operators.lineage import stage
from kinetable.operators.ordered import Series, first_after, islands, last_before, next_row, prev_row, running_sum, scan, total, with_halo
from kinetable.params import DEFAULTS, DetectionParams, ReleaseEventParams, SegmentParams, TrackParams

c = F.col
MIN_DT = 1e-6


def velocity(df: DataFrame, series: Series, y: str, t: str, available: Column, scale: Column, name: str = "velocity") -> DataFrame:
    """Change of ``y`` per second over ``scale``; null unless this and the previous row are available."""
    rows = scan(df, series, _v=prev_row(F.struct(c(y).alias("y"), c(t).alias("t"), available.alias("ok"))))
    dt = c(t) - c("_v.t")
    value = F.when(available & c("_v.ok") & (dt > MIN_DT), (c(y) - c("_v.y")) / dt / scale)
    return rows.withColumn(name, value).drop("_v")


def min_distance(x: Column, y: Column, targets: Sequence[Column], scale: Column) -> Column:
    """Distance to the nearest of several nullable ``{x, y}`` structs, over ``scale``."""
    each = [F.when(w.isNotNull(), F.hypot(x - w["x"], y - w["y"])) for w in targets]
    return (F.least(*each) if len(each) > 1 else each[0]) / scale


def consecutive_pairs(df: DataFrame, series: Series, fields: Sequence[str]) -> DataFrame:
    """Pair every row but the first with its predecessor as ``a``."""
    return scan(df, series, a=prev_row(F.struct(*fields))).filter(c("a").isNotNull())


def _near_line(prev: Column, nxt: Column, p: ReleaseEventParams) -> Column:
    dt = nxt["t"] - prev["t"]
    share = (c("timestamp_sec") - prev["t"]) / F.when(dt > MIN_DT, dt)
    off = F.hypot(c("x") - (prev["x"] + share * (nxt["x"] - prev["x"])), c("y") - (prev["y"] + share * (nxt["y"] - prev["y"])))
    span = F.hypot(nxt["x"] - prev["x"], nxt["y"] - prev["y"])
    return (dt <= MIN_DT) | (off <= F.greatest(span * F.lit(p.span_frac), F.lit(p.min_tolerance_px)))


def trusted(df: DataFrame, series: Series, p: ReleaseEventParams = DEFAULTS.event) -> DataFrame:
    """Two-pass consistency: detected against detected, then interpolated against the survivors."""
    at = F.struct(c("timestamp_sec").alias("t"), "x", "y")
    placed = df.filter(c("x").isNotNull() & c("y").isNotNull() & c("source").isin("detected", "interpolated"))
    seen = F.when(c("source") == "detected", at)
    rows = scan(placed, series, _b=last_before(seen), _a=first_after(seen))
    both = c("_b").isNotNull() & c("_a").isNotNull()
    rows = rows.withColumn("_ok", (c("source") == "detected") & (~both | _near_line(c("_b"), c("_a"), p))).drop("_b", "_a")
    clean = F.when(c("_ok"), at)
    rows = scan(rows, series, _b=last_before(clean), _a=first_after(clean), _n=total(F.when(c("_ok"), 1).otherwise(0)))
    bridged = (c("source") == "interpolated") & (c("_n") >= 2) & both & _near_line(c("_b"), c("_a"), p)
    return rows.filter(c("_ok") | F.coalesce(bridged, F.lit(False))).drop("_b", "_a", "_n", "_ok")


def streaks(df: DataFrame, series: Series, qualifies: Column, k: int) -> DataFrame:
    """Runs of at least ``k`` consecutive qualifying rows: first row, last row, length."""
    first = series.order[0]
    rows = islands(df, series, ~F.coalesce(qualifies, F.lit(False)), "_run").filter(F.coalesce(qualifies, F.lit(False)))
    runs = rows.groupBy(*series.keys, "_run").agg(
        F.min(first).alias("start"), F.max(first).alias("end"), F.count(F.lit(1)).alias("length")
    )
    return runs.filter(c("length") >= k).drop("_run")


def chains(df: DataFrame, series: Series, t: str, max_gap: float, name: str = "chain") -> DataFrame:
    """Number the gap-bounded chains: a chain breaks when the step is not in (1e-6, max_gap]."""
    rows = scan(df, series, _t=prev_row(c(t)))
    step = c(t) - c("_t")
    breaks = step.isNotNull() & ~((step > MIN_DT) & (step <= max_gap))
    return islands(rows, series, breaks, name).drop("_t")


def state_runs(df: DataFrame, series: Series, state: str) -> DataFrame:
    """Runs of equal ``state``: value, first and last row, number of rows."""
    first = series.order[0]
    rows = scan(df, series, _s=prev_row(c(state)))
    rows = islands(rows, series, c("_s").isNull() | (c("_s") != c(state)), "run")
    return rows.groupBy(*series.keys, "run", state).agg(
        F.min(first).alias("start"), F.max(first).alias("end"), F.count(F.lit(1)).alias("length")
    )


def genuine_dip(df: DataFrame, keys: Sequence[str], pos: str, knee: str, p: SegmentParams = DEFAULTS.segment) -> DataFrame:
    """Add ``dip_ok``: the angle fell far enough to its trailing minimum (no data passes)."""
    halo = with_halo(df, keys, pos, before=p.lookback_rows - 1)
    w = halo.window().rowsBetween(-(p.lookback_rows - 1), 0)
    seen = F.collect_list(F.when(c(knee).isNotNull(), F.struct(c(knee).alias("v"), c(pos).alias("i")))).over(w)
    rows = halo.select(_seen=seen).withColumn("_low", F.array_min("_seen"))
    high = F.array_max(F.transform(F.filter("_seen", lambda e: e["i"] < c("_low.i")), lambda e: e["v"]))
    ok = F.when(F.size("_seen") == 0, True).otherwise(F.coalesce(high - c("_low.v") >= p.knee_drop_deg, F.lit(False)))
    return rows.withColumn("dip_ok", ok).drop("_seen", "_low")


def stationary(df: DataFrame, keys: Sequence[str], pos: str, hip: str, p: SegmentParams = DEFAULTS.segment) -> DataFrame:
    """Add ``stationary_ok``: the trailing range of the hip position is small (no data passes)."""
    halo = with_halo(df, keys, pos, before=p.lookback_rows - 1)
    w = halo.window().rowsBetween(-(p.lookback_rows - 1), 0)
    return halo.select(stationary_ok=F.coalesce(F.max(hip).over(w) - F.min(hip).over(w) <= p.max_hip_range, F.lit(True)))


def trailing_mean(df: DataFrame, keys: Sequence[str], pos: str, value: str, n: int = 30, name: str = "trailing_mean") -> DataFrame:
    halo = with_halo(df, keys, pos, before=n - 1)
    return halo.select(**{name: F.avg(value).over(halo.window().rowsBetween(-(n - 1), 0))})


def trail(df: DataFrame, keys: Sequence[str], pos: str, fields: Sequence[str], n: int = 10, name: str = "trail") -> DataFrame:
    """The last ``n`` rows up to the current one as an array of structs."""
    halo = with_halo(df, keys, pos, before=n - 1)
    return halo.select(**{name: F.collect_list(F.struct(*fields)).over(halo.window().rowsBetween(-(n - 1), 0))})


def trailing_min(df: DataFrame, keys: Sequence[str], pos: str, value: str, k: int = 3, name: str = "trailing_min") -> DataFrame:
    halo = with_halo(df, keys, pos, before=k - 1)
    return halo.select(**{name: F.min(value).over(halo.window().rowsBetween(-(k - 1), 0))})


def bounded_windows(windows: DataFrame, series: Series, end: str, margin: int, name: str = "hi") -> DataFrame:
    """Extend each interval by ``margin``, but never into the next one."""
    start = series.order[0]
    rows = scan(windows, series, _next=next_row(c(start)))
    return rows.withColumn(name, F.least(c(end) + margin, c("_next") - 1)).drop("_next")


def prefix_count(df: DataFrame, series: Series, where: Column, name: str = "prefix_count") -> DataFrame:
    return scan(df, series, **{name: running_sum(F.when(where, 1).otherwise(0).cast("long"))})


def bracket(df: DataFrame, series: Series, anchor: Column, fields: Sequence[str]) -> DataFrame:
    """Previous and next anchor row strictly around each row, as structs."""
    at = F.when(anchor, F.struct(*fields))
    return scan(df, series, anchor_before=last_before(at), anchor_after=first_after(at))


def static_run_cut(df: DataFrame, series: Series, eps: float = DEFAULTS.recovery.static_eps_px, most: int = DEFAULTS.recovery.max_static) -> DataFrame:
    """Drop everything from the row that repeats its predecessor's place once too often."""
    rows = scan(df, series, _q=prev_row(F.struct("x", "y")))
    repeat = F.coalesce((F.abs(c("x") - c("_q.x")) < eps) & (F.abs(c("y") - c("_q.y")) < eps), F.lit(False))
    rows = rows.withColumn("_rep", repeat).drop("_q")
    rows, moved = stage(rows), ~c("_rep")
    rows = scan(rows, series, _all=running_sum(F.when(c("_rep"), 1).otherwise(0)))
    rows = scan(rows, series, _base=last_before(F.when(moved, c("_all"))))
    rows = rows.withColumn("_over", c("_rep") & (c("_all") - F.coalesce("_base", F.lit(0)) > most))
    rows = scan(rows, series, _cut=running_sum(F.when(c("_over"), 1).otherwise(0)))
    return rows.filter(c("_cut") == 0).drop("_rep", "_all", "_base", "_over", "_cut")


class EmaFold(Fold):
    """r <- decay * r + (1 - decay) * x over the rows that have a value; emits every row."""

    def __init__(self, order: Sequence[str], value: str, decay: float, default: float):
        self.columns = [*order, value]
        self.decay, self.default, self.n = decay, default, len(order)
        self.schema = T.StructType()

    def start(self):
        return None

    def step(self, state, row):
        x = row[-1]
        if x is not None:
            state = float(x) if state is None else self.decay * state + (1 - self.decay) * x
        return state, [(*row[: self.n], state if state is not None else self.default)]


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: Column, p: TrackParams = DEFAULTS.track, name: str = "ema") -> DataFrame:
    fold = EmaFold(order, value, p.radius_decay, p.default_radius)
    fold.schema = T.StructType([*[df.schema[o] for o in order], T.StructField(name, T.DoubleType())])
    return keyed_fold(df, keys, order, block, fold)


class LandmarkFold(Fold):
    """EMA of many coordinates at once; an undetected frame resets all of them."""

    def __init__(self, order: str, detected: str, names: Sequence[str], alpha: float, order_type: T.DataType):
        self.columns = [order, detected, *names]
        self.alpha = alpha
        self.schema = T.StructType([T.StructField(order, order_type), *[T.StructField(n, T.DoubleType()) for n in names]])

    def start(self):
        return None

    def step(self, state, row):
        frame, detected, *values = row
        if not detected:
            return None, [(frame, *[None] * len(values))]
        if state is None:
            state = [None] * len(values)
        state = [
            s if v is None else v if s is None else self.alpha * v + (1 - self.alpha) * s for v, s in zip(values, state)
        ]
        return state, [(frame, *state)]


def smooth_landmarks(df: DataFrame, keys: Sequence[str], order: str, detected: str, names: Sequence[str], block: Column, p: DetectionParams = DEFAULTS.detection) -> DataFrame:
    fold = LandmarkFold(order, detected, names, p.smoothing_alpha, df.schema[order].dataType)
    return keyed_fold(df, keys, [order], block, fold)


class CooldownFold(Fold):
    """Keep an event only if it is far enough from the last kept one."""

    def __init__(self, order: str, order_type: T.DataType, weak: str, gap: int, suppress: int):
        self.columns = [order, weak]
        self.gap, self.suppress = gap, suppress
        self.schema = T.StructType([T.StructField(order, order_type)])

    def start(self):
        return [None, None]

    def step(self, state, row):
        last, until = state
        frame, weak = row
        if (last is not None and frame - last < self.gap) or (until is not None and frame < until):
            return state, []
        return [frame, frame + self.suppress if weak else None], [(frame,)]


def cooldown(events: DataFrame, keys: Sequence[str], order: str, weak: str, block: Column, p: SegmentParams = DEFAULTS.segment) -> DataFrame:
    """Cooldown after every kept event, longer suppression after a weak one."""
    fold = CooldownFold(order, events.schema[order].dataType, weak, p.cooldown_frames, p.ownership_frames)
    return keyed_fold(events, keys, [order], block, fold)


def session_windows(df: DataFrame, keys: Sequence[str], ts: str, gap: str) -> DataFrame:
    """Batch form of gap sessionization; the same expression works on a stream."""
    w = F.session_window(ts, gap)
    return df.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, c("w.start").alias("start"), c("w.end").alias("end"), "n")



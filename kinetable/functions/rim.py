"""Target (rim) geometry and the confidence formulas of the outcome ladder.

Weights are fixed values: outcome confidences depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.params import DEFAULTS, OutcomeParams

MIN_DT = 1e-6


def rim_top(cy: Column, r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return cy - F.lit(p.rim_half_height) * r


def rim_bottom(cy: Column, r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return cy + F.lit(p.rim_half_height) * r


def tight_band(r: Column, ball_r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return r * F.lit(p.tight_radii) + ball_r


def wide_band(r: Column, ball_r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return r * F.lit(p.wide_radii) + ball_r


def in_band(x: Column, cx: Column, band: Column) -> Column:
    return F.abs(x - cx) <= band


def above_rim(y: Column, cy: Column, r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return y < rim_top(cy, r, p)


def below_rim(y: Column, cy: Column, r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return y > rim_bottom(cy, r, p)


def near_height(y: Column, cy: Column, r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return F.abs(y - cy) <= r * F.lit(p.near_height_radii)


def dip_ratio(conf_a: Column, conf_b: Column, gap_rows: Column, covered_rows: Column, min_conf: Column) -> Column:
    """How far confidence sinks between two points; an uncovered frame counts as 0."""
    base = F.greatest(conf_a, conf_b)
    return F.when(base <= 0, F.lit(1.0)).when(covered_rows < gap_rows, F.lit(0.0)).otherwise(min_conf / base)


def _trusted(value: Column, hoop_conf: Column, stability: Column) -> Column:
    """``value`` scaled by both factors, one after the other: the order of the products decides the last bit."""
    return value * (F.lit(0.5) + F.lit(0.5) * hoop_conf) * (F.lit(0.5) + F.lit(0.5) * stability)


def crossing_conf(
    drift: Column, max_drift: Column, dip: Column, n_above: Column, n_below: Column, gap_sec: Column,
    both_detected: Column, hoop_conf: Column, stability: Column, p: OutcomeParams = DEFAULTS.outcome,
) -> Column:
    terms = (
        F.lit(0.12)
        + F.lit(0.20) * F.when(max_drift > 0, F.lit(1.0) - drift / max_drift).otherwise(F.lit(0.0))
        + F.lit(0.20) * (F.lit(1.0) - dip / F.lit(p.max_dip))
        + F.lit(0.10) * F.least(F.lit(1.0), n_above / F.lit(float(max(p.min_above, 1))))
        + F.lit(0.08) * F.least(F.lit(1.0), n_below / F.lit(float(max(p.min_below, 1))))
        + F.lit(0.15) * (F.lit(1.0) - gap_sec / F.lit(p.max_cross_sec + 1e-6))
        + F.lit(0.15) * F.when(both_detected, F.lit(1.0)).otherwise(F.lit(0.8))
    )
    return F.least(F.lit(1.0), _trusted(terms, hoop_conf, stability))


def deflect_conf(dt: Column, n_approach: Column, hoop_conf: Column, stability: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    terms = (
        F.lit(0.30)
        + F.lit(0.30) * (F.lit(1.0) - dt / F.lit(p.max_deflect_sec + 1e-6))
        + F.lit(0.20) * F.least(F.lit(1.0), n_approach / F.lit(float(max(p.min_above, 1))))
        + F.least(F.lit(100), n_approach * 8) * 20 / F.lit(10000.0)
    )
    return F.least(F.lit(1.0), _trusted(terms, hoop_conf, stability))


def _grown(base: int, n: Column) -> Column:
    """``base`` and 5 a point, in hundredths: whole numbers until one division, so 0.5 + 0.05 * 3 is 0.65 itself."""
    return F.least(F.lit(100), F.lit(base) + n * 5) / F.lit(100.0)


def beside_conf(n: Column, hoop_conf: Column, stability: Column) -> Column:
    return _trusted(_grown(50, n), hoop_conf, stability)


def far_conf(n: Column, hoop_conf: Column, stability: Column) -> Column:
    return _trusted(_grown(40, n), hoop_conf, stability)


def px_per_metre(r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    return r / F.lit(p.rim_radius_m)


def speed_near_rim(a: Column, b: Column, cx: Column, r: Column, p: OutcomeParams = DEFAULTS.outcome) -> Column:
    """Metres per second between structs ``{x, y, t, radius, source}``; null unless defensible."""
    band = wide_band(r, (a["radius"] + b["radius"]) / 2, p)
    dt = F.abs(b["t"] - a["t"])
    ok = (
        (a["source"] == "detected") & (b["source"] == "detected")
        & in_band(a["x"], cx, band) & in_band(b["x"], cx, band) & (dt > MIN_DT) & (r > 0)
    )
    return F.when(ok, F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / px_per_metre(r, p) / dt)

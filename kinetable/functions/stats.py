"""Small-sample statistics as aggregate and scalar Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.params import DEFAULTS

QUADRATURE_STEPS = 128


def coef_var(mean: Column, std: Column) -> Column:
    return F.when(F.abs(mean) >= 1e-6, F.abs(std / mean))


def rounded_tie(value: Column, digits: int) -> Column:
    """``value`` rounded half away from zero; one within 1e-12 of a tie is a tie, whatever order its rows were folded in."""
    return F.round(F.round(value, 12), digits)


def pooled_effect(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Cohen's d from two groups' mean, sample variance and size."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (m1 - m2) / F.sqrt(pooled))


def effect_label(d: Column) -> Column:
    """Label of an effect; one within 1e-12 of a cut lies on it.

    Small groups of whole numbers hit the cuts exactly (d = 0.5), and the last bit of a variance that was folded
    row by row depends on the order of the rows.
    """
    small, medium, large = DEFAULTS.stats.effect_cuts
    size = F.abs(d) + F.lit(1e-12)
    return (
        F.when(d.isNull(), "unknown")
        .when(size < small, "negligible")
        .when(size < medium, "small")
        .when(size < large, "medium")
        .otherwise("large")
    )


def welch_p(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Two-sided p value of Welch's t test, JVM-side.

    The t tail is an integral of ``cos^(df-1)``, taken with Simpson's rule; the range ends
    where the integrand has vanished, so the step width follows the peak.
    """
    a, b = v1 / n1, v2 / n2
    se2 = a + b
    t = F.abs(m1 - m2) / F.sqrt(se2)
    df = se2 * se2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    n = QUADRATURE_STEPS

    def integral(limit: Column) -> Column:
        top = F.least(limit, F.lit(8.5) / F.sqrt(F.greatest(df - 1, F.lit(1e-9))))
        h = top / F.lit(float(n))
        weight = lambda i: F.when((i == 0) | (i == n), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda acc, i: acc + weight(i) * F.pow(F.cos(i * h), df - 1)) * h / 3

    p = F.lit(1.0) - integral(F.atan(t / F.sqrt(df))) / integral(F.lit(1.5707963267948966))
    return F.when((n1 >= 2) & (n2 >= 2) & (se2 > 0), F.greatest(F.lit(0.0), p))


def straightness(direct: Column, path: Column, n: Column, min_points: int = 2) -> Column:
    return F.when((n >= min_points) & (path >= 1e-9), direct / path)


def fit_line(t: Column, v: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept as aggregates."""
    return F.regr_slope(v, t), F.regr_intercept(v, t)


def fit_parabola(t: Column, v: Column) -> Column:
    """Leading coefficient of the least-squares parabola (normal equations)."""
    n = F.count(F.when(t.isNotNull() & v.isNotNull(), 1))
    s1, s2, s3, s4 = (F.sum(F.pow(t, F.lit(float(k)))) for k in (1, 2, 3, 4))
    b0, b1, b2 = F.sum(v), F.sum(t * v), F.sum(t * t * v)
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    lead = b2 * (s2 * n - s1 * s1) - s3 * (b1 * n - s1 * b0) + s2 * (b1 * s1 - s2 * b0)
    return F.when(F.abs(det) > 1e-12, lead / det)

"""Per-session statistics: consistency, two-group comparison, trends, summary, findings.

Shape of the plan: attempts are gathered by session as they are, then exploded to metric rows and
aggregated by ``(session, metric)``; session-level picks then aggregate the 13-odd metric rows.  A
session of a few attempts is smaller than its moments, so these are not shuffled; for sessions of very many
attempts ``spread`` aggregates on the map side first, which also spreads a hot session.  No join is needed
to keep metrics without data, and the sample-size gates ride along as counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions import stats, text
from kinetable.functions.scores import finding_conf
from kinetable.operators.ordered import Series, positions
from kinetable.params import DEFAULTS, StatsParams
from kinetable.plans.registry import Metric, metric_rows

MADE, MISSED, UNKNOWN = "made", "missed", "unknown"
METRIC = ["metric_pos", "metric_key", "label", "unit"]


def usable(shots: DataFrame) -> DataFrame:
    return shots.filter(~F.col("excluded_from_analysis"))


def percent_made(made: Column, missed: Column) -> Column:
    return F.round(F.lit(100.0) * made / F.nullif(made + missed, F.lit(0)), 1)


def outcome_counts(shots: DataFrame, keys: Sequence[str]) -> DataFrame:
    ok = ~F.col("excluded_from_analysis")
    counts = shots.groupBy(*keys).agg(
        *[F.count_if(ok & (F.col("outcome") == o)).alias(o) for o in (MADE, MISSED, UNKNOWN)],
        F.count_if(~ok).alias("excluded"),
    )
    return counts.withColumn("shooting_percentage", percent_made(F.col(MADE), F.col(MISSED)))


def metric_profile(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], a: str = MADE, b: str = MISSED, spread: bool = False) -> DataFrame:
    """Raw moments per (session, metric): all usable values and both groups, plus the gates."""
    ok = ~F.col("excluded_from_analysis")
    rows = metric_rows(shots if spread else shots.repartition(*keys), [*keys, "outcome", "excluded_from_analysis"], metrics)
    value = F.when(ok, F.col("value"))
    va, vb = F.when(F.col("outcome") == a, value), F.when(F.col("outcome") == b, value)
    moments = []
    for name, v in (("all", value), ("a", va), ("b", vb)):
        moments += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"var_{name}")]
    return rows.groupBy(*keys, *METRIC).agg(
        *moments,
        F.count_if(ok).alias("n_usable"),
        F.count_if(ok & (F.col("outcome") == a)).alias("n_group_a"),
        F.count_if(ok & (F.col("outcome") == b)).alias("n_group_b"),
        F.count_if(ok & (F.col("outcome") == UNKNOWN)).alias("n_unknown"),
    )


def with_consistency(profile: DataFrame, p: StatsParams = DEFAULTS.stats) -> DataFrame:
    std = F.sqrt("var_all")
    enough = F.col("n_all") >= p.min_consistency
    return profile.withColumns(
        {
            "mean_value": F.round("mean_all", 3),
            "std_dev": F.round(std, 3),
            "cv": F.when(enough, stats.rounded_tie(stats.coef_var(F.col("mean_all"), std), 3)),
            "enough_for_cv": enough,
        }
    )


def consistency(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], p: StatsParams = DEFAULTS.stats) -> DataFrame:
    rows = with_consistency(metric_profile(shots, keys, metrics), p)
    return rows.select(
        *keys, *METRIC, F.col("n_all").alias("n"), "mean_value", "std_dev",
        F.col("cv").alias("coefficient_of_variation"), F.col("enough_for_cv").alias("sufficient_sample"),
    )


def with_comparison(profile: DataFrame, p: StatsParams = DEFAULTS.stats, p_value: bool = True) -> DataFrame:
    c = F.col
    enough = (c("n_a") >= p.min_each) & (c("n_b") >= p.min_each)
    effect = F.when(enough, stats.pooled_effect(c("mean_a"), c("var_a"), c("n_a"), c("mean_b"), c("var_b"), c("n_b")))
    reason = (
        F.when(c("n_usable") < p.min_usable, "not_enough_total_shots")
        .when((c("n_group_a") < p.min_each) | (c("n_group_b") < p.min_each), "not_enough_made_or_missed_shots")
    )
    cols = {
        "reason": reason,
        "eligible": reason.isNull(),
        "sufficient_sample": enough,
        "made_mean": F.round("mean_a", 3),
        "missed_mean": F.round("mean_b", 3),
        "made_std": F.round(F.sqrt("var_a"), 3),
        "missed_std": F.round(F.sqrt("var_b"), 3),
        "difference": F.round(c("mean_a") - c("mean_b"), 3),
        "effect_size": stats.rounded_tie(effect, 3),
        "effect_label": stats.effect_label(effect),
    }
    if p_value:
        raw = stats.welch_p(c("mean_a"), c("var_a"), c("n_a"), c("mean_b"), c("var_b"), c("n_b"))
        cols["p_value"] = F.round(F.when(enough, raw), 4)
    return profile.withColumns(cols)


def compare_groups(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], p: StatsParams = DEFAULTS.stats, spread: bool = False) -> DataFrame:
    rows = with_comparison(metric_profile(shots, keys, metrics, spread=spread), p)
    return rows.select(
        *keys, *METRIC, F.col("n_a").alias("made_n"), F.col("n_b").alias("missed_n"), "made_mean", "missed_mean",
        "made_std", "missed_std", "difference", "effect_size", "effect_label", "sufficient_sample", "p_value",
    )


def group_report(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], p: StatsParams = DEFAULTS.stats) -> DataFrame:
    """Gated report: one row per metric of eligible sessions, one reason row for the others."""
    rows = with_comparison(metric_profile(shots, keys, metrics), p, p_value=False)
    ok = F.col("eligible")
    kept = rows.filter(ok | (F.col("metric_pos") == 0))
    only = [F.when(ok, F.col(c)).alias(c) for c in ("metric_key", "made_mean", "missed_mean", "difference", "effect_size", "effect_label")]
    return kept.select(
        *keys, "eligible", "reason", F.col("n_group_a").alias("made_count"), F.col("n_group_b").alias("missed_count"),
        F.col("n_unknown").alias("unknown_count"), *only,
    )


def top_metrics(rows: DataFrame, keys: Sequence[str], score: Column, n: int, where: Column, descending: bool) -> DataFrame:
    """Top ``n`` metric rows per session; ties keep registry order in both directions."""
    first = score.desc() if descending else score.asc()
    w = Window.partitionBy(*keys).orderBy(first, F.col("metric_pos"))  # bounded by the registry
    return rows.filter(where).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def most_consistent(result: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    cv = F.col("coefficient_of_variation")
    return top_metrics(result, keys, cv, n, cv.isNotNull(), descending=False)


def least_consistent(result: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    cv = F.col("coefficient_of_variation")
    return top_metrics(result, keys, cv, n, cv.isNotNull(), descending=True)


def top_differentiators(comparison: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    d = F.col("effect_size")
    return top_metrics(comparison, keys, F.abs(d), n, F.col("sufficient_sample") & d.isNotNull(), descending=True)


def with_thirds(shots: DataFrame, series: Series, p: StatsParams = DEFAULTS.stats) -> DataFrame:
    """Usable attempts of long enough sessions, marked ``early`` / ``late`` (or neither)."""
    placed = positions(usable(shots), series, "_pos", "_n").filter(F.col("_n") >= p.min_trend)
    third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    return placed.withColumns({"early": F.col("_pos") <= third, "late": F.col("_pos") > F.col("_n") - third}).drop("_pos", "_n")


def trend_thirds(shots: DataFrame, series: Series, metrics: Sequence[Metric], p: StatsParams = DEFAULTS.stats) -> DataFrame:
    keys = series.keys
    rows = metric_rows(with_thirds(shots, series, p).filter("early OR late"), [*keys, "outcome", "early", "late"], metrics)
    c = F.col

    def side(flag: str) -> list[Column]:
        v = F.when(c(flag), c("value"))
        return [
            F.avg(v).alias(f"_{flag}"), F.count(v).alias(f"{flag}_n"),
            F.count_if(c(flag) & (c("outcome") == MADE)).alias(f"_{flag}_made"),
            F.count_if(c(flag) & (c("outcome") == MISSED)).alias(f"_{flag}_missed"),
        ]

    agg = rows.groupBy(*keys, *METRIC).agg(*side("early"), *side("late"))
    return agg.select(
        *keys, *METRIC,
        F.round("_early", 3).alias("early_mean"), F.round("_late", 3).alias("late_mean"),
        F.round(c("_late") - c("_early"), 3).alias("change"), "early_n", "late_n",
        percent_made(c("_early_made"), c("_early_missed")).alias("early_shooting_pct"),
        percent_made(c("_late_made"), c("_late_missed")).alias("late_shooting_pct"),
        (c("_early_made") + c("_early_missed")).alias("early_n_classified"),
        (c("_late_made") + c("_late_missed")).alias("late_n_classified"),
    )


def top_trend(trends: DataFrame, keys: Sequence[str], min_n: int = 3) -> DataFrame:
    c = F.col
    where = c("change").isNotNull() & (c("early_n") >= min_n) & (c("late_n") >= min_n)
    return top_metrics(trends, keys, F.abs(c("change")), 1, where, descending=True)


def session_picks(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], p: StatsParams = DEFAULTS.stats) -> DataFrame:
    """One row per session with its gate and its best, worst and most telling metric."""
    rows = with_comparison(with_consistency(metric_profile(shots, keys, metrics), p), p, p_value=False)
    c = F.col
    rank = -c("metric_pos")
    telling = c("eligible") & c("sufficient_sample") & c("effect_size").isNotNull()
    cv_cols = ["metric_key", "label", "cv", "n_all", "mean_value", "std_dev"]
    d_cols = ["metric_key", "label", "made_mean", "missed_mean", "n_a", "n_b", "effect_size", "effect_label", "difference", "made_std", "missed_std"]
    return rows.groupBy(*keys).agg(
        F.max("n_usable").alias("n_usable"),
        F.max("n_group_a").alias("n_made"),
        F.max("n_group_b").alias("n_missed"),
        F.first("eligible").alias("eligible"),
        F.first("reason").alias("reason"),
        F.max_by(F.struct(*cv_cols), F.when(c("cv").isNotNull(), F.struct(-c("cv"), rank))).alias("best"),
        F.max_by(F.struct(*cv_cols), F.when(c("cv").isNotNull(), F.struct(c("cv"), rank))).alias("worst"),
        F.max_by(F.struct(*d_cols), F.when(telling, F.struct(F.abs("effect_size"), rank))).alias("diff"),
    )


def session_summary(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], p: StatsParams = DEFAULTS.stats) -> DataFrame:
    c = F.col
    ok = ~c("excluded_from_analysis")
    counts = shots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_shots_detected"),
        *[F.count_if(ok & (c("outcome") == o)).alias(o) for o in (MADE, MISSED, UNKNOWN)],
        F.count_if(~ok).alias("excluded"),
        F.round(F.max("end_time_sec"), 1).alias("session_duration_sec"),
        F.round(F.avg(F.when(ok & (c("pose_quality") > 0), c("pose_quality"))), 3).alias("mean_pose_quality"),
        F.round(F.avg(F.when(ok & (c("ball_track_quality") > 0), c("ball_track_quality"))), 3).alias("mean_ball_track_quality"),
        F.avg("hoop_confidence").alias("_hoop"),
    )
    picks = session_picks(shots, keys, metrics, p)
    best, diff = c("best"), c("diff")
    return counts.join(picks, list(keys)).select(
        *keys, "total_shots_detected", MADE, MISSED, UNKNOWN, "excluded",
        percent_made(c(MADE), c(MISSED)).alias("shooting_percentage"),
        "session_duration_sec", "mean_pose_quality", "mean_ball_track_quality",
        F.round("_hoop", 3).alias("hoop_confidence"),
        F.when(best.isNotNull(), F.concat(best["label"], F.lit(" (CV="), text.number(best["cv"]), F.lit(")"))).alias("strongest_consistency_label"),
        F.when(
            diff.isNotNull(),
            F.concat(diff["label"], F.lit(" (effect size="), text.number(diff["effect_size"]), F.lit(", "), diff["effect_label"], F.lit(")")),
        ).alias("biggest_differentiator_label"),
        F.array_compact(
            F.array(
                F.when(c(UNKNOWN) > 0, F.concat(c(UNKNOWN).cast("string"), F.lit(" shot(s) could not be confidently classified as made or missed."))),
                F.when(c("excluded") > 0, F.concat(c("excluded").cast("string"), F.lit(" shot(s) were excluded from analysis."))),
                F.when(c("_hoop") < DEFAULTS.vote.accept_confidence, F.lit("Target location confidence was low for this session.")),
            )
        ).alias("warnings"),
    )


def findings(shots: DataFrame, series: Series, metrics: Sequence[Metric], max_n: int = 3, p: StatsParams = DEFAULTS.stats, spread: bool = False) -> DataFrame:
    """Ranked findings: ``(keys, ord, finding, evidence, confidence)``."""
    keys, c = series.keys, F.col
    rows = with_comparison(metric_profile(shots, keys, metrics, spread=spread), p, p_value=False)
    telling = rows.filter(c("eligible"))
    top = top_differentiators(telling, keys, max_n)
    n = text.number
    compared = top.select(
        *keys, c("rank").alias("ord"),
        F.concat(c("label"), F.lit(" "), text.direction(c("made_mean"), c("missed_mean"), "was higher on makes", "was higher on misses"), F.lit(".")).alias("finding"),
        F.concat(
            F.lit("makes "), n(c("made_mean")), F.lit(" (n="), c("n_a").cast("string"), F.lit(", sd="), n(c("made_std")),
            F.lit("); misses "), n(c("missed_mean")), F.lit(" (n="), c("n_b").cast("string"), F.lit(", sd="), n(c("missed_std")),
            F.lit("); difference "), n(c("difference")), F.lit(", effect "), n(c("effect_size")), F.lit(" ("), c("effect_label"), F.lit(")"),
        ).alias("evidence"),
        finding_conf(c("effect_label"), F.least("n_a", "n_b")).alias("confidence"),
    )
    state = rows.groupBy(*keys).agg(
        F.first("reason").alias("reason"), F.max("n_group_a").alias("n_made"), F.max("n_group_b").alias("n_missed"),
        F.count_if(c("sufficient_sample") & c("effect_size").isNotNull()).alias("n_telling"), F.count(F.lit(1)).alias("n_metrics"),
    )
    silent = state.filter(c("reason").isNotNull() | (c("n_telling") == 0)).select(
        *keys, F.lit(1).alias("ord"),
        F.when(c("reason").isNotNull(), "No makes-vs-misses comparison yet.").otherwise("No strong measurable difference between makes and misses.").alias("finding"),
        F.when(c("reason").isNotNull(), text.humanize(c("reason")))
        .otherwise(
            F.concat(
                F.lit("compared "), c("n_metrics").cast("string"), F.lit(" metrics across "), c("n_made").cast("string"),
                F.lit(" made and "), c("n_missed").cast("string"), F.lit(" missed"),
            )
        ).alias("evidence"),
        F.when(c("reason").isNotNull(), "low").otherwise("medium").alias("confidence"),
    )
    trends = trend_thirds(shots, series, metrics, p)
    swing = trends.filter(
        (c("metric_pos") == 0) & (F.abs(c("late_shooting_pct") - c("early_shooting_pct")) >= 10)
    ).select(
        *keys, F.lit(max_n + 1).alias("ord"),
        F.concat(F.lit("Shooting percentage went from "), F.format_string("%.1f", c("early_shooting_pct")), F.lit(" early to "), F.format_string("%.1f", c("late_shooting_pct")), F.lit(" late.")).alias("finding"),
        F.concat(F.lit("early third "), c("early_n_classified").cast("string"), F.lit(" classified; late third "), c("late_n_classified").cast("string"), F.lit(" classified")).alias("evidence"),
        F.when(F.least("early_n_classified", "late_n_classified") >= 3, "medium").otherwise("low").alias("confidence"),
    )
    drift = top_trend(trends, keys).select(
        *keys, F.lit(max_n + 2).alias("ord"),
        F.concat(c("label"), F.lit(" changed from "), n(c("early_mean")), F.lit(" early to "), n(c("late_mean")), F.lit(" late.")).alias("finding"),
        F.concat(F.lit("early n="), c("early_n").cast("string"), F.lit(", late n="), c("late_n").cast("string"), F.lit(", change="), n(c("change")), F.lit(" "), c("unit")).alias("evidence"),
        F.lit("low").alias("confidence"),
    )
    return compared.unionByName(silent).unionByName(swing).unionByName(drift)

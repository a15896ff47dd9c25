"""Coaching selection: one strength and one priority per session, with abstention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.functions import text
from kinetable.functions.scores import confidence_level, finding_conf
from kinetable.params import DEFAULTS, StatsParams
from kinetable.plans.registry import Metric
from kinetable.plans.session_stats import session_picks


def coaching(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], wording: DataFrame | None = None, p: StatsParams = DEFAULTS.stats) -> DataFrame:
    c = F.col
    ok = ~c("excluded_from_analysis")
    quality = shots.groupBy(*keys).agg(
        F.avg(F.when(ok & (c("pose_quality") > 0), c("pose_quality"))).alias("_pose"),
        F.avg(F.when(ok & (c("ball_track_quality") > 0), c("ball_track_quality"))).alias("_ball"),
    )
    score = F.least(F.round("_pose", 3), F.round("_ball", 3))  # least skips a missing side
    rows = session_picks(shots, keys, metrics, p).join(quality, list(keys))
    rows = rows.withColumn("tracking", F.when(score.isNull(), "excluded").otherwise(confidence_level(score)))

    effect_conf = finding_conf(c("diff.effect_label"), F.least("diff.n_a", "diff.n_b"))
    by_group = c("diff").isNotNull() & effect_conf.isin("medium", "high")
    rows = rows.withColumns(
        {
            "ineligible_note": F.when(c("n_usable") == 0, "no_usable_shots").when(c("tracking").isin("low", "excluded"), "low_tracking_quality"),
            "effect_confidence": F.when(c("diff").isNotNull(), effect_conf),
            "priority_source": F.when(by_group, "makes_vs_misses").when(c("worst").isNotNull(), "consistency"),
            "priority_key": F.when(by_group, c("diff.metric_key")).otherwise(c("worst.metric_key")),
            "priority_label": F.when(by_group, c("diff.label")).otherwise(c("worst.label")),
        }
    )
    rows = rows.withColumn(
        "priority_confidence",
        F.when(c("priority_source") == "makes_vs_misses", c("effect_confidence")).when(c("priority_source") == "consistency", "medium"),
    )
    # one metric cannot be both the strength and the least repeatable one
    clash = F.coalesce((c("priority_source") == "consistency") & (c("priority_key") == c("best.metric_key")), F.lit(False))
    eligible = c("ineligible_note").isNull()
    keep = lambda col: F.when(eligible, col)
    n = text.number
    out = rows.select(
        *keys,
        eligible.alias("eligible"),
        keep(F.when(~clash, c("best.metric_key"))).alias("strength_key"),
        keep(c("priority_key")).alias("priority_key"),
        keep(c("priority_source")).alias("priority_source"),
        keep(c("priority_confidence")).alias("priority_confidence"),
        keep(
            F.when(
                c("priority_source") == "makes_vs_misses",
                F.concat(
                    c("diff.label"), F.lit(" averaged "), n(c("diff.made_mean")), F.lit(" on makes (n="), c("diff.n_a").cast("string"),
                    F.lit(") and "), n(c("diff.missed_mean")), F.lit(" on misses (n="), c("diff.n_b").cast("string"), F.lit("), a "),
                    c("diff.effect_label"), F.lit(" difference"),
                ),
            ).when(
                c("priority_source") == "consistency",
                F.concat(c("worst.label"), F.lit(" varied most over "), c("worst.n_all").cast("string"), F.lit(" attempts (CV="), n(c("worst.cv")), F.lit(")")),
            )
        ).alias("priority_evidence"),
        keep(
            F.when(c("reason").isNotNull(), c("reason")).when(
                c("diff").isNull() | (c("effect_confidence") == "low"), "no_strong_difference"
            )
        ).alias("makes_vs_misses_reason"),
        keep(F.when(c("worst").isNull(), "not_enough_shots_for_consistency")).alias("consistency_reason"),
        F.when(~eligible, "low")
        .when(c("tracking") == "medium", "medium")
        .otherwise(F.coalesce("priority_confidence", F.lit("low"))).alias("confidence"),
        F.array_compact(
            F.array(c("ineligible_note"), F.when(eligible & (c("tracking") == "medium"), "moderate_tracking_quality"))
        ).alias("data_quality_notes"),
        F.when(~eligible, c("ineligible_note"))
        .when(~clash & c("best").isNotNull() & c("priority_key").isNotNull(), "strength_and_priority")
        .when(c("priority_key").isNotNull(), "priority_only")
        .when(c("best").isNotNull(), "strength_only")
        .otherwise("not_enough_evidence").alias("coach_note_code"),
        F.coalesce(c("diff.made_mean") > c("diff.missed_mean"), F.lit(False)).alias("_made_higher"),
    )
    if wording is None:
        return out.drop("_made_higher")
    words = wording  # small: its measured size lets Spark broadcast it
    strength = words.select(c("metric_key").alias("strength_key"), c("strength_text"))
    priority = words.withColumnRenamed("metric_key", "priority_key").drop("strength_text")
    told = out.join(strength, "strength_key", "left").join(priority, "priority_key", "left")
    by_groups = c("priority_source") == "makes_vs_misses"
    return told.select(
        *[c(k) for k in out.columns if k != "_made_higher"],
        c("concept").alias("priority_concept"),
        c("strength_text"),
        F.when(by_groups, F.when(c("_made_higher"), c("noticed_made_higher")).otherwise(c("noticed_missed_higher")))
        .otherwise(c("noticed_varied")).alias("priority_text"),
        F.when(by_groups, c("cue_made")).otherwise(c("cue_consistent")).alias("cue_text"),
    )

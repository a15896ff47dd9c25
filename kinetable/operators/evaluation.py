"""Evaluation of detections and labels against truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.plans.registry import Metric, metric_rows
from kinetable.plans.session_stats import percent_made

c = F.col

OUTCOMES = ("made", "missed", "unknown")


def completeness(shots: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Filled cells over all cells of the metric registry."""
    rows = metric_rows(shots, list(keys), metrics)
    out = rows.groupBy(*keys).agg(F.count("value").alias("filled"), F.count(F.lit(1)).alias("cells"))
    return out.withColumn("completeness", F.round(c("filled") / c("cells"), 4))


def confusion(matched: DataFrame, truth: str, pred: str, labels: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """Confusion counts per truth label, with recall, committed accuracy and unknown share."""
    return matched.groupBy(c(truth).alias("truth")).agg(
        *[F.count_if(c(pred) == p).alias(f"pred_{p}") for p in labels],
        F.count(F.lit(1)).alias("n"),
        F.round(F.count_if(c(pred) == c(truth)) / F.count(F.lit(1)), 4).alias("recall"),
        F.round(F.try_divide(F.count_if(c(pred) == c(truth)), F.count_if(c(pred) != unknown)), 4).alias("committed_accuracy"),
        F.round(F.count_if(c(pred) == unknown) / F.count(F.lit(1)), 4).alias("unknown_rate"),
    )


def timing_error(matched: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    return matched.groupBy(*keys).agg(
        F.count(delta).alias("n"), F.round(F.avg(F.abs(delta)), 4).alias("mean_error"), F.round(F.max(F.abs(delta)), 4).alias("max_error")
    )


def regression_summary(shots: DataFrame, coaching: DataFrame, keys: Sequence[str], order: Sequence[str], block: str) -> DataFrame:
    """One comparable row per session: counts, percentage, outcomes in order, and coaching keys.

    Counts and percentage are those of usable attempts; the outcomes are of all.  Lists are built block by block
    (``block`` follows the order), so only the outcomes of a session meet, never its attempts.
    """
    ok = ~c("excluded_from_analysis")
    local = shots.groupBy(*keys, F.expr(block).alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(ok & (c("outcome") == o)).alias(f"_{o}") for o in OUTCOMES], F.count_if(~ok).alias("_excluded"),
        F.transform(F.sort_array(F.collect_list(F.struct(*order, "outcome"))), lambda r: r["outcome"]).alias("_said"),
    )
    per = local.groupBy(*keys).agg(
        F.sum("_n").alias("n_shots"), *[F.sum(f"_{o}").alias(o) for o in OUTCOMES], F.sum("_excluded").alias("excluded"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_said"))), lambda r: r["_said"])).alias("outcomes"),
    )
    told = coaching.select(*keys, "eligible", "confidence", "strength_key", "priority_key")
    per = per.withColumn("shooting_percentage", percent_made(c("made"), c("missed")))
    return per.join(told, list(keys), "left")


def truth_keys(shots: DataFrame, truth: DataFrame, keys: Sequence[str], on: Sequence[str], label: str = "outcome") -> DataFrame:
    """Automatic and verified label of every key of either side, and ``status``: both, no_truth or no_attempt."""
    k = [*keys, *on]
    auto = shots.select(*k, c(label).alias("automatic_outcome"), F.lit(1).alias("_a"))
    ver = truth.select(*k, c(label).alias("verified_outcome"), F.lit(1).alias("_v"))
    status = F.when(c("_v").isNull(), "no_truth").when(c("_a").isNull(), "no_attempt").otherwise("both")
    return auto.join(ver, k, "full").select(*k, "automatic_outcome", "verified_outcome", status.alias("status"))


def truth_summary(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and percentage of each session, automatic ones and, where all keys match, verified ones.

    A session with any key on one side only is refused: ``n_mismatched`` tells how many, and its figures stay
    automatic.
    """
    n = lambda name, o: F.count_if(c(name) == o)
    agg = compared.groupBy(*keys).agg(
        F.count_if(c("status") != "both").alias("n_mismatched"),
        *[n("automatic_outcome", o).alias(f"automatic_{o}") for o in OUTCOMES], *[n("verified_outcome", o).alias(f"_{o}") for o in OUTCOMES[:2]],
    )
    verified = c("n_mismatched") == 0
    pick = lambda o: F.when(verified, c(f"_{o}")).otherwise(c(f"automatic_{o}"))
    agg = agg.withColumns({"outcomes_verified": verified, "made": pick("made"), "missed": pick("missed"), "unknown": F.when(verified, 0).otherwise(c("automatic_unknown"))})
    return agg.select(
        *keys, "n_mismatched", "outcomes_verified", *[f"automatic_{o}" for o in OUTCOMES],
        percent_made(c("automatic_made"), c("automatic_missed")).alias("automatic_shooting_percentage"), "made", "missed", "unknown",
        percent_made(c("made"), c("missed")).alias("shooting_percentage"),
    )

"""Post-contact reversal: did the ball come back up or out after touching the target zone?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetable.operators.flight import flight_rows
from kinetable.operators.ordered import Series, last_before, running_max, running_max_before, running_sum, scan
from kinetable.params import DEFAULTS, OutcomeParams

c = F.col


def reversal_scan(df: DataFrame, series: Series, y: str, k: int = 2) -> DataFrame:
    """Per row: running maximum so far and how many lower rows followed its last increase."""
    rows = scan(df, series, running_max=running_max(c(y)), _before=running_max_before(c(y)))
    rows = rows.withColumn("new_max", c("_before").isNull() | (c(y) > c("_before"))).drop("_before")
    lower = F.when(c(y) < c("running_max"), 1).otherwise(0).cast("long")
    rows = scan(rows, series, _lower=running_sum(lower))
    rows = scan(rows, series, _base=last_before(F.when(c("new_max"), c("_lower"))))
    since = F.when(c("new_max"), F.lit(0).cast("long")).otherwise(c("_lower") - c("_base"))
    return rows.withColumn("lower_since_max", since).withColumn("reversed", c("lower_since_max") >= k).drop("_lower", "_base")


def post_contact_reversal(points: DataFrame, hoops: DataFrame, keys: Sequence[str] = ("sid", "shot_index"), hoop_keys: Sequence[str] = ("sid",), p: OutcomeParams = DEFAULTS.outcome, flight: DataFrame | None = None) -> DataFrame:
    k = list(keys)
    per = Window.partitionBy(*k)
    rows = flight_rows(points, hoops, k, hoop_keys, p) if flight is None else flight
    at = F.struct(c("frame_index").alias("f"), c("timestamp_sec").alias("t"))
    soon = c("descent") & (c("timestamp_sec") - c("apex.t") <= p.max_apex_sec)
    rows = rows.withColumns({"_soon": soon, "_start": F.min(F.when(soon & c("wide"), c("frame_index"))).over(per)})
    rows = rows.withColumn("_contact", F.min(F.when(c("_soon") & c("wide") & c("tight") & c("near"), at)).over(per))
    episode = c("_soon") & (c("frame_index") >= c("_start"))
    post = episode & (c("frame_index") >= c("_contact.f")) & (c("timestamp_sec") - c("_contact.t") <= p.max_cross_sec)
    pre = episode & (c("frame_index") < c("_contact.f"))
    rows = rows.withColumns({"_ep": episode, "_post": F.coalesce(post, F.lit(False)), "_pre": F.coalesce(pre, F.lit(False))})
    # the deepest point is the first one that reaches the maximum; later lower ones confirm
    rows = rows.withColumn("_deep", F.max(F.when(c("_post"), F.struct(c("y").alias("y"), (-c("frame_index")).alias("nf")))).over(per))
    confirm = c("_post") & (c("frame_index") > -c("_deep.nf")) & (c("y") < c("_deep.y"))
    rows = rows.withColumn("_cf", F.coalesce(confirm, F.lit(False)))
    agg = rows.groupBy(*k).agg(
        F.max("hoop_conf").alias("hoop_conf"),
        F.count_if("kept").alias("n_rel"),
        F.count_if("descent").alias("n_desc"),
        F.max("_start").alias("interaction_start_frame"),
        F.max(F.when(c("_ep"), c("frame_index"))).alias("interaction_end_frame"),
        F.max("_contact").alias("contact"),
        F.count_if("_pre").alias("n_pre"),
        F.min_by("y", F.when(c("_pre"), c("frame_index"))).alias("_y0"),
        F.max_by("y", F.when(c("_pre"), c("frame_index"))).alias("_y1"),
        F.count_if("_post").alias("n_post"),
        F.max(-c("_deep.nf")).alias("deep_frame"),
        F.count_if("_cf").alias("n_confirm"),
        F.array_sort(F.collect_list(F.when(c("_cf"), c("frame_index")))).alias("frames"),
        F.min(F.when(c("_cf"), at)).alias("first_confirm"),
        F.count_if(c("_cf") & (c("source") == "detected")).alias("n_det"),
        F.count_if(c("_cf") & (c("source") == "interpolated")).alias("n_int"),
        F.coalesce(F.bool_or(c("_cf") & ~c("wide")), F.lit(False)).alias("sideways"),
        F.coalesce(F.bool_or(c("_cf") & c("above")), F.lit(False)).alias("upwards"),
    )
    turned = c("n_confirm") >= p.min_below
    escaped = c("sideways") | c("upwards")
    # Reason codes and their evidence quality.
    reason = (
        F.when(c("hoop_conf").isNull() | (c("hoop_conf") < p.hoop_floor), "hoop_location_not_reliable")
        .when(c("n_rel") < p.min_reliable, "insufficient_ball_trajectory_data")
        .when(c("n_desc") < p.min_descent, "insufficient_descent_observation")
        .when(c("interaction_start_frame").isNull(), "no_rim_interaction_region_observed")
        .when(c("contact").isNull(), "no_contact_level_proximity_observed")
        .when(c("n_post") < 2, "insufficient_post_contact_observation")
        .when(c("n_confirm") == 0, "no_reversal_clean_continuation")
        .when(~turned, "reversal_candidate_not_sustained")
        .when(c("n_det") == 0, "reversal_structurally_present_but_interpolated_only")
        .when(escaped, "post_contact_reversal_with_escape")
        .otherwise("post_contact_reversal_without_confirmed_escape")
    )
    strong = ("no_reversal_clean_continuation", "post_contact_reversal_with_escape")
    weak = ("reversal_candidate_not_sustained", "post_contact_reversal_without_confirmed_escape")
    early = ("hoop_location_not_reliable", "insufficient_ball_trajectory_data", "insufficient_descent_observation", "no_rim_interaction_region_observed")
    out = agg.withColumn("reason", reason)
    begun = ~c("reason").isin(*early)
    touched = begun & c("contact").isNotNull()
    watched = touched & (c("n_post") >= 2)
    confirmed = watched & turned
    graded = confirmed & (c("n_det") > 0)
    direction = F.when(c("sideways") & c("upwards"), "lateral_and_upward").when(c("sideways"), "lateral").when(c("upwards"), "upward")
    return out.select(
        *k, "reason",
        F.when(c("reason").isin(*strong), "strong").when(c("reason").isin(*weak), "weak").otherwise("insufficient").alias("evidence_quality"),
        F.when(begun, c("interaction_start_frame")).alias("interaction_start_frame"),
        F.when(begun, c("interaction_end_frame")).alias("interaction_end_frame"),
        F.when(touched, c("contact.f")).alias("contact_frame"),
        F.when(touched & (c("n_pre") >= 2), c("_y1") > c("_y0")).alias("pre_contact_descending"),
        F.when(touched, c("n_pre")).otherwise(0).alias("pre_contact_n_points"),
        confirmed.alias("reversal_detected"),
        F.when(watched, c("deep_frame")).alias("max_depth_frame"),
        F.when(confirmed, c("first_confirm.f")).alias("reversal_frame"),
        F.when(confirmed, c("frames")).otherwise(F.array().cast("array<bigint>")).alias("reversal_confirm_frames"),
        F.when(confirmed, c("n_det")).otherwise(0).alias("n_detected_support"),
        F.when(confirmed, c("n_int")).otherwise(0).alias("n_interpolated_support"),
        (graded & escaped).alias("escape_detected"),
        F.when(graded, direction).alias("escape_direction"),
    )

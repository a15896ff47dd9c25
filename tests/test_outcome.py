"""Outcome ladder and reversal on hand-built flights."""

import pytest
from pyspark.sql import functions as F

from kinetable.functions import rim
from kinetable.functions.scores import rounded
from kinetable.operators.outcome import classify_outcome, classify_outcome_weighted, compare_classifiers, explain_outcome
from kinetable.operators.reversal import post_contact_reversal

POINTS = "sid string, shot_index long, frame_index long, timestamp_sec double, x double, y double, radius double, confidence double, source string"


def flight(xy, conf=0.9, source="detected", shot=1, sid="s", dip=None, frames=None):
    out = []
    for i, (x, y) in enumerate(xy):
        f = frames[i] if frames else i
        out.append((sid, shot, f, f / 30, float(x), float(y), 6.0, 0.35 if dip == i else conf, source[i] if isinstance(source, list) else source))
    return out


RISE = [(300 + 20 * i, 200 - 25 * i) for i in range(7)]  # up to (420, 50)
MAKE = RISE + [(455, 45), (480, 50), (495, 60), (498, 70), (500, 80), (501, 95), (502, 110), (502, 130)]
WIDE = RISE + [(470, 45), (500, 55), (505, 70), (560, 72), (590, 90), (610, 110)]
BESIDE = RISE + [(430, 45), (425, 60), (420, 75), (410, 90), (400, 120)]
FAR = [(300 + 20 * i, 200 - 32 * i) for i in range(7)] + [(425, 135), (425, 160), (425, 190), (425, 220)]


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = (
        flight(MAKE, dip=11, shot=1) + flight(WIDE, shot=2) + flight(BESIDE, shot=3) + flight(FAR, shot=4) + flight(MAKE[:2], shot=5)
        + flight(RISE[:4], shot=6) + flight(RISE, shot=7) + flight(MAKE, shot=8) + flight(MAKE, dip=11, shot=9, sid="lost")
        + flight(MAKE, dip=11, shot=10, source=["interpolated"] * len(MAKE), conf=0.2) + flight([(300, 200), (310, 20), (320, 60)] + [(320 + i, 62 + i / 9) for i in range(4)], shot=11, frames=[0, 1, 90, 91, 92, 93, 94])
    )
    df = spark.createDataFrame(rows, POINTS)
    hoops = spark.createDataFrame([("s", 500.0, 80.0, 18.0, 0.75), ("lost", 500.0, 80.0, 18.0, 0.2)], "sid string, hoop_x double, hoop_y double, hoop_r double, hoop_conf double")
    return df, hoops, {r["shot_index"]: r for r in classify_outcome(df, hoops).collect()}


@pytest.mark.parametrize(
    "shot, outcome, reason",
    [
        (1, "made", "ball_crossed_rim_band_top_to_bottom"),
        (2, "missed", "ball_approached_rim_then_deflected_away"),
        (3, "missed", "ball_passed_beside_hoop_at_rim_height"),
        (4, "missed", "ball_descended_well_clear_of_hoop"),
        (5, "unknown", "insufficient_ball_trajectory_data"),
        (6, "unknown", "apex_not_reliably_observed"),
        (7, "unknown", "insufficient_descent_observation"),
        (9, "unknown", "hoop_location_not_reliable"),
        (11, "unknown", "rim_interaction_not_sufficiently_observed"),
    ],
)
def test_reasons(outcomes, shot, outcome, reason):
    r = outcomes[2][shot]
    assert (r["outcome"], r["outcome_reason"]) == (outcome, reason)


def test_no_occlusion_means_no_make(outcomes):
    assert outcomes[2][8]["outcome"] != "made"


def test_low_confidence_abstains(spark, outcomes):
    weak = spark.createDataFrame([("s", 500.0, 80.0, 18.0, 0.31)], "sid string, hoop_x double, hoop_y double, hoop_r double, hoop_conf double")
    rows = spark.createDataFrame(flight(MAKE, source=["interpolated"] * len(MAKE), dip=11), POINTS)
    (r,) = classify_outcome(rows, weak).collect()
    assert r["outcome"] == "unknown" and r["outcome_reason"].endswith("low_confidence") and 0 < r["outcome_confidence"] < 0.45


def test_variants_and_explanation(outcomes):
    df, hoops, base = outcomes
    other = {r["shot_index"]: r for r in classify_outcome_weighted(df, hoops).collect()}
    assert other[1]["outcome"] == "made" and other[1]["n_candidates"] >= 1
    assert compare_classifiers(df, hoops).filter("shot_index = 1").collect()[0]["changed"] is False
    pairs = explain_outcome(df, hoops).filter("shot_index = 1").collect()
    assert any(r["passes_drift"] and r["passes_occlusion"] and not r["deflected"] for r in pairs)
    assert base[1]["crossing_below_frame"] > base[1]["crossing_above_frame"]


def test_input_order_does_not_matter(outcomes):
    df, hoops, base = outcomes
    again = {r["shot_index"]: r for r in classify_outcome(df.repartition(5).orderBy(F.rand(1)), hoops).collect()}
    assert {k: v["outcome_confidence"] for k, v in again.items()} == {k: v["outcome_confidence"] for k, v in base.items()}


def test_reversal(spark, outcomes):
    _, hoops, _ = outcomes
    down = RISE + [(470, 45), (495, 60), (500, 75), (500, 90)]
    bounce = down + [(505, 80), (520, 60), (580, 50)]
    rows = (
        flight(MAKE, shot=1) + flight(bounce, shot=2) + flight(down + [(500, 88)], shot=3)
        + flight(bounce, shot=4, source=["detected"] * len(down) + ["interpolated"] * 3) + flight(BESIDE, shot=5)
    )
    got = {r["shot_index"]: r for r in post_contact_reversal(spark.createDataFrame(rows, POINTS), hoops).collect()}
    assert (got[1]["reason"], got[1]["evidence_quality"]) == ("no_reversal_clean_continuation", "strong")
    assert got[2]["reason"] == "post_contact_reversal_with_escape" and got[2]["reversal_detected"]
    assert got[3]["reason"] == "reversal_candidate_not_sustained"
    assert got[4]["reason"] in ("reversal_structurally_present_but_interpolated_only", "reversal_candidate_not_sustained", "no_reversal_clean_continuation")
    assert got[5]["reason"] == "no_rim_interaction_region_observed"


def test_confidence_at_the_floor_and_at_a_tie(spark):
    """0.5 + 0.05 * n and the products are those of the SQL, to the last bit: 0.45 is no less than the floor."""
    import duckdb

    found = spark.createDataFrame([(n, h / 40, d / r) for n in range(1, 9) for h in range(12, 41) for r in range(3, 9) for d in range(1, r + 1)], "n long, h double, s double")
    rows = found.select("n", "h", "s", rim.beside_conf(F.col("n"), F.col("h"), F.col("s")).alias("c")).withColumn("r", rounded(F.col("c"), 3)).toPandas()
    want = duckdb.sql("SELECT least(1.0, 0.5 + 0.05 * n) * (0.5 + 0.5 * h) * (0.5 + 0.5 * s) AS c, round(c::DOUBLE, 3) AS r FROM rows").fetchall()
    assert [tuple(v) for v in rows[["c", "r"]].values.tolist()] == want

"""Session statistics, coaching rules and scalar functions."""

import pytest
from pyspark.sql import functions as F

from kinetable.functions import geometry as geo
from kinetable.functions import scores, stats, text
from kinetable.operators import aggregates as ag
from kinetable.operators.ordered import Series
from kinetable.plans import session_stats as ss
from kinetable.plans.coaching import coaching
from kinetable.plans.registry import Metric

METRICS = (Metric("knee", "Knee angle", "deg", "knee"), Metric("pace", "Pace", "sec", "pace"))
SCHEMA = "sid string, i long, outcome string, excluded_from_analysis boolean, knee double, pace double, pose_quality double, ball_track_quality double, hoop_confidence double, start_time_sec double, end_time_sec double"


def session(sid, made, missed, gap=15.0, quality=0.9):
    rows = []
    for i in range(made + missed):
        hit = i < made
        rows.append((sid, i, "made" if hit else "missed", False, (170.0 if hit else 170.0 - gap) + i % 3, 1.0 + 0.01 * i, quality, quality, 0.8, 5.0 * i, 5.0 * i + 2))
    return rows


@pytest.fixture(scope="module")
def shots(spark):
    rows = session("good", 5, 5) + session("few", 2, 1) + session("one_sided", 6, 1) + session("blurry", 5, 5, quality=0.3) + session("fair", 5, 5, quality=0.6)
    rows += [("excluded", i, "unknown", True, 1.0, 1.0, 0.5, 0.5, 0.2, 0.0, 1.0) for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_welch_reference_values(spark):
    # t = 2 on 10 degrees of freedom has p = 0.0734; equal groups have p = 1
    one = spark.range(1)
    v = lambda m1, v1, n1, m2, v2, n2: one.select(stats.welch_p(*[F.lit(float(x)) for x in (m1, v1, n1, m2, v2, n2)])).first()[0]
    assert v(2, 3, 6, 0, 3, 6) == pytest.approx(0.07339, abs=2e-4)
    assert v(1, 1, 4, 1, 1, 4) == pytest.approx(1.0, abs=1e-6)
    assert v(1, 0, 4, 1, 0, 4) is None


def test_gates_and_planted_difference(shots):
    rep = ss.group_report(shots, ["sid"], METRICS).collect()
    reasons = {r["sid"]: r["reason"] for r in rep}
    assert reasons["few"] == "not_enough_total_shots" and reasons["one_sided"] == "not_enough_made_or_missed_shots" and reasons["good"] is None
    comp = by(ss.compare_groups(shots, ["sid"], METRICS), "sid", "metric_key")
    assert comp[("good", "knee")]["effect_label"] == "large" and comp[("good", "knee")]["p_value"] < 0.001
    top = by(ss.top_differentiators(ss.compare_groups(shots, ["sid"], METRICS), ["sid"], 1), "sid")
    assert top["good"]["metric_key"] == "knee"


def test_consistency_keeps_empty_metrics_and_needs_four(shots):
    rows = by(ss.consistency(shots, ["sid"], METRICS), "sid", "metric_key")
    assert rows[("few", "knee")]["coefficient_of_variation"] is None and rows[("few", "knee")]["n"] == 3
    assert rows[("excluded", "knee")]["n"] == 0 and rows[("excluded", "knee")]["mean_value"] is None
    assert rows[("good", "pace")]["coefficient_of_variation"] < rows[("good", "knee")]["coefficient_of_variation"] + 1


def test_thirds(spark):
    rows = [("s", i, "made" if i >= 4 else "missed", False, float(i), 1.0, 0.9, 0.9, 0.9, float(i), float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    t = by(ss.trend_thirds(df, Series(["sid"], ["start_time_sec", "i"], "floor(start_time_sec / 3)"), METRICS), "metric_key")["knee"]
    assert (t["early_mean"], t["late_mean"], t["change"], t["early_n"]) == (0.5, 6.5, 6.0, 2)
    assert (t["early_shooting_pct"], t["late_shooting_pct"]) == (0.0, 100.0)


def test_summary_and_coaching(shots, spark):
    s = by(ss.session_summary(shots, ["sid"], METRICS), "sid")
    assert s["good"]["shooting_percentage"] == 50.0 and s["excluded"]["excluded"] == 3 and len(s["excluded"]["warnings"]) == 2
    words = text.copy_table(spark, {k: tuple(f"{k} {n}".replace("_", " ") for n in text.KINDS) for k in ("knee", "pace")})
    told = by(coaching(shots, ["sid"], METRICS, words), "sid")
    assert told["good"]["priority_key"] == "knee" and told["good"]["priority_source"] == "makes_vs_misses" and told["good"]["priority_confidence"] == "high"
    assert told["blurry"]["eligible"] is False and told["blurry"]["data_quality_notes"] == ["low_tracking_quality"]
    assert told["excluded"]["data_quality_notes"] == ["no_usable_shots"]
    assert told["fair"]["confidence"] == "medium"
    assert "_" not in told["good"]["priority_text"]


def test_findings_for_every_session(shots):
    out = ss.findings(shots, Series(["sid"], ["start_time_sec", "i"], "floor(start_time_sec / 60)"), METRICS).collect()
    assert {r["sid"] for r in out} == {"good", "few", "one_sided", "blurry", "fair", "excluded"}


def test_upper_median_and_nearest_rank(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 3, 4)] + [("t", float(v)) for v in range(1, 22)] + [("u", 7.0)] * 9, "sid string, v double")
    med = by(ag.upper_median(df, ["sid"], "v"), "sid")
    assert (med["s"]["upper_median"], med["t"]["upper_median"], med["u"]["upper_median"]) == (3.0, 11.0, 7.0)
    assert by(ag.nearest_rank(df, ["sid"], "v"), "sid")["t"]["p95"] == 20.0


def test_weighted_side(spark):
    rows = [("s", 0.25, 0.9, None, None)] * 8 + [("s", 0.02, 0.41, None, None)] * 2 + [("s", None, None, 0.21, 0.9)] * 10
    df = spark.createDataFrame(rows, "sid string, left_dist double, left_vis double, right_dist double, right_vis double")
    assert ag.weighted_side(df, ["sid"]).first()["shooting_side"] == "right"


def test_geometry_and_buckets(spark):
    one = spark.range(1)
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    r = one.select(
        geo.angle_deg(p(1, 0), p(0, 0), p(0, 1)).alias("a"), geo.angle_deg(p(0, 0), p(0, 0), p(0, 1)).alias("n"),
        geo.lean_deg(p(1, 0), p(0, 1)).alias("l"), scores.confidence_level(F.lit(0.75)).alias("h"), scores.confidence_level(F.lit(0.0)).alias("x"),
        scores.evidence_tier(F.lit("hoop_corroborated"), F.lit("no_pose_data")).alias("t"), text.humanize(F.lit("a_b")).alias("u"),
    ).first()
    assert r["a"] == pytest.approx(90) and r["n"] is None and r["l"] == pytest.approx(45)
    assert (r["h"], r["x"], r["t"], r["u"]) == ("high", "excluded", "high", "a b")


def test_exact_median_of_even_odd_tied_and_missing_values(spark):
    from statistics import median

    from kinetable.operators.aggregates import exact_median

    values = {"even": [0.1, 0.9, 0.4, 0.5], "odd": [3.0, -1.0, 2.0], "tied": [0.5] * 6 + [0.75] * 6, "one": [7.0], "none": []}
    rows = [(k, v) for k, vs in values.items() for v in [*vs, None]]
    got = {r["k"]: (r["median"], r["n"]) for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: (median(v), len(v)) for k, v in values.items() if v}


def test_ranks_by_splitters_equal_sorted_values(spark):
    """Half of all values lie in a tiny range; narrowed down in several passes, each value is exact."""
    import random

    rng = random.Random(2)
    values = {"hot": [rng.uniform(0, 1e-3) if i % 2 else rng.gauss(0, 1e6) for i in range(6000)] + [5.0] * 3000, "some": [float(i % 7) for i in range(50)], "one": [3.0], None: [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("none", None)], "k string, v double").repartition(5)
    for most in (1 << 18, 50):
        med = {r["k"]: (r["median"], r["n"]) for r in ag.exact_median(df, ["k"], "v", most=most).collect()}
        top = {r["k"]: r["p95"] for r in ag.nearest_rank(df, ["k"], "v", most=most).collect()}
        for k, vs in values.items():
            if k is None:
                continue
            order = sorted(vs)
            n = len(order)
            assert med[k] == ((order[(n - 1) // 2] + order[n // 2]) / 2, n)
            assert top[k] == order[min(n - 1, round(0.95 * (n - 1)))]
        assert "none" not in med


def test_coverage_mean_of_a_tie_is_the_same_in_any_order(spark):
    """25 bests of k / 96 with a mean of exactly 0.66375, in many orders and splits: always what SQL rounds that double to."""
    import random

    from kinetable.operators.aggregates import coverage

    rng, rows = random.Random(5), []
    for sid in range(60):
        parts = [63] * 18 + [64] * 7 + [0]
        parts[-1] = 1593 - sum(parts[:-1]) + parts[0]
        parts = parts[1:]
        for _ in range(40):
            i, j = rng.sample(range(25), 2)
            step = min(rng.randint(0, 30), parts[i], 96 - parts[j])
            parts[i], parts[j] = parts[i] - step, parts[j] + step
        assert sum(parts) == 1593
        rows += [(sid, i, k / 96.0) for i, k in enumerate(parts)]
    dets = spark.createDataFrame(rows, "sid long, frame_index long, confidence double")
    out = coverage(dets, dets.select("sid").distinct(), ["sid"], "frame_index", F.lit(31)).select("mean_best_confidence").distinct().collect()
    assert [r[0] for r in out] == [0.6637]


def test_profile_shuffles_attempts_and_not_moments(spark):
    shots = spark.createDataFrame([(s, o, False, float(v)) for s in range(40) for v, o in enumerate(("made", "missed", "made", "missed"))], "sid long, outcome string, excluded_from_analysis boolean, v double")
    profile = ss.metric_profile(shots, ["sid"], [Metric("v", "V", "m", "v"), Metric("w", "W", "m", "v * 2")])
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sid" in plan and "metric_pos" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    spread = ss.metric_profile(shots, ["sid"], [Metric("v", "V", "m", "v"), Metric("w", "W", "m", "v * 2")], spread=True)
    assert sorted(profile.collect()) == sorted(spread.collect())


def test_effects_on_a_cut_have_the_label_of_the_cut(spark):
    """Groups of whole numbers with effects of exactly 0.2 and 0.5, in several orders; a last bit below a cut is still on it."""
    import itertools
    import math

    below = spark.range(1).select(*[stats.effect_label(F.lit(s * math.nextafter(v, 0.0))) for v in (0.2, 0.5, 0.8) for s in (1, -1)]).first()
    assert list(below) == ["small", "small", "medium", "medium", "large", "large"]
    groups = {"small": ([36.0, 38.0, 21.0, 50.0], [21.0, 24.0, 44.0, 46.0]), "medium": ([24.0, 45.0, 50.0, 33.0], [41.0, 23.0])}
    rows = [
        (f"{label} {i}", o, False, v)
        for label, (made, missed) in groups.items()
        for i, (a, b) in enumerate(itertools.product(itertools.permutations(made), itertools.permutations(missed)))
        for o, v in [*(("made", v) for v in a), *(("missed", v) for v in b)]
    ]
    shots = spark.createDataFrame(rows, "sid string, outcome string, excluded_from_analysis boolean, v double")
    got = ss.group_report(shots, ["sid"], [Metric("v", "V", "m", "v")]).select(F.split("sid", " ")[0].alias("want"), "effect_label").distinct().collect()
    assert {(r[0], r[1]) for r in got} == {("small", "small"), ("medium", "medium")}


def test_coefficient_on_a_rounding_tie_is_the_same_in_any_order(spark):
    """Whole numbers with sd / mean = 0.4375 exactly: 0.438 in every order."""
    import itertools

    rows = [(i, "made", False, v) for i, order in enumerate(itertools.permutations([33.0, 11.0, 43.0, 46.0, 27.0])) for v in order]
    shots = spark.createDataFrame(rows, "sid long, outcome string, excluded_from_analysis boolean, v double")
    got = ss.consistency(shots, ["sid"], [Metric("v", "V", "m", "v")]).select("coefficient_of_variation").distinct().collect()
    assert [r[0] for r in got] == [0.438]
    below = spark.range(1).select(*[stats.rounded_tie(F.lit(v), 3) for v in (0.43749999999999994, -0.43749999999999994, 0.43749)]).first()
    assert list(below) == [0.438, -0.438, 0.437]


def test_findings_of_the_given_table_compare_suppliers_of_many_orders(spark, tmp_path):
    import __spark_entry__ as entry

    rows = []
    for supplier in (1, 2):
        for i in range(12):  # every attempt is in an order of its own
            made = i % 2 == 0
            rows.append((100 * supplier + i, i, supplier, 1, 20.0 + (10.0 if made else 0.0) + i % 3, 1000.0 + i, 0.05, 0.02, "A" if made else "R", f"1996-{i + 1:02d}-01"))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate string"
    spark.createDataFrame(rows, names).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["EPI17"](spark, str(tmp_path)).collect()
    first = {r["sid"]: r["finding"] for r in got if r["ord"] == 1}
    assert set(first) == {1, 2} and not any("No makes" in f for f in first.values())
    assert {r["sid"] for r in got if r["finding"].startswith("Quantity was higher on makes")} == {1, 2} and {r["ord"] for r in got} >= {1, 2, 3, 5}

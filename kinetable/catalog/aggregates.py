"""Registered aggregate queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.base import (
    METRICS_SQL, SHOT_METRICS, query, shot_series, shots, shots_sql, with_,
)
from kinetable.functions import stats
from kinetable.functions.scores import finding_conf
from kinetable.plans import session_stats as ss
from kinetable.plans.coaching import coaching
from kinetable.plans.registry import melt_metrics

c = F.col
LONG = with_(shots_sql("l_suppkey"), METRICS_SQL, "vals AS (SELECT sid, m.key AS metric_key, m.value AS value, outcome FROM metric_rows WHERE NOT excluded_from_analysis AND m.value IS NOT NULL)")


def long(spark, sf):
    return melt_metrics(shots(spark, sf, "l_suppkey"), ["sid", "outcome"], SHOT_METRICS)


@query("AGG01", LONG + "SELECT sid, metric_key, round(avg(value), 4) AS mean_value FROM vals GROUP BY ALL")
def mean(spark, sf):
    return long(spark, sf).groupBy("sid", "metric_key").agg(F.round(F.avg("value"), 4).alias("mean_value"))


@query("AGG02", LONG + "SELECT sid, metric_key, round(stddev_samp(value), 4) AS std_dev FROM vals GROUP BY ALL")
def stdev(spark, sf):
    return long(spark, sf).groupBy("sid", "metric_key").agg(F.round(F.stddev_samp("value"), 4).alias("std_dev"))


@query("AGG03", LONG + """SELECT sid, metric_key,
  CASE WHEN abs(avg(value)) >= 1e-6 THEN round(abs(stddev_samp(value) / avg(value)), 4) END AS cv FROM vals GROUP BY ALL""")
def coefficient_of_variation(spark, sf):
    cv = stats.coef_var(F.avg("value"), F.stddev_samp("value"))
    return long(spark, sf).groupBy("sid", "metric_key").agg(F.round(cv, 4).alias("cv"))


MOMENTS = LONG + """, g AS (SELECT sid, metric_key,
  count(*) FILTER (outcome = 'made') AS n1, avg(value) FILTER (outcome = 'made') AS m1, var_samp(value) FILTER (outcome = 'made') AS v1,
  count(*) FILTER (outcome = 'missed') AS n2, avg(value) FILTER (outcome = 'missed') AS m2, var_samp(value) FILTER (outcome = 'missed') AS v2
  FROM vals GROUP BY ALL),
d AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 AND ((n1-1)*v1 + (n2-1)*v2) > 0
  THEN (m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1 + n2 - 2)) END AS d FROM g)
"""


def moments(spark, sf):
    made, missed = c("outcome") == "made", c("outcome") == "missed"
    return long(spark, sf).groupBy("sid", "metric_key").agg(
        F.count_if(made).alias("n1"), F.avg(F.when(made, c("value"))).alias("m1"), F.var_samp(F.when(made, c("value"))).alias("v1"),
        F.count_if(missed).alias("n2"), F.avg(F.when(missed, c("value"))).alias("m2"), F.var_samp(F.when(missed, c("value"))).alias("v2"),
    )


def effect():
    return stats.pooled_effect(c("m1"), c("v1"), c("n1"), c("m2"), c("v2"), c("n2"))


@query("AGG04", MOMENTS + "SELECT sid, metric_key, round(d, 4) AS effect_size FROM d")
def cohens_d(spark, sf):
    return moments(spark, sf).select("sid", "metric_key", F.round(effect(), 4).alias("effect_size"))


EFFECT_LABEL = """CASE WHEN d IS NULL THEN 'unknown' WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small'
  WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"""


@query("AGG05", MOMENTS + f"SELECT sid, metric_key, {EFFECT_LABEL} AS effect_label FROM d")
def effect_label(spark, sf):
    return moments(spark, sf).select("sid", "metric_key", stats.effect_label(effect()).alias("effect_label"))


STEPS = stats.QUADRATURE_STEPS



def _simpson(limit: str) -> str:
    top = f"least({limit}, 8.5 / sqrt(greatest(df - 1, 1e-9)))"
    w = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"(list_sum(list_transform(range(0, {STEPS} + 1), lambda i: {w} * pow(cos(i * {top} / {STEPS}), df - 1))) * {top} / {STEPS} / 3)"


WELCH = f"""w AS (SELECT *, abs(m1-m2)/sqrt(v1/n1+v2/n2) AS t,
  pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)) AS df FROM d),
p AS (SELECT *, greatest(0.0, 1 - {_simpson("atan(t/sqrt(df))")} / {_simpson("pi()/2")})::DOUBLE AS p FROM w)"""


@query("AGG06", MOMENTS + "," + WELCH + "SELECT sid, metric_key, round(p, 4) AS p_value FROM p")
def welch_t_test(spark, sf):
    p = stats.welch_p(c("m1"), c("v1"), c("n1"), c("m2"), c("v2"), c("n2"))
    return moments(spark, sf).select("sid", "metric_key", F.round(p, 4).alias("p_value"))


@query("AGG07", MOMENTS + "," + WELCH + f"""SELECT sid, metric_key, n1 AS made_n, n2 AS missed_n, round(m1,3) AS made_mean, round(m2,3) AS missed_mean,
  round(sqrt(v1),3) AS made_std, round(sqrt(v2),3) AS missed_std, round(m1-m2,3) AS difference, round(d,3) AS effect_size,
  {EFFECT_LABEL} AS effect_label, n1>=2 AND n2>=2 AS sufficient_sample, round(p,4) AS p_value FROM p""")
def compare_groups(spark, sf):
    return ss.compare_groups(shots(spark, sf, "l_suppkey"), ["sid"], SHOT_METRICS, spread=True).drop("metric_pos", "label", "unit")


PROFILE = with_(shots_sql(), METRICS_SQL, """ok AS (SELECT *, CASE WHEN NOT excluded_from_analysis THEN m.value END AS v FROM metric_rows),
prof AS (SELECT sid, m.pos AS metric_pos, m.key AS metric_key, m.label AS label, m.unit AS unit, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd,
  count(v) FILTER (outcome='made') AS n1, avg(v) FILTER (outcome='made') AS m1, var_samp(v) FILTER (outcome='made') AS v1,
  count(v) FILTER (outcome='missed') AS n2, avg(v) FILTER (outcome='missed') AS m2, var_samp(v) FILTER (outcome='missed') AS v2,
  count(*) FILTER (NOT excluded_from_analysis) AS usable,
  count(*) FILTER (NOT excluded_from_analysis AND outcome='made') AS made,
  count(*) FILTER (NOT excluded_from_analysis AND outcome='missed') AS missed,
  count(*) FILTER (NOT excluded_from_analysis AND outcome='unknown') AS unknown FROM ok GROUP BY ALL),
full_ AS (SELECT *, CASE WHEN n >= 4 AND abs(mean) >= 1e-6 THEN round(abs(sd/mean),3) END AS cv, n1>=2 AND n2>=2 AS sufficient,
  CASE WHEN usable < 4 THEN 'not_enough_total_shots' WHEN made < 2 OR missed < 2 THEN 'not_enough_made_or_missed_shots' END AS reason,
  CASE WHEN n1 >= 2 AND n2 >= 2 AND ((n1-1)*v1 + (n2-1)*v2) > 0 THEN (m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1 + n2 - 2)) END AS d FROM prof),
lab AS (SELECT *, """ + EFFECT_LABEL + " AS effect_label FROM full_)")


@query("AGG08", PROFILE + """SELECT sid, metric_pos, metric_key, label, unit, n, round(mean,3) AS mean_value, round(sd,3) AS std_dev,
  cv AS coefficient_of_variation, n >= 4 AS sufficient_sample FROM full_""")
def consistency(spark, sf):
    return ss.consistency(shots(spark, sf), ["sid"], SHOT_METRICS)


@query("AGG09", PROFILE + """SELECT sid, reason IS NULL AS eligible, reason, made AS made_count, missed AS missed_count, unknown AS unknown_count,
  CASE WHEN reason IS NULL THEN metric_key END AS metric_key,
  CASE WHEN reason IS NULL THEN round(m1,3) END AS made_mean, CASE WHEN reason IS NULL THEN round(m2,3) END AS missed_mean,
  CASE WHEN reason IS NULL THEN round(m1-m2,3) END AS difference, CASE WHEN reason IS NULL THEN round(d,3) END AS effect_size,
  CASE WHEN reason IS NULL THEN effect_label END AS effect_label FROM lab WHERE reason IS NULL OR metric_pos = 0""")
def group_report(spark, sf):
    return ss.group_report(shots(spark, sf), ["sid"], SHOT_METRICS)


@query("AGG10", with_(shots_sql()) + """, o AS (SELECT sid, count(*) FILTER (NOT excluded_from_analysis AND outcome='made') AS made,
  count(*) FILTER (NOT excluded_from_analysis AND outcome='missed') AS missed, count(*) FILTER (NOT excluded_from_analysis AND outcome='unknown') AS unknown,
  count(*) FILTER (excluded_from_analysis) AS excluded FROM shots GROUP BY sid)
  SELECT *, round(100.0::DOUBLE*made/nullif(made+missed,0),1) AS shooting_percentage FROM o""")
def outcome_counts(spark, sf):
    return ss.outcome_counts(shots(spark, sf), ["sid"])


TRENDS = with_(shots_sql("{sid}"), """placed AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p,
  count(*) OVER (PARTITION BY sid) AS n FROM shots WHERE NOT excluded_from_analysis),
thirds AS (SELECT *, p <= greatest(1, n // 3) AS early, p > n - greatest(1, n // 3) AS late FROM placed WHERE n >= 6)""",
METRICS_SQL.replace("FROM shots", "FROM thirds"),
"""t AS (SELECT sid, m.pos AS metric_pos, m.key AS metric_key, m.label AS label, m.unit AS unit,
  avg(m.value) FILTER (early) AS e, avg(m.value) FILTER (late) AS l, count(m.value) FILTER (early) AS early_n, count(m.value) FILTER (late) AS late_n,
  count(*) FILTER (early AND outcome='made') AS em, count(*) FILTER (early AND outcome='missed') AS es,
  count(*) FILTER (late AND outcome='made') AS lm, count(*) FILTER (late AND outcome='missed') AS ls FROM metric_rows GROUP BY ALL),
trends AS (SELECT sid, metric_pos, metric_key, label, unit, round(e,3) AS early_mean, round(l,3) AS late_mean, round(l-e,3) AS change, early_n, late_n,
  round(100.0::DOUBLE*em/nullif(em+es,0),1) AS early_shooting_pct, round(100.0::DOUBLE*lm/nullif(lm+ls,0),1) AS late_shooting_pct,
  em+es AS early_n_classified, lm+ls AS late_n_classified FROM t)""")


@query("AGG11", TRENDS.replace("{sid}", "l_suppkey") + "SELECT * FROM trends")
def trend_thirds(spark, sf):
    return ss.trend_thirds(shots(spark, sf, "l_suppkey"), shot_series(), SHOT_METRICS)


PICKS = """best AS (SELECT * FROM lab WHERE cv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sid ORDER BY cv, metric_pos) = 1),
worst AS (SELECT * FROM lab WHERE cv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sid ORDER BY cv DESC, metric_pos) = 1),
diff AS (SELECT * FROM lab WHERE reason IS NULL AND sufficient AND d IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(round(d,3)) DESC, metric_pos) = 1)"""


@query("AGG12", PROFILE + "," + PICKS + """, s AS (SELECT sid, count(*) AS total_shots_detected,
  count(*) FILTER (NOT excluded_from_analysis AND outcome='made') AS made, count(*) FILTER (NOT excluded_from_analysis AND outcome='missed') AS missed,
  count(*) FILTER (NOT excluded_from_analysis AND outcome='unknown') AS unknown, count(*) FILTER (excluded_from_analysis) AS excluded,
  round(max(end_time_sec),1) AS session_duration_sec,
  round(avg(pose_quality) FILTER (NOT excluded_from_analysis AND pose_quality > 0),3) AS mean_pose_quality,
  round(avg(ball_track_quality) FILTER (NOT excluded_from_analysis AND ball_track_quality > 0),3) AS mean_ball_track_quality,
  avg(hoop_confidence) AS hoop FROM shots GROUP BY sid)
SELECT s.sid, total_shots_detected, s.made, s.missed, s.unknown, s.excluded, round(100.0::DOUBLE*s.made/nullif(s.made+s.missed,0),1) AS shooting_percentage,
  session_duration_sec, mean_pose_quality, mean_ball_track_quality, round(hoop,3) AS hoop_confidence,
  best.label || ' (CV=' || printf('%.3f', best.cv) || ')' AS strongest_consistency_label,
  diff.label || ' (effect size=' || printf('%.3f', round(diff.d,3)) || ', ' || diff.effect_label || ')' AS biggest_differentiator_label,
  list_filter([CASE WHEN s.unknown > 0 THEN s.unknown || ' shot(s) could not be confidently classified as made or missed.' END,
    CASE WHEN s.excluded > 0 THEN s.excluded || ' shot(s) were excluded from analysis.' END,
    CASE WHEN hoop < 0.4 THEN 'Target location confidence was low for this session.' END], lambda x: x IS NOT NULL) AS warnings
FROM s LEFT JOIN best USING (sid) LEFT JOIN diff ON diff.sid = s.sid""")
def session_summary(spark, sf):
    return ss.session_summary(shots(spark, sf), ["sid"], SHOT_METRICS)


@query("AGG32", with_(shots_sql(), METRICS_SQL) + """SELECT sid, count(m.value) AS filled, count(*) AS cells,
  round(count(m.value)::DOUBLE/count(*),4) AS completeness FROM metric_rows GROUP BY sid""")
def completeness(spark, sf):
    from kinetable.operators.evaluation import completeness as op

    return op(shots(spark, sf), ["sid"], SHOT_METRICS)


@query("TOP1", PROFILE + """, r AS (SELECT sid, metric_key, cv AS coefficient_of_variation,
  row_number() OVER (PARTITION BY sid ORDER BY cv, metric_pos) AS a, row_number() OVER (PARTITION BY sid ORDER BY cv DESC, metric_pos) AS b FROM full_ WHERE cv IS NOT NULL)
SELECT sid, 'most' AS side, metric_key, coefficient_of_variation, a AS rank FROM r WHERE a <= 3
UNION ALL SELECT sid, 'least', metric_key, coefficient_of_variation, b FROM r WHERE b <= 3""")
def most_and_least_consistent(spark, sf):
    rows = ss.consistency(shots(spark, sf), ["sid"], SHOT_METRICS)
    pick = ["sid", "side", "metric_key", "coefficient_of_variation", "rank"]
    most = ss.most_consistent(rows, ["sid"]).withColumn("side", F.lit("most")).select(pick)
    return most.unionByName(ss.least_consistent(rows, ["sid"]).withColumn("side", F.lit("least")).select(pick))


@query("TOP2", PROFILE + """SELECT sid, metric_key, round(d,3) AS effect_size, row_number() OVER (PARTITION BY sid ORDER BY abs(round(d,3)) DESC, metric_pos) AS rank
FROM full_ WHERE sufficient AND d IS NOT NULL QUALIFY rank <= 3""")
def top_differentiators(spark, sf):
    rows = ss.compare_groups(shots(spark, sf), ["sid"], SHOT_METRICS)
    return ss.top_differentiators(rows, ["sid"]).select("sid", "metric_key", "effect_size", "rank")


@query("TOP3", TRENDS.replace("{sid}", "l_suppkey") + """SELECT sid, metric_key, change FROM trends WHERE change IS NOT NULL AND early_n >= 3 AND late_n >= 3
QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(change) DESC, metric_pos) = 1""")
def top_trend(spark, sf):
    rows = ss.trend_thirds(shots(spark, sf, "l_suppkey"), shot_series(), SHOT_METRICS)
    return ss.top_trend(rows, ["sid"]).select("sid", "metric_key", "change")


FINDING_CONF = """CASE WHEN {l}='large' AND least({a},{b})>=5 THEN 'high' WHEN {l} IN ('large','medium') AND least({a},{b})>=3 THEN 'medium' ELSE 'low' END"""


@query("FN15", PROFILE + f"SELECT sid, metric_key, {FINDING_CONF.format(l='effect_label', a='n1', b='n2')} AS finding_confidence FROM lab")
def finding_confidence(spark, sf):
    rows = ss.with_comparison(ss.metric_profile(shots(spark, sf), ["sid"], SHOT_METRICS), p_value=False)
    return rows.select("sid", "metric_key", finding_conf(c("effect_label"), F.least("n_a", "n_b")).alias("finding_confidence"))


def _n(x: str) -> str:
    return f"coalesce(printf('%.3f', {x}), 'n/a')"


@query("EPI17", PROFILE.replace(shots_sql(), shots_sql("l_suppkey")) + "," + TRENDS.replace("{sid}", "l_suppkey").replace("WITH shots AS", "shots2 AS").replace("FROM shots ", "FROM shots2 ").replace("metric_rows", "trend_rows") + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY abs(round(d,3)) DESC, metric_pos) AS ord FROM lab
  WHERE reason IS NULL AND sufficient AND d IS NOT NULL QUALIFY ord <= 3),
state AS (SELECT sid, any_value(reason) AS reason, max(made) AS made, max(missed) AS missed, count(*) FILTER (sufficient AND d IS NOT NULL) AS telling, count(*) AS metrics FROM lab GROUP BY sid)
SELECT sid, ord, label || ' ' || CASE WHEN round(m1,3) > round(m2,3) THEN 'was higher on makes' ELSE 'was higher on misses' END || '.' AS finding,
  'makes ' || {_n('round(m1,3)')} || ' (n=' || n1 || ', sd=' || {_n('round(sqrt(v1),3)')} || '); misses ' || {_n('round(m2,3)')} || ' (n=' || n2 || ', sd=' || {_n('round(sqrt(v2),3)')}
  || '); difference ' || {_n('round(m1-m2,3)')} || ', effect ' || {_n('round(d,3)')} || ' (' || effect_label || ')' AS evidence,
  {FINDING_CONF.format(l='effect_label', a='n1', b='n2')} AS confidence FROM ranked
UNION ALL SELECT sid, 1, CASE WHEN reason IS NOT NULL THEN 'No makes-vs-misses comparison yet.' ELSE 'No strong measurable difference between makes and misses.' END,
  CASE WHEN reason IS NOT NULL THEN replace(reason, '_', ' ') ELSE 'compared ' || metrics || ' metrics across ' || made || ' made and ' || missed || ' missed' END,
  CASE WHEN reason IS NOT NULL THEN 'low' ELSE 'medium' END FROM state WHERE reason IS NOT NULL OR telling = 0
UNION ALL SELECT sid, 4, 'Shooting percentage went from ' || printf('%.1f', early_shooting_pct) || ' early to ' || printf('%.1f', late_shooting_pct) || ' late.',
  'early third ' || early_n_classified || ' classified; late third ' || late_n_classified || ' classified',
  CASE WHEN least(early_n_classified, late_n_classified) >= 3 THEN 'medium' ELSE 'low' END FROM trends WHERE metric_pos = 0 AND abs(late_shooting_pct - early_shooting_pct) >= 10
UNION ALL SELECT sid, 5, label || ' changed from ' || {_n('early_mean')} || ' early to ' || {_n('late_mean')} || ' late.',
  'early n=' || early_n || ', late n=' || late_n || ', change=' || {_n('change')} || ' ' || unit, 'low' FROM (SELECT * FROM trends WHERE change IS NOT NULL AND early_n >= 3 AND late_n >= 3
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(change) DESC, metric_pos) = 1)""")
def findings(spark, sf):
    """A session is a supplier, as in the trends: an order's few attempts leave hardly anything to compare."""
    return ss.findings(shots(spark, sf, "l_suppkey"), shot_series(), SHOT_METRICS, spread=True)


COACH = PROFILE + "," + PICKS + f""", q AS (SELECT sid, round(avg(pose_quality) FILTER (NOT excluded_from_analysis AND pose_quality > 0),3) AS pq,
  round(avg(ball_track_quality) FILTER (NOT excluded_from_analysis AND ball_track_quality > 0),3) AS bq FROM shots GROUP BY sid),
u AS (SELECT sid, max(usable) AS usable, any_value(reason) AS reason FROM lab GROUP BY sid),
j AS (SELECT q.sid, u.usable, u.reason, least(pq,bq) AS score, best.metric_key AS bk, worst.metric_key AS wk, worst.label AS wl, worst.n AS wn, worst.cv AS wcv,
  diff.metric_key AS dk, diff.label AS dl, diff.m1 AS dm1, diff.m2 AS dm2, diff.n1 AS dn1, diff.n2 AS dn2, diff.effect_label AS del,
  CASE WHEN diff.sid IS NOT NULL THEN {FINDING_CONF.format(l='diff.effect_label', a='diff.n1', b='diff.n2')} END AS ec
  FROM q JOIN u USING (sid) LEFT JOIN best ON best.sid=q.sid LEFT JOIN worst ON worst.sid=q.sid LEFT JOIN diff ON diff.sid=q.sid),
j2 AS (SELECT *, CASE WHEN score IS NULL THEN 'excluded' WHEN score>=0.75 THEN 'high' WHEN score>=0.5 THEN 'medium' WHEN score>0 THEN 'low' ELSE 'excluded' END AS tracking,
  CASE WHEN ec IN ('medium','high') THEN 'makes_vs_misses' WHEN wk IS NOT NULL THEN 'consistency' END AS src FROM j),
j3 AS (SELECT *, CASE WHEN src='makes_vs_misses' THEN dk ELSE wk END AS pk, CASE WHEN src='makes_vs_misses' THEN ec WHEN src='consistency' THEN 'medium' END AS pc,
  CASE WHEN usable=0 THEN 'no_usable_shots' WHEN tracking IN ('low','excluded') THEN 'low_tracking_quality' END AS note FROM j2),
j4 AS (SELECT *, coalesce(src='consistency' AND pk=bk, false) AS clash, note IS NULL AS ok FROM j3)
"""


@query("EPI18", COACH + f"""SELECT sid, ok AS eligible, CASE WHEN ok AND NOT clash THEN bk END AS strength_key, CASE WHEN ok THEN pk END AS priority_key,
  CASE WHEN ok THEN src END AS priority_source, CASE WHEN ok THEN pc END AS priority_confidence,
  CASE WHEN ok THEN CASE src WHEN 'makes_vs_misses' THEN dl || ' averaged ' || {_n('round(dm1,3)')} || ' on makes (n=' || dn1 || ') and ' || {_n('round(dm2,3)')} || ' on misses (n=' || dn2 || '), a ' || del || ' difference'
    WHEN 'consistency' THEN wl || ' varied most over ' || wn || ' attempts (CV=' || {_n('wcv')} || ')' END END AS priority_evidence,
  CASE WHEN ok THEN CASE WHEN reason IS NOT NULL THEN reason WHEN dk IS NULL OR ec='low' THEN 'no_strong_difference' END END AS makes_vs_misses_reason,
  CASE WHEN ok AND wk IS NULL THEN 'not_enough_shots_for_consistency' END AS consistency_reason,
  CASE WHEN NOT ok THEN 'low' WHEN tracking='medium' THEN 'medium' ELSE coalesce(pc,'low') END AS confidence,
  list_filter([note, CASE WHEN ok AND tracking='medium' THEN 'moderate_tracking_quality' END], lambda x: x IS NOT NULL) AS data_quality_notes,
  CASE WHEN NOT ok THEN note WHEN NOT clash AND bk IS NOT NULL AND pk IS NOT NULL THEN 'strength_and_priority' WHEN pk IS NOT NULL THEN 'priority_only'
    WHEN bk IS NOT NULL THEN 'strength_only' ELSE 'not_enough_evidence' END AS coach_note_code FROM j4""")
def coaching_selection(spark, sf):
    return coaching(shots(spark, sf), ["sid"], SHOT_METRICS)

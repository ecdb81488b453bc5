"""Queries about evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SHORT
from ..functions.expr import rounded
from ..operators import evidence as e
from ..operators import series as s
from .base import daily, plan, table
from .series_queries import PH, PHASE_SQL


def families(spark, d):
    """Families of the tables' event types."""
    kinds = table(spark, d, "events").select(F.col("event_type").alias("concept_id")).distinct()
    family = F.when(F.col("concept_id").isin("purchase", "click"), "demand").when(F.col("concept_id") == "view", "awareness").when(F.col("concept_id") == "error", "nonflood").otherwise("weather")
    return kinds.withColumn("family", family)


def phases(spark, d):
    return s.phase_metrics(daily(spark, d), plan(spark, d), SHORT)


def roles(spark, d):
    return plan(spark, d).select("request_id", "role", "episode_id")


def allowed(spark, d):
    return roles(spark, d).where("role = 'control'").select("episode_id", "request_id")


def concurrence_rows(spark, d):
    return e.concurrence(daily(spark, d), families(spark, d), SHORT)


def concurrence(spark, d):
    return rounded(concurrence_rows(spark, d))


def concurrence_consensus(spark, d):
    return rounded(e.consensus(concurrence_rows(spark, d), SHORT))


def national_comparison(spark, d):
    return rounded(e.national_comparison(phases(spark, d), roles(spark, d), SHORT))


def control_adjusted(spark, d):
    return rounded(e.control_adjusted(phases(spark, d), roles(spark, d), allowed(spark, d), SHORT))


def attribution(spark, d):
    p = phases(spark, d)
    r = roles(spark, d).withColumn("proxy", F.substring("episode_id", 3, 9).cast("int") % 2 == 0)
    agreed, control = e.consensus(concurrence_rows(spark, d), SHORT), e.control_adjusted(p, r, allowed(spark, d), SHORT)
    return rounded(e.attribution(p, agreed, control, e.national_comparison(p, r, SHORT), s.phase_stability(p, SHORT), r, SHORT))


def dims(spark, d):
    """Nations as states: region, the tier of most customers' segment, climate by key, availability unknown for some."""
    seg = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    mode = seg.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("tier"))
    n = table(spark, d, "nation").join(mode, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select(F.col("n_nationkey").alias("state"), F.col("n_regionkey").alias("region"), F.when(F.col("n_nationkey") % 7 == 0, "unknown").otherwise(F.col("tier")).alias("tier"), F.when(F.col("n_nationkey") % 3 == 0, "unknown").otherwise((F.col("n_nationkey") % 3).cast("string")).alias("climate"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey") % 4 == 1).alias("available"))


def order_events(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.date_add(F.lit("2023-12-01").cast("date"), (F.col("o_orderkey") * 13 % 61 + F.floor(F.col("o_orderkey") / 1000) * 70).cast("int"))
    return o.select(F.col("o_orderkey").alias("episode_id"), F.col("c_nationkey").alias("state"), start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 4).cast("int")).alias("end"))


def control_selection(spark, d):
    ep = order_events(spark, d)
    busy = ep.where("episode_id % 60 = 0").select("state", F.col("start").alias("first"), F.col("end").alias("last"))
    return e.select_controls(ep, dims(spark, d), busy)


def first_controls(spark, d):
    return e.first_controls(control_selection(spark, d))


def anchor_scale(spark, d):
    return rounded(e.anchor_scale(daily(spark, d).join(plan(spark, d).select("request_id", "episode_id"), "request_id"), "view"))


def anchor_ratio_peak(spark, d):
    return rounded(e.anchor_ratio_peak(daily(spark, d), "view"))


FAM = """,
fam AS (SELECT DISTINCT event_type AS concept_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'demand' WHEN event_type = 'view' THEN 'awareness' WHEN event_type = 'error' THEN 'nonflood' ELSE 'weather' END AS family FROM events),
pk AS (SELECT request_id, repeat_id, concept_id, family, max(value) AS peak_value, count(*) AS days, first(date ORDER BY value DESC, date) AS peak_date FROM daily JOIN fam USING (concept_id) GROUP BY 1, 2, 3, 4),
best AS (SELECT request_id, repeat_id, family, first(concept_id ORDER BY peak_value DESC, days DESC, concept_id DESC) AS other_id, first(peak_date ORDER BY peak_value DESC, days DESC, concept_id DESC) AS other_peak_date, max(peak_value) AS other_peak_value FROM pk WHERE family <> 'demand' GROUP BY 1, 2, 3),
pairs AS (SELECT pk.request_id, pk.repeat_id, pk.concept_id, pk.peak_date, f.family, other_id, other_peak_date, other_peak_value FROM pk CROSS JOIN (SELECT DISTINCT family FROM fam WHERE family <> 'demand') f LEFT JOIN best ON best.request_id = pk.request_id AND best.repeat_id = pk.repeat_id AND best.family = f.family WHERE pk.family = 'demand'),
al AS (SELECT p.request_id, p.repeat_id, p.concept_id, p.family, CASE WHEN count(*) >= 5 AND stddev_pop(x.value) > 1e-12 AND stddev_pop(y.value) > 1e-12 THEN corr(x.value, y.value) END AS correlation, count(*) AS aligned_days
  FROM pairs p JOIN daily x USING (request_id, repeat_id, concept_id) JOIN daily y ON y.request_id = p.request_id AND y.repeat_id = p.repeat_id AND y.concept_id = p.other_id AND y.date = x.date GROUP BY 1, 2, 3, 4),
conc AS (SELECT pairs.*, correlation, aligned_days, abs(datediff('day', peak_date, other_peak_date)) AS peak_difference, coalesce(abs(datediff('day', peak_date, other_peak_date)) <= 2, FALSE) AS strong, coalesce(abs(datediff('day', peak_date, other_peak_date)) <= 7, FALSE) AS moderate FROM pairs LEFT JOIN al USING (request_id, repeat_id, concept_id, family)),
cons AS (SELECT request_id, concept_id, family, count(*) AS repeats, count(*) FILTER (strong) AS strong_repeats, count(*) FILTER (moderate) AS moderate_repeats, count(*) FILTER (strong) / count(*) AS strong_share, count(*) FILTER (moderate) / count(*) AS moderate_share, bool_or(strong) AS any_strong,
  count(peak_difference) AS valid_differences, median(peak_difference) AS median_difference, max(peak_difference) - min(peak_difference) AS difference_range, count(other_id) = count(*) AND count(DISTINCT other_id) = 1 AS same_other, count(other_peak_date) = count(*) AND count(DISTINCT other_peak_date) = 1 AS same_other_date,
  count(DISTINCT peak_date) = 1 AS same_date, coalesce(string_agg(DISTINCT other_id, ';' ORDER BY other_id), '') AS others, median(correlation) AS median_correlation, min(correlation) AS least_correlation, max(correlation) AS largest_correlation, count(correlation) AS correlations FROM conc GROUP BY 1, 2, 3),
cons2 AS (SELECT *, CASE WHEN valid_differences = 0 THEN 'insufficient' WHEN repeats < 2 THEN 'not_repeated' WHEN strong_share = 1 THEN 'unanimous' WHEN strong_share > 0.5 THEN 'majority' WHEN strong_share > 0 THEN 'minority_only' ELSE 'none' END AS verdict, CASE WHEN repeats = 2 THEN strong_share = 1 ELSE strong_share >= 0.5 END AS supports FROM cons),
pmr AS (SELECT pm.*, role, episode_id FROM pm JOIN plan USING (request_id)),
nat AS (SELECT episode_id, concept_id, repeat_id, t.peak_date AS state_peak_date, t.peak_value AS state_peak_value, t.peak_standardized AS state_peak_standardized, t.quality AS state_quality, n.peak_date AS national_peak_date, n.peak_value AS national_peak_value, n.peak_standardized AS national_peak_standardized, n.quality AS national_quality
  FROM (SELECT * FROM pmr WHERE role = 'treated') t LEFT JOIN (SELECT * FROM pmr WHERE role = 'national') n USING (episode_id, concept_id, repeat_id)),
nat2 AS (SELECT *, abs(datediff('day', state_peak_date, national_peak_date)) AS peak_difference, CASE WHEN national_quality IS NULL THEN 'no_national_series' WHEN national_quality <> 'usable' OR state_quality <> 'usable' OR national_peak_date IS NULL OR state_peak_date IS NULL THEN 'insufficient'
  WHEN abs(datediff('day', state_peak_date, national_peak_date)) <= 2 THEN 'concurrent' ELSE 'not_concurrent' END AS status FROM nat),
st AS (""" + " UNION ALL ".join(f"SELECT role, episode_id, request_id, concept_id, repeat_id, '{p}' AS phase, {p}_standardized AS lift FROM pmr" for p in PH) + """),
cb AS (SELECT episode_id, concept_id, repeat_id, phase, count(*) AS controls, median(lift) AS control_median, quantile_cont(lift, 0.75) - quantile_cont(lift, 0.25) AS control_iqr, greatest(count(*) FILTER (lift > 0), count(*) FILTER (lift < 0)) AS same_sign FROM st WHERE role = 'control' AND lift IS NOT NULL GROUP BY 1, 2, 3, 4),
ctl AS (SELECT episode_id, concept_id, repeat_id, phase, lift AS treated_lift, coalesce(controls, 0) AS controls, control_median, control_iqr, lift - control_median AS adjusted_lift, coalesce(same_sign >= 0.75 * controls, FALSE) AS concordant
  FROM (SELECT * FROM st WHERE role = 'treated') t LEFT JOIN cb USING (episode_id, concept_id, repeat_id, phase)),
stab AS (SELECT request_id, concept_id, count(*) AS repeats, CASE WHEN count(*) < 2 THEN 'not_repeated' WHEN count(DISTINCT coalesce(dominant_phase, 'None')) = 1 AND coalesce(greatest(""" + ", ".join(f"CASE WHEN count({p}_standardized) >= 2 THEN stddev_pop({p}_standardized) END" for p in PH) + """), 0) <= 1 THEN 'stable' ELSE 'unstable' END AS status FROM pm GROUP BY 1, 2)
"""
ALL = PHASE_SQL + FAM
CONTROL_SQL = """
ep AS (SELECT o_orderkey AS episode_id, c_nationkey AS state, DATE '2023-12-01' + CAST(o_orderkey * 13 % 61 + o_orderkey // 1000 * 70 AS INT) AS s, DATE '2023-12-01' + CAST(o_orderkey * 13 % 61 + o_orderkey // 1000 * 70 + o_orderkey % 4 AS INT) AS e FROM orders JOIN customer ON o_custkey = c_custkey),
seg AS (SELECT c_nationkey, arg_min(c_mktsegment, row(-n, c_mktsegment)) AS tier FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1),
dim AS (SELECT n_nationkey AS state, n_regionkey AS region, CASE WHEN n_nationkey % 7 > 0 THEN tier END AS tier, nullif(n_nationkey % 3, 0) AS climate, coalesce(n_nationkey % 4 = 1, FALSE) AS available FROM nation LEFT JOIN seg ON n_nationkey = c_nationkey),
pr AS (SELECT ep.episode_id, d.state AS control_state, (CASE WHEN d.region = o.region THEN 4 ELSE 0 END) + (CASE WHEN d.tier = o.tier THEN 2 ELSE 0 END) + (CASE WHEN d.climate = o.climate THEN 1 ELSE 0 END) + (CASE WHEN d.available THEN 1 ELSE 0 END) AS score
  FROM ep JOIN dim o ON o.state = ep.state JOIN dim d ON d.state <> ep.state WHERE NOT EXISTS (SELECT 1 FROM ep b WHERE b.episode_id % 60 = 0 AND b.state = d.state AND b.s <= ep.e + 7 AND ep.s - 7 <= b.e)),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, control_state) AS control_rank FROM pr) WHERE control_rank <= 3)
"""
ORACLE = {
    "concurrence": f"WITH {ALL} SELECT request_id, repeat_id, concept_id, peak_date, family, other_id, other_peak_date, round(other_peak_value, 6) AS other_peak_value, round(correlation, 6) AS correlation, aligned_days, peak_difference, strong, moderate FROM conc",
    "concurrence_consensus": f"WITH {ALL} SELECT * REPLACE (round(strong_share, 6) AS strong_share, round(moderate_share, 6) AS moderate_share, round(median_difference, 6) AS median_difference, round(median_correlation, 6) AS median_correlation, round(least_correlation, 6) AS least_correlation, round(largest_correlation, 6) AS largest_correlation) FROM cons2",
    "national_comparison": f"WITH {ALL} SELECT * REPLACE (round(state_peak_value, 6) AS state_peak_value, round(state_peak_standardized, 6) AS state_peak_standardized, round(national_peak_value, 6) AS national_peak_value, round(national_peak_standardized, 6) AS national_peak_standardized) FROM nat2",
    "control_adjusted": f"WITH {ALL} SELECT * REPLACE (round(treated_lift, 6) AS treated_lift, round(control_median, 6) AS control_median, round(control_iqr, 6) AS control_iqr, round(adjusted_lift, 6) AS adjusted_lift) FROM ctl",
    "attribution": f"""WITH {ALL},
sup AS (SELECT request_id, concept_id, bool_or(supports) FILTER (family = 'awareness') AS awareness, bool_or(supports) FILTER (family = 'weather') AS weather, bool_or(supports) FILTER (family = 'nonflood') AS nonflood FROM cons2 GROUP BY 1, 2),
ev AS (SELECT p.request_id, p.episode_id, p.concept_id, p.repeat_id, p.dominant_phase, CASE p.dominant_phase {' '.join(f"WHEN '{x}' THEN {x}_standardized" for x in PH)} END AS standardized, CASE p.dominant_phase {' '.join(f"WHEN '{x}' THEN {x}_robust" for x in PH)} END AS robust, c.adjusted_lift, nat2.status AS national_status, p.quality,
  coalesce(awareness, FALSE) AS flood, coalesce(weather, FALSE) AS weather, coalesce(nonflood, FALSE) AS other, coalesce(c.adjusted_lift >= 1 AND c.controls >= 2, FALSE) AS local_, NOT coalesce(stab.repeats > 1, FALSE) OR coalesce(stab.status = 'stable', FALSE) AS steady,
  coalesce(nat2.status = 'concurrent', FALSE) AS spike, coalesce(nat2.status = 'not_concurrent', FALSE) AS calm, CAST(substr(p.episode_id, 3) AS INT) % 2 = 0 AS proxy
  FROM pmr p LEFT JOIN sup USING (request_id, concept_id) LEFT JOIN ctl c ON c.episode_id = p.episode_id AND c.concept_id = p.concept_id AND c.repeat_id = p.repeat_id AND c.phase = p.dominant_phase
  LEFT JOIN nat2 ON nat2.episode_id = p.episode_id AND nat2.concept_id = p.concept_id AND nat2.repeat_id = p.repeat_id LEFT JOIN stab ON stab.request_id = p.request_id AND stab.concept_id = p.concept_id WHERE p.role = 'treated'),
e2 AS (SELECT *, dominant_phase IS NOT NULL AND coalesce(standardized >= 1, FALSE) AND (robust IS NULL OR robust >= 1) AS eff FROM ev)
SELECT request_id, episode_id, concept_id, repeat_id, dominant_phase, round(standardized, 6) AS standardized, round(adjusted_lift, 6) AS adjusted_lift, national_status,
CASE WHEN quality <> 'usable' THEN 'insufficient_evidence' WHEN eff AND flood AND local_ AND steady AND calm THEN 'event_consistent_signal' WHEN proxy AND spike AND NOT flood AND NOT local_ THEN 'likely_national_or_promotional' WHEN (weather OR other) AND NOT flood THEN 'nonflood_weather_consistent'
WHEN eff AND (flood OR weather) THEN 'possibly_event_consistent' ELSE 'unrelated_or_ambiguous' END AS category,
concat_ws(';', CASE WHEN eff THEN 'phase_effect' END, CASE WHEN flood THEN 'awareness' END, CASE WHEN weather THEN 'weather' END, CASE WHEN other THEN 'other_weather' END, CASE WHEN local_ THEN 'over_controls' END, CASE WHEN steady THEN 'stable_repeats' END, CASE WHEN spike THEN 'national_peak' END, CASE WHEN calm THEN 'no_national_peak' END,
CASE WHEN quality <> 'usable' THEN 'quality' END) AS reasons FROM e2""",
    "control_selection": f"WITH {CONTROL_SQL} SELECT episode_id, control_state, score, control_rank FROM sel",
    "first_controls": f"WITH {CONTROL_SQL} SELECT episode_id, min(control_state) AS control_state, count(*) AS rows FROM sel WHERE control_rank = 1 GROUP BY 1",
    "anchor_scale": f"""WITH {PHASE_SQL}, a AS (SELECT episode_id, request_id, date, avg(value) AS v FROM daily JOIN plan USING (request_id) WHERE concept_id = 'view' GROUP BY 1, 2, 3 HAVING avg(value) > 0),
x AS (SELECT episode_id, a.request_id, b.request_id AS other_id, a.v / b.v AS ratio FROM a JOIN a b USING (episode_id, date) WHERE a.request_id < b.request_id)
SELECT episode_id, request_id, other_id, count(*) AS days, round(median(ratio), 6) AS scale, round(stddev_pop(ratio), 6) AS spread, round(mad(ratio), 6) AS residual, stddev_pop(ratio) <= 0.5 * median(ratio) AS stable FROM x GROUP BY 1, 2, 3""",
    "anchor_ratio_peak": f"""WITH {PHASE_SQL} SELECT d.request_id, d.repeat_id, d.concept_id, round(max(d.value / a.value), 6) AS ratio_peak, count(*) AS days FROM daily d JOIN daily a ON a.request_id = d.request_id AND a.repeat_id = d.repeat_id AND a.date = d.date AND a.concept_id = 'view' AND a.value >= 5 WHERE d.concept_id <> 'view' GROUP BY 1, 2, 3""",
}
QUERIES = {f.__name__: f for f in (concurrence, concurrence_consensus, national_comparison, control_adjusted, attribution, control_selection, first_controls, anchor_scale, anchor_ratio_peak)}

"""Queries about integration, description and the final analysis, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SHORT
from ..functions.expr import rounded
from ..operators import describe as d_
from ..operators import finalize as f_
from ..operators import integrate as i_
from ..operators import series as s
from .base import daily, observations, plan, table
from .evidence_queries import families, roles
from .series_queries import PHASE_SQL, RESPONSE_SQL

METRICS = ["lift_absolute", "lift_z", "lift_robust", "peak_value"]


def responses(spark, d):
    return s.response_metrics(daily(spark, d), plan(spark, d), SHORT)


def parts(spark, d):
    """Response rows as base, repeats and episodes from which some keys are missing, and a plan that knows some repeats only."""
    r = responses(spark, d).select("request_id", "repeat_id", "concept_id", "peak_value", F.lit("").alias("panel"), F.lit(None).cast("string").alias("backend"))
    base = r.where("not (request_id = 'r4' and concept_id = 'click')")
    repeats = r.where("not (request_id = 'r2' and repeat_id = 'repeat_2')").withColumn("panel", F.lit("core")).drop("peak_value")
    episodes = r.where("concept_id <> 'error'").select("request_id", "concept_id").distinct().withColumn("backend", F.lit("store"))
    p = plan(spark, d).select("request_id", "geography")
    exact = p.where("request_id <> 'r3'").select("request_id", F.lit("repeat_1").alias("repeat_id"), F.lit("exact").alias("panel"))
    whole = p.where("request_id <> 'r1'").select("request_id", F.lit(None).cast("string").alias("repeat_id"), F.lit("whole").alias("panel"))
    return base, exact.unionByName(whole), repeats, episodes


def integrated(spark, d):
    return rounded(i_.integrate(*parts(spark, d), ("panel", "backend")))


def join_summary(spark, d):
    return i_.join_summary(integrated(spark, d))


def orphan_rows(spark, d):
    base, _, repeats, episodes = parts(spark, d)
    wanted = plan(spark, d).select("request_id", F.lit("click;view;refund").alias("concept_ids"))
    return i_.orphans(base, wanted, repeats, episodes)


def unmatched_counts(spark, d):
    return i_.unmatched_counts(orphan_rows(spark, d))


def lineage_conflicts(spark, d):
    o = observations(spark, d).select("request_id", F.col("concept_id").alias("a"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("").alias("b"))
    return i_.lineage_conflicts(o, ("a", "b"))


def request_summaries(spark, d):
    return rounded(d_.request_summaries(responses(spark, d), METRICS, ["request_id", "concept_id"]))


def group_summaries(spark, d):
    return rounded(d_.over_groups(d_.request_summaries(responses(spark, d), METRICS, ["request_id", "concept_id"]), [["request_id"], ["concept_id"], []]))


def family_summaries(spark, d):
    by = d_.request_summaries(responses(spark, d), METRICS, ["request_id", "concept_id"]).join(families(spark, d), "concept_id")
    return rounded(d_.over_groups(by, [["family"]]))


def paired_diagnostics(spark, d):
    return rounded(d_.paired_diagnostics(responses(spark, d), METRICS))


def rank_agreement(spark, d):
    return rounded(d_.rank_agreement(responses(spark, d), METRICS))


def exclusion_ledger(spark, d):
    r = responses(spark, d)
    return d_.exclusions(d_.request_summaries(r, METRICS, ["request_id", "concept_id"]), d_.paired_diagnostics(r, METRICS), d_.rank_agreement(r, METRICS, 6))


def column_audit(spark, d):
    return rounded(d_.column_audit(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")))


def metric_viability(spark, d):
    return rounded(d_.metric_viability(responses(spark, d), METRICS))


def group_coverage(spark, d):
    return d_.group_coverage(responses(spark, d), ["request_id", "concept_id", "repeat_id", "quality"])


def repeat_coverage(spark, d):
    return d_.repeat_coverage(responses(spark, d))


def readiness(spark, d):
    r = responses(spark, d)
    return d_.readiness(r, d_.metric_viability(r, METRICS), roles(spark, d))


def finals(spark, d):
    return f_.final_metrics(daily(spark, d), plan(spark, d), SHORT)


def final_metrics(spark, d):
    return rounded(finals(spark, d))


def event_units(spark, d):
    return rounded(f_.event_units(finals(spark, d)))


def complete_pairs(spark, d):
    return f_.complete_pairs(finals(spark, d)).select("request_id", "repeat_id", "concept_id", "variant", "eligible", "complete_pair")


def contrasts(spark, d):
    return rounded(f_.contrasts(f_.event_units(finals(spark, d))))


def final_sensitivity(spark, d):
    return rounded(f_.sensitivity(f_.event_units(finals(spark, d))))


def readiness_counters(spark, d):
    return f_.readiness_counters(finals(spark, d))


def sample_flow(spark, d):
    return f_.sample_flow(plan(spark, d), daily(spark, d), finals(spark, d))


def response_summary(spark, d):
    u = f_.event_units(finals(spark, d))
    return rounded(f_.response_summary(u, f_.contrasts(u)))


def event_curve(spark, d):
    return rounded(f_.event_curve(daily(spark, d), plan(spark, d), finals(spark, d), 9))


def store_agreement(spark, d):
    x = daily(spark, d)
    return rounded(f_.store_agreement(x.where("repeat_id = 'repeat_1'"), x.where("repeat_id = 'repeat_2'"), ["request_id", "concept_id"]))


def content_hash(spark, d):
    return f_.content_hash(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


def ridge_model(spark, d):
    o = observations(spark, d).withColumn("grp", F.col("user_id").cast("string"))
    rows = o.groupBy("grp", "concept_id").agg(F.avg("interest").alias("target"), F.count("*").cast("double").alias("n"), F.max("interest").alias("top"), F.sin(F.avg(F.dayofmonth("date"))).alias("phase"))
    rows = rows.withColumn("top", F.when(F.hash("grp", "concept_id") % 7 != 0, F.col("top")))
    return rounded(f_.model_errors(f_.ridge(rows, "target", ["n", "top", "phase"], "grp", "concept_id", least_groups=15, least_training=10)), 4)


_K = "request_id, repeat_id, concept_id"
_U = "u AS (" + " UNION ALL ".join(f"SELECT {_K}, '{m}' AS metric, {m} AS value FROM rm" for m in METRICS) + ")"
PARTS = RESPONSE_SQL + """,
r AS (SELECT request_id, repeat_id, concept_id, peak_value FROM rm), base AS (SELECT * FROM r WHERE NOT (request_id = 'r4' AND concept_id = 'click')),
rep AS (SELECT * FROM r WHERE NOT (request_id = 'r2' AND repeat_id = 'repeat_2')), epi AS (SELECT DISTINCT request_id, concept_id FROM r WHERE concept_id <> 'error'),
intg AS (SELECT base.*, CASE WHEN request_id <> 'r3' AND repeat_id = 'repeat_1' THEN 'exact' WHEN request_id <> 'r1' THEN 'whole' WHEN rep.request_id IS NOT NULL THEN 'core' END AS panel_value, CASE WHEN epi.request_id IS NOT NULL THEN 'store' END AS backend_value,
  CASE WHEN request_id <> 'r3' AND repeat_id = 'repeat_1' THEN 'exact' WHEN request_id <> 'r1' THEN 'request' ELSE 'none' END AS plan_match, rep.request_id IS NOT NULL AS repeat_match, epi.request_id IS NOT NULL AS episode_match
  FROM base LEFT JOIN rep USING (request_id, repeat_id, concept_id) LEFT JOIN epi USING (request_id, concept_id)),
orph AS (SELECT 'repeat' AS source, 'base_without' AS direction, request_id, repeat_id, concept_id FROM base ANTI JOIN rep USING (request_id, repeat_id, concept_id)
  UNION ALL SELECT 'episode', 'base_without', request_id, repeat_id, concept_id FROM base ANTI JOIN epi USING (request_id, concept_id) UNION ALL SELECT 'repeat', 'without_base', request_id, repeat_id, concept_id FROM rep ANTI JOIN base USING (request_id, repeat_id, concept_id)
  UNION ALL SELECT 'episode', 'without_base', request_id, NULL, concept_id FROM epi ANTI JOIN base USING (request_id, concept_id)
  UNION ALL SELECT 'plan', 'without_base', request_id, NULL, concept_id FROM (SELECT request_id, unnest(['click', 'view', 'refund']) AS concept_id FROM plan) w ANTI JOIN base USING (request_id, concept_id))
"""
SUMM = RESPONSE_SQL + "," + _U + """,
rs AS (SELECT request_id, concept_id, metric, count(*) AS n, count(value) AS valid, count(*) - count(value) AS missing, CAST(0 AS BIGINT) AS not_finite, avg(value) AS mean, median(value) AS median, min(value) AS least, max(value) AS most, CASE WHEN count(value) > 1 THEN stddev_samp(value) END AS sd FROM u GROUP BY 1, 2, 3),
pd AS (SELECT request_id, concept_id, metric, count(DISTINCT repeat_id) AS repeats, count(value) AS valid, arg_min_null(value, repeat_id) AS first, arg_max_null(value, repeat_id) AS second FROM u GROUP BY 1, 2, 3),
pe AS (SELECT *, CASE WHEN repeats <> 2 THEN 'not_two_repeats' WHEN valid <> 2 THEN 'missing_value' END AS exclusion_reason, CASE WHEN repeats = 2 AND valid = 2 THEN second - first END AS d, (abs(first) + abs(second)) / 2 AS size FROM pd),
pr AS (SELECT a.request_id, a.metric, a.repeat_id AS first, b.repeat_id AS second, a.concept_id, a.value AS x, b.value AS y FROM u a JOIN u b ON a.request_id = b.request_id AND a.metric = b.metric AND a.concept_id = b.concept_id AND a.repeat_id < b.repeat_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY request_id, metric, first, second ORDER BY x) + (count(*) OVER (PARTITION BY request_id, metric, first, second, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY request_id, metric, first, second ORDER BY y) + (count(*) OVER (PARTITION BY request_id, metric, first, second, y) - 1) / 2.0 AS ry FROM pr),
ra AS (SELECT request_id, metric, first, second, count(*) AS concepts, CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 1e-12 AND stddev_pop(ry) > 1e-12 THEN corr(rx, ry) END AS spearman FROM rk GROUP BY 1, 2, 3, 4)
"""
_fin = lambda name, end: f"""SELECT d.*, p.role, p.episode_id, p.geography, '{name}' AS variant, date BETWEEN onset - 14 AND {end} AS inb, date BETWEEN onset - 3 AND event_end + 9 AS inr, datediff('day', onset - 3, event_end + 9) + 1 AS wd FROM daily d JOIN plan p USING (request_id)"""
FINAL = PHASE_SQL + f""",
fx AS ({_fin('main', 'onset - 4')} UNION ALL {_fin('late', 'onset - 1')}),
f0 AS (SELECT request_id, repeat_id, concept_id, variant, role, episode_id, geography, count(value) FILTER (inb) AS baseline_days, avg(value) FILTER (inb) AS baseline_mean, CASE WHEN count(value) FILTER (inb) >= 2 THEN stddev_pop(value) FILTER (inb) END AS baseline_sd, median(value) FILTER (inb) AS middle, mad(value) FILTER (inb) AS madv,
  count(value) FILTER (inr) AS response_days, max(wd) AS wd, max(value) FILTER (inr) AS peak_value, first(date ORDER BY value DESC, date) FILTER (inr) AS peak_date, avg(CAST(value = 0 AS INT)) FILTER (inb OR inr) AS zero_share, max(value) AS top FROM fx GROUP BY 1, 2, 3, 4, 5, 6, 7),
fin AS (SELECT *, peak_value - baseline_mean AS lift, CASE WHEN baseline_sd > 0.001 THEN (peak_value - baseline_mean) / baseline_sd END AS standardized, CASE WHEN madv > 0.001 THEN (peak_value - middle) / (1.4826 * madv) END AS robust,
  concat_ws(';', CASE WHEN baseline_days < 5 THEN 'baseline' END, CASE WHEN response_days < ceil(0.8 * wd) THEN 'coverage' END, CASE WHEN zero_share >= 0.5 THEN 'zeros' END, CASE WHEN top = 0 THEN 'all_zero' END, CASE WHEN coalesce(baseline_sd, 0) <= 0.001 THEN 'flat' END) AS reasons FROM f0),
fe AS (SELECT *, reasons = '' AS eligible FROM fin),
un AS (SELECT episode_id, geography, concept_id, role, request_id, variant, count(*) AS repeats, count(*) FILTER (eligible) AS eligible_repeats, avg(baseline_days) FILTER (eligible) AS baseline_days, avg(baseline_mean) FILTER (eligible) AS baseline_mean, avg(baseline_sd) FILTER (eligible) AS baseline_sd, avg(response_days) FILTER (eligible) AS response_days, avg(zero_share) FILTER (eligible) AS zero_share, avg(peak_value) FILTER (eligible) AS peak_value, avg(lift) FILTER (eligible) AS lift, avg(standardized) FILTER (eligible) AS standardized, avg(robust) FILTER (eligible) AS robust,
  CASE WHEN count(lift) FILTER (eligible) >= 2 THEN stddev_pop(lift) FILTER (eligible) END AS lift_sd, CAST(to_json(list(struct_pack(repeat_id := repeat_id, peak_date := CAST(peak_date AS VARCHAR)) ORDER BY repeat_id) FILTER (eligible)) AS VARCHAR) AS source_lineage FROM fe GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) FILTER (eligible) > 0),
ct AS (SELECT t.episode_id, t.concept_id, t.variant, t.request_id AS treated_request_id, t.geography AS treated_geography, t.lift AS treated_lift, t.standardized AS treated_standardized, c.request_id AS control_request_id, c.geography AS control_geography, c.lift AS control_lift, c.standardized AS control_standardized, t.lift - c.lift AS lift_contrast, t.standardized - c.standardized AS standardized_contrast
  FROM un t JOIN un c USING (episode_id, concept_id, variant) WHERE t.role = 'treated' AND c.role = 'control' AND t.request_id <> c.request_id AND t.geography <> c.geography)
"""
_r = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_og = "count(mean) AS units, round(avg(mean), 6) AS average, round(median(mean), 6) AS middle, round(quantile_cont(mean, 0.25), 6) AS q1, round(quantile_cont(mean, 0.75), 6) AS q3, round(CASE WHEN count(mean) > 1 THEN stddev_samp(mean) END, 6) AS spread, coalesce(CAST(sum(CAST(mean = 0 AS INT)) AS BIGINT), NULL) AS zeros, CAST(sum(CAST(mean > 0 AS INT)) AS BIGINT) AS positive, CAST(sum(CAST(mean < 0 AS INT)) AS BIGINT) AS negative"
ORACLE = {
    "integrated": f"WITH {PARTS} SELECT {_K}, {_r('peak_value')}, panel_value, backend_value, plan_match, repeat_match, episode_match FROM intg",
    "join_summary": f"WITH {PARTS} SELECT count(*) AS rows, count(*) FILTER (plan_match = 'exact') AS exact_plans, count(*) FILTER (plan_match = 'request') AS request_plans, count(*) FILTER (plan_match = 'none') AS no_plan, count(*) FILTER (NOT repeat_match) AS no_repeat, count(*) FILTER (NOT episode_match) AS no_episode FROM intg",
    "orphan_rows": f"WITH {PARTS} SELECT * FROM orph",
    "unmatched_counts": f"WITH {PARTS} SELECT source, direction, count(*) AS n FROM orph GROUP BY 1, 2",
    "lineage_conflicts": f"WITH {PHASE_SQL} SELECT request_id, 'a' AS field, string_agg(DISTINCT concept_id, ';' ORDER BY concept_id) AS \"values\", count(DISTINCT concept_id) AS n FROM obs GROUP BY 1 HAVING count(DISTINCT concept_id) > 1",
    "request_summaries": f"WITH {SUMM} SELECT request_id, concept_id, metric, n, valid, missing, not_finite, {_r('mean', 'median', 'least', 'most', 'sd')} FROM rs",
    "group_summaries": f"WITH {SUMM} SELECT concept_id, request_id, metric, concat_ws('+', CASE WHEN grouping(concept_id) = 0 THEN 'concept_id' END, CASE WHEN grouping(request_id) = 0 THEN 'request_id' END) AS scope, {_og} FROM rs GROUP BY GROUPING SETS ((request_id, metric), (concept_id, metric), (metric))",
    "family_summaries": f"WITH {SUMM}, fam AS (SELECT DISTINCT event_type AS concept_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'demand' WHEN event_type = 'view' THEN 'awareness' WHEN event_type = 'error' THEN 'nonflood' ELSE 'weather' END AS family FROM events) SELECT family, metric, 'family' AS scope, {_og} FROM rs JOIN fam USING (concept_id) GROUP BY family, metric",
    "paired_diagnostics": f"WITH {SUMM} SELECT request_id, concept_id, metric, repeats, valid, round(d, 6) AS difference, round(abs(d), 6) AS absolute_difference, round(abs(d) / sqrt(2), 6) AS pair_sd, CASE WHEN size > 1e-12 THEN round(abs(d) / size, 6) END AS relative_difference, exclusion_reason FROM pe",
    "rank_agreement": f"WITH {SUMM} SELECT request_id, metric, first, second, concepts, round(spearman, 6) AS spearman, CASE WHEN concepts < 3 THEN 'too_few_concepts' WHEN spearman IS NULL THEN 'constant' END AS exclusion_reason FROM ra",
    "exclusion_ledger": f"""WITH {SUMM} SELECT 'value' AS kind, request_id, concept_id, metric, 'missing' AS reason FROM rs WHERE missing > 0 UNION ALL SELECT 'pair', request_id, concept_id, metric, exclusion_reason FROM pe WHERE exclusion_reason IS NOT NULL
UNION ALL SELECT 'rank', request_id, NULL, metric, CASE WHEN concepts < 6 THEN 'too_few_concepts' ELSE 'constant' END FROM ra WHERE concepts < 6 OR spearman IS NULL""",
    "column_audit": " UNION ALL ".join(f"SELECT count(*) AS rows, '{c}' AS \"column\", '{k}' AS character, count({c}) AS present, count(DISTINCT {c}) AS \"values\", CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS most, count({c}) AS finite, 1 - count({c}) / count(*) AS null_share FROM lineitem" for c, k in (("l_orderkey", "count"), ("l_linenumber", "count"), ("l_quantity", "continuous"), ("l_discount", "bounded"), ("l_returnflag", "label"))),
    "metric_viability": f"""WITH {SUMM}, un1 AS (SELECT metric, request_id, concept_id, count(DISTINCT repeat_id) AS repeats, avg(value) AS v FROM u WHERE value IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT metric, count(DISTINCT request_id) AS requests, count(DISTINCT concept_id) AS concepts, count(*) AS units, count(*) FILTER (repeats >= 2) AS repeated_units, avg(v) AS mean, CASE WHEN count(v) >= 2 THEN stddev_pop(v) END AS sd FROM un1 GROUP BY 1)
SELECT metric, requests, concepts, units, repeated_units, {_r('mean', 'sd')}, CASE WHEN units < 3 THEN 'too_few_units' WHEN repeated_units = 0 THEN 'not_repeated' WHEN coalesce(sd, 0) <= 1e-12 THEN 'constant' ELSE 'usable' END AS reason FROM v""",
    "group_coverage": f"WITH {SUMM} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS rows, count(DISTINCT request_id) AS requests FROM rm GROUP BY {c}" for c in ("request_id", "concept_id", "repeat_id", "quality")),
    "repeat_coverage": f"WITH {SUMM} SELECT request_id, concept_id, count(DISTINCT repeat_id) AS repeats, string_agg(DISTINCT repeat_id, ';' ORDER BY repeat_id) AS repeat_ids, count(DISTINCT repeat_id) = 2 AS pair FROM rm GROUP BY 1, 2",
    "readiness": f"""WITH {SUMM}, un1 AS (SELECT metric, request_id, concept_id, count(DISTINCT repeat_id) AS repeats, avg(value) AS v FROM u WHERE value IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT metric, count(*) >= 3 AND count(*) FILTER (repeats >= 2) > 0 AND coalesce(CASE WHEN count(v) >= 2 THEN stddev_pop(v) END, 0) > 1e-12 AS usable FROM un1 GROUP BY 1),
x AS (SELECT (SELECT count(*) FROM v WHERE usable) AS usable_metrics, (SELECT count(*) FROM v) AS metrics, (SELECT count(*) FROM (SELECT 1 FROM rm GROUP BY request_id, concept_id HAVING count(DISTINCT repeat_id) = 2)) AS paired_units,
  (SELECT count(*) FROM (SELECT 1 FROM rm JOIN plan USING (request_id) GROUP BY episode_id, concept_id HAVING bool_or(role = 'treated') AND bool_or(role = 'control'))) AS matched_concepts)
SELECT *, CASE WHEN usable_metrics = 0 THEN 'collect_more' WHEN matched_concepts = 0 THEN 'add_controls' WHEN paired_units = 0 THEN 'repeat_requests' ELSE 'ready' END AS recommendation FROM x""",
    "final_metrics": f"WITH {FINAL} SELECT {_K}, variant, role, episode_id, geography, baseline_days, {_r('baseline_mean', 'baseline_sd', 'peak_value', 'zero_share', 'lift', 'standardized', 'robust')}, response_days, peak_date, reasons, eligible FROM fe",
    "event_units": f"WITH {FINAL} SELECT episode_id, geography, concept_id, role, request_id, variant, repeats, eligible_repeats, {_r('baseline_days', 'baseline_mean', 'baseline_sd', 'response_days', 'zero_share', 'peak_value', 'lift', 'standardized', 'robust', 'lift_sd')}, source_lineage FROM un",
    "complete_pairs": f"""WITH {FINAL} SELECT {_K}, variant, eligible, coalesce(bool_or(role = 'treated' AND eligible) OVER w AND bool_or(role = 'control' AND eligible) OVER w, FALSE) AS complete_pair FROM fe WHERE role IN ('treated', 'control') WINDOW w AS (PARTITION BY episode_id, concept_id, repeat_id, variant)""",
    "contrasts": f"WITH {FINAL} SELECT * REPLACE ({_r('treated_lift', 'treated_standardized', 'control_lift', 'control_standardized', 'lift_contrast', 'standardized_contrast')}) FROM ct",
    "final_sensitivity": f"""WITH {FINAL}, b AS (SELECT variant, role, avg(m) AS mean_lift, count(*) AS episodes FROM (SELECT variant, role, episode_id, avg(lift) AS m FROM un GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT u.variant, u.role, avg(u.lift - m.lift) AS mean_change, count(*) AS shared_units FROM un u JOIN un m ON m.variant = 'main' AND m.request_id = u.request_id AND m.concept_id = u.concept_id GROUP BY 1, 2)
SELECT variant, role, {_r('mean_lift')}, episodes, {_r('mean_change')}, shared_units FROM b LEFT JOIN c USING (variant, role)""",
    "readiness_counters": f"WITH {FINAL} SELECT count(*) AS rows, count(*) FILTER (eligible) AS eligible_rows, count(DISTINCT request_id) AS requests, count(DISTINCT episode_id) AS episodes, count(DISTINCT concept_id) AS concepts, count(DISTINCT request_id) FILTER (eligible) AS eligible_requests, count(DISTINCT episode_id) FILTER (eligible) AS eligible_episodes, count(DISTINCT concept_id) FILTER (eligible) AS eligible_concepts FROM fe WHERE variant = 'main'",
    "sample_flow": f"""WITH {FINAL} SELECT stage, role, count(DISTINCT request_id) AS requests FROM (SELECT 'planned' AS stage, role, request_id FROM plan UNION ALL SELECT 'acquired', role, request_id FROM daily JOIN plan USING (request_id)
UNION ALL SELECT 'verified', role, request_id FROM fe WHERE variant = 'main' AND baseline_days > 0 UNION ALL SELECT 'eligible', role, request_id FROM fe WHERE variant = 'main' AND eligible) GROUP BY 1, 2""",
    "response_summary": f"""WITH {FINAL}, b AS (SELECT concept_id, role, count(*) AS units, avg(lift) AS mean_lift, avg(standardized) AS mean_standardized FROM un WHERE variant = 'main' GROUP BY 1, 2), c AS (SELECT concept_id, 'treated' AS role, avg(lift_contrast) AS mean_contrast FROM ct WHERE variant = 'main' GROUP BY 1)
SELECT concept_id, role, units, {_r('mean_lift', 'mean_standardized', 'mean_contrast')} FROM b LEFT JOIN c USING (concept_id, role)""",
    "event_curve": f"""WITH {FINAL}, z AS (SELECT p.role, d.concept_id, p.episode_id, d.request_id, datediff('day', onset, date) AS lag, avg((value - baseline_mean) / baseline_sd) AS z FROM daily d JOIN plan p USING (request_id) JOIN (SELECT * FROM fe WHERE variant = 'main' AND eligible) f USING (request_id, repeat_id, concept_id) WHERE abs(datediff('day', onset, date)) <= 9 GROUP BY 1, 2, 3, 4, 5)
SELECT role, concept_id, lag, round(avg(z), 6) AS mean_z, count(*) AS units FROM z GROUP BY 1, 2, 3""",
    "store_agreement": f"""WITH {PHASE_SQL}, j AS (SELECT request_id, concept_id, date, a.value AS x, b.value AS y FROM daily a JOIN daily b USING (request_id, concept_id, date) WHERE a.repeat_id = 'repeat_1' AND b.repeat_id = 'repeat_2'),
k AS (SELECT *, rank() OVER (PARTITION BY request_id, concept_id ORDER BY x) + (count(*) OVER (PARTITION BY request_id, concept_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY request_id, concept_id ORDER BY y) + (count(*) OVER (PARTITION BY request_id, concept_id, y) - 1) / 2.0 AS ry FROM j),
g AS (SELECT request_id, concept_id, count(*) AS days, corr(x, y) AS pearson, corr(rx, ry) AS spearman, avg(abs(x - y)) AS mean_error, sqrt(avg((x - y) * (x - y))) AS root_error, avg(CAST((x = 0) = (y = 0) AS INT)) AS zero_agreement, max(x) AS first_peak, max(y) AS second_peak, first(date ORDER BY x DESC, date) AS first_peak_date, first(date ORDER BY y DESC, date) AS second_peak_date, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM k GROUP BY 1, 2)
SELECT request_id, concept_id, days, CASE WHEN sx > 1e-12 AND sy > 1e-12 THEN round(pearson, 6) END AS pearson, CASE WHEN sx > 1e-12 AND sy > 1e-12 THEN round(spearman, 6) END AS spearman, {_r('mean_error', 'root_error', 'zero_agreement', 'first_peak', 'second_peak')}, first_peak_date, second_peak_date, datediff('day', first_peak_date, second_peak_date) AS peak_displacement, first_peak_date = second_peak_date AS same_peak_date FROM g""",
    "content_hash": """SELECT count(*) AS rows, CAST(sum(p) AS VARCHAR) AS sum, CAST(bit_xor(p) AS VARCHAR) AS xor FROM (SELECT CAST('0x' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'), 1, 15) AS BIGINT) AS p FROM orders)""",
}
QUERIES = {f.__name__: f for f in (integrated, join_summary, orphan_rows, unmatched_counts, lineage_conflicts, request_summaries, group_summaries, family_summaries, paired_diagnostics, rank_agreement, exclusion_ledger, column_audit, metric_viability, group_coverage, repeat_coverage, readiness, final_metrics, event_units, complete_pairs, contrasts, final_sensitivity, readiness_counters, sample_flow, response_summary, event_curve, store_agreement, content_hash, ridge_model)}

"""Queries over daily series, and their SQL."""

from __future__ import annotations

from ..config import SHORT
from ..functions.expr import rounded
from ..operators import series as s
from .base import SQL, daily, plan

PH = list(SHORT.phases)


def phase_metrics(spark, d):
    return rounded(s.phase_metrics(daily(spark, d), plan(spark, d), SHORT))


def response_metrics(spark, d):
    return rounded(s.response_metrics(daily(spark, d), plan(spark, d), SHORT))


def series_runs(spark, d):
    return rounded(s.runs(daily(spark, d), plan(spark, d), SHORT))


def repeat_aggregate(spark, d):
    return rounded(s.repeat_aggregate(s.response_metrics(daily(spark, d), plan(spark, d), SHORT)))


def repeat_stability(spark, d):
    return rounded(s.repeat_stability(daily(spark, d), s.response_metrics(daily(spark, d), plan(spark, d), SHORT), SHORT))


def response_quality(spark, d):
    m = s.response_metrics(daily(spark, d), plan(spark, d), SHORT)
    return s.with_stability(m, s.repeat_stability(daily(spark, d), m, SHORT)).select(*s.KEYS, "quality")


def phase_stability(spark, d):
    return rounded(s.phase_stability(s.phase_metrics(daily(spark, d), plan(spark, d), SHORT), SHORT))


def phase_aggregate(spark, d):
    return rounded(s.phase_aggregate(s.phase_metrics(daily(spark, d), plan(spark, d), SHORT), SHORT))


PHASED = SQL + """,
phased AS (SELECT daily.*, onset, event_end, CASE WHEN date BETWEEN onset - 14 AND onset - 4 THEN 'baseline' WHEN date BETWEEN onset - 3 AND onset - 1 THEN 'anticipatory'
  WHEN date BETWEEN onset AND event_end THEN 'immediate' WHEN date BETWEEN event_end + 2 AND event_end + 4 THEN 'early' WHEN date BETWEEN event_end + 5 AND event_end + 9 THEN 'extended' END AS phase
  FROM daily JOIN plan USING (request_id))
"""
_agg = ", ".join(f"count(value) FILTER (phase = '{p}') AS {p}_days, avg(value) FILTER (phase = '{p}') AS {p}_mean, max(value) FILTER (phase = '{p}') AS {p}_max" for p in PH)
_lift = ", ".join(f"{p}_mean - baseline_mean AS {p}_lift, CASE WHEN baseline_sd > 0.001 THEN ({p}_mean - baseline_mean) / baseline_sd END AS {p}_standardized, CASE WHEN baseline_mad > 0.001 THEN ({p}_mean - baseline_median) / (1.4826 * baseline_mad) END AS {p}_robust" for p in PH)
_in = "phase IN ('anticipatory', 'immediate', 'early', 'extended')"
PHASE_SQL = PHASED + f""",
pm0 AS (SELECT request_id, repeat_id, concept_id, count(value) FILTER (phase = 'baseline') AS baseline_days, avg(value) FILTER (phase = 'baseline') AS baseline_mean,
  CASE WHEN count(value) FILTER (phase = 'baseline') >= 2 THEN stddev_pop(value) FILTER (phase = 'baseline') END AS baseline_sd, median(value) FILTER (phase = 'baseline') AS baseline_median,
  mad(value) FILTER (phase = 'baseline') AS baseline_mad, max(value) AS top, max(value) FILTER ({_in}) AS peak_value,
  first(date ORDER BY value DESC, date) FILTER ({_in}) AS peak_date, first(phase ORDER BY value DESC, date) FILTER ({_in}) AS peak_phase, {_agg} FROM phased GROUP BY 1, 2, 3),
pm1 AS (SELECT *, {_lift}, CASE WHEN baseline_sd > 0.001 THEN (peak_value - baseline_mean) / baseline_sd END AS peak_standardized FROM pm0),
pm AS (SELECT * EXCLUDE (top), (SELECT p FROM (VALUES {", ".join(f"('{p}', {p}_standardized)" for p in PH)}) v(p, x) WHERE x IS NOT NULL ORDER BY x DESC, p LIMIT 1) AS dominant_phase,
  CASE WHEN peak_value IS NULL AND baseline_days = 0 THEN 'missing' WHEN baseline_days < 5 THEN 'insufficient_baseline' WHEN NOT top > 0 THEN 'all_zero' ELSE 'usable' END AS quality FROM pm1)
"""


def rnd(sql: str, columns: list[str], keep: list[str]) -> str:
    return f"WITH {sql} SELECT {', '.join(keep)}, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM "


_phase_doubles = ["baseline_mean", "baseline_sd", "baseline_median", "baseline_mad", "peak_value", "peak_standardized", *[f"{p}_{c}" for p in PH for c in ("mean", "max", "lift", "standardized", "robust")]]
RESPONSE_SQL = SQL + """,
parts AS (SELECT daily.*, onset, CASE WHEN date BETWEEN onset - 14 AND onset - 1 THEN 'baseline' WHEN date BETWEEN onset AND event_end THEN 'event' WHEN date BETWEEN event_end + 1 AND event_end + 9 THEN 'post' END AS part
  FROM daily JOIN plan USING (request_id)),
rm0 AS (SELECT request_id, repeat_id, concept_id, onset, count(value) FILTER (part = 'baseline') AS baseline_days, count(value) FILTER (part = 'event') AS event_days, count(value) FILTER (part = 'post') AS post_days,
  avg(value) FILTER (part = 'baseline') AS baseline_mean, avg(value) FILTER (part = 'event') AS event_mean, avg(value) FILTER (part = 'post') AS post_mean,
  CASE WHEN count(value) FILTER (part = 'baseline') >= 2 THEN stddev_pop(value) FILTER (part = 'baseline') END AS baseline_sd, max(value) FILTER (part IN ('event', 'post')) AS peak_value,
  avg(CAST(value = 0 AS INT)) AS zero_share, median(value) FILTER (part = 'baseline') AS baseline_median, mad(value) FILTER (part = 'baseline') AS baseline_mad FROM parts GROUP BY 1, 2, 3, 4),
peaks AS (SELECT request_id, repeat_id, concept_id, min(date) FILTER (value = peak_value) AS peak_date, CASE WHEN any_value(baseline_mean) IS NOT NULL THEN coalesce(sum(greatest(value - baseline_mean, 0)) FILTER (part IN ('event', 'post')), 0) END AS excess_area
  FROM parts JOIN rm0 USING (request_id, repeat_id, concept_id) GROUP BY 1, 2, 3),
rm AS (SELECT * EXCLUDE (onset), peak_value - baseline_mean AS lift_absolute, CASE WHEN baseline_mean <> 0 THEN peak_value / baseline_mean END AS lift_ratio, CASE WHEN baseline_sd > 0 THEN (peak_value - baseline_mean) / baseline_sd END AS lift_z,
  CASE WHEN baseline_mad > 0 THEN (peak_value - baseline_median) / baseline_mad END AS lift_robust, datediff('day', onset, peak_date) AS days_to_peak,
  CASE WHEN zero_share = 1 THEN 'all_zero' WHEN baseline_days < 5 THEN 'insufficient_baseline' WHEN event_days + post_days < 3 THEN 'insufficient_post' WHEN zero_share >= 0.5 THEN 'low_volume' ELSE 'usable' END AS quality
  FROM rm0 JOIN peaks USING (request_id, repeat_id, concept_id))
"""
_K = ["request_id", "repeat_id", "concept_id"]
STABLE = """
each AS (SELECT request_id, concept_id, a.repeat_id, b.repeat_id, CASE WHEN count(*) >= 2 AND stddev_pop(a.value) > 1e-12 AND stddev_pop(b.value) > 1e-12 THEN corr(a.value, b.value) END AS r, max(abs(a.value - b.value)) AS d
  FROM daily a JOIN daily b USING (request_id, concept_id, date) WHERE a.repeat_id < b.repeat_id GROUP BY 1, 2, 3, 4),
c AS (SELECT request_id, concept_id, min(r) AS least_correlation, max(d) AS largest_difference FROM each GROUP BY 1, 2),
p AS (SELECT request_id, concept_id, count(*) AS repeats, datediff('day', min(peak_date), max(peak_date)) AS peak_date_range FROM rm GROUP BY 1, 2)
"""
ORACLE = {
    "phase_metrics": rnd(PHASE_SQL, _phase_doubles, [*_K, "baseline_days", "peak_date", "peak_phase", "dominant_phase", "quality", *[f"{p}_days" for p in PH]]) + "pm",
    "response_metrics": rnd(RESPONSE_SQL, ["baseline_mean", "event_mean", "post_mean", "baseline_sd", "peak_value", "zero_share", "baseline_median", "baseline_mad", "lift_absolute", "lift_ratio", "lift_z", "lift_robust", "excess_area"], [*_K, "baseline_days", "event_days", "post_days", "peak_date", "days_to_peak", "quality"]) + "rm",
    "series_runs": f"""WITH {PHASED},
x AS (SELECT *, avg(value) FILTER (phase = 'baseline') OVER k AS base, row_number() OVER o AS n, greatest(coalesce(lag(value) OVER o, 0), coalesce(lead(value) OVER o, 0), 1) AS near FROM phased
  WINDOW k AS (PARTITION BY request_id, repeat_id, concept_id), o AS (PARTITION BY request_id, repeat_id, concept_id ORDER BY date)),
y AS (SELECT *, value > base AS over_it, date - CAST(row_number() OVER (PARTITION BY request_id, repeat_id, concept_id, value > base ORDER BY date) AS INT) AS i1, n - row_number() OVER (PARTITION BY request_id, repeat_id, concept_id, value = 0 ORDER BY date) AS i2 FROM x),
r1 AS (SELECT request_id, repeat_id, concept_id, max(c) AS m FROM (SELECT request_id, repeat_id, concept_id, count(*) AS c FROM y WHERE over_it GROUP BY request_id, repeat_id, concept_id, i1) GROUP BY 1, 2, 3),
r2 AS (SELECT request_id, repeat_id, concept_id, max(c) AS m FROM (SELECT request_id, repeat_id, concept_id, count(*) AS c FROM y WHERE value = 0 GROUP BY request_id, repeat_id, concept_id, i2) GROUP BY 1, 2, 3)
SELECT request_id, repeat_id, concept_id, CAST(count(*) FILTER (value >= 5 * near) AS BIGINT) AS isolated_spikes, round(avg(CAST(value = 0 AS INT)), 6) AS zero_share, coalesce(any_value(r1.m), 0) AS longest_run, coalesce(any_value(r2.m), 0) AS longest_zero_run
FROM y LEFT JOIN r1 USING (request_id, repeat_id, concept_id) LEFT JOIN r2 USING (request_id, repeat_id, concept_id) GROUP BY 1, 2, 3""",
    "repeat_aggregate": f"""WITH {RESPONSE_SQL} SELECT request_id, concept_id, count(*) AS repeats, {', '.join(f"round(avg({c}), 6) AS {c}_mean, round(CASE WHEN count({c}) >= 2 THEN stddev_pop({c}) END, 6) AS {c}_sd" for c in ("lift_absolute", "lift_z", "lift_robust"))},
bool_and(quality = 'usable') AS all_usable, arg_min(peak_date, repeat_id) AS peak_date, arg_min(quality, repeat_id) AS quality, string_agg(DISTINCT repeat_id, ';' ORDER BY repeat_id) AS repeat_ids FROM rm GROUP BY 1, 2""",
    "repeat_stability": f"""WITH {RESPONSE_SQL}, {STABLE} SELECT request_id, concept_id, repeats, peak_date_range, round(least_correlation, 6) AS least_correlation, round(largest_difference, 6) AS largest_difference,
coalesce(repeats >= 2 AND least_correlation >= 0.8 AND peak_date_range <= 3, FALSE) AS stable FROM p LEFT JOIN c USING (request_id, concept_id)""",
    "response_quality": f"""WITH {RESPONSE_SQL}, {STABLE}, t AS (SELECT request_id, concept_id, repeats > 1 AND NOT coalesce(repeats >= 2 AND least_correlation >= 0.8 AND peak_date_range <= 3, FALSE) AS unstable FROM p LEFT JOIN c USING (request_id, concept_id))
SELECT request_id, repeat_id, concept_id, CASE WHEN quality = 'usable' AND unstable THEN 'usable_with_caution' ELSE quality END AS quality FROM rm JOIN t USING (request_id, concept_id)""",
    "phase_stability": f"""WITH {PHASE_SQL}, s AS (SELECT request_id, concept_id, count(*) AS repeats, {', '.join(f"CASE WHEN count({p}_standardized) >= 2 THEN stddev_pop({p}_standardized) END AS {p}_sd" for p in PH)}, count(DISTINCT coalesce(dominant_phase, 'None')) AS dominant_phases FROM pm GROUP BY 1, 2)
SELECT request_id, concept_id, repeats, dominant_phases, {', '.join(f"round({p}_sd, 6) AS {p}_sd" for p in PH)}, dominant_phases = 1 AS dominant_agrees,
CASE WHEN repeats < 2 THEN 'not_repeated' WHEN dominant_phases = 1 AND coalesce(greatest({', '.join(f"{p}_sd" for p in PH)}), 0) <= 1 THEN 'stable' ELSE 'unstable' END AS status FROM s""",
    "phase_aggregate": f"""WITH {PHASE_SQL}, s AS (SELECT request_id, concept_id, count(*) AS repeats, {', '.join(f"avg({c}) AS {c}" for c in ["baseline_mean", "baseline_sd", "peak_value", *[f"{p}_{c}" for p in PH for c in ("mean", "lift", "standardized", "robust")]])},
string_agg(DISTINCT CAST(peak_date AS VARCHAR), ';' ORDER BY CAST(peak_date AS VARCHAR)) AS pd, datediff('day', min(peak_date), max(peak_date)) AS peak_date_range, CASE WHEN count(DISTINCT quality) = 1 THEN min(quality) ELSE 'mixed' END AS quality FROM pm GROUP BY 1, 2)
SELECT request_id, concept_id, repeats, {', '.join(f"round({c}, 6) AS {c}" for c in ["baseline_mean", "baseline_sd", "peak_value", *[f"{p}_{c}" for p in PH for c in ("mean", "lift", "standardized", "robust")]])}, coalesce(pd, '') AS peak_dates, peak_date_range, quality, coalesce(peak_date_range = 0, FALSE) AS peak_dates_agree,
(SELECT p FROM (VALUES {", ".join(f"('{p}', {p}_standardized)" for p in PH)}) v(p, x) WHERE x IS NOT NULL ORDER BY x DESC, p LIMIT 1) AS dominant_phase FROM s""",
}
QUERIES = {f.__name__: f for f in (phase_metrics, response_metrics, series_runs, repeat_aggregate, repeat_stability, response_quality, phase_stability, phase_aggregate)}

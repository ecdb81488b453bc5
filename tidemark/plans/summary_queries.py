"""Queries over all metrics of responses and phases, and their SQL."""

from __future__ import annotations

from ..config import SHORT
from ..functions.expr import rounded
from ..operators import summaries as s
from .analysis_queries import _r, responses
from .base import SQL, plan
from .evidence_queries import families, phases
from .series_queries import PH, PHASE_SQL, RESPONSE_SQL


def _joined(spark, d):
    return s.joined(responses(spark, d), phases(spark, d), plan(spark, d), families(spark, d), SHORT)


def unit_summaries(spark, d):
    return rounded(s.unit_summaries(_joined(spark, d), s.described(SHORT)))


def metric_summaries(spark, d):
    return rounded(s.metric_summaries(s.unit_summaries(_joined(spark, d), s.described(SHORT))))


def metric_summaries_by_family(spark, d):
    return rounded(s.metric_summaries(s.unit_summaries(_joined(spark, d), s.described(SHORT)), ("family", "role")))


def repeat_pairs(spark, d):
    return rounded(s.repeat_pairs(_joined(spark, d), s.repeated(SHORT)))


_of = lambda x: "CASE dominant_phase " + " ".join(f"WHEN '{p}' THEN {p}_{x}" for p in PH) + " END"
_UNIT = "request_id, concept_id, episode_id, geography, family, role"


def _long(metrics: list[str]) -> str:
    columns = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in metrics)
    return f"u AS (FROM (SELECT {_UNIT}, repeat_id, {columns} FROM al) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(metrics)})))"


def _sql(metrics: list[str]) -> str:
    """Phases and responses side by side; both parts of the SQL begin with the tables of base.SQL, which are named once."""
    rest = RESPONSE_SQL[len(SQL) :]
    return f"""{PHASE_SQL}{rest},
fam AS (SELECT DISTINCT event_type AS concept_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'demand' WHEN event_type = 'view' THEN 'awareness' WHEN event_type = 'error' THEN 'nonflood' ELSE 'weather' END AS family FROM events),
al AS (SELECT rm.*, {", ".join(f"{p}_{x}" for p in PH for x in ("mean", "max", "lift", "standardized", "robust"))}, peak_standardized, {_of("standardized")} AS dominant_standardized, {_of("robust")} AS dominant_robust, episode_id, geography, role, family
  FROM rm JOIN (SELECT * FROM pm) x USING (request_id, repeat_id, concept_id) LEFT JOIN plan USING (request_id) LEFT JOIN fam USING (concept_id)),
{_long(metrics)}"""


_NUMBERS = ("repeat_mean", "repeat_median", "repeat_minimum", "repeat_maximum", "within_sd")
_UNITS = f"""us AS (SELECT {_UNIT}, metric, count(*) AS repeat_count, count(value) AS valid_repeat_count, count(*) - count(value) AS missing_count, CAST(0 AS BIGINT) AS not_finite_count, avg(value) AS repeat_mean, median(value) AS repeat_median,
  min(value) AS repeat_minimum, max(value) AS repeat_maximum, CASE WHEN count(value) > 1 THEN stddev_samp(value) END AS within_sd FROM u GROUP BY {_UNIT}, metric)"""
_v = "repeat_mean"
_COLUMNS = f"""CAST(sum(repeat_count) AS BIGINT) AS repeat_rows, CAST(sum(valid_repeat_count) AS BIGINT) AS valid_values, CAST(sum(missing_count) AS BIGINT) AS missing_values, CAST(sum(not_finite_count) AS BIGINT) AS not_finite_values, count(*) AS units, count({_v}) AS valid_units,
{", ".join(f"count(DISTINCT {c}) FILTER ({_v} IS NOT NULL) AS {n}" for c, n in (("request_id", "requests"), ("episode_id", "episodes"), ("geography", "geographies"), ("concept_id", "concepts")))},
round(min({_v}), 6) AS minimum, round(max({_v}), 6) AS maximum, round(avg({_v}), 6) AS mean, round(median({_v}), 6) AS median, round(CASE WHEN count({_v}) > 1 THEN stddev_samp({_v}) END, 6) AS sample_sd, round(quantile_cont({_v}, 0.25), 6) AS first_quartile, round(quantile_cont({_v}, 0.75), 6) AS third_quartile,
count(*) FILTER ({_v} = 0) AS zeros, count(*) FILTER ({_v} > 0) AS positive, count(*) FILTER ({_v} < 0) AS negative, round(quantile_cont({_v}, 0.75) - quantile_cont({_v}, 0.25), 6) AS interquartile_range"""
_D, _P = _sql(s.described(SHORT)), _sql(s.repeated(SHORT))
ORACLE = {
    "unit_summaries": f"WITH {_D}, {_UNITS} SELECT * REPLACE ({_r(*_NUMBERS)}) FROM us",
    "metric_summaries": f"WITH {_D}, {_UNITS} SELECT metric, {_COLUMNS} FROM us GROUP BY metric",
    "metric_summaries_by_family": f"WITH {_D}, {_UNITS} SELECT family, role, metric, {_COLUMNS} FROM us GROUP BY family, role, metric",
    "repeat_pairs": f"""WITH {_P}, p AS (SELECT {_UNIT}, metric, count(DISTINCT repeat_id) AS repeats, count(value) AS valid, min(repeat_id) AS a, max(repeat_id) AS b, arg_min_null(value, repeat_id) AS x, arg_max_null(value, repeat_id) AS y FROM u GROUP BY {_UNIT}, metric),
q AS (SELECT *, CASE WHEN repeats <> 2 THEN 'not_two_repeats' WHEN valid <> 2 THEN 'missing_value' END AS why FROM p)
SELECT {_UNIT}, metric, a AS first_repeat_id, CASE WHEN repeats > 1 THEN b END AS second_repeat_id, round(x, 6) AS first_value, round(CASE WHEN repeats > 1 THEN y END, 6) AS second_value, round(CASE WHEN why IS NULL THEN y - x END, 6) AS signed_difference,
round(CASE WHEN why IS NULL THEN abs(y - x) END, 6) AS absolute_difference, round(CASE WHEN why IS NULL THEN (x + y) / 2 END, 6) AS pair_mean, round(CASE WHEN why IS NULL THEN abs(y - x) / sqrt(2) END, 6) AS within_pair_sd,
round(CASE WHEN why IS NULL AND abs((x + y) / 2) > 1e-12 THEN abs(y - x) / abs((x + y) / 2) END, 6) AS relative_difference, coalesce(why IS NULL AND abs((x + y) / 2) > 1e-12, FALSE) AS relative_difference_eligible, why AS exclusion_reason FROM q""",
}
QUERIES = {f.__name__: f for f in (unit_summaries, metric_summaries, metric_summaries_by_family, repeat_pairs)}

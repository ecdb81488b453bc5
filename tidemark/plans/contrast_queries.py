"""Queries about event records and contrasts, over plans in which pairs, panels and controls differ from episode to episode, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import SHORT
from ..functions.expr import rounded
from ..operators import contrasts as c
from ..operators import finalize
from .analysis_queries import FINAL, _r
from .base import daily, plan

#: A month of events has values on few days, so that coverage asks for less.
SPARSE = replace(SHORT, phase_coverage=0.4)


def _metrics(spark, d):
    """Treated requests, one control of each, and for each third episode a second control in the panel of rarer concepts; some controls are of the treated's own geography."""
    m = finalize.final_metrics(daily(spark, d), plan(spark, d), SPARSE)
    e, i = F.substring("episode_id", 3, 20).cast("long"), F.substring("request_id", 2, 20).cast("long") % 5
    m = m.withColumn("panel", F.when(F.col("concept_id").isin("click", "view"), "p1").otherwise("p2"))
    m = m.where((i == 0) | (i == 2) | (i == 3) & (F.col("panel") == "p2") & (e % 3 == 0))
    m = m.withColumn("geography", F.when((i == 2) & (e % 7 == 5), "US-0").otherwise(F.col("geography"))).withColumn("pair_id", F.concat(F.lit("pair"), e))
    m = m.withColumn("backend", F.lit("csv")).withColumn("primary_unit", e % 4 > 0)
    return c.paired(m)


def event_records(spark, d):
    return rounded(c.event_records(_metrics(spark, d)))


def primary_contrasts(spark, d):
    return rounded(c.primary_contrasts(c.event_records(_metrics(spark, d))))


def contrast_rejections(spark, d):
    return c.contrast_rejections(c.event_records(_metrics(spark, d)))


def contrast_summary(spark, d):
    """For each concept: pairs of the main variant, and mean, least and largest contrast."""
    rows = c.primary_contrasts(c.event_records(_metrics(spark, d))).where("variant = 'main'")
    return rounded(rows.groupBy("concept_id").agg(F.count("*").alias("pairs"), *[f("lift_contrast").alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]))


_FIELDS = finalize.FIELDS
_SQL = FINAL.replace("0.8 * wd", "0.4 * wd") + f""",
mt AS (SELECT * REPLACE (CASE WHEN i = 2 AND e % 7 = 5 THEN 'US-0' ELSE geography END AS geography), 'pair' || e AS pair_id, 'csv' AS backend, e % 4 > 0 AS primary_unit
  FROM (SELECT *, CAST(episode_id[3:] AS INT) AS e, CAST(request_id[2:] AS INT) % 5 AS i, CASE WHEN concept_id IN ('click', 'view') THEN 'p1' ELSE 'p2' END AS panel FROM fe) WHERE i = 0 OR i = 2 OR i = 3 AND panel = 'p2' AND e % 3 = 0),
pd AS (SELECT *, bool_or(role = 'treated' AND eligible) OVER w AND bool_or(role = 'control' AND eligible) OVER w AS complete_pair FROM mt WINDOW w AS (PARTITION BY pair_id, panel, concept_id, variant, repeat_id)),
rc AS (SELECT episode_id, geography, concept_id, role, backend, panel, request_id, variant, min(pair_id) AS pair_id, bool_and(primary_unit) AS primary_unit, count(*) AS repeats, count(*) FILTER (eligible) AS repeat_count,
  count(*) FILTER (eligible) > 0 AS eligible, count(*) FILTER (eligible) = 2 AS complete_repeats, coalesce(bool_and(complete_pair) FILTER (eligible), FALSE) AS complete_pair,
  coalesce(string_agg(DISTINCT repeat_id, ';' ORDER BY repeat_id) FILTER (eligible), '') AS repeat_ids, CASE WHEN count(*) FILTER (eligible) > 0 THEN 'csv' ELSE '' END AS acquisition_backends,
  CASE WHEN count(*) FILTER (eligible) > 0 THEN '' ELSE array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ';'))))), ';') END AS reason,
  {", ".join(f"avg({f}) FILTER (eligible) AS {f}" for f in _FIELDS)}, CASE WHEN count(standardized) FILTER (eligible) >= 2 THEN stddev_pop(standardized) FILTER (eligible) END AS repeat_sd,
  '[' || string_agg('{{"repeat_id":"' || repeat_id || '"' || coalesce(',"peak_date":"' || CAST(peak_date AS VARCHAR) || '"', '') || '}}', ',' ORDER BY repeat_id) || ']' AS source_lineage FROM pd GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
ok AS (SELECT * FROM rc WHERE eligible AND primary_unit),
pc AS (SELECT t.pair_id, t.panel, t.concept_id, t.variant, t.episode_id, {", ".join(f"{s}.{x} AS {n}_{x}" for s, n in (("t", "treated"), ("c", "control")) for x in ("request_id", "geography", "lift", "standardized", "robust"))},
  {", ".join(f"t.{x} - c.{x} AS {x}_contrast" for x in ("lift", "standardized", "robust"))}
  FROM ok t JOIN ok c USING (pair_id, panel, concept_id, variant) WHERE t.role = 'treated' AND c.role = 'control' AND t.complete_pair AND c.complete_pair AND t.request_id <> c.request_id AND t.geography <> c.geography
  AND (SELECT count(*) FROM ok o WHERE o.pair_id = t.pair_id AND o.panel = t.panel AND o.concept_id = t.concept_id AND o.variant = t.variant) = 2)
"""
_NUMBERS = [f"{n}_{x}" for n in ("treated", "control") for x in ("lift", "standardized", "robust")] + [f"{x}_contrast" for x in ("lift", "standardized", "robust")]
ORACLE = {
    "event_records": f"WITH {_SQL} SELECT * REPLACE ({_r(*_FIELDS, 'repeat_sd')}) FROM rc",
    "primary_contrasts": f"WITH {_SQL} SELECT * REPLACE ({_r(*_NUMBERS)}) FROM pc",
    "contrast_rejections": f"""WITH {_SQL}, k AS (SELECT pair_id, panel, concept_id, variant, count(*) FILTER (role = 'treated' AND eligible) AS te, count(*) FILTER (role = 'control' AND eligible) AS ce,
  count(*) FILTER (role = 'treated' AND eligible AND primary_unit) AS t, count(*) FILTER (role = 'control' AND eligible AND primary_unit) AS c, bool_and(complete_pair) FILTER (eligible AND primary_unit) AS complete,
  count(DISTINCT geography) FILTER (eligible AND primary_unit) AS places FROM rc GROUP BY 1, 2, 3, 4)
SELECT CASE WHEN te = 0 THEN 'no_eligible_treated' WHEN ce = 0 THEN 'no_eligible_control' WHEN t = 0 OR c = 0 THEN 'not_primary' WHEN t > 1 OR c > 1 THEN 'several_of_a_role' WHEN NOT coalesce(complete, FALSE) THEN 'incomplete_pair' WHEN places < 2 THEN 'same_geography' END AS reason, count(*) AS pairs
FROM k GROUP BY 1 HAVING reason IS NOT NULL""",
    "contrast_summary": f"WITH {_SQL} SELECT concept_id, count(*) AS pairs, round(avg(lift_contrast), 6) AS mean, round(min(lift_contrast), 6) AS least, round(max(lift_contrast), 6) AS most FROM pc WHERE variant = 'main' GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (event_records, primary_contrasts, contrast_rejections, contrast_summary)}

"""Queries about samples, plans and imports, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import imports as m
from ..operators import sampling as p
from ..sources.tables import written
from .analysis_queries import responses
from .base import observations, plan, table
from .cohort_queries import CAT, cataloged
from .evidence_queries import families, roles
from .series_queries import RESPONSE_SQL


def strata(spark, d):
    dims = table(spark, d, "nation").select(F.col("n_nationkey").alias("state"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") % 2 == 0).alias("coastal"))
    return p.with_stratum(p.eligible(cataloged(spark, d)[0]), dims)


def sample_strata(spark, d):
    return strata(spark, d).select("episode_key", "season", "member_class", "footprint", "compact", "stratum", p.seeded("7", "episode_key").alias("h"))


def diverse_sample(spark, d):
    return p.diverse_sample(written(strata(spark, d), "strata"), "episode_key", F.year("episode_start"), 10, "7")


def _sampled(spark, d):
    """Episodes with what samples are drawn by, and the sample of ten a year."""
    rows = strata(spark, d).withColumn("id", F.col("episode_key").cast("string")).withColumn("year", F.year("episode_start")).withColumn("state", F.col("primary_state").cast("string")).withColumn("h", p.seeded("7", "episode_key"))
    rows = written(rows, "strata")
    return rows, p.diverse_sample(rows, "episode_key", F.col("year"), 10, "7").select("id", "selection_rank").join(rows, "id")


def required_swaps(spark, d):
    rows, sample = _sampled(spark, d)
    return p.with_required_states(sample, rows, ["9", "11"], 2, ("3", "4"), strict=False)


def nested_subsets(spark, d):
    _, sample = _sampled(spark, d)
    return p.nested_subsets(sample.withColumn("selection_rank", F.row_number().over(Window.orderBy("selection_rank", "id"))), [20, 10])


def mini_set(spark, d):
    """The home state is that of the sample's first row by id."""
    _, sample = _sampled(spark, d)
    return p.mini_set(sample, sample.agg(F.min_by("state", "id")).first()[0])


def subset_check(spark, d):
    s = nested_subsets(spark, d)
    return p.subset_check(s.where("in_10"), s.where("in_20"))


def request_plan(spark, d):
    e = written(p.request_window(p.geography(p.eligible(cataloged(spark, d)[0]))), "eligible")  # read once for each role of its rows
    controls = e.where("episode_key % 2 = 0").select("episode_key", ((F.col("primary_state") + 1) % 25).cast("string").alias("control_state"))
    panels = table(spark, d, "events").select(F.col("event_type").alias("panel")).distinct().where("panel < 'e'").withColumn("concept_ids", F.concat(F.col("panel"), F.lit(";view")))
    return p.request_plan(e.withColumn("primary_state", F.col("primary_state").cast("string")), controls, panels, 2)


def plan_rows(spark, d):
    return request_plan(spark, d).drop("request_id", "pair_id")


def plan_summary(spark, d):
    return p.plan_summary(request_plan(spark, d))


def plan_violations(spark, d):
    return p.plan_violations(request_plan(spark, d).where("not (episode_key % 10 = 0 and role = 'control' and planned_repeat_id = 'repeat_2')"), 2, 1)


def _split(spark, d):
    o = observations(spark, d).withColumn("k", F.col("event_id") % 10)
    one = o.groupBy("request_id", "repeat_id", "concept_id", "date").agg(F.min("interest").alias("interest"), F.bool_or("is_partial").alias("is_partial"), F.min("k").alias("k"))
    old = one.where("k < 6").drop("k")
    return old, one.where("k >= 4").withColumn("interest", F.when(F.col("k") == 5, 0.0).otherwise(F.col("interest"))).drop("k")


def import_merged(spark, d):
    return rounded(m.merged(*_split(spark, d)))


def import_conflicts(spark, d):
    return rounded(m.conflicts(*_split(spark, d)))


def import_checks(spark, d):
    return m.import_checks(observations(spark, d), plan(spark, d).where("request_id <> 'r3'"))


def export_profile(spark, d):
    o = observations(spark, d).withColumn("source_file", F.concat_ws("_", "request_id", "repeat_id"))
    return m.export_profile(o)


def parsed_values(spark, d):
    """Values written the ways that exports write them, read back; what came of them, by form."""
    k = F.col("event_id") % 8
    text = F.when(k == 0, "<1").when(k == 1, "").when(k == 2, "250").when(k == 3, "x").when(k == 4, F.concat(F.floor("interest").cast("string"), F.lit(" (partial)"))).when(k == 5, "N/A").when(k == 6, F.concat(F.floor("interest").cast("string"), F.lit("isPartial"))).otherwise(F.floor("interest").cast("string"))
    o = observations(spark, d).select(k.alias("form"), text.alias("t"), F.concat(F.col("date").cast("string"), F.lit(" - x")).alias("dt"))
    rows = o.select("form", *[c.alias(n) for n, c in m.parsed_interest(F.col("t")).items()], m.export_date(F.col("dt")).alias("date"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.sum("interest").cast("long").alias("total"), F.count("interest").alias("present"), F.sum(F.col("is_partial").cast("long")).alias("partial"), F.sum(F.col("low_volume").cast("long")).alias("low"), F.count("problem").alias("problems"), F.max("date").alias("last"))


def export_status(spark, d):
    e = table(spark, d, "events")
    keys = ["request_id", "repeat_id"]
    status = F.when(F.col("event_id") % 3 == 0, "failed").when(F.col("event_id") % 3 == 1, "exported").otherwise("imported")
    a = e.select(F.concat(F.lit("r"), F.col("user_id")).alias("request_id"), F.concat(F.lit("repeat_"), F.col("event_id") % 2 + 1).alias("repeat_id"), F.col("ts").alias("attempted_at"), F.col("event_id").alias("attempt_id"), status.alias("status"))
    wanted = e.select(F.concat(F.lit("r"), F.col("user_id")).alias("request_id"), F.explode(F.array(F.lit("repeat_1"), F.lit("repeat_2"))).alias("repeat_id"))
    return m.export_status(a, wanted, keys)


def source_differences(spark, d):
    old, _ = _split(spark, d)
    other = old.where("concept_id <> 'error' or request_id <> 'r1'").withColumn("interest", F.when((F.col("request_id") == "r2") & (F.col("concept_id") == "click"), F.col("interest") + 1).otherwise(F.col("interest")))
    return m.source_differences(old, other)


def term_feasibility(spark, d):
    season = plan(spark, d).select("request_id", F.when(F.col("request_id").isin("r0", "r1"), "a").otherwise("b").alias("season"))
    return rounded(m.term_feasibility(responses(spark, d), season))


def episode_feasibility(spark, d):
    return m.episode_feasibility(responses(spark, d), families(spark, d), roles(spark, d))


def broad_specific(spark, d):
    kinds = families(spark, d).select("concept_id")
    pairs = kinds.select(F.col("concept_id").alias("broad_id")).crossJoin(kinds.select(F.col("concept_id").alias("specific_id"))).where("broad_id = 'view' and specific_id <> 'view'")
    return rounded(m.broad_specific(responses(spark, d), pairs))


def top_rows(spark, d):
    return rounded(m.top_rows(responses(spark, d), {"lift": F.col("lift_absolute"), "z": F.col("lift_z"), "area": F.col("excess_area"), "flat": -F.col("baseline_sd")}))


def concept_violations(spark, d):
    kinds = families(spark, d).select("concept_id", F.when(F.col("concept_id") == "error", "").otherwise(F.col("concept_id")).alias("term"), "family", F.when(F.col("concept_id") == "click", "odd").otherwise("core").alias("tier"), (F.col("concept_id") == "view").alias("is_anchor"), F.col("concept_id").isin("view", "signup").alias("is_context"))
    panels = kinds.agg(F.array_join(F.array_sort(F.collect_list("concept_id")), ";").alias("concept_ids")).select(F.lit("core_1").alias("panel"), "concept_ids").unionByName(kinds.where("concept_id = 'click'").select(F.lit("extra").alias("panel"), F.lit("click;refund").alias("concept_ids")))
    return p.concept_violations(kinds, panels, ["core", "proxy"])


EL = CAT + """,
el AS (SELECT * FROM ca WHERE status IN ('retained', 'merge_candidate') AND duration_days <= 4 AND member_count <= 25 AND NOT crosses_split AND primary_state IS NOT NULL),
sx AS (SELECT episode_key, CASE WHEN month(episode_start) IN (12, 1, 2) THEN 'winter' WHEN month(episode_start) IN (3, 4, 5) THEN 'spring' WHEN month(episode_start) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, CASE WHEN member_count = 1 THEN 'singleton' ELSE 'multi_member' END AS member_class,
  CASE WHEN union_km2 <= 25 THEN 'small' ELSE 'moderate' END AS footprint, CASE WHEN union_km2 <= 10 THEN 'compact' ELSE 'spread' END AS compact, n_regionkey AS region, n_nationkey % 2 = 0 AS coastal, primary_state FROM el LEFT JOIN nation ON n_nationkey = primary_state),
pl AS (SELECT episode_key, role, geography, panel, panel || ';view' AS concept_ids, 'repeat_' || r AS planned_repeat_id, episode_start - 28 AS window_start, greatest(episode_end + 28, episode_start - 28 + 59) AS window_end
  FROM (SELECT *, 'treated' AS role, 'US-' || primary_state AS geography FROM el UNION ALL SELECT *, 'control', 'US-' || (primary_state + 1) % 25 FROM el WHERE episode_key % 2 = 0), (SELECT DISTINCT event_type AS panel FROM events WHERE event_type < 'e'), (VALUES (1), (2)) v(r))
"""
SP = RESPONSE_SQL + """,
so AS (SELECT request_id, repeat_id, concept_id, date, min(interest) AS interest, bool_or(is_partial) AS is_partial, min(event_id % 10) AS k FROM obs GROUP BY 1, 2, 3, 4),
od AS (SELECT * EXCLUDE (k) FROM so WHERE k < 6), nw AS (SELECT * EXCLUDE (k) REPLACE (CASE WHEN k = 5 THEN 0.0 ELSE interest END AS interest) FROM so WHERE k >= 4)
"""
_top = lambda n, s: f"(SELECT '{n}' AS selector, request_id, repeat_id, concept_id, round({s}, 6) AS score FROM rm WHERE {s} IS NOT NULL ORDER BY {s} DESC, request_id DESC, repeat_id DESC, concept_id DESC LIMIT 1)"
ORACLE = {
    "sample_strata": f"WITH {EL} SELECT episode_key, season, member_class, footprint, compact, concat_ws('|', season, coalesce(CAST(region AS VARCHAR), '?'), coalesce(CAST(primary_state AS VARCHAR), '?'), coalesce(CAST(coastal AS VARCHAR), '?'), member_class, footprint, compact) AS stratum, sha256('7:' || episode_key) AS h FROM sx",
    "plan_rows": f"WITH {EL} SELECT * FROM pl",
    "plan_summary": f"WITH {EL} SELECT role, count(*) AS rows, count(DISTINCT (episode_key, panel)) AS requests, count(DISTINCT episode_key) AS pairs, count(DISTINCT planned_repeat_id) AS repeats, count(DISTINCT panel) AS panels FROM pl GROUP BY 1",
    "plan_violations": f"WITH {EL} SELECT DISTINCT episode_key, 'incomplete_design' AS problem FROM pl WHERE episode_key % 10 = 0",
    "import_merged": f"WITH {SP} SELECT request_id, repeat_id, concept_id, date, round(interest, 6) AS interest, is_partial FROM od UNION ALL SELECT request_id, repeat_id, concept_id, date, round(interest, 6), is_partial FROM nw ANTI JOIN od USING (request_id, repeat_id, concept_id, date)",
    "import_conflicts": f"WITH {SP} SELECT request_id, repeat_id, concept_id, date, round(nw.interest, 6) AS interest, round(od.interest, 6) AS old_interest FROM nw JOIN od USING (request_id, repeat_id, concept_id, date) WHERE nw.interest IS DISTINCT FROM od.interest OR nw.is_partial IS DISTINCT FROM od.is_partial",
    "import_checks": f"WITH {SP} SELECT count(*) AS rows, count(*) FILTER (is_partial) AS partial, count(*) FILTER (interest IS NULL) AS missing, count(*) FILTER (NOT interest BETWEEN 0 AND 100) AS outside, (SELECT count(*) FROM (SELECT 1 FROM obs GROUP BY request_id, repeat_id, concept_id, date HAVING count(*) > 1)) AS repeated_identities, (SELECT count(DISTINCT request_id) FROM obs WHERE request_id = 'r3') AS unplanned_requests FROM obs",
    "export_profile": f"WITH {SP}, b AS (SELECT request_id || '_' || repeat_id AS source_file, concept_id, date, count(*) AS k, count(interest) AS v, count(*) FILTER (interest = 0) AS z, count(*) FILTER (is_partial) AS p FROM obs GROUP BY 1, 2, 3) SELECT source_file, CAST(sum(k) AS BIGINT) AS rows, CAST(sum(v) AS BIGINT) AS \"values\", CAST(sum(z) AS BIGINT) AS zeros, CAST(sum(p) AS BIGINT) AS partial, min(date) AS first, max(date) AS last, count(*) FILTER (k > 1) AS repeated_dates FROM b GROUP BY 1",
    "parsed_values": f"WITH {SP} SELECT event_id % 8 AS form, count(*) AS n, CAST(CASE WHEN event_id % 8 IN (1, 2, 3, 5) THEN NULL WHEN event_id % 8 = 0 THEN 0 ELSE sum(floor(interest)) END AS BIGINT) AS total, CASE WHEN event_id % 8 IN (1, 2, 3, 5) THEN 0 ELSE count(*) END AS present, CASE WHEN event_id % 8 IN (4, 6) THEN count(*) ELSE 0 END AS partial, CASE WHEN event_id % 8 = 0 THEN count(*) ELSE 0 END AS low, CASE WHEN event_id % 8 IN (2, 3) THEN count(*) ELSE 0 END AS problems, max(date) AS last FROM obs GROUP BY event_id % 8",
    "export_status": """WITH a AS (SELECT 'r' || user_id AS request_id, 'repeat_' || (event_id % 2 + 1) AS repeat_id, arg_max(CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'exported' ELSE 'imported' END, (ts, event_id)) AS status FROM events GROUP BY 1, 2),
p AS (SELECT DISTINCT 'r' || user_id AS request_id, unnest(['repeat_1', 'repeat_2']) AS repeat_id FROM events) SELECT coalesce(status, 'not_started') AS status, count(*) AS keys, coalesce(status, 'not_started') IN ('failed', 'not_started') AS retry FROM p LEFT JOIN a USING (request_id, repeat_id) GROUP BY coalesce(status, 'not_started')""",
    "source_differences": f"WITH {SP} SELECT request_id, repeat_id, concept_id, date, CASE WHEN concept_id = 'error' THEN 'not_in_source' ELSE 'value' END AS difference FROM od WHERE (concept_id = 'error' AND request_id = 'r1') OR (request_id = 'r2' AND concept_id = 'click' AND interest IS NOT NULL)",
    "term_feasibility": f"""WITH {RESPONSE_SQL}, x AS (SELECT *, CASE WHEN request_id IN ('r0', 'r1') THEN 'a' ELSE 'b' END AS season FROM rm), s AS (SELECT concept_id, stddev_pop(m) AS seasonal_sd, count(*) AS seasons FROM (SELECT concept_id, season, avg(baseline_mean) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT concept_id, count(*) AS series, avg(CAST(quality = 'usable' AS INT)) AS usable_share, median(lift_robust) AS median_lift, avg(baseline_days) AS coverage, avg(zero_share) AS zero_share FROM x GROUP BY 1)
SELECT concept_id, series, round(usable_share, 6) AS usable_share, round(median_lift, 6) AS median_lift, round(coverage, 6) AS coverage, round(zero_share, 6) AS zero_share, round(seasonal_sd, 6) AS seasonal_sd, seasons, CASE WHEN series = 0 THEN 'no_data' WHEN zero_share >= 0.9 THEN 'suppressed' WHEN usable_share = 0 THEN 'unusable' WHEN usable_share < 0.5 THEN 'sparse' WHEN median_lift IS NULL THEN 'flat' WHEN median_lift > 1 THEN 'responsive' ELSE 'stable' END AS feasibility FROM b JOIN s USING (concept_id)""",
    "episode_feasibility": f"""WITH {RESPONSE_SQL}, f AS (SELECT rm.*, CASE WHEN concept_id IN ('purchase', 'click') THEN 'demand' WHEN concept_id = 'view' THEN 'awareness' WHEN concept_id = 'error' THEN 'nonflood' ELSE 'weather' END AS family, role FROM rm JOIN plan USING (request_id))
SELECT request_id, role, count(*) AS series, count(*) FILTER (quality = 'usable') AS usable, {', '.join(f"first(concept_id ORDER BY lift_robust DESC, concept_id) FILTER (family = '{f}' AND lift_robust IS NOT NULL) AS best_{f}" for f in ('demand', 'awareness', 'weather'))},
CASE WHEN count(*) FILTER (quality = 'usable') = 0 THEN 'not_feasible' WHEN count(*) FILTER (quality = 'usable') < count(*) THEN 'partly_feasible' ELSE 'feasible' END AS status FROM f GROUP BY 1, 2""",
    "broad_specific": f"""WITH {RESPONSE_SQL} SELECT 'view' AS broad_id, s.concept_id AS specific_id, count(*) AS shared, round(avg(b.lift_absolute - s.lift_absolute), 6) AS mean_difference, CASE WHEN count(b.lift_absolute + s.lift_absolute) > 0 THEN count(*) FILTER (b.lift_absolute > s.lift_absolute) END AS broad_larger, count(*) FILTER (b.quality = 'usable' AND s.quality <> 'usable') AS only_broad_usable
FROM rm b JOIN rm s USING (request_id, repeat_id) WHERE b.concept_id = 'view' AND s.concept_id <> 'view' GROUP BY 2""",
    "top_rows": f"WITH {RESPONSE_SQL} {_top('lift', 'lift_absolute')} UNION ALL {_top('z', 'lift_z')} UNION ALL {_top('area', 'excess_area')} UNION ALL {_top('flat', '-baseline_sd')}",
    "concept_violations": "SELECT * FROM (VALUES ('missing_field', 'error'), ('unknown_tier', 'click'), ('anchor_and_context', 'view'), ('unknown_concept', 'refund'), ('panel_size', 'extra'), ('core_panels', 'core')) v(kind, id)",
}
QUERIES = {f.__name__: f for f in (sample_strata, diverse_sample, required_swaps, nested_subsets, mini_set, subset_check, plan_rows, plan_summary, plan_violations, import_merged, import_conflicts, import_checks, export_profile, parsed_values, export_status, source_differences, term_feasibility, episode_feasibility, broad_specific, top_rows, concept_violations)}

"""Queries about source quality, the cohort and the catalog, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import catalog as c
from ..operators import cohort as h
from ..operators import episodes as ep
from ..operators import quality as q
from ..sources.tables import written
from .base import table
from .space_queries import MEMBERS, all_members, episode_members, footprints, parted, reviewed

SIGN = ["l_suppkey", "l_shipdate", "l_quantity"]


def duplicate_profile(spark, d):
    return q.duplicate_profile(table(spark, d, "lineitem"), "l_partkey", SIGN)


def duplicate_policy(spark, d):
    """Outcomes under all four policies; some rows count as rejected and as invalid before duplicates are looked at."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_partkey", *SIGN, k.alias("source_row_index"), F.when(F.col("l_quantity") > 48, "null_start").otherwise("").alias("reject_reason"), F.when(F.col("l_linenumber") == 7, "invalid_geometry").alias("quarantine_reason"))
    flagged = q.with_duplicates(rows, "l_partkey", SIGN, "source_row_index")
    out = None
    for policy in q.DUPLICATE_POLICIES:
        one = q.accounting(q.outcome(flagged, policy, "source_row_index")).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


def record_validation(spark, d):
    """Footprints with ids in several spellings, some broken, through validation; counts of what came of them."""
    e = footprints(spark, d)
    hex_ = F.md5(F.col("event_id").cast("string"))
    k = F.col("event_id")
    uuid = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.concat(F.lit("{"), hex_, F.lit("}"))).when(k % 7 == 2, F.lit("no-uuid")).otherwise(hex_)
    start = F.when(k % 11 == 0, F.lit("2023")).when(k % 11 == 1, F.lit(None)).otherwise(F.col("start").cast("string"))
    rows = q.validated(e.select(uuid.alias("uuid"), start.alias("start_date"), F.col("end").cast("string").alias("end_date"), F.lit(None).cast("double").alias("area_km2"), "geometry", "geometry_type", "is_empty", "is_valid", "minx", "miny", "maxx", "maxy"))
    return rows.groupBy("reject_reason").agg(F.count("*").alias("n"), F.sum(F.col("quarantine_reason").isNotNull().cast("long")).alias("quarantined"), F.max("duration_days").alias("longest"), F.sum(F.col("antimeridian_review").cast("long")).alias("reviewed"))


def table_profile(spark, d):
    return rounded(q.table_profile(footprints(spark, d), "area_km2_shape", "start", "end"))


def start_histogram(spark, d):
    return q.histogram(footprints(spark, d), F.date_format("start", "yyyy-MM"), "month")


def field_quality(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") < 10, None).otherwise(F.col("l_quantity")).alias("quantity"), F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_returnflag")).alias("flag"))
    return rounded(q.null_shares(t))


def cohort(spark, d):
    """Orders as events: nations are states, regions domains (Africa and Asia primary, Europe secondary)."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    start = F.when(k % 41 > 0, F.to_date("o_orderdate"))
    e = o.select(k.alias("event_id"), F.when(k % 13 > 0, F.col("c_nationkey").cast("string")).alias("primary_state"), start.alias("start"), F.when(k % 17 > 0, F.date_add(F.to_date("o_orderdate"), (k % 9 - 1).cast("int"))).alias("end"), (k % 29 == 0).alias("review"))
    bridge = e.where("event_id % 5 = 0 and primary_state is not null").select("event_id", F.explode(F.array(F.col("primary_state"), ((F.col("primary_state").cast("int") + 1) % 25).cast("string"))).alias("state"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("state"), F.col("r_name").alias("domain"))
    rows = h.classified(h.with_domain(h.states_of(e, bridge), n), ["AFRICA", "ASIA"], ["EUROPE", "multi_domain"], "1993-01-01", "1997-12-31")
    return rows.withColumn("split", h.split_of(F.col("start"), [("development", "1992-01-01", "1995-12-31"), ("validation", "1996-01-01", "1996-12-31"), ("test", "1997-01-01", "1998-12-31")])).withColumn("year_split", h.year_split(F.col("start")))


def cohort_status(spark, d):
    return cohort(spark, d).select("event_id", "primary_state", F.array_join("state_set", ";").alias("states"), "study_domain", "primary_reason", "other_reasons", "cohort_status", "split", "year_split")


def exclusion_counts(spark, d):
    return h.exclusion_counts(cohort(spark, d))


def state_year_counts(spark, d):
    return h.state_year_counts(cohort(spark, d))


def temporal_quality(spark, d):
    return h.temporal_quality(cohort(spark, d))


def monthly_counts(spark, d):
    return h.monthly_counts(cohort(spark, d))


def cataloged(spark, d):
    """The catalog and the members of the two policies that it looks at."""
    policies, rules, boundary = ("conservative", "balanced"), c.CatalogRules(), "2024-01-01"
    edges, linked, members, alone = parted(spark, d, policies)
    episodes = written(reviewed(ep.rollup(members, linked, edges), ep.spans(members, linked)), "episodes")  # both policies' episodes are looked at
    catalog = c.assemble(episodes, members, ep.union_areas(members.where("policy = 'conservative'"), linked), rules, boundary)
    single = c.assemble_lone(reviewed(ep.lone_episodes(alone, ["conservative"]), None).withColumnRenamed("area_km2_shape", "union_km2"), rules, boundary)
    return catalog.unionByName(single), all_members(members, alone, policies)


def catalog_rows(spark, d):
    return rounded(cataloged(spark, d)[0])


def catalog_review(spark, d):
    return c.review_rows(cataloged(spark, d)[0]).drop("review_id")


def catalog_decisions(spark, d):
    return c.initial_decisions(cataloged(spark, d)[0]).drop("decision_id")


def catalog_summary(spark, d):
    return c.summary(cataloged(spark, d)[0])


def catalog_counters(spark, d):
    return c.counters(cataloged(spark, d)[0])


def catalog_validation(spark, d):
    catalog, members = cataloged(spark, d)
    return c.validation(written(catalog, "catalog"), members)  # every check reads it


def _decided(spark, d):
    """Decisions derived from the episodes: pairs are split apart, every seventh single episode is merged with the next, some are faulty."""
    m = episode_members(spark, d).where("policy = 'conservative'").select("event_id", F.col("component").alias("episode_key")).withColumn("split", F.when(F.col("event_id") % 3 == 0, "test").otherwise("development"))
    by = m.groupBy("episode_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    groups = F.when(F.col("n") > 1, F.array_join(F.transform("ids", lambda i: i.cast("string")), "|"))
    action = F.when(F.col("n") > 1, "split").when(F.col("episode_key") % 7 == 0, "merge").otherwise("retain")
    dec = by.select("episode_key", action.alias("action"), groups.alias("groups"), F.when(F.col("episode_key") % 7 == 0, (F.col("episode_key") + 5).cast("string")).alias("merge_with"), (F.col("episode_key") % 2 == 0).alias("cross_split_override"))
    return dec, m


def decision_violations(spark, d):
    return c.decision_violations(*_decided(spark, d))


def applied_decisions(spark, d):
    dec, m = _decided(spark, d)
    return c.apply_decisions(dec.where("action = 'split'"), m).groupBy("episode_key").agg(F.count_distinct("new_id").alias("new_episodes"), F.count("*").alias("members"))


CO = """
ev AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 13 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS primary_state, CASE WHEN o_orderkey % 41 > 0 THEN CAST(o_orderdate AS DATE) END AS start, CASE WHEN o_orderkey % 17 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 1 AS INT) END AS "end", o_orderkey % 29 = 0 AS review FROM orders JOIN customer ON o_custkey = c_custkey),
es AS (SELECT event_id, primary_state AS state FROM ev WHERE primary_state IS NOT NULL UNION SELECT event_id, CAST((CAST(primary_state AS INT) + 1) % 25 AS VARCHAR) FROM ev WHERE primary_state IS NOT NULL AND event_id % 5 = 0),
dm AS (SELECT event_id, string_agg(state, ';' ORDER BY state) AS states, count(DISTINCT r_name) AS nd, min(r_name) AS d FROM es JOIN nation ON CAST(n_nationkey AS VARCHAR) = state JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
c0 AS (SELECT ev.*, coalesce(states, '') AS states, CASE WHEN nd IS NULL THEN 'unclassified' WHEN nd = 1 THEN d ELSE 'multi_domain' END AS study_domain FROM ev LEFT JOIN dm USING (event_id)),
c1 AS (SELECT *, list_filter([CASE WHEN states <> '' AND study_domain NOT IN ('AFRICA', 'ASIA', 'EUROPE', 'multi_domain') THEN 'outside_domain' END, CASE WHEN start IS NULL THEN 'missing_start' END, CASE WHEN start NOT BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' THEN 'outside_window' END,
  CASE WHEN "end" < start THEN 'negative_duration' END, CASE WHEN states = '' THEN 'no_state' END, CASE WHEN review THEN 'review_required' END], lambda x: x IS NOT NULL) AS why FROM c0),
co AS (SELECT *, why[1] AS primary_reason, array_to_string(why[2:], ';') AS other_reasons, CASE WHEN len(why) > 0 THEN 'excluded' WHEN study_domain IN ('AFRICA', 'ASIA') THEN 'eligible' ELSE 'secondary_domain' END AS cohort_status,
  CASE WHEN start BETWEEN DATE '1992-01-01' AND DATE '1995-12-31' THEN 'development' WHEN start BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN 'validation' WHEN start BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN 'test' END AS split, CASE WHEN year(start) <= 2023 THEN 'development' WHEN year(start) = 2024 THEN 'validation' ELSE 'test' END AS year_split FROM c1)
"""
CAT = MEMBERS + """,
bo AS (SELECT a.event_id, a.component, b.component AS wc FROM me a JOIN me b USING (event_id) WHERE a.policy = 'conservative' AND b.policy = 'balanced'),
sh AS (SELECT wc, count(DISTINCT component) AS base_episodes FROM bo GROUP BY 1),
nr AS (SELECT component, max(base_episodes) AS wider_base_episodes, count(DISTINCT wc) AS wider_components FROM bo JOIN sh USING (wc) GROUP BY 1),
wx AS (SELECT component AS wc, episode_start < DATE '2024-01-01' AND episode_end >= DATE '2024-01-01' AS x FROM ru WHERE policy = 'balanced'),
cx AS (SELECT component, bool_or(x) AS wider_crosses_split FROM bo JOIN wx USING (wc) GROUP BY 1),
k0 AS (SELECT component AS episode_key, episode_id, episode_start, episode_end, duration_days, member_count, primary_state, state_count, edge_count, diagonal_km, largest_distance_km, union_km2, wider_base_episodes, wider_components, wider_crosses_split, episode_start < DATE '2024-01-01' AND episode_end >= DATE '2024-01-01' AS crosses_split,
  concat_ws(';', CASE WHEN edge_count > 0 AND member_count > 2 THEN 'bridge' END, CASE WHEN duration_days > 3 THEN 'long_duration' END, CASE WHEN member_count > 4 THEN 'many_members' END, CASE WHEN state_count > 2 THEN 'many_states' END, CASE WHEN largest_distance_km > 15 THEN 'member_distance' END, CASE WHEN wider_base_episodes > 1 THEN 'merge_candidate' END,
  CASE WHEN wider_crosses_split OR episode_start < DATE '2024-01-01' AND episode_end >= DATE '2024-01-01' THEN 'split_boundary' END, CASE WHEN diagonal_km > 20 THEN 'wide' END) AS reasons FROM ru JOIN nr USING (component) JOIN cx USING (component) JOIN ar USING (policy, component) WHERE policy = 'conservative'),
ca AS (SELECT *, CASE WHEN wider_base_episodes > 1 AND NOT wider_crosses_split THEN 'merge_candidate' WHEN wider_crosses_split THEN 'split_candidate' WHEN reasons <> '' THEN 'manual_review' ELSE 'retained' END AS status,
  CASE WHEN member_count >= 3 THEN 'strong' WHEN member_count = 2 THEN 'moderate' ELSE 'single' END AS strength FROM k0),
rv AS (SELECT episode_key, r AS reason, coalesce(t.ty, 'other') AS ty, coalesce(t.p, 10) AS p FROM (SELECT episode_key, unnest(string_split(reasons, ';')) AS r FROM ca WHERE reasons <> '') LEFT JOIN (VALUES ('merge_candidate', 'merge', 1), ('long_duration', 'split', 2), ('many_members', 'split', 3), ('wide', 'geometry', 4), ('bridge', 'split', 5), ('split_boundary', 'split_boundary', 6), ('member_distance', 'geometry', 7), ('many_states', 'split', 8)) t(reason, ty, p) ON t.reason = r)
"""
_POL = "SELECT '{p}' AS policy, count(*) AS source, count(*) FILTER (o = 'accepted') AS accepted, count(*) FILTER (o = 'quarantined') AS quarantined, count(*) FILTER (o = 'rejected') AS rejected, TRUE AS balanced FROM (SELECT CASE WHEN l_quantity > 48 THEN 'rejected' WHEN l_linenumber = 7 THEN 'quarantined' WHEN n > 1 AND NOT ({stay}) THEN '{lost}' ELSE 'accepted' END AS o FROM dp)"
ORACLE = {
    "duplicate_profile": "WITH g AS (SELECT l_partkey, count(*) AS n, count(DISTINCT (l_suppkey, l_shipdate, l_quantity)) AS kinds, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_shipdate) AS b, count(DISTINCT l_quantity) AS c FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, CAST(coalesce(sum(n - kinds), 0) AS BIGINT) AS exact_copies, count(*) FILTER (kinds > 1) AS conflicting_groups, count(*) FILTER (a > 1) AS conflicts_l_suppkey, count(*) FILTER (b > 1) AS conflicts_l_shipdate, count(*) FILTER (c > 1) AS conflicts_l_quantity FROM g",
    "duplicate_policy": "WITH dp AS (SELECT *, l_orderkey * 10 + l_linenumber AS i, count(*) OVER (PARTITION BY l_partkey) AS n, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey) AS lo, max(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey) AS hi FROM lineitem) " + " UNION ALL ".join(_POL.format(p=p, stay=s, lost=l) for p, s, l in (("quarantine", "FALSE", "quarantined"), ("keep-first", "i = lo", "quarantined"), ("keep-last", "i = hi", "quarantined"), ("reject-all", "FALSE", "rejected"))),
    "record_validation": f"WITH {MEMBERS}, k AS (SELECT *, event_id AS k FROM fp), v AS (SELECT concat_ws(';', CASE WHEN k % 7 = 0 THEN 'null_uuid' END, CASE WHEN k % 7 = 2 THEN 'malformed_uuid' END, CASE WHEN k % 11 = 1 THEN 'null_start' END, CASE WHEN k % 11 = 0 THEN 'malformed_start' END) AS reject_reason, CASE WHEN k % 11 > 1 THEN datediff('day', s, raw_e) END AS dd, x, w FROM k) SELECT reject_reason, count(*) AS n, CAST(0 AS BIGINT) AS quarantined, max(dd) AS longest, count(*) FILTER (x <= -179 OR x + w >= 179 OR w > 180) AS reviewed FROM v GROUP BY 1",
    "table_profile": f"WITH {MEMBERS} SELECT count(*) AS rows, round(min(w * w / 1e6), 6) AS least_area, round(max(w * w / 1e6), 6) AS largest_area, round(avg(w * w / 1e6), 6) AS mean_area, min(s) AS first_start, max(s) AS last_start, count(*) FILTER (raw_e IS NULL) AS null_ends, count(*) FILTER (raw_e < s) AS negative_durations FROM fp",
    "start_histogram": f"WITH {MEMBERS} SELECT strftime(s, '%Y-%m') AS month, count(*) AS n FROM fp GROUP BY 1",
    "field_quality": "SELECT 'l_orderkey' AS field, 0.0 AS null_percent UNION ALL SELECT 'quantity', round((SELECT avg(CAST(l_quantity < 10 AS INT)) * 100 FROM lineitem), 6) UNION ALL SELECT 'flag', round((SELECT avg(CAST(l_returnflag = 'R' AS INT)) * 100 FROM lineitem), 6)",
    "cohort_status": f"WITH {CO} SELECT event_id, primary_state, states, study_domain, primary_reason, other_reasons, cohort_status, split, year_split FROM co",
    "exclusion_counts": f"WITH {CO} SELECT 'primary' AS role, primary_reason AS reason, count(*) AS events FROM co WHERE primary_reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'secondary', r, count(*) FROM (SELECT unnest(why[2:]) AS r FROM co) GROUP BY 2",
    "state_year_counts": f"WITH {CO} SELECT primary_state, year(start) AS year, split, cohort_status, study_domain, primary_reason, count(*) AS events FROM co GROUP BY ALL",
    "temporal_quality": f"""WITH {CO}, s AS (SELECT 'all' AS scope, start, "end", datediff('day', start, "end") AS days FROM co UNION ALL SELECT 'eligible', start, "end", datediff('day', start, "end") FROM co WHERE cohort_status = 'eligible')
SELECT scope, count(*) AS events, count(*) FILTER ("end" IS NULL) AS missing_end, coalesce(count(*) FILTER (days < 0), 0) AS negative, count(*) FILTER (days = 0) AS same_day, count(*) FILTER (days > 1) AS over_1, count(*) FILTER (days > 3) AS over_3, count(*) FILTER (days > 7) AS over_7, count(*) FILTER (days > 30) AS over_30,
quantile_disc(days, 0.5) FILTER (days >= 0) AS p50, quantile_disc(days, 0.9) FILTER (days >= 0) AS p90, quantile_disc(days, 0.95) FILTER (days >= 0) AS p95, quantile_disc(days, 0.99) FILTER (days >= 0) AS p99 FROM s GROUP BY 1""",
    "monthly_counts": f"WITH {CO} SELECT strftime(start, '%Y-%m') AS month, count(*) AS events, count(*) FILTER (cohort_status = 'eligible') AS eligible FROM co GROUP BY 1",
    "catalog_rows": f"WITH {CAT} SELECT * REPLACE (round(diagonal_km, 6) AS diagonal_km, round(largest_distance_km, 6) AS largest_distance_km, round(union_km2, 6) AS union_km2) FROM ca",
    "catalog_review": f"WITH {CAT} SELECT episode_key, first(ty ORDER BY p) AS review_type, min(p) AS priority, count(*) AS reason_count, CASE first(ty ORDER BY p) WHEN 'merge' THEN 'compare_with_neighbours' WHEN 'split' THEN 'check_members' ELSE 'look_at_map' END AS action FROM rv GROUP BY 1",
    "catalog_decisions": f"WITH {CAT} SELECT episode_key, CASE WHEN status = 'retained' THEN 'retain' ELSE 'review_pending' END AS decision, CASE WHEN status = 'retained' THEN 'rule_based' ELSE 'deferred' END AS basis FROM ca",
    "catalog_summary": f"WITH {CAT} SELECT count(*) AS episodes, CAST(sum(member_count) AS BIGINT) AS members, {', '.join(chr(10) + f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in ('retained', 'merge_candidate', 'split_candidate', 'manual_review'))}, count(*) FILTER (crosses_split) AS crossing, count(*) FILTER (member_count = 1) AS singletons FROM ca",
    "catalog_counters": f"""WITH {CAT} SELECT counter, value, status, count(*) AS episodes FROM (SELECT 'year' AS counter, CAST(year(episode_start) AS VARCHAR) AS value, '' AS status FROM ca UNION ALL SELECT 'state', CAST(primary_state AS VARCHAR), '' FROM ca UNION ALL SELECT 'size', CASE WHEN member_count = 1 THEN '1' WHEN member_count <= 5 THEN '2-5' WHEN member_count <= 25 THEN '6-25' WHEN member_count <= 100 THEN '26-100' ELSE '101+' END, '' FROM ca
UNION ALL SELECT 'strength', strength, '' FROM ca UNION ALL SELECT 'reason', unnest(string_split(reasons, ';')), status FROM ca WHERE reasons <> '') GROUP BY 1, 2, 3""",
    "catalog_validation": f"WITH {CAT} SELECT unnest(['event_in_one_episode', 'episode_once', 'members_match', 'ids_recomputed', 'no_lost_episode', 'dates_in_order', 'status_known', 'reasons_fit_status']) AS \"check\", CAST(0 AS BIGINT) AS violations",
    "decision_violations": f"""WITH {CAT}, m AS (SELECT event_id, component AS k, CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'development' END AS sp FROM me WHERE policy = 'conservative'), b AS (SELECT k, count(*) AS n, min(sp) AS sp FROM m GROUP BY 1), mg AS (SELECT k, k + 5 AS o, sp, k % 2 = 0 AS ov FROM b WHERE n = 1 AND k % 7 = 0)
SELECT DISTINCT k AS episode_key, 'unknown_merge_source' AS problem FROM mg ANTI JOIN (SELECT k AS o FROM b) USING (o) UNION ALL SELECT DISTINCT mg.k, 'crosses_split' FROM mg JOIN b ON b.k = mg.o WHERE mg.sp <> b.sp AND NOT ov""",
    "applied_decisions": f"WITH {CAT} SELECT component AS episode_key, CASE WHEN count(*) > 1 THEN count(*) ELSE 1 END AS new_episodes, count(*) AS members FROM me WHERE policy = 'conservative' GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (duplicate_profile, duplicate_policy, record_validation, table_profile, start_histogram, field_quality, cohort_status, exclusion_counts, state_year_counts, temporal_quality, monthly_counts, catalog_rows, catalog_review, catalog_decisions, catalog_summary, catalog_counters, catalog_validation, decision_violations, applied_decisions)}

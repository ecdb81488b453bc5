"""Queries about evidence and provenance of episodes that orders make, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as p
from ..sources.tables import written
from .base import table

VERSION = "v2"


def _inputs(spark, d):
    """Four orders make a base episode, ten a wider one, so that some base episodes lie in two; neighbours of an episode are joined by an edge."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("start"), F.col("o_custkey").alias("c"))
    k = F.col("event_id")
    events = o.select("event_id", "start", F.when(k % 5 > 0, F.date_add("start", (k % 3).cast("int"))).alias("end"), F.transform(F.array(F.col("c") % 25, F.when(k % 4 == 0, F.col("c") % 7)), lambda s: s.cast("string")).alias("states"))
    events = events.withColumn("states", F.array_distinct(F.array_compact("states")))
    ids = o.select("event_id")
    members = ids.select(F.lit("conservative").alias("policy"), "event_id", F.floor(k / 4).alias("component")).unionByName(ids.select(F.lit("balanced").alias("policy"), "event_id", F.floor(k / 10).alias("component")))
    rule = F.when(k % 3 == 0, "contact").when(k % 3 == 1, "overlap").otherwise("near")
    edges = ids.where(k % 4 < 3).select(F.lit("conservative").alias("policy"), k.alias("a"), (k + 1).alias("b"), rule.alias("rule"))
    split = F.when(F.col("episode_start") < "1996-01-01", "development").when(F.col("episode_start") < "1997-01-01", "validation").otherwise("test")
    episodes = written(p.base_episodes(members, events, edges, VERSION, split), "episodes")
    return episodes, members


def episode_evidence(spark, d):
    return p.evidence(*_inputs(spark, d)).drop("episode_id")


def episode_membership(spark, d):
    episodes, members = _inputs(spark, d)
    why = F.when(F.col("state_count") > 2, "many_states").otherwise("")
    return p.membership(episodes, members, why)


def catalog_integrity(spark, d):
    """The eight checks over a catalog with faults of each kind; faulty rows are told by their keys."""
    episodes, members = _inputs(spark, d)
    k, e = F.col("source_episode"), F.col("event_id")
    mine = written(p.membership(episodes, members, F.lit("")), "membership")
    catalog = episodes.where(F.col("episode_key") % 71 != 5).select(F.when(F.col("episode_key") % 73 == 6, F.concat("episode_id", F.lit("x"))).otherwise(F.col("episode_id")).alias("episode_id"), F.when(F.col("episode_key") % 83 != 8, F.col("episode_key")).alias("source_episode"), (F.col("episode_key") % 79 != 7).alias("geometry_valid"))
    renamed = F.when(k % 73 == 6, F.concat("episode_id", F.lit("x"))).otherwise(F.col("episode_id")).alias("episode_id")
    rows = mine.select(renamed, "event_id", F.when(e % 67 != 4, k).alias("source_episode"), F.when(e % 61 == 3, "none").otherwise(F.col("split")).alias("split"))
    rows = rows.unionByName(rows.where(e % 101 == 0))
    ids = episodes.where(F.col("episode_key") % 71 != 5).select(F.when(F.col("episode_key") % 73 == 6, F.concat("episode_id", F.lit("x"))).otherwise(F.col("episode_id")).alias("episode_id"), "episode_key", "split")
    evidence = ids.where("episode_key % 53 <> 1").unionByName(ids.where("episode_key % 59 = 2")).select("episode_id")
    splits = ids.where("episode_key % 47 <> 9").select("episode_id", "split")
    return p.checks(catalog, rows, splits, evidence, VERSION)


_SQL = """
o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, o_custkey AS c FROM orders),
ev AS (SELECT k, k // 4 AS e, k // 10 AS w, s, CASE WHEN k % 5 > 0 THEN s + CAST(k % 3 AS INT) END AS t, unnest(CASE WHEN k % 4 = 0 THEN [c % 25, c % 7] ELSE [c % 25] END) AS st FROM o),
ep AS (SELECT e, count(DISTINCT k) AS n, min(s) AS a, max(coalesce(t, s)) AS b, count(DISTINCT st) AS states FROM ev GROUP BY 1),
dg AS (SELECT e, 'ep_' || substr(sha256('v2:' || count(*) || ':' || sum(p) || ':' || bit_xor(p)), 1, 16) AS id FROM (SELECT k // 4 AS e, ('0x' || substr(sha256(CAST(k AS VARCHAR)), 1, 15))::BIGINT AS p FROM o) GROUP BY 1),
ed AS (SELECT k // 4 AS e, count(*) AS edges, string_agg(DISTINCT CASE k % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'overlap' ELSE 'near' END, ';' ORDER BY CASE k % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'overlap' ELSE 'near' END) AS rules FROM o WHERE k % 4 < 3 GROUP BY 1),
es AS (SELECT ep.*, id, coalesce(edges, 0) AS edges, coalesce(rules, '') AS rules, CASE WHEN a < DATE '1996-01-01' THEN 'development' WHEN a < DATE '1997-01-01' THEN 'validation' ELSE 'test' END AS split FROM ep JOIN dg USING (e) LEFT JOIN ed USING (e)),
li AS (SELECT DISTINCT k // 4 AS e, k // 10 AS w FROM o)
"""
ORACLE = {
    "episode_evidence": f"""WITH {_SQL}, pr AS (SELECT DISTINCT x.e, y.e AS other FROM li x JOIN li y USING (w))
SELECT e AS episode_key, (SELECT string_agg(w, ';' ORDER BY w) FROM li WHERE li.e = es.e) AS related_wider, n AS member_count, datediff('day', a, b) + 1 AS duration_days, states AS state_count, edges AS edge_count, rules AS edge_rules,
q.c > 1 AS wider_merges_several, q.c AS wider_source_count, q.m AS wider_member_count, q.x AS wider_crosses_split
FROM es JOIN (SELECT pr.e, count(*) AS c, CAST(sum(z.n) AS BIGINT) AS m, count(DISTINCT z.split) > 1 AS x FROM pr JOIN es z ON z.e = pr.other GROUP BY 1) q USING (e)""",
    "episode_membership": f"WITH {_SQL} SELECT id AS episode_id, k AS event_id, e AS source_episode, k // 10 AS wider_key, CASE WHEN states > 2 THEN 'pending_review' ELSE 'retained' END AS action, CASE WHEN states > 2 THEN 'many_states' ELSE '' END AS reason, split FROM o JOIN es ON e = k // 4",
    "catalog_integrity": f"""WITH {_SQL}, c AS (SELECT *, e % 73 = 6 AS renamed FROM es WHERE e % 71 <> 5),
m AS (SELECT k, es.e, es.e % 73 = 6 AS renamed, CASE WHEN k % 61 = 3 THEN 'none' ELSE split END AS split, es.split AS own, unnest(range(CASE WHEN k % 101 = 0 THEN 2 ELSE 1 END)) AS copy FROM o JOIN es ON es.e = k // 4)
SELECT 'unique_event_membership' AS "check", count(*) AS violations FROM (SELECT k FROM m GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'one_split_per_episode', count(*) FROM c WHERE e % 47 = 9
UNION ALL SELECT 'stable_ids', count(*) FROM c WHERE renamed OR e IN (SELECT e FROM m WHERE copy = 1)
UNION ALL SELECT 'membership_episode_lineage', count(*) FROM es WHERE e % 71 = 5
UNION ALL SELECT 'source_lineage_present', (SELECT count(*) FROM c WHERE e % 83 = 8) + (SELECT count(*) FROM m WHERE k % 67 = 4)
UNION ALL SELECT 'valid_episode_geometry', count(*) FROM c WHERE e % 79 = 7
UNION ALL SELECT 'one_evidence_row_per_episode', count(*) FROM c WHERE (e % 53 = 1) <> (e % 59 = 2)
UNION ALL SELECT 'membership_split_integrity', count(*) FROM m WHERE split <> own OR e % 71 = 5 OR e % 47 = 9""",
}
QUERIES = {f.__name__: f for f in (episode_evidence, episode_membership, catalog_integrity)}

"""Queries about footprints and episodes over boxes made from orders, and their closed-form SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.expr import rounded, valid_fraction
from ..operators import episodes as ep
from ..operators import spatial as sp
from ..sources.tables import written
from .base import table

CELL = 50_000.0
#: Cells of the pair join: a state has few events in one slot of time, so that wide cells, into which an event is dealt about four times, cost less than narrow ones.
PAIR_CELL = 100_000.0


def _boxed(df, x0, y0, x1, y1):
    """df with geometry: the WKB of a box."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, size = g.box_column(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")])
            starts = np.arange(len(batch) + 1, dtype=np.int32) * size
            wkb = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(starts), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, batch.schema.names) if n not in ("x0", "y0", "x1", "y1")], wkb], [*[n for n in batch.schema.names if n not in ("x0", "y0", "x1", "y1")], "geometry"])

    return df.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1}).mapInArrow(run, schema + ", geometry binary")


def footprints(spark, d):
    """All orders as boxes. Keys are dealt to runs of 3,000, each 70 days after the one before, so that how dense events are doesn't depend on the size of the table."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("event_id")
    start = F.date_add(F.lit("2023-12-01").cast("date"), (k * 13 % 61 + F.floor(k / 3000) * 70).cast("int"))
    other = ((F.col("c_nationkey") + 1) % 25).cast("string")
    own = F.col("c_nationkey").cast("string")
    states = F.when(F.col("o_orderkey") % 6 == 0, F.array(own, other)).otherwise(F.array(own))
    e = o.select(F.col("o_orderkey").alias("event_id"), F.col("c_nationkey").alias("state"), states.alias("states")).withColumn("start", start)
    e = e.withColumn("end", F.when(k % 50 != 7, F.date_add("start", (k % 4).cast("int"))))
    x, y, w = (k * 37 % 211 * 1000).cast("double"), (k * 91 % 199 * 1000).cast("double"), (4000 + k % 7 * 3000).cast("double")
    return sp.decode(_boxed(e, x, y, x + w, y + w))


def projected_areas(spark, d):
    """Customers as boxes in degrees, projected to the equal-area plane."""
    k = F.col("c_custkey")
    x, y = (k * 7 % 340 - 170).cast("double"), (k % 120 - 60).cast("double")
    rows = _boxed(table(spark, d, "customer").select("c_custkey"), x, y, x + (1 + k % 5).cast("double") / 10, y + (1 + k % 3).cast("double") / 10)
    return rounded(sp.decode(rows, projected=True).select("c_custkey", F.col("area_km2_shape").alias("area_km2")), 4)


def districts(spark, d):
    """A district for each nation: boxes of a 5 by 5 grid of 45 km, some way from the origin."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_nationkey").alias("k"))
    k = F.col("k")
    x, y = (k % 5 * 45_000 + 500).cast("double"), (F.floor(k / 5) * 45_000 + 500).cast("double")
    return _boxed(n, x, y, x + 45_000, y + 45_000)


def district_overlaps(spark, d):
    e = footprints(spark, d)
    return rounded(sp.ranked(sp.overlaps(e, sp.tiles(districts(spark, d), CELL), CELL), e)).withColumn("valid", valid_fraction(F.col("event_fraction"))).drop("point_inside")


def district_assignment(spark, d):
    e = footprints(spark, d)
    return sp.primary(sp.overlaps(e, sp.tiles(districts(spark, d), CELL), CELL), e)


def assignment_counters(spark, d):
    return sp.assignment_counters(district_assignment(spark, d))


def union_overlap(spark, d):
    return rounded(sp.union_overlap(footprints(spark, d), sp.tiles(districts(spark, d), CELL), CELL))


def pairs(spark, d):
    e = written(footprints(spark, d), "footprints")
    return ep.scored_pairs(ep.candidate_pairs(e, PAIR_CELL), e)


def policy_edges(spark, d):
    return ep.edges(pairs(spark, d), ep.policies(spark))


def episode_edges(spark, d):
    return rounded(policy_edges(spark, d)).select("policy", "a", "b", "gap_days", "distance_km", "contact", "overlap_km2", "iou", "shared_states", "edge_reason")


def pair_diagnostics(spark, d):
    return ep.pair_diagnostics(pairs(spark, d))


ALL = tuple(p[0] for p in ep.POLICIES)


def parted(spark, d, policies=ALL):
    """Edges of these policies, the footprints that have any with their members, and the other footprints; pairs too far apart in days for all of them are not made."""
    e = written(footprints(spark, d), "footprints")
    most_gap = max(p[1] for p in ep.POLICIES if p[0] in policies)
    pairs = ep.candidate_pairs(e, PAIR_CELL, most_gap)
    edges = written(ep.edges(ep.scored_pairs(pairs, e), ep.policies(spark).where(F.col("policy").isin(*policies))).drop("start_a", "start_b"), "policy_edges")
    linked, alone = ep.parted(e, edges)
    return edges, linked, written(ep.membership(edges, linked, list(policies)), "members"), alone


def all_members(members, alone, policies=ALL):
    return members.unionByName(ep.lone_members(alone, list(policies)))


def episode_members(spark, d):
    _, _, members, alone = parted(spark, d)
    return all_members(members, alone)


def reviewed(episodes, spans):
    return ep.with_review(episodes, spans, {**ep.REVIEW_LIMITS, "members": 3, "days": 4, "distance_km": 20.0, "states": 2})


def rolled(spark, d):
    """Episodes of all policies with what is to be reviewed."""
    edges, linked, members, alone = parted(spark, d)
    return reviewed(ep.rollup(members, linked, edges), ep.spans(members, linked)).unionByName(reviewed(ep.lone_episodes(alone, list(ALL)), None).drop("area_km2_shape"))


def episode_rollup(spark, d):
    return rounded(rolled(spark, d))


def episode_areas(spark, d):
    _, linked, members, alone = parted(spark, d)
    return rounded(ep.union_areas(members, linked).unionByName(ep.lone_areas(alone, list(ALL))), 4)


def policy_sensitivity(spark, d):
    return ep.policy_sensitivity(rolled(spark, d))


def size_distribution(spark, d):
    return ep.size_distribution(rolled(spark, d))


def state_years(spark, d):
    return ep.state_years(rolled(spark, d))


def clustering_agreement(spark, d):
    members = episode_members(spark, d)
    return rounded(ep.agreement(members, "conservative", "balanced").unionByName(ep.agreement(members, "balanced", "broad")))


BOX = """
fp AS (SELECT o_orderkey AS event_id, c_nationkey AS state, CASE WHEN o_orderkey % 6 = 0 THEN [CAST(c_nationkey AS VARCHAR), CAST((c_nationkey + 1) % 25 AS VARCHAR)] ELSE [CAST(c_nationkey AS VARCHAR)] END AS states, s, CASE WHEN o_orderkey % 50 <> 7 THEN s + CAST(o_orderkey % 4 AS INT) END AS raw_e,
  CASE WHEN o_orderkey % 50 <> 7 THEN s + CAST(o_orderkey % 4 AS INT) ELSE s END AS e, o_orderkey * 37 % 211 * 1000.0::DOUBLE AS x, o_orderkey * 91 % 199 * 1000.0::DOUBLE AS y, (4000 + o_orderkey % 7 * 3000)::DOUBLE AS w
  FROM (SELECT *, DATE '2023-12-01' + CAST(o_orderkey * 13 % 61 + o_orderkey // 3000 * 70 AS INT) AS s FROM orders) JOIN customer ON o_custkey = c_custkey),
di AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_nationkey % 5 * 45000.0::DOUBLE + 500 AS x, n_nationkey // 5 * 45000.0::DOUBLE + 500 AS y FROM nation),
ov AS (SELECT event_id, code, greatest(0, least(fp.x + w, di.x + 45000) - greatest(fp.x, di.x)) * greatest(0, least(fp.y + w, di.y + 45000) - greatest(fp.y, di.y)) / 1e6 AS overlap_km2, w * w / 1e6 AS area,
  fp.x + w / 2 BETWEEN di.x AND di.x + 45000 AND fp.y + w / 2 BETWEEN di.y AND di.y + 45000 AS point_inside FROM fp JOIN di ON fp.x <= di.x + 45000 AND di.x <= fp.x + w AND fp.y <= di.y + 45000 AND di.y <= fp.y + w),
pm AS (SELECT event_id, count(*) AS candidates, count(*) FILTER (point_inside) AS inside, count(*) FILTER (most - overlap_km2 <= 1e-9) AS tied, min(code) FILTER (point_inside) AS covering, first(code ORDER BY overlap_km2 DESC, code) AS largest FROM (SELECT *, max(overlap_km2) OVER (PARTITION BY event_id) AS most FROM ov) GROUP BY 1),
asg AS (SELECT event_id, CASE WHEN inside = 1 THEN covering ELSE largest END AS primary_code, CASE WHEN candidates IS NULL THEN 'none' WHEN inside = 1 THEN 'point' WHEN candidates = 1 THEN 'single' WHEN tied > 1 THEN 'manual_review' ELSE 'largest_overlap' END AS method, coalesce(candidates, 0) AS candidates,
  coalesce(inside <> 1 AND candidates > 1 AND (tied > 1 OR inside > 1), FALSE) AS review FROM fp LEFT JOIN pm USING (event_id)),
us AS (SELECT event_id, s, e, unnest(states) AS st FROM fp),
sp AS (SELECT a.event_id AS a, b.event_id AS b, string_agg(a.st, ';' ORDER BY a.st) AS shared_states FROM us a JOIN us b ON a.st = b.st AND a.event_id < b.event_id AND b.s <= a.e + 2 AND a.s <= b.e + 2 GROUP BY 1, 2),
sc AS (SELECT p.a, p.b, shared_states, year(a.s) AS ya, year(b.s) AS yb, CAST(greatest(datediff('day', a.e, b.s), datediff('day', b.e, a.s), 0) AS INT) AS gap_days, sqrt(power(a.x + a.w / 2 - b.x - b.w / 2, 2) + power(a.y + a.w / 2 - b.y - b.w / 2, 2)) / 1000 AS distance_km,
  a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.w AND b.y <= a.y + a.w AS contact, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y)) / 1e6 AS overlap_km2, (a.w * a.w + b.w * b.w) / 1e6 AS areas
  FROM sp p JOIN fp a ON a.event_id = p.a JOIN fp b ON b.event_id = p.b),
ed AS (SELECT policy, a, b, gap_days, distance_km, contact, overlap_km2, shared_states, overlap_km2 / (areas - overlap_km2) AS iou, concat_ws(';', CASE WHEN contact THEN 'intersects' END, CASE WHEN overlap_km2 / (areas - overlap_km2) >= least_iou THEN 'overlap' END, CASE WHEN distance_km <= reach THEN 'distance' END) AS edge_reason
  FROM sc, (VALUES ('conservative', 0, 2.0, -1.0), ('balanced', 1, 0.10, 10.0), ('broad', 2, 0.05, 25.0)) p(policy, gap, least_iou, reach)
  WHERE gap_days <= gap AND (contact OR overlap_km2 / (areas - overlap_km2) >= least_iou OR distance_km <= reach))
"""
_YS = "CASE WHEN year({}) <= 2023 THEN 'development' WHEN year({}) = 2024 THEN 'validation' ELSE 'test' END"
MEMBERS = "RECURSIVE " + BOX + f""",
sy AS (SELECT policy, a, b FROM ed UNION ALL SELECT policy, b, a FROM ed),
cc AS (SELECT policy, event_id AS n, event_id AS r FROM fp, (VALUES ('conservative'), ('balanced'), ('broad')) p(policy) UNION SELECT cc.policy, sy.b, cc.r FROM cc JOIN sy ON sy.policy = cc.policy AND sy.a = cc.n),
me AS (SELECT policy, n AS event_id, min(r) AS component FROM cc GROUP BY 1, 2),
g1 AS (SELECT me.policy, component, fp.*, datediff('day', lag(s) OVER (PARTITION BY policy, component ORDER BY s, event_id), s) AS gap, {_YS.format('s', 's')} AS ys FROM me JOIN fp USING (event_id)),
pst AS (SELECT policy, component, first(state ORDER BY n DESC, f) AS primary_state FROM (SELECT policy, component, state, count(*) AS n, min(event_id) AS f FROM g1 GROUP BY 1, 2, 3) GROUP BY 1, 2),
ec AS (SELECT ed.policy, component, count(*) AS edge_count FROM ed JOIN me ON me.policy = ed.policy AND me.event_id = ed.a GROUP BY 1, 2),
md AS (SELECT a.policy, a.component, max(sqrt(power(a.x + a.w / 2 - b.x - b.w / 2, 2) + power(a.y + a.w / 2 - b.y - b.w / 2, 2)) / 1000) AS largest_distance_km FROM g1 a JOIN g1 b ON a.policy = b.policy AND a.component = b.component GROUP BY 1, 2),
sl AS (SELECT policy, component, string_agg(st, ';' ORDER BY st) AS state_codes, count(*) AS state_count FROM (SELECT DISTINCT policy, component, unnest(states) AS st FROM g1) GROUP BY 1, 2),
r0 AS (SELECT policy, component, sha256(policy || '|' || string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY event_id)) AS episode_id, min(s) AS episode_start, max(e) AS episode_end, count(*) AS member_count, any_value(state_codes) AS state_codes, any_value(state_count) AS state_count, coalesce(max(gap), 0) AS largest_start_gap, first(x + w / 2 ORDER BY event_id) AS point_x, first(y + w / 2 ORDER BY event_id) AS point_y,
  sqrt(power(max(x + w) - min(x), 2) + power(max(y + w) - min(y), 2)) / 1000 AS diagonal_km, any_value(primary_state) AS primary_state, coalesce(any_value(edge_count), 0) AS edge_count, datediff('day', min(s), max(e)) AS duration_days, {_YS.format('min(s)', 'min(s)')} AS year_split, count(DISTINCT ys) > 1 AS crosses_year_split, any_value(largest_distance_km) AS largest_distance_km,
  CASE WHEN count(*) = 1 THEN '1' WHEN count(*) <= 5 THEN '2-5' WHEN count(*) <= 25 THEN '6-25' WHEN count(*) <= 100 THEN '26-100' ELSE '101+' END AS size_bin FROM g1 JOIN pst USING (policy, component) JOIN md USING (policy, component) JOIN sl USING (policy, component) LEFT JOIN ec USING (policy, component) GROUP BY 1, 2),
ru AS (SELECT *, concat_ws(';', CASE WHEN member_count > 3 THEN 'over_members' END, CASE WHEN duration_days > 4 THEN 'over_days' END, CASE WHEN largest_distance_km > 20 THEN 'over_distance_km' END, CASE WHEN state_count > 2 THEN 'over_states' END) AS review_reasons FROM r0),
ys AS (SELECT DISTINCT policy, component, unnest([y, y + w]) AS h FROM g1),
sb AS (SELECT * FROM (SELECT policy, component, h AS lo, lead(h) OVER (PARTITION BY policy, component ORDER BY h) AS hi FROM ys) WHERE hi IS NOT NULL),
iv AS (SELECT sb.policy, sb.component, hi - lo AS high, x, x + w AS x1, max(x + w) OVER (PARTITION BY sb.policy, sb.component, lo ORDER BY x, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sb JOIN g1 ON g1.policy = sb.policy AND g1.component = sb.component AND y <= lo AND y + w >= hi),
ar AS (SELECT policy, component, sum(high * greatest(0, x1 - greatest(x, coalesce(reach, x)))) / 1e6 AS union_km2 FROM iv GROUP BY 1, 2)
"""
_ag = lambda l, r: f"""SELECT '{l}' AS left_policy, '{r}' AS right_policy, CAST(sum(n) AS BIGINT) AS events, count(*) FILTER (n = il AND n = ir) AS preserved, count(DISTINCT CASE WHEN pr > 1 AND n = il THEN l END) AS merged, count(DISTINCT CASE WHEN pl > 1 THEN l END) AS split, CAST(coalesce(sum(n) FILTER (n = il AND n = ir), 0) AS BIGINT) AS identical,
round((sum(n) * (sum(n) - 1) / 2 - sum(il * (il - 1) / 2 / pl) - sum(ir * (ir - 1) / 2 / pr) + 2 * sum(n * (n - 1) / 2)) / (sum(n) * (sum(n) - 1) / 2), 6) AS agreement
FROM (SELECT *, sum(n) OVER (PARTITION BY l) AS il, sum(n) OVER (PARTITION BY r) AS ir, count(*) OVER (PARTITION BY l) AS pl, count(*) OVER (PARTITION BY r) AS pr FROM (SELECT a.component AS l, b.component AS r, count(*) AS n FROM me a JOIN me b USING (event_id) WHERE a.policy = '{l}' AND b.policy = '{r}' GROUP BY 1, 2))"""  # noqa: E731,E741
_q = lambda lat: f"((1 - ee * ee) * (sin(radians({lat})) / (1 - power(ee * sin(radians({lat})), 2)) - ln((1 - ee * sin(radians({lat}))) / (1 + ee * sin(radians({lat})))) / (2 * ee)))"
ORACLE = {
    "projected_areas": f"WITH b AS (SELECT c_custkey, c_custkey % 120 - 60.0 AS y, (1 + c_custkey % 5) / 10 AS w, (1 + c_custkey % 3) / 10 AS h, 0.0818191908426215 AS ee FROM customer) SELECT c_custkey, round(6378137.0 * 6378137.0 / 2 * radians(w) * ({_q('y + h')} - {_q('y')}) / 1e6, 4) AS area_km2 FROM b",
    "district_overlaps": f"WITH {BOX} SELECT event_id, code, round(overlap_km2, 6) AS overlap_km2, row_number() OVER (PARTITION BY event_id ORDER BY overlap_km2 DESC, code) AS assignment_rank, CASE WHEN overlap_km2 > 0 THEN round(overlap_km2 / area, 6) END AS event_fraction, CASE WHEN overlap_km2 > 0 THEN round(overlap_km2 / sum(overlap_km2) OVER (PARTITION BY event_id), 6) END AS union_fraction, row_number() OVER (PARTITION BY event_id ORDER BY overlap_km2 DESC, code) = 1 AS is_primary, TRUE AS valid FROM ov",
    "district_assignment": f"WITH {BOX} SELECT * FROM asg",
    "assignment_counters": f"WITH {BOX} SELECT method, count(*) AS events, count(*) FILTER (candidates > 1) AS several FROM asg GROUP BY 1",
    "union_overlap": f"WITH {BOX} SELECT event_id, round(greatest(0, least(x + w, 225500) - greatest(x, 500)) * greatest(0, least(y + w, 225500) - greatest(y, 500)) / 1e6, 6) AS union_km2 FROM fp",
    "episode_edges": f"WITH {BOX} SELECT policy, a, b, gap_days, round(distance_km, 6) AS distance_km, contact, round(overlap_km2, 6) AS overlap_km2, round(iou, 6) AS iou, shared_states, edge_reason FROM ed",
    "pair_diagnostics": f"""WITH {BOX}, x AS (SELECT ya AS year, unnest(string_split(shared_states, ';')) AS state, a, b, t.time_rule, p.space_rule FROM sc, (VALUES ('gap_0', 0), ('gap_1', 1), ('gap_2', 2)) t(time_rule, n), (VALUES ('intersects', -1.0), ('within_5km', 5.0), ('within_10km', 10.0), ('within_25km', 25.0)) p(space_rule, k)
WHERE ya = yb AND gap_days <= t.n AND (CASE WHEN p.k < 0 THEN contact ELSE distance_km <= p.k END))
SELECT year, state, time_rule, space_rule, count(DISTINCT (a, b)) AS pairs, count(DISTINCT v) AS participants FROM (SELECT *, unnest([a, b]) AS v FROM x) GROUP BY 1, 2, 3, 4""",
    "episode_members": f"WITH {MEMBERS} SELECT policy, event_id, component, row_number() OVER (PARTITION BY policy, component ORDER BY event_id) AS member_rank, event_id = component AS is_anchor FROM me",
    "episode_rollup": f"WITH {MEMBERS} SELECT * REPLACE (round(diagonal_km, 6) AS diagonal_km, round(largest_distance_km, 6) AS largest_distance_km) FROM ru",
    "episode_areas": f"WITH {MEMBERS} SELECT policy, component, round(union_km2, 4) AS union_km2 FROM ar",
    "policy_sensitivity": f"""WITH {MEMBERS} SELECT policy, CAST(sum(member_count) AS BIGINT) AS members, count(*) AS episodes, count(*) FILTER (member_count = 1) AS singletons, count(*) FILTER (member_count > 1) AS multi_member, quantile_disc(member_count, 0.5) AS size_p50, quantile_disc(member_count, 0.9) AS size_p90, quantile_disc(member_count, 0.95) AS size_p95,
quantile_disc(member_count, 0.99) AS size_p99, max(member_count) AS largest, quantile_disc(duration_days, 0.5) AS duration_p50, quantile_disc(duration_days, 0.95) AS duration_p95, max(duration_days) AS longest, count(*) FILTER (state_count > 1) AS multistate, count(*) FILTER (crosses_year_split) AS split_boundary,
count(*) FILTER (review_reasons <> '') AS review_flagged, CAST(sum(edge_count) AS BIGINT) AS edges FROM ru GROUP BY 1""",
    "size_distribution": f"WITH {MEMBERS} SELECT policy, size_bin, count(*) AS episodes, CAST(sum(member_count) AS BIGINT) AS members FROM ru GROUP BY 1, 2",
    "state_years": f"WITH {MEMBERS} SELECT policy, state, year, count(*) AS episodes FROM (SELECT policy, unnest(string_split(state_codes, ';')) AS state, year(episode_start) AS year FROM ru) GROUP BY 1, 2, 3",
    "clustering_agreement": f"WITH {MEMBERS} {_ag('conservative', 'balanced')} UNION ALL {_ag('balanced', 'broad')}",
}
QUERIES = {f.__name__: f for f in (projected_areas, district_overlaps, district_assignment, assignment_counters, union_overlap, episode_edges, pair_diagnostics, episode_members, episode_rollup, episode_areas, policy_sensitivity, size_distribution, state_years, clustering_agreement)}

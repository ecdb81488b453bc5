"""Queries about inputs, keys, folds and derived columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import catalog as c
from ..operators import cohort as h
from ..operators import describe, finalize
from ..sources import tables
from .base import table
from .cohort_queries import CAT, CO, cataloged, cohort


def input_report(spark, d):
    return tables.input_report({n: table(spark, d, n) for n in ("orders", "lineitem", "events")})


def boundary_rows(spark, d):
    """Nations as raw boundary attributes, some unresolved, made canonical."""
    n = table(spark, d, "nation")
    raw = n.select(F.when(F.col("n_nationkey") % 4 == 0, "-99").otherwise(F.col("n_name")).alias("iso"), F.concat(F.lit(" "), F.col("n_name")).alias("adm"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_regionkey").cast("string")).alias("sov"), F.lit(None).cast("binary").alias("geometry"))
    return tables.canonical_boundaries(raw, {"code": ["iso", "adm"], "sovereign": ["sov"], "name": ["missing", "adm"]}, "code").drop("geometry")


def duplicate_keys(spark, d):
    return describe.duplicate_keys(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


def state_records(spark, d):
    e = cohort(spark, d)
    return h.state_records(e, e.select("event_id", F.explode("state_set").alias("state"))).select("event_id", "state", "start", "cohort_status", "is_primary_state")


def fold_assignment(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("grp")).distinct()
    return finalize.folds(rows, "grp", 4, "0")


def episode_slices(spark, d):
    return c.slices(cataloged(spark, d)[0])


def episode_features(spark, d):
    return rounded(c.features(cataloged(spark, d)[0]))


ORACLE = {
    "input_report": " UNION ALL ".join(f"SELECT '{t}' AS name, {n} AS columns, count(*) AS rows FROM {t}" for t, n in (("orders", 6), ("lineitem", 11), ("events", 6))),
    "boundary_rows": "SELECT n_name AS code, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_regionkey AS VARCHAR) END AS sovereign, n_name AS name, CAST(1 AS BIGINT) AS rows_of_code FROM nation",
    "duplicate_keys": "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "state_records": f"WITH {CO} SELECT event_id, es.state, start, cohort_status, es.state IS NOT DISTINCT FROM primary_state AS is_primary_state FROM es JOIN co USING (event_id) WHERE cohort_status <> 'excluded'",
    "fold_assignment": "SELECT grp, CAST((row_number() OVER (ORDER BY sha256('0:' || grp), grp) - 1) % 4 AS INT) AS fold FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS grp FROM customer)",
    "episode_slices": f"WITH {CAT} SELECT episode_key, status, 'review_flagged' AS slice FROM ca WHERE reasons <> '' UNION ALL SELECT episode_key, status, 'split_crossing' FROM ca WHERE crosses_split UNION ALL SELECT episode_key, status, 'multistate' FROM ca WHERE state_count > 1",
    "episode_features": f"WITH {CAT} SELECT episode_key, round(sin(month(episode_start) * 2 * pi() / 12), 6) AS season_sin, round(cos(month(episode_start) * 2 * pi() / 12), 6) AS season_cos, round(ln(1 + member_count), 6) AS log_members, round(ln(1 + diagonal_km), 6) AS log_diagonal, round(ln(1 + union_km2), 6) AS log_area, status = 'retained' AND state_count = 1 AS primary_unit FROM ca",
}
QUERIES = {f.__name__: f for f in (input_report, boundary_rows, duplicate_keys, state_records, fold_assignment, episode_slices, episode_features)}

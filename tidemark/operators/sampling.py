"""Deterministic samples and request plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import season, stable_id
from .integrity import guarded
from .greedy import mini_set, nested_subsets, with_required_states  # noqa: F401  parts of the sampling interface


def seeded(seed: str, c: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(c).cast("string")), 256)


def eligible(catalog: DataFrame, most_days: int = 4, most_members: int = 25) -> DataFrame:
    """Retained or merely mergeable episodes, short and small, that cross no split and have a state."""
    return catalog.where(F.col("status").isin("retained", "merge_candidate") & (F.col("duration_days") <= most_days) & (F.col("member_count") <= most_members) & ~F.col("crosses_split") & F.col("primary_state").isNotNull())


#: Areas in km2 up to which a footprint is small, and compact.
SMALL_KM2, COMPACT_KM2 = 25.0, 10.0
DIMENSIONS = ("season", "region", "primary_state", "coastal", "member_class", "footprint", "compact")


def with_stratum(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """rows with season, region, coast, member class, footprint, compactness and the stratum they make with the state. dims: state, region, coastal."""
    out = rows.join(dims, rows["primary_state"] == dims["state"], "left").drop("state").withColumn("season", season(F.col("episode_start")))
    out = out.withColumn("member_class", F.when(F.col("member_count") == 1, "singleton").otherwise("multi_member"))
    out = out.withColumn("footprint", F.when(F.col("union_km2") <= SMALL_KM2, "small").otherwise("moderate")).withColumn("compact", F.when(F.col("union_km2") <= COMPACT_KM2, "compact").otherwise("spread"))
    return out.withColumn("stratum", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in DIMENSIONS]))


def diverse_sample(rows: DataFrame, key: str, year: Column, per_year: int, seed: str) -> DataFrame:
    """Up to per_year rows of each year, chosen one by one for novelty: the sum over dimensions of 1 / (1 + how often the value was chosen), ties to the largest seeded hash.

    Novelty depends on the stratum alone, so per stratum only the per_year rows with the largest hashes can be chosen; the greedy choice runs on those, at
    most per_year times the number of strata for each year.
    """
    rows = rows.withColumn("year", year).withColumn("h", seeded(seed, key))
    best = Window.partitionBy("year", "stratum").orderBy(F.desc("h"))
    few = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_year).select(F.col(key).cast("string").alias("id"), "year", "stratum", "h")

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        left = [(r.h, r.id, r.stratum.split("|")) for r in table.itertuples()]
        seen: list[dict[str, int]] = [{} for _ in range(len(left[0][2]))]
        out = []
        while left and len(out) < per_year:
            pick = max(left, key=lambda x: (round(sum(1 / (1 + s.get(v, 0)) for s, v in zip(seen, x[2])), 9), x[0]))
            left.remove(pick)
            for s, v in zip(seen, pick[2]):
                s[v] = s.get(v, 0) + 1
            out.append((pick[1], table["year"].iloc[0], "|".join(pick[2]), len(out) + 1))
        return pd.DataFrame(out, columns=["id", "year", "stratum", "selection_rank"])

    return few.groupBy("year").applyInPandas(choose, "id string, year int, stratum string, selection_rank int")


def subset_check(smaller: DataFrame, larger: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many of the smaller set are not in the larger, how many the larger has more, and whether the smaller is a proper subset."""
    one = lambda a, b, name: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.count("*").alias(name))
    return one(smaller, larger, "outside").crossJoin(one(larger, smaller, "more")).withColumn("proper", (F.col("outside") == 0) & (F.col("more") > 0))


def geography(episodes: DataFrame) -> DataFrame:
    """Geography of each episode by its primary state, how sure it is, and whether it needs review."""
    sure = F.when(F.col("primary_state").isNull(), "none").when(F.col("state_count") > 1, "moderate").otherwise("high")
    return episodes.withColumn("geography", F.concat(F.lit("US-"), F.col("primary_state"))).withColumn("confidence", sure).withColumn("mapping_status", F.when(F.col("confidence") == "none", "manual_review").otherwise("mapped"))


def request_window(rows: DataFrame, before: int = 28, after: int = 28, least: int = 60) -> DataFrame:
    """rows with the request's first and last day, the end padded so that it has at least this many days."""
    first, last = F.date_sub("episode_start", before), F.date_add("episode_end", after)
    return rows.withColumn("window_start", first).withColumn("window_end", F.greatest(last, F.date_add("window_start", least - 1)))


def request_plan(episodes: DataFrame, controls: DataFrame, panels: DataFrame, repeats: int, version: str = "1") -> DataFrame:
    """A row for each episode, role, panel and repeat, with stable ids. controls: episode_key, control_state (rank one); panels: panel, concept_ids, a small dimension."""
    roles = episodes.join(controls, "episode_key", "left")
    rows = roles.select("*", F.explode(F.array_compact(F.array(F.struct(F.lit("treated").alias("role"), F.col("geography").alias("place")), F.when(F.col("control_state").isNotNull(), F.struct(F.lit("control").alias("role"), F.concat(F.lit("US-"), F.col("control_state")).alias("place")))))).alias("r"))
    rows = rows.crossJoin(F.broadcast(panels)).withColumn("repeat_number", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    key = [F.col("episode_key").cast("string"), F.col("r.role"), F.col("r.place"), F.col("panel"), F.lit(version)]
    return rows.select("episode_key", F.col("r.role").alias("role"), F.col("r.place").alias("geography"), "panel", "concept_ids", F.concat(F.lit("repeat_"), F.col("repeat_number")).alias("planned_repeat_id"), "window_start", "window_end", stable_id("req_", *key).alias("request_id"), stable_id("pair_", F.col("episode_key").cast("string"), F.lit(version)).alias("pair_id"))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("role").agg(F.count("*").alias("rows"), F.count_distinct("request_id").alias("requests"), F.count_distinct("pair_id").alias("pairs"), F.count_distinct("planned_repeat_id").alias("repeats"), F.count_distinct("panel").alias("panels"))


def plan_violations(plan: DataFrame, repeats: int, panels: int) -> DataFrame:
    """Episodes whose design is not complete: every role, panel and repeat once, one pair id, not shared with another episode."""
    by = plan.groupBy("episode_key").agg(F.count("*").alias("n"), F.count_distinct("role", "panel", "planned_repeat_id").alias("kinds"), F.count_distinct("role").alias("roles"), F.count_distinct("pair_id").alias("pairs"))
    bad = by.where((F.col("n") != F.col("roles") * repeats * panels) | (F.col("n") != F.col("kinds")) | (F.col("pairs") != 1)).select("episode_key", F.lit("incomplete_design").alias("problem"))
    shared = plan.select("episode_key", "pair_id").distinct().withColumn("n", F.count("*").over(Window.partitionBy("pair_id"))).where("n > 1").select("episode_key", F.lit("shared_pair").alias("problem"))
    return bad.unionByName(shared)


def filtered(plan: DataFrame, limit: int | None = None, **equal: str | list[str]) -> DataFrame:
    """Plan rows with these values (one or several of each column), in their fixed order, up to a limit. A column that the plan lacks is an error; a filter that leaves nothing is, too,
    for whatever reads the result."""
    if absent := [c for c in equal if c not in plan.columns]:
        raise ValueError(f"the plan has no columns {absent}")
    for c, v in equal.items():
        plan = plan.where(F.col(c).isin(v if isinstance(v, list) else [v]))
    none = plan.agg(F.count("*").alias("rows")).where("rows = 0")
    rows = guarded(plan, none, f"no plan row with {equal}").orderBy("request_id", "planned_repeat_id")
    return rows if limit is None else rows.limit(limit)


def concept_violations(concepts: DataFrame, panels: DataFrame, tiers: list[str], core: str = "core") -> DataFrame:
    """What is wrong with a concept dictionary (concept_id, term, family, tier, is_anchor, is_context) and its panels (panel, concept_ids): (kind, id)."""
    blank = F.nullif(F.trim("concept_id"), F.lit("")).isNull() | F.nullif(F.trim("term"), F.lit("")).isNull() | F.col("family").isNull()
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    listed = panels.select("panel", F.explode(F.split("concept_ids", ";")).alias("concept_id"))
    size = listed.groupBy("panel").agg(F.count_distinct("concept_id").alias("n"))
    n_core = panels.where(F.col("panel").startswith(core)).agg(F.count("*").alias("n")).where("n <> 5").select(F.lit(core).alias("panel"))
    return (
        row(concepts.where(blank), "missing_field", "concept_id").unionByName(row(concepts.where(~F.col("tier").isin(tiers)), "unknown_tier", "concept_id")).unionByName(row(concepts.where(F.col("is_anchor") & F.col("is_context")), "anchor_and_context", "concept_id"))
        .unionByName(row(concepts.groupBy("concept_id").count().where("count > 1"), "repeated_id", "concept_id")).unionByName(row(listed.join(concepts, "concept_id", "left_anti"), "unknown_concept", "concept_id"))
        .unionByName(row(size.where("n <> 5"), "panel_size", "panel")).unionByName(row(n_core, "core_panels", "panel"))
    )

"""Provisional catalog of episodes: assembly, flags, status, review, decisions, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import reasons, size_bin, stable_id


@dataclass(frozen=True)
class CatalogRules:
    """Limits beyond which (strictly) an episode is flagged."""

    most_days: int = 3
    most_members: int = 4
    most_diagonal_km: float = 20.0
    most_gap: int = 1
    most_distance_km: float = 15.0
    most_states: int = 2


#: Review type and priority of each reason; 10 for any other.
REVIEW = (("merge_candidate", "merge", 1), ("long_duration", "split", 2), ("many_members", "split", 3), ("wide", "geometry", 4), ("bridge", "split", 5), ("split_boundary", "split_boundary", 6), ("member_distance", "geometry", 7), ("many_states", "split", 8))


def assemble(rolled: DataFrame, members: DataFrame, areas: DataFrame, rules: CatalogRules, boundary: str, base: str = "conservative", wider: str = "balanced") -> DataFrame:
    """One row for each base episode: the wider policy's components that hold its members, flags, sorted reasons, status and strength of evidence.

    rolled: episodes with the largest distance of members; areas: (policy, component, union_km2). An episode whose wider component holds members of other base episodes is a candidate for merging; one that starts before and ends on or after the boundary date crosses the split.
    """
    side = lambda p, c: members.where(F.col("policy") == p).select("event_id", F.col("component").alias(c))
    both = side(base, "component").join(side(wider, "wider_component"), "event_id")
    shared = both.groupBy("wider_component").agg(F.count_distinct("component").alias("base_episodes"))
    near = both.join(shared, "wider_component").groupBy("component").agg(F.max("base_episodes").alias("wider_base_episodes"), F.count_distinct("wider_component").alias("wider_components"))
    crossing = rolled.where(F.col("policy") == wider).select(F.col("component").alias("wider_component"), _crosses(boundary).alias("crosses"))
    near = near.join(both.join(crossing, "wider_component").groupBy("component").agg(F.bool_or("crosses").alias("wider_crosses_split")), "component")
    rows = rolled.where(F.col("policy") == base).join(near, "component").join(areas.where(F.col("policy") == base).select("component", "union_km2"), "component")
    return _flagged(rows, rules, boundary)


def assemble_lone(episodes: DataFrame, rules: CatalogRules, boundary: str) -> DataFrame:
    """Rows as assemble gives them for base episodes of one event (with union_km2) that are alone in the wider policy too."""
    one = F.lit(1).cast("long")
    return _flagged(episodes.withColumns({"wider_base_episodes": one, "wider_components": one, "wider_crosses_split": _crosses(boundary)}), rules, boundary)


def _crosses(boundary: str) -> Column:
    return (F.col("episode_start") < F.lit(boundary).cast("date")) & (F.col("episode_end") >= F.lit(boundary).cast("date"))


def _flagged(rows: DataFrame, rules: CatalogRules, boundary: str) -> DataFrame:
    merge = F.col("wider_base_episodes") > 1
    crosses = _crosses(boundary)
    bridge = (F.col("edge_count") > 0) & (F.col("member_count") > 2)
    far, states = F.col("largest_distance_km") > rules.most_distance_km, F.col("state_count") > rules.most_states
    why = reasons((bridge, "bridge"), (F.col("duration_days") > rules.most_days, "long_duration"), (F.col("member_count") > rules.most_members, "many_members"), (states, "many_states"), (far, "member_distance"), (merge, "merge_candidate"), (crosses | F.col("wider_crosses_split"), "split_boundary"), (F.col("diagonal_km") > rules.most_diagonal_km, "wide"))
    out = rows.withColumn("reasons", F.array_join(why, ";")).withColumn("crosses_split", crosses)
    status = F.when(merge & ~F.col("wider_crosses_split"), "merge_candidate").when(F.col("wider_crosses_split"), "split_candidate").when(F.col("reasons") != "", "manual_review").otherwise("retained")
    strength = F.when(F.col("member_count") >= 3, "strong").when(F.col("member_count") == 2, "moderate").otherwise("single")
    out = out.withColumn("status", status).withColumn("strength", strength)
    return out.select(F.col("component").alias("episode_key"), "episode_id", "episode_start", "episode_end", "duration_days", "member_count", "primary_state", "state_count", "edge_count", "diagonal_km", "largest_distance_km", "union_km2", "wider_base_episodes", "wider_components", "wider_crosses_split", "crosses_split", "reasons", "status", "strength")


def review_rows(catalog: DataFrame) -> DataFrame:
    """One row for each flagged episode: the type of its reason with the highest priority (first on ties), an action, a stable id."""
    types = catalog.sparkSession.createDataFrame(REVIEW, "reason string, review_type string, priority int")
    each = catalog.where("reasons <> ''").select("episode_key", "status", F.posexplode(F.split("reasons", ";")).alias("place", "reason")).join(F.broadcast(types), "reason", "left")
    key = F.struct(F.coalesce("priority", F.lit(10)).alias("p"), "place")
    by = each.groupBy("episode_key").agg(F.min_by(F.coalesce("review_type", F.lit("other")), key).alias("review_type"), F.min(F.coalesce("priority", F.lit(10))).alias("priority"), F.count("*").alias("reason_count"))
    action = F.when(F.col("review_type") == "merge", "compare_with_neighbours").when(F.col("review_type") == "split", "check_members").otherwise("look_at_map")
    return by.withColumn("action", action).withColumn("review_id", stable_id("rev_", F.col("episode_key").cast("string"), F.col("review_type")))


def initial_decisions(catalog: DataFrame) -> DataFrame:
    kept = F.col("status") == "retained"
    return catalog.select("episode_key", F.when(kept, "retain").otherwise("review_pending").alias("decision"), F.when(kept, "rule_based").otherwise("deferred").alias("basis"), stable_id("dec_", F.col("episode_key").cast("string"), F.col("status")).alias("decision_id"))


def summary(catalog: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return catalog.agg(F.count("*").alias("episodes"), F.sum("member_count").alias("members"), *[n(F.col("status") == s).alias(s) for s in ("retained", "merge_candidate", "split_candidate", "manual_review")], n(F.col("crosses_split")).alias("crossing"), n(F.col("member_count") == 1).alias("singletons"))


def counters(catalog: DataFrame) -> DataFrame:
    """Episodes by year, state, size, strength, and by reason and status: (counter, value, status, episodes)."""
    none = F.lit("")
    rows = catalog.select(F.explode(F.concat(F.array(
        F.struct(F.lit("year").alias("counter"), F.year("episode_start").cast("string").alias("value"), none.alias("status")), F.struct(F.lit("state").alias("counter"), F.col("primary_state").cast("string").alias("value"), none.alias("status")),
        F.struct(F.lit("size").alias("counter"), size_bin(F.col("member_count")).alias("value"), none.alias("status")), F.struct(F.lit("strength").alias("counter"), F.col("strength").alias("value"), none.alias("status")),
    ), F.transform(F.filter(F.split("reasons", ";"), lambda r: r != ""), lambda r: F.struct(F.lit("reason").alias("counter"), r.alias("value"), F.col("status").alias("status"))))).alias("c")).select("c.*")
    return rows.groupBy("counter", "value", "status").agg(F.count("*").alias("episodes"))


def validation(catalog: DataFrame, members: DataFrame, base: str = "conservative") -> DataFrame:
    """Violations of each rule of a sound catalog: (check, violations)."""
    mine = members.where(F.col("policy") == base)
    counted = mine.groupBy("component").agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.lit(base), F.array_join(F.array_sort(F.collect_list("event_id")), ";")), 256).alias("own_id"))
    one = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    checks = [
        one("event_in_one_episode", mine.groupBy("event_id").count().where("count > 1")), one("episode_once", catalog.groupBy("episode_key").count().where("count > 1")),
        one("members_match", catalog.join(counted, catalog["episode_key"] == counted["component"], "left").where("n is null or n <> member_count")), one("ids_recomputed", catalog.join(counted, catalog["episode_key"] == counted["component"], "left").where("not (own_id <=> episode_id)")), one("no_lost_episode", counted.join(catalog, counted["component"] == catalog["episode_key"], "left_anti")),
        one("dates_in_order", catalog.where("episode_end < episode_start")), one("status_known", catalog.where("status is null")), one("reasons_fit_status", catalog.where("(status = 'retained') <> (reasons = '')")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def numbers(c: str) -> Column:
    """Numbers of a list in one text, parted by semicolons; what is no number is null, blanks are left out."""
    return F.transform(F.filter(F.split(F.col(c), ";"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("long"))


def decision_violations(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """What is wrong with reviewers' decisions (episode_key, action, groups, merge_with, cross_split_override): (episode_key, problem).

    groups: member lists, ids by semicolons, lists by bars; they must part the episode's members exactly. members: (event_id, episode_key, split).
    """
    known = members.select("episode_key").distinct()
    parts = decisions.where("action = 'split'").select("episode_key", F.explode(F.split("groups", r"\|")).alias("g")).select("episode_key", F.explode(F.split("g", ";")).alias("event_id"))
    listed = parts.groupBy("episode_key", F.col("event_id").try_cast("long").alias("event_id")).agg(F.count("*").alias("n"))
    mine = members.select("episode_key", "event_id", F.lit(True).alias("is_member")).join(decisions.where("action = 'split'").select("episode_key"), "episode_key", "left_semi")
    compared = mine.join(listed, ["episode_key", "event_id"], "full")
    problem = lambda df, name: df.select("episode_key", F.lit(name).alias("problem")).distinct()
    merged = decisions.where("action = 'merge'").select("episode_key", "cross_split_override", F.explode(numbers("merge_with")).alias("other"))
    split = members.groupBy("episode_key").agg(F.min("split").alias("split"))
    crossing = merged.join(split, "episode_key").join(split.select(F.col("episode_key").alias("other"), F.col("split").alias("other_split")), "other").where("split <> other_split and not coalesce(cross_split_override, false)")
    return (
        problem(decisions.join(known, "episode_key", "left_anti"), "unknown_episode").unionByName(problem(decisions.groupBy("episode_key").count().where("count > 1"), "decided_twice"))
        .unionByName(problem(compared.where("n is null or is_member is null or n > 1"), "groups_not_a_partition")).unionByName(problem(merged.join(known.select(F.col("episode_key").alias("other")), "other", "left_anti"), "unknown_merge_source"))
        .unionByName(problem(crossing, "crosses_split")).unionByName(problem(decisions.where("action not in ('retain', 'merge', 'split')"), "unknown_action"))
    )


def apply_decisions(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """(event_id, episode_key, new_id) after sound decisions: split groups and merged episodes get ids from their members."""
    parts = decisions.where("action = 'split'").select("episode_key", F.posexplode(F.split("groups", r"\|")).alias("part", "g")).select("episode_key", "part", F.explode(F.split("g", ";").cast("array<bigint>")).alias("event_id"))
    merged = decisions.where("action = 'merge'").select(F.col("episode_key").alias("target"), F.explode(F.concat(F.split("merge_with", ";").cast("array<bigint>"), F.array("episode_key"))).alias("episode_key"))
    rows = members.join(parts, ["episode_key", "event_id"], "left").join(merged, "episode_key", "left")
    group = F.concat_ws("/", F.coalesce("target", "episode_key").cast("string"), F.coalesce("part", F.lit(0)).cast("string"))
    rows = rows.withColumn("grp", group)
    ids = rows.groupBy("grp").agg(stable_id("ep_", F.array_join(F.array_sort(F.collect_list("event_id")), ";")).alias("new_id"))
    return rows.join(ids, "grp").select("event_id", "episode_key", "new_id")


def slices(catalog: DataFrame) -> DataFrame:
    """The episodes that diagnostics look at, once for each slice they are in: flagged for review, crossing the split, in several states."""
    which = reasons((F.col("reasons") != "", "review_flagged"), (F.col("crosses_split"), "split_crossing"), (F.col("state_count") > 1, "multistate"))
    return catalog.select("episode_key", "status", F.explode(which).alias("slice"))


def features(catalog: DataFrame) -> DataFrame:
    """Model features of each episode: sine and cosine of its month, logs of its size, extent and area, and whether it is a primary unit (retained, in one state)."""
    month = F.month("episode_start") * 2 * F.pi() / 12
    return catalog.select("episode_key", F.sin(month).alias("season_sin"), F.cos(month).alias("season_cos"), F.log1p(F.col("member_count").cast("double")).alias("log_members"), F.log1p("diagonal_km").alias("log_diagonal"), F.log1p("union_km2").alias("log_area"), ((F.col("status") == "retained") & (F.col("state_count") == 1)).alias("primary_unit"))

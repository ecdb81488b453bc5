"""Reviewers' decisions over whole groups: merges that name one another are closed before anything is applied.

decisions: episode_key, action (retain, split, merge), groups (of a split: member ids by semicolons, groups by bars), merge_with (ids by semicolons),
cross_split_override, reviewer, reason. members: event_id, episode_key, split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null
from .catalog import decision_violations, numbers
from .components import components


def _merges(decisions: DataFrame) -> DataFrame:
    return decisions.where("action = 'merge'").select("episode_key", F.coalesce(F.col("cross_split_override"), F.lit(False)).alias("override"), F.explode(numbers("merge_with")).alias("other"))


def closed_merges(decisions: DataFrame) -> DataFrame:
    """(episode_key, target): episodes that merges join to each other, directly or by way of others, have the same target, the smallest of them."""
    edges = _merges(decisions).where("other is not null").select(F.col("episode_key").cast("long").alias("a"), F.col("other").alias("b"))
    return components(edges).select(F.col("node").alias("episode_key"), F.col("component").alias("target"))


def violations(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """(episode_key, problem) of everything for which decisions cannot be applied.

    Beside what decision_violations finds: no_reviewer (an action without a name or a reason), merge_of_one (a merge that names no other episode),
    merged_and_decided (an episode that is retained or split by one decision and merged by another), and crossing by way of others (chain_crosses_split:
    a closed group holds several splits and one of its merges does not allow it).
    """
    problem = lambda df, name: df.select("episode_key", F.lit(name).alias("problem")).distinct()
    unnamed = decisions.where(F.col("action").isNotNull() & (blank_to_null("reviewer").isNull() | blank_to_null("reason").isNull()))
    others = F.filter(F.coalesce(numbers("merge_with"), F.array().cast("array<bigint>")), lambda x: F.coalesce(x != F.col("episode_key"), F.lit(False)))
    alone = decisions.where("action = 'merge'").where(F.size(others) == 0)
    merges, closed = _merges(decisions), closed_merges(decisions)
    both = decisions.where("action in ('retain', 'split')").join(closed.select("episode_key"), "episode_key", "left_semi")
    splits = members.select("episode_key", "split").distinct().join(closed, "episode_key").groupBy("target").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
    allowed = merges.join(closed, "episode_key").groupBy("target").agg(F.bool_and("override").alias("allowed"))
    crossing = closed.join(splits, "target").join(allowed.where("not allowed"), "target")
    out = decision_violations(decisions, members)
    for df, name in ((unnamed, "no_reviewer"), (alone, "merge_of_one"), (both, "merged_and_decided"), (crossing, "chain_crosses_split")):
        out = out.unionByName(problem(df, name))
    return out


def applied(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """(event_id, episode_key, action, new_key, new_id) after sound decisions: episodes of a closed merge become one, groups of a split one each, others stay.

    new_id depends on the members alone, by sums over hashes, so that no group's members meet in one task; action is keep for an episode without a decision.
    """
    parts = decisions.where("action = 'split'").select("episode_key", F.posexplode(F.split("groups", r"\|")).alias("part", "g"))
    parts = parts.select("episode_key", "part", F.explode(numbers("g")).alias("event_id"))
    action = decisions.select("episode_key", "action")
    rows = members.join(parts, ["episode_key", "event_id"], "left").join(closed_merges(decisions), "episode_key", "left").join(action, "episode_key", "left")
    kind = F.when(F.col("target").isNotNull(), "merge").otherwise(F.coalesce("action", F.lit("keep")))
    key = F.concat_ws("/", F.coalesce("target", "episode_key").cast("string"), F.coalesce("part", F.lit(0)).cast("string"))
    rows = rows.select("event_id", "episode_key", kind.alias("action"), key.alias("new_key"))
    part = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 15), 16, 10).cast("long")
    sums = rows.groupBy("new_key").agg(F.count("*").alias("n"), F.sum(part.cast("decimal(20,0)")).alias("s"), F.bit_xor(part).alias("x"))
    text = F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))
    ids = sums.select("new_key", F.concat(F.lit("ep_"), F.substring(F.sha2(text, 256), 1, 16)).alias("new_id"))
    return rows.join(ids, "new_key").select("event_id", "episode_key", "action", "new_key", "new_id")


def decision_log(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each new episode that a decision made or kept: new_id, decision, how many episodes and events went into it, the first and last of them."""
    rows = applied(decisions, members)
    return rows.groupBy("new_id", F.col("action").alias("decision")).agg(
        F.count_distinct("episode_key").alias("episodes"), F.count("*").alias("events"), F.min("episode_key").alias("first_episode"), F.max("episode_key").alias("last_episode")
    )

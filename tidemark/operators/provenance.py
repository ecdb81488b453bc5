"""Evidence of catalog episodes, provenance of their members, and the checks that hold the two together.

members: policy, event_id, component. edges: policy, a, b, rule. events: event_id, start, end, states (an array). Base episodes come from one policy; a wider policy's
components say which of them might be one episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(members: DataFrame, policy: str, name: str) -> DataFrame:
    return members.where(F.col("policy") == policy).select("event_id", F.col("component").alias(name))


def member_digest(event_id: Column) -> tuple[Column, Column, Column]:
    """Aggregates that depend on a group's ids alone and need no group in one place: how many, and sum and exclusive or of 60 bits of hash."""
    part = F.conv(F.substring(F.sha2(event_id.cast("string"), 256), 1, 15), 16, 10).cast("long")
    return F.count("*"), F.sum(part.cast("decimal(20,0)")), F.bit_xor(part)


def digest_text(n: Column, s: Column, x: Column, version: str) -> Column:
    return F.concat(F.lit("ep_"), F.substring(F.sha2(F.concat_ws(":", F.lit(version), *[c.cast("string") for c in (n, s, x)]), 256), 1, 16))


def base_episodes(members: DataFrame, events: DataFrame, edges: DataFrame, version: str, split: Column, base: str = "conservative") -> DataFrame:
    """A row for each base episode: episode_key, episode_id (of its members alone), extent in time, states, edges, the rules that made them, and its split by its start."""
    rows = _side(members, base, "episode_key").join(events, "event_id")
    n, s, x = member_digest(F.col("event_id"))
    by = rows.groupBy("episode_key").agg(n.alias("n"), s.alias("s"), x.alias("x"), F.min("start").alias("episode_start"), F.max(F.coalesce("end", "start")).alias("episode_end"))
    states = rows.select("episode_key", F.explode("states").alias("state")).distinct().groupBy("episode_key").agg(F.array_sort(F.collect_list("state")).alias("states"))
    inside = edges.where(F.col("policy") == base).join(_side(members, base, "episode_key").withColumnRenamed("event_id", "a"), "a")
    made = inside.groupBy("episode_key").agg(F.count("*").alias("edge_count"), F.array_sort(F.collect_set("rule")).alias("edge_rules"))
    out = by.join(states, "episode_key", "left").join(made, "episode_key", "left")
    return out.select(
        "episode_key",
        digest_text(F.col("n"), F.col("s"), F.col("x"), version).alias("episode_id"),
        F.col("n").alias("member_count"),
        "episode_start",
        "episode_end",
        (F.datediff("episode_end", "episode_start") + 1).alias("duration_days"),
        F.coalesce(F.size("states"), F.lit(0)).alias("state_count"),
        F.array_join(F.coalesce("states", F.array().cast("array<string>")), ";").alias("state_codes"),
        F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        F.array_join(F.coalesce("edge_rules", F.array().cast("array<string>")), ";").alias("edge_rules"),
        split.alias("split"),
    )


def evidence(episodes: DataFrame, members: DataFrame, base: str = "conservative", wider: str = "balanced") -> DataFrame:
    """A row for each base episode: the wider components that hold its members, and how many base episodes and members these hold, and whether they cross splits.

    Where a base episode lies in one wider component, as it does when the wider policy joins all that the base joins, its numbers are those of the component, so that no
    pairs of base episodes are made. Only episodes in several components are compared with what shares them.
    """
    links = _side(members, base, "episode_key").join(_side(members, wider, "wider_key"), "event_id").select("episode_key", "wider_key").distinct()
    sized = links.join(episodes.select("episode_key", "member_count", "split"), "episode_key")
    totals = (F.count("*").alias("sources"), F.sum("member_count").alias("members"), (F.min("split") != F.max("split")).alias("crosses"))
    of_wider = sized.groupBy("wider_key").agg(*totals)
    by = links.groupBy("episode_key").agg(F.array_sort(F.collect_list("wider_key")).alias("wider"))
    one = by.where("size(wider) = 1").join(of_wider, F.col("wider")[0] == F.col("wider_key")).drop("wider_key")
    several = by.where("size(wider) > 1")
    other = sized.select("wider_key", F.col("episode_key").alias("other"), "member_count", "split")
    pairs = several.select("episode_key", "wider", F.explode("wider").alias("wider_key")).join(other, "wider_key").dropDuplicates(["episode_key", "other"])
    many = pairs.groupBy("episode_key").agg(F.first("wider").alias("wider"), *totals)
    rows = one.unionByName(many).join(episodes, "episode_key")
    return rows.select(
        "episode_id",
        "episode_key",
        F.array_join(F.transform("wider", lambda w: w.cast("string")), ";").alias("related_wider"),
        "member_count",
        "duration_days",
        "state_count",
        "edge_count",
        "edge_rules",
        (F.col("sources") > 1).alias("wider_merges_several"),
        F.col("sources").alias("wider_source_count"),
        F.col("members").alias("wider_member_count"),
        F.coalesce("crosses", F.lit(False)).alias("wider_crosses_split"),
    )


def membership(episodes: DataFrame, members: DataFrame, reasons: Column, base: str = "conservative", wider: str = "balanced") -> DataFrame:
    """Each event of an episode with its sources, split, and what is to become of it: pending_review where the episode has a reason for it."""
    rows = _side(members, base, "episode_key").join(_side(members, wider, "wider_key"), "event_id", "left").join(episodes.withColumn("why", reasons), "episode_key")
    return rows.select("episode_id", "event_id", F.col("episode_key").alias("source_episode"), "wider_key", F.when(F.col("why") != "", "pending_review").otherwise("retained").alias("action"), F.col("why").alias("reason"), "split")


def checks(catalog: DataFrame, membership: DataFrame, splits: DataFrame, evidence: DataFrame, version: str) -> DataFrame:
    """(check, violations) of the eight rules of a sound catalog.

    catalog: episode_id, source_episode, geometry_valid. membership: episode_id, event_id, source_episode, split. splits and evidence: episode_id (splits: split).
    """
    one = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    def once(rows: DataFrame) -> DataFrame:
        """Episodes that do not have exactly one row, and rows of no episode."""
        n = rows.groupBy("episode_id").agg(F.count("*").alias("n"))
        return catalog.select("episode_id").distinct().withColumn("there", F.lit(True)).join(n, "episode_id", "full").where("there is null or n is null or n <> 1")

    n, s, x = member_digest(F.col("event_id"))
    ids = membership.groupBy("episode_id").agg(n.alias("n"), s.alias("s"), x.alias("x")).withColumn("own", digest_text(F.col("n"), F.col("s"), F.col("x"), version))
    listed = catalog.select("episode_id").distinct()
    lineage = catalog.where("source_episode is null").select(F.lit(1)).unionAll(membership.where("source_episode is null").select(F.lit(1)))
    known = splits.groupBy("episode_id").agg(F.max("split").alias("own_split"))
    leaks = membership.join(known, "episode_id", "left").where(~F.col("split").eqNullSafe(F.col("own_split")))
    found = [
        one("unique_event_membership", membership.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")),
        one("one_split_per_episode", once(splits)),
        one("stable_ids", ids.join(listed, "episode_id", "left_semi").where("own <> episode_id")),
        one("membership_episode_lineage", listed.withColumn("a", F.lit(1)).join(ids.select("episode_id", F.lit(1).alias("b")), "episode_id", "full").where("a is null or b is null")),
        one("source_lineage_present", lineage),
        one("valid_episode_geometry", catalog.where("not coalesce(geometry_valid, false)")),
        one("one_evidence_row_per_episode", once(evidence)),
        one("membership_split_integrity", leaks),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

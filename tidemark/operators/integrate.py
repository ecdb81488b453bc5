"""Integration of phase rows with plans, repeats and episodes, and what does not fit together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_present


def integrate(base: DataFrame, plan: DataFrame, repeats: DataFrame, episodes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every base row with its plan row, repeat row and episode row, and each field from the first of them that has it (empty text counts as missing).

    A plan row for the exact repeat goes before one for the request alone (repeat_id null). plan_match tells which was found.
    """
    exact = plan.where("repeat_id is not null")
    whole = plan.where("repeat_id is null").drop("repeat_id")
    named = lambda df, keys, p: df.select(*keys, F.lit(True).alias(f"{p}_found"), *[F.col(c).alias(f"{p}_{c}") if c in df.columns else F.lit(None).cast("string").alias(f"{p}_{c}") for c in fields])
    out = base.join(named(exact, ["request_id", "repeat_id"], "exact"), ["request_id", "repeat_id"], "left").join(named(whole, ["request_id"], "whole"), ["request_id"], "left")
    out = out.join(named(repeats, ["request_id", "repeat_id", "concept_id"], "repeat"), ["request_id", "repeat_id", "concept_id"], "left").join(named(episodes, ["request_id", "concept_id"], "episode"), ["request_id", "concept_id"], "left")
    values = [first_present(*([c] if c in base.columns else []), f"exact_{c}", f"whole_{c}", f"repeat_{c}", f"episode_{c}").alias(f"{c}_value") for c in fields]
    match = F.when(F.col("exact_found"), "exact").when(F.col("whole_found"), "request").otherwise("none")
    rest = [c for c in base.columns if c not in ("request_id", "repeat_id", "concept_id", *fields)]
    return out.select("request_id", "repeat_id", "concept_id", *rest, *values, match.alias("plan_match"), F.coalesce("repeat_found", F.lit(False)).alias("repeat_match"), F.coalesce("episode_found", F.lit(False)).alias("episode_match"))


def join_summary(integrated: DataFrame) -> DataFrame:
    """How many rows found each kind of partner."""
    n = lambda c: F.sum(c.cast("long"))
    return integrated.agg(F.count("*").alias("rows"), n(F.col("plan_match") == "exact").alias("exact_plans"), n(F.col("plan_match") == "request").alias("request_plans"), n(F.col("plan_match") == "none").alias("no_plan"), n(~F.col("repeat_match")).alias("no_repeat"), n(~F.col("episode_match")).alias("no_episode"))


def orphans(base: DataFrame, planned: DataFrame, repeats: DataFrame, episodes: DataFrame) -> DataFrame:
    """Keys without a partner, both ways: source, direction, request_id, repeat_id, concept_id.

    planned: request_id and concept_ids, a list in one text separated by semicolons.
    """
    keys = ["request_id", "repeat_id", "concept_id"]
    wanted = planned.select("request_id", F.explode(F.split("concept_ids", ";")).alias("concept_id")).where("trim(concept_id) <> ''")
    none = F.lit(None).cast("string").alias("repeat_id")

    def rows(df, source, direction, repeat=True):
        return df.select(F.lit(source).alias("source"), F.lit(direction).alias("direction"), "request_id", "repeat_id" if repeat else none, "concept_id").distinct()

    pair = ["request_id", "concept_id"]
    return (
        rows(base.join(repeats, keys, "left_anti"), "repeat", "base_without")
        .unionByName(rows(base.join(episodes, pair, "left_anti"), "episode", "base_without"))
        .unionByName(rows(repeats.join(base, keys, "left_anti"), "repeat", "without_base"))
        .unionByName(rows(episodes.join(base, pair, "left_anti"), "episode", "without_base", False))
        .unionByName(rows(wanted.join(base, pair, "left_anti"), "plan", "without_base", False))
    )


def unmatched_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("source", "direction").agg(F.count("*").alias("n"))


def lineage_conflicts(sources: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields for which a request's sources (source, request_id, fields as text) disagree; missing values don't disagree."""
    stacked = sources.select("request_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in fields])).alias("x")).select("request_id", "x.*")
    return stacked.where("value is not null").groupBy("request_id", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), ";").alias("values"), F.count_distinct("value").alias("n")).where("n > 1")


def require_clean(violations: DataFrame, what: str, shown: int = 20) -> None:
    """Fails with the first few violations, if there are any."""
    rows = violations.orderBy(*violations.columns).limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))

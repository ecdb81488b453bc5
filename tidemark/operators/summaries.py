"""Summaries and paired diagnostics of every response and phase metric, in which each request and concept has one vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from .describe import finite, unpivoted
from .series import KEYS

UNIT = ("request_id", "concept_id")


def described(rules: Rules) -> list[str]:
    """The metrics that are summed up: baseline, response and each phase's mean, largest value and lift."""
    response = ["baseline_mean", "baseline_median", "baseline_sd", "baseline_mad", "event_mean", "post_mean", "lift_absolute", "days_to_peak", "zero_share", "peak_value"]
    return response + [f"{p}_{x}" for p in rules.phases for x in ("mean", "max", "lift")]


def repeated(rules: Rules) -> list[str]:
    """The metrics whose repeats are compared: also ratios and standardised and robust lifts, of the response, of its dominant phase, and of each phase."""
    more = ["lift_ratio", "lift_z", "lift_robust", "peak_standardized", "dominant_standardized", "dominant_robust"]
    return described(rules) + more + [f"{p}_{x}" for p in rules.phases for x in ("standardized", "robust")]


def joined(responses: DataFrame, phases: DataFrame, plan: DataFrame, families: DataFrame, rules: Rules) -> DataFrame:
    """One row for each series with all its metrics, and what its request and concept are."""
    of = lambda x: F.coalesce(*[F.when(F.col("dominant_phase") == p, F.col(f"{p}_{x}")) for p in rules.phases])
    own = [c for c in phases.columns if c not in responses.columns or c in KEYS]
    rows = responses.join(phases.select(*own), list(KEYS)).withColumn("dominant_standardized", of("standardized")).withColumn("dominant_robust", of("robust"))
    return rows.join(plan.select("request_id", "episode_id", "geography", "role"), "request_id", "left").join(families, "concept_id", "left")


def unit_summaries(rows: DataFrame, metrics: list[str], meta: tuple[str, ...] = ("episode_id", "geography", "family", "role")) -> DataFrame:
    """Each metric over the repeats of each request and concept: rows, valid, missing and not finite values, mean, median, extremes, sample deviation."""
    long = unpivoted(rows, metrics, [*UNIT, *meta])
    v = F.when(finite("value"), F.col("value"))
    return long.groupBy(*UNIT, *meta, "metric").agg(
        F.count("*").alias("repeat_count"),
        F.count(v).alias("valid_repeat_count"),
        F.count_if(F.col("value").isNull()).alias("missing_count"),
        F.count_if(F.col("value").isNotNull() & ~finite("value")).alias("not_finite_count"),
        F.avg(v).alias("repeat_mean"),
        F.median(v).alias("repeat_median"),
        F.min(v).alias("repeat_minimum"),
        F.max(v).alias("repeat_maximum"),
        F.stddev_samp(v).alias("within_sd"),
    )


def metric_summaries(units: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each metric over unit means, all together or by some property of the unit: how many rows, units, requests, episodes, geographies and concepts stand behind it,
    its quartiles and spread, and how many units are zero, positive and negative."""
    v = F.col("repeat_mean")
    valid = lambda c: F.count_distinct(F.when(v.isNotNull(), F.col(c)))
    out = units.groupBy(*by, "metric").agg(
        F.sum("repeat_count").alias("repeat_rows"),
        F.sum("valid_repeat_count").alias("valid_values"),
        F.sum("missing_count").alias("missing_values"),
        F.sum("not_finite_count").alias("not_finite_values"),
        F.count("*").alias("units"),
        F.count(v).alias("valid_units"),
        valid("request_id").alias("requests"),
        valid("episode_id").alias("episodes"),
        valid("geography").alias("geographies"),
        valid("concept_id").alias("concepts"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.median(v).alias("median"),
        F.stddev_samp(v).alias("sample_sd"),
        F.percentile(v, F.lit(0.25)).alias("first_quartile"),
        F.percentile(v, F.lit(0.75)).alias("third_quartile"),
        F.count_if(v == 0).alias("zeros"),
        F.count_if(v > 0).alias("positive"),
        F.count_if(v < 0).alias("negative"),
    )
    return out.withColumn("interquartile_range", F.col("third_quartile") - F.col("first_quartile"))


def repeat_pairs(rows: DataFrame, metrics: list[str], meta: tuple[str, ...] = ("episode_id", "geography", "family", "role"), least: float = 1e-12) -> DataFrame:
    """The two repeats of each request and concept side by side, metric by metric; a unit without exactly two repeats and two finite values has no differences, and a reason.

    relative_difference is the absolute difference over the absolute mean, where that is more than least.
    """
    long = unpivoted(rows, metrics, [*UNIT, *meta, "repeat_id"])
    v = F.when(finite("value"), F.col("value"))
    out = long.groupBy(*UNIT, *meta, "metric").agg(
        F.count_distinct("repeat_id").alias("repeats"),
        F.count("*").alias("n"),
        F.count(v).alias("valid"),
        F.min("repeat_id").alias("first_repeat_id"),
        F.max("repeat_id").alias("second_repeat_id"),
        F.min_by(v, "repeat_id").alias("first_value"),
        F.max_by(v, "repeat_id").alias("second_value"),
    )
    reason = F.when((F.col("repeats") != 2) | (F.col("n") != 2), "not_two_repeats").when(F.col("valid") != 2, "missing_value")
    ok = lambda c: F.when(reason.isNull(), c)
    d, mean = F.col("second_value") - F.col("first_value"), (F.col("first_value") + F.col("second_value")) / 2
    enough = reason.isNull() & (F.abs(mean) > least)
    return out.select(
        *UNIT,
        *meta,
        "metric",
        "first_repeat_id",
        F.when(F.col("repeats") > 1, F.col("second_repeat_id")).alias("second_repeat_id"),
        "first_value",
        F.when(F.col("repeats") > 1, F.col("second_value")).alias("second_value"),
        ok(d).alias("signed_difference"),
        ok(F.abs(d)).alias("absolute_difference"),
        ok(mean).alias("pair_mean"),
        ok(F.abs(d) / F.sqrt(F.lit(2.0))).alias("within_pair_sd"),
        F.when(enough, F.abs(d) / F.abs(mean)).alias("relative_difference"),
        F.coalesce(enough, F.lit(False)).alias("relative_difference_eligible"),
        reason.alias("exclusion_reason"),
    )

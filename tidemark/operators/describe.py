"""Descriptive summaries in which every unit has equal weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import correlation, population_sd


def finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def unpivoted(rows: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def request_summaries(rows: DataFrame, metrics: list[str], dims: list[str]) -> DataFrame:
    """Each metric over a request's repeats: rows, valid, missing, not finite, mean, median, extremes, sample deviation."""
    long = unpivoted(rows, metrics, [*dims, "repeat_id"])
    v = F.when(finite("value"), F.col("value"))
    return long.groupBy(*dims, "metric").agg(
        F.count("*").alias("n"), F.count(v).alias("valid"), F.sum(F.col("value").isNull().cast("long")).alias("missing"), F.sum((F.col("value").isNotNull() & ~finite("value")).cast("long")).alias("not_finite"),
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_samp(v).alias("sd"),
    )


def over_groups(summaries: DataFrame, groups: list[list[str]]) -> DataFrame:
    """The requests' means, equally weighted, over several groupings at once (grouping sets); scope names each row's grouping."""
    dims = sorted({c for g in groups for c in g})
    v = F.col("mean")
    sets = [[F.col(c) for c in [*g, "metric"]] for g in groups]
    scope = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])
    return summaries.groupingSets(sets, *dims, "metric").agg(
        scope.alias("scope"), F.count(v).alias("units"), F.avg(v).alias("average"), F.median(v).alias("middle"), F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.75)).alias("q3"), F.stddev_samp(v).alias("spread"),
        F.sum((v == 0).cast("long")).alias("zeros"), F.sum((v > 0).cast("long")).alias("positive"), F.sum((v < 0).cast("long")).alias("negative"),
    )


def paired_diagnostics(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Differences of the two repeats of each request, concept and metric; units without exactly two repeats and two finite values have none and a reason."""
    long = unpivoted(rows, metrics, ["request_id", "concept_id", "repeat_id"])
    v = F.when(finite("value"), F.col("value"))
    out = long.groupBy("request_id", "concept_id", "metric").agg(F.count_distinct("repeat_id").alias("repeats"), F.count(v).alias("valid"), F.min_by("value", "repeat_id").alias("first"), F.max_by("value", "repeat_id").alias("second"))
    ok = (F.col("repeats") == 2) & (F.col("valid") == 2)
    d = F.when(ok, F.col("second") - F.col("first"))
    size = (F.abs("first") + F.abs("second")) / 2
    reason = F.when(F.col("repeats") != 2, "not_two_repeats").when(F.col("valid") != 2, "missing_value")
    return out.select("request_id", "concept_id", "metric", "repeats", "valid", d.alias("difference"), F.abs(d).alias("absolute_difference"), (F.abs(d) / F.sqrt(F.lit(2.0))).alias("pair_sd"), F.when(size > 1e-12, F.abs(d) / size).alias("relative_difference"), reason.alias("exclusion_reason"))


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 within keys; ties share the mean of their ranks."""
    order, ties = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    return rows.withColumn(name, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)


def rank_agreement(rows: DataFrame, metrics: list[str], least: int = 3) -> DataFrame:
    """Spearman correlation of the concepts' order between the two repeats of each request and metric."""
    long = unpivoted(rows, metrics, ["request_id", "repeat_id", "concept_id"]).where(finite("value"))
    a = long.select("request_id", "metric", "concept_id", F.col("repeat_id").alias("first"), F.col("value").alias("x"))
    b = long.select("request_id", "metric", "concept_id", F.col("repeat_id").alias("second"), F.col("value").alias("y"))
    keys = ["request_id", "metric", "first", "second"]
    pairs = a.join(b, ["request_id", "metric", "concept_id"]).where("first < second")
    ranked = average_ranks(average_ranks(pairs, keys, "x", "rx"), keys, "y", "ry")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("concepts"), correlation("rx", "ry", least).alias("spearman"))
    return out.withColumn("exclusion_reason", F.when(F.col("concepts") < least, "too_few_concepts").when(F.col("spearman").isNull(), "constant"))


def exclusions(summaries: DataFrame, pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """A ledger of what the summaries left out: kind, request_id, concept_id, metric, reason."""
    row = lambda df, kind, concept, reason: df.select(F.lit(kind).alias("kind"), "request_id", concept.alias("concept_id"), "metric", reason.alias("reason"))
    values = summaries.where("missing + not_finite > 0")
    return (
        row(values, "value", F.col("concept_id"), F.when(F.col("not_finite") > 0, "not_finite").otherwise("missing"))
        .unionByName(row(pairs.where("exclusion_reason is not null"), "pair", F.col("concept_id"), F.col("exclusion_reason")))
        .unionByName(row(ranks.where("exclusion_reason is not null"), "rank", F.lit(None).cast("string"), F.col("exclusion_reason")))
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def column_audit(rows: DataFrame) -> DataFrame:
    """For each column: rows, nulls, null share, distinct values, extremes as text, finite numbers, and its character."""
    def character(name: str, kind: str) -> str:
        if kind == "boolean" or name.startswith("is_"):
            return "flag"
        if kind in ("double", "float") or kind.startswith("decimal"):
            return "bounded" if any(w in name for w in ("share", "fraction", "discount")) else "continuous"
        return "count" if kind in ("bigint", "int", "smallint", "tinyint") else "label"

    parts = []
    for name, kind in rows.dtypes:
        numeric = kind in ("double", "float")
        parts += [F.count(F.col(name)).alias(f"{name}\x1fn"), F.count_distinct(F.col(name)).alias(f"{name}\x1fd"), F.min(F.col(name)).cast("string").alias(f"{name}\x1fl"), F.max(F.col(name)).cast("string").alias(f"{name}\x1fm"), (F.sum(finite(name).cast("long")) if numeric else F.count(F.col(name))).alias(f"{name}\x1ff")]
    one = rows.agg(F.count("*").alias("rows"), *parts)
    stacked = [F.struct(F.lit(n).alias("column"), F.lit(character(n, k)).alias("character"), F.col(f"{n}\x1fn").alias("present"), F.col(f"{n}\x1fd").alias("values"), F.col(f"{n}\x1fl").alias("least"), F.col(f"{n}\x1fm").alias("most"), F.col(f"{n}\x1ff").alias("finite")) for n, k in rows.dtypes]
    out = one.select("rows", F.explode(F.array(*stacked)).alias("c")).select("rows", "c.*")
    return out.withColumn("null_share", F.when(F.col("rows") > 0, 1 - F.col("present") / F.col("rows")))


def metric_viability(rows: DataFrame, metrics: list[str], least_units: int = 3) -> DataFrame:
    """For each metric: independent requests and concepts with finite values, units with two repeats, statistics, and why it can't be used."""
    long = unpivoted(rows, metrics, ["request_id", "concept_id", "repeat_id"]).where(finite("value"))
    unit = long.groupBy("metric", "request_id", "concept_id").agg(F.count_distinct("repeat_id").alias("repeats"), F.avg("value").alias("v"))
    out = unit.groupBy("metric").agg(F.count_distinct("request_id").alias("requests"), F.count_distinct("concept_id").alias("concepts"), F.count("*").alias("units"), F.sum((F.col("repeats") >= 2).cast("long")).alias("repeated_units"), F.avg("v").alias("mean"), population_sd(F.col("v")).alias("sd"))
    return out.withColumn("reason", F.when(F.col("units") < least_units, "too_few_units").when(F.col("repeated_units") == 0, "not_repeated").when(F.coalesce("sd", F.lit(0.0)) <= 1e-12, "constant").otherwise("usable"))


def group_coverage(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and distinct requests of every value of every dimension, in one pass."""
    out = rows.groupingSets([[F.col(c)] for c in dims], *dims).agg(F.concat_ws("", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims]).alias("dimension"), F.count("*").alias("rows"), F.count_distinct("request_id").alias("requests"))
    return out.select("dimension", F.coalesce(*[F.col(c).cast("string") for c in dims]).alias("value"), "rows", "requests")


def repeat_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("request_id", "concept_id").agg(F.count_distinct("repeat_id").alias("repeats"), F.array_join(F.array_sort(F.collect_set("repeat_id")), ";").alias("repeat_ids"), (F.count_distinct("repeat_id") == 2).alias("pair"))


def readiness(rows: DataFrame, viability: DataFrame, roles: DataFrame) -> DataFrame:
    """One row: usable metrics, paired units, whether treated and control requests share a concept, and a recommendation."""
    seen = rows.join(roles, "request_id").groupBy("episode_id", "concept_id").agg(F.bool_or(F.col("role") == "treated").alias("t"), F.bool_or(F.col("role") == "control").alias("c"))
    matched = seen.agg(F.sum((F.col("t") & F.col("c")).cast("long")).alias("matched_concepts"))
    usable = viability.agg(F.sum((F.col("reason") == "usable").cast("long")).alias("usable_metrics"), F.count("*").alias("metrics"))
    pairs = repeat_coverage(rows).agg(F.sum(F.col("pair").cast("long")).alias("paired_units"))
    out = usable.crossJoin(pairs).crossJoin(matched)
    return out.withColumn("recommendation", F.when(F.col("usable_metrics") == 0, "collect_more").when(F.col("matched_concepts") == 0, "add_controls").when(F.col("paired_units") == 0, "repeat_requests").otherwise("ready"))

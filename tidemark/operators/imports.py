"""Import of observations: parsing, idempotent append, checks, attempts, and what the imported terms are good for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import iso_date

IDENTITY = ["request_id", "repeat_id", "concept_id", "date"]


def parsed_interest(text: Column) -> dict[str, Column]:
    """interest, is_partial, low_volume, value_class and problem of an exported value: blank is null, <n is 0 of low volume, a mark of partial data at the end is read as such, and
    anything else must be a number from 0 to 100."""
    bare = F.trim(text)
    partial = bare.rlike(r"(isPartial|\(partial\))$")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"isPartial$", ""), r"\(partial\)$", ""))
    blank = bare.isNull() | bare.isin("", "N/A", "NA", "null")
    low = bare.startswith("<")
    value = F.when(blank, None).when(low, 0.0).otherwise(bare.try_cast("double"))
    bad = ~blank & (value.isNull() | ~value.between(0, 100) | F.isnan(value))
    partial = F.coalesce(partial, F.lit(False))
    kind = F.when(bad, None).when(blank, F.when(partial, "partial").otherwise("missing")).when(low, "reported_zero_low_volume").when(value == 0, "reported_zero_relative_scale").otherwise("true_zero_unknown")
    return {"interest": F.when(~F.coalesce(bad, F.lit(False)), value), "is_partial": partial, "low_volume": F.coalesce(low, F.lit(False)), "value_class": kind, "problem": F.when(bad, "bad_value")}


def export_date(text: Column) -> Column:
    return iso_date(F.substring(F.trim(F.split_part(text, F.lit(" - "), F.lit(1))), 1, 10))


def long_observations(cells: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Observations from cells of exports (source_file, date_text, position, label, value_text) and their sidecars, matched by file stem and position; label_matches tells whether
    the header has the label asked for. A sidecar without a repeat takes one from the file's hash."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    asked = sidecars.where("problem is null").select(stem(F.col("sidecar_file")).alias("stem"), "request_id", "repeat_id", "requested_concepts", "requested_labels")
    rows = cells.withColumn("stem", stem(F.col("source_file"))).join(asked, "stem")
    fields = parsed_interest(F.col("value_text"))
    label = F.get("requested_labels", F.col("position"))
    repeat = F.coalesce("repeat_id", F.substring("file_sha256", 1, 16))
    return rows.select("source_file", "request_id", repeat.alias("repeat_id"), F.get("requested_concepts", F.col("position")).alias("concept_id"), export_date(F.col("date_text")).alias("date"), *[c.alias(n) for n, c in fields.items()], F.lower("label").contains(F.lower(label)).alias("label_matches"))


def conflicts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose identity is known with another value."""
    old = existing.select(*IDENTITY, F.col("interest").alias("old_interest"), F.col("is_partial").alias("old_partial"))
    return new.join(old, IDENTITY).where(~(F.col("interest").eqNullSafe(F.col("old_interest")) & F.col("is_partial").eqNullSafe(F.col("old_partial")))).select(*IDENTITY, "interest", "old_interest")


def additions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows of unknown identity; of rows that repeat one, the smallest value stays."""
    one = new.groupBy(*IDENTITY).agg(F.min_by(F.struct("interest", "is_partial"), F.struct("interest", "is_partial")).alias("v")).select(*IDENTITY, "v.*")
    return one.join(existing, IDENTITY, "left_anti")


def merged(existing: DataFrame, new: DataFrame) -> DataFrame:
    columns = [*IDENTITY, "interest", "is_partial"]
    return existing.select(columns).unionByName(additions(existing, new).select(columns))


def import_checks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: observations, identities that repeat, requests the plan lacks, partial and missing values, values outside 0 to 100."""
    repeated = rows.groupBy(*IDENTITY).count().where("count > 1").agg(F.count("*").alias("repeated_identities"))
    unplanned = rows.select("request_id").distinct().join(plan, "request_id", "left_anti").agg(F.count("*").alias("unplanned_requests"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = rows.agg(F.count("*").alias("rows"), n(F.col("is_partial")).alias("partial"), n(F.col("interest").isNull()).alias("missing"), n(~F.col("interest").between(0, 100)).alias("outside"))
    return one.crossJoin(repeated).crossJoin(unplanned)


def admission_violations(rows: DataFrame, plan: DataFrame, synthetic_allowed: bool = False) -> DataFrame:
    """(request_id, repeat_id, concept_id, date, problem) of observations that may not enter the final analysis: outside the plan (request_id, planned_repeat_id, concept_ids by semicolons),
    of a repeated identity, without a partial flag, out of range, or made up where only observed ones may be."""
    asked = plan.select("request_id", F.col("planned_repeat_id").alias("repeat_id"), F.explode(F.split("concept_ids", ";")).alias("concept_id")).distinct()
    row = lambda df, name: df.select(*IDENTITY, F.lit(name).alias("problem"))
    out = row(rows.join(asked, ["request_id", "repeat_id", "concept_id"], "left_anti"), "outside_plan")
    out = out.unionByName(row(rows.groupBy(*IDENTITY).count().where("count > 1"), "repeated_identity")).unionByName(row(rows.where("is_partial is null"), "no_partial_flag"))
    out = out.unionByName(row(rows.where(F.isnan("interest") | ~F.col("interest").between(0, 100)), "out_of_range"))
    if not synthetic_allowed and "data_origin" in rows.columns:
        out = out.unionByName(row(rows.where("data_origin = 'synthetic_fixture'"), "synthetic"))
    return out


def export_profile(rows: DataFrame, file: str = "source_file") -> DataFrame:
    """For each file: rows, values, zeros, partial ones, first and last date, dates that repeat."""
    n = lambda c: F.sum(c.cast("long"))
    by = rows.groupBy(file, "concept_id", "date").agg(F.count("*").alias("k"), F.count("interest").alias("values"), n(F.coalesce(F.col("interest") == 0, F.lit(False))).alias("zeros"), n(F.col("is_partial")).alias("partial"))
    return by.groupBy(file).agg(F.sum("k").alias("rows"), F.sum("values").alias("values"), F.sum("zeros").alias("zeros"), F.sum("partial").alias("partial"), F.min("date").alias("first"), F.max("date").alias("last"), n(F.col("k") > 1).alias("repeated_dates"))


def latest_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The last attempt (by time, then id) of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("attempted_at"), F.desc("attempt_id"))
    return attempts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def export_status(attempts: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Planned keys by the status of their last attempt; not_started where there is none. retry tells which statuses are tried again."""
    rows = plan.select(*keys).distinct().join(latest_attempts(attempts, keys), keys, "left").withColumn("status", F.coalesce("status", F.lit("not_started")))
    return rows.groupBy("status").agg(F.count("*").alias("keys")).withColumn("retry", F.col("status").isin("failed", "not_started"))


def source_differences(stored: DataFrame, reread: DataFrame) -> DataFrame:
    """Identities for which stored and re-read observations differ: missing on a side, another value, another partial flag."""
    a = stored.select(*IDENTITY, F.struct("interest", "is_partial").alias("s"))
    b = reread.select(*IDENTITY, F.struct("interest", "is_partial").alias("r"))
    rows = a.join(b, IDENTITY, "full").where(~F.col("s").eqNullSafe(F.col("r")))
    kind = F.when(F.col("r").isNull(), "not_in_source").when(F.col("s").isNull(), "not_stored").when(~F.col("s.interest").eqNullSafe(F.col("r.interest")), "value").otherwise("partial_flag")
    return rows.select(*IDENTITY, kind.alias("difference"))


def term_feasibility(metrics: DataFrame, seasons: DataFrame, least: float = 0.5) -> DataFrame:
    """For each concept: share of usable series, median lift, deviation of its seasonal means, coverage, and a class. seasons: request_id, season."""
    rows = metrics.join(seasons, "request_id")
    seasonal = rows.groupBy("concept_id", "season").agg(F.avg("baseline_mean").alias("m")).groupBy("concept_id").agg(F.stddev_pop("m").alias("seasonal_sd"), F.count("*").alias("seasons"))
    by = rows.groupBy("concept_id").agg(F.count("*").alias("series"), F.avg((F.col("quality") == "usable").cast("double")).alias("usable_share"), F.median("lift_robust").alias("median_lift"), F.avg("baseline_days").alias("coverage"), F.avg("zero_share").alias("zero_share"))
    out = by.join(seasonal, "concept_id")
    cls = F.when(F.col("series") == 0, "no_data").when(F.col("zero_share") >= 0.9, "suppressed").when(F.col("usable_share") == 0, "unusable").when(F.col("usable_share") < least, "sparse").when(F.col("median_lift").isNull(), "flat").when(F.col("median_lift") > 1, "responsive").otherwise("stable")
    return out.withColumn("feasibility", cls)


def episode_feasibility(metrics: DataFrame, families: DataFrame, roles: DataFrame) -> DataFrame:
    """For each request: series, usable ones, the best concept of each family (largest robust lift, ties by name), and a status."""
    rows = metrics.join(F.broadcast(families), "concept_id").join(roles, "request_id")
    best = lambda f: F.min_by(F.when(F.col("family") == f, F.col("concept_id")), F.when((F.col("family") == f) & F.col("lift_robust").isNotNull(), F.struct((-F.col("lift_robust")).alias("l"), F.col("concept_id"))))
    out = rows.groupBy("request_id", "role").agg(F.count("*").alias("series"), F.sum((F.col("quality") == "usable").cast("long")).alias("usable"), *[best(f).alias(f"best_{f}") for f in ("demand", "awareness", "weather")])
    return out.withColumn("status", F.when(F.col("usable") == 0, "not_feasible").when(F.col("usable") < F.col("series"), "partly_feasible").otherwise("feasible"))


def broad_specific(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Broad against specific concepts on the requests and repeats that both have. pairs: broad_id, specific_id."""
    side = lambda p: metrics.select("request_id", "repeat_id", F.col("concept_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("lift_absolute", "zero_share", "quality")])
    rows = F.broadcast(pairs).join(side("broad"), "broad_id").join(side("specific"), ["specific_id", "request_id", "repeat_id"])
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("broad_id", "specific_id").agg(F.count("*").alias("shared"), F.avg(F.col("broad_lift_absolute") - F.col("specific_lift_absolute")).alias("mean_difference"), n(F.col("broad_lift_absolute") > F.col("specific_lift_absolute")).alias("broad_larger"), n((F.col("broad_quality") == "usable") & (F.col("specific_quality") != "usable")).alias("only_broad_usable"))


def top_rows(metrics: DataFrame, selectors: dict[str, Column]) -> DataFrame:
    """The row with the largest score of each selector; ties to the names last in order."""
    key = lambda s: F.struct(s, "request_id", "repeat_id", "concept_id")
    one = metrics.agg(*[F.max_by(F.struct("request_id", "repeat_id", "concept_id", s.alias("score")), F.when(s.isNotNull(), key(s))).alias(n) for n, s in selectors.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("selector"), F.col(f"{n}.request_id"), F.col(f"{n}.repeat_id"), F.col(f"{n}.concept_id"), F.col(f"{n}.score")) for n in selectors])).alias("r")).select("r.*")

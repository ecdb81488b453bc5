"""Cohort of events: domains, exclusion reasons, status, splits, temporal quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import reasons
from ..sources.tables import written
from . import selection
from .integrity import guarded

#: Reasons in order of priority.
REASONS = ("outside_domain", "missing_start", "outside_window", "negative_duration", "no_state", "review_required")


def states_of(events: DataFrame, bridge: DataFrame) -> DataFrame:
    """events with state_set: the states of the bridge (event_id, state), else the primary state alone."""
    by = bridge.groupBy("event_id").agg(F.array_sort(F.collect_set("state")).alias("found"))
    alone = F.when(F.col("primary_state").isNotNull(), F.array("primary_state")).otherwise(F.array().cast("array<string>"))
    return events.join(by, "event_id", "left").withColumn("state_set", F.coalesce("found", alone)).drop("found")


def intersecting(events: DataFrame, columns: tuple[str, ...] = ("intersects_us_state_union", "intersects_united_states")) -> DataFrame:
    """Events that intersect the country, by the first of these flags that the table has. A null flag is no."""
    have = next((c for c in columns if c in events.columns), None)
    if have is None:
        raise ValueError(f"none of {columns} in the table")
    return events.where(F.coalesce(F.col(have), F.lit(False)))


def with_domain(events: DataFrame, domains: DataFrame) -> DataFrame:
    """events with study_domain: the one domain of their states, multi_domain, or unclassified. domains: state, domain, a small dimension."""
    each = events.select("event_id", F.explode("state_set").alias("state")).join(F.broadcast(domains), "state")
    by = each.groupBy("event_id").agg(F.array_sort(F.collect_set("domain")).alias("d"))
    domain = F.when(F.col("d").isNull(), "unclassified").when(F.size("d") == 1, F.get("d", F.lit(0))).otherwise("multi_domain")
    return events.join(by, "event_id", "left").withColumn("study_domain", domain).drop("d")


def classified(events: DataFrame, primary_domains: list[str], secondary_domains: list[str], first: str, last: str) -> DataFrame:
    """events with exclusion reasons (primary and the others) and a status: eligible, secondary_domain or excluded."""
    known = F.size("state_set") > 0
    inside = F.col("study_domain").isin(*primary_domains, *secondary_domains)
    why = reasons((known & ~inside, REASONS[0]), (F.col("start").isNull(), REASONS[1]), (~F.col("start").between(F.lit(first).cast("date"), F.lit(last).cast("date")), REASONS[2]), (F.col("end") < F.col("start"), REASONS[3]), (~known, REASONS[4]), (F.col("review"), REASONS[5]))
    out = events.withColumn("why", why)
    status = F.when(F.size("why") > 0, "excluded").when(F.col("study_domain").isin(*primary_domains), "eligible").otherwise("secondary_domain")
    return out.withColumn("primary_reason", F.get("why", F.lit(0))).withColumn("other_reasons", F.array_join(F.slice("why", 2, F.greatest(F.size("why") - 1, F.lit(0))), ";")).withColumn("cohort_status", status).drop("why")


def split_of(start: Column, windows: list[tuple[str, str, str]]) -> Column:
    """Name of the first window (name, first day, last day) that holds a date; null outside all."""
    return F.coalesce(*[F.when(start.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in windows])


def require_split(rows: DataFrame, start: str, windows: list[tuple[str, str, str]]) -> DataFrame:
    """rows with split; a start outside all windows, or none, stops whatever reads the result with an error that names the first of them."""
    out = rows.withColumn("split", split_of(F.col(start), windows))
    return guarded(out, out.where("split is null").select(F.col(start).cast("string").alias(start)).distinct(), "dates outside all splits")


def year_split(start: Column) -> Column:
    return F.when(F.year(start) <= 2023, "development").when(F.year(start) == 2024, "validation").otherwise("test")


def exclusion_counts(cohort: DataFrame) -> DataFrame:
    first = cohort.where("primary_reason is not null").select(F.lit("primary").alias("role"), F.col("primary_reason").alias("reason"))
    rest = cohort.where("other_reasons <> ''").select(F.lit("secondary").alias("role"), F.explode(F.split("other_reasons", ";")).alias("reason"))
    return first.unionByName(rest).groupBy("role", "reason").agg(F.count("*").alias("events"))


def state_year_counts(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("primary_state", F.year("start").alias("year"), "split", "cohort_status", "study_domain", "primary_reason").agg(F.count("*").alias("events"))


def temporal_quality(cohort: DataFrame) -> DataFrame:
    """For all and for eligible events: missing ends, negative, same-day and long durations, and nearest-rank percentiles of the duration."""
    days = F.datediff("end", "start")
    scopes = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("cohort_status") == "eligible", "eligible"))))
    rows = cohort.select(scopes.alias("scope"), "start", "end", days.alias("days"))
    n = lambda c: F.sum(c.cast("long"))
    counts = rows.groupBy("scope").agg(
        F.count("*").alias("events"),
        n(F.col("end").isNull()).alias("missing_end"),
        n(F.col("days") < 0).alias("negative"),
        n(F.col("days") == 0).alias("same_day"),
        *[n(F.col("days") > k).alias(f"over_{k}") for k in (1, 3, 7, 30)],
    )
    names = [f"p{p}" for p in (50, 90, 95, 99)]
    durations = written(rows.where("days >= 0").select("scope", "days"), "durations")
    ranks = selection.discrete(durations, ("scope",), "days", {name: int(name[1:]) / 100 for name in names})
    return counts.join(ranks, "scope", "left").select(*counts.columns, *[F.col(name).cast("int").alias(name) for name in names])


def monthly_counts(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy(F.date_format("start", "yyyy-MM").alias("month")).agg(F.count("*").alias("events"), F.sum((F.col("cohort_status") == "eligible").cast("long")).alias("eligible"))


def state_records(cohort: DataFrame, bridge: DataFrame) -> DataFrame:
    """Rows of the bridge (event_id, state) whose event is not excluded, with the event's dates and status, and whether the state is its primary one."""
    kept = cohort.where("cohort_status <> 'excluded'").select("event_id", "start", "end", "primary_state", "study_domain", "cohort_status")
    return bridge.join(kept, "event_id").withColumn("is_primary_state", F.col("state").eqNullSafe(F.col("primary_state")))

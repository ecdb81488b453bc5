"""Integrity of request plans: every rule of the design as rows that break it, and a check that stops a job inside its plan."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null
from ..sources.tables import written

PLAN_FIELDS = (
    "request_id",
    "planned_repeat_id",
    "episode_id",
    "role",
    "panel",
    "pair_id",
    "concept_ids",
    "terminology_version",
    "backend",
    "event_start",
    "event_end",
    "window_start",
    "window_end",
    "category",
    "search_property",
)


@dataclass(frozen=True)
class Design:
    """What every episode must be requested for: each role, panel and repeat once; panels maps names to their concepts."""

    roles: tuple[str, ...]
    panels: dict[str, tuple[str, ...]]
    repeats: tuple[str, ...]
    backends: tuple[str, ...]
    terminology: str
    retained: str = "retained"
    most_episodes: int | None = None

    def slots(self) -> list[tuple[str, str, str]]:
        return [(r, p, n) for r in self.roles for p in self.panels for n in self.repeats]


def _slot() -> Column:
    return F.concat_ws("/", "role", "panel", "planned_repeat_id")


def _own_problems(plan: DataFrame, design: Design) -> DataFrame:
    """Rules that a plan row breaks by itself."""
    listed = F.create_map(*[F.lit(x) for name, concepts in design.panels.items() for x in (name, ";".join(concepts))])
    found = [F.when(blank_to_null(F.col(c).cast("string")).isNull(), F.struct(F.lit("empty_field").alias("kind"), F.lit(c).alias("detail"))) for c in PLAN_FIELDS]
    for kind, condition, detail in (
        ("outside_design", ~_inside(design), _slot()),
        ("panel_concepts", ~F.col("concept_ids").eqNullSafe(F.try_element_at(listed, F.col("panel"))), F.col("panel")),
        ("terminology", ~F.col("terminology_version").eqNullSafe(F.lit(design.terminology)), F.col("terminology_version")),
        ("backend", ~F.coalesce(F.col("backend").isin(*design.backends), F.lit(False)), F.col("backend")),
    ):
        found.append(F.when(condition, F.struct(F.lit(kind).alias("kind"), F.coalesce(detail, F.lit("")).alias("detail"))))
    return _each(plan, found)


def _catalog_problems(plan: DataFrame, catalog: DataFrame, design: Design) -> DataFrame:
    """Rules that a plan row breaks against its episode in the catalog; only what they look at is dealt out."""
    by = catalog.groupBy("episode_id").agg(F.max("status").alias("status"), F.max("episode_start").alias("episode_start"), F.max("episode_end").alias("episode_end"), F.lit(True).alias("known"))
    rows = plan.select("episode_id", "request_id", "event_start", "event_end").join(by.hint("merge"), "episode_id", "left")  # never broadcast: files of a catalog may be far smaller than its rows
    known = F.coalesce("known", F.lit(False))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    found = []
    for kind, condition, detail in (
        ("not_in_catalog", ~known, F.lit("")),
        ("not_retained", known & ~F.col("status").eqNullSafe(F.lit(design.retained)), F.coalesce("status", F.lit(""))),
        ("dates_conflict", known & (differs("event_start", "episode_start") | differs("event_end", "episode_end")), F.lit("")),
    ):
        found.append(F.when(condition, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))))
    return _each(rows, found)


def _each(rows: DataFrame, found: list[Column]) -> DataFrame:
    rows = rows.select("episode_id", "request_id", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.select("x.kind", F.col("episode_id").cast("string").alias("episode_id"), F.col("request_id").cast("string").alias("request_id"), "x.detail")


def _inside(design: Design) -> Column:
    """Whether a row is in a slot of the design; not, if one of its fields is null."""
    return F.coalesce(F.col("role").isin(*design.roles) & F.col("panel").isin(*design.panels) & F.col("planned_repeat_id").isin(*design.repeats), F.lit(False))


def _request_problems(rows: DataFrame) -> DataFrame:
    """Repeats that a request has twice, and requests whose rows differ in more than the repeat. rows: request_id, planned_repeat_id, episode_id, and s1 and s2, 128 bits of hash of the other fields."""
    each = rows.groupBy("request_id", "planned_repeat_id").agg(F.count("*").alias("n"), F.min("episode_id").alias("e"), *[f(c).alias(f"{n}_{c}") for c in ("s1", "s2") for n, f in (("a", F.min), ("b", F.max))])
    again = F.collect_list(F.when(F.col("n") > 1, F.struct(F.lit("repeated_request").alias("kind"), F.col("e").cast("string").alias("e"), F.col("planned_repeat_id").cast("string").alias("detail"))))
    changes = (F.min("a_s1") != F.max("b_s1")) | (F.min("a_s2") != F.max("b_s2"))
    by = each.groupBy("request_id").agg(again.alias("again"), changes.alias("changes"), F.min("e").alias("e"))
    changed = F.when(F.col("changes"), F.array(F.struct(F.lit("request_changes").alias("kind"), F.col("e").cast("string").alias("e"), F.lit("").alias("detail")))).otherwise(F.array())
    found = by.where("changes or size(again) > 0").select("request_id", F.explode(F.concat("again", changed)).alias("x"))
    return found.select("x.kind", F.col("x.e").alias("episode_id"), F.col("request_id").cast("string").alias("request_id"), "x.detail")


def design_violations(plan: DataFrame, catalog: DataFrame, design: Design) -> DataFrame:
    """(kind, episode_id, request_id, detail) of everything that keeps a plan from being the design over the catalog.

    The division of the plan by the design is one aggregate: rows of an episode are counted for each slot of the design, so that one row of an episode is dealt
    out, whatever the number of its rows in a task. Null and blank fields break empty_field; an empty plan breaks no_episode.
    """
    none = F.lit(None).cast("string")
    row = lambda df, kind, episode, request, detail: df.select(F.lit(kind).alias("kind"), episode.cast("string").alias("episode_id"), request.cast("string").alias("request_id"), detail.cast("string").alias("detail"))
    out = _own_problems(plan, design).unionByName(_catalog_problems(plan, catalog, design))

    # a hash passes nulls over, so that where they are is hashed too
    fields = [F.col(c).cast("string") for c in PLAN_FIELDS if c != "planned_repeat_id"]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in fields])
    rows = plan.select("request_id", "planned_repeat_id", "episode_id", F.xxhash64(nulls, *fields).alias("s1"), F.xxhash64(F.lit("2"), nulls, *fields).alias("s2"))
    # rows of a request are dealt out once; those without an id, which may be many, are first added up where they are
    named = blank_to_null(F.col("request_id").cast("string")).isNotNull()
    out = out.unionByName(_request_problems(rows.where(named).repartition("request_id"))).unionByName(_request_problems(rows.where(~named)))

    slots = design.slots()
    here = lambda r, p, n: F.count_if((F.col("role") == r) & (F.col("panel") == p) & (F.col("planned_repeat_id") == n))
    by = plan.groupBy("episode_id").agg(*[here(*s).alias(f"n{i}") for i, s in enumerate(slots)])
    which = lambda f: F.array_compact(F.array(*[F.when(f(F.col(f"n{i}")), F.lit("/".join(s))) for i, s in enumerate(slots)]))
    missing = F.array_join(which(lambda n: n == 0), ";")
    out = out.unionByName(row(by.where(missing != ""), "incomplete_design", F.col("episode_id"), none, missing))
    out = out.unionByName(row(by.select("episode_id", F.explode(which(lambda n: n > 1)).alias("slot")), "repeated_slot", F.col("episode_id"), none, F.col("slot")))
    beside = plan.where(~_inside(design)).groupBy("episode_id", "role", "panel", "planned_repeat_id").agg(F.count("*").alias("n"))
    out = out.unionByName(row(beside.where("n > 1"), "repeated_slot", F.col("episode_id"), none, _slot()))

    pairs = plan.select("episode_id", "pair_id").distinct()
    several = pairs.groupBy("episode_id").agg(F.count("pair_id").alias("n"))
    out = out.unionByName(row(several.where("n <> 1"), "several_pairs", F.col("episode_id"), none, F.lit("")))
    shared = pairs.where("pair_id is not null").groupBy("pair_id").agg(F.count("episode_id").alias("n")).where("n > 1")
    out = out.unionByName(row(shared, "shared_pair", none, none, F.col("pair_id")))
    again = catalog.groupBy("episode_id").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(row(again, "repeated_in_catalog", F.col("episode_id"), none, F.lit("")))
    total = several.agg(F.count("*").alias("n"))
    out = out.unionByName(row(total.where("n = 0"), "no_episode", none, none, F.lit("")))
    if design.most_episodes is not None:
        out = out.unionByName(row(total.where(F.col("n") > design.most_episodes), "too_many_episodes", none, none, F.col("n")))
    return out


def lineage_violations(base: DataFrame, plan: DataFrame) -> DataFrame:
    """(kind, request_id, repeat_id, concept_id, detail) of base rows and plan rows that cannot be matched for sure.

    base: request_id, repeat_id, concept_id. plan: request_id, planned_repeat_id (blank: for all repeats), concept_ids. Kinds: empty_key
    and repeated_key of either, ambiguous_fallback of requests with plan rows for all repeats beside rows for one, and of
    base rows whose plan row (that of their repeat, else that for all) names them not (unplanned_concept), or nothing (no_concepts).
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    base = base.select(*[text(c).alias(c) for c in ("request_id", "repeat_id", "concept_id")])
    plan = plan.select(text("request_id").alias("request_id"), text("planned_repeat_id").alias("repeat_id"), text("concept_ids").alias("concept_ids"))
    none = F.lit("").alias("concept_id")
    row = lambda df, kind, *columns: df.select(F.lit(kind).alias("kind"), *columns)
    key = ("request_id", "repeat_id", "concept_id")

    names = F.concat_ws(",", *[F.when(F.col(c) == "", c) for c in key])
    out = row(base.where(names != ""), "empty_key", *key, names.alias("detail"))
    out = out.unionByName(row(base.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "repeated_key", *key, F.lit("base").alias("detail")))
    out = out.unionByName(row(plan.where("request_id = ''"), "empty_key", "request_id", "repeat_id", none, F.lit("plan").alias("detail")))
    rows = plan.groupBy("request_id", "repeat_id").agg(F.count("*").alias("n"), F.max("concept_ids").alias("concept_ids"))
    out = out.unionByName(row(rows.where("n > 1"), "repeated_key", "request_id", "repeat_id", none, F.lit("plan").alias("detail")))
    repeats = rows.groupBy("request_id").agg(F.count("*").alias("n"), F.bool_or(F.col("repeat_id") == "").alias("for_all"))
    out = out.unionByName(row(repeats.where("for_all and n > 1"), "ambiguous_fallback", "request_id", F.lit("").alias("repeat_id"), none, F.col("n").cast("string").alias("detail")))

    exact = rows.where("repeat_id <> ''").select("request_id", "repeat_id", F.col("concept_ids").alias("own"))
    whole = rows.where("repeat_id = ''").select("request_id", F.col("concept_ids").alias("shared"))
    matched = base.join(exact, ["request_id", "repeat_id"], "left").join(whole, "request_id", "left").withColumn("listed", F.coalesce("own", "shared"))
    concepts = F.filter(F.transform(F.split("listed", ";"), lambda c: F.trim(c)), lambda c: c != "")
    unplanned = matched.where(F.col("listed").isNotNull()).withColumn("concepts", concepts)
    empty, other = unplanned.where("size(concepts) = 0"), unplanned.where("size(concepts) > 0 and not array_contains(concepts, concept_id)")
    out = out.unionByName(row(empty, "no_concepts", *key, F.lit("").alias("detail")))
    return out.unionByName(row(other, "unplanned_concept", *key, F.array_join(F.array_sort(F.array_distinct("concepts")), ";").alias("detail")))


def samples(violations: DataFrame, kind: str, order: tuple[str, ...], each: int = 20) -> DataFrame:
    """The first few violations of each kind in a fixed order, numbered, and how many there are: what a report shows, whatever their number."""
    violations = written(violations, "violations")  # read twice, and much dearer to find than to keep
    total = violations.groupBy(kind).agg(F.count("*").alias("of"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return violations.withColumn("place", place).where(F.col("place") <= each).join(total, kind)


def guarded(rows: DataFrame, violations: DataFrame, what: str, shown: int = 20) -> DataFrame:
    """rows, if there is no violation; else whatever reads them fails, with how many there are and the first of them.

    The check is part of the plan: one row, made by an aggregate that keeps no more than shown violations, is joined to all
    rows, and making it raises the error. Nothing is collected before a result is asked for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first = 0, []
        for batch in batches:
            n += len(batch)
            first = heapq.nsmallest(shown, first + batch.column("v").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([first], pa.list_(pa.string()))], ["n", "first"])

    # one pass: a row of each task, with no more than shown violations
    line = F.to_json(F.struct(*[F.col(c) for c in violations.columns]))
    some = violations.select(line.alias("v")).mapInArrow(run, "n long, first array<string>")
    counted = some.agg(F.sum("n").alias("n"), F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, shown), " ").alias("first"))
    text = F.concat(F.lit(f"{what}: "), F.col("n"), F.lit(" violations, "), F.col("first"))
    sound = counted.select(F.when(F.col("n") > 0, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)).alias("_sound"))
    return rows.join(F.broadcast(sound), F.col("_sound")).drop("_sound")

"""Records of event units with all that went into them, and contrasts of treated and control units under one admission rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import population_sd
from .finalize import FIELDS

UNIT = ("episode_id", "geography", "concept_id", "role", "backend", "panel", "request_id", "variant")
PAIR = ("pair_id", "panel", "concept_id", "variant")


def paired(metrics: DataFrame) -> DataFrame:
    """metrics with complete_pair: both roles have an eligible row of the pair, panel, concept, variant and repeat. Rows of other roles have none."""
    key = [*PAIR, "repeat_id"]
    has = lambda role: F.bool_or((F.col("role") == role) & F.col("eligible"))
    both = metrics.groupBy(*key).agg((has("treated") & has("control")).alias("_both"))
    both = both.select("_both", *[F.col(c).alias(f"_{c}") for c in key])
    rows = metrics.join(both, [F.col(c) == F.col(f"_{c}") for c in key], "left")  # rows without a pair are of none
    complete = F.coalesce("_both", F.lit(False)) & F.col("role").isin("treated", "control")
    return rows.select(*metrics.columns, complete.alias("complete_pair"))


def event_records(metrics: DataFrame, asked_repeats: int = 2, lineage: tuple[str, ...] = ("repeat_id", "peak_date")) -> DataFrame:
    """A record for each unit, eligible or not.

    metrics: rows of UNIT and repeat_id with eligible, reasons, complete_pair, primary_unit, pair_id, FIELDS and the lineage columns. Numbers are means over
    eligible repeats. repeat_ids and backends are those of eligible repeats; reason lists what speaks against all of them, and is empty where one is
    eligible; source_lineage has every repeat's lineage as JSON. complete_pair asks it of all eligible repeats, of which there must be one.
    """
    fine = lambda c: F.when(F.col("eligible"), F.col(c))
    joined = lambda values: F.array_join(F.array_sort(values), ";")
    n = F.count_if("eligible")
    history = F.to_json(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("string").alias(c) for c in lineage]))))
    rows = metrics.groupBy(*UNIT).agg(
        F.min("pair_id").alias("pair_id"),
        F.bool_and("primary_unit").alias("primary_unit"),
        F.count("*").alias("repeats"),
        n.alias("repeat_count"),
        (n > 0).alias("eligible"),
        (n == asked_repeats).alias("complete_repeats"),
        F.coalesce(F.bool_and(fine("complete_pair")), F.lit(False)).alias("complete_pair"),
        joined(F.collect_set(fine("repeat_id"))).alias("repeat_ids"),
        joined(F.collect_set(fine("backend"))).alias("acquisition_backends"),
        joined(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("reasons", ";"), lambda r: r != ""))))).alias("reason"),
        *[F.avg(fine(c)).alias(c) for c in FIELDS],
        population_sd(fine("standardized")).alias("repeat_sd"),
        history.alias("source_lineage"),
    )
    return rows.withColumn("reason", F.when(F.col("eligible"), "").otherwise(F.col("reason")))


def primary_contrasts(records: DataFrame) -> DataFrame:
    """Treated less control for each pair, panel, concept and variant that has exactly one eligible primary record of each role, both of a complete pair, of
    different requests and geographies."""
    rows = records.where("eligible and primary_unit and role in ('treated', 'control')")
    side = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    shown = ("request_id", "geography", "lift", "standardized", "robust")
    one = rows.groupBy(*PAIR).agg(
        F.count_if(F.col("role") == "treated").alias("t"),
        F.count_if(F.col("role") == "control").alias("c"),
        F.bool_and("complete_pair").alias("complete"),
        F.min("episode_id").alias("episode_id"),
        *[side(role, x).alias(f"{role}_{x}") for role in ("treated", "control") for x in shown],
    )
    one = one.where("t = 1 and c = 1 and complete and treated_request_id <> control_request_id and treated_geography <> control_geography").drop("t", "c", "complete")
    return one.withColumns({f"{x}_contrast": F.col(f"treated_{x}") - F.col(f"control_{x}") for x in ("lift", "standardized", "robust")})


def contrast_rejections(records: DataFrame) -> DataFrame:
    """(reason, pairs) of pairs, panels, concepts and variants that have a record but no contrast, by the first rule that they break."""
    key = records.groupBy(*PAIR).agg(
        *[F.count_if((F.col("role") == r) & F.col("eligible")).alias(f"{r}_eligible") for r in ("treated", "control")],
        *[F.count_if((F.col("role") == r) & F.col("eligible") & F.col("primary_unit")).alias(r) for r in ("treated", "control")],
        F.bool_and(F.when(F.col("eligible") & F.col("primary_unit"), F.col("complete_pair"))).alias("complete"),
        F.count_distinct(F.when(F.col("eligible") & F.col("primary_unit"), F.col("geography"))).alias("places"),
    )
    rule = F.when(F.col("treated_eligible") == 0, "no_eligible_treated").when(F.col("control_eligible") == 0, "no_eligible_control")
    rule = rule.when((F.col("treated") == 0) | (F.col("control") == 0), "not_primary").when((F.col("treated") > 1) | (F.col("control") > 1), "several_of_a_role")
    rule = rule.when(~F.coalesce("complete", F.lit(False)), "incomplete_pair").when(F.col("places") < 2, "same_geography")
    return key.withColumn("reason", rule).where("reason is not null").groupBy("reason").agg(F.count("*").alias("pairs"))

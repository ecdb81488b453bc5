"""Final analysis: strict admission, event units, contrasts, curves, comparison of stores, content hash, the baseline model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Rules
from ..functions.expr import correlation, mad_of, median_of, population_sd, reasons
from ..sources.tables import written
from . import selection
from .describe import average_ranks
from .series import KEYS, window_columns

#: Numbers that are averaged over repeats.
FIELDS = ("baseline_days", "baseline_mean", "baseline_sd", "response_days", "peak_value", "zero_share", "lift", "standardized", "robust")


def final_metrics(series: DataFrame, plan: DataFrame, rules: Rules, gap_days: int = 1) -> DataFrame:
    """For each key and variant: baseline, response peak, lifts, the reasons against it, and whether it is eligible.

    Variant main ends the baseline before the first phase, variant late gap_days before the onset; both come from one scan. The response is the time of all phases.
    """
    windows = window_columns(rules)
    first, last = windows["anticipatory"][0], windows[list(rules.phases)[-1]][1]
    start = windows["baseline"][0]
    variants = F.array(F.struct(F.lit("main").alias("variant"), windows["baseline"][1].alias("baseline_end")), F.struct(F.lit("late").alias("variant"), F.date_sub("onset", gap_days).alias("baseline_end")))
    rows = series.join(plan, "request_id").withColumn("v", F.explode(variants)).select("*", "v.*").withColumns({"first": first, "last": last, "start": start})
    base = F.when(F.col("date").between(F.col("start"), F.col("baseline_end")), F.col("value"))
    inside = F.when(F.col("date").between(F.col("first"), F.col("last")), F.col("value"))
    days = F.datediff("last", "first") + 1
    out = rows.groupBy(*KEYS, "variant", "role", "episode_id", "geography").agg(
        F.count(base).alias("baseline_days"), F.avg(base).alias("baseline_mean"), population_sd(base).alias("baseline_sd"), F.collect_list(base).alias("values"), F.count(inside).alias("response_days"), F.max(days).alias("window_days"),
        F.max(inside).alias("peak_value"), F.min_by(F.when(inside.isNotNull(), F.col("date")), F.struct(inside.isNull(), -inside, F.col("date"))).alias("peak_date"), F.avg(F.when(base.isNotNull() | inside.isNotNull(), (F.col("value") == 0).cast("double"))).alias("zero_share"), F.max("value").alias("top"),
    )
    out = out.withColumn("middle", median_of(F.col("values"))).withColumn("mad", mad_of(F.col("values")))
    why = reasons((F.col("baseline_days") < rules.least_baseline_days, "baseline"), (F.col("response_days") < F.ceil(rules.phase_coverage * F.col("window_days")), "coverage"), (F.col("zero_share") >= rules.most_zero_share, "zeros"), (F.col("top") == 0, "all_zero"), (F.coalesce("baseline_sd", F.lit(0.0)) <= rules.least_sd, "flat"))
    out = out.withColumn("lift", F.col("peak_value") - F.col("baseline_mean")).withColumn("standardized", F.when(F.col("baseline_sd") > rules.least_sd, F.col("lift") / F.col("baseline_sd"))).withColumn("robust", F.when(F.col("mad") > rules.least_sd, (F.col("peak_value") - F.col("middle")) / (1.4826 * F.col("mad"))))
    return out.withColumn("reasons", F.array_join(why, ";")).withColumn("eligible", F.size(why) == 0).drop("values", "middle", "mad", "top", "window_days")


def event_units(metrics: DataFrame) -> DataFrame:
    """Eligible repeats of each event, geography, concept, role and request averaged, with deviations and their lineage as JSON."""
    keys = ["episode_id", "geography", "concept_id", "role", "request_id", "variant"]
    fine = lambda c: F.when(F.col("eligible"), F.col(c))
    lineage = F.to_json(F.array_sort(F.collect_list(F.when(F.col("eligible"), F.struct("repeat_id", F.col("peak_date").cast("string").alias("peak_date"))))))
    return metrics.groupBy(*keys).agg(F.count("*").alias("repeats"), F.sum(F.col("eligible").cast("long")).alias("eligible_repeats"), *[F.avg(fine(c)).alias(c) for c in FIELDS], population_sd(fine("lift")).alias("lift_sd"), lineage.alias("source_lineage")).where("eligible_repeats > 0")


def complete_pairs(metrics: DataFrame) -> DataFrame:
    """Rows of treated and control requests with complete_pair: both roles have an eligible row of the concept, repeat and variant."""
    w = Window.partitionBy("episode_id", "concept_id", "repeat_id", "variant")
    has = lambda role: F.max(((F.col("role") == role) & F.col("eligible")).cast("int")).over(w)
    return metrics.where("role in ('treated', 'control')").withColumn("complete_pair", (has("treated") + has("control")) == 2)


def contrasts(units: DataFrame) -> DataFrame:
    """Treated less control for each event, concept, variant and control request of another geography."""
    side = lambda role, p: units.where(F.col("role") == role).select("episode_id", "concept_id", "variant", *[F.col(c).alias(f"{p}_{c}") for c in ("request_id", "geography", "lift", "standardized")])
    pairs = side("treated", "treated").join(side("control", "control"), ["episode_id", "concept_id", "variant"]).where("treated_request_id <> control_request_id and treated_geography <> control_geography")
    return pairs.withColumn("lift_contrast", F.col("treated_lift") - F.col("control_lift")).withColumn("standardized_contrast", F.col("treated_standardized") - F.col("control_standardized"))


def sensitivity(units: DataFrame) -> DataFrame:
    """Event-balanced mean lift of each variant and role, and the mean change from main on shared units."""
    balanced = units.groupBy("variant", "role", "episode_id").agg(F.avg("lift").alias("m")).groupBy("variant", "role").agg(F.avg("m").alias("mean_lift"), F.count("*").alias("episodes"))
    main = units.where("variant = 'main'").select("request_id", "concept_id", F.col("lift").alias("main_lift"))
    change = units.join(main, ["request_id", "concept_id"]).groupBy("variant", "role").agg(F.avg(F.col("lift") - F.col("main_lift")).alias("mean_change"), F.count("*").alias("shared_units"))
    return balanced.join(change, ["variant", "role"], "left")


def readiness_counters(metrics: DataFrame) -> DataFrame:
    """One row: rows, requests, episodes and concepts of the main variant, and how many of each are eligible."""
    main = metrics.where("variant = 'main'")
    fine = lambda c: F.count_distinct(F.when(F.col("eligible"), F.col(c)))
    names = {"request_id": "requests", "episode_id": "episodes", "concept_id": "concepts"}
    return main.agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible_rows"), *[F.count_distinct(c).alias(n) for c, n in names.items()], *[fine(c).alias(f"eligible_{n}") for c, n in names.items()])


def sample_flow(plan: DataFrame, series: DataFrame, metrics: DataFrame) -> DataFrame:
    """Requests planned, acquired, verified and eligible, for each role."""
    main = metrics.where("variant = 'main'")
    stage = lambda df, name: df.select("role", "request_id", F.lit(name).alias("stage"))
    rows = stage(plan, "planned").unionByName(stage(series.join(plan, "request_id"), "acquired")).unionByName(stage(main.where("baseline_days > 0"), "verified")).unionByName(stage(main.where("eligible"), "eligible"))
    return rows.groupBy("stage", "role").agg(F.count_distinct("request_id").alias("requests"))


def response_summary(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each concept and role: units and mean lift of the main variant; for treated ones also the mean contrast."""
    by = units.where("variant = 'main'").groupBy("concept_id", "role").agg(F.count("*").alias("units"), F.avg("lift").alias("mean_lift"), F.avg("standardized").alias("mean_standardized"))
    diff = pairs.where("variant = 'main'").groupBy("concept_id").agg(F.avg("lift_contrast").alias("mean_contrast")).withColumn("role", F.lit("treated"))
    return by.join(diff, ["concept_id", "role"], "left")


def event_curve(series: DataFrame, plan: DataFrame, metrics: DataFrame, reach: int) -> DataFrame:
    """Mean standardised value by days from the onset: mean of repeats, then of events, with how many there are."""
    scale = metrics.where("variant = 'main' and eligible").select(*KEYS, "baseline_mean", "baseline_sd")
    rows = series.join(plan.select("request_id", "role", "episode_id", "onset"), "request_id").join(scale, KEYS).withColumn("lag", F.datediff("date", "onset")).where(F.abs("lag") <= reach)
    z = (F.col("value") - F.col("baseline_mean")) / F.col("baseline_sd")
    unit = rows.groupBy("role", "concept_id", "episode_id", "request_id", "lag").agg(F.avg(z).alias("z"))
    return unit.groupBy("role", "concept_id", "lag").agg(F.avg("z").alias("mean_z"), F.count("*").alias("units"))


def store_agreement(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """How two stores (keys, date, value) agree on shared days: correlations, errors, zeros, peaks."""
    rows = first.select(*keys, "date", F.col("value").alias("x")).join(second.select(*keys, "date", F.col("value").alias("y")), [*keys, "date"])
    rows = average_ranks(average_ranks(rows, keys, "x", "rx"), keys, "y", "ry")
    d = F.col("x") - F.col("y")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("days"), correlation("x", "y").alias("pearson"), F.when(correlation("x", "y").isNotNull(), correlation("rx", "ry")).alias("spearman"), F.avg(F.abs(d)).alias("mean_error"), F.sqrt(F.avg(d * d)).alias("root_error"), F.avg(((F.col("x") == 0) == (F.col("y") == 0)).cast("double")).alias("zero_agreement"),
        F.max("x").alias("first_peak"), F.max("y").alias("second_peak"), F.min_by("date", F.struct(-F.col("x"), "date")).alias("first_peak_date"), F.min_by("date", F.struct(-F.col("y"), "date")).alias("second_peak_date"),
    )
    return out.withColumn("peak_displacement", F.datediff("second_peak_date", "first_peak_date")).withColumn("same_peak_date", F.col("first_peak_date") == F.col("second_peak_date"))


def content_hash(rows: DataFrame) -> DataFrame:
    """One row that depends on a table's rows, how often each occurs, and its columns, not on their order or partitions: the number of rows, and the sum and exclusive or of 60 bits of each row's hash."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("long")
    return rows.select(part.alias("p")).agg(F.count("*").alias("rows"), F.sum(F.col("p").cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor("p").cast("string").alias("xor"))


def folds(rows: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """rows with fold: groups in the order of a seeded hash, dealt in turn. Groups are numbered within 256 ranges of the hash, and the ranges' sizes say where each begins."""
    ids = rows.select(group).distinct().withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(group)), 256)).withColumn("range", F.substring("h", 1, 2))
    # at most 256 rows
    sizes = ids.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", group)) - 1
    numbered = ids.withColumn("place", place).join(F.broadcast(sizes.select("range", before.alias("before"))), "range")
    return rows.join(numbered.select(group, ((F.col("before") + F.col("place")) % k).cast("int").alias("fold")), group)


@dataclass
class Fitted:
    """A model of one fold: for each feature its training median, mean and deviation, and the coefficients (intercept, features, categories but the first)."""

    fold: int
    scales: list[tuple[float, float, float]]
    beta: list[float]
    mean: float


def model_gates(rows: DataFrame, target: str, group: str, category: str | None = None, k: int = 4, least_groups: int = 20, least_training: int = 12, seed: str = "0") -> DataFrame:
    """(reason) for each rule that keeps the model from being fitted: too few groups in all, in a category, or to train a fold on."""
    rows = rows.where(F.col(target).isNotNull())
    n = rows.agg(F.count_distinct(group).alias("n"))
    out = n.where(F.col("n") < least_groups).select(F.lit(f"fewer_than_{least_groups}_groups").alias("reason"))
    if category:
        few = rows.groupBy(category).agg(F.count_distinct(group).alias("n")).where(F.col("n") < least_groups)
        out = out.unionByName(few.select(F.concat(F.lit("few_groups:"), F.col(category).cast("string")).alias("reason")))
    of_fold = folds(rows, group, k, seed).groupBy("fold").agg(F.count_distinct(group).alias("held"))
    return out.unionByName(of_fold.crossJoin(n).where(F.col("n") - F.col("held") < least_training).select(F.concat(F.lit("few_training_groups:"), F.col("fold")).alias("reason")))


def fit_ridge(dealt: DataFrame, target: str, features: list[str], categories: list[str], category: str | None, k: int, alpha: float) -> list[Fitted]:
    """One model for each fold from all other folds. Medians, means and deviations come from the training rows alone; sums for the normal equations are distributed aggregates, and only the
    square system of the columns is solved on the driver. A feature that does not vary in training has coefficient 0."""
    w = F.col("weight")
    copies = dealt.withColumn("out", F.explode(F.array(*[F.lit(f) for f in range(k)]))).where("fold <> out")
    # a row for each fold; values are counted by range, so that no group holds a fold's values
    long = written(copies.select("out", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")).select("out", "f.*"), "features")
    middle = selection.medians(long, ("out", "name"), "x")
    medians = written(middle.groupBy("out").agg(*[F.coalesce(F.max(F.when(F.col("name") == c, F.col("median"))), F.lit(0.0)).alias(f"d_{c}") for c in features]), "medians")
    medians = copies.select("out").distinct().join(medians, "out", "left").select("out", *[F.coalesce(f"d_{c}", F.lit(0.0)).alias(f"d_{c}") for c in features])
    filled = copies.join(medians, "out").withColumns({f"f_{c}": F.when(F.col(c).isNull() | F.isnan(c), F.col(f"d_{c}")).otherwise(F.col(c)) for c in features})
    mean = lambda c: F.sum(w * F.col(f"f_{c}")) / F.sum(w)
    means = filled.groupBy("out").agg(*[mean(c).alias(f"m_{c}") for c in features])
    filled = filled.join(F.broadcast(means), "out")
    columns = [F.lit(1.0), *[F.col(f"f_{c}") - F.col(f"m_{c}") for c in features], *[(F.col(category) == v).cast("double") for v in categories]]
    p = len(columns)
    named = filled.select("out", w.alias("weight"), F.col(target).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(columns)])
    sums = named.groupBy("out").agg(*[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(w * F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(p)])
    scales = {r["out"]: [(r[f"d_{c}"], r[f"m_{c}"]) for c in features] for r in medians.join(means, "out").collect()}
    models = []
    for r in sums.collect():
        gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        right = np.array([r[f"b{i}"] for i in range(p)])
        sd = np.ones(p)
        n = len(features)
        sd[1 : n + 1] = np.sqrt(np.maximum(np.diag(gram)[1 : n + 1] / gram[0, 0], 0.0))
        use = np.array([i == 0 or i > n or sd[i] > 1e-12 for i in range(p)])
        sd[~use] = 1.0
        gram, right = gram / np.outer(sd, sd), right / sd
        beta = np.zeros(p)
        beta[use] = np.linalg.solve((gram + alpha * np.diag([0.0] + [1.0] * (p - 1)))[np.ix_(use, use)], right[use])
        models.append(Fitted(r["out"], [(d, m, float(s)) for (d, m), s in zip(scales[r["out"]], sd[1 : n + 1])], beta.tolist(), float(r["b0"] / r["g0_0"])))
    return sorted(models, key=lambda m: m.fold)


def ridge(rows: DataFrame, target: str, features: list[str], group: str, category: str | None = None, k: int = 4, alpha: float = 1.0, least_groups: int = 20, least_training: int = 12, seed: str = "0") -> DataFrame:
    """Grouped cross-validated ridge predictions against the weighted mean: one row for each row of the input, or none if a gate is shut or nothing varies.

    Every group has weight 1 in total. Missing features take the training rows' median; features are standardised by the training rows; category is one-hot without its first value. The
    intercept is not penalised.
    """
    rows = rows.where(F.col(target).isNotNull())
    schema = [F.col(group), F.lit(0).alias("fold"), F.col(target).alias("actual"), F.lit(0.0).alias("predicted"), F.lit(0.0).alias("mean_predicted"), F.lit(0.0).alias("weight")]
    if not model_gates(rows, target, group, category, k, least_groups, least_training, seed).isEmpty():
        return rows.select(*schema).limit(0)
    # a concept dictionary's values
    categories = sorted(str(r[0]) for r in rows.select(category).distinct().collect())[1:] if category else []
    dealt = folds(rows, group, k, seed).withColumn("weight", 1 / F.count("*").over(Window.partitionBy(group)))
    models = fit_ridge(dealt, target, features, categories, category, k, alpha)
    if any(all(b == 0 for b in m.beta[1:]) for m in models):
        return rows.select(*schema).limit(0)
    weights = rows.sparkSession.createDataFrame([(m.fold, m.beta, [list(s) for s in m.scales], m.mean) for m in models], "fold int, beta array<double>, scales array<array<double>>, mean_predicted double")
    # one row for each fold
    held = dealt.join(F.broadcast(weights), "fold")
    scale = lambda i, j: F.get(F.get("scales", F.lit(i)), F.lit(j))
    value = lambda c, i: (F.when(F.col(c).isNull() | F.isnan(c), scale(i, 0)).otherwise(F.col(c)) - scale(i, 1)) / scale(i, 2)
    terms = [value(c, i) for i, c in enumerate(features)] + [(F.col(category) == v).cast("double") for v in categories]
    dot = sum((F.get("beta", F.lit(i)) * x for i, x in enumerate(terms, 1)), F.get("beta", F.lit(0)))
    return held.select(group, "fold", F.col(target).alias("actual"), dot.alias("predicted"), "mean_predicted", "weight")


def model_errors(predictions: DataFrame) -> DataFrame:
    """Weighted mean absolute and root mean squared error of the model and of the mean, for each fold and pooled (fold null)."""
    w = F.col("weight")
    e = lambda c: F.col(c) - F.col("actual")
    one = lambda c, name: [(F.sum(w * F.abs(e(c))) / F.sum(w)).alias(f"{name}_mae"), F.sqrt(F.sum(w * e(c) * e(c)) / F.sum(w)).alias(f"{name}_rmse")]
    return predictions.groupingSets([[F.col("fold")], []], "fold").agg(F.count("*").alias("rows"), *one("predicted", "ridge"), *one("mean_predicted", "mean"))

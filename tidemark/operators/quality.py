"""Quality of source records: validation, duplicates, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import canonical_uuid, iso_date, reasons

DUPLICATE_POLICIES = ("quarantine", "keep-first", "keep-last", "reject-all")


def validated(records: DataFrame, allow_invalid_geometry: bool = False) -> DataFrame:
    """Source records (uuid, start_date, end_date, area_km2 and decoded geometry) with canonical id and dates, and why each is rejected or quarantined (rejected: reject_reason; quarantined: quarantine_reason)."""
    rows = records.withColumn("record_id", canonical_uuid(F.col("uuid"))).withColumn("start", iso_date(F.col("start_date").cast("string"))).withColumn("end", iso_date(F.col("end_date").cast("string")))
    reject = reasons((F.col("uuid").isNull(), "null_uuid"), (F.col("uuid").isNotNull() & F.col("record_id").isNull(), "malformed_uuid"), (F.col("start_date").isNull(), "null_start"), (F.col("start_date").isNotNull() & F.col("start").isNull(), "malformed_start"), (F.col("geometry").isNull(), "null_geometry"), (F.col("geometry").isNotNull() & F.col("geometry_type").isNull(), "undecodable_geometry"), (F.coalesce("is_empty", F.lit(False)), "empty_geometry"))
    invalid = ~F.coalesce("is_valid", F.lit(True)) & ~F.coalesce("is_empty", F.lit(False))
    width = F.col("maxx") - F.col("minx")
    out = rows.withColumn("reject_reason", F.array_join(reject, ";")).withColumn("quarantine_reason", F.when(invalid & F.lit(not allow_invalid_geometry) & (F.size(reject) == 0), "invalid_geometry"))
    return out.withColumn("duration_days", F.datediff("end", "start")).withColumn("antimeridian_review", F.coalesce((F.col("minx") <= -179) | (F.col("maxx") >= 179) | (width > 180), F.lit(False)))


def with_duplicates(rows: DataFrame, key: str, signature: list[str], order: str) -> DataFrame:
    """rows with copies of the key, whether they conflict in the signature, in which of its columns, and the first and last of them by order; rows later rejected count too.

    A null key is no duplicate: such rows are copies of nothing, whatever their number, and take no part in the shuffle by key.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    keyed = rows.where(F.col(key).isNotNull()).withColumn("sign", F.xxhash64(*map(text, signature)))
    w = Window.partitionBy(key)
    differ = {f"differs_{c}": F.min(text(c)).over(w) != F.max(text(c)).over(w) for c in signature}
    some = [F.when((F.col("copies") > 1) & F.col(k), F.lit(f"{k.removeprefix('differs_')}_conflict")) for k in differ]
    out = keyed.withColumn("copies", F.count("*").over(w)).withColumns(differ).withColumn("conflicts", F.array_compact(F.array(*some))).drop(*differ)
    out = out.withColumn("conflict", (F.col("copies") > 1) & (F.min("sign").over(w) != F.max("sign").over(w)))
    out = out.withColumn("first_of_key", F.min(order).over(w)).withColumn("last_of_key", F.max(order).over(w)).drop("sign")
    alone = rows.where(F.col(key).isNull()).withColumns({"copies": F.lit(1).cast("long"), "conflicts": F.array().cast("array<string>"), "conflict": F.lit(False), "first_of_key": F.col(order), "last_of_key": F.col(order)})
    return out.unionByName(alone)


def outcome(rows: DataFrame, policy: str, order: str) -> DataFrame:
    """rows with outcome (accepted, quarantined, rejected) and outcome_reason under a policy for duplicates; geometry goes before duplicates."""
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"unknown policy {policy}")
    duplicate = F.col("copies") > 1
    stays = {"quarantine": F.lit(False), "keep-first": F.col(order) == F.col("first_of_key"), "keep-last": F.col(order) == F.col("last_of_key"), "reject-all": F.lit(False)}[policy]
    lost = "rejected" if policy == "reject-all" else "quarantined"
    kind = F.when(~F.col("conflict"), "exact_duplicate")
    state = F.when(F.col("reject_reason") != "", "rejected").when(F.col("quarantine_reason").isNotNull(), "quarantined").when(duplicate & ~stays, lost).otherwise("accepted")
    why = F.when(F.col("reject_reason") != "", F.col("reject_reason")).when(F.col("quarantine_reason").isNotNull(), F.col("quarantine_reason")).when(duplicate & ~stays, F.concat_ws(";", F.lit(policy), kind, F.array_join("conflicts", ";")))
    return rows.withColumn("outcome", state).withColumn("outcome_reason", why)


def accounting(rows: DataFrame) -> DataFrame:
    """One row: how many were accepted, quarantined and rejected, and whether that is all of them."""
    n = lambda s: F.sum((F.col("outcome") == s).cast("long"))
    return rows.agg(F.count("*").alias("source"), n("accepted").alias("accepted"), n("quarantined").alias("quarantined"), n("rejected").alias("rejected")).withColumn("balanced", F.col("source") == F.col("accepted") + F.col("quarantined") + F.col("rejected"))


def duplicate_profile(rows: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """One row: keys that occur again, their rows, rows beyond the first, exact copies, conflicting groups, and groups in which each signature column conflicts."""
    # counting distinct values of each column would deal out every row once for each; that a column differs shows in its extremes and its nulls
    each = rows.groupBy(key, *signature).agg(F.count("*").alias("n"))
    present = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0))
    differ = [((F.coalesce(F.min(c) != F.max(c), F.lit(False))) | ((present(c) > 0) & (present(c) < F.sum("n")))).alias(f"d_{c}") for c in signature]
    by = each.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), *differ).where("n > 1")
    return by.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.coalesce(F.sum(F.col("n") - F.col("kinds")), F.lit(0)).alias("exact_copies"), F.coalesce(F.sum((F.col("kinds") > 1).cast("long")), F.lit(0)).alias("conflicting_groups"), *[F.coalesce(F.sum(F.col(f"d_{c}").cast("long")), F.lit(0)).alias(f"conflicts_{c}") for c in signature])


def table_profile(rows: DataFrame, area: str, start: str, end: str) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.min(area).alias("least_area"), F.max(area).alias("largest_area"), F.avg(area).alias("mean_area"), F.min(start).alias("first_start"), F.max(start).alias("last_start"), F.sum(F.col(end).isNull().cast("long")).alias("null_ends"), F.sum((F.col(end) < F.col(start)).cast("long")).alias("negative_durations"))


def histogram(rows: DataFrame, value, name: str) -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def null_shares(rows: DataFrame) -> DataFrame:
    """Percentage of nulls of every field, in one pass."""
    one = rows.agg(*[F.avg(F.col(c).isNull().cast("double") * 100).alias(c) for c in rows.columns])
    return one.unpivot([], rows.columns, "field", "null_percent")

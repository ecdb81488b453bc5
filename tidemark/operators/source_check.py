"""Stored observations held against the files that they came from: contents by hash, sidecars, windows, calendars, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null, iso_date
from ..sources.tables import csv_cells
from .imports import parsed_interest

#: Fields in which a sidecar must agree with its plan row, and settings of the query.
LINEAGE = ("request_id", "repeat_id", "episode_id", "geography")
SETTINGS = ("category", "search_property")
IDENTITY = ("request_id", "repeat_id", "concept_id", "date")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, sha256, lines) of each file: the hash is that of its bytes, the lines are those of its text."""
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "﻿|\r", "")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("sha256"), F.split(text, "\n").alias("lines"))


def _cells(files: DataFrame) -> DataFrame:
    """files with the header's cells and all later rows' cells; the header is the first line whose first cell is a unit of time."""
    rows = F.filter(F.transform("lines", csv_cells), lambda c: F.exists(c, lambda x: x != ""))
    head = lambda c: F.lower(F.get(c, F.lit(0))).isin("date", "day", "week", "month")
    out = files.select("source_file", "sha256", rows.alias("rows")).withColumn("at", F.coalesce(F.array_position(F.transform("rows", head), F.lit(True)), F.lit(0)).cast("int"))
    header = F.when(F.col("at") > 0, F.get("rows", F.col("at") - 1))
    return out.select("source_file", "sha256", header.alias("header"), F.when(F.col("at") > 0, F.slice("rows", F.col("at") + 1, F.size("rows"))).alias("rows"))


def _stem(c):
    return F.regexp_replace(c, r"\.[^.]*$", "")


def recheck(stored: DataFrame, plan: DataFrame, files: DataFrame, sidecars: DataFrame, terms: DataFrame, backends: tuple[str, ...]) -> DataFrame:
    """(kind, request_id, repeat_id, concept_id, date, detail) of everything in which stored observations, plan, sidecars and raw files disagree.

    stored: IDENTITY, interest, is_partial, source_file. plan: request_id, planned_repeat_id, episode_id, geography, window_start,
    window_end, category, search_property, concept_ids. files: as raw_files gives them. sidecars: sidecar_file, source_filename, csv_sha256,
    export_date, start_date, end_date, backend, requested_concepts, requested_labels, LINEAGE and SETTINGS. terms: concept_id, query_text.

    By request and repeat: several_sources, no_plan, no_raw_or_sidecar, hash_mismatch, unverified (no hash or date of export), file_name, lineage,
    backend, query_dates, settings, panel, header (not daily, or of another width), labels. By day: date_form, outside_window,
    repeated_date, missing_day (of the query's window), bad_value. By observation: value, partial_flag, not_in_source, not_stored.
    """
    keys = ("request_id", "repeat_id")
    # of several sources the first that there is a raw file of is looked at, and one that is lost only if there is no other
    lost = stored.select(*keys, "source_file").distinct().join(files.select("source_file", F.lit(False).alias("lost")).distinct(), "source_file", "left").withColumn("lost", F.coalesce("lost", F.lit(True)))
    first = F.min_by("source_file", F.struct("lost", F.col("source_file").isNull(), "source_file"))
    by = lost.groupBy(*keys).agg(first.alias("source_file"), (F.coalesce(F.min("source_file") != F.max("source_file"), F.lit(False))).alias("several"))
    p = plan.select("request_id", F.col("planned_repeat_id").alias("repeat_id"), F.lit(True).alias("planned"), *[F.col(c).alias(f"plan_{c}") for c in ("episode_id", "geography", "window_start", "window_end", *SETTINGS)], F.split("concept_ids", ";").alias("concepts"))
    side = sidecars.select(_stem(F.col("sidecar_file")).alias("stem"), F.struct(*[c for c in sidecars.columns if c != "sidecar_file"]).alias("side"))
    read = _cells(files).withColumn("stem", _stem(F.col("source_file")))
    # texts of the planned concepts in their order, and a row for each request and repeat
    named = p.select(*keys, F.posexplode("concepts").alias("place", "concept_id")).join(terms, "concept_id", "left")
    texts = named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "query_text"))), lambda x: x["query_text"]).alias("texts"))
    rows = by.join(p, list(keys), "left").join(texts, list(keys), "left").join(read, "source_file", "left").join(side, "stem", "left")

    differs = lambda a, b: ~a.cast("string").eqNullSafe(b.cast("string"))
    there = F.col("sha256").isNotNull() & F.col("side").isNotNull() & F.coalesce("planned", F.lit(False))
    claimed = blank_to_null("side.csv_sha256")
    date = blank_to_null(F.col("side.export_date").cast("string"))
    lineage = F.concat_ws(",", *[F.when(differs(F.col(f"side.{c}"), F.col(c if c in keys else f"plan_{c}")), c) for c in LINEAGE])
    settings = F.concat_ws(",", *[F.when(differs(F.col(f"side.{c}"), F.col(f"plan_{c}")), c) for c in SETTINGS])
    labels = F.zip_with(F.slice("header", 2, F.greatest(F.size("header") - 1, F.lit(0))), F.col("side.requested_labels"), lambda have, want: F.coalesce(F.lower(have).contains(F.lower(want)), F.lit(False)))
    daily = F.lower(F.get("header", F.lit(0))).isin("date", "day") & (F.size("header") == F.size("concepts") + 1)
    problems = [
        ("several_sources", F.col("several"), F.lit("")),
        ("no_plan", F.col("planned").isNull(), F.lit("")),
        ("no_raw_or_sidecar", F.col("sha256").isNull() | F.col("side").isNull(), F.lit("")),
        ("hash_mismatch", there & (claimed != F.col("sha256")), F.lit("")),
        ("unverified", there & (claimed.isNull() | date.isNull() | date.contains("REQUIRED")), F.lit("")),
        ("file_name", there & differs(F.col("side.source_filename"), F.col("source_file")), F.lit("")),
        ("lineage", there & (lineage != ""), lineage),
        ("backend", there & ~F.coalesce(F.col("side.backend").isin(*backends), F.lit(False)), F.col("side.backend")),
        ("query_dates", there & (differs(F.col("side.start_date"), F.col("plan_window_start")) | differs(F.col("side.end_date"), F.col("plan_window_end"))), F.lit("")),
        ("settings", there & (settings != ""), settings),
        ("panel", there & (~F.col("side.requested_concepts").eqNullSafe(F.col("concepts")) | ~F.col("side.requested_labels").eqNullSafe(F.col("texts"))), F.lit("")),
        ("header", there & ~F.coalesce(daily, F.lit(False)), F.lit("")),
        ("labels", there & ~F.coalesce(F.forall(labels, lambda x: x), F.lit(False)), F.lit("")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.coalesce(d, F.lit("")).alias("detail"))) for k, c, d in problems]))
    nothing = (F.lit(None).cast("string").alias("concept_id"), F.lit(None).cast("date").alias("date"))
    out = rows.select(*keys, F.explode(found).alias("x")).select("x.kind", *keys, *nothing, "x.detail")

    days = rows.where(there).select(*keys, "concepts", F.col("side.start_date").cast("date").alias("first"), F.col("side.end_date").cast("date").alias("last"), F.explode("rows").alias("cells"))
    text = F.get("cells", F.lit(0))
    days = days.select(*keys, "concepts", "first", "last", "cells", text.alias("text"), F.when(F.length(text) == 10, iso_date(text)).alias("date"))
    day = lambda df, kind, detail=F.lit(""): df.select(F.lit(kind).alias("kind"), *keys, F.lit(None).cast("string").alias("concept_id"), "date", detail.alias("detail"))
    out = out.unionByName(day(days.where("date is null"), "date_form", F.col("text")))
    out = out.unionByName(day(days.where("date < first or date > last"), "outside_window"))
    out = out.unionByName(day(days.where("date is not null").groupBy(*keys, "date").agg(F.count("*").alias("n")).where("n > 1"), "repeated_date"))
    wanted = rows.where(there & (F.col("side.start_date") <= F.col("side.end_date"))).select(*keys, F.explode(F.sequence(F.col("side.start_date").cast("date"), F.col("side.end_date").cast("date"))).alias("date"))
    out = out.unionByName(day(wanted.join(days.select(*keys, "date"), [*keys, "date"], "left_anti"), "missing_day"))

    cells = days.where("date is not null").select(*keys, "date", F.posexplode("concepts").alias("place", "concept_id"), "cells").withColumn("text", F.get("cells", F.col("place") + 1))
    cells = cells.select(*keys, "concept_id", "date", *[c.alias(n) for n, c in parsed_interest(F.col("text")).items() if n in ("interest", "is_partial", "problem")])
    cell = lambda df, kind: df.select(F.lit(kind).alias("kind"), *IDENTITY, F.lit("").alias("detail"))
    out = out.unionByName(cell(cells.where("problem is not null"), "bad_value"))
    once = cells.groupBy(*IDENTITY).agg(F.min(F.struct("interest", "is_partial")).alias("raw"))
    mine = stored.join(rows.where(there).select(*keys), list(keys), "left_semi").select(*IDENTITY, F.struct("interest", "is_partial").alias("kept"))
    both = mine.join(once, list(IDENTITY), "full").where(~F.col("kept").eqNullSafe(F.col("raw")))
    kind = F.when(F.col("raw").isNull(), "not_in_source").when(F.col("kept").isNull(), "not_stored")
    kind = kind.when(~F.col("kept.interest").eqNullSafe(F.col("raw.interest")), "value").otherwise("partial_flag")
    return out.unionByName(both.select(kind.alias("kind"), *IDENTITY, F.lit("").alias("detail")))

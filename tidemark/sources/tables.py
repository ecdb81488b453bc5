"""Readers and sinks: bounded scans, schemas that also hold for empty results, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Files that save_ordered has one task write, about: half of those whose numbers stand in order as text.
FILES_OF_TASK = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the session's shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def footprint_scan(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Parquet rows with source_row_index: the pandas index column if there is one, else the row's place in all files, in the order of their names (files that one task wrote, by
    their number, which Spark pads to three digits alone). The bound holds before anything is counted."""
    df = spark.read.parquet(path)
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    # one row for each file
    sizes = df.select(file.alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    number = F.regexp_extract("file", r"-c(\d+)\.[^/]*$", 1)
    order = Window.orderBy(F.when(number != "", F.regexp_replace("file", r"\d+\.[^/]*$", "")).otherwise(F.col("file")), F.when(number != "", number.cast("long")), "file")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_file", file).withColumn("_place", place).join(sizes.select(F.col("file").alias("_file"), before.alias("_before")), "_file")
    index = F.col("_before") + F.col("_place")
    index = F.coalesce(F.col("__index_level_0__").cast("long"), index) if "__index_level_0__" in df.columns else index
    df = df.withColumn("source_row_index", index)
    if max_rows is not None:
        df = df.where(F.col("_before") + F.col("_place") < max_rows)
    return df.drop("_file", "_place", "_before")


def inspect_schema(df: DataFrame, required: list[str], optional: list[str], samples: int = 3, width: int = 120) -> DataFrame:
    """A row for each field: type, nullability, whether it is required, optional, ignored or unknown, and the values of some rows (bytes as their number, text cut). Required fields that
    are absent are listed as missing. warning says what is wrong with a field."""
    ignored = {"__index_level_0__"}
    shown = [F.when(F.col(f.name).isNotNull(), F.concat(F.length(f.name).cast("string"), F.lit(" bytes"))) if f.dataType == T.BinaryType() else F.substring(F.col(f.name).cast("string"), 1, width) for f in df.schema]
    seen = df.select(*[c.alias(f.name) for c, f in zip(shown, df.schema)]).limit(samples).collect()
    role = lambda n: "required" if n in required else "optional" if n in optional else "ignored" if n in ignored else "unknown"
    rows = [(f.name, f.dataType.simpleString(), f.nullable, role(f.name), [r[f.name] for r in seen], "unknown field" if role(f.name) == "unknown" else None) for f in df.schema]
    rows += [(name, None, None, "missing", [], "required field is missing") for name in required if name not in df.columns]
    return df.sparkSession.createDataFrame(rows, "field string, type string, nullable boolean, role string, samples array<string>, warning string")


def input_report(inputs: dict[str, DataFrame]) -> DataFrame:
    """name, columns and rows of each input."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), "rows") for name, df in inputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conformance(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of a registered schema that df lacks or has with another type."""
    have = {f.name: f.dataType for f in df.schema}
    rows = [(f.name, f.dataType.simpleString(), have[f.name].simpleString() if f.name in have else None) for f in schema if have.get(f.name) != f.dataType]
    return df.sparkSession.createDataFrame(rows, "field string, expected string, found string")


def conforming(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's registered fields, if it has all of them with their types; else an error that names each that differs. Nothing is read for it."""
    if bad := conformance(df, schema).collect():  # a row for each field of the schema at most
        raise ValueError("fields that do not conform: " + ", ".join(f"{r['field']} ({r['expected']}, found {r['found']})" for r in bad))
    return df.select(*[f.name for f in schema])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df cast to a fixed schema; columns it lacks are null, others go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def save(df: DataFrame, path: str, schema: T.StructType | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Fixed-schema Parquet sink; an empty frame keeps its columns, an existing path is an error."""
    (typed(df, schema) if schema else df).write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """Small metric tables as one CSV file."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def save_all(df: DataFrame, sinks: dict[str, DataFrame]) -> None:
    """Several sinks of one cached frame, from one pass over its inputs."""
    df.persist()
    try:
        for path, part in sinks.items():
            save(part, path)
    finally:
        df.unpersist()


def read_plan(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Request plan from CSV (header trimmed, short rows padded) or Parquet; fails on blank, repeated or missing headers, over-wide rows, no rows, or blank required values."""
    if not path.rstrip("/").endswith(".csv"):
        df = spark.read.parquet(path)
    else:
        first = spark.read.text(path).limit(1).select(csv_cells(F.regexp_replace("value", "^\ufeff", "")).alias("c")).first()
        header = [h.strip() for h in first["c"]] if first else []
        if len(set(header)) < len(header) or "" in header:
            raise ValueError(f"blank or repeated header: {header}")
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header] + [T.StructField("_extra", T.StringType())])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
        if not df.where("_extra is not null").isEmpty():
            raise ValueError("a row has more values than the header")
        df = df.drop("_extra")
    if absent := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {absent}")
    blank = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull() for c in required]
    if df.isEmpty() or blank and not df.where(F.array_contains(F.array(*blank), True)).isEmpty():
        raise ValueError("empty plan, or a required value is blank")
    return df


def canonical_boundaries(rows: DataFrame, fields: dict[str, list[str]], code: str, required: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """Boundary rows with each field from the first source column that is resolved (blank and -99 are not), and duplicates counted by code. A required field that stays unresolved, or with
    unique a code that occurs again, is an error."""
    pick = lambda names: F.coalesce(*[F.when(~F.trim(F.col(n)).isin("", "-99"), F.trim(F.col(n))) for n in names if n in rows.columns])
    out = rows.select(*[pick(names).alias(name) for name, names in fields.items()], "geometry")
    for c in required:
        if lost := out.where(F.col(c).isNull()).count():
            raise ValueError(f"{lost} boundaries without {c}")
    counts = out.groupBy(code).agg(F.count("*").alias("rows_of_code"))
    if unique and (twice := counts.where("rows_of_code > 1").limit(20).collect()):
        raise ValueError(f"codes of several boundaries: {[r[0] for r in twice]}")
    return out.join(counts, out[code].eqNullSafe(counts[code])).drop(counts[code])


def csv_cells(line: Column) -> Column:
    """Cells of a line of CSV, trimmed; quoted ones may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))
    bare = lambda c: F.when(F.trim(c).startswith('"'), F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(found, lambda c: F.trim(bare(c)))


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, file_sha256, line, cells, labels of the rows of exports. The header is the first line whose first cell is a unit of time; lines without any value are left out."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.sha2("value", 256).alias("file_sha256"), F.regexp_replace("value", "\ufeff|\r", "").alias("text"))
    lines = texts.select("source_file", "file_sha256", F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("cells", csv_cells(F.col("content")))
    lines = lines.where(F.exists("cells", lambda c: c != ""))
    unit = F.lower(F.get("cells", F.lit(0))).isin("date", "day", "week", "month")
    head = lines.where(unit).groupBy("source_file").agg(F.min("line").alias("head_line"), F.min_by("cells", "line").alias("labels"))
    return lines.join(head, "source_file").where("line > head_line").select("source_file", "file_sha256", "line", "cells", "labels")


def export_problems(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line, problem): rows that have another number of cells than the header (width), and dates that a file has twice (date)."""
    rows = export_lines(spark, path)
    width = rows.where(F.size("cells") != F.size("labels")).select("source_file", "line", F.lit("width").alias("problem"))
    twice = rows.groupBy("source_file", F.get("cells", F.lit(0)).alias("date")).agg(F.max("line").alias("line"), F.count("*").alias("n")).where("n > 1")
    return width.unionByName(twice.select("source_file", "line", F.lit("date").alias("problem")))


def export_checks(spark: SparkSession, path: str, sidecars: DataFrame) -> DataFrame:
    """A row for each export: rows, cells of its header, rows of another width, dates that repeat, and whether its labels hold those that its sidecar asked for (null: no sidecar)."""
    rows = export_lines(spark, path)
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    asked = sidecars.select(stem(F.col("sidecar_file")).alias("stem"), "requested_labels")
    by = rows.groupBy("source_file").agg(F.count("*").alias("rows"), F.first("labels").alias("labels"), F.count_if(F.size("cells") != F.size("labels")).alias("odd_rows"), (F.count("*") - F.count_distinct(F.get("cells", F.lit(0)))).alias("repeated_dates"))
    pairs = F.zip_with(F.slice("labels", 2, 100), "requested_labels", lambda have, want: F.coalesce(F.lower(have).contains(F.lower(want)), F.lit(False)))
    joined = by.withColumn("stem", stem(F.col("source_file"))).join(asked, "stem", "left")
    return joined.select("source_file", "rows", F.size("labels").alias("header_cells"), "odd_rows", "repeated_dates", F.when(F.col("requested_labels").isNotNull(), F.forall(pairs, lambda x: x)).alias("labels_match"))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Wide exports in long form: source_file, file_sha256, date_text, position, label, value_text. Rows that are wider or narrower than their header, or repeat a date, are an error."""
    if bad := export_problems(spark, path).limit(20).collect():
        raise ValueError(f"exports with rows that do not fit: {[tuple(r) for r in bad]}")
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    pairs = F.arrays_zip(rest("labels").alias("label"), rest("cells").alias("value"))
    wide = export_lines(spark, path).select("source_file", "file_sha256", F.get("cells", F.lit(0)).alias("date_text"), F.posexplode(pairs).alias("position", "c"))
    return wide.select("source_file", "file_sha256", "date_text", "position", F.col("c.label").alias("label"), F.col("c.value").alias("value_text"))


def read_wide_store(spark: SparkSession, path: str, needs_partial: bool = False) -> DataFrame:
    """The other store's CSV files in long form: date, concept_id, value, is_partial. Columns are date or Day, isPartial and concepts; blank values are left out. needs_partial: a
    table without isPartial is an error."""
    df = spark.read.option("header", True).csv(path)
    if needs_partial and "isPartial" not in df.columns:
        raise ValueError(f"no isPartial column in {path}")
    day = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("date", "Day") if c in df.columns])
    partial = F.lower(F.coalesce(F.col("isPartial"), F.lit(""))) == "true" if "isPartial" in df.columns else F.lit(False)
    concepts = [c for c in df.columns if c not in ("date", "Day", "isPartial")]
    long = df.select(day.alias("date"), partial.alias("is_partial"), *[F.col(f"`{c}`") for c in concepts]).unpivot(["date", "is_partial"], concepts, "concept_id", "text")
    return long.where(F.trim("text") != "").select("date", "concept_id", F.col("text").cast("double").alias("value"), "is_partial")


SIDECAR = "request_id string, backend string, requested_concepts array<string>, requested_labels array<string>, geography string, start_date date, end_date date, episode_id string, anchor_concept_id string, repeat_id string, csv_sha256 string"


def read_sidecars(spark: SparkSession, path: str, backends: list[str]) -> DataFrame:
    """Sidecar metadata with problem, null where it is sound: lists of equal length from 1 to 5, an allowed backend, an end not before the start, a request. What is missing is not sound."""
    df = spark.read.schema(SIDECAR).option("multiLine", True).json(path).withColumn("sidecar_file", F.col("_metadata.file_name"))
    n = F.size("requested_concepts")
    fine = lambda c: F.coalesce(c, F.lit(False))
    lists = fine((n == F.size("requested_labels")) & n.between(1, 5))
    problem = F.when(~lists, "lists").when(~fine(F.col("backend").isin(backends)), "backend").when(~fine(F.col("end_date") >= F.col("start_date")), "dates").when(F.col("request_id").isNull(), "request")
    return df.withColumn("problem", problem)


def inventory(spark: SparkSession, path: str, sidecars: DataFrame) -> DataFrame:
    """A row for each exported file: size, SHA-256, time, and whether it has a sidecar of the same stem."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "length", F.sha2("content", 256).alias("sha256"), "modificationTime")
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    side = sidecars.select(stem(F.col("sidecar_file")).alias("stem"), "request_id", "backend")
    return files.withColumn("stem", stem(F.col("source_file"))).join(side, "stem", "left").withColumn("has_sidecar", F.col("request_id").isNotNull())


def store_counts(inventory: DataFrame) -> DataFrame:
    """Files, bytes, different contents and files with a sidecar of each store."""
    return inventory.groupBy(F.coalesce("backend", F.lit("unknown")).alias("store")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_distinct("sha256").alias("contents"), F.sum(F.col("has_sidecar").cast("long")).alias("with_sidecar"))


def save_sinks(df: DataFrame, path: str, sink: Column, names: tuple[str, ...], schema: T.StructType, total: str | None = None) -> DataFrame:
    """Writes every row of df into the one of several sinks that sink names, by one partitioned write, and returns what that write has counted: (sink, rows, total).

    Counts are observed on the rows as they are written, so nothing is cached, read back or computed twice. A row whose sink
    is none of names, or null, stops the write; sinks without rows are counted as 0.
    """
    known = F.coalesce(sink.isin(*names), F.lit(False))
    checked = F.when(known, sink).otherwise(F.raise_error(F.concat(F.lit("no sink: "), F.coalesce(sink.cast("string"), F.lit("null")))))
    rows = df.withColumn("_sink", checked)
    rows = typed(rows, T.StructType([*schema.fields, T.StructField("_sink", T.StringType())])).withColumnRenamed("_sink", "sink")
    value = F.col(total).cast("double") if total else F.lit(None).cast("double")
    mine = lambda n: F.col("sink") == n
    seen = Observation()
    metrics = [m for i, n in enumerate(names) for m in (F.count_if(mine(n)).alias(f"rows_{i}"), F.sum(F.when(mine(n), value)).alias(f"total_{i}"))]
    rows.observe(seen, *metrics).write.mode("errorifexists").option("compression", "zstd").partitionBy("sink").parquet(path)
    got = seen.get
    return df.sparkSession.createDataFrame([(n, got[f"rows_{i}"], got[f"total_{i}"]) for i, n in enumerate(names)], "sink string, rows long, total double")


def read_sink(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """One of the sinks that save_sinks wrote, with its fixed schema also if no row went there."""
    parts = T.StructType([*schema.fields, T.StructField("sink", T.StringType())])
    return spark.read.schema(parts).parquet(path).where(F.col("sink") == name).drop("sink")


def save_ordered(df: DataFrame, path: str, *order: Column, partitions: int | None = None, rows_per_file: int = 0) -> None:
    """Writes df in a fixed order over many files: the files one after the other by name, and the rows of each as they stand, are df in that order.

    Ranges of the order go to one task each, so that no task sorts everything; rows equal in order stay in one file's neighbourhood but in no
    fixed order among themselves, so end order with a key. footprint_scan numbers the rows again by file name and place. With rows_per_file more partitions are made where a
    task would write so many files that their numbers outgrow the three digits that Spark pads them to.
    """
    if partitions and rows_per_file:
        partitions = max(partitions, -(-df.count() // (rows_per_file * FILES_OF_TASK)))
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)

"""Queries about sources and sinks: each writes files made of the given tables into the shared folder, reads them as the engine's inputs, and has SQL for what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import rounded
from ..operators import cohort as h
from ..operators import imports as m
from ..sources import tables
from ..streaming.imports import import_stream
from .base import SQL, daily, observations, plan, table

LABEL = "{}, all: (US)"


def _sorted_orders(spark, d):
    """Orders in the order of their keys, in several files."""
    path = tables.new_path(spark, "orders")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").write.option("maxRecordsPerFile", 4000).parquet(path)
    return path


def source_index(spark, d):
    return tables.footprint_scan(spark, _sorted_orders(spark, d)).select("o_orderkey", "source_row_index")


def bounded_scan(spark, d):
    """The bound is what is looked at: rows after it don't count."""
    return rounded(tables.footprint_scan(spark, _sorted_orders(spark, d), 5000).agg(F.count("*").alias("rows"), F.max("source_row_index").alias("last_index"), F.sum("o_totalprice").alias("total")), 2)


def schema_inspection(spark, d):
    return tables.inspect_schema(table(spark, d, "customer"), ["c_custkey", "c_name", "geometry"], ["c_acctbal"]).select("field", "type", "role", "warning", F.size("samples").alias("samples"))


def plan_reader(spark, d):
    """Customers as request plans in CSV files with quoted cells."""
    path = tables.new_path(spark, "plan") + ".csv"
    c = table(spark, d, "customer")
    c.select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("seg, "), F.col("c_mktsegment")).alias("panel"), F.col("c_nationkey").alias("geography")).write.option("header", True).csv(path)
    return tables.read_plan(spark, path, ["request_id", "panel"]).groupBy("panel").agg(F.count_distinct("request_id").alias("requests"), F.count_distinct("geography").alias("places"))


def _exports(spark, d):
    """One file for each request and repeat, with a preamble, quoted labels, and values in several spellings; and what was asked for, as sidecars of the files' stems."""
    v = daily(spark, d).withColumn("text", F.when(F.col("value") < 1, "<1").when(F.dayofmonth("date") == 9, F.concat(F.round("value").cast("int").cast("string"), F.lit(" (partial)"))).otherwise(F.round("value").cast("int").cast("string")))
    kinds = sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())
    wide = v.groupBy("request_id", "repeat_id", "date").pivot("concept_id", kinds).agg(F.first("text"))
    line = F.concat_ws(",", F.col("date").cast("string"), *[F.coalesce(F.col(k), F.lit("")) for k in kinds])
    body = wide.groupBy("request_id", "repeat_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    head = ",".join(["Day", *[f'"{LABEL.format(k)}"' for k in kinds]])
    text = F.concat(F.lit("Category: "), "request_id", F.lit(" "), "repeat_id", F.lit("\n\n" + head + "\n"), "body")
    path = tables.new_path(spark, "exports")
    body.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), "[.][^.]*$", ".json").alias("sidecar_file"), F.split(F.regexp_extract("value", "^Category: (.*)", 1), " ").alias("ids"))
    lists = [F.array(*map(F.lit, kinds)).alias("requested_concepts"), F.array(*[F.lit(k.upper() + ", ALL") for k in kinds]).alias("requested_labels")]
    return path, read.select("sidecar_file", F.get("ids", F.lit(0)).alias("request_id"), F.get("ids", F.lit(1)).alias("repeat_id"), *lists, F.lit(None).cast("string").alias("problem"), F.lit("csv").alias("backend"))


def export_observations(spark, d):
    path, sidecars = _exports(spark, d)
    rows = m.long_observations(tables.read_exports(spark, path), sidecars)
    return rows.select("request_id", "repeat_id", "concept_id", "date", "interest", "is_partial", "value_class", "label_matches")


def export_checks(spark, d):
    path, sidecars = _exports(spark, d)
    return tables.export_checks(spark, path, sidecars.where("repeat_id = 'repeat_1'")).groupBy("rows", "header_cells", "odd_rows", "repeated_dates", "labels_match").agg(F.count("*").alias("files"))


def acquisition_inventory(spark, d):
    path, sidecars = _exports(spark, d)
    return tables.store_counts(tables.inventory(spark, path, sidecars.where("repeat_id = 'repeat_1'"))).drop("bytes")


def sidecar_problems(spark, d):
    """Customers as sidecars, some without what they must have; one file each would be a file for every row, so that a file holds the sidecars of a nation."""
    k = F.col("c_custkey")
    some = table(spark, d, "customer").select(
        F.concat(F.lit("q"), k).alias("request_id"), F.when(k % 5 > 0, F.when(k % 5 == 1, "other").otherwise("csv")).alias("backend"), F.when(k % 7 > 0, F.array(F.lit("a"), F.lit("b"))).alias("requested_concepts"),
        F.when(k % 11 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("requested_labels"), F.lit("2024-01-05").alias("start_date"), F.when(k % 13 > 1, "2024-01-09").when(k % 13 == 1, "2024-01-01").alias("end_date"), "c_nationkey",
    )
    path = tables.new_path(spark, "sidecars")
    one = some.groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct(*[c for c in some.columns if c != "c_nationkey"]))).alias("value")).select("value")
    one.write.option("maxRecordsPerFile", 1).text(path)
    return tables.read_sidecars(spark, path, ["csv"]).groupBy("problem").agg(F.count("*").alias("sidecars"))


def wide_store(spark, d):
    path = tables.new_path(spark, "store")
    kinds = sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())
    w = daily(spark, d).groupBy("request_id", "repeat_id", "date").pivot("concept_id", kinds).agg(F.first("value"))
    w.select(F.col("date").cast("string").alias("date"), *kinds, F.when(F.dayofmonth("date") == 9, "True").otherwise("False").alias("isPartial")).write.option("header", True).csv(path)
    rows = tables.read_wide_store(spark, path, needs_partial=True)
    return rounded(rows.groupBy("date", "concept_id", "is_partial").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


def written_sinks(spark, d):
    """Three sinks of one pass, with a fixed schema each, read back."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("flag", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("note", T.StringType())])
    rows = tables.typed(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price")), schema)
    paths = {f: tables.new_path(spark, f"sink-{f}") for f in "ANR"}
    tables.save_all(rows, {p: rows.where(F.col("flag") == f) for f, p in paths.items()})
    out = None
    for f, p in paths.items():
        one = spark.read.parquet(p).agg(F.lit(f).alias("sink"), F.count("*").alias("rows"), F.sum("price").alias("total"), F.count("note").alias("notes"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 2)


def metric_sink(spark, d):
    path = tables.new_path(spark, "metrics")
    tables.save_csv(table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.max("l_quantity").alias("most")), path)
    return spark.read.option("header", True).csv(path).select(F.col("l_returnflag"), F.col("rows").cast("long").alias("rows"), F.col("most").cast("double").alias("most"))


def streamed_import(spark, d):
    """Observations land in two lots, of which the second repeats some of the first; a stream imports each once."""
    land, store, state = (tables.new_path(spark, n) for n in ("landing", "store", "progress"))
    one = observations(spark, d).groupBy("request_id", "repeat_id", "concept_id", "date").agg(F.min("interest").alias("interest"), F.bool_or("is_partial").alias("is_partial"))
    for lot, rows in enumerate((one.where("date < '2024-01-20'"), one.where("date > '2024-01-10'"))):
        rows.write.parquet(f"{land}/lot={lot}")
        import_stream(spark, f"{land}/*", store, state).awaitTermination()
    return rounded(spark.read.parquet(store).groupBy("request_id", "concept_id").agg(F.count("*").alias("rows"), F.sum("interest").alias("total")), 4)


def admission_violations(spark, d):
    """Observations with values out of range and made-up ones against a plan that lacks a concept and a repeat."""
    o = observations(spark, d).withColumn("interest", F.when(F.col("event_id") % 501 == 0, 250.0).when(F.col("event_id") % 502 == 0, float("nan")).otherwise(F.col("interest")))
    o = o.withColumn("data_origin", F.when(F.col("event_id") % 503 == 0, "synthetic_fixture").otherwise("observed")).withColumn("is_partial", F.when(F.col("event_id") % 97 != 1, F.col("is_partial")))
    p = plan(spark, d).where("role <> 'national'").select("request_id", F.explode(F.array(F.lit("repeat_1"), F.lit("repeat_2"))).alias("planned_repeat_id"), F.lit("click;view;purchase;signup").alias("concept_ids"))
    return m.admission_violations(o, p).groupBy("problem").agg(F.count("*").alias("observations"))


def intersecting_events(spark, d):
    """By the state union's flag where the table has it, else by the country's."""
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3 == 0).alias("intersects_united_states"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 2 == 0).alias("intersects_us_state_union"))
    count = lambda df, name: h.intersecting(df).groupBy("o_orderpriority").agg(F.count("*").alias(name))
    return count(o, "by_states").join(count(o.drop("intersects_us_state_union"), "by_country"), "o_orderpriority")


_T = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END"
ORACLE = {
    "source_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS source_row_index FROM orders",
    "bounded_scan": "SELECT count(*) AS rows, max(i) AS last_index, round(sum(o_totalprice), 2) AS total FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i < 5000",
    "schema_inspection": f"""SELECT column_name AS field, {_T} AS type, CASE WHEN column_name IN ('c_custkey', 'c_name') THEN 'required' WHEN column_name = 'c_acctbal' THEN 'optional' ELSE 'unknown' END AS role, CASE WHEN column_name NOT IN ('c_custkey', 'c_name', 'c_acctbal') THEN 'unknown field' END AS warning, 3 AS samples
FROM information_schema.columns WHERE table_name = 'customer' UNION ALL SELECT 'geometry', NULL, 'missing', 'required field is missing', 0""",
    "plan_reader": "SELECT 'seg, ' || c_mktsegment AS panel, count(*) AS requests, count(DISTINCT c_nationkey) AS places FROM customer GROUP BY 1",
    "export_observations": f"""WITH {SQL}, k AS (SELECT DISTINCT event_type AS concept_id FROM events), g AS (SELECT DISTINCT request_id, repeat_id, date FROM daily)
SELECT request_id, repeat_id, concept_id, date, CASE WHEN value < 1 THEN 0.0 ELSE CAST(floor(value + 0.5) AS DOUBLE) END AS interest, coalesce(value >= 1 AND day(date) = 9, FALSE) AS is_partial,
CASE WHEN value IS NULL THEN 'missing' WHEN value < 1 THEN 'reported_zero_low_volume' ELSE 'true_zero_unknown' END AS value_class, TRUE AS label_matches FROM g CROSS JOIN k LEFT JOIN daily USING (request_id, repeat_id, concept_id, date)""",
    "export_checks": f"WITH {SQL}, g AS (SELECT request_id, repeat_id, count(DISTINCT date) AS rows FROM daily GROUP BY 1, 2) SELECT rows, CAST((SELECT count(DISTINCT event_type) + 1 FROM events) AS INT) AS header_cells, CAST(0 AS BIGINT) AS odd_rows, CAST(0 AS BIGINT) AS repeated_dates, CASE WHEN repeat_id = 'repeat_1' THEN TRUE END AS labels_match, count(*) AS files FROM g GROUP BY 1, 5",
    "acquisition_inventory": f"WITH {SQL}, g AS (SELECT DISTINCT request_id, repeat_id FROM daily) SELECT CASE WHEN repeat_id = 'repeat_1' THEN 'csv' ELSE 'unknown' END AS store, count(*) AS files, count(*) AS contents, count(*) FILTER (repeat_id = 'repeat_1') AS with_sidecar FROM g GROUP BY 1",
    "sidecar_problems": "SELECT CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'lists' WHEN c_custkey % 5 < 2 THEN 'backend' WHEN c_custkey % 13 < 2 THEN 'dates' END AS problem, count(*) AS sidecars FROM customer GROUP BY 1",
    "wide_store": f"WITH {SQL} SELECT CAST(date AS VARCHAR) AS date, concept_id, day(date) = 9 AS is_partial, count(*) AS n, round(sum(value), 4) AS total FROM daily GROUP BY 1, 2, 3",
    "written_sinks": "SELECT l_returnflag AS sink, count(*) AS rows, round(sum(l_extendedprice), 2) AS total, CAST(0 AS BIGINT) AS notes FROM lineitem GROUP BY 1",
    "metric_sink": "SELECT l_returnflag, count(*) AS rows, max(l_quantity) AS most FROM lineitem GROUP BY 1",
    "streamed_import": f"WITH {SQL}, o AS (SELECT request_id, repeat_id, concept_id, date, min(interest) AS interest FROM obs GROUP BY 1, 2, 3, 4) SELECT request_id, concept_id, count(*) AS rows, round(sum(interest), 4) AS total FROM o GROUP BY 1, 2",
    "admission_violations": f"""WITH {SQL}, o AS (SELECT obs.*, event_id % 501 = 0 OR event_id % 502 = 0 AS bad, role FROM obs JOIN plan USING (request_id)) SELECT * FROM (
SELECT 'outside_plan' AS problem, count(*) AS observations FROM o WHERE role = 'national' OR concept_id NOT IN ('click', 'view', 'purchase', 'signup') UNION ALL SELECT 'repeated_identity', count(*) FROM (SELECT 1 FROM obs GROUP BY request_id, repeat_id, concept_id, date HAVING count(*) > 1)
UNION ALL SELECT 'no_partial_flag', count(*) FROM o WHERE event_id % 97 = 1 UNION ALL SELECT 'out_of_range', count(*) FROM o WHERE bad UNION ALL SELECT 'synthetic', count(*) FROM o WHERE event_id % 503 = 0) WHERE observations > 0""",
    "intersecting_events": "SELECT o_orderpriority, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 2 = 0) AS by_states, count(*) FILTER (o_orderkey % 3 = 0) AS by_country FROM orders GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (source_index, bounded_scan, schema_inspection, plan_reader, export_observations, export_checks, acquisition_inventory, sidecar_problems, wide_store, written_sinks, metric_sink, streamed_import, admission_violations, intersecting_events)}

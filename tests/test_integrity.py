"""Plan integrity, the check inside a plan, exact order statistics by refined ranges."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import integrity, selection

DESIGN = integrity.Design(("treated", "control"), {"p": ("a",)}, ("r1",), ("csv",), "v")


def rows(spark, *changes):
    base = {"request_id": "q", "planned_repeat_id": "r1", "episode_id": "e", "role": "treated", "panel": "p", "pair_id": "x", "concept_ids": "a", "terminology_version": "v"}
    base |= {"backend": "csv", "event_start": "2024-01-01", "event_end": "2024-01-02", "window_start": "2023-12-01", "window_end": "2024-02-01", "category": "0", "search_property": "web"}
    assert tuple(base) == integrity.PLAN_FIELDS
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], ", ".join(f"{c} string" for c in base))


def catalog(spark, *extra):
    return spark.createDataFrame([("e", "retained", "2024-01-01", "2024-01-02"), *extra], "episode_id string, status string, episode_start string, episode_end string")


def kinds(found):
    return sorted((r["kind"], r["detail"]) for r in found.collect())


def test_sound_plan_has_no_violation(spark):
    plan = rows(spark, {}, {"request_id": "q2", "role": "control"})
    assert kinds(integrity.design_violations(plan, catalog(spark), DESIGN)) == []


@pytest.mark.parametrize(
    "change, want",
    [
        ({"category": None}, {("empty_field", "category")}),
        ({"panel": None}, {("empty_field", "panel"), ("outside_design", "treated/r1"), ("panel_concepts", ""), ("incomplete_design", "treated/p/r1")}),
        ({"episode_id": "z"}, {("not_in_catalog", ""), ("incomplete_design", "control/p/r1"), ("incomplete_design", "treated/p/r1"), ("shared_pair", "x")}),
        ({"event_end": "2024-01-03"}, {("dates_conflict", "")}),
        ({"pair_id": "y"}, {("several_pairs", "")}),
        ({"planned_repeat_id": "r9"}, {("outside_design", "treated/p/r9"), ("incomplete_design", "treated/p/r1")}),
        ({"concept_ids": "a;b"}, {("panel_concepts", "p")}),
        ({"backend": "other"}, {("backend", "other")}),
        ({"role": "control"}, {("repeated_slot", "control/p/r1"), ("incomplete_design", "treated/p/r1")}),
        ({"request_id": "q2"}, {("repeated_request", "r1"), ("request_changes", "")}),
    ],
)
def test_violations(spark, change, want):
    plan = rows(spark, change, {"request_id": "q2", "role": "control"})
    assert set(kinds(integrity.design_violations(plan, catalog(spark), DESIGN))) == want


def test_empty_plan_and_crowded_catalog(spark):
    plan = rows(spark, {})
    assert kinds(integrity.design_violations(plan.limit(0), catalog(spark), DESIGN)) == [("no_episode", "")]
    found = integrity.design_violations(plan, catalog(spark, ("e", "retained", "2024-01-01", "2024-01-02")), integrity.Design(("treated",), {"p": ("a",)}, ("r1",), ("csv",), "v", most_episodes=0))
    assert kinds(found) == [("repeated_in_catalog", ""), ("too_many_episodes", "1")]


def test_guard_is_part_of_the_plan(spark):
    rows_ = spark.range(1000).withColumn("v", F.col("id") * 2)
    fine = integrity.guarded(rows_, rows_.where("id < 0"), "ids")
    assert fine.columns == rows_.columns and fine.agg(F.sum("v")).first()[0] == 999_000
    broken = integrity.guarded(rows_, rows_.where("id >= 950"), "late ids")  # nothing runs yet
    with pytest.raises(PySparkException, match=r"late ids: 50 violations, .*\"id\":950"):
        broken.collect()


def brute_discrete(x, share):
    return sorted(x)[max(1, math.ceil(round(share * 1000) * len(x) / 1000 - 1e-9)) - 1]


@pytest.mark.parametrize("buckets", [20, 1024])
def test_order_statistics(spark, buckets):
    rng = np.random.default_rng(buckets)
    groups = {
        "normal": rng.standard_normal(501).tolist(),
        "ties": rng.integers(0, 4, 400).astype(float).tolist(),
        "one": [3.5],
        "two": [1.0, 2.0],
        "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0] * 3,
        "infinite": [float("-inf"), float("inf"), 1.0, 2.0],
        None: [7.0] * 50,
    }
    if buckets == 1024:
        groups["skewed"] = (10 ** rng.uniform(-8, 8, 3000)).tolist()
    data = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r["g"]: r["median"] for r in selection.medians(df, ("g",), "x", buckets).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(statistics.median(xs), rel=1e-15) or math.isnan(statistics.median(xs)) or xs[0] == float("-inf")
    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in selection.discrete(df, ("g",), "x", shares, buckets).collect():
        assert {n: r[n] for n in shares} == {n: brute_discrete(groups[r["g"]], s) for n, s in shares.items()}
    assert selection.medians(df.where("x > 2"), (), "x", buckets).first()["median"] == statistics.median(x for xs in groups.values() for x in xs if x > 2)
    assert selection.medians(df.where("x is null"), ("g",), "x").count() == 0


def test_one_write_serves_all_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    from tidemark.sources import tables

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType())])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 1000, 1, 3).mapInArrow(count, "id long")
    path = str(tmp_path / "sinks")
    got = {r["sink"]: (r["rows"], r["total"]) for r in tables.save_sinks(rows, path, F.when(F.col("id") % 4 == 0, "a").otherwise("b"), ("a", "b", "c"), schema, "id").collect()}
    assert got == {"a": (250, 124500.0), "b": (750, 375000.0), "c": (0, None)} and seen.value == 1000  # inputs were read once
    assert {n: tables.read_sink(spark, path, n, schema).count() for n in "abc"} == {"a": 250, "b": 750, "c": 0}
    assert tables.read_sink(spark, path, "c", schema).columns == ["id", "note"]
    with pytest.raises(PySparkException, match="no sink: 7"):
        tables.save_sinks(spark.range(9), str(tmp_path / "bad"), F.col("id").cast("string"), ("0", "1", "2", "3", "4", "5", "6", "8"), schema)


def test_files_in_the_order_of_their_names_are_the_sorted_rows(spark, tmp_path):
    from tidemark.sources import tables

    rows = spark.range(500).select("id", (F.col("id") * 37 % 11).alias("k"))
    path = str(tmp_path / "ordered")
    tables.save_ordered(rows, path, F.desc("k"), F.asc("id"), partitions=4, rows_per_file=60)
    got = [r["id"] for r in tables.footprint_scan(spark, path).orderBy("source_row_index").collect()]
    assert got == sorted(range(500), key=lambda i: (-(i * 37 % 11), i))


def test_decisions_are_closed(spark):
    from tidemark.operators import decisions

    d = "episode_key long, action string, groups string, merge_with string, cross_split_override boolean, reviewer string, reason string"
    members = spark.createDataFrame([(10 * k + i, k, "test" if k == 4 else "dev") for k in range(1, 8) for i in range(2)], "event_id long, episode_key long, split string")
    made = spark.createDataFrame([(1, "merge", None, "2", True, "r", "x"), (2, "merge", None, "3;4", True, "r", "x"), (5, "split", "50|51", None, False, "r", "x"), (6, "retain", None, None, False, "r", "x")], d)
    assert decisions.violations(made, members).count() == 0
    got = {}
    for r in decisions.applied(made, members).collect():
        got.setdefault(r["new_id"], set()).add((r["event_id"], r["action"]))
    assert sorted(sorted(e for e, _ in x) for x in got.values()) == [[10, 11, 20, 21, 30, 31, 40, 41], [50], [51], [60, 61], [70, 71]]
    assert {frozenset(a for _, a in x) for x in got.values()} == {frozenset([a]) for a in ("merge", "split", "retain", "keep")}
    bad = spark.createDataFrame([(1, "merge", None, "2", False, "r", "x"), (2, "merge", None, "4", False, "r", " "), (4, "retain", None, None, False, "r", "x"), (5, "merge", None, "5; ", False, "r", "x"), (7, "split", "70|70;71", None, False, None, "x")], d)
    found = {(r["episode_key"], r["problem"]) for r in decisions.violations(bad, members).collect()}
    assert found == {(2, "no_reviewer"), (7, "no_reviewer"), (5, "merge_of_one"), (4, "merged_and_decided"), (2, "crosses_split"), (7, "groups_not_a_partition"), *((k, "chain_crosses_split") for k in (1, 2, 4))}


def test_required_states_fail_closed_and_break_ties_by_id(spark):
    from tidemark.operators import greedy

    cols = "id string, year int, state string, h string, season string, coastal boolean, member_class string, footprint string, compact string"
    same = ("5", "winter", True, "singleton", "small", "spread")
    sample = spark.createDataFrame([("a1", 2020, "A", *same), ("a2", 2020, "A", *same)], cols)
    more = spark.createDataFrame([("z1", 2020, "Z", *same), ("z2", 2020, "Z", *same), ("y1", 2021, "Y", *same)], cols)
    got = [(r["added_id"], r["removed_id"]) for r in greedy.with_required_states(sample, more, ["Z"], 2).orderBy("step").collect()]
    assert got == [("z2", "a2"), ("z1", "a1")]
    with pytest.raises(ValueError, match=r"Y \(no_swap\)"):
        greedy.with_required_states(sample, more, ["Y"], 1)
    rows = greedy.with_required_states(sample, more, ["X", "Z"], 1, strict=False).orderBy("step").collect()
    assert [(r["required_state"], r["added_id"], r["problem"]) for r in rows] == [("X", None, "few_candidates"), ("Z", "z2", None)]


def test_batches_read_the_parts_they_touch_and_put_conflicts_aside(spark, tmp_path):
    import datetime as dt

    from tidemark.streaming import imports

    store = str(tmp_path / "store")
    day = dt.date(2024, 1, 1)
    frame = lambda rows: spark.createDataFrame(rows, imports.SCHEMA)
    many = [(f"q{k}", "r", "c", day, float(k), False) for k in range(60)]
    imports.import_parted_batch(frame(many), store, 0, 16)
    some = [("q1", "r", "c", day, 1.0, False), ("q1", "r", "c", day + dt.timedelta(1), 5.0, False), ("q1", "r", "c", day + dt.timedelta(1), 4.0, True), ("q1", "r", "d", day, None, None), ("q1", "r", "d", day, None, None)]
    for _ in range(2):  # a batch that is tried again changes nothing
        imports.import_parted_batch(frame(some), store, 1, 16)
    imports.import_parted_batch(frame([("q1", "r", "c", day, None, False), ("q1", "r", "d", day, None, None)]), store, 2, 16)
    imports.import_parted_batch(frame([]), store, 3, 16)
    log = {r["import_batch"]: tuple(r[c] for c in ("rows", "added", "repeated", "conflicting", "parts")) for r in spark.read.parquet(f"{store}/log").collect()}
    assert log == {0: (60, 60, 0, 0, 16), 1: (4, 2, 1, 1, 1), 2: (2, 0, 1, 1, 1), 3: (0, 0, 0, 0, 0)}
    read = {r["import_batch"]: r["files_read"] for r in spark.read.parquet(f"{store}/log").collect()}
    assert read[0] == 0 and 0 < read[1] <= 4 and read[3] == 0  # of the files of 16 parts those of one
    aside = {(r["import_batch"], r["interest"], r["old_interest"]) for r in spark.read.parquet(f"{store}/conflicts").collect()}
    assert aside == {(1, 5.0, 4.0), (2, None, 1.0)}
    kept = {(r["request_id"], r["concept_id"], r["date"], r["interest"]) for r in spark.read.parquet(f"{store}/rows").collect()}
    assert kept == {(q, c, d, v) for q, _, c, d, v, _ in many} | {("q1", "c", day + dt.timedelta(1), 4.0), ("q1", "d", day, None)}


def test_splits_filters_and_schemas_fail_closed(spark):
    import datetime as dt

    from pyspark.sql import types as T

    from tidemark.operators import cohort, sampling
    from tidemark.sources import tables

    windows = [("a", "2024-01-01", "2024-01-31")]
    rows = spark.createDataFrame([(dt.date(2024, 1, k),) for k in (1, 31)], "start date")
    assert {r["split"] for r in cohort.require_split(rows, "start", windows).collect()} == {"a"}
    for bad in (dt.date(2024, 2, 1), None):
        with pytest.raises(PySparkException, match="dates outside all splits: 1 violations"):
            cohort.require_split(rows.unionByName(spark.createDataFrame([(bad,)], "start date")), "start", windows).count()
    plan = spark.createDataFrame([("q2", "r1", "p"), ("q1", "r2", "p"), ("q1", "r1", "o")], "request_id string, planned_repeat_id string, panel string")
    assert [r["request_id"] for r in sampling.filtered(plan, panel="p").collect()] == ["q1", "q2"]
    assert [tuple(r) for r in sampling.filtered(plan, 1, panel=["p", "o"]).collect()] == [("q1", "r1", "o")]
    with pytest.raises(ValueError, match="no columns"):
        sampling.filtered(plan, place="p")
    with pytest.raises(PySparkException, match="no plan row"):
        sampling.filtered(plan, panel="x").collect()
    schema = T.StructType([T.StructField("panel", T.StringType())])
    assert tables.conforming(plan, schema).columns == ["panel"]
    with pytest.raises(ValueError, match=r"panel \(bigint, found string\), none \(string, found None\)"):
        tables.conforming(plan, T.StructType([T.StructField("panel", T.LongType()), T.StructField("none", T.StringType())]))


def test_rows_without_key_are_copies_of_nothing(spark):
    from tidemark.operators import quality

    rows = spark.createDataFrame([(None, 1, k) for k in range(50)] + [("a", 1, 100), ("a", 2, 101), ("b", 1, 102)], "key string, v int, place long")
    got = quality.with_duplicates(rows, "key", ["v"], "place")
    assert {(r["key"], r["copies"], r["conflict"]) for r in got.collect()} == {(None, 1, False), ("a", 2, True), ("b", 1, False)} and got.count() == 53
    assert all(r["first_of_key"] == r["place"] == r["last_of_key"] for r in got.where("key is null").collect())


def test_shares_of_overlapping_boundaries_are_of_their_union(spark):
    from tidemark.operators import spatial

    found = spark.createDataFrame([(1, "a", 6.0), (1, "b", 4.0), (2, "a", 0.0)], "event_id long, code string, overlap_km2 double")
    events = spark.createDataFrame([(1, 10.0), (2, 1.0)], "event_id long, area_km2_shape double")
    union = spark.createDataFrame([(1, 8.0)], "event_id long, union_km2 double")
    assert [r["union_fraction"] for r in spatial.ranked(found, events, union).orderBy("event_id", "code").collect()] == [0.75, 0.5, None]
    assert [r["union_fraction"] for r in spatial.ranked(found, events).orderBy("event_id", "code").collect()] == [0.6, 0.4, None]

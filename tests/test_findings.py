"""Faults that a review found, each on the fewest rows that show it."""

from __future__ import annotations

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.config import SHORT
from tidemark.functions import expr, geometry
from tidemark.llm import pii, queries
from tidemark.operators import episodes, evidence, integrity, quality, series
from tidemark.sources import tables


@pytest.mark.parametrize("name, users", [("lineage_integrity", (16, 31, 376, 450)), ("source_recheck", (60, 129))])
def test_faults_that_small_tables_lack(spark, tmp_path, name, users):
    """Requests 6, 11, 126 and 150 are planned twice or have other repeats; 20 and 43 have two sources, of which one is lost."""
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = [(i, u, k, datetime.datetime(2024, 1, 1 + i % 30, 5), 1.0 * i) for i, (u, k) in enumerate((u, k) for u in users for k in kinds for _ in range(20))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = plans.queries()[name](spark, str(tmp_path))
    cur = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(map(repr, cur.fetchall()))


def test_first_repeat_that_has_a_peak(spark):
    day = datetime.date(2024, 1, 2)
    rows = [("q", "c", "r1", 1.0, 1.0, 1.0, "insufficient_post", None), ("q", "c", "r2", 2.0, 2.0, 2.0, "usable", day)]
    df = spark.createDataFrame(rows, "request_id string, concept_id string, repeat_id string, lift_absolute double, lift_z double, lift_robust double, quality string, peak_date date")
    got = series.repeat_aggregate(df).collect()
    assert [(r["peak_date"], r["quality"]) for r in got] == [(day, "insufficient_post")]


def test_order_of_more_files_than_three_digits_number(spark, tmp_path):
    df = spark.range(1100).select(F.col("id").alias("k"))
    tables.save_ordered(df, str(tmp_path / "many"), F.desc("k"), partitions=1, rows_per_file=1)
    got = tables.footprint_scan(spark, str(tmp_path / "many")).collect()
    assert len(got) == 1100 and all(r["k"] == 1099 - r["source_row_index"] for r in got)
    df.coalesce(1).sort("k").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "one"))
    assert all(r["k"] == r["source_row_index"] for r in tables.footprint_scan(spark, str(tmp_path / "one")).collect())


def test_families_are_no_cartesian_product(spark):
    """A dictionary that comes out of a large table is sent to the tasks, whatever Spark takes its size to be."""
    day = datetime.date(2024, 1, 2)
    s = spark.createDataFrame([("q", "r", "buy", day, 1.0), ("q", "r", "see", day, 2.0)], "request_id string, repeat_id string, concept_id string, date date, value double")
    families = spark.createDataFrame([("buy", "demand"), ("see", "awareness")], "concept_id string, family string")
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        plan = evidence.concurrence(s, families, SHORT)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, was)
    assert "CartesianProduct" not in plan


def test_small_and_large_components_are_measured_alike(spark):
    """Boxes of components below and above SMALL: unions and spans equal looking at every square and pair; few boxes need no Python group."""
    rng = random.Random(5)
    boxes = {}
    for component, n in enumerate((1, 2, 3, 7, episodes.SMALL, episodes.SMALL + 9)):
        boxes[component] = [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(n)]]
    rows = [(100 * k + i, k, bytearray(geometry.box(*[1000.0 * v for v in b])), *[1000.0 * v for v in b]) for k, bs in boxes.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "event_id long, component long, geometry binary, minx double, miny double, maxx double, maxy double")
    df = df.withColumns({"is_box": F.lit(True), "policy": F.lit("p"), "point_x": (F.col("minx") + F.col("maxx")) / 2, "point_y": (F.col("miny") + F.col("maxy")) / 2, "area_km2_shape": (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) / 1e6})
    members = df.select("policy", "component", "event_id")
    areas = {r["component"]: r["union_km2"] for r in episodes.union_areas(members, df).collect()}
    far = {r["component"]: r["largest_distance_km"] for r in episodes.spans(members, df).collect()}
    for k, bs in boxes.items():
        assert areas[k] == pytest.approx(len({(x, y) for a, b, c, d in bs for x in range(a, c) for y in range(b, d)}))
        middle = [((a + c) / 2, (b + d) / 2) for a, b, c, d in bs]
        assert far[k] == pytest.approx(max(math.dist(p, q) for p in middle for q in middle))
    alone = df.groupBy("component").agg(F.collect_list(F.struct("minx", "miny", "maxx", "maxy")).alias("b")).select("component", episodes.union_of_boxes("b").alias("m2"))
    assert {r["component"]: pytest.approx(r["m2"] / 1e6) for r in alone.collect()} == areas


def test_license_phrases_of_the_contract(spark, tmp_path):
    rows = [(1, "mit MIT"), (2, "released Under the MIT-License, under the mit license"), (3, "under the old mit license"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in queries.op12_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0, None, None, ""), 2: (9, 2, 1, 5, "mit"), 3: (5, 0, None, None, ""), 4: (0, 0, None, None, "")}


def test_halves_round_as_in_sql(spark):
    values = [1.0171875, 2.0490625, -1.0171875, 0.1234565, 1e-7, 1e305, float("inf"), None]
    got = [r["v"] for r in expr.rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]


def test_days_are_added_up_in_order(spark):
    """The first value alone in its part: the other two summed first would give 0.5 and then 0.6."""
    day = datetime.date(2024, 1, 2)
    rows = [(i, "q", "r", "c", day, v, False) for i, v in enumerate((0.1, 0.2, 0.3))]
    df = spark.sparkContext.parallelize([rows[:1], rows[1:]], 2).flatMap(lambda x: x).toDF("event_id long, request_id string, repeat_id string, concept_id string, date date, interest double, is_partial boolean")
    assert [r["value"] for r in series.daily(df, "event_id").collect()] == [(0.1 + 0.2 + 0.3) / 3]


def test_training_reads_every_document(spark, monkeypatch):
    """One plain address in each of more documents than a model was once trained on: each gives one example."""
    n = 110_000
    docs = spark.range(n, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to a"), F.col("id").cast("string"), F.lit("@mail.example soon")).alias("text"))
    seen = []
    monkeypatch.setattr(pii, "fit", lambda counts: seen.extend(counts) or pii.Model())
    pii.train(docs)
    assert sum(hits for _, _, hits, _ in seen) == n


def test_duplicates_are_profiled_without_dealing_rows_out_for_each_column(spark):
    rows = [(1, 1, "x"), (1, 1, "x"), (2, 1, "x"), (2, 2, "x"), (3, None, "x"), (3, 1, "y"), (3, 1, "y"), (4, None, None), (4, None, None), (5, 1, "x")]
    out = quality.duplicate_profile(spark.createDataFrame(rows, "k long, a int, b string"), "k", ["a", "b"])
    assert out.first().asDict() == {"groups": 4, "rows": 9, "extra_rows": 5, "exact_copies": 3, "conflicting_groups": 2, "conflicts_a": 2, "conflicts_b": 1}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_controls_are_chosen_without_dealing_pairs_of_episodes_and_states(spark):
    """which states are taken is looked up by span of days; choices equal a plain search, and nothing is shuffled by episode."""
    r, day = random.Random(4), datetime.date(2024, 1, 1)
    at = lambda: day + datetime.timedelta(r.randrange(120))
    states = [(k, k % 3, r.choice(["a", "b", "unknown"]), r.choice(["x", "unknown", None]), r.choice([True, False, None])) for k in range(9)]
    events = [(k, r.randrange(9), s, s + datetime.timedelta(r.randrange(5))) for k in range(200) for s in [at()]]
    busy = [(r.randrange(9), s, s + datetime.timedelta(r.randrange(40))) for _ in range(12) for s in [at()]]
    want, about = [], {s[0]: s for s in states}
    for k, own, start, end in events:
        lo, hi = start - datetime.timedelta(7), end + datetime.timedelta(7)
        free = [s for s in states if s[0] != own and not any(b[0] == s[0] and b[1] <= hi and lo <= b[2] for b in busy)]
        like = lambda s, i: s[i] is not None and s[i] != "unknown" and s[i] == about[own][i]  # noqa: E731, B023
        scored = sorted((-(4 * like(s, 1) + 2 * like(s, 2) + like(s, 3) + (s[4] is True)), s[0]) for s in free)
        want += [(k, s, -less, n + 1) for n, (less, s) in enumerate(scored[:3])]
    got = evidence.select_controls(spark.createDataFrame(events, "episode_id long, state int, start date, end date"), spark.createDataFrame(states, "state int, region int, tier string, climate string, available boolean"), spark.createDataFrame(busy, "state int, first date, last date"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert "hashpartitioning(episode_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_catalog_makes_no_members_of_policies_that_it_does_not_look_at(spark, sf_dir):
    """F16-F22."""
    from tidemark.plans import cohort_queries

    members = cohort_queries.cataloged(spark, sf_dir)[1]
    assert {r["policy"] for r in members.select("policy").distinct().collect()} == {"conservative", "balanced"}


def test_events_without_edges_are_episodes_without_joins(spark, sf_dir):
    """F16-F21: they equal what the general way makes of them; boxes' pairs are scored without a join with the events."""
    from tidemark.plans import space_queries as q

    edges, linked, members, alone = q.parted(spark, sf_dir)
    assert 0 < alone.count() == q.footprints(spark, sf_dir).count() - linked.count()
    lone, rules = episodes.lone_members(alone, list(q.ALL)), list(q.ALL)
    general, short = episodes.rollup(lone, alone, edges.limit(0)), episodes.lone_episodes(alone, rules).drop("area_km2_shape")
    assert sorted(map(repr, general.select(short.columns).collect())) == sorted(map(repr, short.collect())) and general.schema.simpleString() == short.select(general.columns).schema.simpleString()
    assert sorted(map(repr, episodes.union_areas(lone, alone).collect())) == sorted(map(repr, episodes.lone_areas(alone, rules).collect()))
    assert q.pairs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_pair_diagnostics_count_pairs_and_participants_from_one_row_each(spark):
    """no join with the events, and no row for each rule that a pair keeps."""
    r, day = random.Random(8), datetime.date(2023, 12, 28)
    rows = [(a, b, r.randrange(4), r.choice([1.0, 7.0, 20.0, 30.0]), r.choice(["1", "2", "1;2"]), r.random() < 0.3, day + datetime.timedelta(r.randrange(8)), day + datetime.timedelta(r.randrange(8))) for a in range(20) for b in range(a + 1, 20) if r.random() < 0.4]
    df = episodes.pair_diagnostics(spark.createDataFrame(rows, "a long, b long, gap_days int, distance_km double, shared_states string, contact boolean, start_a date, start_b date"))
    want: dict = {}
    for a, b, gap, km, states, contact, s, t in rows:
        for k in ((s.year, st, f"gap_{n}", w) for st in states.split(";") for n in range(3) if gap <= n for w, ok in (("intersects", contact), ("within_5km", km <= 5), ("within_10km", km <= 10), ("within_25km", km <= 25)) if ok and s.year == t.year):
            pairs, who = want.setdefault(k, [0, set()])
            want[k][0] = pairs + 1
            who.update((a, b))
    assert {(x["year"], x["state"], x["time_rule"], x["space_rule"]): (x["pairs"], x["participants"]) for x in df.collect()} == {k: (n, len(who)) for k, (n, who) in want.items()}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_models_and_thresholds_come_from_every_fold(spark):
    """a look-alike that stands in the documents of one fold alone, whichever it is, keeps its form from being accepted, and no fold is left out of the trees."""
    cell = lambda v: dict.fromkeys(pii.FEATURES, 0) | {next(f for f in pii.FEATURES if f != "kind"): v}
    even = [(cell(v), 100, 100 * v, fold) for fold in range(pii.FOLDS) for v in (0, 1)]
    assert pii.fit(even).thresholds[0] < float("inf")
    for fold in range(pii.FOLDS):
        assert pii.fit([*even, (cell(1), 10_000, 0, fold)]).thresholds[0] == float("inf")
    assert pii.fit([x for x in even if x[3] == 1]).trees


@pytest.mark.parametrize("name", ["concurrence", "concurrence_consensus", "repeat_stability", "response_quality", "store_agreement", "rank_agreement"])
def test_series_that_do_not_vary_are_not_divided_by(spark, tmp_path, name):
    """F2-F6: request 0 has series of one value beside series that vary; in request 5 everything varies, in request 10 nothing does."""
    kinds = ("click", "error", "purchase", "signup", "view")
    cells = [(u, k, n, repeat) for u in (0, 15, 30) for k in kinds for n in range(20) for repeat in (0, 1)]
    flat = lambda u, k: u == 30 or (u == 0 and k in ("click", "view"))
    rows = [(2 * i + repeat, u, k, datetime.datetime(2024, 1, 3 + n, 5), 35.0 if flat(u, k) else 5.0 * ((n * 7 + i) % 11)) for i, (u, k, n, repeat) in enumerate(cells)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in plans.queries()[name](spark, str(tmp_path)).select(*names).collect()) == want


def test_shards_are_not_broadcast_however_small_their_files(spark, monkeypatch):
    """equal vectors take hardly any space on disk and all of it in memory; results equal brute force."""
    from tidemark.llm import mtree

    vector = lambda i: [(i % 5) * n / 8 - 1 for n in range(6)]
    df = spark.createDataFrame([(i, vector(i)) for i in range(400)], "vec_id long, embedding array<double>")
    plans_seen, join = [], mtree.searched
    monkeypatch.setattr(mtree, "searched", lambda *a: [out := join(*a), plans_seen.append(out._jdf.queryExecution().executedPlan().toString())][0])
    got = sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 100 == 3, k=4, shard=50).collect())
    whole = lambda i: [math.floor(1024 * x) for x in vector(i)]
    best = lambda q: sorted((-sum(x * y for x, y in zip(whole(q), whole(i))), i) for i in range(400) if i != q)[:4]
    assert got == sorted((q, n + 1, i, -less) for q in (3, 103, 203, 303) for n, (less, i) in enumerate(best(q)))
    assert len(plans_seen) == 3 and all("SortMergeJoin" in p and "BroadcastHashJoin [width" not in p for p in plans_seen)


@pytest.fixture(scope="module")
def faulty(spark):
    """A plan with random faults, its catalog and design."""
    r = random.Random(11)
    design = integrity.Design(("treated", "control"), {"p1": ("a", "b"), "p2": ("c",)}, ("r1", "r2"), ("csv",), "v1")
    rows = []
    for e, (role, panel, repeat) in ((e, s) for e in range(25) for s in design.slots()):
        x = dict(zip(integrity.PLAN_FIELDS, [f"q{e}{role}{panel}", repeat, f"e{e}", role, panel, f"pair{e}", "a;b" if panel == "p1" else "c", "v1", "csv", "s", "t", "u", "v", "0", "web"]))
        if r.random() < 0.2:
            x[r.choice(integrity.PLAN_FIELDS)] = r.choice([None, " ", "z", "q0treatedp1", "e1", "r1", "pair2"])
        rows += [tuple(x.values())] * r.choice([1] * 8 + [0, 2])
    plan = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in integrity.PLAN_FIELDS))
    catalog = spark.createDataFrame([(f"e{e}", "retained", "s", "t") for e in range(25)], "episode_id string, status string, episode_start string, episode_end string")
    return [dict(zip(integrity.PLAN_FIELDS, x)) for x in rows], plan, catalog, design


def test_plan_rows_are_dealt_out_by_what_a_check_needs(faulty):
    """F8, F9: faults equal a plain count; no check sorts or deals out all rows with their pairs or with digests in text."""
    rows, plan, catalog, design = faulty
    df = integrity.design_violations(plan, catalog, design)
    got = {}
    for v in df.collect():
        got.setdefault(v["kind"], []).append((v["episode_id"], v["request_id"], v["detail"]))
    groups = lambda *c: {k: [x for x in rows if tuple(x[f] for f in c) == k] for k in {tuple(x[f] for f in c) for x in rows}}
    least = lambda some, c: min((x[c] for x in some if x[c] is not None), default=None)
    other = [c for c in integrity.PLAN_FIELDS if c != "planned_repeat_id"]
    key, text = lambda xs: sorted(xs, key=repr), lambda *parts: "/".join(x for x in parts if x is not None)
    assert key(got["repeated_request"]) == key((least(some, "episode_id"), q, n) for (q, n), some in groups("request_id", "planned_repeat_id").items() if len(some) > 1)
    assert key(got["request_changes"]) == key((least(some, "episode_id"), q, "") for (q,), some in groups("request_id").items() if len({tuple(x[c] for c in other) for x in some}) > 1)
    assert key(got["repeated_slot"]) == key((k[0], None, text(*k[1:])) for k, some in groups("episode_id", "role", "panel", "planned_repeat_id").items() if len(some) > 1)
    assert key(got["several_pairs"]) == key((e, None, "") for (e,), some in groups("episode_id").items() if len({x["pair_id"] for x in some} - {None}) != 1)
    assert key(got["shared_pair"]) == key((None, None, p) for (p,), some in groups("pair_id").items() if p is not None and len({x["episode_id"] for x in some} - {None}) > 1)
    lacks = {e: [text(*s) for s in design.slots() if not any((x["role"], x["panel"], x["planned_repeat_id"]) == s for x in some)] for (e,), some in groups("episode_id").items()}
    assert key(got["incomplete_design"]) == key((e, None, ";".join(m)) for e, m in lacks.items() if m)
    shown = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in shown and "max(pair_id" not in shown


def test_violations_are_found_once_for_samples_and_their_number(faulty):
    """what a report reads stands in a table, of which both are made."""
    _, plan, catalog, design = faulty
    out = integrity.samples(integrity.design_violations(plan, catalog, design), "kind", ("episode_id", "request_id", "detail"), 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    found = integrity.design_violations(plan, catalog, design).groupBy("kind").count().collect()
    assert {(r["kind"], r["of"]) for r in out.collect()} == {tuple(r) for r in found}


def test_sound_plan_neither_broadcasts_nor_joins_plan_rows_with_faults(spark, sf_dir):
    """F8: the orders that are sound are written once, before they become plan rows; the catalog is joined by sorting, however small its files."""
    plan = plans.queries()["sound_plan"](spark, sf_dir)._jdf.queryExecution()
    assert "LeftAnti" not in plan.optimizedPlan().toString() and "BroadcastHashJoin [episode_id" not in plan.executedPlan().toString()

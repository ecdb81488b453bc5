"""Small fixtures: truth tables, edge cases, empty inputs, order independence."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import PHASES, Rules
from tidemark.functions import expr, geometry as g
from tidemark.operators import catalog, cohort, describe, episodes, evidence, finalize, imports, integrate, quality, sampling, series, spatial
from tidemark.operators.components import components
from tidemark.plans import space_queries
from tidemark.sources import tables
from tidemark.streaming.imports import SCHEMA, import_stream

DAY = dt.date(2023, 9, 4)
LAST = DAY + dt.timedelta(1)


def observations(spark, peak: dt.date):
    """Ten weeks around the event, low but for one day."""
    first = DAY - dt.timedelta(35)
    rows = [("q", "repeat_1", "c", first + dt.timedelta(k), 70.0 if first + dt.timedelta(k) == peak else 5.0 + k * 7 % 4, False) for k in range(70)]
    return spark.createDataFrame(rows, "request_id string, repeat_id string, concept_id string, date date, interest double, is_partial boolean")


def one_plan(spark):
    return spark.createDataFrame([("q", DAY, LAST)], "request_id string, onset date, event_end date")


def of_rule(phase: str) -> tuple[dt.date, dt.date]:
    """First and last day of a phase, from the rule's offsets."""
    at = {"s": DAY, "e": LAST}
    a, x, b, y = PHASES[phase]
    return at[a] + dt.timedelta(x), at[b] + dt.timedelta(y)


@pytest.mark.parametrize("phase", [*PHASES, None])
@pytest.mark.parametrize("edge", [0, 1])
def test_peak_phase(spark, phase, edge):
    """A peak on the first or the last day of a phase is in that phase; one long before is in none."""
    peak = of_rule(phase)[edge] if phase else DAY - dt.timedelta(20 + edge)
    row = series.phase_metrics(series.daily(observations(spark, peak)), one_plan(spark), Rules()).first()
    assert row["peak_phase"] == phase or phase is None and row["peak_value"] < 70
    assert row["quality"] == "usable"


def test_phase_windows(spark):
    rows = {r["phase"]: (r["phase_start"], r["phase_end"]) for r in series.phase_windows(one_plan(spark), Rules()).collect()}
    assert {p: rows[p] for p in PHASES} == {p: of_rule(p) for p in PHASES}


def test_series_of_no_rows_keep_their_columns(spark):
    none = observations(spark, DAY).limit(0)
    for f in (series.phase_metrics, series.response_metrics, series.runs):
        assert f(series.daily(none), one_plan(spark), Rules()).count() == 0


def dirty(spark):
    good, other = g.box(0, 0, 1, 1), g.box(5, 5, 6, 6)
    bow = g.write_polygon([np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float)])
    empty = struct.pack("<BII", 1, 3, 0)
    ids = ["%032x" % k for k in range(8)]
    rows = [
        (0, ids[0], 1.0, good, "2024-01-01", "2024-01-02"), (1, ids[1], None, struct.pack("<BII", 1, 6, 1) + good, "2024-01-01", None), (2, ids[2], 1.0, good, "2024-01-01", "2024-01-02"), (3, ids[3], 1.0, b"xx", "2024-01-01", None),
        (4, ids[4], 1.0, empty, "2024-01-01", None), (5, ids[5], 1.0, bow, "2024-01-01", None), (6, ids[2], 9.0, other, "2024-02-01", None), (7, ids[7], 1.0, good, "not-a-date", None), (8, ids[7], 1.0, good, "2024-01-05", None),
    ]
    return spark.createDataFrame(rows, "source_row_index long, uuid string, area_km2 double, geometry binary, start_date string, end_date string")


@pytest.mark.parametrize("policy", quality.DUPLICATE_POLICIES)
def test_duplicate_policies_balance(spark, policy):
    rows = quality.validated(spatial.decode(dirty(spark)))
    rows = quality.with_duplicates(rows, "uuid", ["geometry", "start_date", "area_km2"], "source_row_index")
    got = quality.accounting(quality.outcome(rows, policy, "source_row_index")).first()
    want = {"quarantine": (2, 4, 3), "keep-first": (3, 3, 3), "keep-last": (4, 2, 3), "reject-all": (2, 1, 6)}[policy]
    assert got["balanced"] and (got["accepted"], got["quarantined"], got["rejected"]) == want


def test_uuid_and_date_spellings(spark):
    rows = spark.createDataFrame([("{ABCDEF00-0000-0000-0000-000000000001}", "2024"), ("urn:uuid:abcdef00-0000-0000-0000-000000000001", "20240102"), ("abc", "2024-01-02T03:04"), (None, None)], "u string, d string")
    got = rows.select(expr.canonical_uuid(F.col("u")).alias("u"), expr.iso_date(F.col("d")).alias("d")).collect()
    assert [r["u"] for r in got] == ["abcdef00-0000-0000-0000-000000000001"] * 2 + [None] * 2
    assert [str(r["d"]) for r in got] == ["None", "2024-01-02", "2024-01-02", "None"]


def test_geometry_kernel():
    a, b = [np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], float)], [np.array([(5, 5), (15, 5), (15, 15), (5, 15), (5, 5)], float)]
    hole = [*a, np.array([(2, 2), (8, 2), (8, 8), (2, 8), (2, 2)], float)]
    assert g.overlap(a, b) == 25 and g.union_area([a, b, a]) == 175 and g.area(hole) == 64
    assert g.overlap(hole, b) == 25 - 9
    side = [np.array([(10, 0), (20, 0), (20, 10), (10, 10), (10, 0)], float)]
    assert g.overlap(a, side) == 0 and g.contact(a, side, 0.0) and not g.contact(a, [r + 100 for r in a], 0.0)
    triangle = [np.array([(0, 0), (10, 0), (5, 10), (0, 0)], float)]
    assert abs(g.area(triangle) - 50) < 1e-9 and abs(g.area(g.clip(triangle, 0, 0, 5, 10)) - 25) < 1e-9
    assert g.interior_point(a) == (5, 5) and g.read(b"junk") is None and not g.crosses_itself(hole)
    x, _ = g.project(np.array([180.0]), np.array([0.0]))
    assert abs(x[0] - 17367530.445) < 1


def test_components_and_agreement(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (4, 5), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10}
    assert components(edges.limit(0)).count() == 0
    members = spark.createDataFrame([("a", e, c) for e, c in ((1, 1), (2, 1), (3, 3))] + [("b", e, 1) for e in (1, 2, 3)], "policy string, event_id long, component long")
    row = episodes.agreement(members, "a", "b").first()
    assert (row["preserved"], row["merged"], row["split"]) == (0, 2, 0) and abs(row["agreement"] - 1 / 3) < 1e-9


def test_primary_boundary(spark):
    rows = spark.createDataFrame([(1, "AA", 5.0, True), (2, "AA", 2.0, False), (2, "BB", 3.0, False), (3, "AA", 2.0, False), (3, "BB", 2.0, False)], "event_id long, code string, overlap_km2 double, point_inside boolean")
    events = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "event_id long")
    got = {r["event_id"]: (r["primary_code"], r["method"]) for r in spatial.primary(rows, events).collect()}
    assert got == {1: ("AA", "point"), 2: ("BB", "largest_overlap"), 3: ("AA", "manual_review"), 4: (None, "none")}


def test_cohort_reasons_in_order(spark):
    rows = spark.createDataFrame([(1, ["CA"], "conus", DAY, None, True), (2, [], "unclassified", None, None, False)], "event_id long, state_set array<string>, study_domain string, start date, end date, review boolean")
    got = {r["event_id"]: (r["primary_reason"], r["other_reasons"], r["cohort_status"]) for r in cohort.classified(rows, ["conus"], ["alaska"], "2020-01-01", "2025-01-01").collect()}
    assert got == {1: ("review_required", "", "excluded"), 2: ("missing_start", "no_state", "excluded")}


def test_decisions(spark):
    members = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 3, "b")], "event_id long, episode_key long, split string")
    schema = "episode_key long, action string, groups string, merge_with string, cross_split_override boolean"
    sound = spark.createDataFrame([(1, "split", "1|2", None, None)], schema)
    assert catalog.decision_violations(sound, members).count() == 0
    assert catalog.apply_decisions(sound, members).select("new_id").distinct().count() == 3
    bad = spark.createDataFrame([(1, "split", "1", None, None), (3, "merge", None, "1", False), (9, "retain", None, None, None)], schema)
    assert {(r["episode_key"], r["problem"]) for r in catalog.decision_violations(bad, members).collect()} == {(1, "groups_not_a_partition"), (3, "crosses_split"), (9, "unknown_episode")}


def test_interest_values(spark):
    fine = {"<1": (0.0, False, "reported_zero_low_volume"), "45 (partial)": (45.0, True, "true_zero_unknown"), "45isPartial": (45.0, True, "true_zero_unknown"), "": (None, False, "missing"), "N/A": (None, False, "missing"), "NA": (None, False, "missing"), "null": (None, False, "missing"),
            "(partial)": (None, True, "partial"), "7": (7.0, False, "true_zero_unknown"), "0": (0.0, False, "reported_zero_relative_scale"), " 100 ": (100.0, False, "true_zero_unknown")}
    bad = ["101", "-1", "nan", "-", "x", "4 5", "7*"]
    rows = spark.createDataFrame([(t,) for t in [*fine, *bad]], "t string")
    got = {r["t"]: r for r in rows.select("t", *[c.alias(n) for n, c in imports.parsed_interest(F.col("t")).items()]).collect()}
    assert {t: (r["interest"], r["is_partial"], r["value_class"]) for t, r in got.items() if t in fine} == fine and all(got[t]["problem"] is None for t in fine)
    assert all(got[t]["problem"] == "bad_value" and got[t]["interest"] is None for t in bad)


def test_exports_and_sidecars(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("Category: all\n\nDay,flood: (X),rain\n2024-01-01,<1,5\n2024-01-02 - x,3 (partial),\n")
    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "a.json").write_text('{"request_id": "q", "backend": "s", "requested_concepts": ["c1", "c2"], "requested_labels": ["flood", "rain"], "repeat_id": "repeat_1", "start_date": "2024-01-01", "end_date": "2024-01-02"}')
    side = tables.read_sidecars(spark, str(tmp_path / "side"), ["s"])
    rows = imports.long_observations(tables.read_exports(spark, str(tmp_path / "csv")), side).collect()
    assert sorted((r["concept_id"], str(r["date"]), r["interest"], r["is_partial"]) for r in rows if r["interest"] is not None) == [("c1", "2024-01-01", 0.0, False), ("c1", "2024-01-02", 3.0, True), ("c2", "2024-01-01", 5.0, False)]
    assert all(r["label_matches"] for r in rows) and tables.inventory(spark, str(tmp_path / "csv"), side).first()["has_sidecar"]


def test_export_cells_and_problems(spark, tmp_path):
    def export(name: str, *lines: str) -> str:
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text("\ufeffCategory: all\r\n\r\n" + "\r\n".join(lines) + "\r\n")
        return str(tmp_path / name)

    rows = tables.read_exports(spark, export("quoted", 'Week,"flood, insurance: (US)","a ""b"""', '2024-01-07,"1",2', ",,")).orderBy("position").collect()
    assert [(r["date_text"], r["label"], r["value_text"]) for r in rows] == [("2024-01-07", "flood, insurance: (US)", "1"), ("2024-01-07", 'a "b"', "2")]
    for name, lines in (("wide", ("Day,a", "2024-01-01,1,2")), ("narrow", ("Day,a,b", "2024-01-01,1")), ("twice", ("Day,a", "2024-01-01,1", "2024-01-01,2"))):
        with pytest.raises(ValueError, match="do not fit"):
            tables.read_exports(spark, export(name, *lines))


def test_sidecars_without_what_they_need_are_not_sound(spark, tmp_path):
    sound = {"request_id": "q", "backend": "s", "requested_concepts": ["a"], "requested_labels": ["a"], "start_date": "2024-01-01", "end_date": "2024-01-02"}
    for k, (key, _) in enumerate([*sound.items(), ("", "")]):
        (tmp_path / f"{k}.json").write_text(json.dumps({c: v for c, v in sound.items() if c != key}))
    got = {r["sidecar_file"]: r["problem"] for r in tables.read_sidecars(spark, str(tmp_path), ["s"]).collect()}
    assert got == {"0.json": "request", "1.json": "backend", "2.json": "lists", "3.json": "lists", "4.json": "dates", "5.json": "dates", "6.json": None}


def test_pairs_of_events_in_several_states_and_without_end(spark):
    """Against all pairs, over cells, slots of time and states; an end that is missing is the start."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(160):
        x, y, w = *rng.integers(0, 120_000, 2).tolist(), int(rng.integers(1000, 30_000))
        start = DAY + dt.timedelta(int(rng.integers(0, 40)))
        end = start + dt.timedelta(int(rng.integers(0, 25))) if k % 4 else None
        rows.append((k, 0, sorted({str(s) for s in rng.integers(0, 4, 2)}), start, end, g.box(x, y, x + w, y + w), (x, y, x + w, y + w)))
    df = spark.createDataFrame([r[:6] for r in rows], "event_id long, state long, states array<string>, start date, end date, geometry binary")
    want = set()
    for a in rows:
        for b in rows:
            shared = sorted(set(a[2]) & set(b[2]))
            gap = max((b[3] - (a[4] or a[3])).days, (a[3] - (b[4] or b[3])).days, 0)
            p, q = a[6], b[6]
            meet = p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
            far = np.hypot((p[0] + p[2] - q[0] - q[2]) / 2, (p[1] + p[3] - q[1] - q[3]) / 2) / 1000
            if a[0] < b[0] and shared and gap <= 2 and (meet or far <= 25):
                want.add((a[0], b[0], gap, ";".join(shared)))
    got = [(r["a"], r["b"], r["gap_days"], r["shared_states"]) for r in episodes.candidate_pairs(spatial.decode(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_boxes_and_other_outlines_agree(spark):
    """A box as an outline with one more corner gives what the box gives by expressions."""
    boxes = [(k, 7_000 * k, 5_000 * (k % 3), 9_000 + 1_000 * k) for k in range(12)]
    more = lambda x, y, w: g.write_polygon([np.array([(x, y), (x + w / 2, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)], float)])
    shapes = {kind: spark.createDataFrame([(k, 1, DAY, DAY, f(x, y, w)) for k, x, y, w in boxes], "event_id long, state long, start date, end date, geometry binary") for kind, f in (("box", lambda x, y, w: g.box(x, y, x + w, y + w)), ("odd", more))}
    land = spark.createDataFrame([(str(k), g.box(k * 30_000, 0, k * 30_000 + 35_000, 40_000)) for k in range(3)], "code string, geometry binary")
    out = {}
    for kind, df in shapes.items():
        e = spatial.decode(df)
        assert {r["is_box"] for r in e.collect()} == {kind == "box"}
        tiled = spatial.tiles(land, 20_000.0)
        scored = episodes.scored_pairs(episodes.candidate_pairs(e), e)
        edges = episodes.edges(scored, episodes.policies(spark))
        members = episodes.membership(edges, e, ["broad"])
        out[kind] = [
            sorted((r["event_id"], r["code"], round(r["overlap_km2"], 6), r["point_inside"]) for r in spatial.overlaps(e, tiled, 20_000.0).collect()), sorted((r["event_id"], round(r["union_km2"], 6)) for r in spatial.union_overlap(e, tiled, 20_000.0).collect()),
            sorted((r["a"], r["b"], r["contact"], round(r["iou"], 9)) for r in scored.collect()), sorted((r["component"], round(r["union_km2"], 6)) for r in episodes.union_areas(members, e).collect()), sorted((r["component"], round(r["largest_distance_km"], 6)) for r in episodes.spans(members, e).collect()),
        ]
    assert out["box"] == out["odd"] and all(out["box"])


def test_hull_finds_the_furthest_points():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 400):
        x, y = rng.integers(0, 30, (2, n)).astype(float)
        far = max(np.hypot(a - c, b - d) for a, b in zip(x, y) for c, d in zip(x, y))
        at = g.hull(x, y)
        assert far == pytest.approx(max(np.hypot(*(at - p).T).max() for p in at))


def test_controls_of_unknown_tier_earn_nothing(spark):
    states = spark.createDataFrame([("A", 1, "unknown", "wet", True), ("B", 1, "unknown", "wet", None), ("C", 2, "big", None, False)], "state string, region int, tier string, climate string, available boolean")
    events = spark.createDataFrame([(1, "A", DAY, LAST)], "episode_id long, state string, start date, end date")
    busy = spark.createDataFrame([], "state string, first date, last date")
    got = {r["control_state"]: r["score"] for r in evidence.select_controls(events, states, busy).collect()}
    assert got == {"B": 5, "C": 0}


def test_concurrence_takes_the_last_name_of_equals_and_half_supports(spark):
    days = [(r, c, DAY + dt.timedelta(k), float(v + (k == p) * 9)) for r in ("1", "2", "3", "4") for c, v, p in (("d", 1, 3), ("w1", 2, 4), ("w2", 2, 3 if r < "3" else 20)) for k in range(25)]
    rows = spark.createDataFrame([("q", *d) for d in days], "request_id string, repeat_id string, concept_id string, date date, value double")
    kinds = spark.createDataFrame([("d", "demand"), ("w1", "weather"), ("w2", "weather"), ("f", "awareness")], "concept_id string, family string")
    found = evidence.concurrence(rows, kinds, Rules())
    got = {(r["repeat_id"], r["family"]): (r["other_id"], r["peak_difference"], r["strong"], r["moderate"]) for r in found.collect()}
    assert got["1", "weather"] == ("w2", 0, True, True) and got["4", "weather"] == ("w2", 17, False, False) and got["1", "awareness"] == (None, None, False, False)
    agreed = {r["family"]: r for r in evidence.consensus(found, Rules()).collect()}
    assert agreed["weather"]["supports"] and agreed["weather"]["verdict"] == "minority_only" and agreed["awareness"]["verdict"] == "insufficient" and not agreed["awareness"]["supports"]
    two = evidence.consensus(found.where("repeat_id in ('2', '3')"), Rules()).where("family = 'weather'").first()
    assert two["strong_share"] == 0.5 and not two["supports"]


def test_stream_import_is_idempotent(spark, tmp_path):
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    one = spark.createDataFrame([("q", "r", "c", DAY, 5.0, False)], SCHEMA)
    one.write.parquet(f"{land}/a")
    spark.createDataFrame([("q", "r", "c", DAY + dt.timedelta(1), 6.0, False)], SCHEMA).write.parquet(f"{land}/b")
    for n in range(2):
        import_stream(spark, f"{land}/*", store, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(store).count() == 2
        if not n:
            one.write.parquet(f"{land}/c")
    spark.createDataFrame([("q", "r", "c", DAY, 7.0, False)], SCHEMA).write.parquet(f"{land}/d")
    with pytest.raises(Exception, match="other values"):
        import_stream(spark, f"{land}/*", store, str(tmp_path / "cp")).awaitTermination()


def test_content_hash_ignores_order_and_partitions(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    assert finalize.content_hash(rows).collect() == finalize.content_hash(rows.repartition(5).orderBy(F.desc("id")).select("x", "id")).collect()
    assert finalize.content_hash(rows).collect() != finalize.content_hash(rows.where("id > 0")).collect()


def test_ranks_with_ties(spark):
    rows = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 2.0), ("k", 5.0)], "k string, v double")
    assert sorted(r["rk"] for r in describe.average_ranks(rows, ["k"], "v", "rk").collect()) == [1.0, 2.5, 2.5, 4.0]


def plain_ridge(rows, features, k=4, alpha=1.0):
    """Predictions by group and concept, without Spark."""
    order = sorted({r["grp"] for r in rows}, key=lambda x: hashlib.sha256(f"0:{x}".encode()).hexdigest())
    fold = {x: n % k for n, x in enumerate(order)}
    kinds = sorted({r["c"] for r in rows})[1:]
    out = {}
    for f in range(k):
        train, test = ([r for r in rows if (fold[r["grp"]] == f) == held] for held in (False, True))
        weight = lambda part: np.array([1 / sum(o["grp"] == r["grp"] for o in part) for r in part])
        w = weight(train)
        left, right = [np.ones(len(train))], [np.ones(len(test))]
        for c in features:
            have = [r[c] for r in train if r[c] is not None]
            fill = lambda part: np.array([np.median(have) if r[c] is None else r[c] for r in part])
            m = np.average(fill(train), weights=w)
            sd = np.sqrt(np.average((fill(train) - m) ** 2, weights=w))
            if sd > 0:
                left.append((fill(train) - m) / sd)
                right.append((fill(test) - m) / sd)
        for v in kinds:
            left.append(np.array([float(r["c"] == v) for r in train]))
            right.append(np.array([float(r["c"] == v) for r in test]))
        x, y = np.stack(left, 1), np.array([r["y"] for r in train])
        beta = np.linalg.solve(x.T @ (w[:, None] * x) + alpha * np.diag([0.0] + [1.0] * (x.shape[1] - 1)), x.T @ (w * y))
        for r, p in zip(test, np.stack(right, 1) @ beta):
            out[r["grp"], r["c"]] = (f, p, np.average(y, weights=w))
    return out


def test_ridge_equals_plain_numpy(spark):
    """With missing features, a constant one and one-hot concepts; refused without enough groups."""
    rows = [{"grp": f"g{k}", "c": c, "a": None if (k + n) % 6 == 0 else float(k % 5), "b": float(k * 7 % 11), "flat": 3.0, "y": 2.0 * (k % 5) + n} for k in range(30) for n, c in enumerate("xyz") if (k + n) % 9]
    df = spark.createDataFrame(rows, "grp string, c string, a double, b double, flat double, y double")
    dealt = finalize.folds(df, "grp", 4, "0").withColumn("weight", 1 / F.count("*").over(Window.partitionBy("grp")))
    want = plain_ridge(rows, ["a", "b", "flat"])
    got = finalize.ridge(df, "y", ["a", "b", "flat"], "grp", "c")
    assert sorted((r["grp"], r["fold"], round(r["actual"], 6), round(r["predicted"], 6), round(r["mean_predicted"], 6)) for r in got.collect()) == sorted((g_, f, round(r["y"], 6), round(p, 6), round(m, 6)) for r in rows for g_ in [r["grp"]] for f, p, m in [want[g_, r["c"]]])
    errors = {r["fold"]: r for r in finalize.model_errors(got).collect()}
    assert errors[None]["rows"] == len(rows) and errors[None]["ridge_rmse"] < errors[None]["mean_rmse"] and dealt.count() == len(rows)
    assert finalize.ridge(df.where("grp < 'g2'"), "y", ["a"], "grp", "c").count() == 0
    few = df.where("c <> 'z' or grp < 'g15'")
    assert {r["reason"] for r in finalize.model_gates(few, "y", "grp", "c").collect()} == {"few_groups:z"} and finalize.ridge(few, "y", ["a"], "grp", "c").count() == 0


def test_sample_does_not_depend_on_order(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat_ws("|", F.col("id") % 3, F.col("id") % 4).alias("stratum"), (2020 + F.col("id") % 2).cast("int").alias("y"))
    a = sampling.diverse_sample(rows, "k", F.col("y"), 10, "s").orderBy("year", "selection_rank").collect()
    assert a == sampling.diverse_sample(rows.orderBy(F.desc("k")).repartition(3), "k", F.col("y"), 10, "s").orderBy("year", "selection_rank").collect() and len(a) == 20
    # the greedy choice over all rows
    for y in (2020, 2021):
        left = [(hashlib.sha256(f"s:{k}".encode()).hexdigest(), str(k), (str(k % 3), str(k % 4))) for k in range(200) if 2020 + k % 2 == y]
        picked, seen = [], [{}, {}]
        while len(picked) < 10:
            best = max(left, key=lambda x: (round(sum(1 / (1 + s.get(v, 0)) for s, v in zip(seen, x[2])), 9), x[0]))
            left.remove(best)
            picked.append(best[1])
            for s, v in zip(seen, best[2]):
                s[v] = s.get(v, 0) + 1
        assert [r["id"] for r in a if r["year"] == y] == picked


def test_subsets_are_nested_and_balanced(spark):
    rows = [(f"e{k:02}", 2020 + k % 3, "WS"[k % 2], "ABCDE"[k * 7 % 5], "one" if k % 4 else "many", k * 11 % 40) for k in range(40)]
    chosen = spark.createDataFrame(rows, "id string, year int, region string, state string, member_class string, selection_rank int")
    left, picked = sorted(rows, key=lambda r: r[5]), []
    while len(picked) < 20:
        best = min(left, key=lambda r: (*(sum(p[c] == r[c] for p in picked) for c in (1, 2, 3)), r[5], r[0]))
        left.remove(best)
        picked.append(best)
    got = sampling.nested_subsets(chosen, [20, 10]).orderBy("pick").collect()
    assert [r["id"] for r in got] == [p[0] for p in picked] and [r["in_10"] for r in got] == [True] * 10 + [False] * 10
    both = sampling.nested_subsets(chosen, [20, 10])
    assert tuple(sampling.subset_check(both.where("in_10"), both.where("in_20")).first()) == (0, 10, True)
    assert not sampling.subset_check(both, both).first()["proper"]
    mini = [r["id"] for r in sampling.mini_set(chosen, "C").orderBy("pick").collect()]
    by = {r[0]: r for r in rows}
    assert len(mini) == 5 and by[mini[0]][3] == "C" and len({by[i][1] for i in mini}) == 3 and len({by[i][4] for i in mini}) == 2


def test_required_states_come_in_by_the_best_swap(spark):
    cols = "id string, year int, state string, h string, season string, coastal boolean, member_class string, footprint string, compact string"
    sample = [("s1", 2020, "A", "5", "winter", True, "singleton", "small", "spread"), ("s2", 2020, "B", "6", "summer", False, "singleton", "small", "spread"), ("s3", 2021, "A", "7", "summer", True, "singleton", "small", "spread")]
    more = [("n1", 2020, "Z", "1", "winter", True, "singleton", "small", "spread"), ("n2", 2020, "Z", "9", "winter", False, "multi_member", "moderate", "spread"), ("n3", 2021, "Z", "3", "spring", True, "multi_member", "small", "compact")]
    df = spark.createDataFrame(sample, cols)
    got = [(r["required_state"], r["added_id"], r["removed_id"]) for r in sampling.with_required_states(df, spark.createDataFrame(sample + more, cols), ["Z"], 2).orderBy("step").collect()]
    # first the compact one, then the one that keeps coast, class and footprint
    assert got == [("Z", "n3", "s3"), ("Z", "n1", "s1")]
    assert sampling.with_required_states(df, df, ["A"]).count() == 0


def test_plan_reader_and_conformance(spark, tmp_path):
    (tmp_path / "p.csv").write_text("request_id, geography\nq1,US-CA\nq2\n")
    assert tables.read_plan(spark, str(tmp_path / "p.csv"), ["request_id"]).count() == 2
    with pytest.raises(ValueError, match="blank"):
        tables.read_plan(spark, str(tmp_path / "p.csv"), ["geography"])
    df = spark.range(1)
    assert tables.conformance(df, df.schema).count() == 0
    assert {r["field"]: r["role"] for r in tables.inspect_schema(df, ["uuid"], ["id"]).collect()} == {"id": "optional", "uuid": "missing"}


def test_require_clean(spark):
    integrate.require_clean(spark.range(0), "x")
    with pytest.raises(ValueError, match="id"):
        integrate.require_clean(spark.range(3), "x")


def test_episode_areas_cover_every_policy(spark, sf_dir):
    """Each policy's episodes have an area, also those of the policy with the largest components."""
    got = space_queries.episode_areas(spark, sf_dir).select("policy", "component").collect()
    want = space_queries.episode_members(spark, sf_dir).select("policy", "component").distinct().collect()
    assert {r["policy"] for r in got} == {p[0] for p in episodes.POLICIES} and sorted(map(tuple, got)) == sorted(map(tuple, want))

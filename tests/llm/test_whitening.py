"""Whitening against dense eigenvalues and whole-number sums in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def expected(vectors):
    """Whole steps, n, covariance and deviations by plain arithmetic."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3 for j in range(d)] for i in range(d)])
    return x, n, s, v, [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]


def held(rows, vectors, ids):
    """rows are the whitening of vectors, which have these ids."""
    x, n, s, v, deviation = expected(vectors)
    values = np.linalg.eigvalsh(v)[::-1][:8]
    values = values[values > 1e-9 * values[0]]
    assert len(rows) == n * len(values)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for k in range(len(values)):
        w = np.array([by[i][k + 1]["whitened"] for i in ids])
        centred = np.array(x, float) - np.array(s) / n
        direction = centred.T @ w / n / math.sqrt(values[k])  # V u / e = u
        assert abs(np.linalg.norm(direction) - 1) < 1e-7
        assert np.allclose(v @ direction, values[k] * direction, atol=1e-7 * values[0])
        assert np.allclose(centred @ direction / math.sqrt(values[k]), w, atol=1e-6)
    for i, want in zip(ids, deviation):
        r = by[i][1]
        assert r["n"] == n and r["deviation"] == (want if want < 1 << 63 else None) and int(r["deviation_exact"]) == want
        assert all(abs(q["explained"] - values[k - 1] / np.trace(v)) < 1e-9 and q["identity_error"] < 1e-6 for k, q in by[i].items())


def test_equals_dense_eigenvalues_and_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((120, 11)) @ rng.standard_normal((11, 11)) / 4).tolist()
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [float("nan")] * 11), (904, [float("-inf")] + [0.0] * 10), (905, [None] + [0.0] * 10), (906, [1e300] * 11)]
    df = spark.createDataFrame([*enumerate(vectors), *odd], SCHEMA).repartition(3)
    df = df.withColumn("n", F.lit("x")).withColumn("component", F.lit(1)).withColumn("whitened", F.lit(None).cast("string"))
    held(whitening.whiten(df).collect(), vectors, range(120))


def test_whole_sums_of_large_entries(spark):
    """Limbs keep products whole where doubles cannot; deviations pass 64 bits."""
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((30, 3)) * [1e9, 1e5, 10.0] + [3e10, -5.0, 1e-3]).tolist()
    held(whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).collect(), vectors, range(30))


def test_equal_eigenvalues_and_missing_variance(spark):
    corners = [[sx, sy, 0.5, 0.0] for sx in (-1.0, 1.0) for sy in (-1.0, 1.0)] * 3
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(corners)), SCHEMA)).collect()
    assert {r["component"] for r in rows} == {1, 2} and all(abs(r["explained"] - 0.5) < 1e-12 and r["identity_error"] < 1e-9 for r in rows)
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_null_ids_stay(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, -1.0]), (None, None)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "None"] and {r["n"] for r in got} == {3}


@pytest.mark.parametrize("seed", range(6))
def test_counts_of_negative_pivots(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 25))
    a = rng.standard_normal((d, d))
    a = a + a.T if seed % 2 else np.round(a + a.T) * (1 - np.eye(d))  # zero diagonals need pivots of two rows
    values = np.linalg.eigvalsh(a)
    for s in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
        if np.abs(values - s).min() > 1e-9:
            assert whitening.negative_pivots(a, s) == (values < s).sum()


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0, 0, 0, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 1e-7, 1e-8, 0, 0, 0, 0], list(range(40, 0, -1)), [1e12, 1, 1e-3, 0], [7]])
def test_leading_components(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.leading(v)
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert len(e) == min(8, sum(c > 1e-14 * d * max(values) for c in values)) and np.allclose(e, want, rtol=1e-13 * d, atol=1e-15 * d * max(values))
    assert np.allclose(x.T @ x, np.eye(len(e)), atol=1e-10) and np.abs(v @ x - x * e).max() < 1e-13 * d * max(values)


def test_query(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None}
    rows = queries.op13_whitening(spark, sf_dir).where("vec_id < 40").collect()
    x = np.floor(np.array(list(vectors.values()), float) * 1024)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    place = {k: i for i, k in enumerate(vectors)}
    for k in range(8):
        w = (x - x.mean(axis=0)) @ u[:, -1 - k] / math.sqrt(e[-1 - k])
        got = np.array([by[i, k + 1]["whitened"] for i in range(40)])
        want = w[[place[i] for i in range(40)]]
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6 and abs(by[0, k + 1]["explained"] - e[-1 - k] / np.trace(v)) < 1e-9
    s, n = x.sum(axis=0), len(x)
    assert all(by[i, 1]["deviation"] == sum((n * int(c) - int(t)) ** 2 for c, t in zip(x[place[i]], s)) for i in range(40))

"""Embedding whitening by slicing the spectrum of the covariance.

Spark gathers whole-number sums in two passes, so the covariance is exact before it is rounded once: first the sums of
the vectors, then the products of vectors centred on the nearest whole mean, whose remainder is put right in whole numbers.
The number of negative pivots of an LDL' factorisation of V - s is the number of eigenvalues below s. Halving intervals
until each holds one of the leading eigenvalues isolates them, Rayleigh quotient iteration finishes each from the middle of
its interval, and two counts around the result certify that it is the k-th. Only sums, one for each pair of dimensions,
come to the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries count in steps of 1 / SCALE; SHIFT is added to every step.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on have no 64-bit step and count as not finite.
LARGEST = 2.0**52
#: Products are added up in blocks of so many rows, over limbs of so many bits, so that double sums stay whole.
BLOCK, LIMB = 4096, 20
EPS = np.finfo(float).eps


def usable(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, embedding) as long and doubles; vectors that are null, empty, or hold a null or non-finite entry are left out."""
    out = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return out.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, steps without SHIFT) of the vectors of each length in a batch."""
    vectors = batch["embedding"]
    lengths, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.floor(flat[(ends[at] - d)[:, None] + np.arange(d)] * SCALE).astype(np.int64)


def limbs(steps: np.ndarray) -> list[np.ndarray]:
    """Doubles x with steps = sum of x[k] << k * LIMB, each of LIMB bits; the last one has the sign."""
    out = []
    while steps.size and (steps.min() < -(1 << LIMB) or steps.max() >= 1 << LIMB):
        out.append((steps & ((1 << LIMB) - 1)).astype(float))
        steps = steps >> LIMB
    return [*out, steps.astype(float)]


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length, dimension and limb: how many vectors, and the sum of their steps."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    n: dict[int, int] = {}
    for batch in batches:
        for at, steps in matrices(batch):
            d = steps.shape[1]
            n[d] = n.get(d, 0) + len(at)
            for k, x in enumerate(limbs(steps)):
                sums[d, k] = sums.get((d, k), np.zeros(d, np.int64)) + x.astype(np.int64).sum(axis=0)
    for (d, k), x in sums.items():
        yield pa.record_batch({"d": np.full(d, d, np.int32), "i": np.arange(d, dtype=np.int32), "k": np.full(d, k, np.int32), "n": np.full(d, n[d] if k == 0 else 0), "s": x})


def multiplied(centre: np.ndarray):
    """For each pair of dimensions and each limb: the sum of the products of the centred steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        i, j = np.triu_indices(d)
        sums: dict[int, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for k, x in sums.items():
                yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "k": np.full(len(i), k, np.int32), "s": x})

        blocks = 0
        for batch in batches:
            for _, steps in matrices(batch):
                for b in range(0, len(steps) if steps.shape[1] == d else 0, BLOCK):
                    parts = limbs(steps[b : b + BLOCK] - centre)
                    for p, x in enumerate(parts):
                        for q, y in enumerate(parts):
                            products = (x.T @ y).astype(np.int64)[i, j]
                            sums[p + q] = sums.get(p + q, np.zeros(len(i), np.int64)) + products
                    blocks += 1
                    if blocks % 64 == 0:  # sums of more blocks might not fit 64 bits
                        yield from rows()
                        sums.clear()
        yield from rows()

    return run


def negative_pivots(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix a are below shift: negative pivots of a - shift = LDL', with pivots of one or two rows."""
    a = a - shift * np.eye(len(a))
    n, k, negative, ratio = len(a), 0, 0, (1 + 17**0.5) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        one = True
        if k + 1 < n:
            below = np.abs(a[k + 1 :, k])
            r = k + 1 + int(below.argmax())
            most = below[r - k - 1]
            if abs(a[k, k]) < ratio * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                second = row.max()
                if abs(a[k, k]) * second < ratio * most * most:
                    if abs(a[r, r]) >= ratio * second:
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        one = False
        if one:
            pivot = a[k, k]
            negative += int(pivot < 0)
            if pivot != 0:
                c = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(c, c / pivot)
            k += 1
        else:
            negative += 1
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            k += 2
    return negative


def _solved(v: np.ndarray, shift: float, x: np.ndarray, size: float) -> np.ndarray:
    for nudge in (0, 1, 3, 10):
        try:
            y = np.linalg.solve(v - (shift + nudge * EPS * size) * np.eye(len(v)), x)
            if np.isfinite(y).all():
                return np.linalg.qr(y)[0]
        except np.linalg.LinAlgError:
            pass
    return x


def leading(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and unit eigenvectors as columns; those that are zero but for rounding are left out.

    Eigenvalues that no count can tell apart span one space and get an orthonormal base of it.
    """
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((d, 0))
    tight, close = 8 * d * EPS * size, 64 * d * EPS * size
    below = lambda s: negative_pivots(v, s)
    lowest, highest = -tight, size + 2 * close
    work, values, vectors = [(lowest, highest, 0, d)], [], []
    rng = np.random.default_rng(0)
    while work:
        lo, hi, n_lo, n_hi = work.pop()
        held = n_hi - n_lo
        if held == 0 or d - n_hi >= count:
            continue
        middle = (lo + hi) / 2
        found = None
        if held == 1 or hi - lo <= close:
            x = np.linalg.qr(rng.standard_normal((d, held)))[0]
            for _ in range(3):
                x = _solved(v, middle, x, size)
            if held == 1:
                e = float(x[:, 0] @ v @ x[:, 0])
                for _ in range(12):
                    if np.linalg.norm(v @ x[:, 0] - e * x[:, 0]) <= 2 * EPS * size:
                        break
                    x = _solved(v, e, x, size)
                    e = float(x[:, 0] @ v @ x[:, 0])
                off = float(np.linalg.norm(v @ x[:, 0] - e * x[:, 0]))
                margin = tight + off
                # two counts say that one eigenvalue is here, and that it is the right one of all
                certain = lo - margin <= e <= hi + margin and below(e - margin) == n_lo and below(e + margin) == n_hi
            else:
                certain = False
            if certain or hi - lo <= close:
                found = x
        if found is None:
            n_middle = below(middle)
            work += [(lo, middle, n_lo, n_middle), (middle, hi, n_middle, n_hi)]  # the upper part is taken next
            continue
        for k in range(held):
            x = found[:, k]
            for y in vectors:
                x = x - (y @ x) * y
            x = x / np.linalg.norm(x)
            vectors.append(x)
            values.append(float(x @ v @ x))
    order = np.argsort(-np.array(values), kind="stable")[:count]
    order = [k for k in order if values[k] > 4 * d * EPS * max(values)]
    return np.array([values[k] for k in order]), np.array([vectors[k] for k in order]).reshape(len(order), d).T


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: its size, whole centre, sums of the centred steps, trace and leading components."""

    n: int
    centre: np.ndarray
    rest: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def of(self, steps: np.ndarray) -> np.ndarray:
        centred = (steps - self.centre) - np.array([r / self.n for r in self.rest])
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, steps: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S) squared, in whole numbers of any size."""
        z = steps - self.centre
        most = max(int(np.abs(z).max(initial=0)), max(map(abs, self.rest)))
        if most * most * z.shape[1] >= 1 << 62:
            z = z.astype(object)
        rest = np.array(self.rest, z.dtype)
        fixed = sum(r * r for r in self.rest)
        return [self.n * (self.n * int(a) - 2 * int(b)) + fixed for a, b in zip((z * z).sum(axis=1), z @ rest)]


def fit(vectors: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """Fits on all vectors of the most frequent length (of equally frequent ones the longest); None if there is none."""
    sums = vectors.select("embedding").mapInArrow(added, "d int, i int, k int, n long, s long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    sums = written(sums.groupBy("d", "i", "k").agg(F.sum("n").alias("n"), whole("s").alias("s")), "sums")
    best = sums.where("i = 0 AND k = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    d, n = best["d"], best["n"]
    total = [0] * d
    for r in sums.where(F.col("d") == d).collect():
        total[r["i"]] += int(r["s"]) << r["k"] * LIMB
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    products = vectors.select("embedding").mapInArrow(multiplied(np.array(centre, np.int64)), "i int, j int, k int, s long")
    z = {}
    for r in products.groupBy("i", "j", "k").agg(whole("s").alias("s")).toArrow().to_pylist():
        z[r["i"], r["j"]] = z.get((r["i"], r["j"]), 0) + (int(r["s"]) << r["k"] * LIMB)
    v = np.zeros((d, d))
    for (i, j), s in z.items():
        v[i, j] = v[j, i] = (n * s - rest[i] * rest[j]) / (n * n)
    return Whitening(n, np.array(centre, np.int64), rest, float(np.trace(v)), *leading(v, count))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    d, m = len(model.centre), len(model.values)
    i, j = np.triu_indices(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(m + len(i))
        for batch in batches:
            for _, steps in matrices(batch):
                if steps.shape[1] == d:
                    w = model.of(steps)
                    out += np.concatenate((w.sum(axis=0), (w.T @ w)[i, j]))
        yield pa.record_batch({"k": np.arange(len(out), dtype=np.int32), "s": out})

    found = {r["k"]: r["s"] / model.n for r in vectors.select("embedding").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return max(abs(found[m + p] - found[a] * found[b] - (a == b)) for p, (a, b) in enumerate(zip(i, j)))


def whiten(rows: DataFrame, count: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of each row that has a usable vector.

    Left out are vectors that are null, empty, hold a null, a non-finite entry or one of 2**52 or more, or have another length than most (of equally
    frequent lengths the longest counts). Repeated rows and ids stand as they are; a null vec_id stays null. Components that
    have no variance but rounding give no row, so one vector alone, equal vectors and empty tables give none. deviation is
    null where it passes 64 bits; deviation_exact has it up to 38 digits.
    """
    vectors = usable(rows, key, column)
    model = fit(vectors, count)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, m, d = identity_error(vectors, model), len(model.values), len(model.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, steps in matrices(batch):
                if steps.shape[1] != d:
                    continue
                deviation = model.deviations(steps)
                fits = lambda x, most: x if x < most else None
                times = np.repeat(np.arange(len(at)), m)
                columns = {
                    "vec_id": batch["vec_id"].take(pa.array(at)),
                    "deviation": pa.array([fits(x, 1 << 63) for x in deviation], pa.int64()),
                    "deviation_exact": pa.array([None if x >= 10**38 else Decimal(x) for x in deviation], pa.decimal128(38, 0)),
                }
                columns = {k: x.take(pa.array(times)) for k, x in columns.items()}
                columns |= {"component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(at)), "n": np.full(len(times), model.n), "whitened": model.of(steps).ravel()}
                columns |= {"explained": np.tile(model.values / model.trace, len(at)), "identity_error": np.full(len(times), error)}
                yield from pa.table(columns).select([c.split()[0] for c in schema.split(", ")]).combine_chunks().to_batches()

    return vectors.mapInArrow(run, schema)

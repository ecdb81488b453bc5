"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into units: lines, and within a line runs of words that end where the next word's first letters say so, so
that an edit moves only the borders near it. A sketch hashes every unit's 64-bit digest into three of its cells, which hold
a count, the sum of digests and the sum of check values (modulo 2**64). Two sketches subtract cell by cell; peeling cells that hold one
digest recovers the digests in which the texts differ. Fingerprints are subtracted first; where peeling fails, both texts are sketched again with more cells. The
likeness is the share of common digests among all.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, partitions

#: Cells of a fingerprint, and how many times more each retry takes.
CELLS, GROWTH = 48, 6
HASHES = 3
#: Documents whose sketches are computed side by side.
BLOCK = 128
#: Ranges of doc_id for each task.
RANGES = 8
#: Ends of units: line ends, sentence ends, and before words that start with one of these letters.
UNIT = re.compile(r"\n+|(?<=[.!?;]) +| +(?=[a-eA-E0-9])")
#: Units longer than this, such as data or scripts without spaces, are cut further between characters that one in INNER hashes picks, whatever the script.
LONG, INNER = 120, 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def inner_units(unit: str) -> list[str]:
    code = np.frombuffer(unit.encode("utf-32-le", "replace"), "<u4")
    picked = (code[:-1] * np.uint32(0x9E3779B1) ^ code[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    cuts = (np.flatnonzero(picked % np.uint32(INNER) == 0) + 1).tolist()
    return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]


def unit_digests(text: str) -> np.ndarray:
    """Sorted distinct 64-bit digests; a unit that occurs again is a digest of its own, by how often it came before."""
    seen: dict[str, int] = {}
    out = set()
    for whole in UNIT.split(text):
        for unit in (whole,) if len(whole) <= LONG else inner_units(whole):
            if unit:
                n = seen.get(unit, 0)
                seen[unit] = n + 1
                out.add(xxhash.xxh3_64_intdigest(unit.encode("utf-8", "replace"), n))
    return np.array(sorted(out), np.uint64)


def mixed(digests: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (digests ^ (digests >> np.uint64(31))) * factor
    return (x ^ (x >> np.uint64(29))) * _CHECK


class Sketches:
    """Sketches of many texts side by side: counts, sums of digests and sums of check values (modulo 2**64) in 3 equal tables of cells each."""

    def __init__(self, thirds: np.ndarray):
        self.thirds = thirds
        self.starts = np.cumsum(HASHES * thirds) - HASHES * thirds
        n = int((HASHES * thirds).sum())
        self.counts, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, digests: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        """Adds each digest to the sketch of its owner, or with sign -1 takes it away."""
        third = self.thirds[owner]
        checks, factor = mixed(digests, _MIX[0]) >> np.uint64(32), sign.astype(np.uint64)
        for k, m in enumerate(_MIX):
            at = self.starts[owner] + k * third + ((mixed(digests, m) >> np.uint64(20)) % third.astype(np.uint64)).astype(np.int64)
            np.add.at(self.counts, at, sign)
            np.add.at(self.keys, at, digests * factor)
            np.add.at(self.checks, at, checks * factor)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.thirds)
        out.counts, out.keys, out.checks = self.counts - other.counts, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many digests only the first, and only the second, of each pair has, and for which pairs peeling came to an end."""
        pairs = len(self.thirds)
        owner_of = np.repeat(np.arange(pairs), HASHES * self.thirds)
        first, second = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
        for _ in range(len(self.counts) + 1):
            sign = self.counts
            pure = np.flatnonzero(np.abs(sign) == 1)
            sign = sign[pure]
            key = self.keys[pure] * sign.astype(np.uint64)
            fine = mixed(key, _MIX[0]) >> np.uint64(32) == self.checks[pure] * sign.astype(np.uint64)
            key, sign, owner = key[fine], sign[fine], owner_of[pure[fine]]
            if not len(key):
                break
            order = np.lexsort((key, owner))
            key, sign, owner = key[order], sign[order], owner[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, sign, owner = key[new], sign[new], owner[new]
            self.add(key, owner, -sign)
            first += np.bincount(owner[sign > 0], minlength=pairs)
            second += np.bincount(owner[sign < 0], minlength=pairs)
        left = (self.counts != 0) | (self.keys != 0) | (self.checks != 0)
        return first, second, np.bincount(owner_of[left], minlength=pairs) == 0


def sketched(texts: list[np.ndarray], thirds: np.ndarray) -> Sketches:
    out = Sketches(thirds)
    every = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    out.add(every, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.ones(len(every), np.int64))
    return out


def fingerprints(s: Sketches) -> list[str]:
    """Sketches of one size as text."""
    rows = zip(*[x.astype(t).reshape(len(s.thirds), -1) for x, t in ((s.counts, "<i2"), (s.keys, "<u8"), (s.checks, "<u4"))])
    return [base64.b85encode(b"".join(part.tobytes() for part in row)).decode() for row in rows]


def likenesses(a: list[np.ndarray], b: list[np.ndarray], of_a: Sketches, of_b: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Share of common digests among all of each pair, 1 where both are empty, and how many times it was sketched again. of_a and of_b, the fingerprints, are subtracted first; pairs that
    don't peel are sketched again with GROWTH times the cells."""
    sizes_a, sizes_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out, retries, waiting = np.zeros(len(a)), np.zeros(len(a), np.int64), np.arange(len(a))
    thirds = of_a.thirds
    while len(waiting):
        first, second, done = of_a.minus(of_b).peel()
        done &= sizes_a[waiting] - first == sizes_b[waiting] - second
        common, whole = sizes_a[waiting] - first, sizes_a[waiting] + second
        out[waiting[done]] = np.where(whole > 0, common / np.maximum(whole, 1), 1.0)[done]
        waiting, thirds = waiting[~done], thirds[~done] * GROWTH
        retries[waiting] += 1
        if len(waiting):
            of_a, of_b = (sketched([x[k] for k in waiting], thirds) for x in (a, b))
    return out, retries


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_guards(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to parts ranges of doc_id, each also holding its follower's first rows as guards at its end.

    The borders are ids of the table; there are fewer than parts of them. The last range's guard is the table's first row. A task holds
    some ranges, so that their sizes even out.
    """
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts).alias("q"), F.min("doc_id").alias("first")).first()
    first = found["first"]
    borders = np.array(sorted(set(found["q"] or []) - {first}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("doc_id")
            ids, known = column.fill_null(np.iinfo(np.int64).min).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            part = np.searchsorted(borders, ids, "right")
            border, around = np.flatnonzero(known & np.isin(ids, borders)), np.flatnonzero(known & (ids == first)) if first is not None else np.zeros(0, np.int64)
            rows = batch.take(pa.array(np.concatenate([np.arange(len(ids)), border, around])))
            to = np.concatenate([part, part[border] - 1, np.full(len(around), len(borders))])
            guard = np.arange(len(to)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guard), *rows.columns], ["part", "guard", "doc_id", "text"])

    dealt = docs.mapInArrow(run, "part long, guard boolean, doc_id long, text string")
    return dealt.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "guard", "doc_id", "text")


def fingerprint(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_units, retries_edited, retries_next for every document.

    The next document is the next in ascending doc_id (rows of one id: by text); after the last comes the first. Of rows that share the
    smallest id, the first is the last document's next. Rows whose doc_id is null come before all others. Null text is empty text. Two empty texts have likeness 1.
    A table of one row is its own next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_units", "retries_edited", "retries_next"]

        def rows():
            last = None
            for batch in batches:
                for part, guard, doc_id, text in zip(batch.column("part").to_pylist(), batch.column("guard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                    row = (part, guard, doc_id, text.as_py())
                    digests = unit_digests(row[3])
                    if last and last[0][0] == part and not last[0][1]:
                        yield (*last, row[3], digests)
                    last = (row, digests)

        def settled(held) -> pa.RecordBatch:
            texts, digests, following, after = [h[0][3] for h in held], [h[1] for h in held], [h[2] for h in held], [h[3] for h in held]
            new = [edited(t, f) for t, f in zip(texts, following)]
            changed = [unit_digests(t) for t in new]
            own, other, next_ = (sketched(x, np.full(len(x), max(1, cells // HASHES))) for x in (digests, changed, after))
            (near_edited, again), (near_next, again_next) = likenesses(digests, changed, own, other), likenesses(digests, after, own, next_)
            columns = [
                [h[0][2] for h in held], list(map(len, texts)), [hashlib.sha256(t.encode()).hexdigest() for t in new], fingerprints(own), fingerprints(other),
                near_edited, near_next, list(map(len, digests)), again, again_next,
            ]
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row[0][3])
            if len(held) == BLOCK or size > 4 << 20:
                yield settled(held)
                held, size = [], 0
        if held:
            yield settled(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_units long, retries_edited long, retries_next long"
    docs = documents_of(docs)
    return with_guards(docs, RANGES * partitions(docs.sparkSession)).mapInArrow(run, schema)

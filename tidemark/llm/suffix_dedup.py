"""Removal of byte strings that occur again, found by two-stage suffix sorting.

Segments (see anchored) that share an anchor meet in one task. There the suffixes smaller than their successors are
sorted directly; the others follow by one scan over the buckets of first bytes, which puts each suffix's predecessor in
place. Common prefixes of neighbours in the sorted order then tell which windows occur again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import SMALLEST, Bytes, compressed, keyed, marks_of, opened, repeated_segments, representatives, verdicts
from .common import carried, lean

#: Never a byte of UTF-8; ends every string of a block.
END = 0xFF


def words_at(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; depth more zero bytes follow the data."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + depth, np.uint64)
    for j in range(8):
        out |= padded[j : j + len(out)] << np.uint64(56 - 8 * j)
    return out


def grouped_order(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Order by of and then key: one quick sort of the keys, then stable passes over 16 bits of the group numbers each."""
    by = np.argsort(key)
    group = of - of[0]
    for shift in range(0, max(1, int(group[-1]).bit_length()), 16):
        by = by[np.argsort((group[by] >> shift).astype(np.uint16), kind="stable")]
    return by


def sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """at ordered by the suffixes there, as far as depth bytes tell them apart."""
    order = at[np.argsort(words[at])]
    key = words[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(fresh)
    tied = ~(fresh & np.concatenate([fresh[1:], [True]])) if len(order) else fresh
    live = np.flatnonzero(tied)
    for deep in range(8, depth, 8):
        if not len(live):
            break
        rows, of = order[live], group[live]
        key = words[rows + deep]
        by = grouped_order(key, of)
        rows, key = rows[by], key[by]
        order[live] = rows
        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])
        group[live] = of = np.cumsum(fresh)
        tied = ~(fresh & np.concatenate([fresh[1:], [True]]))
        live = live[tied]
    return order


def suffix_order(data: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All places of data ordered by suffix, by two-stage sorting; suffixes equal over depth bytes may stand in any order."""
    n = len(data)
    words = words_at(data, depth) if words is None else words
    after = np.concatenate([data[1:].astype(np.int16), [-1]])
    differs = np.where(data != after, np.arange(n), n)
    turn = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = data[turn] < after[turn]
    direct = sort_directly(np.flatnonzero(smaller), words, depth)
    first = data[direct]
    borders = np.searchsorted(first, np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        bucket = [front]
        while len(front):  # predecessors in the same bucket join its end
            front = front[front > 0] - 1
            front = front[(data[front] == c) & ~smaller[front]]
            bucket.append(front)
        bucket.append(direct[borders[c] : borders[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[~smaller[before] & (data[before] > c)]
        if len(before):
            char = data[before]
            by = np.argsort(char, kind="stable")
            char = char[by]
            cuts = np.flatnonzero(char[1:] != char[:-1]) + 1
            for part, x in zip(np.split(before[by], cuts), char[np.concatenate([[0], cuts])]):
                heads[x].append(part)
    return np.concatenate(out)


def windows_again(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string, which of its windows occur at another place in the strings."""
    data = np.frombuffer(b"".join(s + bytes([END]) for s in strings), np.uint8)
    depth = -(-window // 8) * 8
    words = words_at(data, depth + 8)
    order = suffix_order(data, depth, words)
    a, b = order[:-1], order[1:]
    for deep in range(0, window - 7, 8):  # longer and longer common prefixes of neighbours
        same = words[a + deep] == words[b + deep]
        a, b = a[same], b[same]
    if window % 8:
        same = words[a + window - 8] == words[b + window - 8]
        a, b = a[same], b[same]
    again = np.zeros(len(data), bool)
    again[a] = again[b] = True
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(sizes) - sizes
    return [again[at : at + max(0, size - window)] for at, size in zip(starts, sizes)]


def window_runs(again: np.ndarray) -> bytes:
    """Maximal runs of marked windows: first and one past the last, as little-endian integers."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
    return turns.astype("<i4").tobytes()


def judge(rows: list[dict]) -> list[bytes]:
    """Runs of the windows that occur again; all of them where the segment itself does."""
    return [np.array([0, len(r["string"]) - Bytes.window + 1], "<i4").tobytes() if r["n"] > 1 else window_runs(w) for r, w in zip(rows, windows_again([r["string"] for r in rows], Bytes.window))]


def marked(docs: DataFrame, scheme: Bytes) -> DataFrame:
    """(doc_id, part, marks) where marks are (start, windows, verdict) of segments with windows that occur again; no verdict: all of them do."""
    hits = repeated_segments(docs, scheme)
    judged = verdicts(representatives(docs, hits, scheme), judge, F.sum("n") > 1, lambda again: window_runs(np.array(again, bool)))
    whole = hits.where("not several").select("doc_id", "part", "start", "windows", F.lit(None).cast("binary").alias("verdict"))
    some = hits.where("several").join(judged, ["anchor", "seg"]).select("doc_id", "part", "start", "windows", "verdict")
    return whole.unionByName(some).groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "windows", "verdict")).alias("marks"))


def covered(starts: list[int], windows: list[int], verdicts: list[bytes | None], window: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, from a document's marks."""
    parts = []
    for start, n, verdict in zip(starts, windows, verdicts):
        if verdict is None:
            parts.append((start, start + n - 1 + window))
        else:
            turns = np.frombuffer(verdict, "<i4").tolist()
            parts += [(start + a, start + b - 1 + window) for a, b in zip(turns[::2], turns[1::2])]
    parts.sort()
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], len(data)]))


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they cover only in part."""
    out = []
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def deduplicate(docs: DataFrame, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with texts also the kept text, cut at whole characters; and the columns to carry.

    Removed is each byte covered by a 200-byte string that starts at another place too, in this or another row; strings
    are judged on the input. Null text is empty text; rows that share a doc_id, or have none, are documents of their own. Texts
    under 200 bytes lose nothing. Other columns play no part.
    """
    scheme = Bytes()
    docs = keyed(docs, carry)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts
    names = [c.split()[0] for c in schema.split(", ")] + list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, z, marks in zip(batch.column("doc_id").to_pylist(), batch.column("z"), marks_of(batch.column("marks"))):
                data = opened(z.as_py())
                runs = covered(*marks, scheme.window)
                row = (None if doc_id == SMALLEST else doc_id, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(data, runs)).hexdigest())
                rows.append((*row, kept(data, whole_characters(data, runs)).decode()) if texts else row)
            types = [pa.int64()] * 4 + [pa.string()] * (1 + texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)] + [batch.column(c) for c in carry], names)

    joined = compressed(docs, carry).join(marked(docs, scheme), ["doc_id", "part"], "left")
    return joined.select("doc_id", "z", "marks", *carry).mapInArrow(lean(run), schema + carried(docs, carry))

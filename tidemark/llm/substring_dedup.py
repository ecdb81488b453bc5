"""Removal of word windows that an earlier document has, by super-k-mers.

Consecutive windows of 13 words that share a minimiser travel as one packed string (see anchored) to the bucket of that
minimiser. There the windows are sorted, and each is given the smallest doc_id that has it, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import SMALLEST, Words, compressed, keyed, marks_of, opened, repeated_segments, representatives, verdicts
from .common import lean


def judge(rows: list[dict]) -> list[bytes]:
    """For each packed string, the smallest doc_id of each of its windows, as little-endian integers."""
    cut = []
    for k, r in enumerate(rows):
        ends = [i for i, c in enumerate(r["string"]) if c == 32]
        starts, ends = [0, *[e + 1 for e in ends]], [*ends, len(r["string"])]
        more = Words.window - 1
        cut += [(r["string"][starts[j] : ends[j + more]], r["low"], k, j) for j in range(len(starts) - more)]
    cut.sort()
    out = [[0] * (r["string"].count(b" ") + 2 - Words.window) for r in rows]
    last, low = None, 0
    for window, doc_id, k, j in cut:  # equal windows stand together, the smallest doc_id first
        if window != last:
            last, low = window, doc_id
        out[k][j] = low
    return [np.array(x, "<i8").tobytes() for x in out]


def deduplicate(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with texts also the kept words joined by one space.

    Words are runs of characters other than space and \\t to \\r. Removed is each word covered by a window of 13 words that also
    starts in a document with a smaller doc_id; windows are judged on the input. Null text has no words; a null doc_id is smaller
    than any other; rows with one doc_id are not smaller than each other. Other columns play no part.
    """
    scheme = Words()
    docs = keyed(docs)
    hits = repeated_segments(docs, scheme).where("low < high")
    judged = verdicts(representatives(docs, hits, scheme), judge, F.min("low"), lambda low: np.array(low, "<i8").tobytes())
    later = hits.where("doc_id > low")
    whole = later.where("not several").select("doc_id", "part", "start", "windows", F.lit(None).cast("binary").alias("verdict"))
    some = later.where("several").join(judged, ["anchor", "seg"]).select("doc_id", "part", "start", "windows", "verdict")
    marks = whole.unionByName(some).groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "windows", "verdict")).alias("marks"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, z, marks in zip(batch.column("doc_id").to_pylist(), batch.column("z"), marks_of(batch.column("marks"))):
                words = opened(z.as_py()).split()
                stay = bytearray(b"\1") * len(words)
                for start, n, verdict in zip(*marks):
                    if verdict is None:
                        stay[start : start + n - 1 + scheme.window] = bytes(n - 1 + scheme.window)
                    else:
                        for j in np.flatnonzero(np.frombuffer(verdict, "<i8") < doc_id).tolist():
                            stay[start + j : start + j + scheme.window] = bytes(scheme.window)
                left = b" ".join(compress(words, stay))
                row = (None if doc_id == SMALLEST else doc_id, len(words), stay.count(0), hashlib.sha256(left).hexdigest())
                rows.append((*row, left.decode()) if texts else row)
            types = [pa.int64()] * 3 + [pa.string()] * (1 + texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return compressed(docs).join(marks, ["doc_id", "part"], "left").select("doc_id", "z", "marks").mapInArrow(lean(run), schema)

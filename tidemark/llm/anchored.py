"""Finding strings of a fixed number of units (bytes or words) that occur again, by minimiser segments.

Every window of `window` units contains one smallest-hashed run of `k` units, its minimiser; equal windows have
equal minimisers at equal places. Consecutive windows whose minimiser is the same occurrence travel as one segment: its
anchor is the minimiser's hash, its seg a hash of all its units. Only segments whose anchor occurs again can hold a
window that occurs again; only where an anchor has different segments must their units be fetched and compared.

Hot anchors: counts are pre-aggregated before the shuffle, copies of a segment are one representative, and occurrences
are joined to one row per anchor or segment, so that Spark can split the hot side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, documents_of, lean, written

#: Units of one numpy pass, bytes of representatives that are compared in one go, and different segments up to which an anchor's are compared in one task.
CHUNK, BLOCK, CROWD = 1 << 20, 1 << 20, 4096
SMALLEST = -(2**63)
SEGMENT = "doc_id long, part long, anchor long, seg long, start int, windows int"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def segments(kmers: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, place of the minimiser) of every segment.

    kmers: hash of the k units from each place on, of documents laid end to end, document d at starts[d]:ends[d]. Of equal hashes in a window, the leftmost is
    its minimiser, which like the hashes depends on nothing but the window.
    """
    n, w = len(kmers), window - k + 1
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= window
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - window + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    if not valid.any():
        return (np.zeros(0, np.int64),) * 4
    least = kmers & ~np.uint64(0xFFFFFF) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least[:-span] = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least[: span - w] = np.minimum(least[: span - w], least[w - span :])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    first = np.flatnonzero(new)
    return np.searchsorted(starts, first, "right") - 1, first, np.flatnonzero(last) - first + 1, place[first]


def byte_kmers(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each place on; k is a power of two. The last k - 1 have no meaning."""
    h = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
    span = 1
    while span < k:
        h[:-span] = h[:-span] * np.uint64(2 * span * 0x9E3779B1 + 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF | 1) + h[span:]
        span *= 2
    return mixed(h)


def word_hashes(whole: bytes, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """Hash, first byte and end of every word, and the first word and end of every piece.

    whole: pieces of the given sizes end to end, in which one space follows every word.
    """
    data = np.frombuffer(whole, np.uint8)
    word_ends = np.flatnonzero(data == 32)
    word_starts = np.concatenate([[0], word_ends[:-1] + 1]) if len(word_ends) else word_ends
    ends = np.searchsorted(word_starts, np.cumsum(sizes))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    # the sum of a word's bytes times powers of an odd number, by prefix sums, over the first power
    odd = 0x9E3779B97F4A7C15
    base = np.full(len(data) + 1, odd, np.uint64)
    base[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(base)[:-1])])
    back = np.full(len(data) + 1, pow(odd, -1, 2**64), np.uint64)
    back[0] = 1
    return mixed((sums[word_ends] - sums[word_starts]) * np.cumprod(back)[word_starts]), word_starts, word_ends, starts, ends


class Bytes:
    """Windows of bytes. Long documents are cut into overlapping chunks; where they are cut changes segments, not results."""

    window, k = 200, 64

    def pieces(self, text: str) -> Iterator[tuple[int, bytes]]:
        data = text.encode("utf-8", "replace")
        for at in range(0, max(1, len(data) - self.window + 1), CHUNK):
            yield at, data[at : at + CHUNK + self.window - 1]

    def found(self, pieces: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(piece, first window, windows, anchor, seg) of all segments of the pieces."""
        whole = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        kmers = byte_kmers(np.frombuffer(whole, np.uint8), self.k)
        doc, first, n, place = segments(kmers, starts, ends, self.window, self.k)
        view, digest, more = memoryview(whole), xxhash.xxh3_64_intdigest, self.window - 1
        seg = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + n + more).tolist())], np.uint64)
        return doc, first - starts[doc], n, kmers[place].view(np.int64), seg.view(np.int64)

    def windows(self, string: bytes) -> list[bytes]:
        return [string[k : k + self.window] for k in range(len(string) - self.window + 1)]

    def strings(self, data: bytes, places: list[tuple[int, int]]) -> list[bytes]:
        return [data[a : a + n + self.window - 1] for a, n in places]


class Words:
    """Windows of words, that is, runs of bytes other than ASCII white space; a window is its words joined by one space.

    Minimisers are ordered by how long their words are, the longest first, and then by hash: runs of short, common words occur again by
    chance, and are minimisers only where a window has nothing else.
    """

    window, k = 13, 3

    def pieces(self, text: str) -> Iterator[tuple[int, bytes]]:
        words = text.encode("utf-8", "replace").split()
        step = CHUNK // 8
        for at in range(0, max(1, len(words) - self.window + 1), step):
            yield at, b" ".join(words[at : at + step + self.window - 1]) + b" "

    def found(self, pieces: list[bytes]):
        whole = b"".join(pieces)
        words, word_starts, word_ends, starts, ends = word_hashes(whole, [len(p) for p in pieces])
        kmers = words.copy()
        for j in range(1, self.k):
            kmers[:-j] = kmers[:-j] * np.uint64(0x5851F42D4C957F2D) + words[j:]
        length = word_ends.copy()
        length[: 1 - self.k] = word_ends[self.k - 1 :]
        short = np.clip(63 - (length - word_starts), 0, 63).astype(np.uint64)
        kmers = short << np.uint64(58) | mixed(kmers) >> np.uint64(6)
        doc, first, n, place = segments(kmers, starts, ends, self.window, self.k)
        view, digest, more = memoryview(whole), xxhash.xxh3_64_intdigest, self.window - 1
        seg = np.array([digest(view[a:b]) for a, b in zip(word_starts[first].tolist(), word_ends[first + n + more - 1].tolist())], np.uint64)
        return doc, first - starts[doc], n, kmers[place].view(np.int64), seg.view(np.int64)

    def windows(self, string: bytes) -> list[bytes]:
        words = string.split(b" ")
        return [b" ".join(words[k : k + self.window]) for k in range(len(words) - self.window + 1)]

    def strings(self, data: bytes, places: list[tuple[int, int]]) -> list[bytes]:
        words = data.split()
        return [b" ".join(words[a : a + n + self.window - 1]) for a, n in places]


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (null: smallest), part, text, and the columns to carry. part tells rows of one id apart by their text; it is 0 where ids are unique.

    Rows that agree in both are the same text, so that whatever holds for one holds for the other.
    """
    docs = documents_of(docs, carry)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("n"))).alias("most")).first()["most"]
    part = F.lit(0).cast("long") if (ids or 0) < 2 else F.xxhash64("text")
    return docs.select(F.coalesce("doc_id", F.lit(SMALLEST)).alias("doc_id"), part.alias("part"), "text", *carry)


def compressed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """keyed documents with z, the compressed text, so that what moves between machines is small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [squeeze(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(z, pa.binary()), *[batch.column(c) for c in carry]], ["doc_id", "part", "z", *carry])

    return docs.mapInArrow(lean(run), "doc_id long, part long, z binary" + carried(docs, carry))


def opened(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def marks_of(column: pa.Array) -> Iterator[tuple[list, list, list]]:
    """Starts, windows and verdicts of each row's marks; empty lists for a row without any."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    marks = column.flatten()
    starts, windows, verdicts = (marks.field(c).to_pylist() for c in ("start", "windows", "verdict"))
    at = 0
    for n in column.value_lengths().to_pylist():
        n = n or 0
        yield starts[at : at + n], windows[at : at + n], verdicts[at : at + n]
        at += n


def all_segments(docs: DataFrame, scheme, anchors_only: bool = False) -> DataFrame:
    """SEGMENT rows of keyed documents."""
    names = ["anchor"] if anchors_only else ["doc_id", "part", "anchor", "seg", "start", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, first, n, anchor, seg = scheme.found([h[3] for h in held])
            if anchors_only:
                return pa.RecordBatch.from_arrays([pa.array(anchor)], names)
            ids, parts, at = (np.array([h[c] for h in held], np.int64) for c in range(3))
            return pa.RecordBatch.from_arrays(list(map(pa.array, (ids[doc], parts[doc], anchor, seg, (at[doc] + first).astype(np.int32), n.astype(np.int32)))), names)

        for batch in batches:
            for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text")):
                for at, piece in scheme.pieces(text.as_py()):
                    held.append((doc_id, part, at, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(lean(run), "anchor long" if anchors_only else SEGMENT)


def repeated_segments(docs: DataFrame, scheme) -> DataFrame:
    """Segments whose anchor occurs again, with how many there are, the smallest and largest doc_id, and whether they differ (several)."""
    # tables in between let Spark split the hot side of each join
    again = written(all_segments(docs, scheme, anchors_only=True).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    hits = written(all_segments(docs, scheme).join(again, "anchor"), "hits")
    about = hits.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("seg") != F.max("seg")).alias("several"))
    return written(hits.join(written(about, "anchors"), "anchor"), "segments")


def representatives(docs: DataFrame, hits: DataFrame, scheme) -> DataFrame:
    """A table of one row (anchor, seg, n, low, string) for each different segment of an anchor that has several.

    An anchor of more than CROWD segments has a row (anchor, seg, n, low, place, h1, h2) for each of their windows instead: such windows are counted by
    128 bits of hash, over all machines.
    """
    one = hits.where("several").groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "part", "start", "windows")).alias("at"))
    crowded = one.groupBy("anchor").agg(F.count("*").alias("segs")).where(F.col("segs") > CROWD).select("anchor", F.lit(True).alias("crowded"))
    one = one.join(crowded, "anchor", "left")
    wanted = one.groupBy("at.doc_id", "at.part").agg(F.collect_list(F.struct("anchor", "seg", "n", "low", "at.start", "at.windows", "crowded")).alias("wanted"))
    schema = "anchor long, seg long, n long, low long, string binary, place int, h1 long, h2 long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, wanted in zip(batch.column("z"), batch.column("wanted")):
                asked = wanted.as_py()
                rows = []
                for a, string in zip(asked, scheme.strings(opened(z.as_py()), [(a["start"], a["windows"]) for a in asked])):
                    key = (a["anchor"], a["seg"], a["n"], a["low"])
                    if not a["crowded"]:
                        rows.append((*key, string, None, None, None))
                        continue
                    for k, w in enumerate(scheme.windows(string)):
                        h = xxhash.xxh3_128_digest(w)
                        rows.append((*key, None, k, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
                types = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return written(compressed(docs).join(wanted, ["doc_id", "part"]).select("z", "wanted").mapInArrow(lean(run), schema), "representatives")


def verdicts(rows: DataFrame, judge: Callable[[list[dict]], list[bytes]], value: F.Column, encode: Callable[[list], bytes]) -> DataFrame:
    """(anchor, seg, verdict) of all representatives: by judge, or for crowded anchors by encode from each window's value, an aggregate over its equals."""
    windows = rows.where("place is not null")
    known = written(windows.groupBy("anchor", "h1", "h2").agg(value.alias("value")), "windows")
    each = windows.join(known, ["anchor", "h1", "h2"]).groupBy("anchor", "seg").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [encode([x["value"] for x in v]) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("seg"), pa.array(got, pa.binary())], ["anchor", "seg", "verdict"])

    return by_anchor(rows.where("place is null").select("anchor", "seg", "n", "low", "string"), judge).unionByName(each.mapInArrow(lean(run), "anchor long, seg long, verdict binary"))


def by_anchor(rows: DataFrame, judge: Callable[[list[dict]], list[bytes]]) -> DataFrame:
    """(anchor, seg, verdict): judge gets blocks of whole anchors' representatives and gives a verdict for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in ("anchor", "seg")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(judge(rows), pa.binary())], ["anchor", "seg", "verdict"])

        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= BLOCK and row["anchor"] != held[-1]["anchor"]:
                    yield settled(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["string"])
        if held:
            yield settled(held)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(lean(run), "anchor long, seg long, verdict binary")

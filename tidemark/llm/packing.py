"""Hierarchical packing of documents into training sequences of several lengths.

A document is its token ids and one closing id. Whole windows of the longest size are cut off first; what remains goes
to the tier of the smallest context size that holds it. Tiers are packed from the longest down: a window opens with
the longest piece of its tier, its gap takes the longest pieces of the same or shorter tiers that fit, and only
where none fits is a piece cut. So windows end up full, at 256, 512, 1024 or 2048 tokens, all powers of two, without
padding. What no other piece can fill at the end of a task is cut at powers of two. Full sequences are dealt to step
groups so that the groups' attention costs (sums of squared piece lengths) come out close.

Every task packs the documents that it reads, in blocks of bounded size: there is no shuffle, no group that could
grow hot, and a lost task repeats alone.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import documents_of

TIERS = (256, 512, 1024, 2048)
#: Remainders that a task holds before it packs them, and sequences dealt among step groups of this many.
BLOCK, STEP = 4096, 64
CLOSING_ID = 1

SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "tier", "step_group")
    ]
)


class Piece:
    """Ids of one document from start on; cut() parts it."""

    __slots__ = ("doc_id", "ids", "start", "total", "length")

    def __init__(self, doc_id, ids: bytes, start: int, total: int):
        self.doc_id, self.ids, self.start, self.total, self.length = doc_id, ids, start, total, len(ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids[: 4 * n], self.start, self.total), Piece(self.doc_id, self.ids[4 * n :], self.start + n, self.total)


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    return next(t for t in tiers if length <= t)


def pack_remainders(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[Piece]]]:
    """(tier, pieces) of full sequences; the last ones are cut at powers of two."""
    waiting = sorted(pieces, key=lambda p: p.length)
    lengths = [p.length for p in waiting]
    while waiting:
        lengths.pop()
        window = [waiting.pop()]
        size = tier_of(window[0].length, tiers)
        gap = size - window[0].length
        while gap and waiting:
            k = bisect.bisect_right(lengths, gap) - 1
            lengths.pop(max(k, 0))
            piece = waiting.pop(max(k, 0))
            if k < 0:  # none fits: the shortest is cut, which harms the fewest tokens
                piece, rest = piece.cut(gap)
                at = bisect.bisect(lengths, rest.length)
                lengths.insert(at, rest.length)
                waiting.insert(at, rest)
            window.append(piece)
            gap -= piece.length
        if not gap:
            yield size, window
            continue
        power = size
        while window:
            power = min(power, 1 << (sum(p.length for p in window).bit_length() - 1))
            head, room = [], power
            while room:
                piece = window.pop(0)
                if piece.length > room:
                    piece, rest = piece.cut(room)
                    window.insert(0, rest)
                head.append(piece)
                room -= piece.length
            yield size, head


def pack_stream(documents: Iterator[tuple[int | None, bytes]], task: int, tiers: tuple[int, ...] = TIERS, block: int = BLOCK, step: int = STEP) -> Iterator[list[tuple]]:
    """Blocks of result rows for a task's documents (doc_id, ids with the closing id)."""
    longest, made, steps = max(tiers), 0, 0

    def settled(full: list, held: list[Piece]) -> list[tuple]:
        nonlocal made, steps
        sequences = full + list(pack_remainders(held, tiers))
        groups = max(1, -(-len(sequences) // step))
        rows = []
        by_cost = sorted(range(len(sequences)), key=lambda k: -sum(p.length**2 for p in sequences[k][1]))
        dealt = {k: n % groups if n // groups % 2 == 0 else groups - 1 - n % groups for n, k in enumerate(by_cost)}
        for k, (size, pieces) in enumerate(sequences):
            offset, total = 0, sum(p.length for p in pieces)
            for p in pieces:
                rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.total, task << 40 | made + k, offset, total, size, task << 40 | steps + dealt[k]))
                offset += p.length
        made, steps = made + len(sequences), steps + groups
        return rows

    full: list = []
    held: list[Piece] = []
    for doc_id, ids in documents:
        rest = Piece(doc_id, ids, 0, len(ids) // 4)
        while rest.length >= longest:
            head, rest = Piece(doc_id, rest.ids[: 4 * longest], rest.start, rest.total), Piece(doc_id, rest.ids[4 * longest :], rest.start + longest, rest.total)
            full.append((longest, [head]))
            if len(full) >= block:
                yield settled(full, [])
                full = []
        if rest.length:
            held.append(rest)
        if len(held) >= block:
            yield settled(full, held)
            full, held = [], []
    if full or held:
        yield settled(full, held)


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, block: int = BLOCK, step: int = STEP, encoder: Callable[[str], Callable[[str], bytes]] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, tier, step_group.

    Null text is empty text, whose only id is the closing one, so every row of the input is in some sequence. A null
    doc_id stays null. Repeated rows are packed as documents of their own. Very long texts fill windows of their own.
    Sequence ids are unique; they depend on how the input is split into tasks. tiers must be powers of two.
    """
    closing = CLOSING_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer) if encoder else bpe.load(tokenizer).encode
        documents = ((i.as_py(), encode(t.as_py()) + closing) for batch in batches for i, t in zip(batch.column("doc_id"), batch.column("text")))
        for rows in pack_stream(documents, TaskContext.get().partitionId(), tiers, block, step):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], SCHEMA.names)

    return documents_of(docs).mapInArrow(run, SCHEMA)

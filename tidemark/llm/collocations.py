"""Phrases whose words stand together more often than apart, counted over a prefix-free parse.

Each piece of a text is cut where a window of three words has a hash of a chosen residue; neighbouring chunks share that
window, so every phrase of up to four words lies whole in a chunk. Spark counts the distinct chunks once (the dictionary,
with parse frequencies); phrases are then counted inside distinct chunks, times their frequency. A phrase belongs to the
chunk in which it starts before the shared window, so the overlaps count once.

A longer phrase can be frequent only if its pairs of words are: the frequent pairs' hashes set bits in a table of fixed
size, and triples and quadruples over pairs without a bit are not looked at. The table only saves work: whatever it lets
through is counted exactly, so counts are exact at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold_batches, partitions, text_or_empty, written

#: Words of the longest phrase, and so of the window that neighbouring chunks share, plus one.
LONGEST = 4
SHARED = LONGEST - 1
#: One window in so many ends a chunk.
PERIOD = 8
#: Occurrences that make a phrase a candidate, share (in hundredths) of them inside one longer phrase that drops it, phrases for each language.
LEAST, INSIDE, TOP = 30, 80, 2000
#: The table of pairs has 2 to this many bits, whatever the size of the input.
BITS = 26
#: Words that a task gathers before it adds up equal phrases.
GATHER = 1 << 20

#: Kinds of bytes: 0 in words, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?\n\x0b\x0c\r"]] = 2
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(texts: pa.Array, kinds: np.ndarray = KINDS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts one after the other, each word's text, and whether a piece begins with it."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, bool)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = kinds[data]
    inside = kind == 0
    before = np.concatenate(([False], inside[:-1]))
    before[offsets[offsets < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    size = np.int32 if len(data) < 1 << 31 else np.int64
    so_far = np.cumsum(inside, dtype=size)
    ends = np.concatenate((so_far[starts] - 1, so_far[-1:])).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == 2, dtype=size)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    return words, text, first


def hashes(values: pa.Array) -> np.ndarray:
    """64 bits for each value, the same in every task."""
    return pd.util.hash_array(np.array(values.to_pylist(), object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part, odd in zip(parts, ODD):
        out = (out ^ part) * odd
        out ^= out >> np.uint64(29)
    return out


def joined(words: pa.Array, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """words[start : start + length] with one space between words, for each start."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pc.binary_join(pa.ListArray.from_arrays(offsets.astype(np.int32), words.take(pa.array(take)).cast(pa.binary())), b" ").cast(pa.string())


def parsed(texts: pa.Array, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, last, chunk) of each chunk; last: it ends its piece, so that all its words are starts."""
    words, text, first = words_of(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, bool), pa.array([], pa.string())
    coded = words.dictionary_encode()
    h = hashes(coded.dictionary)[coded.indices.to_numpy()]
    piece = np.cumsum(first)
    ends_chunk = np.zeros(len(h), bool)
    if len(h) >= SHARED:
        n = len(h) - SHARED + 1
        window = mixed(*(h[k : k + n] for k in range(SHARED)))
        ends_chunk[:n] = (window % np.uint64(period) == 0) & (piece[:n] == piece[SHARED - 1 :])
    starts = np.flatnonzero(first | ends_chunk)
    following = np.concatenate((starts[1:], [len(h)]))
    last = np.concatenate((first[starts[1:]], [True]))
    return text[starts], last, joined(words, starts, following - starts + SHARED * ~last)


def dictionary(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """(lang, last, chunk, freq): the distinct chunks of each language and how often the parse has them."""
    hold_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty("text").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, last, chunk = parsed(pc.ascii_lower(batch["text"]), period)
            found = pa.table({"lang": batch["lang"].take(pa.array(text)), "last": last, "chunk": chunk, "freq": np.ones(len(text), np.int64)})
            found = found.group_by(["lang", "last", "chunk"]).aggregate([("freq", "sum")]).rename_columns(["lang", "last", "chunk", "freq"])
            yield from found.select(["lang", "last", "chunk", "freq"]).combine_chunks().to_batches()

    chunks = rows.mapInArrow(parse, "lang string, last boolean, chunk string, freq long")
    return chunks.groupBy("lang", "last", "chunk").agg(F.sum("freq").alias("freq"))


def tally(codes: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place and the summed weight of each distinct code."""
    if not len(codes):
        return at[:0], weight[:0]
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return at[order[first]], np.add.reduceat(weight[order], first)


def numbered(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].astype(np.int64)


def phrases_in(chunks: pa.Table, sizes: tuple[int, ...], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, f) of the chunks' phrases of these sizes; with bits only those all of whose pairs have a bit."""
    chunks = chunks.combine_chunks()
    column = lambda name: chunks[name].chunk(0)
    words, text, _ = words_of(column("chunk"), (np.arange(256) == 0x20).astype(np.uint8))
    coded, langs = words.dictionary_encode(), column("lang").dictionary_encode()
    ids, lang = coded.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)[text]
    left = np.searchsorted(text, text, "right") - np.arange(len(text))
    starts = (left > SHARED) | column("last").to_numpy(zero_copy_only=False)[text]
    weight = column("freq").to_numpy()[text]
    word = numbered(lang * max(1, len(coded.dictionary)) + ids)
    n = len(word) + 1
    has_next = np.flatnonzero(left >= 2)
    pair, good = np.zeros(len(word), np.int64), np.zeros(len(word) + LONGEST, bool)
    if len(has_next):
        pair[has_next] = numbered(word[has_next] * n + word[has_next + 1])
        good[has_next] = True
        if bits is not None:
            place = np.zeros(pair[has_next].max() + 1, np.int64)
            place[pair[has_next]] = has_next
            h = hashes(coded.dictionary)
            slot = mixed(hashes(langs.dictionary)[lang[place]], h[ids[place]], h[ids[place + 1]]) >> np.uint64(64 - BITS)
            good[has_next] = ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)[pair[has_next]]
    for size in sizes:
        fits = starts & (left >= size)
        for k in range(size - 1):
            fits &= good[k : k + len(word)]
        at = np.flatnonzero(fits)
        codes = {1: lambda: word[at], 2: lambda: pair[at], 3: lambda: pair[at] * n + word[at + 2], 4: lambda: pair[at] * n + pair[at + 2]}[size]()
        place, f = tally(codes, at, weight[at])
        rows = pa.table({"lang": langs.dictionary.take(pa.array(lang[place])), "size": np.full(len(place), size, np.int32), "phrase": joined(words, place, np.full(len(place), size, np.int64)), "f": f})
        yield from rows.combine_chunks().to_batches(max_chunksize=1 << 16)


def counted(chunks: DataFrame, sizes: tuple[int, ...], least: int, bits=None) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of these sizes that occur at least so often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, characters = [], 0
        for batch in batches:
            held.append(batch)
            characters += batch["chunk"].nbytes
            if characters >= 6 * GATHER:
                yield from phrases_in(pa.Table.from_batches(held), sizes, bits and bits.value)
                held, characters = [], 0
        if held:
            yield from phrases_in(pa.Table.from_batches(held), sizes, bits and bits.value)

    rows = chunks.mapInArrow(count, "lang string, size int, phrase string, f long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def pair_bits(pairs: DataFrame) -> np.ndarray:
    """The bits of these pairs' hashes; 2 to the power of BITS bits at most come to the driver, however many pairs there are."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, _ = words_of(batch["phrase"], (np.arange(256) == 0x20).astype(np.uint8))
            h = hashes(words)
            slot = mixed(hashes(batch["lang"]), h[0::2], h[1::2]) >> np.uint64(64 - BITS)
            yield pa.record_batch({"slot": (slot >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (slot & np.uint64(63))).view(np.int64)})

    found = pairs.select("lang", "phrase").mapInArrow(hashed, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), exact where the product passes 64 bits too."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(l) + wide(r))


def ranked(frequent: DataFrame, totals: DataFrame, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The best phrases of each language from the counts of all frequent ones (a part of a frequent phrase is frequent)."""
    candidates = frequent.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    f = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(f("head", "l"), ["lang", "head"]).join(f("tail", "r"), ["lang", "tail"])
    lowest = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("cut"))

    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    longer = candidates.where("size >= 3").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", inside)))

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = kept.select("lang", "phrase", "a", "cut.*").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(frequent.sparkSession))))
    # the best of each salt first, so that no task sorts a language
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, period: int = PERIOD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language, over whole texts.

    Null texts are empty, null languages are und; languages without a candidate, and empty tables, give no row. Repeated
    rows count as often as they stand there. Ties in score go to the more frequent phrase, then to the smaller one by its
    UTF-8 bytes. Columns other than text and lang are not read.
    """
    spark = docs.sparkSession
    chunks = written(dictionary(docs, period), "chunks")
    n_starts = F.size(F.split("chunk", " ")) - F.when(F.col("last"), 0).otherwise(SHARED)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("freq") * n_starts).alias("n"))
    short = written(counted(chunks, (1, 2), least), "phrases")
    bits = spark.sparkContext.broadcast(pair_bits(short.where("size = 2")))
    long = written(counted(chunks, (3, 4), least, bits), "phrases")
    return ranked(short.unionByName(long), totals, top)

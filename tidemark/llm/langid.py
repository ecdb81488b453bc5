"""Language identification by prediction by partial matching.

For every language, contexts of up to ORDER bytes hold counts of the bytes that followed, from a bounded sample of labelled
documents, whose texts are taken as they are. A byte's code length comes from the longest context that has been seen: the byte's share
there or, if it hasn't followed there, the escape's share (method C: as many escapes as kinds of byte) and then that of the next shorter context without the bytes that the
longer one would have named, down to equal shares for the bytes that were never seen. Statistics are frozen after training, so a byte's code length
depends on nothing but it and the ORDER bytes before it. Code lengths are whole numbers of 1 / UNIT bits, so that sums don't depend on their order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, written

#: Longest context in bytes, and the largest number of labelled documents of each language that training reads.
ORDER, SAMPLE = 4, 600
#: Code lengths are counted in this part of a bit.
UNIT = 1 << 16
#: Bytes scored in one go; contexts with their byte whose code lengths a worker remembers.
CHUNK, REMEMBERED = 1 << 18, 1 << 20
UNKNOWN = "und"

#: Grams (the ORDER bytes before a byte and the byte, as one number) and how often each occurs, by language.
Model = dict[str, tuple[np.ndarray, np.ndarray]]
_START = b"\0" * ORDER


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def grams_of(data: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte from the one at ORDER on."""
    n = len(data) - ORDER
    out = np.zeros(max(0, n), np.uint64)
    for k in range(ORDER + 1 if n > 0 else 0):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def pieces(text: str) -> Iterator[bytes]:
    """Parts of at most CHUNK bytes, each behind the ORDER bytes that come before it (at the start: zeros)."""
    data = _START + text.encode("utf-8", "replace")
    for at in range(0, max(1, len(data) - ORDER), CHUNK):
        yield data[at : at + CHUNK + ORDER]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of texts with their counts, summed within each piece."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for piece in pieces(text.as_py()):
                gram, n = np.unique(grams_of(np.frombuffer(piece, np.uint8)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of at most sample different labelled documents of each language that are not held out, picked by a hash of the row.

    Texts stay where they are until the picked rows are known. A cut by the language's number of rows leaves about twice as many hashes as are wanted, so
    that no language's rows meet in one task.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    # one row for each language
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("row"))
    few = F.pmod("row", F.lit(1 << 31)).cast("double") * F.col("rows") <= 2.0 * sample * (1 << 31)
    picked = labelled.select("lang", "row").join(F.broadcast(sizes), "lang").where(few).select("lang", "row").distinct().withColumn("place", place).where(F.col("place") <= sample)
    # at most sample rows of two columns for each language
    picked = F.broadcast(written(picked.select("lang", "row"), "picked"))
    return labelled.join(picked, ["lang", "row"], "left_semi").groupBy("lang", "row").agg(F.first("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts of grams by language, from at most sample documents of each. Rows without text or language, and held-out ones, play no part; none left: no languages."""
    table = sampled(docs, sample).mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = table["lang"].to_numpy(zero_copy_only=False)
    gram, n = table["gram"].to_numpy().astype(np.uint64), table["n"].to_numpy()
    model: Model = {}
    for lang in sorted(set(langs)):
        mine = np.flatnonzero(langs == lang)
        mine = mine[np.argsort(gram[mine])]
        model[str(lang)] = gram[mine], n[mine]
    return model


class Tree:
    """One language's frozen contexts of 0 to ORDER bytes.

    Of each order: sorted symbols (context and byte) with their counts; sorted contexts with the sum of counts and the number of kinds of byte, and
    both once more for the context that is one byte shorter, less the bytes that this one has named.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.symbols, self.counts, self.contexts, self.total, self.kinds, self.left, self.left_kinds = ([] for _ in range(7))
        for order in range(ORDER + 1):
            key = gram & np.uint64((1 << 8 * (order + 1)) - 1)
            by = np.argsort(key, kind="stable")
            symbol, at = np.unique(key[by], return_index=True)
            count = np.add.reduceat(n[by], at) if len(at) else n[:0]
            context, first = np.unique(symbol >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, first) if len(first) else n[:0]
            kinds = np.diff(np.append(first, len(symbol)))
            if order:
                shorter = np.searchsorted(self.contexts[-1], context & np.uint64((1 << 8 * (order - 1)) - 1))
                same = np.searchsorted(self.symbols[-1], symbol & np.uint64((1 << 8 * order) - 1))
                named = np.add.reduceat(self.counts[-1][same], first) if len(first) else n[:0]
                self.left.append(self.total[-1][shorter] - named)
                self.left_kinds.append(self.kinds[-1][shorter] - kinds)
            for kept, new in ((self.symbols, symbol), (self.counts, count), (self.contexts, context), (self.total, total), (self.kinds, kinds)):
                kept.append(new)

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram, in units."""
        bits = np.zeros(len(gram))
        coded = np.zeros(len(gram), bool)
        above = np.zeros(len(gram), bool)
        total, kinds = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        for order in range(ORDER, -1, -1):
            at, seen = _find(self.contexts[order], (gram >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1))
            total = np.where(above, total, self.total[order][at])
            kinds = np.where(above, kinds, self.kinds[order][at])
            of, follows = _find(self.symbols[order], gram & np.uint64((1 << 8 * (order + 1)) - 1))
            now = seen & follows & ~coded
            escapes = seen & ~follows & ~coded & (kinds > 0)
            bits[now] += np.log2((total + kinds)[now] / self.counts[order][of[now]])
            bits[escapes] += np.log2((total + kinds)[escapes] / kinds[escapes])
            coded |= now
            above |= seen
            if order:
                total, kinds = self.left[order - 1][at], self.left_kinds[order - 1][at]
        bits[~coded] += np.log2(256 - len(self.symbols[0]) or 1)
        return np.rint(bits * UNIT).astype(np.int32)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted among sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Scorer:
    """Code lengths of texts under every language of a frozen model. Grams met before are looked up in a table of fixed size."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.langs, self.trees = list(model), [Tree(*counts) for counts in model.values()]
        self.shift = np.uint64(64 - (remembered.bit_length() - 1))
        self.grams = np.full(remembered, 2**64 - 1, np.uint64)
        self.known = np.zeros((remembered, len(self.trees)), np.int32)

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """One row for each gram, one column for each language."""
        slot = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.grams[slot] != gram)
        if len(new):
            kinds, first, which = np.unique(gram[new], return_index=True, return_inverse=True)
            lengths = np.stack([t.code_lengths(kinds) for t in self.trees], axis=1)
            out[new] = lengths[which]
            # of grams that share a slot the last stays, in both tables
            at = slot[new[first]]
            self.grams[at] = kinds
            self.known[at] = lengths
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths in units of each text under each language, and numbers of bytes."""
        bits, sizes = np.zeros((len(texts), len(self.trees)), np.int64), np.zeros(len(texts), np.int64)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            data = np.frombuffer(b"".join(p for _, p in held), np.uint8)
            n = np.array([len(p) for _, p in held])
            starts = np.cumsum(n) - n
            # grams that reach into the piece before are left out
            whole = np.ones(len(data) - ORDER, bool)
            for k in range(ORDER):
                at = starts[1:] - ORDER + k
                whole[at] = False
            lengths = self.code_lengths(grams_of(data)[whole])
            some = n > ORDER
            first = (np.cumsum(n - ORDER) - (n - ORDER))[some]
            if len(first):
                np.add.at(bits, [k for (k, _), s in zip(held, some) if s], np.add.reduceat(lengths, first, axis=0, dtype=np.int64))
            np.add.at(sizes, [k for k, _ in held], n - ORDER)

        for k, text in enumerate(texts):
            for piece in pieces(text):
                held.append((k, piece))
                size += len(piece)
                if size >= CHUNK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return bits, sizes

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, their shares of the probability among all, and bits for each byte."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        units, sizes = self.texts(texts)
        best = units.argmin(axis=1)
        least = units[np.arange(len(texts)), best]
        share = 1 / np.exp2(np.maximum(-1000.0, (least[:, None] - units) / UNIT)).sum(axis=1)
        return [self.langs[k] for k in best], share, least / UNIT / np.maximum(1, sizes)


@functools.lru_cache(maxsize=2)
def _scorer(broadcast) -> Scorer:
    return Scorer(broadcast.value)


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and bits_per_byte of every document, and the columns to carry.

    lang_pred is und, with score and bits_per_byte 0, where the text is null or has no letter (Unicode's L), or where nothing was learned. Only the text is read. Whole
    texts are scored. Ties go to the language first in order. Repeated rows give repeated results; a null doc_id stays null.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def found(text: pa.Array, lettered: pa.Array) -> pa.Array:
        scorer = _scorer(frozen)
        lang = np.full(len(text), UNKNOWN, object)
        share, bits = np.zeros(len(text)), np.zeros(len(text))
        some = np.flatnonzero(lettered.to_numpy(zero_copy_only=False).astype(bool))
        lang[some], share[some], bits[some] = scorer.score([text[k].as_py() for k in some.tolist()])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(share), pa.array(bits)], ["lang_pred", "score", "bits_per_byte"])

    # texts go to Python, and only what was found comes back; not deterministic, so that a filter on it does not run it once more
    score = F.arrow_udf(found, "struct<lang_pred:string,score:double,bits_per_byte:double>").asNondeterministic()
    docs = documents_of(docs, tuple(c for c in carry if c not in ("doc_id", "text"))).withColumn("found", score("text", F.col("text").rlike(r"\p{L}")))
    return docs.select("doc_id", "found.lang_pred", "found.score", "found.bits_per_byte", *carry)

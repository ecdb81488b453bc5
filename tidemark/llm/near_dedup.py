"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words, weighted by how often they occur in it times the mean inverse document frequency of their
words. Consistent weighted samples of two texts agree as often as their weighted Jaccard similarity says. Texts that agree on all
samples of some band are candidates; those whose samples agree often enough are verified by the exact weighted Jaccard similarity. Classes
are the connected components of the links.

Exact copies are one representative from the start. Buckets of few members give all their pairs. Members of larger buckets
are dealt again by pairs of bands, and only in sub-buckets that are still large, whose members nearly all are near copies
of each other, are members compared with a few centres that all sub-buckets choose by the same orders. Verification goes in two rounds: one candidate for each text, then those that would join different classes.
Centres only save work: members of a crowded bucket whom all this leaves in different classes are then compared block against block, every
one with every other, and verified where they meet; what comes out are links that join classes, no row for each pair. Nothing is left out but pairs already in one verified class.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .anchored import CHUNK, SMALLEST, compressed, keyed, mixed, opened, word_hashes
from .common import lean, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 14, 3
#: Members up to which a bucket gives all pairs; orders by which larger sub-buckets choose centres.
ALL_PAIRS, CENTRES = 24, 3
#: Following bands by each of which a crowded bucket is dealt again.
NEXT = 3
#: Members of crowded buckets that meet in one block, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Share of documents from which on a word counts as less than rare. At most (distinct words in a document) / FREQUENT words can reach it, whatever the
#: number of documents; that bounds the table that is sent to the workers.
FREQUENT = 1e-3
#: Samples agreeing less often than this are not verified: four standard deviations under SIMILAR.
LEAST_AGREEMENT = SIMILAR - 4 * (SIMILAR * (1 - SIMILAR) / (BANDS * ROWS)) ** 0.5


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for t in batch.column(column):
        yield b" ".join(t.as_py().encode("utf-8", "replace").split()) + b" "


def document_frequencies(docs: DataFrame, least: float = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the words that at least this share of documents has, their numbers of documents, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for batch in batches:
            for text in texts_of(batch, "text"):
                held.append(np.unique(word_hashes(text, [len(text)])[0]))
                size += len(held[-1])
                if size > CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    total = docs.count()
    often = docs.select("text").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, least * total))
    table = often.toArrow()
    words, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(words)
    return words[order], n[order], total


class Weights:
    """Weighted shingles of texts under frozen document frequencies."""

    def __init__(self, words: np.ndarray, n: np.ndarray, total: int, least: float = FREQUENT):
        self.words = words
        rare = max(2.0, least * total)
        self.idf = np.append(np.log1p(total / np.maximum(n, rare)), np.log1p(max(1, total) / rare))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingle hashes, weights and the first of each text (texts' shingles stand together, sorted by hash). A text of fewer words than a shingle has is one shingle."""
        hashes, _, _, starts, ends = word_hashes(b"".join(texts), [len(t) for t in texts])
        if not len(hashes):
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(texts), np.int64)
        at = np.searchsorted(self.words, hashes)
        known = np.append(self.words, np.uint64(0))[at] == hashes
        idf = self.idf[np.where(known & (at < len(self.words)), at, len(self.words))]
        text = np.repeat(np.arange(len(texts)), ends - starts)
        pad = SHINGLE - 1
        same = np.concatenate([text, np.full(pad, -1)])
        padded, weight = np.concatenate([hashes, np.zeros(pad, np.uint64)]), np.concatenate([idf, np.zeros(pad)])
        n = len(hashes)
        shingle, mean = np.zeros(n, np.uint64), np.zeros(n)
        for j in range(SHINGLE):  # words past a short text's end count as nothing
            here = same[j : j + n] == text
            shingle = shingle * np.uint64(0x5851F42D4C957F2D) + np.where(here, padded[j : j + n], np.uint64(0))
            mean += np.where(here, weight[j : j + n], 0.0)
        first = np.zeros(n, bool)
        first[starts[ends > starts]] = True
        keep = (same[pad : pad + n] == text) | first & ((ends - starts)[text] < SHINGLE)
        shingle, mean, text = mixed(shingle[keep]), mean[keep] / SHINGLE, text[keep]
        order = np.lexsort((shingle, text))
        shingle, mean, text = shingle[order], mean[order], text[order]
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(shingle)))
        return shingle[at], mean[at] * times, np.searchsorted(text[at], np.arange(len(texts)))


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the two Gamma(2, 1) variates that consistent weighted sampling draws: r, and ln c."""
    x = np.linspace(1e-9, 40, 2_000_001)
    cdf = 1 - np.exp(-x) * (1 + x)
    draw = lambda n: np.interp((np.arange(n) + 0.5) / n, cdf, x)
    return draw(4096), np.log(draw(1 << 20))


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """One column of consistent weighted samples for each text that has shingles; a sample is a hash of the chosen shingle and its level."""
    r_table, c_table = tables()
    log = np.log(weights)
    sizes = np.diff(np.append(starts, len(shingles)))
    out = np.zeros((count, len(starts)), np.uint64)
    owner = np.repeat(np.arange(len(starts)), sizes)
    for k in range(count):
        h = mixed(shingles + np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        r = r_table[(h & np.uint64(4095)).astype(np.int64)]
        beta = ((h >> np.uint64(12)) & np.uint64(0xFFFFF)).astype(np.float64) * 2.0**-20
        level = np.floor(log / r + beta)
        a = c_table[(h >> np.uint64(32)).astype(np.int64) & 0xFFFFF] - r * (level - beta + 1)
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[owner])
        at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
        out[k] = mixed(shingles[at] ^ (level[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (shingles, weights)."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low, high = np.minimum(a[1][at], b[1][bt]).sum(), np.maximum(a[1][at], b[1][bt]).sum()
    whole = a[1].sum() + b[1].sum() - low - high
    return float(low / (whole + high)) if whole + high > 0 else 0.0


def bands(docs: DataFrame, frozen) -> DataFrame:
    """(node, buckets, signature, size) of every text that has words: the bucket of each of BANDS bands, a byte of each sample as signature, and the text's bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*frozen.value)
        held: list[tuple[int, bytes]] = []

        def flush() -> pa.RecordBatch:
            shingles, weight, starts = weights.of([t for _, t in held])
            some = np.flatnonzero(np.diff(np.append(starts, len(shingles))))
            got = samples(shingles, weight, starts[some])
            bucket = np.stack([mixed(functools.reduce(lambda x, y: x * np.uint64(0x5851F42D4C957F2D) + y, got[b * ROWS : b * ROWS + ROWS]) + np.uint64(b)) for b in range(BANDS)])
            node = np.array([n for n, _ in held], np.int64)[some]
            signature = [x.tobytes() for x in (got & np.uint64(255)).astype(np.uint8).T]
            sizes = np.array([len(t) for _, t in held], np.int64)[some]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(bucket.T.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array(signature, pa.binary()), pa.array(sizes)], ["node", "buckets", "signature", "size"])

        size = 0
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), texts_of(batch, "text")):
                if len(text) > 1:
                    held.append((node, text))
                    size += len(text)
                if size > CHUNK // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("node", "text").mapInArrow(lean(run), "node long, buckets array<long>, signature binary, size long")


def agreeing(left: F.Column, right: F.Column) -> F.Column:
    """Share of equal bytes of two signatures."""
    n = BANDS * ROWS
    byte = lambda c, i: F.substring(c, i + 1, F.lit(1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda acc, i: acc + (byte(left, i) == byte(right, i)).cast("int")) / n


def all_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of agreeing members of buckets given as lists of at most ALL_PAIRS members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for members in batch.column("members").to_pylist():
                node = [m["node"] for m in members]
                sign = np.frombuffer(b"".join(m["signature"] for m in members), np.uint8).reshape(len(node), -1)
                for i in range(1, len(node)):
                    for j in np.flatnonzero((sign[:i] == sign[i]).mean(axis=1) >= LEAST_AGREEMENT).tolist():
                        if node[i] != node[j]:
                            seen.add((max(node[i], node[j]), min(node[i], node[j])))
            a, b = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(lean(run), "a long, b long")


def small(rows: DataFrame) -> DataFrame:
    """Members of buckets known to be small, a list for each bucket."""
    return rows.groupBy("bucket").agg(F.collect_list(F.struct("node", "signature")).alias("members")).select("members")


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of nodes that share a bucket and whose samples agree often enough, of crowded buckets only the likely ones; and (node, band, bucket) of
    crowded buckets. signed: a table of (node, buckets, signature)."""
    rows = signed.select("node", F.posexplode("buckets").alias("band", "bucket"))
    sized = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = written(rows.join(sized, "bucket"), "shared")
    signs = signed.select("node", "signature")
    few = all_pairs(small(shared.where(F.col("n") <= ALL_PAIRS).join(signs, "node")))
    # a crowded bucket is dealt again by each of the next bands; texts that are alike share one of those all but surely
    crowded = shared.where(F.col("n") > ALL_PAIRS).select("node", "band", "bucket").join(signed, "node")
    following = [F.xxhash64("bucket", F.get("buckets", (F.col("band") + k) % BANDS)) for k in range(1, NEXT + 1)]
    again = written(crowded.select("node", "signature", F.explode(F.array(*following)).alias("bucket")), "again")
    first = [F.min(F.struct(F.xxhash64(F.lit(c), F.col("node")).alias("h"), "node", "signature")).alias(f"c{c}") for c in range(CENTRES)]
    counted = written(again.groupBy("bucket").agg(F.count("*").alias("n"), *first).where("n > 1"), "counted")
    dealt = again.join(counted, "bucket")
    fewer = all_pairs(small(dealt.where(F.col("n") <= ALL_PAIRS).select("bucket", "node", "signature")))
    centres = F.array_distinct(F.transform(F.array(*[f"c{c}" for c in range(CENTRES)]), lambda c: F.struct(c["node"].alias("node"), c["signature"].alias("signature"))))
    near = F.filter(centres, lambda c: (c["node"] != F.col("node")) & (agreeing(F.col("signature"), c["signature"]) >= LEAST_AGREEMENT))
    star = dealt.where(F.col("n") > ALL_PAIRS).select("node", F.transform(near, lambda c: c["node"]).alias("centres"))
    star = star.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("centres"))).alias("centres")).select("node", F.explode("centres").alias("c"))
    pairs = few.unionByName(fewer).unionByName(star.select(F.greatest("node", "c").alias("a"), F.least("node", "c").alias("b"))).distinct()
    return pairs, shared.where(F.col("n") > ALL_PAIRS).select("node", "band", "bucket")


def by_pair(sides: DataFrame, judge, schema: str) -> DataFrame:
    """What judge makes of the rows of each pair of blocks. sides: (pair, side, node, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for start, end in zip(cuts, cuts[1:]):
                if start < end:
                    if held and pair[start] != last:
                        yield from judge(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(start, end - start))
                    last = pair[start]
        if held:
            yield from judge(pa.Table.from_batches(held))

    return sides.repartition("pair").sortWithinPartitions("pair").mapInArrow(lean(run), schema)


def compared(sides: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of agreeing members of different classes, and how many samples agree. sides: (pair, side, node, class, signature) of pairs of blocks."""
    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        right = rows["side"].to_numpy() == 1
        node, of = rows["node"].to_numpy(), rows["class"].to_numpy()
        sign = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(len(node), -1)
        others, classes_of, signs = node[right], of[right], sign[right]
        out: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(~right).tolist():
            alike = (signs == sign[i]).sum(axis=1)
            for j in np.flatnonzero((alike >= LEAST_AGREEMENT * sign.shape[1]) & (classes_of != of[i])).tolist():
                x, y = int(node[i]), int(others[j])
                out[max(x, y), min(x, y)] = int(alike[j])
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out.values(), pa.int64())], ["a", "b", "alike"])

    return by_pair(sides, judge, "a long, b long, alike long")


def linked(sides: DataFrame, frozen) -> DataFrame:
    """Links (a, b), a > b, that join the classes of the members of each pair of blocks as all their links would: agreeing members are verified where they meet, unless what has been
    found there makes them one class already, so that no more links come out than there are members. sides: (pair, side, band, node, class, signature, buckets, z).

    Two texts that share several buckets are compared in that of the first band: if it is not a crowded one, all its pairs have been verified before.
    """
    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        weights = Weights(*frozen.value)
        right = rows["side"].to_numpy() == 1
        node, band = rows["node"].to_numpy(), rows["band"][0].as_py()
        sign = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(len(node), -1)
        buckets = rows["buckets"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)[:, :band]
        names, group = np.unique(rows["class"].to_numpy(), return_inverse=True)
        if len(names) < 2:
            return
        texts = [b" ".join(opened(z.as_py()).split()) + b" " for z in rows["z"]]
        shingles, weight, starts = weights.of(texts)
        vocabulary, at = np.unique(shingles, return_inverse=True)
        ends, totals = np.append(starts[1:], len(shingles)), np.add.reduceat(weight, starts)
        heavy = np.zeros(len(vocabulary))
        lefts, rights = np.flatnonzero(~right), np.flatnonzero(right)
        out: list[tuple[int, int]] = []
        for i in lefts.tolist():
            apart = rights[group[rights] != group[i]]
            agree = (sign[apart] == sign[i]).sum(axis=1) >= LEAST_AGREEMENT * sign.shape[1]
            apart = apart[agree]
            apart = apart[~(buckets[apart] == buckets[i]).any(axis=1)]
            if not len(apart):
                continue
            mine = slice(starts[i], ends[i])
            heavy[at[mine]] = weight[mine]
            sizes = ends[apart] - starts[apart]
            first = np.cumsum(sizes) - sizes
            flat = np.repeat(starts[apart] - first, sizes) + np.arange(sizes.sum())
            low = np.add.reduceat(np.minimum(heavy[at[flat]], weight[flat]), first)
            heavy[at[mine]] = 0.0
            for j in apart[low >= (SIMILAR - 1e-9) * (totals[i] + totals[apart] - low)].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    out.append((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j]))))
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_pair(sides, judge, "a long, b long")


def met_blocks(crowded: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    """(pair, side, node, class and the columns of crowded and signed) of every two blocks of a crowded bucket that are to be compared.

    Members of a class that has BLOCK of them in the bucket stand in blocks of their own, which are not compared with each other; members of smaller classes share blocks.
    """
    members = crowded.join(found.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    members = written(members.join(signed, "node"), "members")
    size = F.sum("size") if "size" in members.columns else F.lit(0)
    sizes = members.groupBy("bucket", "class").agg(F.count("*").alias("n"), size.alias("bytes")).withColumn("own", F.col("n") >= BLOCK).withColumn("group", F.when(F.col("own"), F.col("class")).otherwise(0))
    sizes = written(sizes, "sizes")
    divided = sizes.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES))
    groups = sizes.groupBy("bucket", "own", "group").agg(blocks.alias("blocks")).join(divided, "bucket")
    groups = written(groups, "groups")
    blocks = groups.select("bucket", "own", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # named anew, so that the two sides of the join are told apart
    left, right = (blocks.select("bucket", F.struct("own", "group", "block").alias(side)) for side in ("l", "r"))
    met = left.join(right, "bucket").where("l <= r and not (l.own and r.own and l.group = r.group)").withColumn("pair", F.xxhash64("bucket", "l", "r"))
    met = met.select("bucket", "pair", F.posexplode(F.array("l", "r")).alias("side", "at")).select("bucket", "pair", "side", "at.own", "at.group", "at.block")
    placed = members.join(sizes.select("bucket", "class", "own", "group"), ["bucket", "class"]).join(groups, ["bucket", "own", "group"])
    return placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).join(met, ["bucket", "own", "group", "block"])


def across(crowded: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, alike) for every pair of nodes that share a crowded bucket, are of different classes so far, and whose samples agree often enough. Their number grows with the square of
    a bucket's classes; linking compares the same pairs without a row for each."""
    return compared(met_blocks(crowded, signed, found).select("pair", "side", "node", "class", "signature")).distinct()


def linking(crowded: DataFrame, signed: DataFrame, found: DataFrame, texts: DataFrame, frozen) -> DataFrame:
    """Links (a, b) that join the classes found so far as all links between nodes that share a crowded bucket would. texts: (node, z) of all nodes."""
    met = met_blocks(crowded, signed, found).select("pair", "side", "band", "node", "class", "signature", "buckets")
    return linked(met.join(texts, "node"), frozen).distinct()


def verified(pairs: DataFrame, texts: DataFrame, frozen) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity is SIMILAR or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*frozen.value)

        def vector(z) -> tuple[np.ndarray, np.ndarray]:
            return weights.of([b" ".join(opened(z.as_py()).split()) + b" "])[:2]

        last, held = None, None
        for batch in batches:
            out = []
            for a, b, za, zb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("za"), batch.column("zb")):
                if b != last:
                    last, held = b, vector(zb)
                if similarity(vector(za), held) >= SIMILAR - 1e-9:
                    out.append((a, b))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").sortWithinPartitions("b").mapInArrow(lean(run), "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, for every row; first tells one row of each class apart.

    Two texts are linked if the weighted Jaccard similarity of their shingles is 0.8 or more; classes are what links connect. Equal texts are always of one class, null text being empty
    text. A text without words is only like equal texts. class_id is null if no member has a doc_id. Other columns play no part.
    """
    docs = keyed(docs)
    # one number for each row's text; where ids are unique it is the id itself
    docs = docs.withColumn("node", F.when(F.col("part") == 0, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "part")))
    rows = docs.select("doc_id", "part", "node", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"))
    copies = written(rows.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("n")), "copies")
    frozen = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs))
    again = written(rows.join(copies.select("h1", "h2", F.col("node").alias("kept")), ["h1", "h2"]).select("doc_id", "part", "node", "kept"), "rows")
    later = again.where("node <> kept").select("node").distinct()
    signed = written(bands(docs, frozen).join(later, "node", "left_anti"), "signed")
    pairs, crowded = candidates(signed)
    pairs = written(pairs, "pairs")
    named = compressed(docs).withColumn("node", F.when(F.col("part") == 0, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "part")))

    def joined(pairs: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of pairs, and their components: first is verified before all others that would still join different classes."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        # the same join at every size: what is wanted grows with the input
        texts = written(named.join(wanted.hint("merge"), "node").select("node", "z").dropDuplicates(["node"]), "texts")
        links = written(verified(first, texts, frozen), "links")
        found = written(components(links), "classes")
        side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        links = links.unionByName(written(verified(apart, texts, frozen), "links"))
        return links, written(components(links), "classes")

    links, found = joined(pairs, pairs.groupBy("a").agg(F.min("b").alias("b")))
    texts = named.select("node", "z").join(crowded.select("node").distinct().hint("merge"), "node").dropDuplicates(["node"])
    rest = written(linking(crowded, signed, found, texts, frozen), "across")
    if not rest.isEmpty():
        found = written(components(links.unionByName(rest)), "classes")
    labelled = again.join(found.withColumnRenamed("node", "kept"), "kept", "left").withColumn("component", F.coalesce("component", "kept"))
    named_id = F.when(F.col("doc_id") != SMALLEST, F.col("doc_id"))
    about = labelled.groupBy("component").agg(F.min(named_id).alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct("doc_id", "part")).alias("one"))
    first = (F.col("doc_id") == F.col("one.doc_id")) & (F.col("part") == F.col("one.part"))
    return labelled.join(about, "component").select(named_id.alias("doc_id"), "class_id", "class_size", first.alias("first"), "part")

"""Exact top-k inner products by best-first search of M-trees.

Vectors of integers are placed on a sphere by one more coordinate, after which the largest inner product is the smallest distance. Rows
are dealt to the nearest of some pivots, and a pivot's rows to shards; every shard is one M-tree of paged nodes: a node holds routing objects with a covering radius
and the distance to their parent. A search takes the node with the smallest possible distance first; through the stored distances
the triangle inequality rules out entries without computing their distance. Scores themselves are exact integers.
A query first searches one shard of its nearest pivot. Its k-th best there bounds all that follows: pivots whose covering radius keeps every row farther away are left out, and in the other
shards the search starts from that bound. Queries go against shards in blocks, and the best of all are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Entries of a node, rows of a shard, queries of a block.
PAGE, SHARD, BLOCK = 64, 4096, 256
#: Pivots at most; they and their radii are sent to all workers, whatever the number of rows.
PIVOTS = 1024
#: Share of squared sizes that bounds give way by. Squares of norms and distances are sums of at most a few thousand doubles, so that rounding is far below it as long as scores
#: fit a 64-bit integer.
SLACK = 1e-12


class Node:
    """Entries of one page: centre of each, distance to the page's own centre, covering radius; children, or rows in a leaf."""

    __slots__ = ("points", "to_parent", "radius", "children", "rows")

    def __init__(self, points, to_parent, radius, children, rows):
        self.points, self.to_parent, self.radius, self.children, self.rows = points, to_parent, radius, children, rows


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def build(points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> Node:
    """Bulk-loads a tree: up to PAGE routing objects, far apart, each take the rows nearest to them."""
    if len(rows) <= PAGE:
        at = points[rows]
        return Node(at, distances(at, centre), np.zeros(len(rows)), None, rows)
    fan = min(PAGE, -(-len(rows) // PAGE) + 1)
    chosen = [rows[0]]
    nearest = distances(points[rows], points[rows[0]])
    owner = np.zeros(len(rows), np.int64)
    while len(chosen) < fan and nearest.max() > 0:
        chosen.append(rows[int(nearest.argmax())])
        d = distances(points[rows], points[chosen[-1]])
        owner[d < nearest] = len(chosen) - 1
        nearest = np.minimum(nearest, d)
    if len(chosen) == 1:  # all rows are one point
        parts = np.array_split(rows, fan)
        chosen = [p[0] for p in parts]
    else:
        parts = [rows[owner == k] for k in range(len(chosen))]
    routing = points[chosen]
    children = [build(points, part, c) for part, c in zip(parts, routing)]
    radius = np.array([distances(points[part], c).max() for part, c in zip(parts, routing)])
    return Node(routing, distances(routing, centre), radius, children, None)


def on_sphere(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more coordinate, which brings the square of every norm to norm."""
    points = vectors.astype(np.float64)
    return np.concatenate([points, np.sqrt(np.maximum(0.0, norm - (points**2).sum(axis=1)))[:, None]], axis=1)


class Tree:
    """An M-tree over a shard's rows of integer vectors, whose squared norms are norm at most."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        self.norm = float((self.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) if norm is None else norm
        self.points = on_sphere(self.vectors, self.norm)
        self.root = build(self.points, np.arange(len(ids)), self.points[0]) if len(ids) else None
        self.computed = 0

    def reach(self, score: float, query_norm: float) -> float:
        """Distance beyond which no row has this score: the square of a distance is the sum of both squared norms less twice the score."""
        square = query_norm + self.norm
        return max(0.0, square - 2 * score + SLACK * (square + abs(score))) ** 0.5

    def search(self, query: np.ndarray, k: int, not_id: int | None = None, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id): highest score first, ties to the smaller id; not_id is left out, and so are scores under least."""
        if self.root is None:
            return []
        q = np.append(query.astype(np.float64), 0.0)
        exact = query.astype(np.int64)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        norm = float((q**2).sum())
        slack = SLACK**0.5 * (norm + self.norm) ** 0.5 * 1e-3
        # distance beyond which nothing can be among the best
        worst = np.inf if least is None else self.reach(least, norm)
        queue = [(0.0, 0, self.root, float(distances(self.points[:1], q)[0]))]
        tick = 1
        self.computed += 1
        while queue:
            bound, _, node, to_centre = heapq.heappop(queue)
            if bound > worst + slack:
                break
            may = np.flatnonzero(np.abs(to_centre - node.to_parent) - node.radius <= worst + slack)
            self.computed += len(may)
            if node.children is None:
                rows = node.rows[may]
                for score, row in zip((self.vectors[rows] @ exact).tolist(), rows.tolist()):
                    if self.ids[row] != not_id and (least is None or score >= least):
                        entry = (score, -int(self.ids[row]))
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                if len(best) == k:
                    worst = min(worst, self.reach(best[0][0], norm))
            else:
                d = distances(node.points[may], q)
                for e, far in zip(may.tolist(), d.tolist()):
                    low = max(0.0, far - node.radius[e])
                    if low <= worst + slack:
                        heapq.heappush(queue, (low, tick, node.children[e], far))
                        tick += 1
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integers(table: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id and v, floor(scale * x) of every component; vectors that are null or hold a null or a component that isn't finite are left out."""
    x = F.col(vector_column).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(fine & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def packed(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """One row for each value of keys, with fields of all its rows (a long, or an array of longs) as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members").to_pylist()
            columns = [pa.array([np.array([m[f] for m in some], "<i8").tobytes() for some in members], pa.binary()) for f in fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *columns], [*keys, *fields.values()])

    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys], *[f"{n} binary" for n in fields.values()]])
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("members")).mapInArrow(run, schema)


def nearest_pivot(rows: DataFrame, pivots: dict, norm: float) -> DataFrame:
    """rows (id, v, width) with the number of the nearest pivot of their width and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            pivot, far = np.zeros(len(width), np.int64), np.zeros(len(width))
            lists = batch.column("v")
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                points = on_sphere(lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), w), norm)
                # rows of a batch in parts, so that the distances to all pivots stay small
                for some in range(0, len(at), 1024):
                    x = points[some : some + 1024]
                    square = np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (pivots[w] ** 2).sum(axis=1) - 2 * x @ pivots[w].T)
                    near = square.argmin(axis=1)
                    pivot[at[some : some + 1024]] = near
                    far[at[some : some + 1024]] = np.sqrt(((x - pivots[w][near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, batch.column("width"), pa.array(pivot), pa.array(far)], ["id", "v", "width", "pivot", "far"])

    return rows.mapInArrow(run, "id long, v array<long>, width int, pivot long, far double")


def searched(shards: DataFrame, asked: DataFrame, on: list[str], k: int, norm: float) -> DataFrame:
    """(query_id, tag, vec_id, score, computed): the k best of each query in each shard it meets. shards: width, pivot, shard, ids, vectors; asked: width, pivot, query_ids, tags,
    query_vectors, least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["width"], r["pivot"], r["shard"]) != last:
                    last = (r["width"], r["pivot"], r["shard"])
                    ids = np.frombuffer(r["ids"], "<i8")
                    tree = Tree(ids, np.frombuffer(r["vectors"], "<i8").reshape(len(ids), -1), norm)
                ids, tags, least = (np.frombuffer(r[c], "<i8") for c in ("query_ids", "tags", "least"))
                out = []
                for i, tag, q, low in zip(ids.tolist(), tags.tolist(), np.frombuffer(r["query_vectors"], "<i8").reshape(len(ids), -1), least.tolist()):
                    before = tree.computed
                    found = tree.search(q, k, i, None if low == NONE else low)
                    out += [(i, tag, v, s, 0) for s, v in found] + [(i, tag, None, None, tree.computed - before)]
                names = ["query_id", "tag", "vec_id", "score", "computed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * len(names))], names)

    # never broadcast: what shards take on disk says little about their size in memory, since equal rows and small numbers are written in hardly any space
    met = shards.hint("merge").join(asked, on).repartition("width", "pivot", "shard", "block").sortWithinPartitions("width", "pivot", "shard")
    columns = ("width", "pivot", "shard", "ids", "vectors", "query_ids", "tags", "query_vectors", "least")
    return met.select(*columns).mapInArrow(run, "query_id long, tag long, vec_id long, score long, computed long")


#: Stands for no score yet.
NONE = -(2**63)


def smallest_hashes(rows: DataFrame, most: dict[int, int], n: dict[int, int]) -> DataFrame:
    """(width, place, v): of each width the most[width] rows with the smallest hashes of their ids, numbered.

    Only rows under a bound of the hash are sorted, about four times as many as are asked for whatever the number of rows; the bound is raised as long as it leaves too few.
    """
    rows = rows.withColumn("hash", F.xxhash64("id"))
    share = {w: min(1.0, 4 * most[w] / n[w]) for w in most}
    of = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for w, v in values.items() for x in (w, v)]), F.col("width"))
    while share:
        under = rows.where(F.col("hash").cast("double") / 2.0**64 + 0.5 <= of({w: float(s) for w, s in share.items()}))
        found = {r["width"]: r["n"] for r in under.groupBy("width").agg(F.count("*").alias("n")).collect()}  # one row for each width
        if all(found.get(w, 0) >= min(most[w], n[w]) for w in most):
            place = F.row_number().over(Window.partitionBy("width").orderBy("hash", "id", "v"))
            return under.withColumn("place", place).where(F.col("place") <= of(most)).select("width", "place", "v")
        share = {w: min(1.0, 4 * s) for w, s in share.items()}
    return rows.select("width", F.lit(0).alias("place"), "v").limit(0)


def search_all(table: DataFrame, queries: F.Column, k: int, id_column: str, vector_column: str, scale: int, shard: int, block: int, pivots: int) -> DataFrame:
    """A table of all that the searches of top_k find: (query_id, tag, vec_id, score, computed), rows without vec_id saying how many distances a search computed. tag tells vectors of
    one query id apart; equal ones are asked once."""
    width = lambda df: df.withColumn("width", F.size("v"))
    rows, wanted = (width(integers(t, id_column, vector_column, scale)) for t in (table, table.where(queries)))
    wanted = wanted.dropDuplicates(["id", "v"])
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    about = rows.groupBy("width").agg(F.count("*").alias("n"), F.max(square).alias("norm")).collect()  # one row for each length of vectors
    norm = max((r["norm"] for r in about), default=0.0)
    # the pivots are the rows with the smallest hashes: as many as there are shards, and never more than pivots
    few = {r["width"]: min(pivots, max(1, -(-r["n"] // shard))) for r in about}
    chosen = smallest_hashes(rows, few, {r["width"]: r["n"] for r in about}).collect()
    points = {w: on_sphere(np.array([r["v"] for r in chosen if r["width"] == w and r["place"] <= n], np.int64).reshape(-1, w), norm) for w, n in few.items()}
    dealt = written(nearest_pivot(rows, points, norm), "dealt")
    sizes = written(dealt.groupBy("width", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")), "pivots")
    placed = dealt.join(F.broadcast(sizes.select("width", "pivot", F.ceil(F.col("n") / shard).alias("parts"))), ["width", "pivot"]).withColumn("shard", F.pmod(F.xxhash64("id", "v"), "parts"))
    shards = written(packed(placed, ["width", "pivot", "shard"], {"id": "ids", "v": "vectors"}), "shards")
    home = nearest_pivot(wanted, points, norm).withColumn("tag", F.xxhash64("v")).withColumn("least", F.lit(NONE)).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-wanted.count() // block)))))
    fields = {"id": "query_ids", "tag": "tags", "v": "query_vectors", "least": "least"}
    first = written(searched(shards.where("shard = 0"), packed(home, ["width", "pivot", "block"], fields), ["width", "pivot"], k, norm), "first")
    # a query that has k scores already looks only for those that are as good
    best = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    bounds = first.where("vec_id is not null").withColumn("rank", best).where(F.col("rank") == k).groupBy("query_id", "tag").agg(F.max("score").alias("least"))
    radii = {w: np.full(len(p), -1.0) for w, p in points.items()}
    for r in sizes.collect():  # one row for each pivot
        radii[r["width"]][r["pivot"]] = r["radius"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for w, v, least in zip(batch.column("width").to_pylist(), batch.column("v").to_pylist(), batch.column("least").to_pylist()):
                q = np.append(np.array(v, np.float64), 0.0)
                size = float((q**2).sum()) + norm
                worst = np.inf if least == NONE else max(0.0, size - 2 * least + SLACK * (size + abs(least))) ** 0.5
                may = (distances(points[w], q) - radii[w] <= worst + SLACK**0.5 * size**0.5 * 1e-3) & (radii[w] >= 0)
                lists.append(np.flatnonzero(may).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "pivots"])

    rest = home.select("id", "tag", "v", "width", F.col("pivot").alias("home"), "block").join(bounds.withColumnRenamed("query_id", "id"), ["id", "tag"], "left")
    rest = rest.withColumn("least", F.coalesce("least", F.lit(NONE)))
    rest = rest.mapInArrow(near, "id long, tag long, v array<long>, width int, home long, block long, least long, pivots array<long>").withColumn("pivot", F.explode("pivots"))
    asked = packed(rest.withColumn("at_home", F.col("pivot") == F.col("home")), ["width", "pivot", "block", "at_home"], fields)
    others = searched(shards, asked.where("not at_home"), ["width", "pivot"], k, norm)
    return first.unionByName(others).unionByName(searched(shards.where("shard > 0"), asked.where("at_home"), ["width", "pivot"], k, norm))


def top_k(table: DataFrame, queries: F.Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024, shard: int = SHARD, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product for each row that queries selects, its own id left out.

    Ties go to the smaller id; a row that is there several times is a candidate as often, and so its id repeats in the result. A query that is there several times is answered
    once; vectors of one query id that differ are answered each, with ranks of their own. Only vectors of one length are compared. An empty table, or one without
    queries, gives no rows. Rows without an id take no part.
    """
    found = search_all(table, queries, k, id_column, vector_column, scale, shard, block, pivots).where("vec_id is not null")
    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

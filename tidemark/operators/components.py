"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*edges.columns))).first())


def components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, component) for every node of edges (keys, a, b), nodes being longs; a component is named by its smallest node. Edges of different keys are graphs of their own,
    all of which take the same rounds.

    Alternating large-star and small-star steps. Neighbours' minima are partial aggregates and joins, so that no node's neighbours meet in one
    group. Every round is written, and the rounds end when one changes nothing. No edges: no rows.
    """
    at = [*keys, "a"]
    edges = written(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*at).agg(F.min("b").alias("m")).select(*at, F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, at).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy(*at).agg(F.min("b").alias("m"))
        pairs = large.join(smallest, at)
        small = pairs.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(smallest.select(*at, F.col("m").alias("b"))).distinct()
        edges = written(small, "edges")
        new = _state(edges)
        if new == state:
            roots = edges.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        state = new

"""Exact order statistics of large groups without gathering a group: value ranges are counted and refined until they hold one value.

Each round counts the values of every range that still matters in BUCKETS parts (of which the ends hold one value each), and keeps of each only the part that holds
the wanted rank. Counts are partial aggregates, so what is shuffled is groups times parts, however many values there are and
however they are spread over groups. Ends of parts are values that occur, so a round always leaves fewer different values,
and rounds end when a part holds a single one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

BUCKETS = 1024


def at_ranks(values: DataFrame, keys: tuple[str, ...], column: str, ranks: Column, buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, rank, value): the values at these ranks (an array of numbers from 1, made of the group's size n) of each group.

    Null and NaN values are no values; a group without values gives no row. Null keys are a group. values is read once for
    each round; give a written table if making it is dear.
    """
    found = values.select(*keys, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    whole = found.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    open_ = whole.withColumn("rank", F.explode(F.array_distinct(ranks))).withColumn("below", F.lit(0).cast("long"))
    open_ = written(open_.select(*keys, "n", F.col("rank").cast("long").alias("rank"), "lo", "hi", "below"), "ranges")
    done = None
    while True:
        closed = open_.where("lo = hi").select(*keys, "n", "rank", F.col("lo").alias("value"))
        done = closed if done is None else done.unionByName(closed)
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            return done
        open_ = written(_refined(found, open_, keys, buckets), "ranges")


def _refined(found: DataFrame, open_: DataFrame, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """The part of each range that holds its rank."""
    same = [found[k].eqNullSafe(open_[k]) for k in keys]
    rows = found.join(open_, same + [found["x"].between(open_["lo"], open_["hi"])]) if keys else found.join(F.broadcast(open_), found["x"].between(open_["lo"], open_["hi"]))
    rows = rows.select(*[open_[k] for k in keys], "n", "rank", "below", "lo", "hi", "x")
    share = F.try_divide(F.col("x") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that no difference is infinite
    inner = F.least(F.lit(buckets - 2), F.greatest(F.lit(1), F.lit(1) + F.floor(F.coalesce(share, F.lit(0.0)) * (buckets - 2)))).cast("int")
    part = F.when(F.col("x") <= F.col("lo"), 0).when(F.col("x") >= F.col("hi"), buckets - 1).otherwise(inner)
    counts = rows.groupBy(*keys, "n", "rank", "below", part.alias("part")).agg(F.count("*").alias("held"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # a window holds the parts of one range
    before = F.sum("held").over(Window.partitionBy(*keys, "rank").orderBy("part"))
    counts = counts.withColumn("upto", F.col("below") + before).withColumn("below", F.col("upto") - F.col("held"))
    return counts.where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select(*keys, "n", "rank", "lo", "hi", "below")


def medians(values: DataFrame, keys: tuple[str, ...], column: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys, median): of an even number of values the mean of the middle two."""
    n = F.col("n")
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    rows = at_ranks(values, keys, column, F.array(low, high), buckets)
    return rows.groupBy(*keys).agg((F.min("value") / 2 + F.max("value") / 2).alias("median"))


def discrete(values: DataFrame, keys: tuple[str, ...], column: str, shares: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """(keys, and a column for each share): the smallest value that this share of the group's values do not exceed."""
    # ceil of n * share in whole thousandths, so that a product such as 0.95 * 20 is not rounded up
    rank = {name: F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * round(share * 1000) / 1000 - 1e-9)) for name, share in shares.items()}
    rows = at_ranks(values, keys, column, F.array(*rank.values()), buckets)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("rank") == r, F.col("value"))).alias(name) for name, r in rank.items()])

"""Greedy choices as rounds of aggregates: every pick is the best row of one distributed max_by or min_by.

What a pick depends on beside the rows is what has been picked so far. That is bounded by how many rows are asked for, so it is kept on the
driver and goes into the next round's score as literals; the rows themselves are never gathered.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: What a swap may keep, and what it keeps at best.
MATCHED = ("season", "coastal", "member_class", "footprint", "compact")
BALANCED = ("coastal", "member_class", "footprint")
_NONE = "\x00"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(_NONE))


def _plain(v) -> str:
    return _NONE if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _times(c: str, picked: list[Row]) -> Column:
    """How often the row's value of c was picked."""
    seen = Counter(_plain(r[c]) for r in picked)
    if not seen:
        return F.lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in seen.items() for x in kv]), _text(c)), F.lit(0))


def _least(rows: DataFrame, *score: Column) -> Row | None:
    """The row with the smallest score; null if there is none."""
    return rows.agg(F.min_by(F.struct(*rows.columns), F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])).alias("r")).first()["r"]


def _left(rows: DataFrame, picked: list[Row]) -> DataFrame:
    return rows.where(~F.col("id").isin([r["id"] for r in picked])) if picked else rows


def nested_subsets(chosen: DataFrame, sizes: list[int], first: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(id, pick, in_n for each size): rows picked one by one, ids of first before all others, then from the year, region and state that have fewest so
    far, ties by rank and id. Picks up to n are the subset of n, so that a smaller one is part of a larger.

    chosen: id (of one row each), year, region, state, selection_rank. A pick depends on the dimensions and the rank alone, so per combination
    only as many rows as the largest size are looked at.
    """
    most = max(sizes)
    place = F.row_number().over(Window.partitionBy("year", "region", "state").orderBy("selection_rank", "id"))
    few = chosen.select("id", "year", "region", "state", "selection_rank").withColumn("place", place)
    few = written(few.where((F.col("place") <= most) | F.col("id").isin(list(first))).drop("place"), "few")
    early = {r["id"]: r for r in few.where(F.col("id").isin(list(first))).collect()} if first else {}
    picked = [early[i] for i in dict.fromkeys(first) if i in early][:most]
    while len(picked) < most:
        best = _least(_left(few, picked), *[_times(c, picked) for c in ("year", "region", "state")], F.col("selection_rank"), F.col("id"))
        if best is None:
            break
        picked.append(best)
    out = chosen.sparkSession.createDataFrame([(r["id"], k + 1) for k, r in enumerate(picked)], "id string, pick int")
    return out.withColumns({f"in_{n}": F.col("pick") <= n for n in sizes})


def mini_set(chosen: DataFrame, home: str, n: int = 5) -> DataFrame:
    """(id, pick): the first row of the home state, then one by one those that bring most of a new year, state and member class, ties to the lowest rank
    and id; no row without one of the home state. chosen: a sample of id (of one row each), year, state, member_class, selection_rank; per combination of these only the first n by rank are looked at."""
    dims = ("year", "state", "member_class")
    place = F.row_number().over(Window.partitionBy(*dims).orderBy("selection_rank", "id"))
    few = chosen.select("id", *dims, "selection_rank").withColumn("place", place).where(F.col("place") <= n).drop("place")
    few = written(few, "few")
    best = _least(few.where(F.col("state") == home), F.col("selection_rank"), F.col("id"))
    picked = [] if best is None else [best]
    while picked and len(picked) < n:
        known = sum((F.least(_times(c, picked), F.lit(1)) for c in dims), F.lit(0))
        best = _least(_left(few, picked), known, F.col("selection_rank"), F.col("id"))
        if best is None:
            break
        picked.append(best)
    return chosen.sparkSession.createDataFrame([(r["id"], k + 1) for k, r in enumerate(picked)], "id string, pick int")


SWAPS = "step int, required_state string, added_id string, removed_id string, matched string, problem string"


def with_required_states(sample: DataFrame, candidates: DataFrame, required: list[str], least: int = 1, gladly: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """The swaps that bring every required state into the sample at least so often: (step, required_state, added_id, removed_id, matched, problem).

    sample: the chosen; candidates: all; both with id (of one row each), year, state, h (a seeded hash) and the columns of MATCHED. Swaps are made one after
    another, for states as listed, each within a year and never at the cost of a required state. The best swap has, in this order: a compact newcomer if the
    state has none; the same coast, member class and footprint; years, seasons and classes that the state lacks; most that matches; most rows of the state
    that loses one; a state given up gladly (first of all the last listed); the largest hashes, then ids. A state for which no swap is left is an error, or with
    strict=False a row with a problem (few_candidates: there are fewer in all than asked for; no_swap: none that keeps the years' numbers).
    """
    columns = ["id", "year", "state", "h", *MATCHED]
    place = F.row_number().over(Window.partitionBy("state", "year", *MATCHED).orderBy(F.desc("h"), F.desc("id")))
    offered = candidates.where(F.col("state").isin(required))
    enough = {r["state"]: r["n"] for r in offered.groupBy("state").agg(F.count("*").alias("n")).collect()}  # required states only
    # a swap's score depends on the newcomer by its classes and hash, so of each class no more than can be asked for
    new = offered.join(sample.select("id"), "id", "left_anti").withColumn("place", place).where(F.col("place") <= least * len(required))
    new, old = written(new.select(*columns), "newcomers"), written(sample.select(*columns), "sample")
    out: list[tuple] = []
    gained: list[str] = []
    lost: list[str] = []
    for state in required:
        while True:
            there = old.where(~F.col("id").isin(lost)) if lost else old
            there = there.unionByName(new.where(F.col("id").isin(gained))) if gained else there
            have = there.where(F.col("state") == state).take(least)
            if len(have) >= least:
                break
            best = None if enough.get(state, 0) < least else _best_swap(new.where((F.col("state") == state) & ~F.col("id").isin(["", *gained])), there.where(~F.col("state").isin(required)), there, have, gladly)
            if best is None:
                out.append((len(out) + 1, state, None, None, None, "no_swap" if enough.get(state, 0) >= least else "few_candidates"))
                break
            out.append((len(out) + 1, state, best["new_id"], best["old_id"], best["matched"], None))
            gained.append(best["new_id"])
            lost.append(best["old_id"])
    if strict and (bad := [r for r in out if r[-1]]):
        raise ValueError("required states cannot be had: " + ", ".join(f"{r[1]} ({r[-1]})" for r in bad))
    return sample.sparkSession.createDataFrame(out, SWAPS)


def _best_swap(new: DataFrame, removable: DataFrame, there: DataFrame, have: list[Row], gladly: tuple[str, ...]) -> Row | None:
    """have: what the state has so far, fewer rows than are asked for."""
    often = there.groupBy("state").agg(F.count("*").alias("often"))
    prefix = lambda df, p, keep=(): df.select(*[F.col(c).alias(c if c in keep else f"{p}_{c}") for c in df.columns])
    pairs = prefix(new, "new", ("year",)).join(prefix(removable.join(often, "state"), "old", ("year",)), "year")
    same = lambda c: F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    count = lambda conditions: sum((c.cast("int") for c in conditions), F.lit(0))
    compact = F.lit(any(r["compact"] == "compact" for r in have)) | F.coalesce(F.col("new_compact") == "compact", F.lit(False))
    balanced = count(same(c) for c in BALANCED) == len(BALANCED)
    fresh = count(~F.col(n).eqNullSafe(F.lit(r[c])) for r in have for n, c in (("year", "year"), ("new_season", "season"), ("new_member_class", "member_class")))
    given = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in gladly]), F.col("old_state").cast("string")), F.lit(0)) if gladly else F.lit(0)
    matched = F.concat_ws(";", *[F.when(same(c), c) for c in MATCHED])
    score = (compact, balanced, fresh, count(same(c) for c in MATCHED), F.col("old_often"), given, F.col("new_h"), F.col("old_h"), F.col("new_id"), F.col("old_id"))
    rows = pairs.select(F.struct("new_id", "old_id", matched.alias("matched")).alias("swap"), F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)]).alias("score"))
    return rows.agg(F.max_by("swap", "score").alias("r")).first()["r"]

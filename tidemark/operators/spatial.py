"""Footprints, boundaries and their overlaps. Geometry runs in Arrow batches on rows that equi-joins on grid cells have brought together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

DECODED = "geometry_type string, is_empty boolean, is_valid boolean, minx double, miny double, maxx double, maxy double, point_x double, point_y double, area_km2_shape double, is_box boolean"
#: Overlaps that differ by less, in km2, are ties.
TIE = 1e-9


def _rings(wkb, projected: bool) -> tuple[str, g.Rings] | None:
    got = g.read(wkb)
    if got and projected:
        return got[0], [np.stack(g.project(r[:, 0], r[:, 1]), axis=1) for r in got[1]]
    return got


def decode(df: DataFrame, projected: bool = False) -> DataFrame:
    """df with the kind, validity, bounds, interior point and area of its geometry (WKB), and whether it is a box along the axes; all null where that can't be decoded. Bounds and
    point are in the input's units, area in km2 of the plane. Boxes of a batch are read together, other outlines one by one."""
    fields = [f.split()[0] for f in DECODED.split(", ")]
    types = [pa.string(), pa.bool_(), pa.bool_(), *[pa.float64()] * 7, pa.bool_()]

    def one(wkb) -> tuple:
        got = g.read(wkb)
        if got is None:
            return (None,) * 11
        kind, rings = got
        rings = [r for r in rings if len(r)]
        if not rings:
            return kind, True, False, *(None,) * 6, 0.0, False
        plane = _rings(wkb, True)[1] if projected else rings
        closed = all(len(r) > 3 and (r[0] == r[-1]).all() for r in rings)
        return kind, False, closed and not g.crosses_itself(rings), *g.bounds(rings), *g.interior_point(rings), g.area(plane) / 1e6, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wkb = batch.column("geometry").to_pylist()
            which, x0, y0, x1, y1 = g.boxes(wkb)
            u0, v0, u1, v1 = (*g.project(x0, y0), *g.project(x1, y1)) if projected else (x0, y0, x1, y1)
            columns = (x0, y0, x1, y1, (x0 + x1) / 2, (y0 + y1) / 2, (u1 - u0) * (v1 - v0) / 1e6)
            if len(which) == len(wkb):
                yes = pa.array(np.ones(len(wkb), bool))
                more = [pa.array(["Polygon"] * len(wkb), pa.string()), pa.array(np.zeros(len(wkb), bool)), yes, *map(pa.array, columns), yes]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *fields])
                continue
            rows: list = [None] * len(wkb)
            for k, row in zip(which.tolist(), zip(*[c.tolist() for c in columns])):
                rows[k] = ("Polygon", False, True, *row, True)
            for k in set(range(len(wkb))).difference(which.tolist()):
                rows[k] = one(wkb[k])
            more = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *fields])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + DECODED)


def cells(df: DataFrame, size: float, around: float = 0.0) -> DataFrame:
    """A row for each grid cell that a row's bounds, widened by around, touch. Bounds without extent have one cell."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - around) / size), F.floor((F.col(hi) + around) / size))
    return df.withColumn("cell_x", F.explode(span("minx", "maxx"))).withColumn("cell_y", F.explode(span("miny", "maxy")))


def tiles(boundaries: DataFrame, size: float) -> DataFrame:
    """code, cell_x, cell_y, tile, bounds of the tile and is_box: each boundary clipped to the cells it touches, so that no overlap is computed with a whole boundary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for code, wkb, x, y in zip(*[batch.column(c).to_pylist() for c in ("code", "geometry", "cell_x", "cell_y")]):
                rings = g.clip(g.read(wkb)[1], x * size, y * size, (x + 1) * size, (y + 1) * size)
                if rings:
                    tile = g.write_polygon(rings)
                    box = g.boxes([tile])
                    out.append((code, x, y, tile, *(g.bounds(rings)), len(box[0]) == 1))
            columns = list(zip(*out)) if out else [()] * 9
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.float64()] * 4, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["code", "cell_x", "cell_y", "tile", "tile_minx", "tile_miny", "tile_maxx", "tile_maxy", "tile_is_box"])

    found = cells(decode(boundaries.select(F.col("code").cast("string").alias("code"), "geometry")), size).select("code", "geometry", "cell_x", "cell_y")
    return found.mapInArrow(run, "code string, cell_x long, cell_y long, tile binary, tile_minx double, tile_miny double, tile_maxx double, tile_maxy double, tile_is_box boolean")


def overlaps(events: DataFrame, tiled: DataFrame, size: float) -> DataFrame:
    """event_id, code, overlap_km2, point_inside of every footprint and boundary that share a point. Footprints: event_id, geometry and decoded columns.

    A box and a box share what their bounds share, which is an expression; only pairs with another outline go through the kernel.
    """
    names = ["event_id", "geometry", "minx", "miny", "maxx", "maxy", "point_x", "point_y", "is_box"]
    pairs = cells(events.select(*names), size).join(tiled, ["cell_x", "cell_y"])
    boxes = F.col("is_box") & F.col("tile_is_box")
    wide = F.least("maxx", "tile_maxx") - F.greatest("minx", "tile_minx")
    high = F.least("maxy", "tile_maxy") - F.greatest("miny", "tile_miny")
    inside = F.col("point_x").between(F.col("tile_minx"), F.col("tile_maxx")) & F.col("point_y").between(F.col("tile_miny"), F.col("tile_maxy"))
    plain = pairs.where(boxes & (wide >= 0) & (high >= 0)).select("event_id", "code", (wide * high).alias("m2"), inside.alias("point_inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for event, code, wkb, tile, x, y in zip(*[batch.column(c).to_pylist() for c in ("event_id", "code", "geometry", "tile", "point_x", "point_y")]):
                a, b = g.read(wkb)[1], g.read(tile)[1]
                shared = g.overlap(a, b)
                if g.contact(a, b, shared):
                    e = g.edges(b)
                    heights = (y,) if y not in e[:, 1] else (y - 1e-6, y + 1e-6)  # the border counts as inside
                    out.append((event, code, shared, any(lo <= x <= hi for h in heights for lo, hi in g.intervals(e, h))))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.bool_()))], ["event_id", "code", "m2", "point_inside"])

    other = pairs.where(~boxes & (wide >= 0) & (high >= 0)).mapInArrow(run, "event_id long, code string, m2 double, point_inside boolean")
    return plain.unionByName(other).groupBy("event_id", "code").agg((F.sum("m2") / 1e6).alias("overlap_km2"), F.bool_or("point_inside").alias("point_inside"))


def _larger_first() -> list:
    """Overlaps are sums in some order; they are compared as far as they are exact."""
    return [F.desc(F.round("overlap_km2", 9)), F.col("code")]


def ranked(found: DataFrame, events: DataFrame, union: DataFrame | None = None) -> DataFrame:
    """Overlaps with their share of the event's area and of what the event shares with all boundaries together, their rank (largest first, ties by code) and whether they are the first.

    union: (event_id, union_km2), as union_overlap gives it, for boundaries that overlap each other; without it their overlaps are added up, which is the same where they do not.
    """
    w = Window.partitionBy("event_id")
    out = found.join(events.select("event_id", "area_km2_shape"), "event_id").withColumn("assignment_rank", F.row_number().over(w.orderBy(*_larger_first())))
    if union is not None:
        out = out.join(union.select("event_id", "union_km2"), "event_id", "left")
    whole = F.sum("overlap_km2").over(w) if union is None else F.col("union_km2")
    some = F.col("overlap_km2") > 0
    out = out.withColumn("event_fraction", F.when((F.col("area_km2_shape") > 0) & some, F.col("overlap_km2") / F.col("area_km2_shape")))
    return out.withColumn("union_fraction", F.when(some, F.try_divide(F.col("overlap_km2"), whole))).withColumn("is_primary", F.col("assignment_rank") == 1).drop("area_km2_shape", "union_km2")


def primary(found: DataFrame, events: DataFrame, tie: float = TIE) -> DataFrame:
    """One row for each event: its primary code, how it was found, and whether that needs review: the only boundary its point is in, its only match, the first of a tie (to
    review), or the largest overlap (to review if its point is in several). No match: null."""
    rows = found.withColumn("most", F.max("overlap_km2").over(Window.partitionBy("event_id")))
    order = F.struct(-F.round("overlap_km2", 9), "code")
    by = rows.groupBy("event_id").agg(
        F.count("*").alias("candidates"), F.sum(F.col("point_inside").cast("long")).alias("inside"), F.sum((F.col("most") - F.col("overlap_km2") <= tie).cast("long")).alias("tied"),
        F.min_by("code", F.struct(~F.col("point_inside"), "code")).alias("covering"), F.min_by("code", order).alias("largest"),
    )
    method = F.when(F.col("candidates").isNull(), "none").when(F.col("inside") == 1, "point").when(F.col("candidates") == 1, "single").when(F.col("tied") > 1, "manual_review").otherwise("largest_overlap")
    out = events.select("event_id").join(by, "event_id", "left").withColumn("method", method)
    code = F.when(F.col("method") == "point", F.col("covering")).when(F.col("method") != "none", F.col("largest"))
    review = (F.col("method") == "manual_review") | (F.col("method") == "largest_overlap") & (F.col("inside") > 1)
    return out.select("event_id", code.alias("primary_code"), "method", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), review.alias("review"))


def union_overlap(events: DataFrame, tiled: DataFrame, size: float) -> DataFrame:
    """event_id and the area of its overlap with the union of all boundaries. Within a cell the tiles' union is what counts, so boundaries that overlap are not counted twice.

    Where tiles of a cell don't overlap each other, which one self-join of the tiles tells, the union is their sum, and boxes go by expressions; other cells go through the kernel.
    """
    # tiles are as many as boundaries have cells, whatever the number of footprints
    a, b = (tiled.select("cell_x", "cell_y", "code", *[F.col(f"tile_{c}").alias(f"{c}_{k}") for c in ("minx", "miny", "maxx", "maxy")]) for k in "ab")
    meet = (F.col("a.code") < F.col("b.code")) & (F.least("maxx_a", "maxx_b") > F.greatest("minx_a", "minx_b")) & (F.least("maxy_a", "maxy_b") > F.greatest("miny_a", "miny_b"))
    on = (F.col("a.cell_x") == F.col("b.cell_x")) & (F.col("a.cell_y") == F.col("b.cell_y")) & meet
    mixed = a.alias("a").join(b.alias("b"), on).select(F.col("a.cell_x").alias("cell_x"), F.col("a.cell_y").alias("cell_y"))
    mixed = mixed.unionByName(tiled.where(~F.col("tile_is_box")).select("cell_x", "cell_y")).distinct()
    names = ["event_id", "geometry", "minx", "miny", "maxx", "maxy", "is_box"]
    dealt = cells(events.select(*names), size).join(mixed.withColumn("mixed", F.lit(True)), ["cell_x", "cell_y"], "left")
    kernel = F.coalesce(F.col("mixed"), F.lit(False)) | ~F.col("is_box")
    wide = F.least("maxx", "tile_maxx") - F.greatest("minx", "tile_minx")
    high = F.least("maxy", "tile_maxy") - F.greatest("miny", "tile_miny")
    plain = dealt.where(~kernel).join(tiled, ["cell_x", "cell_y"]).select("event_id", (F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))).alias("m2"))
    per_cell = tiled.groupBy("cell_x", "cell_y").agg(F.collect_list("tile").alias("tile_list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, areas = [], []
            for event, wkb, cx, cy, parts in zip(*[batch.column(c).to_pylist() for c in ("event_id", "geometry", "cell_x", "cell_y", "tile_list")]):
                a = g.clip(g.read(wkb)[1], cx * size, cy * size, (cx + 1) * size, (cy + 1) * size)
                shapes = [g.read(t)[1] for t in parts]
                ids.append(event)
                areas.append(g.area(a) + g.union_area(shapes) - g.union_area([a, *shapes]) if a else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(areas, pa.float64())], ["event_id", "m2"])

    other = dealt.where(kernel).join(per_cell, ["cell_x", "cell_y"]).select("event_id", "geometry", "cell_x", "cell_y", "tile_list").mapInArrow(run, "event_id long, m2 double")
    return plain.unionByName(other).groupBy("event_id").agg((F.sum("m2") / 1e6).alias("union_km2"))


def assignment_counters(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("method").agg(F.count("*").alias("events"), F.sum((F.col("candidates") > 1).cast("long")).alias("several"))

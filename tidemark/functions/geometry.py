"""Planar geometry on WKB without a geometry library: rings of straight edges, even-odd fill.

Areas of overlaps and unions come from slabs: between neighbouring heights of vertices and edge crossings no edges cross, so
an interval's width at a slab's middle times the slab's height is exact.
"""

from __future__ import annotations

import math
import struct

import numpy as np

#: Fixed values of the equal-area projection: WGS 84 axis and eccentricity, true scale at 30 degrees.
_AXIS, _E = 6378137.0, 0.0818191908426215
_K0 = math.cos(math.radians(30)) / math.sqrt(1 - _E**2 * math.sin(math.radians(30)) ** 2)

Rings = list[np.ndarray]


def project(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees to metres on the cylindrical equal-area plane; monotone in each, so boxes stay boxes."""
    s = np.sin(np.radians(lat))
    q = (1 - _E**2) * (s / (1 - _E**2 * s**2) - np.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return _AXIS * _K0 * np.radians(lon), _AXIS * q / (2 * _K0)


def write_polygon(rings: Rings) -> bytes:
    parts = [struct.pack("<BII", 1, 3, len(rings))]
    for r in rings:
        parts += [struct.pack("<I", len(r)), np.ascontiguousarray(r, "<f8").tobytes()]
    return b"".join(parts)


def box(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return write_polygon([np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])])


def box_column(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[bytes, int]:
    """The WKB of many boxes one after another, and how many bytes each has."""
    rows = np.zeros(len(x0), [("header", "S13"), ("ring", "<f8", (5, 2))])
    rows["header"] = struct.pack("<BIII", 1, 3, 1, 5)
    for k, corner in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))):
        rows["ring"][:, k, 0], rows["ring"][:, k, 1] = corner
    return rows.tobytes(), rows.itemsize


def read(wkb: bytes | None) -> tuple[str, Rings] | None:
    """(type, rings) of a polygon or multipolygon; None where it can't be decoded or is of another type."""
    try:
        kind, rings, _ = _read(wkb, 0)
        return (kind, rings) if kind else None
    except (struct.error, ValueError, TypeError, IndexError):
        return None


def boxes(wkb: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Which of some geometries are polygons of one ring that is a box along the axes with some extent, and their bounds x0, y0, x1, y1."""
    header = struct.pack("<BIII", 1, 3, 1, 5)
    at = np.array([k for k, w in enumerate(wkb) if w is not None and len(w) == 93 and w[:13] == header], np.int64)
    ring = np.frombuffer(b"".join(wkb[k][13:] for k in at), "<f8").reshape(-1, 5, 2)
    x, y = ring[..., 0], ring[..., 1]
    fine = np.isfinite(ring).all(axis=(1, 2)) & (ring[:, 0] == ring[:, 4]).all(axis=1)
    turned = (x[:, 0] == x[:, 1]) & (y[:, 1] == y[:, 2]) & (x[:, 2] == x[:, 3]) & (y[:, 3] == y[:, 0])
    level = (y[:, 0] == y[:, 1]) & (x[:, 1] == x[:, 2]) & (y[:, 2] == y[:, 3]) & (x[:, 3] == x[:, 0])
    fine &= (turned | level) & (x[:, 0] != x[:, 2]) & (y[:, 0] != y[:, 2])
    return at[fine], *(np.array(f(c[fine, :4], axis=1)) for f, c in ((np.min, x), (np.min, y), (np.max, x), (np.max, y)))


def _read(data: bytes, at: int) -> tuple[str | None, Rings, int]:
    order = {0: ">", 1: "<"}[data[at]] if data[at] in (0, 1) else "?"
    if order == "?":
        raise ValueError("byte order")
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    n = struct.unpack_from(order + "I", data, at + 5)[0]
    at += 9
    rings: Rings = []
    if kind == 3:
        for _ in range(n):
            m = struct.unpack_from(order + "I", data, at)[0]
            ring = np.frombuffer(data, order + "f8", 2 * m, at + 4).reshape(m, 2).astype(float)
            rings.append(ring)
            at += 4 + 16 * m
        return "Polygon", rings, at
    if kind == 6:
        for _ in range(n):
            _, more, at = _read(data, at)
            rings += more
        return "MultiPolygon", rings, at
    return None, [], at


def edges(rings: Rings) -> np.ndarray:
    """(x0, y0, x1, y1) of all edges."""
    parts = [np.hstack([r[:-1], r[1:]]) for r in rings if len(r) > 1]
    return np.vstack(parts) if parts else np.zeros((0, 4))


def crossing_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of a and b cross."""
    if not len(a) or not len(b):
        return np.zeros(0)
    p, r = a[:, None, :2], a[:, None, 2:] - a[:, None, :2]
    q, s = b[None, :, :2], b[None, :, 2:] - b[None, :, :2]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    d = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / cross
        u = (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / cross
        hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return (p[..., 1] + t * r[..., 1])[hit]


def intervals(e: np.ndarray, y: float) -> list[tuple[float, float]]:
    """Filled x intervals at a height that no vertex has."""
    on = e[(e[:, 1] > y) != (e[:, 3] > y)]
    x = np.sort(on[:, 0] + (y - on[:, 1]) / (on[:, 3] - on[:, 1]) * (on[:, 2] - on[:, 0]))
    return list(zip(x[::2].tolist(), x[1::2].tolist()))


def slabs(shapes: list[np.ndarray]) -> list[tuple[float, float]]:
    """(middle, height) of slabs that no crossing divides."""
    everything = np.vstack(shapes)
    ys = np.unique(np.concatenate([everything[:, 1], everything[:, 3], crossing_heights(everything, everything)]))
    return [((lo + hi) / 2, hi - lo) for lo, hi in zip(ys[:-1].tolist(), ys[1:].tolist()) if hi > lo]


def area(rings: Rings) -> float:
    e = edges(rings)
    return sum(h * sum(b - a for a, b in intervals(e, y)) for y, h in slabs([e])) if len(e) else 0.0


def overlap(a: Rings, b: Rings) -> float:
    """Area of the intersection."""
    ea, eb = edges(a), edges(b)
    if not len(ea) or not len(eb) or not boxes_meet(a, b):
        return 0.0
    total = 0.0
    for y, h in slabs([ea, eb]):
        other = intervals(eb, y)
        total += h * sum(max(0.0, min(x1, z1) - max(x0, z0)) for x0, x1 in intervals(ea, y) for z0, z1 in other)
    return total


def union_area(shapes: list[Rings]) -> float:
    """Area of the union of any number of shapes."""
    es = [e for e in map(edges, shapes) if len(e)]
    if not es:
        return 0.0
    total = 0.0
    for y, h in slabs(es):
        reach = -math.inf
        for x0, x1 in sorted(i for e in es for i in intervals(e, y)):
            total += h * max(0.0, x1 - max(x0, reach))
            reach = max(reach, x1)
    return total


def union_of_boxes(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> float:
    """Area of the union of boxes: slab by slab, the merged intervals of the boxes that reach through it."""
    order = np.argsort(x0, kind="stable")
    x0, y0, x1, y1 = x0[order], y0[order], x1[order], y1[order]
    heights = np.unique(np.concatenate([y0, y1]))
    total = 0.0
    for lo, hi in zip(heights[:-1], heights[1:]):
        on = (y0 <= lo) & (y1 >= hi)
        if on.any():
            left, right = x0[on], x1[on]
            reach = np.maximum.accumulate(right)
            before = np.concatenate([[-np.inf], reach[:-1]])
            total += (hi - lo) * float(np.maximum(0.0, right - np.maximum(left, before)).sum())
    return total


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, one row each."""
    points = np.unique(np.stack([x, y], axis=1), axis=0)
    if len(points) < 3:
        return points

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    rows = points.tolist()
    return np.array(half(rows) + half(rows[::-1])).reshape(-1, 2)


def bounds(rings: Rings) -> tuple[float, float, float, float]:
    every = np.vstack(rings)
    return (*every.min(axis=0).tolist(), *every.max(axis=0).tolist())


def boxes_meet(a: Rings, b: Rings) -> bool:
    p, q = bounds(a), bounds(b)
    return p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]


def contact(a: Rings, b: Rings, area_of_overlap: float) -> bool:
    """Whether the closed shapes share a point: some area, or edges that meet."""
    if area_of_overlap > 0:
        return True
    if not a or not b or not boxes_meet(a, b):
        return False
    ea, eb = edges(a), edges(b)
    if len(crossing_heights(ea, eb)):
        return True
    for e in eb:  # parallel edges that overlap
        r, s = ea[:, 2:] - ea[:, :2], e[2:] - e[:2]
        flat = np.abs(r[:, 0] * s[1] - r[:, 1] * s[0]) == 0
        d = e[:2] - ea[:, :2]
        line = flat & (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0] == 0)
        lo, hi = np.minimum(ea[:, :2], ea[:, 2:]), np.maximum(ea[:, :2], ea[:, 2:])
        if (line & (np.minimum(e[:2], e[2:]) <= hi).all(axis=1) & (lo <= np.maximum(e[:2], e[2:])).all(axis=1)).any():
            return True
    return False


def interior_point(rings: Rings) -> tuple[float, float]:
    """Middle of the widest interval at middle height, or at a slab's middle if a vertex is there."""
    e = edges(rings)
    x0, y0, x1, y1 = bounds(rings)
    y = (y0 + y1) / 2
    if np.isin(y, e[:, 1]) or not intervals(e, y):
        y = min((m for m, _ in slabs([e])), key=lambda m: abs(m - y), default=y)
    found = intervals(e, y)
    if not found:
        return (x0 + x1) / 2, y
    a, b = max(found, key=lambda i: i[1] - i[0])
    return (a + b) / 2, y


def crosses_itself(rings: Rings) -> bool:
    """Whether edges of the shape cross other than at shared ends."""
    e = edges(rings)
    for i in range(len(e)):
        others = np.delete(e, i, axis=0)
        apart = ~((others[:, :2] == e[i, :2]).all(1) | (others[:, :2] == e[i, 2:]).all(1) | (others[:, 2:] == e[i, :2]).all(1) | (others[:, 2:] == e[i, 2:]).all(1))
        if len(crossing_heights(e[i : i + 1], others[apart])):
            return True
    return False


def clip(rings: Rings, x0: float, y0: float, x1: float, y1: float) -> Rings:
    """The part of a shape in a box; edges along the box's sides may be added, which even-odd areas don't mind."""
    out = []
    for ring in rings:
        points = ring[:-1].tolist()
        for axis, limit, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
            new = []
            for p, q in zip(points, points[1:] + points[:1]):
                inside_p, inside_q = (p[axis] - limit) * keep >= 0, (q[axis] - limit) * keep >= 0
                if inside_p:
                    new.append(p)
                if inside_p != inside_q:
                    t = (limit - p[axis]) / (q[axis] - p[axis])
                    c = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                    c[axis] = limit
                    new.append(c)
            points = new
            if not points:
                break
        if len(points) > 2:
            out.append(np.array(points + points[:1]))
    return out

"""Overlays of polygons that return shapes: intersection, difference, union, repair, parts, strips.

As in the kernel of areas, the plane is cut at every level of a vertex or crossing. Between two
levels the edges are in order, so what belongs to the result are trapezoids; their sides, and along
each level the stretches that belong to it on one side only, are its boundary. All ends are rounded
to one grid, 2 ** -46 of the coordinates' size (15 nm in UTM), so that the boundary always closes and
shapes that were joined apart still meet.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from landmesh.functions import batches
from landmesh.functions.geometry import GEOM, _doubles, _crossings, _edges, _struct, contains, rings_of

Rings = list[np.ndarray]

RULES = {
    "intersection": lambda a, b: a > 0 and b > 0,
    "difference": lambda a, b: a > 0 and b == 0,
    "union": lambda a, b: a > 0 or b > 0,
}


def _spans(edges: list[tuple], mid: float, of_b: list[bool], rule) -> list[tuple]:
    """Pairs of edges between which the result lies at a height without crossings."""
    odd, depth, out, left = set(), [0, 0], [], None
    for _, _, edge in sorted((x1 + (mid - y1) / (y2 - y1) * (x2 - x1), i, edge) for i, edge in enumerate(edges) for x1, y1, x2, y2, _ in (edge,)):
        layer = edge[4]
        if layer in odd:
            odd.discard(layer)
            depth[of_b[layer]] -= 1
        else:
            odd.add(layer)
            depth[of_b[layer]] += 1
        inside = rule(*depth)
        if inside and left is None:
            left = edge
        elif left is not None and not inside:
            out.append((left, edge))
            left = None
    return out


def _level_segments(below: list[tuple], above: list[tuple], y: float) -> list[tuple]:
    """Boundary along a level: eastwards where only the upper side belongs, else westwards."""
    ends: dict[float, int] = {}
    for spans, sign in ((above, 1), (below, -1)):
        for left, right in spans:
            ends[left] = ends.get(left, 0) + sign
            ends[right] = ends.get(right, 0) - sign
    xs, depth, out = sorted(x for x, n in ends.items() if n), 0, []
    for x, after in zip(xs[:-1], xs[1:], strict=True):
        depth += ends[x]
        out += [((x, y), (after, y)) if depth > 0 else ((after, y), (x, y))] * abs(depth)
    return out


def _joined(segments: list[tuple], grid: float) -> list[tuple]:
    """Segments whose ends a step or two apart along a level are one point; opposite ones cancel."""
    at_level: dict[float, set] = {}
    for x, y in (p for s in segments for p in s):
        at_level.setdefault(y, set()).add(x)
    point: dict[tuple, tuple] = {}
    for y, xs in at_level.items():
        last = home = -np.inf
        for x in sorted(xs):
            home = x if x - last > 2 * grid else home
            last = x
            point[x, y] = (home, y)
    left: dict[tuple, int] = {}
    for a, b in segments:
        a, b = point[a], point[b]
        if left.get((b, a)):
            left[b, a] -= 1
        elif a != b:
            left[a, b] = left.get((a, b), 0) + 1
    return [s for s, n in left.items() for _ in range(n)]


def _rings(segments: list[tuple], grid: float) -> Rings:
    """Directed segments, interior on the left, as closed rings without points on straight lines."""
    leaving: dict[tuple, list[tuple]] = {}
    for a, b in segments:
        leaving.setdefault(a, []).append(b)
    out = []
    for start in sorted(leaving):
        while leaving[start]:
            at, ring = start, [start]
            came = None
            while True:
                options = leaving[at]
                if len(options) > 1 and came is not None:  # the sharpest turn to the left parts rings that touch
                    back = np.arctan2(came[1] - at[1], came[0] - at[0])
                    options.sort(key=lambda p: (back - np.arctan2(p[1] - at[1], p[0] - at[0])) % (2 * np.pi) or 2 * np.pi, reverse=True)
                came, at = at, options.pop()
                if at == start:
                    break
                ring.append(at)
            kept = _straightened(np.array(ring), grid)
            if kept is not None:
                out.append(kept)
    return out


def _straightened(ring: np.ndarray, grid: float) -> np.ndarray | None:
    """A ring closed again, from its least vertex on, without vertices nearer than 4 grid steps to
    the line of their neighbours; None if no area is left but rounding."""
    while len(ring) > 2:
        before, after = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
        chord = after - before
        long = np.hypot(*chord.T)
        off = np.abs(chord[:, 0] * (ring - before)[:, 1] - chord[:, 1] * (ring - before)[:, 0])
        flat = off <= 4 * grid * np.maximum(long, grid)
        flat[1:] &= ~flat[:-1]  # never two neighbours at once
        flat[-1] &= ~flat[0]
        if not flat.any():
            closed = np.concatenate([ring, ring[:1]])
            if abs(signed_area(closed)) <= 8 * grid * np.hypot(*np.diff(closed, axis=0).T).sum():
                return None
            first = np.lexsort((ring[:, 1], ring[:, 0]))[0]
            ring = np.roll(ring, -first, axis=0)
            return np.concatenate([ring, ring[:1]])
        ring = ring[~flat]
    return None


def combined(a: list[Rings], b: list[Rings], rule: str) -> Rings:
    """The shape that RULES[rule] makes of the union of shapes a and the union of shapes b.

    Each shape counts by the even-odd rule, so one that crosses itself comes out repaired. Outer
    rings turn counter-clockwise, holes clockwise.
    """
    shapes = [(s, of_b) for group, of_b in ((a, False), (b, True)) for s in group if any(len(r) > 3 for r in s)]
    if not shapes:
        return []
    layer_of_b = [of_b for _, of_b in shapes]
    points = np.concatenate([r for s, _ in shapes for r in s])
    grid = 2.0 ** (np.floor(np.log2(np.abs(points).max() or 1.0)) - 46)
    snap = lambda v: np.round(v / grid) * grid
    corner = snap(points.min(axis=0))
    parts = [_edges([snap(r) - corner for r in s]) for s, _ in shapes]
    raw = [(*v, i) for i, p in enumerate(parts) for v in p.tolist()]
    if not raw:
        return []
    every = np.unique(snap(np.array(_crossings(raw))))
    new = np.diff(every, prepend=-np.inf) > 2 * grid  # levels a step or two apart are one
    levels = every[new].tolist()
    level = dict(zip(every.tolist(), every[new][np.cumsum(new) - 1].tolist(), strict=True))
    e = sorted(((x1, level[y1], x2, level[y2], i) for x1, y1, x2, y2, i in raw), key=lambda v: v[1])
    e = [v for v in e if v[1] < v[3]]

    def x_at(v: tuple, y: float) -> float:
        x1, y1, x2, y2, _ = v
        return x1 if y <= y1 else x2 if y >= y2 else round((x1 + (y - y1) / (y2 - y1) * (x2 - x1)) / grid) * grid

    segments: list[tuple] = []
    below: list[tuple] = []
    active: list[tuple] = []
    at = 0
    for low, high in zip(levels[:-1], levels[1:], strict=True):
        active = [v for v in active if v[3] > low]
        while at < len(e) and e[at][1] <= low:
            active.append(e[at])
            at += 1
        spans = [(x_at(a, low), x_at(a, high), x_at(b, low), x_at(b, high)) for a, b in _spans(active, (low + high) / 2, layer_of_b, RULES[rule])]
        segments += _level_segments(below, [(s[0], s[2]) for s in spans], low)
        segments += [((s[1], high), (s[0], low)) for s in spans]
        segments += [((s[2], low), (s[3], high)) for s in spans]
        below = [(s[1], s[3]) for s in spans]
    segments += _level_segments(below, [], levels[-1])
    return [r + corner for r in _rings(_joined(segments, grid), grid)]


def signed_area(ring: np.ndarray) -> float:
    p = ring - ring[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def parts_of(rings: Rings) -> list[Rings]:
    """Rings made by `combined` as polygons: each outer ring with the holes right inside it."""
    outer = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    parts = [[r] for r in outer]
    for hole in (r for r in rings if signed_area(r) < 0):
        i = int(np.argmax(np.hypot(*np.diff(hole, axis=0).T)))
        m, d = (hole[i] + hole[i + 1]) / 2, hole[i + 1] - hole[i]
        m = m + np.array([-d[1], d[0]]) * 1e-7  # a little to the left of the hole's edge, where the shape is
        around = [p for p in parts if (p[0].min(axis=0) <= hole.min(axis=0)).all() and (p[0].max(axis=0) >= hole.max(axis=0)).all()]
        home = next((p for p in around if contains(p[:1], *m)), around[0] if around else None)
        if home is not None:
            home.append(hole)
    return sorted(parts, key=lambda p: tuple(p[0][0]))


#: Cosine of 30 degrees.
FACING = 0.866


def strips(a: Rings, b: Rings, widest: float, tolerance: float) -> Rings:
    """Ground between two shapes whose edges face each other at most `widest` apart.

    Each pair of edges gives the quadrilateral over their common stretch; what either shape covers
    is taken off. Edges that turn from each other by over 30 degrees do not face.
    """
    def near_edges(of: Rings, other: Rings) -> list[list[float]]:
        low, high = (f([f(r, axis=0) for r in other], axis=0) for f in (np.min, np.max))
        e = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in of])
        reach = (np.minimum(e[:, :2], e[:, 2:]) <= high + widest) & (np.maximum(e[:, :2], e[:, 2:]) >= low - widest)
        return e[reach.all(axis=1)].tolist()

    quads = []
    eb = near_edges(b, a)
    for ax, ay, bx, by in near_edges(a, b):
        long = math.hypot(bx - ax, by - ay)
        if not long:
            continue
        ux, uy = (bx - ax) / long, (by - ay) / long
        for cx, cy, fx, fy in eb:
            t0, t1 = (cx - ax) * ux + (cy - ay) * uy, (fx - ax) * ux + (fy - ay) * uy
            lo, hi = max(0.0, min(t0, t1)), min(long, max(t0, t1))
            if hi <= lo or abs(t1 - t0) < FACING * math.hypot(fx - cx, fy - cy):
                continue
            d0, d1 = (cy - ay) * ux - (cx - ax) * uy, (fy - ay) * ux - (fx - ax) * uy
            near, far = (d0 + (v - t0) / (t1 - t0) * (d1 - d0) for v in (lo, hi))
            if near * far < 0 or not tolerance < max(abs(near), abs(far)) <= widest:
                continue
            v = [(ax + t * ux - d * uy, ay + t * uy + d * ux) for t, d in ((lo, 0.0), (hi, 0.0), (hi, far), (lo, near))]
            quads.append([np.array([*v, v[0]])])
    return combined(quads, [a, b], "difference") if quads else []


# Columns. The functions are marked as not deterministic, as they are dear: the optimizer then never
# computes one twice, for a filter and for the value.


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly before shapes are computed, which takes longer than the shuffle: hot cells
    and small tables would leave the work to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def empty() -> Column:
    """A geometry of one point at the origin, of no area."""
    zero = F.array(F.lit(0.0))
    return F.struct(F.lit(0).alias("dim"), zero.alias("xs"), zero.alias("ys"), F.array(F.lit(0)).alias("offs"), *(F.lit(0.0).alias(v) for v in ("xmin", "ymin", "xmax", "ymax")))



def _pairwise(rule: str):
    @F.arrow_udf(GEOM)
    def shape(a: pa.Array, b: pa.Array) -> pa.Array:
        n = len(a)
        both = batches.joined(batches.from_arrow(a), batches.from_arrow(b))
        return _struct(GEOM, batches.to_arrow(batches.combined(both, np.tile(np.arange(n), 2), np.arange(2 * n) >= n, n, rule)))

    return shape.asNondeterministic()


#: Shapes of two geometry columns; null where nothing is left. A null geometry counts as empty.
intersection, difference, union = (_pairwise(r) for r in ("intersection", "difference", "union"))


def _union_alone(g: batches.Flat) -> batches.Flat:
    return batches.combined(g, np.arange(len(g)), np.zeros(len(g), dtype=bool), len(g), "union")


@F.arrow_udf(GEOM)
def repaired(g: pa.Array) -> pa.Array:
    """Polygons that cross themselves as the parts that the even-odd rule leaves; others as they are."""
    g = batches.from_arrow(g)
    return _struct(GEOM, batches.to_arrow(batches.either(g.dim == 2, _union_alone(g), g)))


CHECKED = StructType([*GEOM.fields, StructField("was_invalid", BooleanType()), *_doubles("area", "perimeter", "cx", "cy").fields])


def crosses(rings: Rings, rows: int = 256) -> bool:
    """Whether any two edges of a shape cross, of one ring or of two; touching is no crossing."""
    e = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings if len(r) > 1])
    e = e - np.tile(e[0, :2], 2)
    still = 1e-9 * max(1e-9, np.abs(e).max()) ** 2  # what rounding leaves of a point on a line
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    side = lambda o, v, p: v[:, None, 0] * (p[None, :, 1] - o[:, None, 1]) - v[:, None, 1] * (p[None, :, 0] - o[:, None, 0])
    for i in range(0, len(e), rows):
        o, v = a[i : i + rows], d[i : i + rows]
        s, t = side(o, v, a), side(o, v, e[:, 2:])
        u, w = side(a, d, o).T, side(a, d, o + v).T
        over = lambda p, q: (np.minimum(p, q) < -still) & (np.maximum(p, q) > still)
        if (over(s, t) & over(u, w)).any():
            return True
    return False


@F.arrow_udf(CHECKED)
def checked(g: pa.Array) -> pa.Array:
    """The fields of a valid geometry, whether it had to be repaired, and its measures.

    A shape is invalid if edges of its rings cross, or if a single ring has another area by the
    shoelace than by the even-odd rule (it runs along itself). A ring of which nothing is left
    stays as it is.
    """
    g = batches.from_arrow(g)
    m = batches.measures(g)
    rings = np.diff(g.first)
    signed = np.abs(np.bincount(g.row_of_ring, weights=batches.signed_areas(g), minlength=len(g)))
    alone = (rings == 1) & (np.abs(signed - m[:, 0]) > 1e-6 * np.maximum(m[:, 0], signed))
    bad = (g.dim == 2) & (alone | batches.crosses(g))
    at = np.flatnonzero(bad)
    if len(at):
        fixed = _union_alone(g.taken(at))
        some = np.diff(fixed.first) > 0
        m[at[some]] = batches.measures(fixed)[some]
        home = np.arange(len(g))
        home[at[some]] = len(g) + np.flatnonzero(some)
        g = batches.joined(g, fixed).taken(home)
    return _struct(CHECKED, [*batches.to_arrow(g), pa.array(bad), *map(pa.array, m.T)])


@F.arrow_udf(IntegerType())
def n_parts(g: pa.Array) -> pa.Array:
    """Polygons in a repaired or combined geometry."""
    g = batches.from_arrow(g)
    return pa.array(np.bincount(g.row_of_ring, weights=batches.signed_areas(g) > 0, minlength=len(g)).astype(np.int32))


def _with_lists(rule: str):
    """Of a geometry column and one of arrays of geometries: the former without or with those."""

    @F.arrow_udf(GEOM)
    def shape(g: pa.Array, shapes: pa.Array) -> pa.Array:
        own, (more, row) = batches.from_arrow(g), batches.from_lists(shapes)
        of_b = (np.arange(len(own) + len(more)) >= len(own)) & (rule == "difference")
        return _struct(GEOM, batches.to_arrow(batches.combined(batches.joined(own, more), np.append(np.arange(len(own)), row), of_b, len(own), rule)))

    return shape.asNondeterministic()


@F.arrow_udf(GEOM)
def _union_of(shapes: pa.Array) -> pa.Array:
    every, row = batches.from_lists(shapes)
    return _struct(GEOM, batches.to_arrow(batches.combined(every, row, np.zeros(len(row), dtype=bool), len(shapes), "union")))


def without(g: Column | str, shapes: Column | str) -> Column:
    """A geometry without all those of an array column."""
    return _with_lists("difference")(g, shapes)


def with_all(g: Column | str, shapes: Column | str) -> Column:
    """A geometry joined with all those of an array column."""
    return _with_lists("union")(g, shapes)


def strip_between(widest: float, tolerance: float):
    """A function of two geometry columns: the ground between them (see `strips`)."""

    @F.arrow_udf(GEOM)
    def strip(a: pa.Array, b: pa.Array) -> pa.Array:
        return _struct(GEOM, batches.to_arrow(batches.strips(batches.from_arrow(a), batches.from_arrow(b), widest, tolerance, FACING)))

    return strip.asNondeterministic()


def to_geojson_text(g: dict | None) -> str | None:
    """A geometry as GeoJSON text: polygons in parts, points, lines."""
    if g is None or g["xs"] is None:
        return None
    rings = rings_of(g)
    if g["dim"] == 0:
        return json.dumps({"type": "Point", "coordinates": rings[0][0].tolist()})
    if g["dim"] == 1:
        return json.dumps({"type": "LineString", "coordinates": rings[0].tolist()})
    parts = [[r.tolist() for r in p] for p in parts_of(combined([rings], [], "union"))]
    return json.dumps({"type": "Polygon", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPolygon", "coordinates": parts})


@F.pandas_udf(StringType())
def to_geojson(g: pd.DataFrame) -> pd.Series:
    return pd.Series([to_geojson_text(r) for r in g.to_dict("records")], dtype=object)


def dissolved(features: DataFrame, by: list[str], cell: float = 48.0, rounds: int = 8) -> DataFrame:
    """One shape for each value of `by`: the union of the geometries (`geom`), borders between them gone.

    Neighbours are joined first: shapes by the cell of their middle, what comes out by wider cells
    and so on, and at last by `by` alone. No task joins more than one cell's shapes, whose inner
    borders are gone before the next round. The first cells are small and double twice, so that
    few shapes stand in one row; then they grow fourfold. Rows without a polygon count as nothing.
    """
    rows = features.filter("geom.xs is not null and geom.dim = 2").select(*by, "geom")
    for i in range(rounds):
        side = cell * (2.0 ** min(i, 2)) * 4.0 ** max(0, i - 2)
        middle = lambda v: F.floor((F.col(f"geom.{v}min") + F.col(f"geom.{v}max")) / (2 * side))  # noqa: B023, E731
        rows = rows.groupBy(*by, middle("x").alias("cx"), middle("y").alias("cy")).agg(F.collect_list("geom").alias("g")).select(*by, _union_of.asNondeterministic()("g").alias("geom"))
    return rows.groupBy(*by).agg(F.collect_list("geom").alias("g")).select(*by, _union_of("g").alias("geom"))

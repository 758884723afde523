"""Overlays and measures of whole batches of geometries at once, as arrays over all rows.

The method is that of `geometry` and `shapes`, slab by slab, with rows of about as many edges side
by side. Rows of very many edges, and those whose boundary meets itself in an odd way, are left to
the functions of single rows, so that every row comes out, by one way or the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Edges of a row up to which rows go side by side, by how many places they get.
SIZES = (4, 8, 12, 16, 24, 32, 48, 64, 96)
#: Numbers in an array of all slabs and edges of some rows.
ROOM = 1 << 21
#: Vertices of the rows that are overlaid at once.
VERTICES = 100_000


@dataclass
class Flat:
    """Geometries as arrays: vertices, each ring's first one and each row's first ring (with ends)."""

    dim: np.ndarray
    x: np.ndarray
    y: np.ndarray
    ring: np.ndarray
    first: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.dim)

    @property
    def row_of_ring(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    @property
    def ring_of_vertex(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ring) - 1), np.diff(self.ring))

    def rings(self, i: int) -> list[np.ndarray]:
        """Closed rings of a row, as `geometry.rings_of`."""
        out = []
        for a, b in zip(self.ring[self.first[i] : self.first[i + 1]], self.ring[self.first[i] + 1 : self.first[i + 1] + 1], strict=True):
            p = np.stack([self.x[a:b], self.y[a:b]], axis=1)
            out.append(np.concatenate([p, p[:1]]) if len(p) and (p[0] != p[-1]).any() else p)
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, ring and (x1, y1, x2, y2) of an edge from each vertex; from the last one to the
        first, which has no length where the ring is closed."""
        to = np.arange(1, len(self.x) + 1)
        some = np.diff(self.ring) > 0
        to[self.ring[1:][some] - 1] = self.ring[:-1][some]
        ring = self.ring_of_vertex
        return self.row_of_ring[ring], ring, np.stack([self.x, self.y, self.x[to], self.y[to]], axis=1)

    def taken(self, rows: np.ndarray) -> Flat:
        n = np.diff(self.first)[rows]
        rings = _spans(self.first[rows], n)
        size = np.diff(self.ring)[rings]
        at = _spans(self.ring[rings], size)
        return Flat(self.dim[rows], self.x[at], self.y[at], _ends(size), _ends(n), self.null[rows])


def either(mask: np.ndarray, a: Flat, b: Flat) -> Flat:
    """The rows of a where the mask holds, else those of b."""
    n = np.arange(len(a))
    return joined(a, b).taken(np.where(mask, n, len(a) + n))


def joined(a: Flat, b: Flat) -> Flat:
    """The rows of a, then those of b."""
    return Flat(np.append(a.dim, b.dim), np.append(a.x, b.x), np.append(a.y, b.y), np.append(a.ring[:-1], b.ring + len(a.x)), np.append(a.first[:-1], b.first + a.first[-1]), np.append(a.null, b.null))


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of some spans."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def from_arrow(column) -> Flat:
    """A column of geometries (struct); null ones have no ring."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fields = dict(zip((f.name for f in column.type), column.flatten(), strict=True))
    long = lambda v: v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n, rings = long(fields["xs"]), long(fields["offs"])
    numbers = lambda v, kind: v.flatten().to_numpy(zero_copy_only=False).astype(kind)
    start = numbers(fields["offs"], np.int64) + np.repeat(np.cumsum(n) - n, rings)
    null = fields["xs"].is_null().to_numpy(zero_copy_only=False)
    dim = fields["dim"].fill_null(-1).to_numpy(zero_copy_only=False)
    return Flat(dim, numbers(fields["xs"], float), numbers(fields["ys"], float), np.append(start, n.sum()), _ends(rings), null)


def from_lists(column) -> tuple[Flat, np.ndarray]:
    """A column of arrays of geometries: those of all rows, and which row each is of."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return from_arrow(column.flatten()), np.repeat(np.arange(len(column)), n)


def to_arrow(g: Flat) -> list[pa.Array]:
    """The fields of GEOM; rows without a ring are null."""
    rings = np.diff(g.first)
    vertices = np.diff(g.ring[g.first])
    gone = rings == 0
    ends = lambda sizes: pa.array(_ends(sizes), pa.int32(), mask=np.append(gone, False))
    offs = (g.ring[:-1] - np.repeat(g.ring[g.first[:-1]], rings)).astype(np.int32)
    edge = {}
    some = np.flatnonzero(vertices > 0)
    for name, values in (("x", g.x), ("y", g.y)):
        for which, f in (("min", np.minimum), ("max", np.maximum)):
            out = np.zeros(len(g))
            if len(some):
                out[some] = f.reduceat(values, g.ring[g.first[:-1]][some])
            edge[name + which] = pa.array(out, mask=gone)
    return [pa.array(g.dim, pa.int32(), mask=gone), pa.ListArray.from_arrays(ends(vertices), pa.array(g.x)), pa.ListArray.from_arrays(ends(vertices), pa.array(g.y)), pa.ListArray.from_arrays(ends(rings), pa.array(offs)), *(edge[k] for k in ("xmin", "ymin", "xmax", "ymax"))]


def gathered(n: int, row: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> Flat:
    """Polygons of n rows from closed rings in any order; those of a row stay in theirs."""
    order = np.argsort(row, kind="stable")
    begin = np.cumsum(size) - size
    at = _spans(begin[order], size[order])
    rings = np.bincount(row, minlength=n)
    return Flat(np.full(n, 2, dtype=np.int32), x[at], y[at], _ends(size[order]), _ends(rings), rings == 0)


def stacked(rows: list[list[np.ndarray]]) -> Flat:
    """Polygons of rows of closed rings."""
    size = np.array([len(r) for rings in rows for r in rings], dtype=np.int64)
    p = np.concatenate([r for rings in rows for r in rings] or [np.zeros((0, 2))])
    return gathered(len(rows), np.repeat(np.arange(len(rows)), [len(rings) for rings in rows]), size, p[:, 0], p[:, 1])


def _padded(row: np.ndarray, n: int, *columns: tuple[np.ndarray, float]):
    """Rows side by side: for each of SIZES the rows of about so many entries, and their columns as
    (row, place), filled up; the rows of more come with None. Rows without entries are left out."""
    order = np.argsort(row, kind="stable")
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    least = 0
    for size in SIZES:
        every = np.flatnonzero((count > least) & (count <= size))
        least = size
        step = max(1, ROOM // (size * size * 4))
        for i in range(0, len(every), step):
            rows = every[i : i + step]
            at = begin[rows][:, None] + np.arange(size)
            there = np.arange(size) < count[rows][:, None]
            take = order[np.where(there, at, 0)]
            yield rows, [np.where(there if c.ndim == 1 else there[..., None], c[take], fill) for c, fill in columns]
    over = np.flatnonzero(count > least)
    if len(over):
        yield over, None


def _upward(e: np.ndarray) -> np.ndarray:
    """Edges with y1 < y2; level ones lie above all and reach nowhere."""
    up = np.where((e[..., 1] > e[..., 3])[..., None], e[..., [2, 3, 0, 1]], e)
    return np.where((up[..., 1] == up[..., 3])[..., None], np.array([0.0, np.inf, 0.0, np.inf]), up)


def _crossings(e: np.ndarray) -> np.ndarray:
    """(row, pair): y where two edges cross, else infinity."""
    i, j = np.triu_indices(e.shape[1], 1)
    a, b = e[:, i], e[:, j]
    with np.errstate(all="ignore"):
        d, g, q = a[..., 2:] - a[..., :2], b[..., 2:] - b[..., :2], b[..., :2] - a[..., :2]
        cross = d[..., 0] * g[..., 1] - d[..., 1] * g[..., 0]
        t = (q[..., 0] * g[..., 1] - q[..., 1] * g[..., 0]) / cross
        u = (q[..., 0] * d[..., 1] - q[..., 1] * d[..., 0]) / cross
        hit = (b[..., 1] < a[..., 3]) & (b[..., 3] > a[..., 1]) & (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        return np.where(hit, a[..., 1] + t * d[..., 1], np.inf)


def _cut(levels: np.ndarray) -> np.ndarray:
    """Sorted levels without the columns that are infinite in all rows."""
    return levels[:, : max(1, int(np.isfinite(levels).sum(axis=1).max(initial=0)))]


def _at(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return e[..., 0] + (y - e[..., 1]) / (e[..., 3] - e[..., 1]) * (e[..., 2] - e[..., 0])


def _areas(e: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """(row, 3): areas of both, of a alone, of b alone."""
    e = _upward(e)
    levels = np.sort(np.concatenate([e[..., 1], e[..., 3], _crossings(e)], axis=1), axis=1)
    levels[:, 1:][levels[:, 1:] == levels[:, :-1]] = np.inf
    levels = _cut(np.sort(levels, axis=1))
    out = np.zeros((len(e), 3))
    for s in range(levels.shape[1] - 1):
        low, high = levels[:, s], levels[:, s + 1]
        real = np.isfinite(high)
        mid = np.where(real, (low + np.where(real, high, low)) / 2, 0.0)[:, None]
        on = (e[..., 1] < mid) & (e[..., 3] > mid) & real[:, None]
        x = np.where(on, _at(e, mid), np.inf)
        order = np.argsort(x, axis=1, kind="stable")
        x, on, b = (np.take_along_axis(v, order, axis=1) for v in (x, on, of_b))
        in_a, in_b = (np.cumsum(on & v, axis=1)[:, :-1] % 2 == 1 for v in (~b, b))
        x = np.where(on, x, 0.0)  # those that are not there come last
        wide = np.where(on[:, 1:], x[:, 1:] - x[:, :-1], 0.0) * (np.where(real, high, 0.0) - np.where(real, low, 0.0))[:, None]
        for k, inside in enumerate((in_a & in_b, in_a & ~in_b, in_b & ~in_a)):
            out[:, k] += (wide * inside).sum(axis=1)
    return out


def overlay_areas(a: Flat, b: Flat) -> np.ndarray:
    """(row, 3): areas of the intersection, of a alone and of b alone, under the even-odd rule."""
    from landmesh.functions import geometry

    (ra, _, ea), (rb, _, eb) = a.edges(), b.edges()
    row, e = np.concatenate([ra, rb]), np.concatenate([ea, eb])
    of_b = np.arange(len(row)) >= len(ra)
    some = e[:, 1] != e[:, 3]
    row, e, of_b = row[some], e[some], of_b[some]
    out = np.zeros((len(a), 3))
    if len(row):
        corner = np.full((len(a), 2), np.inf)
        np.minimum.at(corner, row, np.minimum(e[:, :2], e[:, 2:]))
        e = e - np.tile(corner[row], 2)
    for rows, columns in _padded(row, len(a), (e, np.inf), (of_b, False)):
        if columns is None:
            out[rows] = [geometry.overlay_areas(a.rings(i), b.rings(i)) for i in rows]
        else:
            out[rows] = _areas(*columns)
    return out


def _nothing(n: int) -> Flat:
    return gathered(n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def measures(g: Flat) -> np.ndarray:
    """(row, 4): area, perimeter and centroid, as `geometry.ring_measures`."""
    n = len(g)
    row, ring, e = g.edges()
    area = overlay_areas(g, _nothing(n))[:, 1]
    if not len(row):
        return np.stack([area, *np.zeros((3, n))], axis=1)
    total = lambda v: np.bincount(row, weights=v, minlength=n)
    perimeter = total(np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]))
    head = np.zeros((n, 2))
    some = np.diff(g.ring[g.first]) > 0
    at = g.ring[g.first[:-1]][some]
    # Of a row whose first ring is empty, the origin, as there is no vertex to begin with.
    lead = np.diff(g.ring)[g.first[:-1][some]] > 0
    head[np.flatnonzero(some)[lead]] = np.stack([g.x[at], g.y[at]], axis=1)[lead]
    p = e - np.tile(head[row], 2)
    c = p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1]
    signed = total(c) / 2
    cx, cy = (total((p[:, i] + p[:, i + 2]) * c) / 6 for i in (0, 1))
    # Means of vertices, of closed rings: where the last edge has a length, the first vertex counts again.
    last = np.zeros(len(row), dtype=bool)
    last[g.ring[1:][np.diff(g.ring) > 0] - 1] = True
    again = last & ((e[:, :2] != e[:, 2:]).any(axis=1))
    count = np.maximum(total(1.0 + again), 1.0)
    mean = [(total(e[:, i]) + total(np.where(again, e[:, i + 2], 0.0))) / count for i in (0, 1)]
    with np.errstate(all="ignore"):
        centre = [np.where(signed != 0, head[:, i] + v / signed, m) for i, (v, m) in enumerate(zip((cx, cy), mean, strict=True))]
    return np.stack([np.abs(area), perimeter, *centre], axis=1)


def signed_areas(g: Flat) -> np.ndarray:
    """Of each ring, positive if it turns counter-clockwise."""
    _, ring, e = g.edges()
    if not len(ring):
        return np.zeros(len(g.ring) - 1)
    p = e - np.tile(np.stack([g.x, g.y], axis=1)[g.ring[:-1][ring]], 2)
    return np.bincount(ring, weights=p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1], minlength=len(g.ring) - 1) / 2


def crosses(g: Flat) -> np.ndarray:
    """Whether any two edges of a row cross, as `shapes.crosses`."""
    from landmesh.functions import shapes

    row, _, e = g.edges()
    out = np.zeros(len(g), dtype=bool)
    for rows, columns in _padded(row, len(g), (e, np.nan)):
        if columns is None:
            out[rows] = [shapes.crosses(g.rings(i)) for i in rows]
            continue
        (e_,) = columns
        e_ = np.nan_to_num(e_ - np.tile(e_[:, :1, :2], 2))
        still = (1e-9 * np.maximum(1e-9, np.abs(e_).max(axis=(1, 2))) ** 2)[:, None, None]
        a, b, d = e_[..., :2], e_[..., 2:], e_[..., 2:] - e_[..., :2]
        side = lambda p: d[:, :, None, 0] * (p[:, None, :, 1] - a[:, :, None, 1]) - d[:, :, None, 1] * (p[:, None, :, 0] - a[:, :, None, 0])  # noqa: E731, B023
        s, t = side(a), side(b)
        over = (np.minimum(s, t) < -still) & (np.maximum(s, t) > still)
        out[rows] = (over & np.swapaxes(over, 1, 2)).any(axis=(1, 2))
    return out


def combined(shapes_: Flat, row: np.ndarray, of_b: np.ndarray, n: int, rule: str) -> Flat:
    """For each of n rows what `shapes.combined` makes of its shapes: those of a, and those of b.

    Each of shapes_ is of the row and the side that row and of_b say, those of a row in their order.
    Rows go a part at a time, so that what is held beside the shapes doesn't grow with their number.
    """
    size = np.zeros(n, dtype=np.int64)
    np.add.at(size, row, np.diff(shapes_.ring[shapes_.first]) + 1)
    part = np.cumsum(size) // VERTICES
    if not n or part[0] == part[-1]:
        return _combined(shapes_, row, of_b, n, rule)
    out, order = None, np.argsort(row, kind="stable")
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        mine = order[slice(*np.searchsorted(row[order], (i, j)))]
        some = _combined(shapes_.taken(mine), row[mine] - i, of_b[mine], j - i, rule)
        out = some if out is None else joined(out, some)
    return out


def _combined(shapes_: Flat, row: np.ndarray, of_b: np.ndarray, n: int, rule: str) -> Flat:
    from landmesh.functions import shapes as single

    long = np.diff(shapes_.ring)
    opened = np.zeros(len(long), dtype=bool)
    some = long > 0
    first, last = shapes_.ring[:-1][some], shapes_.ring[1:][some] - 1
    opened[some] = (shapes_.x[first] != shapes_.x[last]) | (shapes_.y[first] != shapes_.y[last])
    wide = np.bincount(shapes_.row_of_ring, weights=long + opened > 3, minlength=len(shapes_)) > 0
    shape, _, e = shapes_.edges()
    keep = wide[shape]
    shape, e = shape[keep], e[keep]
    at = row[shape]
    if not len(at):
        return _nothing(n)
    most, corner = np.zeros(n), np.full((n, 2), np.inf)
    np.maximum.at(most, at, np.abs(e[:, :2]).max(axis=1))
    grid = 2.0 ** (np.floor(np.log2(np.where(most > 0, most, 1.0))) - 46)
    e = np.round(e / grid[at][:, None]) * grid[at][:, None]
    np.minimum.at(corner, at, e[:, :2])
    e = e - np.tile(corner[at], 2)
    some = e[:, 1] != e[:, 3]
    shape, at, e = shape[some], at[some], e[some]
    # Number of a shape within its row, by how many there are before it.
    order = np.argsort(row, kind="stable")
    number = np.empty(len(row), dtype=np.int64)
    begin = np.searchsorted(row[order], np.arange(n + 1))
    number[order] = np.arange(len(row)) - begin[row[order]]
    found, left = [], []
    for rows, columns in _padded(at, n, (e, np.inf), (number[shape], -1), (of_b[shape], False)):
        if columns is None:
            left.append(rows)
            continue
        odd, *rings = _overlaid(*columns, grid[rows], rule)
        left.append(rows[odd])
        which, size, x, y = rings
        x, y = (v + np.repeat(corner[rows, i][which], size) for i, v in enumerate((x, y)))
        found.append((rows[which], size, x, y))
    for i in np.concatenate(left) if left else []:
        mine = order[begin[i] : begin[i + 1]]
        rings = single.combined([shapes_.rings(s) for s in mine if not of_b[s]], [shapes_.rings(s) for s in mine if of_b[s]], rule)
        if rings:
            p = np.concatenate(rings)
            found.append((np.full(len(rings), i), np.array([len(r) for r in rings]), p[:, 0], p[:, 1]))
    return gathered(n, *(np.concatenate(v) for v in zip(*found, strict=True))) if found else _nothing(n)


def _overlaid(e: np.ndarray, number: np.ndarray, of_b: np.ndarray, grid: np.ndarray, rule: str):
    """Which rows are odd (a boundary that meets itself more than once in a place), and of the
    others the closed rings: row, size, x, y. Edges (row, place, 4), relative and on the grid."""
    e = _upward(e)
    m, places = number.shape
    g = grid[:, None]
    every = np.concatenate([e[..., 1], e[..., 3], np.round(_crossings(e) / g) * g], axis=1)
    order = np.argsort(every, axis=1, kind="stable")
    levels = np.take_along_axis(every, order, axis=1)
    with np.errstate(invalid="ignore"):
        new = np.concatenate([np.ones((m, 1), dtype=bool), ~(np.diff(levels, axis=1) <= 2 * g)], axis=1) & np.isfinite(levels)
    # Levels a step or two apart are one, the lowest of them.
    cluster = np.cumsum(new, axis=1) - 1
    lowest = np.take_along_axis(levels, np.maximum.accumulate(np.where(new, np.arange(levels.shape[1]), 0), axis=1), axis=1)
    back = np.empty_like(order)
    np.put_along_axis(back, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    level_of, value_of = (np.take_along_axis(v, back, axis=1)[:, : 2 * places] for v in (cluster, lowest))
    e = e.copy()
    real = np.isfinite(e[..., 3])
    e[..., 1], e[..., 3] = np.where(real, value_of[:, :places], np.inf), np.where(real, value_of[:, places:], np.inf)
    low_of, high_of = level_of[:, :places], level_of[:, places:]
    real &= low_of < high_of
    count = new.sum(axis=1)
    tall = int(count.max(initial=0))
    level = np.full((m, max(tall, 1)), np.inf)
    r, c = np.nonzero(new)
    level[r, cluster[r, c]] = levels[r, c]

    parts: list[list[np.ndarray]] = []
    layers = int(number.max(initial=0)) + 1
    for s in range(tall - 1):
        on = real & (low_of <= s) & (high_of > s)
        if not on.any():
            continue
        there = s + 1 < count
        low, high = level[:, s], np.where(there, level[:, s + 1], level[:, s])
        x = np.where(on, _at(e, ((low + high) / 2)[:, None]), np.inf)
        by = np.argsort(x, axis=1, kind="stable")
        on_, b_, n_ = (np.take_along_axis(v, by, axis=1) for v in (on, of_b, number))
        depth = [np.zeros((m, places), dtype=np.int64), np.zeros((m, places), dtype=np.int64)]
        for k in range(layers):
            mine = on_ & (n_ == k)
            if mine.any():
                odd = np.cumsum(mine, axis=1) % 2
                b_side = (mine & b_).any(axis=1)[:, None]
                depth[0] += odd * ~b_side
                depth[1] += odd * b_side
        inside = _RULES[rule](*depth)
        before = np.concatenate([np.zeros((m, 1), dtype=bool), inside[:, :-1]], axis=1)
        change = on_ & (inside != before)
        i, j = np.nonzero(change)
        edge = e[i, by[i, j]]
        step = grid[i]
        x_low, x_high = (np.where(y <= edge[:, 1], edge[:, 0], np.where(y >= edge[:, 3], edge[:, 2], np.round(_at(edge, y) / step) * step)) for y in (low[i], high[i]))
        parts.append([i, np.full(len(i), s), x_low, x_high, np.where(inside[i, j], 1, -1)])
    none = (np.zeros(m, dtype=bool), *(np.zeros(0, np.int64),) * 2, *(np.zeros(0),) * 2)
    if not parts:
        return none
    row, slab, x_low, x_high, sign = (np.concatenate(v) for v in zip(*parts, strict=True))
    if not len(row):
        return none

    # Ends along each level: those a step or two apart are one vertex.
    k = len(row)
    key = np.concatenate([row * (tall + 1) + slab, row * (tall + 1) + slab + 1])
    x, turn = np.concatenate([x_low, x_high]), np.concatenate([sign, -sign])
    by = np.lexsort((x, key))
    key, x = key[by], x[by]
    fresh = np.ones(2 * k, dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (np.diff(x) > 2 * grid[key[1:] // (tall + 1)])
    vertex = np.empty(2 * k, dtype=np.int64)
    vertex[by] = np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)
    v_row, v_level, v_x = key[head] // (tall + 1), key[head] % (tall + 1), x[head]
    v_y = level[v_row, v_level]
    many = np.zeros(m, dtype=bool)

    # Sides of the slabs; opposite ones cancel. Up where the shape ends, down where it begins.
    pair = vertex[:k] * len(head) + vertex[k:]
    pair, which = np.unique(pair, return_inverse=True)
    net = np.bincount(which, weights=-sign).astype(np.int64)
    low_v, high_v = pair // len(head), pair % len(head)
    many[v_row[low_v[np.abs(net) > 1]]] = True
    ups, downs = net > 0, net < 0
    tails, tips = [low_v[ups], high_v[downs]], [high_v[ups], low_v[downs]]
    # Stretches of levels, eastwards where only the upper side belongs.
    along = np.bincount(vertex, weights=turn, minlength=len(head)).astype(np.int64)
    some = np.flatnonzero(along)
    depth = np.cumsum(along[some])[:-1]
    west, east = some[:-1], some[1:]
    many[v_row[west[np.abs(depth) > 1]]] = True
    tails += [west[depth > 0], east[depth < 0]]
    tips += [east[depth > 0], west[depth < 0]]
    tail, tip = np.concatenate(tails), np.concatenate(tips)

    fine = ~many[v_row[tail]]
    tail, tip = tail[fine], tip[fine]
    out_n, in_n = (np.bincount(v, minlength=len(head)) for v in (tail, tip))
    many[v_row[(out_n != in_n) | (out_n > 2)]] = True
    fine = ~many[v_row[tail]]
    tail, tip = tail[fine], tip[fine]
    if not len(tail):
        return (many, *none[1:])
    # The segment after each one; where two leave a vertex, the sharpest turn to the left.
    leaving = np.argsort(tail, kind="stable")
    start = np.searchsorted(tail[leaving], tip)
    after = leaving[start]
    twice = np.flatnonzero(np.bincount(tail, minlength=len(head))[tip] == 2)
    if len(twice):
        at = tip[twice]
        to = np.stack([leaving[start[twice]], leaving[start[twice] + 1]], axis=1)
        angle = lambda v: np.arctan2(v_y[v] - v_y[at], v_x[v] - v_x[at])
        back = angle(tail[twice])
        turned = np.stack([(back - angle(tip[to[:, i]])) % (2 * np.pi) for i in range(2)], axis=1)
        turned[turned == 0] = 2 * np.pi
        after[twice] = to[np.arange(len(twice)), turned.argmin(axis=1)]
    taken = np.bincount(after, minlength=len(tail))
    many[v_row[tail[taken != 1]]] = True
    fine = ~many[v_row[tail]]
    renumber = np.cumsum(fine) - 1
    tail, after = tail[fine], renumber[after[fine]]
    if not len(tail):
        return (many, *none[1:])
    # Each cycle from its least vertex, by x and y.
    rank = np.empty(len(head), dtype=np.int64)
    rank[np.lexsort((v_y, v_x, v_row))] = np.arange(len(head))
    least, jump = rank[tail], after
    for _ in range(int(np.bincount(v_row[tail]).max()).bit_length() + 1):
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    first = np.flatnonzero(rank[tail] == least)
    first = first[np.argsort(rank[tail[first]], kind="stable")]
    cycle, now, walked = np.arange(len(first)), first, []
    while len(now):
        walked.append((cycle, tail[now]))
        now = after[now]
        on = rank[tail[now]] != least[now]
        cycle, now = cycle[on], now[on]
    cycle, at = (np.concatenate(v) for v in zip(*walked, strict=True))
    by = np.argsort(cycle, kind="stable")
    cycle, at = cycle[by], at[by]
    # A ring that comes twice through a vertex is left to the function of single rows.
    both = np.sort(cycle * len(head) + at)
    many[v_row[both[1:][both[1:] == both[:-1]] % len(head)]] = True
    if len(at) < len(tail):
        lost = np.bincount(v_row[tail], minlength=m) != np.bincount(v_row[at], minlength=m)
        many |= lost
    fine = ~many[v_row[at]]
    cycle, at = cycle[fine], at[fine]
    return (many, *_straightened(cycle, v_row[at], v_x[at], v_y[at], grid))


#: RULES of `shapes` over arrays of depths.
_RULES = {"intersection": lambda a, b: (a > 0) & (b > 0), "difference": lambda a, b: (a > 0) & (b == 0), "union": lambda a, b: (a > 0) | (b > 0)}


def _straightened(cycle: np.ndarray, row: np.ndarray, x: np.ndarray, y: np.ndarray, grid: np.ndarray):
    """Rings (vertices in order) closed again from their least vertex, as `shapes._straightened`:
    row, size, x, y."""
    while True:
        n = len(cycle)
        lead = np.ones(n, dtype=bool)
        lead[1:] = cycle[1:] != cycle[:-1]
        begin = np.flatnonzero(lead)
        size = np.diff(begin, append=n)
        some = np.repeat(size > 2, size)
        if not some.all():
            cycle, row, x, y = (v[some] for v in (cycle, row, x, y))
            continue
        if not n:
            return row, size, x, y
        before, after = np.arange(n) - 1, np.arange(n) + 1
        end = begin + size - 1
        before[begin], after[end] = end, begin
        step = grid[row]
        dx, dy = x[after] - x[before], y[after] - y[before]
        off = np.abs(dx * (y - y[before]) - dy * (x - x[before]))
        flat = off <= 4 * step * np.maximum(np.hypot(dx, dy), step)
        gone = flat & ~(flat[before] & ~lead)  # never two neighbours at once
        gone[end] &= ~gone[begin]
        if not gone.any():
            break
        cycle, row, x, y = (v[~gone] for v in (cycle, row, x, y))
    ring = np.cumsum(lead) - 1
    px, py = x - x[begin][ring], y - y[begin][ring]
    area = np.abs(np.bincount(ring, weights=px * py[after] - px[after] * py)) / 2
    around = np.bincount(ring, weights=np.hypot(x[after] - x, y[after] - y))
    keep = area > 8 * grid[row[begin]] * around
    # From the least vertex on, and back to it.
    by = np.lexsort((y, x, ring))
    least = by[begin] - begin
    size, begin, least, row = size[keep], begin[keep], least[keep], row[begin][keep]
    place = _spans(np.zeros(len(size), dtype=np.int64), size + 1) if len(size) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(size)), size + 1)
    take = begin[of] + (place + least[of]) % size[of]
    return row, size + 1, x[take], y[take]


def strips(a: Flat, b: Flat, widest: float, tolerance: float, facing: float) -> Flat:
    """For each row the ground between its two shapes, as `shapes.strips`."""
    n = len(a)
    edges = []
    for g, other in ((a, b), (b, a)):
        low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        of = other.row_of_ring[other.ring_of_vertex]
        p = np.stack([other.x, other.y], axis=1)
        np.minimum.at(low, of, p)
        np.maximum.at(high, of, p)
        row, _, e = g.edges()
        near = (np.minimum(e[:, :2], e[:, 2:]) <= high[row] + widest) & (np.maximum(e[:, :2], e[:, 2:]) >= low[row] - widest)
        edges.append((row[near.all(axis=1)], e[near.all(axis=1)]))
    (ra, ea), (rb, eb) = edges
    (begin_a, na), (begin_b, nb) = ((np.cumsum(c) - c, c) for c in (np.bincount(r, minlength=n) for r in (ra, rb)))
    quads, of, end = [], [], np.cumsum(na * nb)
    i = 0
    while i < n:  # pairs of edges of as many rows as there is room for
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + ROOM, side="right")))
        size = (na * nb)[i:j]
        row = np.repeat(np.arange(i, j), size)
        k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        p, q = ea[begin_a[row] + k // np.maximum(nb[row], 1)], eb[begin_b[row] + k % np.maximum(nb[row], 1)]
        with np.errstate(all="ignore"):
            at, long = p[:, :2], np.hypot(*(p[:, 2:] - p[:, :2]).T)
            u = (p[:, 2:] - at) / long[:, None]
            along = lambda v: ((v - at) * u).sum(axis=1)  # noqa: E731, B023
            off = lambda v: (v - at)[:, 1] * u[:, 0] - (v - at)[:, 0] * u[:, 1]  # noqa: E731, B023
            t0, t1, d0, d1 = along(q[:, :2]), along(q[:, 2:]), off(q[:, :2]), off(q[:, 2:])
            lo, hi = np.maximum(0.0, np.minimum(t0, t1)), np.minimum(long, np.maximum(t0, t1))
            near, far = (d0 + (v - t0) / (t1 - t0) * (d1 - d0) for v in (lo, hi))
            most = np.maximum(np.abs(near), np.abs(far))
            some = (long > 0) & (hi > lo) & (np.abs(t1 - t0) >= facing * np.hypot(*(q[:, 2:] - q[:, :2]).T)) & (near * far >= 0) & (most > tolerance) & (most <= widest)
        at, u, lo, hi, near, far = (v[some] for v in (at, u, lo, hi, near, far))
        turn = np.stack([-u[:, 1], u[:, 0]], axis=1)
        corner = [at + u * t[:, None] + turn * d[:, None] for t, d in ((lo, 0 * lo), (hi, 0 * lo), (hi, far), (lo, near))]
        quads.append(np.stack([*corner, corner[0]], axis=1))
        of.append(row[some])
        i = j
    if not quads or not sum(map(len, of)):
        return _nothing(n)
    of, p = np.concatenate(of), np.concatenate(quads).reshape(-1, 2)
    rows, which = np.unique(of, return_inverse=True)
    strip = gathered(len(of), np.arange(len(of)), np.full(len(of), 5), p[:, 0], p[:, 1])
    every = joined(strip, joined(a.taken(rows), b.taken(rows)))
    found = combined(every, np.concatenate([which, np.arange(len(rows)), np.arange(len(rows))]), np.arange(len(every)) >= len(of), len(rows), "difference")
    ring = found.row_of_ring
    return gathered(n, rows[ring], np.diff(found.ring), found.x, found.y)


def distances(g: Flat, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of a point for each row to its shape, 0 inside a polygon, as `planar.shape_distance`; NaN
    where a shape has no vertex."""
    row, _, e = g.edges()
    out = np.full(len(g), np.nan)
    if not len(row):
        return out
    px, py = x[row], y[row]
    d, q = e[:, 2:] - e[:, :2], np.stack([px, py], axis=1) - e[:, :2]
    with np.errstate(all="ignore"):
        long = (d * d).sum(axis=1)
        t = np.where(long > 0, np.clip((q * d).sum(axis=1) / long, 0.0, 1.0), 0.0)
        apart = np.hypot(e[:, 0] + t * d[:, 0] - px, e[:, 1] + t * d[:, 1] - py)
        crossed = ((e[:, 1] > py) != (e[:, 3] > py)) & (px < d[:, 0] * (py - e[:, 1]) / d[:, 1] + e[:, 0])
    np.fmin.at(out, row, apart)
    inside = (np.bincount(row, weights=crossed, minlength=len(g)) % 2 == 1) & (g.dim == 2)
    return np.where(inside, 0.0, out)


def meets_box(e: np.ndarray, x0, y0, x1, y1) -> np.ndarray:
    """Whether edges have a point in closed boxes, as `planar.edge_meets_box`."""
    ax, ay, bx, by = e.T
    apart = (np.maximum(ax, bx) < x0) | (np.minimum(ax, bx) > x1) | (np.maximum(ay, by) < y0) | (np.minimum(ay, by) > y1)
    corners = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
    return ~apart & (np.minimum.reduce(corners) <= 0) & (np.maximum.reduce(corners) >= 0)


def _crossed(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the ray from a point to the east crosses an edge."""
    with np.errstate(all="ignore"):
        return ((e[:, 1] > y) != (e[:, 3] > y)) & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])


def covering(g: Flat, depth: int, finest: int):
    """Row, level, ix, iy and whether it is inner, of the cells of each row's covering (see `coverings`)."""
    row, _, e = g.edges()
    n = len(g)
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    np.minimum.at(low, row, e[:, :2])
    np.maximum.at(high, row, e[:, :2])
    some = np.flatnonzero(np.isfinite(low).all(axis=1))
    begin = np.searchsorted(row, np.arange(n))
    count = np.bincount(row, minlength=n)
    level = np.ceil(np.log2(np.maximum((high - low)[some].max(axis=1), 2.0**finest))).astype(np.int64)
    side = 2.0**level
    first, last = (np.floor(v[some] / side[:, None]).astype(np.int64) for v in (low, high))
    wide = last - first + 1
    of = np.repeat(np.arange(len(some)), wide.prod(axis=1))
    k = _spans(np.zeros(len(some), dtype=np.int64), wide.prod(axis=1))
    own, level, at = some[of], level[of], first[of] + np.stack([k // wide[of, 1], k % wide[of, 1]], axis=1)
    cell, edge = np.repeat(np.arange(len(own)), count[own]), _spans(begin[own], count[own])
    done = []

    def met(cell, edge):
        a, s = at[cell], 2.0 ** level[cell]
        keep = meets_box(e[edge], a[:, 0] * s, a[:, 1] * s, (a[:, 0] + 1) * s, (a[:, 1] + 1) * s)
        return cell[keep], edge[keep]

    cell, edge = met(cell, edge)
    for _ in range(depth):
        held = np.bincount(cell, minlength=len(own)) > 0
        done.append((own[~held], level[~held], at[~held]))
        four = np.flatnonzero(held)
        home = np.cumsum(held) - 1
        cell, edge = (4 * home[cell])[:, None] + np.arange(4), np.repeat(edge, 4)
        cell = cell.ravel()
        own, level = np.repeat(own[four], 4), np.repeat(level[four] - 1, 4)
        at = (2 * at[four][:, None] + np.array([(0, 0), (0, 1), (1, 0), (1, 1)])).reshape(-1, 2)
        cell, edge = met(cell, edge)
    held = np.bincount(cell, minlength=len(own)) > 0
    done.append((own[~held], level[~held], at[~held]))
    free, free_level, free_at = (np.concatenate(v) for v in zip(*done, strict=True))
    # Cells that no edge crosses lie inside as a whole, or outside.
    middle = (free_at + 0.5) * (2.0**free_level)[:, None]
    which, edge = np.repeat(np.arange(len(free)), count[free]), _spans(begin[free], count[free])
    inside = np.bincount(which, weights=_crossed(e[edge], *middle[which].T), minlength=len(free)) % 2 == 1
    out = [np.concatenate([a[inside], b[held]]) for a, b in ((free, own), (free_level, level), (free_at, at))]
    return out[0], out[1], out[2][:, 0], out[2][:, 1], np.arange(len(out[0])) < inside.sum()


def meet(a: Flat, b: Flat) -> np.ndarray:
    """Whether the two shapes of a row have a point in common, as `planar.shapes_meet`."""
    n = len(a)
    (ra, _, ea), (rb, _, eb) = a.edges(), b.edges()
    (begin_a, na), (begin_b, nb) = ((np.cumsum(c) - c, c) for c in (np.bincount(r, minlength=n) for r in (ra, rb)))
    out = np.zeros(n, dtype=bool)
    end = np.cumsum(na * nb)
    side = lambda s, x, y: np.sign((s[:, 2] - s[:, 0]) * (y - s[:, 1]) - (s[:, 3] - s[:, 1]) * (x - s[:, 0]))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + ROOM, side="right")))
        size = (na * nb)[i:j]
        row = np.repeat(np.arange(i, j), size)
        k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        pi, qi = begin_a[row] + k // np.maximum(nb[row], 1), begin_b[row] + k % np.maximum(nb[row], 1)
        p, q = ea[pi], eb[qi]
        apart = np.zeros(len(row), dtype=bool)
        for c in (0, 1):
            apart |= (np.maximum(p[:, c], p[:, c + 2]) < np.minimum(q[:, c], q[:, c + 2])) | (np.maximum(q[:, c], q[:, c + 2]) < np.minimum(p[:, c], p[:, c + 2]))
        touch = ~apart & (side(p, q[:, 0], q[:, 1]) * side(p, q[:, 2], q[:, 3]) <= 0) & (side(q, p[:, 0], p[:, 1]) * side(q, p[:, 2], p[:, 3]) <= 0)
        out[row[touch]] = True
        # Parts of a shape may lie inside the other on their own, so that every vertex counts.
        for mine, of, point, other in ((pi, ra, p, q), (qi, rb, q, p)):
            if len(mine):
                base = mine.min()
                out[of[base:][np.flatnonzero(np.bincount(mine - base, weights=_crossed(other, point[:, 0], point[:, 1])) % 2 == 1)]] = True
        i = j
    return out

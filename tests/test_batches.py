"""Overlays of whole batches against those of single rows."""

import numpy as np
import pytest

from landmesh.functions import batches, shapes
from landmesh.functions.geometry import boundary_distance, contains, overlay_areas, ring_measures

TURN = np.array([[0.6, 0.8], [-0.8, 0.6]])


def polygon(rng, kind):
    if kind == 0:  # anything, crossing itself as it likes
        p = rng.random((rng.integers(3, 8), 2)) * 100 + [740000, 1950000]
    elif kind == 1:  # a few places of a small grid: ends and edges that fall together
        p = rng.integers(0, 4, (rng.integers(3, 7), 2)).astype(float)
    elif kind == 2:  # boxes, turned
        x, y, w, h = rng.integers(0, 6, 2).tolist() + rng.integers(1, 6, 2).tolist()
        p = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], dtype=float) @ TURN + [740000, 1950000]
    else:  # many edges
        p = rng.random((rng.integers(9, 40), 2)) * 50
    rings = [np.concatenate([p, p[:1]])]
    if kind == 2 and rng.random() < 0.3:  # a hole
        m = p.mean(axis=0)
        rings.append((rings[0] - m) * -0.5 + m)
    return rings


def cases(n=240, seed=3):
    rng = np.random.default_rng(seed)
    kinds = [[0, 1, 2, 2, 2, 3][i % 6] for i in range(n)]
    rows = [(polygon(rng, k), polygon(rng, k)) for k in kinds]
    rows += [(a, a) for a, _ in rows[:12]] + [(a, []) for a, _ in rows[:6]] + [([], []), ([np.zeros((1, 2))], rows[0][0])]
    return rows


def test_measures_of_batches():
    rows = cases()
    a, b = (batches.stacked([r[i] for r in rows]) for i in (0, 1))
    want = np.array([overlay_areas(*r) for r in rows])
    assert np.allclose(batches.overlay_areas(a, b), want, atol=1e-6)
    assert np.allclose(batches.measures(a), [ring_measures(r[0]) for r in rows], atol=1e-5)
    assert np.allclose(batches.signed_areas(a), [shapes.signed_area(p) for r in rows for p in r[0]], atol=1e-6)
    crossed = batches.crosses(a)
    assert crossed.tolist() == [bool(r[0]) and any(len(p) > 1 for p in r[0]) and shapes.crosses(r[0]) for r in rows]


@pytest.mark.parametrize("part", [100_000, 500])
@pytest.mark.parametrize("rule", shapes.RULES)
def test_overlays_of_batches(rule, part, monkeypatch):
    rows = cases()
    monkeypatch.setattr(batches, "VERTICES", part)
    flat = batches.stacked([s for r in rows for s in r])
    alone = []
    monkeypatch.setattr(shapes, "combined", lambda *a, f=shapes.combined: alone.append(1) or f(*a))
    got = batches.combined(flat, np.repeat(np.arange(len(rows)), 2), np.tile([False, True], len(rows)), len(rows), rule)
    assert 0 < len(alone) < 0.55 * len(rows)
    monkeypatch.undo()
    for i, (a, b) in enumerate(rows):
        want, mine = shapes.combined([a], [b], rule), got.rings(i)
        area = sum(map(shapes.signed_area, want))
        assert sum(map(shapes.signed_area, mine)) == pytest.approx(area, abs=1e-5)
        assert overlay_areas(mine, [])[1] == pytest.approx(area, abs=1e-5)
        assert overlay_areas(mine, want)[0] == pytest.approx(area, abs=1e-5)  # the same ground
        assert len(mine) == len(want)


def test_many_shapes_of_a_row():
    tiles = [[np.array([(x, y), (x + 2, y), (x + 2, y + 3), (x, y + 3), (x, y)], dtype=float) @ TURN] for x in (0, 2) for y in (0, 3, 6)]
    flat = batches.stacked(tiles)
    got = batches.combined(flat, np.array([0, 0, 1, 1, 1, 0]), np.zeros(6, dtype=bool), 2, "union")
    for i, mine in enumerate(([0, 1, 5], [2, 3, 4])):
        want = shapes.combined([tiles[k] for k in mine], [], "union")
        assert [len(r) for r in got.rings(i)] == [len(r) for r in want]
        assert all(np.array_equal(a, b) for a, b in zip(got.rings(i), want, strict=True))


def test_strips_of_batches():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        w, h, gap, slip = rng.random(4) * [10, 10, 1.5, 4] + [2, 2, 0, 0]
        a = np.array([(0, 0), (w, 0), (w, h), (0, h), (0, 0)])
        tilt = 0.05 * (i % 3)
        b = np.array([(w + gap, slip), (w + gap + 5, slip), (w + gap + 5, slip + h), (w + gap + tilt, slip + h), (w + gap, slip)])
        rows.append(([a @ TURN + [740000, 1950000]], [b @ TURN + [740000, 1950000]]))
    a, b = (batches.stacked([r[i] for r in rows]) for i in (0, 1))
    got = batches.strips(a, b, 1.0, 0.05, shapes.FACING)
    found = 0
    for i, r in enumerate(rows):
        want = shapes.strips(*r, 1.0, 0.05)
        found += bool(want)
        assert sum(map(shapes.signed_area, got.rings(i))) == pytest.approx(sum(map(shapes.signed_area, want)), abs=1e-6)
    assert 10 < found < 60


def test_distances_of_batches():
    rng = np.random.default_rng(6)
    rows = [a for a, _ in cases()]
    g = batches.stacked(rows)
    x, y = (np.array([r[0][:, i].mean() if r else 0.0 for r in rows]) + rng.normal(0, 20, len(rows)) for i in (0, 1))
    got = batches.distances(g, x, y)
    inside = 0
    for i, rings in enumerate(rows):
        if not rings:
            assert np.isnan(got[i])
            continue
        want = 0.0 if contains(rings, x[i], y[i]) else boundary_distance(rings, np.array([[x[i], y[i]]]))[0]
        inside += want == 0
        assert got[i] == pytest.approx(want, abs=1e-6)
    assert 10 < inside < len(rows) - 20
    assert batches.distances(batches.stacked([rows[0], rows[0]]), *np.full((2, 2), np.nan)).shape == (2,)

"""Nearest shapes, coverings, greedy chains and keyed status against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landmesh.functions.geometry import contains, from_wkt_text, rings_of
from landmesh.operators import coverings, matching, nearest
from landmesh.streaming import status
from tests.test_operators import EDGE, greedy

GEO = "id string, wkt string"


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Rising scores along a path: every edge waits for the next one."""
    n, seen = 10_000, []
    rows = [(f"a{(i + 1) // 2:05d}", f"b{i // 2:05d}", "s", "t", float(i), False) for i in range(n)]
    real = matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name: seen.append(name) or real(df, name))
    got = {(r.a_id, r.b_id) for r in matching.one_to_one(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == greedy(rows)
    assert len(seen) <= 20


def test_selection_of_mixed_sides_and_copies(spark):
    """A feature may stand on either side of its pairs; repeated pairs and null scores are no error."""
    rng = random.Random(11)
    rows = []
    for _ in range(400):
        (a, sa), (b, sb) = rng.sample([(f"{s}{i}", s) for s in "stu" for i in range(12)], 2)
        if sa != sb:
            rows.append((a, b, sa, sb, float(rng.randint(1, 9)), rng.random() < 0.05))
    rows = list({frozenset(r[:2]): r for r in rows}.values())
    want = greedy(rows)
    assert {(r.a_id, r.b_id) for r in matching.one_to_one(spark.createDataFrame(rows + rows[:20], EDGE)).collect()} == want
    assert matching.one_to_one(spark.createDataFrame([], EDGE)).count() == 0
    some = [("a", "b", "s", "t", None, None), ("a", "c", "s", "t", 1.0, None)]
    assert [r.b_id for r in matching.one_to_one(spark.createDataFrame(some, EDGE)).collect()] == ["c"]


def shapes_of(seed: int, n: int = 120) -> list[tuple[str, str]]:
    """Rectangles, stars, rings with holes and points of very different sizes."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 5000), rng.uniform(0, 3000)
        r = rng.choice([0.5, 5, 30]) if i else 900
        k = rng.randint(3, 9)
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(k))
        ring = [(x + r * rng.uniform(0.4, 1) * math.cos(t), y + r * rng.uniform(0.4, 1) * math.sin(t)) for t in turn]
        text = ", ".join(f"{a!r} {b!r}" for a, b in [*ring, ring[0]])
        hole = ""
        if i % 10 == 0:
            q = r * 0.05
            hole = f", ({x - q!r} {y - q!r}, {x + q!r} {y - q!r}, {x + q!r} {y + q!r}, {x - q!r} {y + q!r}, {x - q!r} {y - q!r})"
        out.append((f"p{i:03d}", f"POINT ({x!r} {y!r})" if i % 17 == 3 else f"POLYGON (({text}){hole})"))
    return out


def with_boxes(spark, rows):
    from landmesh.functions.geometry import from_wkt

    df = spark.createDataFrame([*rows, ("none", None)], GEO).withColumn("geom", from_wkt("wkt"))
    return df.select("id", "geom", F.col("geom.xmin").alias("x0"), F.col("geom.ymin").alias("y0"), F.col("geom.xmax").alias("x1"), F.col("geom.ymax").alias("y1"))


def gap(rings, x, y, dim) -> float:
    if dim == 2 and contains(rings, x, y):
        return 0.0
    best = math.inf
    for ring in rings:
        p = ring.tolist()
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(ax + t * dx - x, ay + t * dy - y))
    return best


def points_of(seed: int, n: int = 150) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-500, 5500), rng.uniform(-500, 3500)) for i in range(n)]
    return [*rows, (n, 1e6, -2e6), (n + 1, -70_000.0, 10.0), (n + 2, None, 1.0), (3, 7.0, 7.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_shape(spark, seed):
    rows, points = shapes_of(seed), points_of(seed)
    flat = [(i, g := from_wkt_text(t), rings_of(g)) for i, t in rows]
    got = nearest.nearest(spark.createDataFrame(points, "point_id int, x double, y double"), with_boxes(spark, rows), "id").collect()
    assert len(got) == len(points)
    for r in got:
        if r.x is None:
            assert r.id is None and r.distance is None
            continue
        want = min((gap(rings, r.x, r.y, g["dim"]), i) for i, g, rings in flat)
        assert r.distance == pytest.approx(want[0], abs=1e-6)
        assert r.id == want[1] or want[0] != 0 or gap(next(x for i, _, x in flat if i == r.id), r.x, r.y, 2) == 0


def test_nearest_of_boxes_ties_and_none(spark):
    boxes = spark.createDataFrame([(2, 0.0, 0.0, 1.0, 1.0), (1, 4.0, 0.0, 5.0, 1.0), (3, None, 0.0, 1.0, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([("tie", 2.5, 0.5), ("in", 0.5, 0.5), ("far", 1e9, 0.5)], "name string, x double, y double")
    got = {r.name: (r.id, r.distance) for r in nearest.nearest(points, boxes, "id").collect()}
    assert got == {"tie": (1, 1.5), "in": (2, 0.0), "far": (1, 1e9 - 5)}
    for some, of in ((points, boxes.limit(0)), (points.limit(0), boxes)):
        assert nearest.nearest(some, of, "id").filter("id is not null").count() == 0


def test_nearest_leaves_far_shapes_out(spark, monkeypatch):
    """A point far off meets few of very many shapes: the bound falls as it goes down."""
    n = 3000
    shapes = spark.range(n).select("id", *(F.expr(e).alias(c) for c, e in (("x0", "id % 60 * 10.0"), ("y0", "id div 60 * 10.0"), ("x1", "id % 60 * 10.0 + 5"), ("y1", "id div 60 * 10.0 + 5"))))
    met = []
    monkeypatch.setattr(nearest, "stored", lambda df, name, f=nearest.stored: met.append((name, out := f(df, name))) or out)
    points = spark.createDataFrame([(2000.0 + i, 1500.0) for i in range(4)], "x double, y double")
    got = nearest.nearest(points, shapes, "id").collect()
    assert {r.id for r in got} == {n - 1}
    frontiers = [df.groupBy("__p").count().agg(F.max("count")).first()[0] for name, df in met if name == "frontier"]
    assert frontiers and max(frontiers) <= 40


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_points_in_coverings(spark, depth):
    rows, points = [r for r in shapes_of(3) if "POLYGON" in r[1]], points_of(3, 400)
    flat = [(i, rings_of(from_wkt_text(t))) for i, t in rows]
    got = coverings.assigned(spark.createDataFrame(points, "point_id int, x double, y double"), with_boxes(spark, rows), "id", depth).collect()
    assert len(got) == len(points)
    for r in got:
        assert r.id == (None if r.x is None else min((i for i, rings in flat if contains(rings, r.x, r.y)), default=None))
    assert sum(r.tested for r in got) < (len(points) if depth else len(points) + 1)


def test_inner_cells_lie_inside_and_all_ground_is_covered(spark):
    rows = [("l", "POLYGON ((0 0, 100 0, 100 10, 10 10, 10 100, 0 100, 0 0))")]
    cells = coverings.covering(with_boxes(spark, rows), "id", 5).collect()
    rings = rings_of(from_wkt_text(rows[0][1]))
    assert {c.inner for c in cells} == {True, False}
    rng = random.Random(1)
    for _ in range(2000):
        x, y = rng.uniform(-5, 105), rng.uniform(-5, 105)
        of = [c for c in cells if math.floor(x / 2.0**c.level) == c.ix and math.floor(y / 2.0**c.level) == c.iy]
        assert len(of) <= 1
        assert contains(rings, x, y) == bool(of and (of[0].inner or contains(rings, x, y)))


@pytest.mark.parametrize("depth", [1, 4])
def test_polygons_that_meet(spark, depth):
    from landmesh.functions.shapes import combined

    a = [r for r in shapes_of(4, 90) if "POLYGON" in r[1]]
    b = [r for r in shapes_of(5, 90) if "POLYGON" in r[1]]
    # One that lies within another, one in a hole, one that only touches.
    a += [("big", "POLYGON ((9000 0, 9100 0, 9100 100, 9000 100, 9000 0), (9040 40, 9060 40, 9060 60, 9040 60, 9040 40))")]
    b += [("in", "POLYGON ((9010 10, 9011 10, 9011 11, 9010 10))"), ("hole", "POLYGON ((9045 45, 9046 45, 9046 46, 9045 45))"), ("touch", "POLYGON ((9100 50, 9110 50, 9110 60, 9100 50))"), ("off", "POLYGON ((9100.5 50, 9110 50, 9110 60, 9100.5 50))")]
    got = {(r.a_id, r.b_id) for r in coverings.intersecting(with_boxes(spark, a), with_boxes(spark, b), "id", "id", depth).collect()}
    rings = lambda t: rings_of(from_wkt_text(t))
    want = {(i, j) for i, s in a for j, t in b if combined([rings(s)], [rings(t)], "intersection")} | {("big", "touch")}
    assert got == want
    assert coverings.intersecting(with_boxes(spark, a).limit(0), with_boxes(spark, b), "id", "id").count() == 0


@pytest.mark.parametrize("few", [0, 5, 16])
def test_pairs_of_few_and_many_vertices(spark, few, monkeypatch):
    from landmesh.functions.shapes import combined

    monkeypatch.setattr(coverings, "FEW", few)
    ring = lambda x, y, r, n: "POLYGON ((" + ", ".join(f"{x + r * math.cos(2 * math.pi * (i % n) / n)!r} {y + r * math.sin(2 * math.pi * (i % n) / n)!r}" for i in range(n + 1)) + "))"
    a = [(str(i), ring(7.0 * i, 3.0 * (i % 4), 2 + i % 3 * 3, [3, 4, 40][i % 3])) for i in range(24)]
    b = [(str(i), ring(6.53 * i, 2.017 * (i % 5), 1.01 + i % 2 * 2, [4, 30][i % 2])) for i in range(24)]
    got = [(r.a_id, r.b_id) for r in coverings.intersecting(with_boxes(spark, a), with_boxes(spark, b), "id", "id", 3).collect()]
    rings = lambda t: rings_of(from_wkt_text(t))
    assert sorted(got) == sorted((i, j) for i, s in a for j, t in b if combined([rings(s)], [rings(t)], "intersection"))
    made = []
    monkeypatch.setattr(coverings, "stored", lambda df, name, f=coverings.stored: made.append(name) or f(df, name))
    small = [r for i, r in enumerate(a) if i % 3 == 1]
    coverings.intersecting(with_boxes(spark, small), with_boxes(spark, small), "id", "id")
    assert bool(made) == (few < 5)


STATUS = "property_id string, status string, updated_at timestamp"


def test_status_survives_a_restart_and_compaction(spark, tmp_path):
    import datetime
    import glob
    import os

    rng = random.Random(9)
    day = datetime.datetime(2024, 1, 1)
    source, path, mark = (str(tmp_path / n) for n in ("in", "status", "mark"))
    want, sizes = {}, []
    schema = spark.createDataFrame([], STATUS).schema
    for batch in range(5):
        rows = [(f"p{rng.randrange(40)}", f"s{batch}-{i}", day + datetime.timedelta(minutes=rng.randrange(10_000))) for i in range(30)]
        rows += [(None, "x", day), ("p1", None, None), (f"q{batch}", None, day)]
        if batch == 0:
            rows += [(f"old{i}", "s", day) for i in range(5000)]  # a large state that later batches don't touch
        for k, s, t in rows:
            if k and t and (k not in want or t > want[k][1]):
                want[k] = (s, t)
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(STATUS).parquet(source)
        q = status.latest_status(stream, path, mark)  # each time a new query on the same checkpoint
        q.awaitTermination()
        assert q.exception() is None
        sizes.append(sum(os.path.getsize(f) for f in glob.glob(f"{path}/delta/batch={batch:010d}/*.parquet")))
        if batch in (1, 3):
            assert status.compact(spark, path, schema) == batch
            assert status.compact(spark, path, schema) == batch
        got = {r.property_id: (r.status, r.updated_at) for r in status.current(spark, path, schema).collect()}
        assert {k: t for k, (_, t) in got.items()} == {k: t for k, (_, t) in want.items()}
    assert max(sizes[1:]) < sizes[0] / 3
    assert status.current(spark, str(tmp_path / "nothing"), schema).count() == 0
    assert len(glob.glob(f"{path}/base/*")) == 2 and len(glob.glob(f"{path}/delta/*")) == 3

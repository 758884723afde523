"""Pair features, matchers, zones, rasters and shapes of several rings against brute force."""

import difflib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmesh.functions import geometry as geo
from landmesh.functions import shapes
from landmesh.operators import model, pixels, zones
from landmesh.plans import parts
from landmesh.plans import queries as land
from landmesh.plans.fixtures import fixture, properties

SF = "/root/testdata/sf0.001"


def similarity(a, b):
    x, y = (a or "").strip(), (b or "").strip()
    if not x or not y:
        return 0.5
    try:
        p, q = float(x.replace(",", "")), float(y.replace(",", ""))
        top = max(abs(p), abs(q))
        return 1.0 if not top else max(0.0, 1 - abs(p - q) / top)
    except ValueError:
        pass
    x, y = x.lower(), y.lower()
    return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()


def attributes(a: dict, b: dict):
    keys = [k for k in a if k in b and not k.startswith("_") and k.lower() not in ("id", "fid", "confidence", "method", "source_model")]
    return (sum(similarity(a[k], b[k]) for k in keys) / len(keys) if keys else 0.5), len(keys)


@pytest.fixture(scope="module")
def bags(spark):
    return {r.feature_id: r for r in properties(fixture(spark, SF, "features")).collect()}


def test_attribute_scores_of_all_matches(spark, bags):
    rows = land.QUERIES["i2_attribute_scores"](spark, SF).collect()
    assert len(rows) == fixture(spark, SF, "matches").count()
    for r in rows:
        other = {("owner_name" if k == "owner" else k): v for k, v in bags[r.b_id].properties.items()}
        score, n = attributes(bags[r.a_id].properties, other)
        assert r.attr_score == pytest.approx(score, abs=1e-12) and r.n_shared == n


def corner_gap(a, b):
    """Discrete Hausdorff distance of two boxes."""
    def away(x, y, r):
        if r[0] <= x <= r[2] and r[1] <= y <= r[3]:
            return min(x - r[0], r[2] - x, y - r[1], r[3] - y)
        return math.hypot(max(0, r[0] - x, x - r[2]), max(0, r[1] - y, y - r[3]))

    return max(away(x, y, q) for p, q in ((a, b), (b, a)) for x in p[::2] for y in p[1::2])


def test_pair_features_of_all_candidates(spark, bags):
    """Every feature of every pair, by hand."""
    rows = land.QUERIES["i5_pair_features"](spark, SF).collect()
    trust = {"cadastral": 0.95, "ground_truth": 0.9, "building_footprint": 0.8, "municipal_gis": 0.8, "revenue": 0.65}
    names = {"owner_sim": ["owner_name", "owner"], "survey_sim": ["survey_no"], "khata_sim": []}
    n_apart = 0
    assert rows
    for r in rows:
        a, b = bags[r.a_id], bags[r.b_id]
        boxes = [(f.x0, f.y0, f.x1, f.y1) for f in (a, b)]
        assert r.label == (a.k == b.k)
        score, n = attributes(a.properties, b.properties)
        assert r.attr_score == pytest.approx(score, abs=1e-12) and r.n_shared == n
        if a.is_polygon and b.is_polygon:
            n_apart += 1
            assert r.hausdorff_m == pytest.approx(corner_gap(*boxes), abs=1e-9)
            size = [(x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in boxes]
            assert r.area_ratio == pytest.approx(min(size) / max(size)) and r.is_point_pair == 0
            round_ = [4 * math.pi * s / (2 * (x1 - x0 + y1 - y0)) ** 2 for s, (x0, y0, x1, y1) in zip(size, boxes, strict=True)]
            assert r.compactness_diff == pytest.approx(abs(round_[0] - round_[1]))
        else:
            assert r.hausdorff_m is None and r.iou is None and r.is_point_pair == 1
        for c, keys in names.items():
            x, y = (next((f.properties[k].strip() for k in keys if (f.properties.get(k) or "").strip()), None) for f in (a, b))
            assert r[c] == (None if x is None or y is None else pytest.approx(similarity(x, y), abs=1e-12))
        both = sorted(trust[f.source_type] for f in (a, b))
        assert [r.reliability_min, r.reliability_max] == both
        assert {t for t in trust if r[f"src_{t}"] == 1} == {a.source_type, b.source_type}
    assert n_apart > 100


def labelled(spark, n: int = 1500):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        good = rng.random() < 0.5
        f = {c: None if rng.random() < 0.15 else rng.random() * (1.5 if good else 1.0) for c in model.FEATURES}
        rows.append((f"a{i}", f"b{i}", int(good), f"{'ward' if i % 2 else 'x'}-{i % 20}", None if i % 3 else 1.0, rng.random(), float(rng.randint(0, 100)), i % 50 == 0, *f.values()))
    return spark.createDataFrame(rows, "a_id string, b_id string, label int, group string, weight double, baseline double, match_score double, locked boolean, " + ", ".join(f"{c} double" for c in model.FEATURES))


def test_compiled_matcher_equals_the_pipeline(spark):
    rows = labelled(spark)
    fitted, metrics = model.train(rows, trees=6)
    by = {r.who: r for r in metrics.collect()}
    assert by["model"].auc > by["rule"].auc
    want = {r.a_id: r.p for r in model.probabilities(rows, fitted).collect()}
    got = {r.a_id: r for r in model.rescored_by_columns(rows, fitted, cut=0.0).collect()}
    assert len(got) == len(want) and max(abs(got[i].p - p) for i, p in want.items()) < 1e-9
    cut = model.rescored_by_columns(rows, fitted).collect()
    same = model.rescored(rows, fitted).collect()
    assert Counter((r.a_id, r.match_score, r.geo_score) for r in cut) == Counter((r.a_id, r.match_score, r.geo_score) for r in same)
    assert all(r.p >= 0.5 or r.locked for r in cut) and len(cut) < len(want)
    assert model.promote(metrics, None) and model.promote(metrics, metrics)
    better = metrics.withColumn("f1", F.col("f1") + 0.01)
    assert not model.promote(metrics, better) and model.promote(metrics, better, forced=True)
    again = model.refit(rows, trees=3)
    assert model.probabilities(rows, again).filter("p between 0 and 1").count() == len(want)
    back = rows.select("a_id", model.from_snapshot(model.snapshot()).alias("v"), *model.FEATURES).limit(50).collect()
    for r in back:
        assert r.v == [None if r[c] is None else pytest.approx(r[c], abs=1e-5) for c in model.FEATURES]


def test_zones_are_even_and_compact(spark):
    rng = random.Random(8)
    spots = [(rng.gauss(*c), rng.gauss(*d)) for c, d, n in (((0, 5), (0, 5), 400), ((100, 20), (50, 20), 150), ((30, 1), (90, 1), 53)) for _ in range(n)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([*spots, (None, 1.0), *spots[:3]])], "id int, x double, y double")
    at = zones.centres(points, 7)
    out = zones.balanced(points, at).collect()
    count = Counter(r.zone for r in out if r.x is not None)
    n = len(spots) + 3
    assert len(out) == n + 1 and [count[z] for z in range(1, 8)] == [n // 7 + (z <= n % 7) for z in range(1, 8)]
    assert [r.zone for r in out if r.x is None] == [None]
    cost = sum((r.x - at[r.zone - 1][0]) ** 2 + (r.y - at[r.zone - 1][1]) ** 2 for r in out if r.zone)
    mixed = [((x - at[i % 7][0]) ** 2 + (y - at[i % 7][1]) ** 2) for i, (x, y) in enumerate(spots)]
    assert cost < sum(mixed) / 2
    plain = zones.balanced(points, at, [0.0] * 7)  # without prices the repair alone makes them even
    assert Counter(r.zone for r in plain.collect() if r.x is not None) == count


def test_names_of_zones(spark):
    middles = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 0.0), (4, 21.0, 0.0)], "zone int, x double, y double")
    places = spark.createDataFrame([("Far", 1, 3.0, 0.0, 1), ("Near", 2, 0.1, 0.0, 1), ("B", 2, 9.0, 0.0, 2), ("A", 2, 11.0, 0.0, 2), ("C", 1, 22.0, 0.0, None), (None, 1, 20.0, 0.0, 3)], "name string, rank int, x double, y double, zone int")
    assert [r.name for r in zones.named(middles, places).orderBy("zone").collect()] == ["Far", "A", "C", "C 2"]
    assert [r.name for r in zones.named(middles, places.limit(0)).orderBy("zone").collect()] == ["Ward", "Ward 2", "Ward 3", "Ward 4"]


def opened_by_hand(grid: dict, size: int, first, then) -> dict:
    half = size // 2
    near = lambda g, p, f: f(v for q, v in g.items() if abs(q[0] - p[0]) <= half and abs(q[1] - p[1]) <= half)
    once = {p: near(grid, p, first) for p in grid}
    return {p: near(once, p, then) for p in grid}


@pytest.mark.parametrize("size", [1, 3, 5, 9, 41])
def test_opening_at_borders_and_any_size(spark, size):
    rng = random.Random(size)
    grid = {(r, c): float(rng.randint(0, 20)) for r in range(-3, 9) for c in range(5, 19)}
    df = spark.createDataFrame([(1, r, c, v) for (r, c), v in grid.items()], "raster_id int, row int, col int, v double")
    got = {(r.row, r.col): r.v for r in pixels.opened(df, "v", size).collect()}
    assert got == opened_by_hand(grid, size, min, max)


def test_opening_of_a_raster_with_holes(spark):
    """One axis after the other over the places that are there."""
    rng = random.Random(3)
    grid = {(r, c): float(rng.randint(0, 9)) for r in range(9) for c in range(9) if rng.random() < 0.9 and r != 4}
    df = spark.createDataFrame([(1, r, c, v) for (r, c), v in grid.items()], "raster_id int, row int, col int, v double")
    got = {(r.row, r.col): r.v for r in pixels.opened(df, "v", 3).collect()}
    assert set(got) == set(grid)
    assert all(got[p] <= v for p, v in grid.items())
    assert got == opened_by_hand(grid, 3, min, max)


RINGS = {
    "bow tie and a square": ("POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0), (20 0, 21 0, 21 1, 20 1, 20 0))", True, 51.0),
    "multipolygon with a bow tie": ("MULTIPOLYGON (((0 0, 2 2, 2 0, 0 2, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))", True, 3.0),
    "hole that leaves its shell": ("POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", True, 27.0),
    "parts that overlap": ("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((2 2, 6 2, 6 6, 2 6, 2 2)))", True, 24.0),
    "courtyard": ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))", False, 72.0),
    "parts that touch": ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((2 2, 4 2, 4 4, 2 4, 2 2)))", False, 8.0),
    "hole that touches": ("POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0), (0 3, 2 2, 2 4, 0 3))", False, 34.0),
    "bow tie": ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", True, 2.0),
}


@pytest.mark.parametrize("name", RINGS)
def test_faults_of_shapes_with_several_rings(spark, name):
    wkt, bad, area = RINGS[name]
    for dx, dy in ((0.0, 0.0), (740_000.125, 1_950_000.5)):
        g = geo.from_wkt_text(wkt)
        g |= {"xs": [x + dx for x in g["xs"]], "ys": [y + dy for y in g["ys"]]} | {k: float(g[k]) + d for k, d in (("xmin", dx), ("xmax", dx), ("ymin", dy), ("ymax", dy))}
        r = spark.createDataFrame([(g,)], "g struct<dim:int,xs:array<double>,ys:array<double>,offs:array<int>,xmin:double,ymin:double,xmax:double,ymax:double>").select(shapes.checked("g").alias("m")).first().m
        assert (r.was_invalid, r.area) == (bad, pytest.approx(area, abs=1e-6))
        assert not shapes.crosses(geo.rings_of(r.asDict()))


def test_parts_are_written_as_parts():
    """What is written is read back with the same area; holes stay with their part."""
    two = "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 3 6, 6 6, 6 3, 3 3)), ((20 0, 21 0, 21 1, 20 1, 20 0)))"
    g = geo.from_wkt_text(two)
    text, data = geo.to_wkt_text(g), geo.to_wkb_bytes(g)
    assert text.startswith("MULTIPOLYGON (((") and text.count("))") == 2 and data[1] == 6
    for back in (geo.from_wkt_text(text), geo.from_wkb_bytes(data)):
        assert geo.ring_measures(geo.rings_of(back))[0] == 73 and len(back["offs"]) == 3
    assert geo.to_wkt_text(geo.from_wkt_text("MULTIPOINT ((1 2), (3 4))")) == "MULTIPOINT ((1.0 2.0), (3.0 4.0))"
    assert geo.to_wkt_text(geo.from_wkt_text("POINT (1 2)")) == "POINT (1.0 2.0)"
    assert geo.to_wkt_text(None) is None and np.frombuffer(geo.to_wkb_bytes(geo.from_wkt_text("POINT (1 2)"))[5:]).tolist() == [1, 2]


def test_training_rows_take_no_similarities(spark, monkeypatch):
    """h3 asks for few columns: what is written for it are the pairs, and they only."""
    names = []
    for module in (land.matching, land.model):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: names.append((name, len(df.columns))) or f(df, name))
    assert parts.h3_training_rows(spark, SF).count() > 0
    assert [n for n, _ in names] == ["pairs"]
    names.clear()
    assert "a_properties" not in land._training_rows(spark, SF).columns
    assert names[-1] == ("labelled", 7 + len(land.model.FEATURES))

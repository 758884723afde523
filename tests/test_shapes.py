"""Shapes against the areas of the overlay kernel, and their use in repair, dissolving, gaps and export."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmesh.functions import shapes
from landmesh.functions.geometry import from_wkt, overlay_areas, ring_measures, rings_of
from landmesh.functions.scoring import RELIABILITY
from landmesh.operators import matching, normalize, topology
from landmesh.sources import sinks

TURN = np.array([[0.6, 0.8], [-0.8, 0.6]])


def box(x, y, w, h, turn=False):
    p = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], dtype=float)
    return [p @ TURN if turn else p]


def text(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r.tolist()) + ")" for r in rings) + ")"


def table(spark, rows):
    f = spark.createDataFrame([(1, k, text(r)) for k, r in rows], "ward int, feature_id string, wkt string").withColumn("geom", from_wkt("wkt")).drop("wkt")
    return f.select("*", *(F.col(f"geom.{v}{m}").alias(f"{v}{i}") for v in ("x", "y") for m, i in (("min", 0), ("max", 1))))


@pytest.mark.parametrize("seed", range(30))
def test_areas_follow_the_overlay(seed):
    rng = np.random.default_rng(seed)

    def polygon():
        n = rng.integers(3, 9)
        p = rng.random((n, 2)) * 100 + [740000, 1950000] if seed % 3 else rng.integers(0, 6, (n, 2)).astype(float)
        return [np.concatenate([p, p[:1]])]

    a, b = polygon(), polygon()
    both, only_a, only_b = overlay_areas(a, b)
    for rule, want in (("intersection", both), ("difference", only_a), ("union", both + only_a + only_b)):
        got = shapes.combined([a], [b], rule)
        assert sum(map(shapes.signed_area, got)) == pytest.approx(want, abs=1e-5)
        assert overlay_areas(got, [])[1] == pytest.approx(want, abs=1e-5)  # no ring counts twice
        assert sum(map(len, shapes.parts_of(got))) == len(got)


def test_borders_vanish_in_a_union():
    for turn in (False, True):
        tiles = [box(740000 + 20 * (i % 8), 1950000 + 25 * (i // 8), 20, 25, turn) for i in range(64)]
        (ring,) = shapes.combined(tiles, [], "union")
        assert len(ring) == 5
        assert ring_measures([ring])[:2] == pytest.approx((64 * 500, 2 * (160 + 200)))
        framed = shapes.combined(tiles, [tiles[27]], "difference")
        assert [len(p) for p in shapes.parts_of(framed)] == [2]


def test_nothing_left_and_odd_rings():
    a = box(0, 0, 1, 1)
    assert shapes.combined([a], [a], "difference") == []
    assert shapes.combined([], [], "union") == []
    assert shapes.combined([[np.zeros((1, 2))]], [a], "intersection") == []
    assert shapes.combined([[np.array([(0, 0), (1, 1), (2, 2), (0, 0)], dtype=float)]], [], "union") == []  # a line
    assert shapes.to_geojson_text(None) is None


def test_columns_of_empty_and_null(spark):
    f = table(spark, [("a", box(0, 0, 2, 2)), ("b", box(5, 5, 1, 1))])
    r = f.crossJoin(f.select(F.col("geom").alias("g"))).filter("geom.xmin = 0 and g.xmin = 5").select(shapes.intersection("geom", "g").alias("i"), shapes.union("geom", "g").alias("u"), shapes.difference(F.when(F.lit(False), F.col("geom")), F.col("g")).alias("n")).first()
    assert r.i is None or r.i.xs is None
    assert r.n is None or r.n.xs is None
    assert len(json.loads(shapes.to_geojson_text(r.u.asDict()))["coordinates"]) == 2


def test_repair_and_dissolve(spark):
    rows = [("s", "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", 4326, {"b": "2"})]
    f = spark.createDataFrame(rows, "source_id string, wkt string, srid int, properties map<string,string>").withColumn("geom", from_wkt("wkt")).drop("wkt")
    r = normalize.normalized(f)[0].first()
    assert (r.was_invalid, round(r.area, 9), round(r.x, 9), len(r.geom.offs)) == (True, 2.0, 1.0, 2)
    tiles = table(spark, [(str(i), box(400 * (i % 5), 300 * (i // 5), 400, 300, True)) for i in range(25)])
    for rounds in (0, 3):
        (d,) = shapes.dissolved(tiles, ["ward"], rounds=rounds).collect()
        assert ring_measures(rings_of(d.geom.asDict()))[:2] == pytest.approx((25 * 120000, 2 * (2000 + 1500)))


def test_gaps_and_fixes_of_polygons(spark):
    for turn in (False, True):
        # b stands 0.4 from a, c overlaps b by 1, and d fills a part of the strip between a and b
        f = table(spark, [("a", box(0, 0, 10, 10, turn)), ("b", box(10.4, 0, 10, 20, turn)), ("c", box(19.4, 0, 10, 20, turn)), ("d", box(10, 0, 0.4, 4, turn))])
        found = topology.polygon_gaps(f).collect()
        got = {tuple(r.feature_ids): r for r in found}
        assert set(got) == {("a", "b")}
        r = got["a", "b"]
        assert (r.issue_type, r.fix.target) == ("sliver", "a")
        assert r.measure == pytest.approx(0.4 * 6)
        issues = topology.findings(f).filter("issue_type in ('overlap', 'sliver')").withColumn("status", F.lit("accepted"))
        areas = {r.feature_id: ring_measures(rings_of(r.geom.asDict()))[0] for r in topology.fixed(f, issues).collect()}
        assert areas == {k: pytest.approx(v) for k, v in {"a": 102.4, "b": 180.0, "c": 200.0, "d": 1.6}.items()}


def test_a_strip_along_several_neighbours_is_one_finding(spark):
    for turn in (False, True):
        # a faces b and c over one strip; d and e have one of their own
        f = table(spark, [("a", box(0, 0, 20, 10, turn)), ("b", box(0, 10.4, 10, 10, turn)), ("c", box(10, 10.4, 10, 10, turn)), ("d", box(50, 0, 10, 10, turn)), ("e", box(60.8, 0, 10, 10, turn))])
        assert len(topology.polygon_gaps(f).collect()) == 3
        got = {tuple(r.feature_ids): r for r in topology.whole_gaps(f).collect()}
        assert set(got) == {("a", "b", "c"), ("d", "e")}
        r = got["a", "b", "c"]
        assert (r.issue_type, r.fix.target, round(r.measure, 6)) == ("sliver", "a", 8.0)
        assert got["d", "e"].measure == pytest.approx(8.0)
    assert topology.whole_gaps(f.limit(1)).count() == 0


def test_export_keeps_shape_and_types(spark):
    f = table(spark, [("a", box(0, 0, 10, 10, True))])
    g = f.select(F.col("feature_id").alias("cluster"), F.create_map(F.lit("o"), F.lit('R"ao')).alias("attributes"), F.create_map(F.lit("o"), F.lit("revenue")).alias("provenance"), F.lit(None).cast("double").alias("confidence"), F.lit(2).alias("conflict_count"), F.struct("x0", "y0", "x1", "y1", F.col("geom").alias("shape")).alias("geom"))
    line = json.loads(sinks.geojson_lines(g).first().value)
    assert line["properties"] == {"o": 'R"ao', "_provenance": {"o": "revenue"}, "_confidence": None, "_conflict_count": 2}
    assert len(line["geometry"]["coordinates"][0]) == 5
    assert [0.0, 0.0] in line["geometry"]["coordinates"][0]
    bare = json.loads(sinks.geojson_lines(g.withColumn("attributes", F.create_map().cast("map<string,string>")).withColumn("geom", F.col("geom").dropFields("shape"))).first().value)
    assert set(bare["properties"]) == {"_provenance", "_confidence", "_conflict_count"}


def test_golden_record_keeps_the_most_reliable_shape(spark):
    f = table(spark, [("a", box(0, 0, 10, 10, True)), ("b", box(1, 0, 10, 10, True))])
    f = f.withColumns({"source_type": F.when(F.col("feature_id") == "a", "building_footprint").otherwise("cadastral"), "is_polygon": F.lit(True), "properties": F.create_map(F.lit("o"), F.col("feature_id"))})
    m = spark.createDataFrame([("a", "b", 1, 0.8, 90.0)], "a_id string, b_id string, ward int, iou double, match_score double")
    found = spark.createDataFrame([], "a_id string, b_id string, status string")
    (g,) = matching.golden_records(m, f, found).collect()
    best = max(("building_footprint", "cadastral"), key=lambda t: RELIABILITY[t])
    want = {"building_footprint": "a", "cadastral": "b"}[best]
    assert g.geom.feature_id == want
    assert g.geom["shape"].xs == f.filter(F.col("feature_id") == want).first().geom.xs

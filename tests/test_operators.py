"""Matching, clusters, changes, pixels and files on small cases and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from landmesh.operators import changes, matching, pixels, quality, spatial, stats
from landmesh.sources import readers, sinks
from landmesh.streaming import feeds

EDGE = "a_id string, b_id string, a_source string, b_source string, match_score double, locked boolean"


def greedy(rows):
    used, out = set(), set()
    for a, b, sa, sb, score, locked in sorted(rows, key=lambda r: (not r[5], -r[4], r[0], r[1])):
        if (a, sb) not in used and (b, sa) not in used:
            used |= {(a, sb), (b, sa)}
            out.add((a, b))
    return out


def test_one_to_one_is_the_greedy_result(spark):
    rng = random.Random(5)
    rows = []
    for a in range(30):
        for b in rng.sample(range(30), 6):
            rows.append((f"a{a}", f"b{b}", f"s{a % 2}", f"t{b % 2}", float(rng.randint(1, 12)), rng.random() < 0.05))
    got = {(r.a_id, r.b_id) for r in matching.one_to_one(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == greedy(rows)


def test_one_to_one_per_source(spark):
    rows = [("c1", "m1", "c", "m", 90.0, False), ("c1", "m2", "c", "m", 80.0, False), ("c1", "r1", "c", "r", 70.0, False), ("c2", "m1", "c", "m", 60.0, True)]
    got = {(r.a_id, r.b_id) for r in matching.one_to_one(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {("c2", "m1"), ("c1", "m2"), ("c1", "r1")}


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y"), ("x", "z"), ("x", "y")]
    got = {r.node: r.cluster for r in matching.components(spark.createDataFrame(edges, "a_id string, b_id string")).collect()}
    assert set(got.values()) == {"n00", "x"}
    assert len(got) == 24


def test_large_boxes_meet_small_ones(spark):
    boxes = [("big", 0.0, 0.0, 10_000.0, 10_000.0), ("a", 5.0, 5.0, 6.0, 6.0), ("b", 9_990.0, 10_000.0, 10_010.0, 10_020.0), ("far", 20_000.0, 0.0, 20_001.0, 1.0), ("none", None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(0, *b) for b in boxes], "ward int, feature_id string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.a_feature_id, r.b_feature_id) for r in spatial.box_pairs(df, df, ["ward"]).filter("a_feature_id < b_feature_id").collect())
    assert got == [("a", "big"), ("b", "big")]


def test_changes(spark):
    schema = "ward int, feature_id string, x0 double, y0 double, x1 double, y1 double, height double, confidence double"
    old = [("same", 0, 10, 3), ("gone", 20, 30, 3), ("up", 40, 50, 3), ("grow", 60, 70, 3)]
    new = [("same2", 0, 10.5, 3, 0.9), ("up2", 40, 50, 9, 0.9), ("grow2", 60, 75, 3, None), ("new", 80, 90, 3, 0.0), ("tiny", 95, 95.5, 3, 0.9)]
    a = spark.createDataFrame([(0, i, float(x), 0.0, float(y), 10.0, float(h), None) for i, x, y, h in old], schema)
    b = spark.createDataFrame([(0, i, float(x), 0.0, float(y), 10.0, float(h), c) for i, x, y, h, c in new], schema)
    got = {(r.change_type, r.baseline_id, r.current_id): r.confidence for r in changes.detect_changes(a, b).collect()}
    assert set(got) == {("new_structure", None, "new"), ("demolished", "gone", None), ("vertical_extension", "up", "up2"), ("extension", "grow", "grow2")}
    assert got["new_structure", None, "new"] == 0.85
    assert got["demolished", "gone", None] == 0.8


def test_completeness_and_scores(spark):
    bags = [{"parcel_id": "1", "owner": "a"}, {"parcel_id": "1", "owner": ""}, {"parcel_id": "2", "owner": "b", "_x": "y"}]
    f = spark.createDataFrame([("s", b, False, 0.0, 0.0, 1.0, 1.0) for b in bags], "source_id string, properties map<string,string>, was_invalid boolean, x0 double, y0 double, x1 double, y1 double")
    sources = spark.createDataFrame([("s", 1, "EPSG:4326", None)], "source_id string, ward int, crs string, captured_at date")
    issues = spark.createDataFrame([("s", "open"), ("s", "fixed")], "source_id string, status string")
    wards = spark.createDataFrame([(1, None, None, None, None)], "ward int, west double, south double, east double, north double")
    r = quality.source_cards(f, sources, issues, wards, F.lit("2024-01-01").cast("date")).first()
    assert (r.duplicates, r.open_issues, r.n) == (1, 1, 3)
    assert abs(r.complete - 5 / 6) < 1e-12
    assert {c.key: c.value for c in r.checks}["topology"] == 0.5


def test_metrics_of_a_perfect_and_a_useless_score(spark):
    rows = [("good", i % 2, float(i % 2)) for i in range(10)] + [("flat", i % 2, 0.5) for i in range(10)] + [("one", 1, 0.7)]
    got = {r.g: r for r in stats.classifier_metrics(spark.createDataFrame(rows, "g string, label int, p double"), ["g"]).collect()}
    assert (got["good"].auc, got["good"].f1, got["good"].brier) == (1.0, 1.0, 0.0)
    assert got["flat"].auc == 0.5
    assert got["one"].auc is None


def test_pages_and_order(spark):
    df = spark.createDataFrame([("10",), ("2",), ("x",), ("1a",)], "id string")
    assert [r.id for r in df.orderBy(*stats.natural_order(df, "id")).collect()] == ["1a", "2", "10", "x"]
    page = stats.page(df, "id", limit=2, offset=1).collect()
    assert [(r.id, r.number_matched) for r in page] == [("1a", 4), ("2", 4)]
    with pytest.raises(ValueError):
        stats.in_box(df, 2, 0, 1, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"k":"v","n":2}},{"type":"Feature","geometry":null,"properties":{}}]}')
    rows = readers.geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert [(r.crs, r.geom.dim, r.properties) for r in rows] == [("EPSG:4326", 2, {"k": "v", "n": "2"})]
    (tmp_path / "p.csv").write_text("﻿khata_no, LNG ,Latitude,owner\n1,83.1,17.7,Rao\n2,,17.8,Das\n3,x,1,\n", encoding="utf-8")
    rows = readers.csv_points(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.x, r.y, r.properties) for r in rows] == [(83.1, 17.7, {"khata_no": "1", "owner": "Rao"})]
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="coordinate columns"):
        readers.csv_points(spark, str(tmp_path / "q.csv"))
    (tmp_path / "w.gpx").write_text('<gpx><wpt lat="17.7" lon="83.2"><name>G1</name><ele>12.5</ele><desc>post</desc></wpt></gpx>')
    r = readers.gpx(spark, str(tmp_path / "w.gpx")).first()
    assert (r.x, r.y, r.name, r.ele, r.description) == (83.2, 17.7, "G1", 12.5, "post")
    (tmp_path / "m.json").write_text('{"ward_id":"4","files":[{"path":"a.csv","type":"revenue"},{"path":"b.csv","type":"revenue"}]}')
    done = spark.createDataFrame([("4", "a.csv")], "ward_id string, path string")
    assert [r.path for r in readers.manifest(spark, str(tmp_path / "m.json"), done).collect()] == ["b.csv"]
    (tmp_path / "l.geojsonl").write_text('{"geometry":{"type":"Point","coordinates":[83.2,17.7]},"properties":{"c":"1"}}\n{"geometry":{"type":"Point","coordinates":[1,1]},"properties":{}}\n')
    rows = readers.geojson_lines(spark, str(tmp_path / "l.geojsonl"), (83, 17, 84, 18)).collect()
    assert [(r.geom.xs, r.properties) for r in rows] == [([83.2], {"c": "1"})]


def test_sinks(spark):
    g = spark.createDataFrame([("h1", {"owner": "Rao"}, {"owner": "revenue"}, 0.9, 0, (0.0, 0.0, 1.0, 1.0)), ("h2", {"area": "5"}, {"area": "cadastral"}, None, 1, (0.0, 0.0, 1.0, 1.0))], "cluster string, attributes map<string,string>, provenance map<string,string>, confidence double, conflict_count int, geom struct<x0:double,y0:double,x1:double,y1:double>")
    rows = {r.hp_id: r for r in sinks.flat(g).collect()}
    assert (rows["h1"].owner, rows["h1"].area, rows["h2"].confidence) == ("Rao", "", 0.0)
    assert '"_conflict_count":0' in sinks.geojson_lines(g).orderBy("value").collect()[1].value


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, 3, "2024-01-01 10:00:00", 0.5), (2, 3, "2024-01-02 10:00:00", 1.0), (3, 3, "2024-02-20 00:00:00", 1.0)]
    spark.createDataFrame(rows, "id int, ward int, t string, confidence double").select("id", "ward", F.col("t").cast("timestamp").alias("detected_at"), "confidence").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = feeds.rolling_detections(stream).writeStream.format("memory").queryName("rolling").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = spark.table("rolling").filter("n = 2").collect()
    assert len(got) == 6
    assert {r.mean_confidence for r in got} == {0.75}


def test_pixel_regions(spark):
    px = spark.range(40 * 40).select(F.lit(1).alias("raster_id"), (F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).alias("col"))
    u = (F.col("col").isin(5, 6, 20, 21) & F.col("row").between(5, 20)) | (F.col("row").isin(21, 22) & F.col("col").between(7, 19))
    px = px.withColumn("dtm", F.lit(1.0)).withColumn("dsm", F.when(u, 7.0).when(F.col("row") == 0, float("nan")).otherwise(1.0))
    got = pixels.regions(pixels.height_mask(px)).collect()
    assert [(r.n_pixels, r.mean_height) for r in got] == [(16 * 4 + 26, 6.0)]


def test_arriving_files_are_normalised_once(spark, tmp_path):
    """Features of new files are moved, repaired and appended by ward; tiles get their flag."""
    from landmesh.functions.geometry import from_wkt
    from landmesh.operators.normalize import normalized

    schema = "source_id string, ward int, wkt string, srid int, properties map<string,string>"
    normal = lambda df: normalized(df.withColumn("geom", from_wkt("wkt")).drop("wkt"), 32644)[0].select("source_id", "ward", "area", "was_invalid", "properties")
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i, wkt in enumerate(("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))")):
        spark.createDataFrame([(f"s{i}", i, wkt, 32644, {"n": str(i)}), (f"s{i}", i, None, 32644, {})], schema).coalesce(1).write.mode("append").parquet(src)
        feeds.append_normalized(spark.readStream.schema(schema).parquet(src), normal, out, mark).awaitTermination(120)
    got = sorted((r.source_id, r.ward, round(r.area, 6), r.was_invalid) for r in spark.read.parquet(out).collect())
    assert got == [("s0", 0, 2.0, True), ("s1", 1, 16.0, False)]
    tiles = spark.createDataFrame([(49.9,), (50.0,), (None,)], "confidence double")
    assert [r.buffered for r in feeds.flagged_tiles(tiles).collect()] == [True, False, None]


def test_synthetic_pairs_follow_from_their_numbers(spark):
    from landmesh.operators.model import synthetic_pairs

    rows = synthetic_pairs(spark, 20).collect()
    again = {r.feature_id: r for r in synthetic_pairs(spark, 25).repartition(7).collect()}
    assert len(rows) == len({r.feature_id for r in rows}) and all(again[r.feature_id] == r for r in rows)
    of = {t: [r for r in rows if r.source_type == t] for t in ("cadastral", "municipal_gis", "building_footprint", "revenue")}
    assert len(of["cadastral"]) == 20 * 12
    for t, least in (("municipal_gis", 0.8), ("building_footprint", 0.8), ("revenue", 0.85)):
        assert 240 * least < len(of[t]) < 240
    for r in of["building_footprint"]:
        assert any(p.block == r.block and p.plot == r.plot and p.x0 <= r.x0 <= r.x1 <= p.x1 for p in of["cadastral"])


def test_tables_between_rounds_are_dropped(spark):
    from pathlib import Path

    folder = Path(matching.shared_root(spark).removeprefix("file://"))
    of = lambda name: {p.name for p in folder.glob(f"{name}-*")}
    stars, pairs = of("stars"), of("pairs")
    edges = spark.createDataFrame([(f"a{i}", f"b{j}", "s", "t", 50.0 + i * j % 7, False) for i in range(6) for j in range(i, i + 3)], "a_id string, b_id string, a_source string, b_source string, match_score double, locked boolean")
    nodes = matching.components(edges)
    assert nodes.select("cluster").distinct().count() == 1
    assert len(of("stars") - stars) == 1
    kept = matching.one_to_one(edges)
    assert kept.columns == ["a_id", "b_id", "a_source", "b_source", "match_score", "locked"]
    assert 0 < kept.count() <= 6
    assert not of("pairs") - pairs


def test_golden_records_without_attributes(spark):
    f = spark.createDataFrame([(k, 1, t, True, 0.0, 0.0, 1.0, 1.0) for k, t in (("a", "cadastral"), ("b", "municipal_gis"))], "feature_id string, ward int, source_type string, is_polygon boolean, x0 double, y0 double, x1 double, y1 double")
    m = spark.createDataFrame([("a", "b", 1, 0.8, 90.0)], "a_id string, b_id string, ward int, iou double, match_score double")
    (g,) = matching.golden_records(m, f, spark.createDataFrame([("a", "b", "open")], "a_id string, b_id string, status string")).collect()
    assert (g.cluster, g.n_members, g.confidence, g.conflict_count) == ("a", 2, 0.9, 1)
    assert "attributes" not in g

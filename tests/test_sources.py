"""Splitting readers, commits of files, quarantine and SQL functions."""

import gzip
import json
import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from landmesh.functions.registry import register_functions
from landmesh.sources import commits, readers, scratch, split_geojson


def collection(n: int, crs: bool, seed: int, odd: bool = True) -> str:
    """Features with quotes, brackets and backslashes in texts, nested objects that look like features, gaps."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", '{"type":"Feature"', "é", " ", ",", "日"]) for _ in range(rng.randint(0, 12)))
        geometry = None if i % 11 == 5 else {"type": "Point", "coordinates": [i / 10, rng.random()]} if i % 3 else {"type": "Polygon", "coordinates": [[[i / 10, 0], [i / 10 + 1, 0], [i / 10 + 1, 1], [i / 10, 0]]]}
        f = {"type": "Feature", "id": i, "geometry": geometry, "properties": {"t": text, "n": str(i)}}
        if odd and i % 5 == 0:
            f = {"properties": {"t": text, "n": str(i), "x": {"type": "Feature", "a": [{"type": "Feature"}]}}, "geometry": geometry, "type": "Feature", "bbox": [0, 0]}
        out.append(json.dumps(f, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
    head = {"name": "x]}\\", **({"crs": {"type": "name", "properties": {"name": "EPSG:32644"}}} if crs else {}), "list": [{"no": "feature"}]}
    return '{"type": "FeatureCollection", ' + json.dumps(head)[1:-1] + ', "features": [\n' + " ,\n".join(out) + "], \"last\": {\"a\": 1}}"


@pytest.mark.parametrize("size", [97, 400, 5000, 1 << 20])
def test_split_reader_equals_the_plain_one(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(split_geojson, "AHEAD", 50)
    for name, text in (("a", collection(60, True, 1)), ("b", collection(7, False, 2)), ("lone", '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"n":"one"}}'), ("none", '{"type":"FeatureCollection","features":[]}'), ("empty", "")):
        (tmp_path / f"{name}.geojson").write_text(text)
    if size < 400:  # a name of a coordinate system has to lie in one range
        (tmp_path / "a.geojson").write_text(collection(60, False, 1))
    files = [str(tmp_path / f"{n}.geojson") for n in ("a", "b", "lone", "none", "empty")]
    key = lambda r: (r.crs, r.properties["n"], r.properties.get("t"), r.geom.xs, r.geom.ys)
    got = split_geojson.split_geojson(spark, files, size=size).collect()
    want = readers.geojson(spark, str(tmp_path / "*.geojson")).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    few = split_geojson.split_geojson(spark, files, (0.95, 0.0, 2.05, 1.0), size).collect()
    assert sorted(map(key, few)) == sorted(key(r) for r in want if 0.95 <= r.geom.xs[0] <= 2.05 and 0 <= r.geom.ys[0] <= 1)


def test_files_are_committed_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("ward"))
    failing = rows.withColumn("k", F.when(F.col("k") == 77, F.raise_error(F.lit("midway")).cast("long")).otherwise(F.col("k")))
    assert commits.committed(spark, path, rows.schema).count() == 0
    with pytest.raises(Exception, match="midway"):
        commits.commit_features(failing.repartition(5), path, "one")
    assert commits.committed(spark, path, rows.schema).count() == 0 and commits.sources(spark, path) == []
    assert commits.commit_features(rows, path, "one")
    assert not commits.commit_features(rows, path, "one")  # a replay
    assert commits.commit_features(rows.limit(5), path, "two / ü")
    with pytest.raises(ValueError, match="no features in three"):
        commits.commit_features(rows.limit(0), path, "three")
    assert commits.committed(spark, path, rows.schema).count() == 105
    assert commits.sources(spark, path) == ["one", "two / ü"]
    assert commits.vacuum(spark, path) >= 1  # Spark may have cleaned up after the failed task itself
    assert commits.committed(spark, path, rows.schema).count() == 105 and commits.vacuum(spark, path) == 0


def test_quarantine_counts_in_one_pass(spark, tmp_path):
    crs = ["EPSG:4326", "epsg:32644", "urn:ogc:def:crs:EPSG::3857", "CRS84", "", None, "EPSG:1", "nonsense", "EPSG:99999999999"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(crs)], "id int, crs string")
    seen = Observation("q")
    good, bad = readers.split_quarantine(readers.quarantined(rows, count=seen), str(tmp_path / "q"))
    assert [r.srid for r in good.orderBy("id").collect()] == [4326, 32644, 3857, 4326]
    assert [r.reason for r in bad.orderBy("id").collect()] == ["no coordinate system"] * 2 + [f"unknown coordinate system {c}" for c in crs[6:]]
    assert seen.get == {"good": 4, "bad": 5}


def test_reader_is_chosen_by_name_then_type(spark):
    rows = [("A.GeoJSON", "revenue", "geojson"), ("b.geojsonl.gz", "x", "geojson_lines"), ("c.CSV", "x", "csv_points"), ("d.gpx", "x", "gpx"), ("e.tif", "x", "raster"), ("f", "gnss_cors", "csv_points"), ("g.bin", "ori", "raster"), ("h", "cadastral", "geojson"), ("i.pdf", None, "scan")]
    got = spark.createDataFrame(rows, "path string, type string, want string").withColumn("got", readers.reader_of(F.col("path"), F.coalesce("type", F.lit("")))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_polygons_of_a_csv_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text('confidence,geometry\n0.9,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n0.5,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n,x\n0.99,broken\n')
    rows = readers.csv_wkt(spark, str(tmp_path / "f.csv")).collect()
    assert [(r.confidence, r.geom.xs) for r in rows] == [(0.9, [0.0, 1.0, 1.0, 0.0])]
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write('confidence,geometry\n0.75,"POINT (1 2)"\n')
    assert readers.csv_wkt(spark, str(tmp_path / "g.csv.gz")).count() == 1


def test_sql_functions(spark):
    names = register_functions(spark, "t_")
    assert len(names) == len(set(names)) > 20
    r = spark.sql("SELECT t_score_band(70D) AS band, t_compactness(1D, 0D) AS none, t_geom_overlay(t_geom_from_wkt('POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))'), t_geom_from_wkt('POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))')).both AS area, t_normal_name('Sy. No') AS name").first()
    assert (r.band, r.none, r.area, r.name) == ("review", None, 1.0, "syno")
    assert spark.sql("SELECT count(*) AS n FROM t_cells_of(-1D, 0D, 9D, 4D, 5D)").first().n == 3
    assert spark.sql("SELECT count(*) AS n FROM t_cells_of(null, 0D, 9D, 4D, 5D)").first().n == 0
    plan = spark.sql("SELECT t_score_band(cast(id AS double)) FROM range(3)")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan  # the optimizer sees the expression


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    def shuffled():  # on one machine the driver's block manager has all files
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before = shuffled()
    rows = scratch.written(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), str(tmp_path / "t"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(scratch.CLEANUP) == "false"
    assert rows.agg(F.sum("count")).first()[0] == 1000
    scratch.dropped(spark, [str(tmp_path / "t")])
    assert not (tmp_path / "t").exists()

"""Features of different systems end to end."""

import pytest
import numpy as np
from pyspark.sql import functions as F

from landmesh.functions.geometry import from_lonlat, from_wkt
from landmesh.operators import georef, normalize, topology


def test_normalized(spark):
    x, y = from_lonlat(83.2, 17.7, 32644)
    square = f"POLYGON (({x} {y}, {x + 10} {y}, {x + 10} {y + 10}, {x} {y + 10}, {x} {y}))"
    bow = "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"
    rows = [("s", square, 32644, {"a": "1"}), ("s", bow, 4326, {"b": "2"}), ("s", None, 4326, {"c": "3"})]
    f = spark.createDataFrame(rows, "source_id string, wkt string, srid int, properties map<string,string>").withColumn("geom", from_wkt("wkt")).drop("wkt")
    out, card = normalize.normalized(f)
    got = {r.srid: r for r in out.filter("properties['a'] = '1'").collect()}
    assert abs(got[4326].x - 83.2) < 1e-3
    r = card.first()
    assert (r.n_features, r.n_repaired, r.fields) == (2, 1, ["a", "b"])
    with pytest.raises(Exception, match="unknown coordinate system"):
        normalize.normalized(f.withColumn("srid", F.lit(1)))[0].collect()


def test_georeferencing_errors_and_outliers(spark):
    good = [(0, float(px), float(py), 83 + 0.1 * px, 17 - 0.2 * py) for px, py in [(0, 0), (10, 0), (0, 10), (10, 10)]]
    line = [(1, float(i), float(i), float(i), float(i)) for i in range(4)]
    few = [(2, 0.0, 0.0, 0.0, 0.0)]
    off = [(3, float(px), float(py), float(px), float(py) + (5.0 if k == 4 else 0.0)) for k, (px, py) in enumerate([(0, 0), (10, 0), (0, 10), (10, 10), (5, 5)])]
    points = spark.createDataFrame(good + line + few + off, "sheet_id int, px double, py double, x double, y double")
    fits = georef.fit(points)
    got = {r.sheet_id: r for r in fits.collect()}
    assert got[0].rmse < 1e-9
    assert "collinear" in got[1].error
    assert "needs 3" in got[2].error
    worst = georef.residuals(points.filter("sheet_id = 3"), fits).orderBy(F.desc("residual")).first()
    assert (worst.px, worst.py) == (5.0, 5.0)


def test_topology_decisions_and_clips(spark):
    p = spark.createDataFrame([("a", 0.0, 10.0), ("b", 9.0, 20.0)], "feature_id string, x0 double, x1 double").withColumns({"ward": F.lit(1), "y0": F.lit(0.0), "y1": F.lit(10.0)})
    issues = topology.findings(p).withColumn("issue_id", F.lit(1))
    done = topology.decided(issues, spark.createDataFrame([(1, "ignore", 1), (1, "accept", 2)], "issue_id int, action string, at int"))
    assert done.first().status == "accepted"
    got = {r.feature_id: (r.x0, r.x1) for r in topology.clip(p, done).collect()}
    assert got == {"a": (0.0, 9.0), "b": (9.0, 20.0)}
    ring = spark.createDataFrame([(1, "a", [0.0, 0.0, 5.0], [0.0, 0.01, 5.0])], "ward int, feature_id string, xs array<double>, ys array<double>")
    assert topology.duplicate_vertices(ring).first().measure == 1.0
    near = spark.createDataFrame([(1, "a", [0.0, 0.03, 0.06, 0.09, 5.0, 5.0], [0.0] * 6), (1, "b", [], []), (1, "c", None, None)], "ward int, feature_id string, xs array<double>, ys array<double>")
    got = near.select("feature_id", topology.n_repeats("xs", "ys").alias("n"), F.size(topology.without_repeats("xs", "ys")).alias("left")).collect()
    assert [(r.n, r.left) for r in got][:2] == [(3, 3), (0, 0)]


def test_sheets_of_as_many_points_are_solved_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [int(v) for v in rng.integers(2, 9, 60)]
    points = [(s, *map(float, rng.random(4) * 100)) for s, n in enumerate(sizes) for _ in range(n)]
    rows = spark.createDataFrame(points, "sheet_id int, px double, py double, x double, y double").repartition(1)
    for model, need in georef.MODELS.items():
        got = {r.sheet_id: r for r in georef.fit(rows, model).collect()}
        assert {s: r.n for s, r in got.items()} == dict(enumerate(sizes))
        for s, r in got.items():
            p = np.array([v[1:] for v in points if v[0] == s])
            if len(p) < need:
                assert (r.error, r.cx) == (f"{model} needs {need} points", None)
                continue
            u, v = (p[:, 0] - r.px0) / r.scale, (p[:, 1] - r.py0) / r.scale
            design = np.stack(georef._terms(model, u, v), axis=1)
            want, *_ = np.linalg.lstsq(design, p[:, 2:], rcond=None)
            assert np.allclose(np.array([r.cx, r.cy]).T, want, atol=1e-6)
            assert np.isclose(r.rmse, np.sqrt(((p[:, 2:] - design @ want) ** 2).sum(axis=1).mean()), atol=1e-6)
    calls = []
    monkeypatch.setattr(np.linalg, "svd", lambda *a, f=np.linalg.svd, **k: calls.append(len(a[0])) or f(*a, **k))
    georef._solved(rng.random((50, 7, 4)), "affine", True)
    assert calls == [50]

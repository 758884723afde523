"""Scores, classes, geometry and coordinates on hand-made values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landmesh.functions import geometry as geo
from landmesh.functions import scoring as sc


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_similarity(spark):
    rows = [("1,000", "1000", 1.0), ("100", "80", 0.8), ("", "x", 0.5), (None, None, 0.5), (" Rao ", "rao", 1.0), ("12/3", "12/4", 0.75), ("0", "0", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.withColumn("got", sc.value_similarity("a", "b")).collect():
        assert math.isclose(r.got, r.want), r


def test_recency_and_confidence(spark):
    day = lambda d: F.lit(d).cast("date")
    r = one(
        spark,
        new=sc.recency_score(day("2024-01-01"), day("2023-12-01"), day("2024-06-01")),
        old=sc.recency_score(day("2024-01-01"), day("2018-01-01"), day("2024-01-02")),
        none=sc.recency_score(F.lit(None).cast("date"), F.lit(None).cast("date"), day("2024-01-02")),
        one_date=sc.recency_score(F.lit(None).cast("date"), day("2023-12-01"), day("2024-01-02")),
        conf=sc.confidence(F.lit(0.95), F.lit(1.0), F.lit(0.8), F.lit(1.0)),
        score=sc.match_score(F.lit(None).cast("double"), F.lit(5.0)),
    )
    assert (r.new, r.none, r.one_date, r.conf, r.score) == (1.0, 0.8, 1.0, 94, 80.0)
    assert abs(r.old - 0.5) < 1e-3


@pytest.mark.parametrize("values, want", [((0.9, 0, 0), "ready"), ((0.9, 1, 3), "blocked_conflict"), ((0.9, 0, 1), "blocked_topology"), ((0.8, 0, 0), "low_confidence"), ((None, 0, 0), "low_confidence"), ((0.85, 0, 0), "ready")])
def test_readiness(spark, values, want):
    conf, conflicts, issues = values
    assert one(spark, r=sc.readiness(F.lit(conf).cast("double"), F.lit(conflicts), F.lit(issues))).r == want


def test_classes(spark):
    r = one(
        spark,
        sliver=sc.gap_kind(F.lit(10.0), F.lit(100.2)),
        gap=sc.gap_kind(F.lit(20.0), F.lit(42.0)),
        srid=sc.utm_srid(F.lit(83.2), F.lit(17.7)),
        south=sc.utm_srid(F.lit(83.2), F.lit(-17.7)),
        band=sc.score_band(F.lit(85)),
        key=sc.quadkey(F.lit(83.22), F.lit(17.72), 9),
        height=sc.first_number(F.create_map(F.lit("height_m"), F.lit("n/a"), F.lit("height"), F.lit("7.5"))),
        owner=sc.first_alias(F.create_map(F.lit("owner_name"), F.lit(" "), F.lit("owner"), F.lit("Rao")), "owner"),
        name=sc.normal_name(F.lit("Survey_No.")),
        alert=sc.alert_score(F.lit(250), F.lit(85), F.lit(0.05), F.lit(6)),
    )
    assert (r.sliver, r.gap, r.srid, r.south, r.band, r.height, r.owner, r.name, r.alert) == ("sliver", "gap", 32644, 32744, "auto_accept", 7.5, "Rao", "surveyno", 100)
    assert r.key == "123310330"


def test_ocr_fields(spark):
    page = "GOVT Khata No: 1024 Owner: R. Venkata Rao Survey No: 118/2 Extent: 1,250.5 sq m Village: Kommadi"
    r = one(spark, **{f: sc.ocr_field(F.lit(page), f) for f in sc.OCR_LABELS}, none=sc.ocr_field(F.lit("nothing"), "khata_no"))
    assert (r.khata_no, r.owner_name, r.survey_no, r.area, r.none) == ("1024", "R. Venkata Rao", "118/2", "1,250.5", None)


@pytest.mark.parametrize(
    "page, want",
    [
        ("REVENUE RECORD - WARD 4 Khata No: 4521/B Owner: Venkatesh Rao Survey No: 210/1 Extent: 750 sq m Village: Urban", ("4521/B", "Venkatesh Rao", "210/1", "750")),
        ("KHATHA NUMBER 12 Owner Name: K. Swathi", ("12", "K. Swathi", None, None)),
        ("Khata:77 s.y. no. 4-A Area - 1,200 Acres District X", ("77", None, "4-A", "1,200")),
        ("Sy.No 9 Name X Owner: Ann9 Owner - Lakshmi Devi Mandal M Extent 5cents", (None, "Lakshmi Devi", "9", "5")),
        ("Extent: 40 rooms Area: 4.5 Sq. M", (None, None, None, "4.5")),
        ("Khata No:", (None, None, None, None)),
        ("", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_ocr_labels_and_kinds(spark, page, want):
    """Glued numbers, signs, empty labels, values of another kind and the second label of a field."""
    r = one(spark, **{f: sc.ocr_field(F.lit(page).cast("string"), f) for f in sc.OCR_LABELS})
    assert (r.khata_no, r.owner_name, r.survey_no, r.area) == want


def box(x0, y0, x1, y1):
    return [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], dtype=float)]


coordinate = st.integers(-40, 40).map(lambda v: v / 4)


@given(st.lists(coordinate, min_size=8, max_size=8))
@settings(deadline=None, max_examples=100)
def test_rectangles_have_closed_forms(v):
    a, b = (sorted((v[0], v[1])) + sorted((v[2], v[3]))), (sorted((v[4], v[5])) + sorted((v[6], v[7])))
    both, only_a, only_b = geo.overlay_areas(box(a[0], a[2], a[1], a[3]), box(b[0], b[2], b[1], b[3]))
    shared = max(0, min(a[1], b[1]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[2], b[2]))
    assert math.isclose(both, shared, abs_tol=1e-9)
    assert math.isclose(both + only_a, (a[1] - a[0]) * (a[3] - a[2]), abs_tol=1e-9)
    assert math.isclose(both + only_b, (b[1] - b[0]) * (b[3] - b[2]), abs_tol=1e-9)


@given(st.lists(st.tuples(coordinate, coordinate), min_size=3, max_size=7), st.lists(st.tuples(coordinate, coordinate), min_size=3, max_size=7), coordinate)
@settings(deadline=None, max_examples=100)
def test_any_polygons_add_up_and_may_move(p, q, by):
    a, b = ([np.array([*r, r[0]], dtype=float)] for r in (p, q))
    both, only_a, only_b = geo.overlay_areas(a, b)
    own = geo.overlay_areas(a, [])[1]
    assert math.isclose(both + only_a, own, abs_tol=1e-6)
    moved = geo.overlay_areas([r + by for r in a], [r + by for r in b])
    assert np.allclose(moved, (both, only_a, only_b), atol=1e-6)
    assert min(both, only_a, only_b) >= 0


def test_measures_and_codecs():
    hole = geo.from_wkt_text("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))")
    area, perimeter, cx, cy = geo.ring_measures(geo.rings_of(hole))
    assert (area, perimeter) == (96.0, 48.0)
    assert geo.contains(geo.rings_of(hole), 1, 1)
    assert not geo.contains(geo.rings_of(hole), 3, 3)
    assert geo.from_wkt_text(geo.to_wkt_text(hole)) == hole
    assert geo.hausdorff(box(0, 0, 1, 1), box(0, 0, 1, 3)) == 2.0
    assert geo.from_geojson_text('{"type":"Point","coordinates":[1,2]}')["dim"] == 0
    assert geo.from_geojson_text("{") is None


@pytest.mark.parametrize("code", geo.CODES)
def test_coordinates_round_trip(code):
    lon, lat = np.array([83.2, 80.5]), np.array([17.7, 24.1])
    x, y = geo.from_lonlat(lon, lat, code)
    back = geo.to_lonlat(x, y, code)
    assert np.allclose(back[0], lon, atol=1e-6)
    assert np.allclose(back[1], lat, atol=1e-6)


def test_coordinates_are_in_range():
    x, y = geo.from_lonlat(83.2185, 17.6868, 32644)
    assert 730_000 < x < 740_000
    assert 1_950_000 < y < 1_960_000
    lon, lat = geo.to_lonlat(x, y, 24344)
    assert 50 < 111_320 * math.hypot(lon - 83.2185, lat - 17.6868) < 1500
    with pytest.raises(ValueError):
        geo.from_lonlat(1, 2, 9999)


def test_wkb_there_and_back(spark, tmp_path):
    import struct

    from landmesh.functions import geometry as g
    from landmesh.sources.readers import wkb_parquet

    for text in ("POINT (1.5 2.0)", "LINESTRING (0.0 0.0, 1.0 2.0, 3.0 1.0)", "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 0.5, 2.0 0.5, 2.0 1.0, 1.0 0.5))"):
        whole = g.from_wkt_text(text)
        assert g.to_wkt_text(g.from_wkb_bytes(g.to_wkb_bytes(whole))) == g.to_wkt_text(whole)
    big = struct.pack(">BII", 0, 1 | 0x20000000 | 0x80000000, 4326) + struct.pack(">ddd", 7, 8, 9)
    assert g.to_wkt_text(g.from_wkb_bytes(big)) == "POINT (7.0 8.0)".replace("POINT (", "POINT (")
    part = g.to_wkb_bytes(g.from_wkt_text("POLYGON ((0 0, 1 0, 1 1, 0 0))"))
    assert g.from_wkb_bytes(struct.pack("<BII", 1, 6, 2) + part + part)["offs"] == [0, 4]
    assert g.from_wkb_bytes(None) is None and g.from_wkb_bytes(b"") is None and g.from_wkb_bytes(part[:20]) is None
    box = "struct<xmin:double,xmax:double,ymin:double,ymax:double>"
    rows = [(1, bytearray(part), (0.0, 1.0, 0.0, 1.0), [("first",), ("second",)]), (2, bytearray(part), (50.0, 51.0, 0.0, 1.0), []), (3, None, (0.0, 1.0, 0.0, 1.0), None)]
    path = str(tmp_path / "layer")
    spark.createDataFrame(rows, f"id int, geometry binary, bbox {box}, sources array<struct<dataset:string>>").write.parquet(path)
    got = {r.id: r for r in wkb_parquet(spark, path, -1, -1, 2, 2).collect()}
    assert set(got) == {1, 3} and got[1].source == "first" and got[3].source is None and got[1].geom.xmax == 1.0


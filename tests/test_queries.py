"""Queries against their SQL on the smallest tables, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from landmesh.plans import parts  # noqa: F401
from landmesh.plans import queries as land
from landmesh.plans import summaries  # noqa: F401

SF = "/root/testdata/sf0.001"
FAST = ["c1_filtered", "c2_in_box", "g3_page", "e1_detection_kpis", "e2_leaderboard", "e5_profile", "e21_classifier_metrics", "d7_points_in", "d2_overlaps", "a13_upsert", "i17_ocr_fields", "e8_source_cards", "d5_encroachments", "k2_topology", "e16_recall", "f3_chosen_layer", "f4_epochs", "c3_audit", "c5_without_key", "c6_published", "g4_natural_order", "h4_missing", "d13_new_conflicts", "d15_match_details", "d17_labels", "d14_displaced", "i16_source_fields", "i4_confidence", "i7_first_alias", "i8_snapshot", "i14_utm_srid", "i19_quadkey", "i20_block_split", "i21_alerts", "f6_one_to_one", "e15_sources", "d11_issue_names", "b10_hausdorff", "b5_quarantine", "m_sql_functions", "k9_zone_names", "j2_latest_status", "e17_extraction", "i18_footprint_confidence", "k4_accept_all", "d7_points_in_polygons"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(rows, columns):
    order = sorted(columns)
    return sorted(tuple(repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in (r[c] for c in order)) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    got = land.QUERIES[name](spark, SF)
    cur = duck.execute(land.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    assert plain([r.asDict() for r in got.collect()], columns) == plain(want, columns)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 26
    assert sum(r.total for r in rows if r.ward is not None) == next(r.total for r in rows if r.ward is None)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Queries over summaries, names of dimensions, quarantine, SQL functions and compiled models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landmesh.functions import planar
from landmesh.functions import scoring as sc
from landmesh.functions.registry import register_functions
from landmesh.operators import matching, model, records, stats, topology
from landmesh.plans.fixtures import ctes, fixture, properties
from landmesh.plans.queries import _CONFLICTS, _GOLDEN, _conflicts, _features, _golden, _issues, _training_rows, query
from landmesh.sources import readers

# Sources: a layer of each ward is one; its state and date follow from the ward's number.
_SOURCES = """sources AS (SELECT source_type || '-' || ward AS source_id, 'File ' || source_type || ' ' || ward AS name, source_type, ward,
  CASE ward % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN NULL ELSE 'ready' END AS status, count(*) AS n_features FROM features GROUP BY source_type, ward)"""


def _sources(spark, sf_dir):
    state = F.when(F.col("ward") % 6 == 0, "failed").when(F.col("ward") % 6 == 1, "processing").when(F.col("ward") % 6 > 2, "ready")
    return _features(spark, sf_dir).groupBy("source_type", "ward").agg(F.count("*").alias("n_features")).select(
        F.concat_ws("-", "source_type", "ward").alias("source_id"), F.concat_ws(" ", F.lit("File"), "source_type", "ward").alias("name"), "source_type", "ward", state.alias("status"), "n_features"
    )


@query(f"{ctes('features')}, {_SOURCES} SELECT status, count(*) AS n FROM sources GROUP BY status")
def e15_sources(spark, sf_dir):
    return records.sources_by_status(_sources(spark, sf_dir))


@query(f"{ctes('matches', 'footprints_2025', 'wards')} SELECT (SELECT count(*) FROM wards) AS wards, (SELECT count(*) FROM features) AS features, (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM ({_CONFLICTS}) WHERE conflict_type IS NOT NULL) AS conflicts, (SELECT count(*) FROM footprints_2025) AS footprints")
def e15_totals(spark, sf_dir):
    names = {"wards": "wards", "features": "features", "matches": "matches", "footprints": "footprints_2025"}
    return records.totals(**{k: fixture(spark, sf_dir, v) for k, v in names.items()}, conflicts=_conflicts(spark, sf_dir))


@query(f"{ctes('matches')} SELECT count(*) AS n_records, round(avg(round(confidence, 4)), 6) AS mean_confidence, count(*) FILTER (round(confidence, 4) >= 0.85) AS n_sure, count(*) FILTER (conflict_count > 0) AS with_conflicts, sum(n_members)::BIGINT AS n_members FROM ({_GOLDEN})")
def e18_golden_kpis(spark, sf_dir):
    out = stats.golden_kpis(_golden(spark, sf_dir))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"""{ctes('features')}, {_SOURCES} SELECT count(*) AS sources, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS processing, 0::BIGINT AS needs_georef, 0::BIGINT AS pending_ocr,
  count(DISTINCT source_type) AS types_covered, 0::BIGINT AS extracted_layers, 0::BIGINT AS extracted_features, (SELECT count(*) FROM parcels WHERE k % 9 IN (0, 1)) AS open_conflicts,
  (SELECT count(*) FROM parcels WHERE k % 200 IN (7, 57, 107) AND k % 3 <> 0) AS open_issues, (SELECT round(avg(k % 101), 6) FROM parcels WHERE k % 4 = 0) AS mean_ward_score FROM sources""")
def e18_overview_kpis(spark, sf_dir):
    p = fixture(spark, sf_dir, "parcels")
    found = p.select(F.when(F.col("k") % 9 == 0, "pending").when(F.col("k") % 9 == 1, "needs_review").otherwise("resolved").alias("status"))
    reports = p.select(F.when(F.col("k") % 4 != 0, F.col("k")).alias("source_id"), (F.col("k") % 101).alias("score"))
    return stats.overview_kpis(_sources(spark, sf_dir), found, _issues(spark, sf_dir), reports).withColumn("mean_ward_score", F.round("mean_ward_score", 6))


@query(f"{ctes('features')} SELECT count(*) AS n_matches, count(*) FILTER (s >= 85) AS auto_accept, round(avg(iou), 6) AS mean_iou, round(avg(s), 6) AS mean_score, round(avg(d), 6) AS mean_dist FROM (SELECT 60 + a.k % 40 AS s, CASE WHEN a.k % 3 > 0 THEN (a.k % 16) / 16e0 END AS iou, CASE WHEN a.k % 5 > 0 THEN (a.k % 25) * 1e0 END AS d FROM parcels a)")
def e18_match_distances(spark, sf_dir):
    k = F.col("k")
    m = fixture(spark, sf_dir, "parcels").select((60 + k % 40).alias("match_score"), F.when(k % 3 > 0, (k % 16) / 16).alias("iou"), F.when(k % 5 > 0, (k % 25).cast("double")).alias("dist_m"))
    return stats.match_kpis(m).select("n_matches", "auto_accept", *(F.round(c, 6).alias(c) for c in ("mean_iou", "mean_score", "mean_dist")))


@query(f"""{ctes('features', 'wards')}, {_SOURCES} SELECT p.k AS issue_id, s.name AS source_name, s.source_type, w.name AS ward_name FROM parcels p LEFT JOIN sources s ON s.source_id = CASE WHEN p.k % 7 > 0 THEN 'cadastral-' || p.ward END LEFT JOIN wards w ON w.ward = CASE WHEN p.k % 11 > 0 THEN p.ward END WHERE p.k % 200 IN (7, 57, 107)""")
def d11_issue_names(spark, sf_dir):
    k = F.col("issue_id")
    issues = _issues(spark, sf_dir).select("issue_id", F.when(k % 7 > 0, F.concat_ws("-", F.lit("cadastral"), "ward")).alias("source_id"), F.when(k % 11 > 0, F.col("ward")).alias("ward"))
    out = records.with_ward(records.with_source(issues, _sources(spark, sf_dir)), fixture(spark, sf_dir, "wards"))
    return out.select("issue_id", "source_name", F.col("source_source_type").alias("source_type"), "ward_name")


@query(f"""{ctes('footprints_2025')}, {_SOURCES} SELECT f.feature_id, b.name AS baseline_name, c.name AS current_name FROM footprints_2025 f LEFT JOIN sources b ON b.source_id = 'building_footprint-' || f.ward LEFT JOIN sources c ON c.source_id = 'municipal_gis-' || (f.ward + 1)""")
def d11_run_names(spark, sf_dir):
    runs = fixture(spark, sf_dir, "footprints_2025").select("feature_id", F.concat_ws("-", F.lit("building_footprint"), "ward").alias("baseline_id"), F.concat_ws("-", F.lit("municipal_gis"), F.col("ward") + 1).alias("current_id"))
    s = _sources(spark, sf_dir)
    out = records.with_source(records.with_source(runs, s, "baseline_id", "baseline", ("name",)), s, "current_id", "current", ("name",))
    return out.select("feature_id", "baseline_name", "current_name")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'user' || user_id || '@example.org' END AS actor_email FROM events")
def d11_audit_actors(spark, sf_dir):
    e = fixture(spark, sf_dir, "events")
    profiles = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("profile_id"), F.concat(F.lit("user"), "user_id", F.lit("@example.org")).alias("email")).distinct()
    return records.with_actor(e.select("event_id", F.col("user_id").alias("actor_id")), profiles).select("event_id", "actor_email")


_AWAY = lambda p, b: f"CASE WHEN {p[0]} BETWEEN {b}.x0 AND {b}.x1 AND {p[1]} BETWEEN {b}.y0 AND {b}.y1 THEN least({p[0]} - {b}.x0, {b}.x1 - {p[0]}, {p[1]} - {b}.y0, {b}.y1 - {p[1]}) ELSE sqrt(pow(greatest(0, {b}.x0 - {p[0]}, {p[0]} - {b}.x1), 2) + pow(greatest(0, {b}.y0 - {p[1]}, {p[1]} - {b}.y1), 2)) END"
_HAUSDORFF = "greatest(" + ", ".join(_AWAY((f"{a}.x{i}", f"{a}.y{j}"), b) for a, b in (("a", "b"), ("b", "a")) for i in (0, 1) for j in (0, 1)) + ")"


@query(f"{ctes('matches')} SELECT m.a_id, m.b_id, round({_HAUSDORFF}, 6) AS hausdorff_m FROM matches m JOIN features a ON a.feature_id = m.a_id JOIN features b ON b.feature_id = m.b_id WHERE b.is_polygon")
def b10_hausdorff(spark, sf_dir):
    from landmesh.functions.geometry import rectangle

    side = lambda p: _features(spark, sf_dir).filter("is_polygon").select(F.col("feature_id").alias(f"{p}_id"), planar.edges(rectangle("x0", "y0", "x1", "y1")).alias(p))
    rows = fixture(spark, sf_dir, "matches").select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    return rows.select("a_id", "b_id", F.round(planar.hausdorff("a", "b"), 6).alias("hausdorff_m"))


@query(f"""{ctes('features')} SELECT feature_id, CASE WHEN k % 4 < 2 THEN 32644 WHEN k % 4 = 2 AND k % 3 > 0 THEN 4326 END AS srid, CASE WHEN k % 4 = 2 AND k % 3 = 0 THEN 'no coordinate system' WHEN k % 4 = 3 THEN 'unknown coordinate system EPSG:' || (9000 + k % 5) END AS reason FROM features""")
def b5_quarantine(spark, sf_dir):
    k = F.col("k")
    f = _features(spark, sf_dir)
    declared, embedded = F.when(k % 4 == 0, "EPSG:32644").when(k % 4 == 3, F.concat(F.lit("EPSG:"), 9000 + k % 5)).otherwise(""), F.when(k % 4 == 1, "urn:ogc:def:crs:EPSG::32644")
    rows = f.withColumn("crs", readers.resolved_crs(declared, embedded, F.when(k % 3 > 0, "geojson").otherwise("csv")))
    good, bad = readers.split_quarantine(readers.quarantined(rows.select("feature_id", "crs")), f"{matching.shared_root(spark)}/features-{uuid.uuid4().hex}")
    return good.select("feature_id", "srid", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("feature_id", F.lit(None).cast("int").alias("srid"), "reason"))


@query(f"""{ctes('matches')} SELECT a_id, b_id, CASE WHEN match_score >= 85 THEN 'auto_accept' WHEN match_score >= 60 THEN 'review' ELSE 'conflict' END AS band, CASE WHEN match_score < 40 OR coalesce(iou < 0.3e0, false) THEN 'critical' WHEN match_score < 70 THEN 'high' WHEN match_score < 90 THEN 'medium' ELSE 'low' END AS severity,
  CASE b_type WHEN 'municipal_gis' THEN 0.8e0 WHEN 'building_footprint' THEN 0.8e0 ELSE 0.65e0 END AS trust FROM matches""")
def m_sql_functions(spark, sf_dir):
    """A query in SQL over the registered functions."""
    register_functions(spark)
    return spark.sql("SELECT a_id, b_id, lm_score_band(match_score) AS band, lm_severity(match_score, 0D, iou) AS severity, lm_reliability(b_type) AS trust FROM {m}", m=fixture(spark, sf_dir, "matches"))


@query(f"{ctes('matches')} SELECT m.a_id, m.b_id, (a.x1 - a.x0) * (a.y1 - a.y0) AS a_area, b.x0 AS b_x, a.owner FROM matches m JOIN features a ON a.feature_id = m.a_id JOIN features b ON b.feature_id = m.b_id")
def d15_match_shapes(spark, sf_dir):
    from landmesh.functions.geometry import rectangle

    f = properties(_features(spark, sf_dir)).withColumn("geom", rectangle("x0", "y0", "x1", "y1"))
    labels = fixture(spark, sf_dir, "matches").select("a_id", "b_id", F.lit(True).alias("label")).limit(0)
    out = records.match_details(fixture(spark, sf_dir, "matches"), f, labels)
    g = F.col("a_geom")
    return out.select("a_id", "b_id", ((g["xmax"] - g["xmin"]) * (g["ymax"] - g["ymin"])).alias("a_area"), F.col("b_geom.xmin").alias("b_x"), F.col("a_properties")["owner_name"].alias("owner"))


@query(f"{ctes('footprints_2025')} SELECT count(*) AS n, round(avg(confidence), 3) AS mean_confidence, round(avg(height), 2) AS mean_height, round(sum((x1 - x0) * (y1 - y0)), 1) AS total_area FROM footprints_2025")
def e17_extraction(spark, sf_dir):
    return stats.extraction_metrics(fixture(spark, sf_dir, "footprints_2025").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))))


@query(f"""{ctes('parcels')} SELECT k, round(CASE k % 3 WHEN 0 THEN least(0.98e0, 0.55e0 + 0.45e0 * (1 - exp(-(CASE WHEN k % 7 = 0 THEN 2.5e0 ELSE k % 20 + 2.5e0 END - 2.5e0) / 3))) WHEN 1 THEN CASE WHEN k % 7 = 0 THEN 0.5e0 ELSE (k % 20 + 2.5e0) / 32 END ELSE 0.5e0 END, 3) AS confidence FROM parcels""")
def i18_footprint_confidence(spark, sf_dir):
    k = F.col("k")
    method = F.when(k % 3 == 0, "ndsm").when(k % 3 == 1, "model")
    mean = F.when(k % 7 != 0, (k % 20 + 2.5) / F.when(k % 3 == 1, 32).otherwise(1))
    return fixture(spark, sf_dir, "parcels").select("k", sc.footprint_confidence(method, mean).alias("confidence"))


@query(f"""{ctes('parcels')} SELECT k AS issue_id, CASE WHEN k % 3 = 0 THEN 'ignored' WHEN k % 4 < 3 AND ward % 2 = 0 THEN 'accepted' ELSE 'open' END AS status FROM parcels WHERE k % 200 IN (7, 57, 107)""")
def k4_accept_all(spark, sf_dir):
    k = F.col("issue_id")
    action = F.get(F.array(F.lit("clip_from"), F.lit("merge_into"), F.lit("remove_repeated_points"), F.lit(None)), (k % 4).cast("int"))
    issues = _issues(spark, sf_dir).select("issue_id", F.col("ward").alias("source_id"), F.when(k % 3 == 0, "ignored").otherwise("open").alias("status"), F.struct(action.alias("action")).alias("fix"))
    chosen = fixture(spark, sf_dir, "wards").filter("ward % 2 = 0").select(F.col("ward").alias("source_id"))
    return topology.decided(issues, topology.accept_all(issues, chosen, 1)).select("issue_id", "status")


@query()
def k5_rescored(spark, sf_dir):
    """Pairs with the score of a model that was trained on them, as column expressions."""
    rows = _training_rows(spark, sf_dir)
    fitted = model.train(rows, trees=10)[0]
    pairs = rows.select("a_id", "b_id", "match_score", *model.FEATURES).withColumn("locked", F.col("match_score") >= 99)
    return model.rescored_by_columns(pairs, fitted).select("a_id", "b_id", "geo_score", "match_score")


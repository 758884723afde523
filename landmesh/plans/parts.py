"""Queries over single operators, each with its DuckDB text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.functions import scoring as sc
from landmesh.functions import shapes
from landmesh.functions.geometry import measures
from landmesh.operators import changes, coverings, matching, model, nearest, normalize, pixels, quality, records, spatial, stats, topology
from landmesh.plans import queries as land
from landmesh.plans.fixtures import ctes, fixture, properties
from landmesh.plans.queries import _CONFLICTS, _PAIRS, _cover, _fabric, _features, _gap_sql, _issues, _kind, _labelled, query
from landmesh.streaming import status

# Rasters of the wards: a parcel is a pixel, eight to a row; blocks of 5 × 5 pixels with single high
# pixels between them, as many as the parcels give in full.
_PIXELS = """px AS (SELECT ward AS raster_id, k // 25 // 8 AS r, k // 25 % 8 AS c FROM parcels WHERE k // 25 // 64 < (SELECT max(k) // 25 // 64 FROM parcels)),
  hi AS (SELECT *, CASE WHEN r % 8 < 5 AND c < 5 THEN 6e0 + 3 * (r // 8 % 2) WHEN r % 8 = 6 AND c = 6 THEN 4e0 ELSE 0e0 END AS h FROM px)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "parcels").withColumn("i", F.floor(F.col("k") / 25))
    full = p.agg(F.floor(F.max("i") / 64).alias("full"))
    at = p.join(F.broadcast(full)).filter(F.floor(F.col("i") / 64) < F.col("full"))
    at = at.select(F.col("ward").alias("raster_id"), F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).alias("col"))
    r = F.col("row") % 8
    height = F.when((r < 5) & (F.col("col") < 5), 6.0 + 3 * (F.floor(F.col("row") / 8) % 2)).when((r == 6) & (F.col("col") == 6), 4.0).otherwise(0.0)
    return at.withColumn("dsm", 10.0 + height).withColumn("dtm", F.lit(10.0))


@query(f"{ctes('parcels')}, {_PIXELS} SELECT raster_id, count(*) AS n_pixels, count(*)::DOUBLE AS area, avg(h) AS mean_height, max(h) AS max_height, round(least(0.98e0, 0.55e0 + 0.45e0 * (1 - exp(-(avg(h) - 2.5e0) / 3))), 9) AS confidence FROM hi WHERE h > 4 GROUP BY raster_id, r // 8")
def l4_regions(spark, sf_dir):
    out = pixels.regions(pixels.height_mask(_pixels(spark, sf_dir)))
    return out.select("raster_id", "n_pixels", "area", "mean_height", "max_height", F.round("confidence", 9).alias("confidence"))


@query(f"{ctes('parcels')}, {_PIXELS} SELECT raster_id, count(*) FILTER (h > 4) AS n_mask, 10e0 AS ground FROM hi GROUP BY raster_id")
def l3_clean_mask(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    ground = pixels.opened(rows, "dsm", 41).groupBy("raster_id").agg(F.max("dsm").alias("ground"))
    return pixels.cleaned(pixels.height_mask(rows), 3).groupBy("raster_id").agg(F.count_if("mask").alias("n_mask")).join(ground, "raster_id")


@query(f"""{ctes('parcels')} SELECT ward AS raster_id, count(*) FILTER (m AND t)::DOUBLE / count(*) FILTER (m OR t) AS iou, count(*) FILTER (m AND t)::DOUBLE / count(*) FILTER (m) AS precision, count(*) FILTER (m AND t)::DOUBLE / count(*) FILTER (t) AS recall
  FROM (SELECT ward, k // 25 % 3 <> 0 AS m, k // 25 % 4 <> 0 AS t FROM parcels) GROUP BY ward""")
def l5_pixel_scores(spark, sf_dir):
    i = F.floor(F.col("k") / 25)
    return pixels.segmentation_scores(fixture(spark, sf_dir, "parcels").select(F.col("ward").alias("raster_id"), (i % 3 != 0).alias("mask"), (i % 4 != 0).alias("truth")))


_BLOCKS = "SELECT raster_id, CASE WHEN r % 8 < 5 AND c < 5 THEN r // 8 END AS pred, CASE WHEN c < 5 AND CASE WHEN raster_id % 2 = 0 THEN r % 8 < 4 ELSE r % 8 >= 3 END THEN r // 8 END AS truth FROM px"


@query(f"""{ctes('parcels')}, {_PIXELS}, o AS ({_BLOCKS}), p AS (SELECT raster_id, pred AS i, count(*) AS n FROM o WHERE pred IS NOT NULL GROUP BY ALL), t AS (SELECT raster_id, truth AS i, count(*) AS n FROM o WHERE truth IS NOT NULL GROUP BY ALL), b AS (SELECT raster_id, pred AS i, count(*) AS n FROM o WHERE pred = truth GROUP BY ALL),
  s AS (SELECT p.raster_id, count(*) AS np, count(*) FILTER (b.n >= 0.5e0 * (p.n + t.n - b.n)) AS tp FROM p JOIN t ON t.raster_id = p.raster_id AND t.i = p.i LEFT JOIN b ON b.raster_id = p.raster_id AND b.i = p.i GROUP BY 1)
  SELECT raster_id, tp, np - tp AS fp, np - tp AS fn, 2e0 * tp / (2 * np) AS f1 FROM s""")
def l5_object_scores(spark, sf_dir):
    rows, r, low = _pixels(spark, sf_dir), F.col("row") % 8, F.col("col") < 5
    number = F.floor(F.col("row") / 8)
    pred = F.when((r < 5) & low, number)
    truth = F.when(low & F.when(F.col("raster_id") % 2 == 0, r < 4).otherwise(r >= 3), number)
    return pixels.object_scores(rows.select("raster_id", pred.alias("pred"), truth.alias("truth")), 20)


# Changes


@query(f"""{ctes('footprints_2025')}, pair AS (SELECT a.feature_id AS c, b.feature_id AS b, greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba, b.height AS bh
    FROM footprints_2025 a JOIN features b ON b.source_type = 'building_footprint' AND a.ward = b.ward AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
  best AS (SELECT * FROM (SELECT *, o / least(aa, ba) AS ratio, row_number() OVER (PARTITION BY c ORDER BY o / least(aa, ba) DESC, b) AS n FROM pair) WHERE n = 1),
  seen AS (SELECT f.ward, f.feature_id, f.height, coalesce(nullif(f.confidence, 0), 0.85e0) AS conf, (f.x1 - f.x0) * (f.y1 - f.y0) AS area, t.b, coalesce(t.ratio, 0e0) AS ratio, t.ba, t.bh, 100 * ((f.x1 - f.x0) * (f.y1 - f.y0) - t.ba) / t.ba AS pct, f.height - t.bh AS rise FROM footprints_2025 f LEFT JOIN best t ON t.c = f.feature_id WHERE (f.x1 - f.x0) * (f.y1 - f.y0) >= 10),
  gone AS (SELECT f.ward, f.feature_id, coalesce((SELECT max(o / ba) FROM pair p WHERE p.b = f.feature_id), 0e0) AS covered FROM features f WHERE source_type = 'building_footprint' AND (x1 - x0) * (y1 - y0) >= 10 AND feature_id NOT IN (SELECT b FROM seen WHERE ratio >= 0.2e0)),
  found AS (SELECT ward, 'new_structure' AS change_type, least(0.99e0, conf * (1 - ratio)) AS s FROM seen WHERE ratio < 0.2e0
    UNION ALL SELECT ward, CASE WHEN rise > 2.5e0 THEN 'vertical_extension' WHEN pct > 0 THEN 'extension' ELSE 'reduction' END, least(0.99e0, CASE WHEN rise > 2.5e0 THEN conf * least(1e0, 0.6e0 + rise / 15) ELSE conf * ratio * least(1e0, 0.6e0 + abs(pct) / 100) END) FROM seen WHERE ratio >= 0.2e0 AND (coalesce(rise > 2.5e0, false) OR abs(pct) > 15)
    UNION ALL SELECT ward, 'demolished', 0.8e0 * (1 - covered) FROM gone WHERE covered < 0.2e0)
  SELECT ward, change_type, count(*) AS n, round(avg(round_even(s, 4)), 6) AS mean_confidence FROM found GROUP BY ward, change_type""")
def e14_change_summary(spark, sf_dir):
    found = changes.detect_changes(_kind(spark, sf_dir, "building_footprint"), fixture(spark, sf_dir, "footprints_2025"))
    return changes.change_summary(found).withColumn("mean_confidence", F.round("mean_confidence", 6))


# Validation

_CARDS = """card AS (SELECT f.source_type || '-' || f.ward AS source_id, f.ward, count(*) AS n, avg((k % 50 <> 3)::INT) AS valid, avg(((f.x0 + f.x1) / 2 BETWEEN west AND east AND (f.y0 + f.y1) / 2 BETWEEN south AND north)::INT) AS inside, f.source_type = 'revenue' AS no_crs,
    CASE WHEN f.source_type = 'revenue' THEN (count(*) FILTER (owner <> '') + count(*))::DOUBLE / (2 * count(*)) ELSE 1e0 END AS complete, CASE WHEN source_type IN ('building_footprint', 'ground_truth') THEN 0 ELSE count(survey_no) - count(DISTINCT survey_no) END AS dup,
    CASE WHEN f.source_type = 'cadastral' THEN (SELECT count(*) FROM parcels p WHERE p.ward = f.ward AND p.k % 200 IN (7, 57, 107) AND p.k % 3 <> 0) ELSE 0 END AS open_issues FROM features f JOIN wards w ON w.ward = f.ward GROUP BY f.source_type, f.ward),
  scored AS (SELECT *, round_even(100 * (CASE WHEN no_crs THEN 0.5e0 ELSE 1e0 END + 2 * round_even(valid, 4) + 2 * round_even(complete, 4) + round_even(1 - least(1e0, dup::DOUBLE / n), 4) + round_even(inside, 4) + 2 * round_even(1e0 / (1 + open_issues), 4) + 1) / 10, 1) AS score FROM card)"""


def _cards(spark, sf_dir):
    f = properties(_features(spark, sf_dir)).withColumn("was_invalid", F.col("k") % 50 == 3)
    sources = f.groupBy("source_id", "ward").agg(F.min("captured_at").alias("captured_at"), F.min(F.when(F.col("source_type") != "revenue", "EPSG:32644")).alias("crs"))
    issues = _issues(spark, sf_dir).select(F.concat(F.lit("cadastral-"), F.col("ward")).alias("source_id"), "status")
    return quality.source_cards(f, sources, issues, fixture(spark, sf_dir, "wards"), F.lit("2024-01-31").cast("date"))


@query(f"{ctes('features', 'wards')}, {_CARDS} SELECT source_id, n, valid, inside, dup AS duplicates, complete, open_issues, score FROM scored")
def e8_source_cards(spark, sf_dir):
    return _cards(spark, sf_dir).select("source_id", "n", "valid", "inside", "duplicates", "complete", "open_issues", "score")


_COVER_SQL = "SELECT a.ward, a.feature_id AS s, b.feature_id AS p, greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS area FROM footprints_2025 a JOIN features b ON b.source_type = 'cadastral' AND a.ward = b.ward AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"


@query(f"""{ctes('features', 'wards', 'footprints_2025', 'matches')}, {_CARDS}, cover AS ({_COVER_SQL}),
  s AS (SELECT f.ward, count(*) AS n, count(*) FILTER (feature_id NOT IN (SELECT s FROM cover WHERE o > 0.2e0 * area)) AS u FROM footprints_2025 f GROUP BY f.ward),
  e AS (SELECT ward, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o DESC, p) AS i FROM cover) WHERE i = 1 AND (area - o) / area > 0.15e0 AND o / area > 0.2e0 GROUP BY ward),
  d AS (SELECT ward, count(*) AS n FROM ({_CONFLICTS}) WHERE n > 0 GROUP BY ward)
  SELECT c.ward, coalesce(s.n, 0) AS n_structures, round_even(100 * (3 * round_even(c.q, 4) + 3 * round_even(CASE WHEN s.n > 0 THEN 1 - s.u::DOUBLE / s.n ELSE 1e0 END, 4) + 2 * round_even(1e0 / (1 + coalesce(e.n, 0)), 4) + 2 * round_even(1e0 / (1 + coalesce(d.n, 0)), 4)) / 10, 1) AS score
  FROM (SELECT ward, avg(score) / 100 AS q FROM scored GROUP BY ward) c LEFT JOIN s ON s.ward = c.ward LEFT JOIN e ON e.ward = c.ward LEFT JOIN d ON d.ward = c.ward""")
def e9_ward_scores(spark, sf_dir):
    now, pairs = _cover(spark, sf_dir)
    drift = matching.conflicts(fixture(spark, sf_dir, "matches"), properties(_features(spark, sf_dir)))
    found = quality.findings(spatial.unregistered(now, pairs), spatial.encroachments(pairs), spatial.vacant(_kind(spark, sf_dir, "cadastral"), now), drift)
    return quality.ward_scores(_cards(spark, sf_dir), now, found).select("ward", "n_structures", "score")


@query(f"{ctes('matches')} SELECT 'attribute_drift' AS finding_type, ward, count(*) AS n FROM ({_CONFLICTS}) WHERE n > 0 GROUP BY ward")
def h2_attribute_drift(spark, sf_dir):
    drift = matching.conflicts(fixture(spark, sf_dir, "matches"), properties(_features(spark, sf_dir)))
    now, pairs = _cover(spark, sf_dir)
    found = quality.findings(spatial.unregistered(now, pairs), spatial.encroachments(pairs), spatial.vacant(_kind(spark, sf_dir, "cadastral"), now), drift)
    return found.filter("finding_type = 'attribute_drift'").groupBy("finding_type", "ward").agg(F.count("*").alias("n"))


_TOPOLOGY = f"""{_gap_sql()}, over AS (SELECT a.ward, 'overlap' AS issue_type, a.id AS a_id, b.id AS b_id, greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS measure FROM f a JOIN f b ON a.ward = b.ward AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
  issue AS (SELECT * FROM over WHERE measure > 0.25e0 UNION ALL SELECT ward, CASE WHEN w * l / (w + l) <= 0.5e0 THEN 'sliver' ELSE 'gap' END, a_id, b_id, w * l FROM s WHERE w > 0.05e0 AND w <= 1 AND l > w AND w * l > 0.05e0)"""


@query(f"{ctes('parcels')}, {_TOPOLOGY} SELECT ward, issue_type, a_id, b_id, measure, 'open' AS status FROM issue")
def k2_topology(spark, sf_dir):
    return topology.findings(_fabric(spark, sf_dir)).select("ward", "issue_type", F.col("feature_ids")[0].alias("a_id"), F.col("feature_ids")[1].alias("b_id"), "measure", "status")


@query(f"""{ctes('parcels')}, {_TOPOLOGY}, hit AS (SELECT a_id AS id, issue_type <> 'overlap' AS strip FROM issue UNION SELECT b_id, issue_type <> 'overlap' FROM issue)
  SELECT defect, count(*) AS n, round(avg((EXISTS (SELECT 1 FROM hit WHERE hit.id = t.id AND hit.strip = (t.defect <> 'overlap')))::INT), 9) AS recall FROM (SELECT 'C' || k AS id, CASE k % 200 WHEN 7 THEN 'overlap' WHEN 57 THEN 'sliver' ELSE 'gap' END AS defect FROM parcels WHERE k % 200 IN (7, 57, 107)) t GROUP BY ROLLUP (defect)""")
def e16_recall(spark, sf_dir):
    f = _fabric(spark, sf_dir)
    kind = F.col("k") % 200
    truth = f.filter(kind.isin(7, 57, 107)).select("feature_id", F.when(kind == 7, "overlap").when(kind == 57, "sliver").otherwise("gap").alias("defect"))
    return topology.recall(topology.findings(f), truth).select("defect", "n", F.round("recall", 9).alias("recall"))


_SHARE = "('0x' || substr(md5('{0}/C' || k), 1, 6))::BIGINT / 16777216e0"


@query(f"""{ctes('parcels')}, p AS (SELECT *, {_SHARE.format('defects')} AS u FROM parcels), d AS (SELECT *, CASE WHEN u < 0.01e0 THEN 'overlap' WHEN u < 0.02e0 THEN 'sliver' WHEN u < 0.025e0 THEN 'gap' END AS defect FROM p)
  SELECT 'C' || k AS feature_id, defect, round(CASE defect WHEN 'overlap' THEN x0 - 1.2e0 WHEN 'sliver' THEN x0 + 0.35e0 ELSE x0 + 0.7e0 END, 6) AS x0 FROM d WHERE defect IS NOT NULL""")
def k10_defects(spark, sf_dir):
    clean = fixture(spark, sf_dir, "parcels").select(F.concat(F.lit("C"), "k").alias("feature_id"), "ward", "x0", "y0", "x1", "y1")
    fabric, truth = topology.with_defects(clean)
    return truth.join(fabric, "feature_id").select("feature_id", "defect", F.round("x0", 6).alias("x0"))


@query(f"""{ctes('parcels')}, p AS (SELECT *, {_SHARE.format('epoch')} AS u FROM parcels) SELECT CASE WHEN u < 0.02e0 THEN 'demolished' WHEN u < 0.05e0 THEN 'extension' ELSE 'vertical_extension' END AS change_type, count(*) AS n, count(*) FILTER (u >= 0.02e0) AS n_now FROM p WHERE u < 0.07e0 GROUP BY 1""")
def k10_epoch(spark, sf_dir):
    old = fixture(spark, sf_dir, "parcels").select(F.concat(F.lit("C"), "k").alias("feature_id"), "ward", "x0", "y0", "x1", "y1", F.lit(6.0).alias("height"))
    now, truth = topology.next_epoch(old)
    seen = truth.join(now.select("feature_id", F.lit(1).alias("here")), "feature_id", "left")
    return seen.groupBy("change_type").agg(F.count("*").alias("n"), F.count("here").alias("n_now"))


@query(f"""{ctes('features')}, r AS (SELECT a_id, b_id, ward, (substr(a_id, 2) = substr(b_id, 2))::INT AS label, round(100 * coalesce(iou, greatest(0e0, 1 - d / 25)), 2) / 100 AS p FROM ({_PAIRS}) WHERE CASE WHEN iou IS NULL THEN d <= 25 ELSE iou >= 0.3e0 END)
  SELECT a_id, b_id, label, 'pack-' || ward AS "group", 1e0 AS weight, round(p, 9) AS baseline FROM r UNION ALL SELECT a_id, b_id, label, 'ward-' || ward, 3e0, null FROM r WHERE ward = 3""")
def h3_training_rows(spark, sf_dir):
    keyed = _labelled(spark, sf_dir, keep=False)
    rows = model.training_rows(keyed=keyed, officer=keyed.filter("ward = 3"))
    return rows.select("a_id", "b_id", "label", "group", "weight", F.round("baseline", 9).alias("baseline"))


# Sources and records

_SOURCES = """src AS (SELECT k AS source_id, ward, split_part('cadastral,municipal_gis,building_footprint,ai_extracted', ',', (k // 25 % 4 + 1)::INT) AS source_type, CASE WHEN k // 100 % 3 = 0 THEN 'pending' ELSE 'ready' END AS status, CASE WHEN k % 7 <> 0 THEN DATE '2020-01-01' + (k * 37 % 1000)::INT END AS captured_at, DATE '2024-01-01' + (k % 11)::INT AS created_at FROM parcels)"""


def _sources(spark, sf_dir):
    k = F.col("k")
    kinds = F.array(*map(F.lit, ("cadastral", "municipal_gis", "building_footprint", "ai_extracted")))
    return fixture(spark, sf_dir, "parcels").select(
        k.alias("source_id"), "ward", F.get(kinds, (F.floor(k / 25) % 4).cast("int")).alias("source_type"), F.when(F.floor(k / 100) % 3 == 0, "pending").otherwise("ready").alias("status"),
        F.when(k % 7 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (k * 37 % 1000).cast("int"))).alias("captured_at"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 11).cast("int")).alias("created_at"),
    )


@query(f"{ctes('parcels')}, {_SOURCES} SELECT ward, source_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY (source_type = 'cadastral')::INT, captured_at DESC NULLS LAST, created_at DESC NULLS LAST, source_id) AS n FROM src WHERE status = 'ready' AND source_type IN ('municipal_gis', 'cadastral')) WHERE n = 1")
def f3_chosen_layer(spark, sf_dir):
    return quality.chosen_layer(_sources(spark, sf_dir), ["municipal_gis", "cadastral"]).select("ward", "source_id", "source_type")


@query(f"""{ctes('parcels', 'wards')}, {_SOURCES}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ward, source_type ORDER BY captured_at DESC NULLS LAST, source_id) AS n FROM src WHERE status = 'ready') WHERE n = 1)
  SELECT a.ward, a.source_id AS baseline_id, b.source_id AS current_id FROM last a JOIN last b ON a.ward = b.ward AND a.source_type = 'building_footprint' AND b.source_type = 'ai_extracted' WHERE a.ward % 5 <> 0""")
def f4_epochs(spark, sf_dir):
    runs = fixture(spark, sf_dir, "wards").filter("ward % 5 = 0").select("ward")
    return records.epochs_to_compare(_sources(spark, sf_dir), runs)


@query("SELECT event_id AS id, event_type AS action, 'user-' || user_id AS entity FROM events WHERE event_type LIKE 'err%' AND 'user-' || user_id LIKE 'user-1%' ORDER BY ts DESC, event_id LIMIT 200")
def c3_audit(spark, sf_dir):
    log = fixture(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.concat(F.lit("user-"), "user_id").alias("entity"), F.col("ts").alias("created_at"))
    return stats.audit(log, "user-1", "err", 200).select("id", "action", "entity")


@query(f"{ctes('features')} SELECT feature_id, CASE source_type WHEN 'municipal_gis' THEN 'owner' WHEN 'building_footprint' THEN 'height_m' WHEN 'ground_truth' THEN '' ELSE 'owner_name' END AS keys FROM features")
def c5_without_key(spark, sf_dir):
    bag = records.without_key(F.col("properties"), "survey_no")
    return properties(_features(spark, sf_dir)).select("feature_id", F.array_join(F.array_sort(F.map_keys(bag)), ",").alias("keys"))


@query(f"""{ctes('features')} SELECT feature_id, '{{' || CASE source_type WHEN 'municipal_gis' THEN '"owner":"' || owner || '","survey_no":"' || survey_no || '",' WHEN 'building_footprint' THEN '"height_m":"' || height || '",' WHEN 'ground_truth' THEN '' ELSE '"owner_name":"' || owner || '","survey_no":"' || survey_no || '",' END
  || '"ward_id":"' || ward || '","_was_invalid":"' || (k % 50 = 3) || '"}}' AS properties FROM features""")
def c6_published(spark, sf_dir):
    return records.published(properties(_features(spark, sf_dir)).withColumn("was_invalid", F.col("k") % 50 == 3))


@query(f"{ctes('parcels')}, t AS (SELECT CASE WHEN k % 3 = 0 THEN 'x' || k ELSE k || 'a' END AS label FROM parcels) SELECT label FROM t ORDER BY try_cast(regexp_extract(label, '^(\\d+)', 1) AS BIGINT) NULLS LAST, label LIMIT 500")
def g4_natural_order(spark, sf_dir):
    k = F.col("k")
    labels = fixture(spark, sf_dir, "parcels").select(F.when(k % 3 == 0, F.concat(F.lit("x"), k)).otherwise(F.concat(k, F.lit("a"))).alias("label"))
    return labels.orderBy(*stats.natural_order(labels, "label")).limit(500)


@query(f"{ctes('tickets')} SELECT id, ward, status FROM tickets WHERE id % 4 = 0")
def h4_missing(spark, sf_dir):
    t = fixture(spark, sf_dir, "tickets")
    return stats.missing(t, t.filter("id % 4 <> 0"), "id").select("id", "ward", "status")


@query(f"{ctes('matches')} SELECT a_id, b_id, n AS n_fields FROM ({_CONFLICTS}) WHERE conflict_type IS NOT NULL AND substr(a_id, 2)::BIGINT % 3 <> 0")
def d13_new_conflicts(spark, sf_dir):
    m = fixture(spark, sf_dir, "matches")
    known = m.filter("cast(substring(a_id, 2) as bigint) % 3 = 0")
    return matching.conflicts(m, properties(_features(spark, sf_dir)), known).select("a_id", "b_id", F.size("fields").alias("n_fields"))


@query(f"""{ctes('matches')} SELECT m.a_id, m.b_id, a.owner AS a_owner, b.survey_no AS b_survey_no, CASE WHEN m.b_type = 'revenue' AND a.k % 97 = 0 THEN false END AS label FROM matches m JOIN features a ON a.feature_id = m.a_id JOIN features b ON b.feature_id = m.b_id""")
def d15_match_details(spark, sf_dir):
    m = fixture(spark, sf_dir, "matches").select("a_id", "b_id", "match_score")
    p = fixture(spark, sf_dir, "parcels").filter("k % 97 = 0")
    labels = p.select(F.concat(F.lit("R"), "k").alias("a_id"), F.concat(F.lit("C"), "k").alias("b_id"), F.lit(False).alias("label"))
    out = records.match_details(m, properties(_features(spark, sf_dir)), labels)
    return out.select("a_id", "b_id", F.col("a_properties")["owner_name"].alias("a_owner"), F.col("b_properties")["survey_no"].alias("b_survey_no"), "label")


@query(f"{ctes('matches')} SELECT a_id, b_id, true AS label FROM matches WHERE substr(a_id, 2)::BIGINT % 10 = 1 UNION ALL SELECT a_id, b_id, false FROM matches WHERE substr(a_id, 2)::BIGINT % 10 = 0")
def d17_labels(spark, sf_dir):
    m = fixture(spark, sf_dir, "matches").select("a_id", "b_id", "match_score")
    n = F.substring("a_id", 2, 20).cast("long") % 10
    first = m.filter(n.isin(0, 1)).select("a_id", "b_id", F.lit(True).alias("label"), F.lit(1).alias("at"))
    second = m.filter(n == 0).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.lit(False).alias("label"), F.lit(2).alias("at"))
    return records.decide(m, m.limit(0).select("a_id", "b_id", F.lit(True).alias("label")), first.unionByName(second))[0].select("a_id", "b_id", "label")


@query(f"{ctes('matches')} SELECT a_id, b_id, match_score::DOUBLE AS match_score FROM matches WHERE match_score < 60 AND substr(a_id, 2)::BIGINT % 9 <> 0")
def d14_displaced(spark, sf_dir):
    m = fixture(spark, sf_dir, "matches").withColumn("locked", F.expr("cast(substring(a_id, 2) as bigint) % 9 = 0"))
    again = m.filter("match_score >= 60").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return records.displaced(m, again).select("a_id", "b_id", F.col("match_score").cast("double").alias("match_score"))


@query(f"{ctes('parcels')} SELECT k AS source_id, CASE WHEN k % 3 = 0 THEN 'scan' WHEN k % 3 = 1 THEN 'owner,area' ELSE 'khata' END AS fields FROM parcels")
def i16_source_fields(spark, sf_dir):
    k = F.col("k")
    none = F.array().cast("array<string>")
    ocr = F.when(k % 3 == 0, F.array(F.lit("scan"))).otherwise(none)
    profile = F.when(k % 3 == 1, F.array(F.lit("owner"), F.lit("area"))).otherwise(none)
    metadata = F.create_map(F.lit("khata"), k, F.lit("feature_count"), k)
    return fixture(spark, sf_dir, "parcels").select(k.alias("source_id"), F.array_join(records.source_fields(ocr, profile, metadata), ",").alias("fields"))


# Scores


_RELIABLE = "CASE {0} WHEN 'cadastral' THEN 0.95e0 WHEN 'revenue' THEN 0.65e0 ELSE 0.8e0 END"


@query(f"""{ctes('matches')}, r AS (SELECT a_id, b_id, match_score / 100 AS g, (substr(a_id, 2)::BIGINT % 8) / 8e0 AS a, ({_RELIABLE.format('a_type')} + {_RELIABLE.format('b_type')}) / 2 AS s, (substr(a_id, 2)::BIGINT % 4) / 4e0 AS t FROM matches)
  SELECT a_id, b_id, round_even(100 * (0.4e0 * g + 0.3e0 * a + 0.2e0 * s + 0.1e0 * t), 0) AS confidence, round_even(g, 4) AS geometric_match_score, round_even(a, 4) AS attribute_match_score, round_even(s, 4) AS source_reliability_weight, round_even(t, 4) AS recency_score FROM r""")
def i4_confidence(spark, sf_dir):
    n = F.substring("a_id", 2, 20).cast("long")
    m = fixture(spark, sf_dir, "matches").withColumns({"a": (n % 8) / 8.0, "t": (n % 4) / 4.0})
    parts = sc.confidence_parts(F.col("match_score").cast("double"), "a_type", "b_type", "a", "t")
    return m.select("a_id", "b_id", parts.alias("p")).select("a_id", "b_id", "p.*")


@query(f"{ctes('matches')} SELECT a_id, b_id, CASE WHEN match_score >= 85 THEN 'auto_accept' WHEN match_score >= 60 THEN 'review' ELSE 'conflict' END AS band FROM matches")
def i6_score_band(spark, sf_dir):
    return fixture(spark, sf_dir, "matches").select("a_id", "b_id", sc.score_band("match_score").alias("band"))


@query(f"{ctes('features')} SELECT feature_id, nullif(trim(owner), '') AS owner, nullif(trim(survey_no), '') AS survey FROM features")
def i7_first_alias(spark, sf_dir):
    return properties(_features(spark, sf_dir)).select("feature_id", sc.first_alias("properties", "owner").alias("owner"), sc.first_alias("properties", "survey").alias("survey"))


@query(f"""{ctes('matches')} SELECT a_id, b_id, '{{"match":' || (substr(a_id, 2)::BIGINT % 16) / 8e0 || ',"height":' || CASE WHEN b_type = 'revenue' THEN 'null' ELSE '3.0' END || '}}' AS features FROM matches""")
def i8_snapshot(spark, sf_dir):
    m = fixture(spark, sf_dir, "matches").withColumn("match", F.expr("cast(substring(a_id, 2) as bigint) % 16 / 8")).withColumn("height", F.expr("case when b_type <> 'revenue' then 3d end"))
    return m.select("a_id", "b_id", model.snapshot(["match", "height"]).alias("features"))


@query(f"{ctes('parcels')} SELECT k, (CASE WHEN k % 1700 >= 850 THEN 32600 ELSE 32700 END + floor((k % 3600) / 10e0 / 6) + 1)::INT AS srid FROM parcels")
def i14_utm_srid(spark, sf_dir):
    lon, lat = (F.col("k") % 3600) / 10 - 180, (F.col("k") % 1700) / 10 - 85
    return fixture(spark, sf_dir, "parcels").select("k", sc.utm_srid(lon, lat).alias("srid"))


@query(f"""{ctes('parcels')}, p AS (SELECT k, (k % 3571) / 10e0 - 178.51e0 AS lon, (k % 1601) / 10e0 - 80.03e0 AS lat FROM parcels), t AS (SELECT k, floor((lon + 180) / 360 * 512)::INT AS x, floor((0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 512)::INT AS y FROM p)
  SELECT k, array_to_string([((x >> z) & 1) + 2 * ((y >> z) & 1) FOR z IN [8, 7, 6, 5, 4, 3, 2, 1, 0]], '') AS quadkey FROM t""")
def i19_quadkey(spark, sf_dir):
    lon, lat = (F.col("k") % 3571) / 10.0 - 178.51, (F.col("k") % 1601) / 10.0 - 80.03
    return fixture(spark, sf_dir, "parcels").select("k", sc.quadkey(lon, lat).alias("quadkey"))


@query(f"""{ctes('parcels')}, h AS (SELECT k, md5(cast(floor(x0 / 500)::BIGINT AS VARCHAR) || '/' || cast(floor(y0 / 500)::BIGINT AS VARCHAR)) AS m FROM parcels), r AS (SELECT k, list_reduce([0] || [strpos('0123456789abcdef', substr(m, i::INT, 1)) - 1 FOR i IN range(1, 33)], lambda a, d: (a * 16 + d) % 1000) AS rest FROM h)
  SELECT k, CASE WHEN rest < 100 THEN 'test' WHEN rest < 200 THEN 'val' ELSE 'train' END AS split FROM r""")
def i20_block_split(spark, sf_dir):
    return fixture(spark, sf_dir, "parcels").select("k", sc.block_split(F.concat_ws("/", F.floor(F.col("x0") / 500), F.floor(F.col("y0") / 500))).alias("split"))


@query(f"""{ctes('detections')}, w AS (SELECT ward, count(*) AS spike, 100 * avg(confidence) AS mean, avg((status = 'rejected')::INT) AS bad, count(*) FILTER (detection_type = 'change_of_use') AS use FROM detections GROUP BY ward),
  p AS (SELECT ward, CASE WHEN spike > 200 THEN 40 WHEN spike > 100 THEN 20 ELSE 0 END + CASE WHEN mean > 80 THEN 30 WHEN mean > 60 THEN 15 ELSE 0 END + CASE WHEN bad < 0.1e0 THEN 20 ELSE 0 END + CASE WHEN use > 5 THEN 10 ELSE 0 END AS score FROM w)
  SELECT ward, score, CASE WHEN score >= 71 THEN 'danger' WHEN score >= 41 THEN 'warning' ELSE 'info' END AS level FROM p""")
def i21_alerts(spark, sf_dir):
    w = fixture(spark, sf_dir, "detections").groupBy("ward").agg(F.count("*").alias("spike"), (100 * F.avg("confidence")).alias("mean"), F.avg((F.col("status") == "rejected").cast("int")).alias("bad"), F.count_if(F.col("detection_type") == "change_of_use").alias("use"))
    score = sc.alert_score("spike", "mean", "bad", "use")
    return w.select("ward", score.alias("score"), sc.alert_level(score).alias("level"))


@query(f"{ctes('matches')} SELECT count(*) AS n_matches, count(*) FILTER (match_score >= 85) AS auto_accept, round(avg(iou), 6) AS mean_iou, round(avg(match_score), 6) AS mean_score FROM matches")
def e18_overview(spark, sf_dir):
    return stats.match_kpis(fixture(spark, sf_dir, "matches")).select("n_matches", "auto_accept", F.round("mean_iou", 6).alias("mean_iou"), F.round("mean_score", 6).alias("mean_score"))


# Polygons: the boxes turned by the angle of the 3-4-5 triangle, so that their areas stay as they are


def _turned(df: DataFrame) -> DataFrame:
    """Boxes as turned polygons: `geom`, and their own boxes in x0, y0, x1, y1."""
    x = lambda a, b: 0.6 * F.col(f"x{a}") - 0.8 * F.col(f"y{b}")
    y = lambda a, b: 0.8 * F.col(f"x{a}") + 0.6 * F.col(f"y{b}")
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    geom = F.struct(
        F.lit(2).alias("dim"), F.array(*(x(a, b) for a, b in corners)).alias("xs"), F.array(*(y(a, b) for a, b in corners)).alias("ys"), F.array(F.lit(0)).alias("offs"),
        x(0, 1).alias("xmin"), y(0, 0).alias("ymin"), x(1, 0).alias("xmax"), y(1, 1).alias("ymax"),
    )
    out = df.withColumn("geom", geom)
    return out.withColumns({"x0": F.col("geom.xmin"), "y0": F.col("geom.ymin"), "x1": F.col("geom.xmax"), "y1": F.col("geom.ymax")})


def _area(c: str):
    """Area of a geometry column, null ones (nothing left) as 0."""
    return F.round(F.coalesce(measures(F.coalesce(c, shapes.empty()))["area"], F.lit(0.0)), 4)


@query(f"""{ctes('features')} SELECT a.k, round(i, 4) AS both, round(aa - i, 4) AS outside, round(aa + ba - i, 4) AS whole FROM (SELECT a.k, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba, greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i
  FROM features a JOIN features b ON a.k = b.k AND a.source_type = 'cadastral' AND b.source_type = 'municipal_gis') a""")
def b9_shapes(spark, sf_dir):
    side = lambda kind, p: _turned(_kind(spark, sf_dir, kind)).select("k", F.col("geom").alias(p))
    rows = side("cadastral", "a").join(side("municipal_gis", "b"), "k")
    rows = shapes.spread(rows).select("k", shapes.intersection("a", "b").alias("i"), shapes.difference("a", "b").alias("d"), shapes.union("a", "b").alias("u"))
    return rows.select("k", _area("i").alias("both"), _area("d").alias("outside"), _area("u").alias("whole"))


@query(f"{ctes('parcels')} SELECT k, k % 3 = 0 AS was_invalid, CASE WHEN k % 3 = 0 THEN 250e0 ELSE 500e0 END AS area, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n_parts, round(0.6e0 * (x0 + x1) / 2 - 0.8e0 * (y0 + y1) / 2, 3) AS x FROM parcels")
def b6_repaired(spark, sf_dir):
    rows = _turned(fixture(spark, sf_dir, "parcels"))
    crossed = lambda v: F.array(*(F.col(f"geom.{v}")[i] for i in (0, 1, 3, 2, 0)))
    swap = lambda v: F.when(F.col("k") % 3 == 0, crossed(v)).otherwise(F.col(f"geom.{v}"))
    rows = rows.withColumn("geom", F.col("geom").withField("xs", swap("xs")).withField("ys", swap("ys"))).withColumn("srid", F.lit(32644)).withColumn("source_id", F.lit("s")).withColumn("properties", F.create_map(F.lit("a"), F.lit("1")))
    out, _ = normalize.normalized(shapes.spread(rows).select("k", "source_id", "geom", "srid", "properties"), 32644)
    return out.select("k", "was_invalid", F.round("area", 3).alias("area"), shapes.n_parts("geom").alias("n_parts"), F.round("x", 3).alias("x"))


@query(f"""{ctes('parcels')}, c AS (SELECT ward, k // 25 % 40 AS i, k // 25 // 40 AS j FROM parcels)
  SELECT ward, 500e0 * count(*) AS area, sum(90e0 - 40 * (SELECT count(*) FROM c n WHERE n.ward = c.ward AND n.i = c.i AND n.j = c.j + 1) - 50 * (SELECT count(*) FROM c n WHERE n.ward = c.ward AND n.j = c.j AND n.i = c.i + 1)) AS perimeter FROM c GROUP BY ward""")
def b14_dissolved(spark, sf_dir):
    out = shapes.dissolved(_turned(fixture(spark, sf_dir, "parcels")), ["ward"]).withColumn("m", measures("geom"))
    return out.select("ward", F.round("m.area", 2).alias("area"), F.round("m.perimeter", 2).alias("perimeter"))


@query(land.ORACLES["k3_gaps"].replace("w * l AS area", "round(w * l, 4) AS area, a_id AS target"))
def k3_polygon_gaps(spark, sf_dir):
    found = topology.polygon_gaps(_turned(_fabric(spark, sf_dir)))
    return found.select("ward", "issue_type", F.col("feature_ids")[0].alias("a_id"), F.col("feature_ids")[1].alias("b_id"), F.round("measure", 4).alias("area"), F.col("fix.target").alias("target"))


@query(land.ORACLES["d5_encroachments"].replace("area - o AS outside_area", "round(area - o, 4) AS outside_area, round(area - o, 4) AS shape_area"))
def d5_outside(spark, sf_dir):
    now, parcels = _turned(fixture(spark, sf_dir, "footprints_2025")), _turned(_kind(spark, sf_dir, "cadastral"))
    found = matching.stored(spatial.encroachments(spatial.coverage(now, parcels)), "encroachments")
    return spatial.with_outside(found, now, parcels).select("structure_id", "parcel_id", F.round("outside_area", 4).alias("outside_area"), _area("outside").alias("shape_area"))


@query(land.ORACLES["d7_points_in"])
def d7_points_in_polygons(spark, sf_dir):
    points = fixture(spark, sf_dir, "parcels").select("k", *((0.6 * x - 0.8 * y).alias("x") if v == "x" else (0.8 * x + 0.6 * y).alias("y") for v in "xy" for x, y in (((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2),)))
    wards = fixture(spark, sf_dir, "wards").select(F.col("ward").alias("ward_id"), F.col("west").alias("x0"), F.col("south").alias("y0"), F.col("east").alias("x1"), F.col("north").alias("y1"))
    return coverings.assigned(points, _turned(wards), "ward_id").select("k", "ward_id")


@query(f"""{ctes('footprints_2025')} SELECT f.feature_id AS point_id, round(min(sqrt(pow(greatest(0, p.x0 - f.x, f.x - p.x1), 2) + pow(greatest(0, p.y0 - f.y, f.y - p.y1), 2))), 5) AS distance
  FROM (SELECT feature_id, x0 + 3.25e0 AS x, y0 + 7.5e0 AS y FROM footprints_2025) f CROSS JOIN (SELECT * FROM parcels WHERE k % 7 = 0) p GROUP BY 1""")
def d8_nearest_polygon(spark, sf_dir):
    x, y = F.col("x0") + 3.25, F.col("y0") + 7.5
    points = fixture(spark, sf_dir, "footprints_2025").select(F.col("feature_id").alias("point_id"), (0.6 * x - 0.8 * y).alias("x"), (0.8 * x + 0.6 * y).alias("y"))
    return nearest.nearest(points, _turned(fixture(spark, sf_dir, "parcels").filter("k % 7 = 0")), "k").select("point_id", F.round("distance", 5).alias("distance"))


@query(f"""{ctes('footprints_2025')} SELECT f.feature_id AS structure_id, p.k FROM footprints_2025 f JOIN parcels p ON f.x0 - 0.0625e0 <= p.x1 AND p.x0 <= f.x1 + 0.0625e0 AND f.y0 - 0.0625e0 <= p.y1 AND p.y0 <= f.y1 + 0.0625e0""")
def d9_meeting_polygons(spark, sf_dir):
    grown = fixture(spark, sf_dir, "footprints_2025").select("feature_id", *((F.col(f"{v}{i}") + (0.0625 if i else -0.0625)).alias(f"{v}{i}") for v in "xy" for i in (0, 1)))
    found = coverings.intersecting(_turned(grown), _turned(fixture(spark, sf_dir, "parcels")), "feature_id", "k", 2)
    return found.select(F.col("a_id").alias("structure_id"), F.col("b_id").alias("k"))


@query("SELECT user_id AS property_id, max(ts) AS updated_at, arg_max(event_type, ts) AS status FROM events GROUP BY user_id")
def j2_latest_status(spark, sf_dir):
    """The table as a stream of files, its state after all of them."""
    path = f"{matching.shared_root(spark)}/status-{uuid.uuid4().hex}"
    table = fixture(spark, sf_dir, "events").select(F.col("user_id").alias("property_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
    stream = spark.readStream.schema(fixture(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("user_id").alias("property_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
    status.latest_status(stream, f"{path}/table", f"{path}/marks").awaitTermination()
    return status.current(spark, f"{path}/table", table.schema)

"""Land-record tables derived by arithmetic from the given tables.

One text serves two engines: `//` is integer division and becomes `div` in Spark. Coordinates are
metres in UTM 44N; offsets are multiples of 1/8 m, so that products are exact in doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = "Asha,Ravi,Meena,Kiran,Latha,Suresh,Divya,Naveen,Padma,Vijay,Rekha,Mohan,Sita,Arjun"
FAMILY = "Rao,Reddy,Naidu,Varma,Sharma,Das,Patnaik,Raju,Iyer,Khan"

_OWNER = f"split_part('{GIVEN}', ',', cast(k % 14 + 1 as int)) || ' ' || split_part('{FAMILY}', ',', cast((k // 14) % 10 + 1 as int))"
_SURVEY = "cast(100 + k // 12 as varchar(20)) || '/' || cast(k % 12 + 1 as varchar(20))"

FIXTURES: dict[str, str] = {
    "parcels": """
SELECT o_orderkey AS k, o_orderkey % 25 AS ward,
  740000e0 + 1000 * (o_orderkey % 25 % 5) + 20 * ((o_orderkey // 25) % 40) AS x0,
  1950000e0 + 5000 * (o_orderkey % 25 // 5) + 25 * ((o_orderkey // 25) // 40) AS y0,
  740020e0 + 1000 * (o_orderkey % 25 % 5) + 20 * ((o_orderkey // 25) % 40) AS x1,
  1950025e0 + 5000 * (o_orderkey % 25 // 5) + 25 * ((o_orderkey // 25) // 40) AS y1
FROM orders""",
    "wards": """
SELECT cast(n_nationkey as bigint) AS ward, n_name AS name, 740000e0 + 1000 * (n_nationkey % 5) AS west, 740800e0 + 1000 * (n_nationkey % 5) AS east,
  1950000e0 + 5000 * (n_nationkey // 5) AS south, 1954000e0 + 5000 * (n_nationkey // 5) AS north FROM nation""",
    "features": f"""
SELECT 'C' || k AS feature_id, 'cadastral' AS source_type, ward, k, x0, y0, x1, y1, true AS is_polygon, {_OWNER} AS owner, {_SURVEY} AS survey_no, cast(null as double) AS height, cast('2019-06-01' as date) AS captured_at FROM parcels
UNION ALL SELECT 'M' || k, 'municipal_gis', ward, k, x0 + ((k * 7) % 13 - 6) * 0.25e0, y0 + ((k * 11) % 13 - 6) * 0.25e0, x1 + ((k * 7) % 13 - 6) * 0.25e0, y1 + ((k * 11) % 13 - 6) * 0.25e0, true,
  CASE WHEN k % 31 = 0 THEN 'Another Person' WHEN k % 11 = 0 THEN substr({_OWNER}, 1, 1) || '. ' || split_part('{FAMILY}', ',', cast((k // 14) % 10 + 1 as int)) ELSE {_OWNER} END,
  CASE WHEN k % 37 = 0 THEN '9/9' ELSE {_SURVEY} END, cast(null as double), cast('2024-04-01' as date) FROM parcels WHERE k % 12 <> 0
UNION ALL SELECT 'B' || k, 'building_footprint', ward, k, x0 + 2e0 + ((k * 3) % 5) * 0.5e0, y0 + 2e0 + ((k * 3) % 5) * 0.5e0, x1 - 2e0 - ((k * 3) % 5) * 0.5e0, y1 - 2e0 - ((k * 3) % 5) * 0.5e0, true, cast(null as varchar(40)), cast(null as varchar(40)), 3e0 + (k % 4) * 3e0, cast('2023-03-15' as date) FROM parcels WHERE k % 7 <> 0
UNION ALL SELECT 'R' || k, 'revenue', ward, k, x0 + 10 + ((k * 5) % 17 - 8) * 0.5e0, y0 + 12.5e0 + ((k * 3) % 17 - 8) * 0.5e0, x0 + 10 + ((k * 5) % 17 - 8) * 0.5e0, y0 + 12.5e0 + ((k * 3) % 17 - 8) * 0.5e0, false,
  CASE WHEN k % 41 = 0 THEN '' ELSE {_OWNER} END, CASE WHEN k % 53 = 0 THEN '8/8' ELSE {_SURVEY} END, cast(null as double), cast('2021-01-15' as date) FROM parcels WHERE k % 20 <> 0
UNION ALL SELECT 'G' || k, 'ground_truth', ward, k, x0 + 10 + ((k // 25) % 7 - 3) * 0.5e0, y0 + 12.5e0 + ((k // 25) % 5 - 2) * 0.5e0, x0 + 10 + ((k // 25) % 7 - 3) * 0.5e0, y0 + 12.5e0 + ((k // 25) % 5 - 2) * 0.5e0, false, cast(null as varchar(40)), cast(null as varchar(40)), cast(null as double), cast('2025-12-05' as date) FROM parcels WHERE (k // 25) % 10 = 3 AND k % 7 <> 0""",
    "footprints_2025": """
SELECT 'F' || k AS feature_id, ward, x0 + CASE WHEN k % 50 IN (20, 30, 40) THEN 0e0 ELSE 0.25e0 END AS x0, y0 + CASE WHEN k % 50 IN (20, 30, 40) THEN 0e0 ELSE 0.25e0 END AS y0,
  x1 + CASE WHEN k % 50 = 30 THEN 8e0 WHEN k % 50 = 40 THEN -4e0 WHEN k % 50 = 20 THEN 0e0 ELSE 0.25e0 END AS x1, y1 + CASE WHEN k % 50 IN (20, 30, 40) THEN 0e0 ELSE 0.25e0 END AS y1,
  CASE WHEN k % 50 = 20 THEN height + 4 ELSE height END AS height, 0.75e0 + (k % 8) * 0.03125e0 AS confidence FROM features WHERE source_type = 'building_footprint' AND k % 50 <> 10
UNION ALL SELECT 'N' || k, ward, x0 + 5, y0 + 5, x0 + 13, y0 + 13, 3e0, 0.875e0 FROM parcels WHERE k % 21 = 0
UNION ALL SELECT 'U' || ward || '_' || m, ward, west + 30 * m, south - 40, west + 30 * m + 10, south - 30, 3e0, 0.8125e0 FROM wards CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS four""",
    "detections": """
SELECT event_id AS id, user_id % 25 AS ward, ts AS detected_at, CASE WHEN event_type IN ('error', 'signup') THEN 'change_of_use' ELSE 'new_build' END AS detection_type,
  CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' WHEN 2 THEN 'underassessed' WHEN 3 THEN 'rejected' WHEN 4 THEN 'compliant' END AS status,
  floor(value) * 1e0 AS area_sqm, (event_id % 64) / 64e0 AS confidence FROM events""",
    "tickets": """
SELECT o_orderkey AS id, o_orderkey % 25 AS ward, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'under_review' END AS status FROM orders""",
    "matches": """
SELECT a.feature_id AS a_id, b.feature_id AS b_id, a.source_type AS a_type, b.source_type AS b_type, a.ward, CASE WHEN a.is_polygon AND b.is_polygon THEN
  greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) /
  ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) END AS iou,
  50e0 + a.k % 50 AS match_score
FROM features AS a JOIN features AS b ON a.k = b.k AND a.source_type = 'cadastral' AND b.source_type IN ('municipal_gis', 'building_footprint', 'revenue')""",
}
#: The derived and given tables that a fixture reads.
_NEEDS = {name: [other for other in ("orders", "nation", "events", *FIXTURES) if other != name and re.search(rf"\b(?:FROM|JOIN) {other}\b", sql)] for name, sql in FIXTURES.items()}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or given table over sf_dir."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"varchar\(\d+\)", "string", FIXTURES[name].replace("//", "div"))
    return spark.sql(
        re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in _NEEDS[name] else m[0], sql),
        **{other: fixture(spark, sf_dir, other) for other in _NEEDS[name]},
    )


def ctes(*names: str) -> str:
    """WITH clause that defines the fixtures in DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            visit(other)
        if name in FIXTURES and name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({FIXTURES[n]})" for n in order)


def properties(features: DataFrame) -> DataFrame:
    """features with the property bag that a reader would give, null values left out."""
    pair = lambda key, column: F.struct(F.lit(key).alias("k"), F.col(column).cast("string").alias("v"))
    owner = F.when(F.col("source_type") == "municipal_gis", F.lit("owner")).otherwise(F.lit("owner_name"))
    entries = F.array(F.struct(owner.alias("k"), F.col("owner").alias("v")), pair("survey_no", "survey_no"), pair("height_m", "height"))
    bag = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return features.withColumn("properties", bag).withColumn("source_id", F.concat_ws("-", "source_type", "ward"))

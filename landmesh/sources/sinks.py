"""Sinks: partitioned features, GeoJSON lines, flat tables, detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmesh.functions.shapes import to_geojson


def write_features(features: DataFrame, path: str) -> None:
    """Parquet by ward; a run without any feature is an error."""
    if features.isEmpty():
        raise ValueError("no features to write")
    features.write.mode("append").partitionBy("ward").parquet(path)


def geojson_lines(golden: DataFrame) -> DataFrame:
    """One GeoJSON Feature a line: attributes with provenance, confidence and conflict count.

    The geometry is `geom.shape` where golden records have one, else the box.
    """
    box = lambda a, b: F.array(F.col(f"geom.x{a}"), F.col(f"geom.y{b}"))
    ring = F.array(box(0, 0), box(1, 0), box(1, 1), box(0, 1), box(0, 0))
    geometry = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    if "shape" in golden.schema["geom"].dataType.names:
        geometry = F.coalesce(to_geojson("geom.shape"), geometry)
    extra = F.to_json(F.struct(F.col("provenance").alias("_provenance"), F.col("confidence").alias("_confidence"), F.col("conflict_count").alias("_conflict_count")), {"ignoreNullFields": "false"})
    own = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("_provenance", "_confidence", "_conflict_count"))
    joined = F.concat(F.lit("{"), F.expr("substring(own, 2, length(own) - 2)"), F.when(F.length("own") > 2, ",").otherwise(""), F.expr("substring(extra, 2)"))
    rows = golden.select(geometry.alias("geometry"), F.to_json(own).alias("own"), extra.alias("extra"))
    return rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), "geometry", F.lit(',"properties":'), joined, F.lit("}")).alias("value"))


def flat(golden: DataFrame, most: int = 2000) -> DataFrame:
    """Every attribute key as a text column, '' where missing, with hp_id and confidence.

    The number of columns is checked; keys are few by nature.
    """
    keys = [r.key for r in golden.select(F.explode(F.map_keys("attributes")).alias("key")).distinct().orderBy("key").limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} attribute keys")
    cells = [F.coalesce(F.col("attributes")[k], F.lit("")).alias(k) for k in keys if k not in ("hp_id", "confidence")]
    return golden.select(F.col("cluster").alias("hp_id"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), *cells)


def detections_table(detections: DataFrame, wards: DataFrame) -> DataFrame:
    """Detections with ward names, status 'pending' where there is none, surest first."""
    return detections.join(wards.select("ward", F.col("name").alias("ward_name")), "ward", "left").withColumn("status", F.coalesce("status", F.lit("pending"))).orderBy(F.desc("confidence"), "id")

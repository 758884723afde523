"""Readers of feature files: GeoJSON, CSV points, CSV with WKT, GPX, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from landmesh.functions.geometry import CODES, from_geojson, from_wkt, transform, from_wkb

#: Coordinate column names in order of preference (fixed values).
LON, LAT = ["lon", "lng", "longitude", "x"], ["lat", "latitude", "y"]
_FEATURE = "struct<id:string,geometry:string,properties:string>"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of collections or lone features: geom, properties, crs (EPSG:4326 if none is named).

    Features without geometry are dropped.
    """
    schema = f"type string, features array<{_FEATURE}>, id string, geometry string, properties string, crs struct<properties:struct<name:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    lone = F.array(F.struct("id", "geometry", "properties"))
    rows = raw.select(F.coalesce("crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.explode(F.coalesce("features", lone)).alias("f"))
    return rows.select("crs", F.col("f.id").alias("id"), from_geojson("f.geometry").alias("geom"), F.from_json("f.properties", "map<string,string>").alias("properties")).filter("geom.xs is not null")


def geojson_lines(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Line-delimited, maybe compressed, features whose first vertex is in a box (west, south, east, north)."""
    rows = spark.read.schema("geometry struct<type:string,coordinates:string>, properties string").json(path)
    number = lambda i: F.regexp_extract("geometry.coordinates", r"\[+\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)", i).try_cast("double")
    if box:
        rows = rows.filter(number(1).between(box[0], box[2]) & number(2).between(box[1], box[3]))
    text = F.to_json(F.struct(F.col("geometry.type").alias("type"))).substr(F.lit(1), F.length(F.to_json(F.struct(F.col("geometry.type").alias("type")))) - 1)
    whole = F.concat(text, F.lit(',"coordinates":'), "geometry.coordinates", F.lit("}"))
    return rows.select(from_geojson(whole).alias("geom"), F.from_json("properties", "map<string,string>").alias("properties")).filter("geom.xs is not null")


def _named(columns: list[str], wanted: list[str]) -> str | None:
    plain = {c.strip().lstrip("﻿").lower(): c for c in reversed(columns)}
    return next((plain[w] for w in wanted if w in plain), None)


def csv_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a CSV file with a header: x, y and the other columns as properties.

    Rows without usable coordinates are skipped; without coordinate columns it is an error.
    """
    rows = spark.read.option("header", True).csv(path)
    lon, lat = _named(rows.columns, LON), _named(rows.columns, LAT)
    if lon is None or lat is None:
        raise ValueError(f"no coordinate columns among {rows.columns}: one of {LON} and one of {LAT} is needed")
    quoted = lambda c: F.col(f"`{c}`")
    pairs = [F.struct(F.lit(c.strip().lstrip("﻿")).alias("k"), quoted(c).alias("v")) for c in rows.columns if c not in (lon, lat)]
    bag = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(quoted(lon).try_cast("double").alias("x"), quoted(lat).try_cast("double").alias("y"), bag.alias("properties")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


def csv_wkt(spark: SparkSession, path: str, least: float = 0.75) -> DataFrame:
    """Polygons of a CSV file with columns geometry (WKT) and confidence of at least `least`."""
    rows = spark.read.option("header", True).csv(path).filter(F.col("confidence").try_cast("double") >= least)
    return rows.select(from_wkt("geometry").alias("geom"), F.col("confidence").cast("double").alias("confidence")).filter("geom.xs is not null")


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """Way points with name, ele, desc and time."""
    schema = "_lat double, _lon double, name string, ele double, desc string, time timestamp"
    rows = spark.read.format("xml").option("rowTag", "wpt").schema(schema).load(path)
    return rows.select(F.col("_lon").alias("x"), F.col("_lat").alias("y"), "name", "ele", F.col("desc").alias("description"), "time")


def reader_of(path: Column, source_type: Column) -> Column:
    """Which reader takes a file: by its extension, else by the type of its source."""
    extension = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)(?:\.gz)?$", 1)
    by_name = {"geojson": "geojson", "json": "geojson", "geojsonl": "geojson_lines", "csv": "csv_points", "gpx": "gpx", "tif": "raster", "tiff": "raster", "pdf": "scan", "zip": "archive"}
    out = F.when(F.lit(False), "")
    for k, v in by_name.items():
        out = out.when(extension == k, v)
    return out.when(source_type.isin("ground_truth", "gnss_cors"), "csv_points").when(source_type.isin("ori", "dsm_dtm", "drone_imagery"), "raster").otherwise("geojson")


def manifest(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """Files of ward manifests that are not in `done` (ward_id, path) yet."""
    schema = "ward_id string, files array<struct<path:string,type:string,crs:string,captured_at:string>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path).select("ward_id", F.inline("files"))
    files = files.withColumn("captured_at", F.col("captured_at").try_cast("timestamp"))
    return files if done is None else files.join(done.select("ward_id", "path"), ["ward_id", "path"], "left_anti")


def resolved_crs(declared: Column, embedded: Column, kind: Column) -> Column:
    """Declared, else embedded, else what the format implies; null where none of them says it."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(declared), some(embedded), F.when(kind.isin("geojson", "gpx"), "EPSG:4326"))


def quarantined(features: DataFrame, crs: str = "crs", count: Observation | None = None) -> DataFrame:
    """features with srid, the code of their coordinate system, and reason, why it can't be used.

    A reason is null for good rows; rows with one have no srid and belong in a table of their own
    (`split_quarantine`). `count` gets the numbers of both, good and bad, in the same pass.
    """
    code = F.regexp_extract(F.upper(F.col(crs)), r"^\s*(?:URN:OGC:DEF:CRS:)?EPSG:(?:[0-9.]*:)?([0-9]{1,9})\s*$", 1).try_cast("int")
    code = F.when(F.upper(F.trim(crs)).isin("CRS84", "OGC:CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84", "URN:OGC:DEF:CRS:OGC::CRS84"), 4326).otherwise(code)
    known = code.isin(CODES)
    reason = F.when(F.col(crs).isNull() | (F.trim(crs) == ""), "no coordinate system").when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown coordinate system "), F.trim(crs)))
    out = features.withColumn("srid", F.when(known, code)).withColumn("reason", reason)
    return out if count is None else out.observe(count, F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason").isNotNull()).alias("bad"))


def split_quarantine(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows of `quarantined`, written once, as two parts of one table."""
    rows.withColumn("quarantine", F.col("reason").isNotNull()).write.partitionBy("quarantine").parquet(path)
    whole = rows.sparkSession.read.schema(rows.schema.add("quarantine", "boolean")).parquet(path)
    return whole.filter("not quarantine").drop("quarantine", "reason"), whole.filter("quarantine").drop("quarantine", "srid")


def normalized_points(points: DataFrame, source: int, target: int = 4326) -> DataFrame:
    """points with x and y moved to the target system."""
    return points.withColumn("__p", transform(F.col("x"), F.col("y"), source, target)).withColumn("x", F.col("__p.x")).withColumn("y", F.col("__p.y")).drop("__p")


def wkb_parquet(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of Parquet files with a `bbox` struct and `geometry` as well-known binary that lie
    inside a box; `geom` takes the place of the geometry, `source` is the first source's data set.

    The box goes down to the scan, so that row groups beyond it aren't read.
    """
    b = F.col("bbox")
    rows = spark.read.parquet(path).filter((b["xmin"] > west) & (b["xmax"] < east) & (b["ymin"] > south) & (b["ymax"] < north))
    first = F.try_element_at("sources", F.lit(1))["dataset"] if "sources" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({"geom": from_wkb("geometry"), "source": first}).drop("geometry", "sources", "bbox")

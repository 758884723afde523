"""Spatial joins on a grid: candidates, overlaps, epochs, coverage and assignments.

A join's key is (partition column, cell). Boxes go to every cell that they touch, and a pair counts
only in the smallest cell that both touch, so that no distinct is needed. Boxes of more than
MANY_CELLS cells would flood the grid; they are matched at a coarser one, whose cells double until
no box touches more. Geometry is computed for pairs whose boxes meet only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmesh.functions import geometry as geo
from landmesh.functions import shapes
from landmesh.functions.scoring import match_score

CELL = 64.0
#: Cells for boxes that bring their shapes along, which are dear to repeat.
WIDE_CELL = 128.0
MANY_CELLS = 64
PRUNE, LEAST_IOU, REACH = 33.0, 0.30, 25.0
#: Layers that are not matched by place (fixed values).
UNMATCHED = ["ori", "drone_imagery", "dsm_dtm", "utility", "gnss_cors"]


def _cells(df: DataFrame, cell: float, level: str | None = None) -> DataFrame:
    side = F.lit(cell) * (F.pow(F.lit(2.0), F.col(level)) if level else F.lit(1.0))
    axis = lambda v: F.explode(F.sequence(F.floor(F.col(f"{v}0") / side), F.floor(F.col(f"{v}1") / side)))
    return df.withColumn("cx", axis("x")).withColumn("cy", axis("y"))


def _level(df: DataFrame, cell: float) -> DataFrame:
    """The grid on which a box touches few cells: 0, or by how often the cell must double."""
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / (cell * MANY_CELLS**0.5)
    return df.withColumn("level", F.when(span <= 1, 0).otherwise(F.ceil(F.log2(span))).cast("int"))


def _renamed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keep))


def box_pairs(a: DataFrame, b: DataFrame, by: list[str], cell: float = CELL) -> DataFrame:
    """Pairs of rows whose boxes (x0, y0, x1, y1) touch, equal in `by`; columns get a_ and b_.

    Rows with null boxes or keys pair with nothing.
    """
    a, b = (_level(x.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null"), cell) for x in (a, b))
    # Levels that occur are few, so that each side is repeated once for each of the other's levels.
    levels = F.array_distinct(F.array(F.lit(0), F.col("level")))
    top = a.select("level").unionByName(b.select("level")).agg(F.coalesce(F.max("level"), F.lit(0)).alias("m")).first().m
    if top:
        every = [F.lit(i) for i in range(top + 1)]
        a = a.withColumn("grid", F.explode(F.filter(F.array(*every), lambda g: g >= F.col("level"))))
        b = b.withColumn("grid", F.explode(F.filter(F.array(*every), lambda g: g >= F.col("level"))))
    else:
        a, b = a.withColumn("grid", F.element_at(levels, 1)), b.withColumn("grid", F.lit(0))
    keys = [*by, "grid", "cx", "cy"]
    left, right = (_renamed(_cells(x, cell, "grid"), p, keys) for x, p in ((a, "a_"), (b, "b_")))
    pairs = left.join(right, keys)
    side = F.lit(cell) * F.pow(F.lit(2.0), F.col("grid"))
    first = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / side)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / side))
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    # A pair belongs to the grid of the larger of its two boxes.
    return pairs.filter((F.col("grid") == F.greatest("a_level", "b_level")) & first & meet).drop("grid", "cx", "cy", "a_level", "b_level", "a_grid", "b_grid")


def with_overlap(pairs: DataFrame) -> DataFrame:
    """pairs with `overlap`, the shared area; by expressions where neither side has a `geom`."""
    if "a_geom" in pairs.columns and "b_geom" in pairs.columns:
        return pairs.withColumn("overlap", geo.overlay.asNondeterministic()("a_geom", "b_geom")["both"])
    return pairs.withColumn("overlap", geo.rectangle_overlap("a_", "b_"))


def area(df: DataFrame, prefix: str = "") -> Column:
    return geo.measures(f"{prefix}geom")["area"] if f"{prefix}geom" in df.columns else geo.rectangle_area(prefix)


def candidate_pairs(features: DataFrame, least_iou: float = LEAST_IOU, reach: float = REACH) -> DataFrame:
    """Pairs of features of one ward and different source types that may be the same thing.

    Two polygons need an IoU of least_iou, a pair with a point a distance of `reach` between
    centroids. features: feature_id, source_type, ward, is_polygon, box and optionally geom. Each
    pair comes once, a_id before b_id.
    """
    f = features.filter(~F.col("source_type").isin(UNMATCHED)).select(
        "ward", F.col("feature_id").alias("id"), F.col("source_type").alias("type"), "is_polygon", "x0", "y0", "x1", "y1", *(["geom"] if "geom" in features.columns else [])
    )
    f = f.withColumn("cxm", (F.col("x0") + F.col("x1")) / 2).withColumn("cym", (F.col("y0") + F.col("y1")) / 2)
    polygons = f.filter("is_polygon")
    both = box_pairs(polygons, polygons, ["ward"]).filter("a_id < b_id and a_type <> b_type")
    both = with_overlap(both)
    both = both.withColumn("iou", F.col("overlap") / (area(both, "a_") + area(both, "b_") - F.col("overlap"))).filter(F.col("iou") >= least_iou)
    # Centroids in cells of the reach: a point looks into its own and the eight around it.
    plain = f.drop("geom") if "geom" in f.columns else f
    at = lambda v: F.floor(F.col(v) / reach)
    around = lambda v: F.explode(F.sequence(at(v) - 1, at(v) + 1))
    points = plain.filter("not is_polygon").withColumn("gx", around("cxm")).withColumn("gy", around("cym"))
    others = plain.withColumn("gx", at("cxm")).withColumn("gy", at("cym"))
    keys = ["ward", "gx", "gy"]
    near = _renamed(points, "p_", keys).join(_renamed(others, "q_", keys), keys).filter("p_type <> q_type and (q_is_polygon or p_id < q_id)")
    near = near.withColumn("dist_m", F.hypot(F.col("p_cxm") - F.col("q_cxm"), F.col("p_cym") - F.col("q_cym"))).filter(F.col("dist_m") <= reach)
    pick = lambda c: [F.when(F.col("p_id") < F.col("q_id"), F.col(f"{s}_{c}")).otherwise(F.col(f"{t}_{c}")).alias(f"{o}_{c}") for o, s, t in (("a", "p", "q"), ("b", "q", "p"))]
    point_pairs = near.select("ward", *pick("id"), *pick("type"), F.lit(None).cast("double").alias("iou"), "dist_m")
    polygon_pairs = both.select("ward", "a_id", "b_id", "a_type", "b_type", "iou", F.hypot(F.col("a_cxm") - F.col("b_cxm"), F.col("a_cym") - F.col("b_cym")).alias("dist_m"))
    return polygon_pairs.unionByName(point_pairs).withColumn("match_score", match_score("iou", "dist_m", reach))


def self_overlaps(features: DataFrame, least: float = 0.25, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Pairs inside one source that share more than `least` of area; touching is none."""
    pairs = with_overlap(box_pairs(features, features, list(by)).filter("a_feature_id < b_feature_id"))
    return pairs.filter(F.col("overlap") > least).select(*by, F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"), "overlap")


def coverage(structures: DataFrame, parcels: DataFrame, by: tuple[str, ...] = ("ward",)) -> DataFrame:
    """Structure × parcel pairs with shared area and the structure's area; the base of all findings."""
    pairs = with_overlap(box_pairs(structures, parcels, list(by), WIDE_CELL if "geom" in parcels.columns else CELL))
    return pairs.withColumn("area", area(pairs, "a_")).select(*by, F.col("a_feature_id").alias("structure_id"), F.col("b_feature_id").alias("parcel_id"), "overlap", "area")


def unregistered(structures: DataFrame, pairs: DataFrame, share: float = 0.20) -> DataFrame:
    """Structures of which no parcel covers more than `share`."""
    covered = pairs.filter(F.col("overlap") > share * F.col("area")).select(F.col("structure_id").alias("feature_id")).distinct()
    return structures.join(covered, "feature_id", "left_anti")


def encroachments(pairs: DataFrame, outside: float = 0.15, inside: float = 0.20) -> DataFrame:
    """Structures of which more than `outside` lies outside their largest parcel, more than `inside` in it."""
    best = Window.partitionBy("structure_id").orderBy(F.desc("overlap"), "parcel_id")
    top = pairs.withColumn("n", F.row_number().over(best)).filter("n = 1 and area > 0").drop("n")
    out = top.withColumn("outside_area", F.col("area") - F.col("overlap")).withColumn("outside_share", F.col("outside_area") / F.col("area"))
    return out.filter((F.col("outside_share") > outside) & (F.col("overlap") / F.col("area") > inside))


def with_outside(found: DataFrame, structures: DataFrame, parcels: DataFrame) -> DataFrame:
    """Encroachments with `outside`, the shape of the structure's ground outside its parcel."""
    side = lambda df, p: df.select(F.col("feature_id").alias(f"{p}_id"), F.col("geom").alias(f"__{p}"))
    rows = found.join(side(structures, "structure"), "structure_id").join(side(parcels, "parcel"), "parcel_id")
    return rows.withColumn("outside", shapes.difference("__structure", "__parcel")).drop("__structure", "__parcel")


def vacant(parcels: DataFrame, structures: DataFrame, by: tuple[str, ...] = ("ward",)) -> DataFrame:
    """Parcels that no structure touches."""
    touched = box_pairs(parcels.select(*by, "feature_id", "x0", "y0", "x1", "y1", *(["geom"] if "geom" in parcels.columns else [])), structures, list(by))
    if "a_geom" in touched.columns and "b_geom" in touched.columns:
        touched = touched.filter((geo.overlay("a_geom", "b_geom")["both"] > 0) | (geo.hausdorff_distance("a_geom", "b_geom") == 0))
    return parcels.join(touched.select(F.col("a_feature_id").alias("feature_id")).distinct(), "feature_id", "left_anti")


def points_in(points: DataFrame, polygons: DataFrame, id: str, by: tuple[str, ...] = (), cell: float = 1000.0) -> DataFrame:
    """points with the smallest polygon id that contains them, null if none does (at most one each)."""
    p = points.withColumn("x0", F.col("x")).withColumn("x1", F.col("x")).withColumn("y0", F.col("y")).withColumn("y1", F.col("y"))
    hits = box_pairs(p.select(*by, "point_id", "x0", "y0", "x1", "y1"), polygons.select(*by, id, "x0", "y0", "x1", "y1", *(["geom"] if "geom" in polygons.columns else [])), list(by), cell)
    hits = hits.filter(geo.covers("b_geom", "a_x0", "a_y0")) if "b_geom" in hits.columns else hits.filter("a_x0 < b_x1 and a_y0 < b_y1")
    return points.join(hits.groupBy(F.col("a_point_id").alias("point_id")).agg(F.min(f"b_{id}").alias(id)), "point_id", "left")


def nearest(points: DataFrame, boxes: DataFrame, id: str, most: int = 100_000) -> DataFrame:
    """points with the id of the nearest box, 0 away if inside; `boxes` is a table of few rows.

    Its size is checked, since every point is compared with every box.
    """
    n = boxes.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} boxes: assign by points_in on a grid instead")
    few = boxes.agg(F.collect_list(F.struct(F.col(id).alias("id"), "x0", "y0", "x1", "y1")).alias("boxes"))
    gap = lambda b, v: F.greatest(F.lit(0.0), b[f"{v}0"] - F.col(v), F.col(v) - b[f"{v}1"])
    best = F.array_min(F.transform("boxes", lambda b: F.struct(F.hypot(gap(b, "x"), gap(b, "y")).alias("distance"), b["id"].alias("id"))))
    return points.join(F.broadcast(few)).withColumn("best", best).select(*points.columns, F.col("best.id").alias(id), F.col("best.distance").alias("distance"))


def density(points: DataFrame, side: float = 100.0, least: int = 5) -> DataFrame:
    """Cells of a square grid with at least so many points."""
    return points.groupBy(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)

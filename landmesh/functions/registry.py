"""The library's functions for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from landmesh.functions import geometry, scoring, shapes

#: SQL functions of one expression: name, parameters with types, and the expression over them.
EXPRESSIONS = {
    "reliability": ("source_type string", lambda a: scoring.reliability(a)),
    "match_score": ("iou double, dist double", lambda a, b: scoring.match_score(a, b)),
    "score_band": ("score double", lambda a: scoring.score_band(a)),
    "compactness": ("area double, perimeter double", lambda a, b: scoring.compactness(a, b)),
    "conflict_type": ("n_fields int, iou double", lambda a, b: scoring.conflict_type(a, b)),
    "severity": ("score double, share double, iou double", lambda a, b, c: scoring.severity(a, b, c)),
    "utm_srid": ("lon double, lat double", lambda a, b: scoring.utm_srid(a, b)),
    "normal_name": ("name string", lambda a: scoring.normal_name(a)),
    "quadkey": ("lon double, lat double", lambda a, b: scoring.quadkey(a, b)),
}
#: Arrow functions.
VECTORISED = {
    "geom_from_geojson": geometry.from_geojson, "geom_from_wkt": geometry.from_wkt, "geom_from_wkb": geometry.from_wkb, "geom_to_wkb": geometry.to_wkb, "geom_to_geojson": shapes.to_geojson,
    "geom_overlay": geometry.overlay, "geom_measures": geometry.measures, "geom_hausdorff": geometry.hausdorff_distance, "geom_covers": geometry.covers,
    "geom_intersection": shapes.intersection, "geom_difference": shapes.difference, "geom_union": shapes.union, "geom_repaired": shapes.repaired, "text_ratio": scoring.sequence_ratio,
}


@F.udtf(returnType="cx: bigint, cy: bigint")
class CellsOf:
    """Cells of a square grid that a box touches, a row each: cells_of(x0, y0, x1, y1, side)."""

    def eval(self, x0: float, y0: float, x1: float, y1: float, side: float):
        import math

        if None in (x0, y0, x1, y1, side):
            return
        for cx in range(math.floor(x0 / side), math.floor(x1 / side) + 1):
            for cy in range(math.floor(y0 / side), math.floor(y1 / side) + 1):
                yield cx, cy


def register_functions(spark: SparkSession, prefix: str = "lm_") -> list[str]:
    """Register all functions with a session under prefix + name; their names.

    Those of one expression become temporary SQL functions, which the optimizer sees through; the
    others are Arrow functions, and `cells_of` a table function.
    """
    done = []
    for name, (parameters, make) in EXPRESSIONS.items():
        names = [p.split()[0] for p in parameters.split(", ")]
        text = _sql(spark, make(*map(F.col, names)), parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters.replace(' ', ' ')}) RETURN {text}")
        done.append(prefix + name)
    for name, f in VECTORISED.items():
        spark.udf.register(prefix + name, f)
        done.append(prefix + name)
    spark.udtf.register(f"{prefix}cells_of", CellsOf)
    return [*done, f"{prefix}cells_of"]


def _sql(spark: SparkSession, column, parameters: str) -> str:
    """A column expression as SQL text, resolved against its parameters."""
    schema = StructType.fromDDL(parameters)
    assert all(f.dataType != StringType() or f.name for f in schema)
    plan = spark.createDataFrame([], schema).select(column.alias("v"))
    return plan._jdf.queryExecution().analyzed().expressions().head().child().sql()

"""Features end to end: coordinates to one system, repair marks, boxes, profiles."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmesh.functions import batches
from landmesh.functions.geometry import CODES, GEOM, _struct, from_lonlat, to_lonlat
from landmesh.functions.shapes import checked
from landmesh.operators.quality import profile


def reprojected(features: DataFrame, target: int = 4326, code: str = "srid") -> DataFrame:
    """features (geom, srid) with geom in the target system; rows of an unknown code are an error."""
    known = F.col(code).isin(CODES)
    checked = F.when(known, F.col(code)).otherwise(F.raise_error(F.concat(F.lit("unknown coordinate system "), F.coalesce(F.col(code).cast("string"), F.lit("null")))).cast("int"))

    @F.arrow_udf(GEOM)
    def move(g: pa.Array, srid: pa.Array) -> pa.Array:
        g = batches.from_arrow(g)
        of = srid.to_numpy(zero_copy_only=False)[g.row_of_ring[g.ring_of_vertex]]
        x, y = g.x.copy(), g.y.copy()
        for source in np.unique(of).tolist():
            some = of == source
            x[some], y[some] = from_lonlat(*to_lonlat(g.x[some], g.y[some], int(source)), target)
        return _struct(GEOM, batches.to_arrow(replace(g, x=x, y=y)))

    return features.withColumn("geom", move("geom", checked)).withColumn(code, F.lit(target))


def normalized(features: DataFrame, target: int = 4326) -> tuple[DataFrame, DataFrame]:
    """Features with a geometry, in the target system, with box and measures; and their profile.

    features: source_id, geom, srid, properties. A ring that crosses itself comes out as the parts
    that the even-odd rule leaves, and its feature is marked was_invalid.
    """
    rows = reprojected(features.filter("geom.xs is not null and size(geom.xs) > 0"), target)
    rows = rows.withColumn("m", checked("geom"))
    rows = rows.withColumn("geom", F.struct(*(F.col(f"m.{f.name}") for f in GEOM.fields))).withColumn("was_invalid", F.col("m.was_invalid"))
    out = rows.select(*(c for c in rows.columns if c != "m"), F.col("m.area").alias("area"), F.col("m.cx").alias("x"), F.col("m.cy").alias("y"), F.col("geom.xmin").alias("x0"), F.col("geom.ymin").alias("y0"), F.col("geom.xmax").alias("x1"), F.col("geom.ymax").alias("y1"))
    return out, profile(out)

"""Polygons as cells of a quadtree: joins by cell instead of by geometry.

A polygon's covering has inner cells, which lie inside it as a whole, and cells that its boundary
crosses. A point in an inner cell needs no test; nor do two polygons of which one has an inner cell
where the other has any. Cells are halved until no edge crosses them, at most `depth` times from
the smallest square that is as wide as the polygon. A cell is (level, ix, iy), its side 2 ** level.

Cells are made, and edges compared, for whole Arrow batches; only the joins shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmesh.functions import batches, planar
from landmesh.functions.geometry import meet
from landmesh.operators.matching import stored
from landmesh.operators.spatial import box_pairs

DEPTH = 5
#: Smallest level of a covering, for polygons without extent.
FINEST = -20


#: Vertices up to which two polygons are compared as they are.
FEW = 16
#: Polygons whose cells are made at once.
ROWS = 2000


def covering(polygons: DataFrame, id: str, depth: int = DEPTH) -> DataFrame:
    """id, level, ix, iy and whether the cell is `inner`, of polygons (id, geom); null geometries have no cell."""

    def cells(arrived):
        for batch in arrived:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                row, level, ix, iy, inner = batches.covering(batches.from_arrow(part.column(1)), depth, FINEST)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(level, pa.int32()), pa.array(ix), pa.array(iy), pa.array(inner)], names=[id, "level", "ix", "iy", "inner"])

    rows = polygons.filter("geom.xs is not null").select(F.col(id).alias(id), "geom")
    return rows.mapInArrow(cells, f"`{id}` {rows.schema[id].dataType.simpleString()}, level int, ix long, iy long, inner boolean")


def _levels(cells: DataFrame) -> list[int]:
    """Levels that occur, few as each is a doubling."""
    return sorted(r.level for r in cells.select("level").distinct().collect())


def assigned(points: DataFrame, polygons: DataFrame, id: str, depth: int = DEPTH) -> DataFrame:
    """points (x, y) with the smallest id of the polygons (id, geom) that hold them, null if none does.

    `tested` says whether the point had to be compared with a polygon's edges. Points that repeat
    come out as often. Very many points may share a cell: the join splits its partition.
    """
    cells = stored(covering(polygons, id, depth), "covering")
    rows = stored(points.withColumn("__p", F.monotonically_increasing_id()), "points")
    levels = _levels(cells)
    if not levels:
        return points.withColumn(id, F.lit(None).cast(polygons.schema[id].dataType)).withColumn("tested", F.lit(False))
    at = rows.filter("x is not null and y is not null").select("__p", "x", "y", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    hits = at.withColumn("ix", F.floor(F.col("x") / side)).withColumn("iy", F.floor(F.col("y") / side)).join(cells, ["level", "ix", "iy"])
    hits = stored(hits.select("__p", "x", "y", id, "inner"), "hits")
    edge = polygons.select(F.col(id).alias(id), planar.edges("geom").alias("__all"))
    near = hits.filter("not inner").join(edge, id).select("__p", id, planar.inside("__all", "x", "y").alias("in"), F.lit(True).alias("t"))
    both = hits.filter("inner").select("__p", id, F.lit(True).alias("in"), F.lit(False).alias("t")).unionByName(near)
    best = both.groupBy("__p").agg(F.min(F.when(F.col("in"), F.col(id))).alias(id), F.bool_or("t").alias("tested"))
    return rows.join(best, "__p", "left").select(*points.columns, id, F.coalesce("tested", F.lit(False)).alias("tested"))


def intersecting(a: DataFrame, b: DataFrame, a_id: str, b_id: str, depth: int = DEPTH) -> DataFrame:
    """Pairs of ids of polygons (id, geom) that have a point in common; `tested` as in `assigned`.

    Two polygons of few vertices are compared where their boxes meet, which takes less than their
    cells would. A pair with one of more vertices is found where a cell of one is a cell of the
    other or lies in one. If the larger of the two cells is inner, that settles it; edges are
    compared where no cell does.
    """
    a, b = (x.filter("geom.xs is not null").select(F.col(i).alias(p), "geom") for x, i, p in ((a, a_id, "__a"), (b, b_id, "__b")))
    many = F.size("geom.xs") > FEW
    side = F.greatest(F.col("geom.xmax") - F.col("geom.xmin"), F.col("geom.ymax") - F.col("geom.ymin"))
    fact = [x.agg(F.count_if(many).alias("many"), F.count_if(~many).alias("few"), F.avg(F.when(~many, side)).alias("side")).first() for x in (a, b)]
    out = [a.select("__a").join(b.select("__b").limit(0)).withColumn("tested", F.lit(False)).limit(0)]
    if all(f.few for f in fact):
        boxes = [x.filter(~many).select("*", *(F.col(f"geom.{v}{m}").alias(f"{v}{i}") for v in "xy" for m, i in (("min", 0), ("max", 1)))) for x in (a, b)]
        cell = max(*(f.side for f in fact), 2.0**FINEST) * 4
        near = box_pairs(*boxes, [], cell).filter(meet("a_geom", "b_geom"))
        out.append(near.select(F.col("a___a").alias("__a"), F.col("b___b").alias("__b"), F.lit(True).alias("tested")))
    if fact[0].many:
        out.append(_by_cells(a.filter(many), b, depth))
    if fact[1].many:
        out.append(_by_cells(a.filter(~many), b.filter(many), depth))
    every = out[-1]
    for more in out[1:-1]:
        every = every.unionByName(more)
    return every.select(F.col("__a").alias("a_id"), F.col("__b").alias("b_id"), "tested")


def _by_cells(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Pairs (__a, __b) of polygons that meet, by their coverings."""
    ca, cb = (stored(covering(x, p, depth), "covering") for x, p in ((a, "__a"), (b, "__b")))

    def above(cells: DataFrame, levels: list[int], least: int) -> DataFrame:
        """Cells with their ancestors at those levels, at least so many steps up."""
        fits = F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col("level") + least)
        up = cells.withColumn("l", F.explode(fits))
        own = lambda v: F.expr(f"shiftright({v}, l - level)")
        return up.select(cells.columns[0], F.col("inner").alias("low_inner"), (F.col("l") == F.col("level")).alias("same"), own("ix").alias("ix"), own("iy").alias("iy"), F.col("l").alias("level"))

    la, lb = _levels(ca), _levels(cb)
    if not la or not lb:
        return a.select("__a").join(b.select("__b").limit(0)).withColumn("tested", F.lit(False)).limit(0)
    keys = ["level", "ix", "iy"]
    sure = F.col("inner") | (F.col("same") & F.col("low_inner"))
    met = [above(x, levels, least).join(y, keys).select("__a", "__b", sure.alias("sure")) for x, levels, least, y in ((ca, lb, 0, cb), (cb, la, 1, ca))]
    pairs = stored(met[0].unionByName(met[1]).groupBy("__a", "__b").agg(F.bool_or("sure").alias("sure")), "pairs")
    shape = lambda df, p: df.select(p, F.col("geom").alias(f"{p}_g"))
    test = pairs.filter("not sure").join(shape(a, "__a"), "__a").join(shape(b, "__b"), "__b").filter(meet("__a_g", "__b_g"))
    return pairs.filter("sure").select("__a", "__b", F.lit(False).alias("tested")).unionByName(test.select("__a", "__b", F.lit(True).alias("tested")))

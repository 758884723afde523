"""The nearest shape of each point, by rings of cells that widen until the best distance bounds them.

Shapes lie in square cells of a grid fit to them; where one would take many, in a coarser grid,
whose cells double. A point first looks for a cell with a shape's vertex among its own and the eight around
it, on grids ever coarser, which bounds its distance. From there it goes down again, keeping the
cells that the bound reaches, which falls on the way, and compares itself with their shapes. No
point meets shapes that its bound leaves out, however far away all of them are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmesh.functions import planar
from landmesh.functions.geometry import point_distance
from landmesh.operators.matching import stored

#: A shape's box takes at most this many cells a side, but for one more where it straddles.
SPAN = 4
#: Cells a side of the coarse look that the grid is fit by.
COARSE = 64
#: Bounds are compared with so much room for rounding.
SLACK = 1 + 1e-12


def _box(cell: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column, Column]:
    return cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell


def _side(cell: float, level) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), level)


def _around(rows: DataFrame, cell: float, level) -> DataFrame:
    """rows (x, y, bound) with a row for each cell of a level within their bound."""
    side = _side(cell, level)
    span = lambda v: F.explode(F.sequence(F.floor((F.col(v) - F.col("bound")) / side), F.floor((F.col(v) + F.col("bound")) / side)))
    out = rows.withColumn("cx", span("x")).withColumn("cy", span("y"))
    return out.filter(planar.box_distance("x", "y", *_box(side, F.col("cx"), F.col("cy"))) <= F.col("bound") * SLACK)


def nearest(points: DataFrame, shapes: DataFrame, id: str) -> DataFrame:
    """points (x, y) with the id of the nearest shape and its distance, 0 inside; ties go to the smallest id.

    shapes: id, their box x0, y0, x1, y1, and geom unless they are boxes. Shapes without a box don't
    count; points without coordinates, or without any shape, get nulls. Points that repeat come out
    as often. A cell that very many shapes share is compared with each point that reaches it.
    """
    s = shapes.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select(F.col(id).alias("__id"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), *(["geom"] if "geom" in shapes.columns else []))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    fact = s.agg(F.count("*").alias("n"), F.avg(side).alias("side"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    nothing = lambda df: df.withColumn(id, F.lit(None).cast(s.schema["__id"].dataType)).withColumn("distance", F.lit(None).cast("double"))
    if not fact.n:
        return nothing(points)
    rows = stored(points.withColumn("__p", F.monotonically_increasing_id()), "points")
    at = rows.filter("x is not null and y is not null").select("__p", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    end = at.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if end.x0 is None:
        return nothing(points)
    # How far shapes are apart: from the ground that they take at a coarse look, not from their frame.
    coarse = max(fact.x1 - fact.x0, fact.y1 - fact.y0) / COARSE or 1.0
    ground = s.select(*(F.floor(F.col(f"{v}0") / coarse).alias(v) for v in "xy")).distinct().count() * coarse**2
    cell = max(fact.side, math.sqrt(ground / fact.n))
    whole = max(max(fact.x1, end.x1) - min(fact.x0, end.x0), max(fact.y1, end.y1) - min(fact.y0, end.y0), cell)
    top = math.ceil(math.log2(whole / cell)) + 1  # here any two cells are neighbours

    level = F.when(side <= cell * SPAN, 0).otherwise(F.ceil(F.log2(side / (cell * SPAN)))).cast("int")
    placed = s.withColumn("g", level)
    of = _side(cell, F.col("g"))
    axis = lambda v: F.explode(F.sequence(F.floor(F.col(f"{v}0") / of), F.floor(F.col(f"{v}1") / of)))
    placed = stored(placed.withColumn("cx", axis("x")).withColumn("cy", axis("y")), "placed")
    # Cells by level: those that a shape's box touches, and of them those that hold a vertex for sure.
    point = (F.col("geom.xs")[0], F.col("geom.ys")[0]) if "geom" in s.columns else (F.col("x0"), F.col("y0"))
    boxes = placed.select("g", "cx", "cy", F.lit(False).alias("sure")).distinct()
    vertices = s.select(F.lit(0).alias("g"), *(F.floor(v / cell).alias(c) for v, c in zip(point, ("cx", "cy"), strict=True)), F.lit(True).alias("sure")).filter("cx is not null and cy is not null").distinct()
    levels = boxes.unionByName(vertices).withColumn("l", F.explode(F.sequence(F.col("g"), F.greatest(F.col("g"), F.lit(top)))))
    up = lambda c: F.expr(f"shiftright({c}, l - g)").alias(c)
    occupied = stored(levels.select("l", up("cx"), up("cy"), "sure").groupBy("l", "cx", "cy").agg(F.bool_or("sure").alias("sure")), "occupied")
    used = sorted(r.g for r in placed.select("g").distinct().collect())  # at most one for each doubling

    # Up: the first level at which a cell nearby is occupied.
    found: list[tuple[int, DataFrame]] = []
    left = at
    for k in range(top + 1):
        step = _side(cell, F.lit(k))
        near = occupied.filter((F.col("l") == k) & F.col("sure")).select(F.col("cx").alias("ox"), F.col("cy").alias("oy"))
        spread = lambda v: F.explode(F.sequence(F.col(v) - 1, F.col(v) + 1))
        near = near.withColumn("cx", spread("ox")).withColumn("cy", spread("oy")).groupBy("cx", "cy").agg(F.collect_list(F.struct("ox", "oy")).alias("cells"))  # nine at most
        own = left.withColumn("cx", F.floor(F.col("x") / step)).withColumn("cy", F.floor(F.col("y") / step))
        bound = F.array_min(F.transform("cells", lambda c: planar.box_reach("x", "y", *_box(step, c["ox"], c["oy"]))))  # noqa: B023
        both = stored(own.join(near, ["cx", "cy"], "left").select("__p", "x", "y", bound.alias("bound")), "bounds")
        found.append((k, both.filter("bound is not null")))
        left = both.filter("bound is null").select("__p", "x", "y")
        if left.isEmpty():
            break

    # Down: the cells that the bound reaches, level by level.
    looks, frontier = [], None
    for k, rows_k in reversed(found):
        coarse = [g for g in used if g > k]
        looks += [_around(rows_k, cell, F.lit(g)).withColumn("g", F.lit(g)) for g in coarse]
        here = occupied.filter(F.col("l") == k).select("cx", "cy")
        start = _around(rows_k, cell, F.lit(k)).join(here, ["cx", "cy"], "left_semi").select("__p", "x", "y", "bound", "cx", "cy")
        frontier = start if frontier is None else frontier.unionByName(start)
        if k in used:
            looks.append(frontier.withColumn("g", F.lit(k)))
        if k:
            step = _side(cell, F.lit(k - 1))
            child = lambda v, i: 2 * F.col(v) + i
            four = F.explode(F.array(*(F.struct(child("cx", i).alias("cx"), child("cy", j).alias("cy")) for i in (0, 1) for j in (0, 1))))
            below = frontier.withColumn("c", four).select("__p", "x", "y", "bound", "c.cx", "c.cy").join(occupied.filter(F.col("l") == k - 1).select("cx", "cy", "sure"), ["cx", "cy"])
            reach = planar.box_reach("x", "y", *_box(step, F.col("cx"), F.col("cy")))
            # Cells of larger shapes have no children; without one that holds a vertex the bound stands.
            least = below.groupBy("__p").agg(F.min(F.when(F.col("sure"), reach)).alias("m"))
            below = below.join(least, "__p").withColumn("bound", F.least("bound", "m")).filter(planar.box_distance("x", "y", *_box(step, F.col("cx"), F.col("cy"))) <= F.col("bound") * SLACK)
            frontier = stored(below.select("__p", "x", "y", "bound", "cx", "cy"), "frontier")

    look = looks[0].select("__p", "x", "y", "bound", "g", "cx", "cy")
    for more in looks[1:]:
        look = look.unionByName(more.select(*look.columns))
    pairs = look.join(placed, ["g", "cx", "cy"])
    box = planar.box_distance("x", "y", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    # Dear, so that it is marked as not deterministic: it is never computed twice.
    exact = point_distance.asNondeterministic()("geom", "x", "y") if "geom" in s.columns else box
    best = pairs.filter(box <= F.col("bound") * SLACK).select("__p", F.struct(exact.alias("distance"), F.col("__id").alias("id")).alias("b")).filter("b.distance is not null")
    best = best.groupBy("__p").agg(F.min("b").alias("b"))
    return rows.join(best, "__p", "left").select(*points.columns, F.col("b.id").alias(id), F.col("b.distance").alias("distance"))

"""Zones of equal size around centres, with names: k-means, prices per centre, exact counts.

Each centre has a price that is added to the squared distance from it; a point goes where the sum
is least. Raising the prices of full centres and lowering those of empty ones evens the counts.
The prices are found on a grid of cell counts, whose size depends on the area and not on the number
of points; a last repair moves single points, cheapest first, until all counts are what they shall be.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmesh.operators.matching import stored

#: Quantiles at which a full zone's cheapest moves are cut off before they are ranked.
CUTS = [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0]


def centres(points: DataFrame, k: int = 98, seed: int = 1) -> list[tuple[float, float]]:
    """k-means centres of points (x, y) from north to south, then west to east; fewer if points coincide."""
    v = VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(points.filter("x is not null and y is not null"))
    found = KMeans(k=k, seed=seed, featuresCol="v").fit(v).clusterCenters()
    return sorted(((float(x), float(y)) for x, y in found), key=lambda c: (-c[1], c[0]))


def _choices(points: DataFrame, at: list[tuple[float, float]], price: list[float], zones: list[int], name: str) -> DataFrame:
    """points with an array column of some zones, numbered from 1, their middles and prices: one row, broadcast."""
    rows = [(z, *map(float, at[z - 1]), float(price[z - 1])) for z in zones]
    one = points.sparkSession.createDataFrame([(rows,)], f"`{name}` array<struct<zone:int,x:double,y:double,price:double>>")
    return points.crossJoin(F.broadcast(one))


def _best(name: str) -> Column:
    """struct(cost, zone) of the cheapest zone of that array."""
    cost = lambda z: (F.col("x") - z["x"]) * (F.col("x") - z["x"]) + (F.col("y") - z["y"]) * (F.col("y") - z["y"]) + z["price"]
    return F.array_min(F.transform(name, lambda z: F.struct(cost(z).alias("cost"), z["zone"].alias("zone"))))


def prices(points: DataFrame, at: list[tuple[float, float]], cells: int = 256, rounds: int = 200, enough: float = 0.01) -> list[float]:
    """Prices under which the zones' counts come near to each other.

    The rounds run in the driver over counts of at most cells × cells squares, however many points
    there are. The step of a price grows while its zone stays too full or too empty, and is halved
    when that turns.
    """
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("x").alias("n")).first()
    if not box.n:
        return [0.0] * len(at)
    side = max(box.x1 - box.x0, box.y1 - box.y0, 1e-9) / cells
    square = lambda v, low: F.least(F.floor((F.col(v) - low) / side), F.lit(cells - 1))
    grid = points.filter("x is not null and y is not null").groupBy(square("x", box.x0).alias("i"), square("y", box.y0).alias("j"))
    few = grid.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).select("n", "x", "y").toPandas()
    n, k, middle = few["n"].to_numpy(float), len(at), np.array(at)
    far = (few["x"].to_numpy()[:, None] - middle[None, :, 0]) ** 2 + (few["y"].to_numpy()[:, None] - middle[None, :, 1]) ** 2
    price, step, sign = np.zeros(k), np.full(k, (side * cells) ** 2 / k / 16), np.zeros(k)
    best, least = price.copy(), np.inf
    for _ in range(rounds):
        off = np.bincount((far + price).argmin(axis=1), weights=n, minlength=k) * k / box.n - 1
        if np.abs(off).sum() < least:
            best, least = price.copy(), np.abs(off).sum()
        if np.abs(off).max() <= enough:
            break
        now = np.sign(off) * (np.abs(off) > enough / 2)
        step *= np.where(now == sign, 1.3, np.where((now != 0) & (sign != 0), 0.5, 1.0))
        price = price + now * step * np.minimum(1.0, np.abs(off) + 0.1)
        sign = np.where(now != 0, now, sign)
    return best.tolist()


def balanced(points: DataFrame, at: list[tuple[float, float]], price: list[float] | None = None) -> DataFrame:
    """points (x, y) with zone 1…k, whose counts differ by one at most; the first zones have the larger ones.

    Points without coordinates get no zone. Repeated points count each. The repair's rounds end, as
    each fills at least one zone or empties at least one; what is ranked is cut off first, so that
    no window holds a whole zone where the prices left few to move.
    """
    k = len(at)
    price = prices(points, at) if price is None else price
    rows = stored(points.withColumn("__p", F.monotonically_increasing_id()), "points")
    fine = rows.filter("x is not null and y is not null")
    all_ = _choices(fine.select("__p", "x", "y"), at, price, list(range(1, k + 1)), "__zones")
    placed = stored(all_.select("__p", "x", "y", _best("__zones").alias("b")).select("__p", "x", "y", "b.cost", "b.zone"), "placed")
    n = placed.count()
    size = {z: n // k + (z <= n % k) for z in range(1, k + 1)}
    while True:
        count = {r.zone: r.n for r in placed.groupBy("zone").agg(F.count("*").alias("n")).collect()}
        over = {z: count.get(z, 0) - size[z] for z in size if count.get(z, 0) > size[z]}
        room = {z: size[z] - count.get(z, 0) for z in size if count.get(z, 0) < size[z]}
        if not over:
            return rows.join(placed.select("__p", "zone"), "__p", "left").select(*points.columns, "zone")
        full = _choices(placed.filter(F.col("zone").isin(list(over))), at, price, list(room), "__room").withColumn("to", _best("__room")).drop("__room")
        full = stored(full.withColumn("loss", F.col("to.cost") - F.col("cost")), "full")
        cuts = {r.zone: r.q for r in full.groupBy("zone").agg(F.percentile_approx("loss", CUTS).alias("q")).collect()}
        pick = lambda z: cuts[z][next(i for i, c in enumerate(CUTS) if c == 1.0 or c * count[z] > 2 * over[z])]  # noqa: B023, E731
        chosen = full.filter(F.col("loss") <= _of({z: float(pick(z)) for z in over}, "zone"))
        order = [F.asc("loss"), F.asc("__p")]
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("zone").orderBy(*order))).filter(F.col("r") <= _of(over, "zone"))
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("to.zone").orderBy(*order))).filter(F.col("r") <= _of(room, "to.zone"))
        moved = stored(chosen.select("__p", F.col("to.cost").alias("new_cost"), F.col("to.zone").alias("new_zone")), "moved")
        placed = stored(placed.join(moved, "__p", "left").select("__p", "x", "y", F.coalesce("new_cost", "cost").alias("cost"), F.coalesce("new_zone", "zone").alias("zone")), "placed")


def _of(values: dict[int, float], zone: str) -> Column:
    """A number for each zone, at most one for each centre."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col(zone))


def named(zones: DataFrame, places: DataFrame) -> DataFrame:
    """zones (zone, x, y of the middle) with a name: that of the best-ranked place inside, else of the nearest.

    places: name, rank (1 is best), x, y, and zone, the one that it lies in or null. Of equal rank
    the one nearest to the middle is taken, then the first by name. Names that come again, in the
    order of zones, get a running number. Without any place a zone is called "Ward".
    """
    inside = places.filter("name is not null and zone is not null").select(F.col("zone").alias("__z"), "name", "rank", F.col("x").alias("px"), F.col("y").alias("py"))
    away = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    own = zones.join(inside, F.col("zone") == F.col("__z")).groupBy("zone").agg(F.min(F.struct("rank", away.alias("d"), "name"))["name"].alias("name"))
    rows = zones.join(own, "zone", "left")
    # The rest: one pass over all places for each zone without any, all at once.
    bare = rows.filter("name is null").select("zone", "x", "y").collect()  # at most one for each zone
    if bare:
        far = lambda r: F.min(F.struct(F.hypot(F.col("x") - r.x, F.col("y") - r.y).alias("d"), "name"))["name"]
        found = places.filter("name is not null").agg(*(far(r).alias(f"n{i}") for i, r in enumerate(bare))).first()
        spark = zones.sparkSession
        near = spark.createDataFrame([(r.zone, found[f"n{i}"] or "Ward") for i, r in enumerate(bare)], f"zone {zones.schema['zone'].dataType.simpleString()}, __near string")
        rows = rows.join(near, "zone", "left").withColumn("name", F.coalesce("name", "__near"))
    again = F.row_number().over(Window.partitionBy("name").orderBy("zone"))
    return rows.withColumn("__n", again).select(*zones.columns, F.when(F.col("__n") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", "__n")).alias("name"))

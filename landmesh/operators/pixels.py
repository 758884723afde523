"""Rasters as pixel tables (raster_id, row, col, values): masks, windows, components, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmesh.operators.matching import components, one_to_one


def height_mask(pixels: DataFrame, least: float = 2.5) -> DataFrame:
    """pixels with `height` above ground and `mask`; heights that are not finite count as 0."""
    h = F.col("dsm") - F.col("dtm")
    h = F.when(h.isNull() | F.isnan(h) | (F.abs(h) == float("inf")), 0.0).otherwise(h)
    return pixels.withColumn("height", h).withColumn("mask", F.col("height") > least)


def _filled(pixels: DataFrame) -> DataFrame:
    """pixels with all places between the ends of each row and column, where any is missing."""
    lines = [pixels.groupBy("raster_id", line).agg((F.max(along) - F.min(along) + 1 - F.count("*")).alias("gap")).filter("gap <> 0") for line, along in (("row", "col"), ("col", "row"))]
    if all(x.isEmpty() for x in lines):
        return pixels.withColumn("__there", F.lit(True))
    frame = pixels.groupBy("raster_id").agg(*(f(c).alias(f"{n}{c[0]}") for c in ("row", "col") for n, f in (("a", F.min), ("b", F.max))))
    places = frame.select("raster_id", F.explode(F.sequence("ar", "br")).alias("row"), "ac", "bc").select("raster_id", "row", F.explode(F.sequence("ac", "bc")).alias("col"))
    return places.join(pixels.withColumn("__there", F.lit(True)), ["raster_id", "row", "col"], "left")


def _pass(pixels: DataFrame, value: str, size: int, pick) -> DataFrame:
    """Smallest or largest value in a square of odd size, one axis after the other.

    A line is cut into blocks of the size; the extreme of a window is that of one block's rest and
    the next one's beginning, so that a pixel's cost doesn't depend on the size. pixels: without
    gaps (`_filled`); null values don't count.
    """
    half = size // 2
    for line, along in (("row", "col"), ("col", "row")):
        whole = Window.partitionBy("raster_id", line)
        block = Window.partitionBy("raster_id", line, "__block")
        rows = pixels.withColumn("__at", F.col(along) - F.min(along).over(whole)).withColumn("__block", F.floor(F.col("__at") / size))
        rows = rows.withColumn("__from", pick(value).over(block.orderBy(along))).withColumn("__to", pick(value).over(block.orderBy(F.desc(along))))
        order = whole.orderBy(along)
        n = F.max("__at").over(whole)
        last = F.last("__from").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ahead = F.when(F.col("__at") + half <= n, F.lead("__from", half).over(order)).otherwise(last)
        behind = F.when(F.col("__at") >= half, F.lag("__to", half).over(order))
        extreme = F.least if pick is F.min else F.greatest
        # Beyond the line's end the rest of the block is all there is, if the line ends in that block.
        ends_here = (F.col("__at") + half > n) & (F.floor(n / size) == F.floor((F.col("__at") - half) / size))
        rows = rows.withColumn("__v", F.when(F.col("__at") < half, ahead).when(ends_here, behind).otherwise(extreme(behind, ahead)))
        pixels = rows.withColumn(value, F.col("__v")).drop("__at", "__block", "__from", "__to", "__v")
    return pixels.withColumn(value, F.when(F.col("__there"), F.col(value)))


def opened(pixels: DataFrame, value: str, size: int) -> DataFrame:
    """Grey opening by a square: the ground under everything narrower than it."""
    return _pass(_pass(_filled(pixels), value, size, F.min), value, size, F.max).filter("__there").drop("__there")


def cleaned(pixels: DataFrame, size: int = 3) -> DataFrame:
    """A mask opened, then closed, by a square."""
    m = pixels.withColumn("__m", F.col("mask").cast("int"))
    m = _filled(m)
    for pick in (F.min, F.max, F.max, F.min):
        m = _pass(m, "__m", size, pick)
    return m.filter("__there").drop("__there").withColumn("mask", F.col("__m") == 1).drop("__m")


def regions(pixels: DataFrame, pixel_area: float = 1.0, least_area: float = 20.0, least_height: float = 2.5) -> DataFrame:
    """8-connected regions of the mask: area, mean and greatest height, confidence.

    Runs of a row are single nodes; a run touches those of the row before whose columns overlap it
    by up to one on each side. They meet on a grid of column blocks, as boxes do.
    """
    on = pixels.filter("mask")
    in_row = Window.partitionBy("raster_id", "row").orderBy("col")
    runs = on.withColumn("run", F.col("col") - F.row_number().over(in_row)).groupBy("raster_id", "row", "run").agg(
        F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"), F.sum("height").alias("s"), F.max("height").alias("top")
    )
    node = F.concat_ws(":", F.col("raster_id").cast("string"), F.format_string("%07d", F.col("row").cast("int")), F.format_string("%07d", F.col("c0").cast("int")))
    runs = runs.withColumn("node", node)
    block = lambda c0, c1: F.explode(F.sequence(F.floor(c0 / 64), F.floor(c1 / 64)))
    a = runs.select("raster_id", (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("node").alias("a_id"), block(F.col("c0") - 1, F.col("c1") + 1).alias("b"))
    b = runs.select("raster_id", "row", F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("node").alias("b_id"), block(F.col("c0"), F.col("c1")).alias("b"))
    touching = a.join(b, ["raster_id", "row", "b"]).filter("a0 <= b1 + 1 and b0 <= a1 + 1").select("a_id", "b_id").distinct()
    nodes = components(touching)
    out = runs.join(nodes, "node", "left").groupBy("raster_id", F.coalesce("cluster", "node").alias("region")).agg(
        F.sum("n").alias("n_pixels"), (F.sum("n") * pixel_area).alias("area"), (F.sum("s") / F.sum("n")).alias("mean_height"), F.max("top").alias("max_height")
    ).filter(F.col("area") >= least_area)
    conf = F.least(F.lit(0.98), 0.55 + 0.45 * (1 - F.exp(-(F.col("mean_height") - least_height) / 3)))
    return out.withColumn("confidence", conf)


def segmentation_scores(pixels: DataFrame) -> DataFrame:
    """Pixel IoU, precision and recall of `mask` against `truth`, by raster."""
    both, either = F.count_if(F.col("mask") & F.col("truth")), F.count_if(F.col("mask") | F.col("truth"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return pixels.groupBy("raster_id").agg(share(both, either).alias("iou"), share(both, F.count_if("mask")).alias("precision"), share(both, F.count_if("truth")).alias("recall"))


def object_scores(pixels: DataFrame, least_pixels: int = 40, least_iou: float = 0.5) -> DataFrame:
    """Objects found, wrong and missed by raster, and their F1.

    pixels: raster_id, pred and truth, the object's number or null. Objects of fewer pixels don't
    count; best-first by IoU, a found object takes at most one true one.
    """
    size = lambda c: pixels.filter(F.col(c).isNotNull()).groupBy("raster_id", c).agg(F.count("*").alias(f"n_{c}")).filter(F.col(f"n_{c}") >= least_pixels)
    pred, truth = size("pred"), size("truth")
    both = pixels.filter("pred is not null and truth is not null").groupBy("raster_id", "pred", "truth").agg(F.count("*").alias("n"))
    pairs = both.join(pred, ["raster_id", "pred"]).join(truth, ["raster_id", "truth"]).withColumn("iou", F.col("n") / (F.col("n_pred") + F.col("n_truth") - F.col("n"))).filter(F.col("iou") >= least_iou)
    name = lambda c: F.concat_ws(":", "raster_id", F.lit(c), c)
    edges = pairs.select(name("pred").alias("a_id"), name("truth").alias("b_id"), F.concat_ws(":", F.lit("pred"), "raster_id").alias("a_source"), F.concat_ws(":", F.lit("truth"), "raster_id").alias("b_source"), F.col("iou").alias("match_score"), F.lit(False).alias("locked"))
    hits = one_to_one(edges).select(F.split_part("a_id", F.lit(":"), F.lit(1)).alias("key")).groupBy("key").agg(F.count("*").alias("tp"))
    count = lambda df, c: df.groupBy("raster_id").agg(F.count("*").alias(c))
    out = count(pred, "n_pred").join(count(truth, "n_truth"), "raster_id", "full").withColumn("key", F.col("raster_id").cast("string")).join(hits, "key", "left").na.fill(0, ["n_pred", "n_truth", "tp"])
    return out.select("raster_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), (2.0 * F.col("tp") / F.greatest(F.col("n_pred") + F.col("n_truth"), F.lit(1))).alias("f1"))

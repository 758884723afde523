"""Topology of a parcel fabric: repeated vertices, overlaps, gaps and slivers with proposed fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmesh.functions import planar, shapes
from landmesh.functions.geometry import measures
from landmesh.functions.scoring import gap_kind
from landmesh.operators.matching import components, stored
from landmesh.operators.spatial import WIDE_CELL, area, box_pairs, self_overlaps

TOLERANCE, GAP_MAX, SLIVER_MAX, OVERLAP_MIN = 0.05, 1.0, 0.5, 0.25


def without_repeats(xs: str, ys: str, tolerance: float = TOLERANCE) -> Column:
    """A ring's vertices (array of x, y structs) without those nearer than the tolerance to the one kept before."""
    points = F.arrays_zip(F.col(xs).alias("x"), F.col(ys).alias("y"))
    return F.aggregate(
        points,
        F.array().cast("array<struct<x:double,y:double>>"),
        lambda kept, p: F.when(
            (F.size(kept) > 0) & (F.hypot(F.element_at(kept, -1)["x"] - p["x"], F.element_at(kept, -1)["y"] - p["y"]) <= tolerance), kept
        ).otherwise(F.concat(kept, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"))))),
    )


def n_repeats(xs: str, ys: str, tolerance: float = TOLERANCE) -> Column:
    """How many vertices `without_repeats` takes off, in time linear in the vertices."""
    points = F.arrays_zip(F.col(xs).alias("x"), F.col(ys).alias("y"))
    none = F.lit(None).cast("double")
    begin = F.struct(none.alias("x"), none.alias("y"), F.lit(0).alias("n"))

    def step(last: Column, p: Column) -> Column:
        near = F.coalesce(F.hypot(last["x"] - p["x"], last["y"] - p["y"]) <= tolerance, F.lit(False))
        pick = lambda c: F.when(near, last[c]).otherwise(p[c]).alias(c)
        return F.struct(pick("x"), pick("y"), (last["n"] + near.cast("int")).alias("n"))

    return F.aggregate(points, begin, step, lambda last: last["n"])


def duplicate_vertices(features: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rings (feature_id, ward, xs, ys) that lose vertices, and how many."""
    kept = features.withColumn("removed", n_repeats("xs", "ys", tolerance))
    return kept.filter("removed > 0").select("ward", F.lit("duplicate_vertex").alias("issue_type"), F.array("feature_id").alias("feature_ids"), F.col("removed").cast("double").alias("measure"))


def gaps(parcels: DataFrame, widest: float = GAP_MAX, sliver: float = SLIVER_MAX, tolerance: float = TOLERANCE) -> DataFrame:
    """Strips between neighbours that face each other less than `widest` apart, with nothing between.

    Parcels are boxes; each parcel is grown by `widest` to the right and upwards and meets what
    stands there, so that a strip is found from one side only. The strip goes to the neighbour of
    the longer common edge, ties to the smaller id.
    """
    cols = ["ward", "feature_id", "x0", "y0", "x1", "y1"]
    p = parcels.select(*cols)
    out = None
    for axis, other in (("x", "y"), ("y", "x")):
        grown = p.withColumn(f"{axis}1", F.col(f"{axis}1") + widest)
        pairs = box_pairs(grown, p, ["ward"]).filter("a_feature_id <> b_feature_id")
        width = F.col(f"b_{axis}0") - (F.col(f"a_{axis}1") - widest)
        long = F.least(f"a_{other}1", f"b_{other}1") - F.greatest(f"a_{other}0", f"b_{other}0")
        strips = pairs.withColumn("width", width).withColumn("long", long).filter((F.col("width") > tolerance) & (F.col("width") <= widest) & (F.col("long") > F.col("width")))
        strips = strips.select("ward", F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"), "width", "long")
        out = strips if out is None else out.unionByName(strips)
    area = F.col("width") * F.col("long")
    return out.withColumn("area", area).filter("area > 0.05").select(
        "ward", gap_kind(F.col("area"), 2 * (F.col("width") + F.col("long")), sliver).alias("issue_type"), F.array(F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).alias("feature_ids"), F.col("area").alias("measure"),
        F.struct(F.lit("merge_into").alias("action"), F.least("a_id", "b_id").alias("target")).alias("fix"),
    )


def _strips(parcels: DataFrame, widest: float, tolerance: float) -> DataFrame:
    """Strips between two polygons that no parcel covers: ward, a_id, b_id, geom, its measures m, and
    how much border it has in common with each of the two."""
    p = parcels.select("ward", "feature_id", "x0", "y0", "x1", "y1", "geom")
    grown = p.withColumns({"x0": F.col("x0") - widest, "y0": F.col("y0") - widest, "x1": F.col("x1") + widest, "y1": F.col("y1") + widest})
    pairs = box_pairs(grown, p, ["ward"], WIDE_CELL).filter("a_feature_id < b_feature_id")
    found = pairs.select("ward", F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"), shapes.strip_between(widest, tolerance)("a_geom", "b_geom").alias("geom")).filter("geom.xs is not null")
    found = stored(found, "found")  # few, and looked at twice
    keys = ["ward", "a_id", "b_id"]
    boxes = found.select(*keys, "geom", *(F.col(f"geom.{v}{m}").alias(f"{v}{i}") for v in ("x", "y") for m, i in (("min", 0), ("max", 1))))
    # Strips are narrow, so that few parcels reach into one; its own two are among those met.
    over = box_pairs(boxes, p, ["ward"], WIDE_CELL).groupBy("ward", F.col("a_a_id").alias("a_id"), F.col("a_b_id").alias("b_id")).agg(
        F.first("a_geom").alias("geom"), F.collect_list("b_geom").alias("covered"),
        *(F.first(F.when(F.col("b_feature_id") == F.col(f"a_{s}_id"), F.col("b_geom")), ignorenulls=True).alias(f"{s}_geom") for s in ("a", "b")),
    )
    left = shapes.spread(over).withColumn("geom", shapes.without("geom", "covered")).filter("geom.xs is not null").withColumn("m", measures("geom")).filter("m.area > 0.05")
    for s in ("a", "b"):  # the common border is what both perimeters lose in the union
        left = left.withColumn(f"{s}_border", measures(f"{s}_geom")["perimeter"] + F.col("m.perimeter") - measures(shapes.union(f"{s}_geom", "geom"))["perimeter"])
    return left.select("ward", "a_id", "b_id", "geom", "m", "a_border", "b_border")


def _gap_finding(kind: Column, ids: Column, area: Column, target: Column) -> list[Column | str]:
    return ["ward", kind.alias("issue_type"), ids.alias("feature_ids"), area.alias("measure"), F.struct(F.lit("merge_into").alias("action"), target.alias("target")).alias("fix"), "geom"]


def polygon_gaps(parcels: DataFrame, widest: float = GAP_MAX, sliver: float = SLIVER_MAX, tolerance: float = TOLERANCE) -> DataFrame:
    """As `gaps`, for polygons (geom): ground between two neighbours that no parcel covers, with its shape.

    A strip along several neighbours is one finding for each two that face each other (`whole_gaps`
    joins them). It goes to the neighbour of the longer common border, ties to the smaller id.
    """
    left = _strips(parcels, widest, tolerance)
    target = F.when(F.col("b_border") > F.col("a_border") + 1e-4, F.col("b_id")).otherwise(F.col("a_id"))
    return left.select(*_gap_finding(gap_kind(F.col("m.area"), F.col("m.perimeter"), sliver), F.array("a_id", "b_id"), F.col("m.area"), target))


def whole_gaps(parcels: DataFrame, widest: float = GAP_MAX, sliver: float = SLIVER_MAX, tolerance: float = TOLERANCE) -> DataFrame:
    """As `polygon_gaps`, with strips that touch each other as one finding over all their neighbours.

    It goes to the neighbour of the longest common border in all, ties to the smallest id.
    """
    strips = stored(_strips(parcels, widest, tolerance).withColumn("n", F.monotonically_increasing_id()), "strips")
    boxes = strips.select("ward", "n", planar.edges("geom").alias("e"), *(F.col(f"geom.{v}{m}").alias(f"{v}{i}") for v in ("x", "y") for m, i in (("min", 0), ("max", 1))))
    wide = boxes.withColumns({"x0": F.col("x0") - tolerance, "y0": F.col("y0") - tolerance, "x1": F.col("x1") + tolerance, "y1": F.col("y1") + tolerance})
    # Ends that were computed apart may miss each other by rounding, or by a hair of ground at a corner.
    near = F.exists("a_e", lambda e: planar.edge_distance("b_e", e["ax"], e["ay"]) <= tolerance) | F.exists("b_e", lambda e: planar.edge_distance("a_e", e["ax"], e["ay"]) <= tolerance)
    touching = box_pairs(wide, boxes, ["ward"]).filter("a_n < b_n").filter(near).select(F.col("a_n").alias("a_id"), F.col("b_n").alias("b_id"))
    of = components(touching).select(F.col("node").alias("n"), F.col("cluster"))
    rows = stored(strips.join(of, "n", "left").withColumn("cluster", F.coalesce("cluster", "n")), "strips")
    sides = rows.select("cluster", F.explode(F.array(*(F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_border").alias("border")) for s in ("a", "b")))).alias("s"))
    each = sides.groupBy("cluster", F.col("s.id").alias("id")).agg(F.bround(F.sum("s.border"), 4).alias("border"))
    home = each.groupBy("cluster").agg(F.min(F.struct((-F.col("border")).alias("b"), "id"))["id"].alias("target"), F.array_sort(F.collect_list("id")).alias("ids"))
    joined = shapes.dissolved(rows, ["ward", "cluster"], rounds=0).join(home, "cluster").withColumn("m", measures("geom"))
    return joined.select(*_gap_finding(gap_kind(F.col("m.area"), F.col("m.perimeter"), sliver), F.col("ids"), F.col("m.area"), F.col("target")))


def fixed(parcels: DataFrame, issues: DataFrame) -> DataFrame:
    """Accepted fixes applied to polygons (geom): clip_from takes the other parcel's ground off the
    target, then merge_into adds a gap's shape to it. What a target loses whole keeps a null geom."""
    accepted = issues.filter("status = 'accepted'").select(F.col("fix.action").alias("action"), F.col("fix.target").alias("feature_id"), "feature_ids", "geom")
    others = accepted.filter("action = 'clip_from'").select("feature_id", F.explode("feature_ids").alias("other")).filter("feature_id <> other").distinct()
    cut = others.join(parcels.select(F.col("feature_id").alias("other"), F.col("geom").alias("g")), "other").groupBy("feature_id").agg(F.collect_list("g").alias("__cut"))
    added = accepted.filter("action = 'merge_into' and geom.xs is not null").groupBy("feature_id").agg(F.collect_list("geom").alias("__add"))
    none = F.array().cast(f"array<{parcels.schema['geom'].dataType.simpleString()}>")
    rows = parcels.join(cut, "feature_id", "left").join(added, "feature_id", "left")
    touched = F.col("__cut").isNotNull() | F.col("__add").isNotNull()
    # Untouched rows go through as null, so that their shapes are not computed.
    clipped = shapes.without(F.when(touched, F.col("geom")), F.coalesce("__cut", none))
    rows = rows.withColumn("__new", shapes.with_all(clipped, F.coalesce("__add", none)))
    return rows.withColumn("geom", F.when(touched, F.col("__new")).otherwise(F.col("geom"))).drop("__cut", "__add", "__new")


def findings(parcels: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """All issues of a fabric of boxes, or of polygons (geom): overlaps (clipped from the smaller parcel), gaps, slivers,
    repeated vertices of `rings`, and features that came in invalid (was_invalid: fixed already)."""
    over = self_overlaps(parcels, OVERLAP_MIN, by=("ward",))
    size = parcels.select("feature_id", area(parcels).alias("s"))
    over = over.join(size.select(F.col("feature_id").alias("a_id"), F.col("s").alias("sa")), "a_id").join(size.select(F.col("feature_id").alias("b_id"), F.col("s").alias("sb")), "b_id")
    over = over.select("ward", F.lit("overlap").alias("issue_type"), F.array("a_id", "b_id").alias("feature_ids"), F.col("overlap").alias("measure"), F.struct(F.lit("clip_from").alias("action"), F.when(F.col("sa") <= F.col("sb") * (1 + 1e-9), F.col("a_id")).otherwise(F.col("b_id")).alias("target")).alias("fix"))
    out = over.unionByName(polygon_gaps(parcels) if "geom" in parcels.columns else gaps(parcels), allowMissingColumns=True)
    if rings is not None:
        out = out.unionByName(duplicate_vertices(rings), allowMissingColumns=True)
    if "was_invalid" in parcels.columns:
        out = out.unionByName(parcels.filter("was_invalid").select("ward", F.lit("self_intersection").alias("issue_type"), F.array("feature_id").alias("feature_ids")), allowMissingColumns=True)
    return out.withColumn("status", F.when(F.col("issue_type") == "self_intersection", "auto_fixed").otherwise("open"))


def clip(parcels: DataFrame, issues: DataFrame) -> DataFrame:
    """Accepted overlap fixes applied to boxes: the target gives up the strip along its shared side.

    Several fixes of one parcel each move one of its sides; the innermost wins.
    """
    fixes = issues.filter("issue_type = 'overlap' and status = 'accepted'").select(F.col("fix.target").alias("feature_id"), F.explode("feature_ids").alias("other")).filter("feature_id <> other")
    o = parcels.select(F.col("feature_id").alias("other"), *(F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")))
    rows = fixes.join(o, "other").join(parcels.select("feature_id", "x0", "y0", "x1", "y1"), "feature_id")
    dx, dy = (F.least(f"{v}1", f"o{v}1") - F.greatest(f"{v}0", f"o{v}0") for v in ("x", "y"))
    by_x = dx <= dy
    move = lambda side, use, low: F.when(use & low, F.col(side)).otherwise(None)
    cut = rows.groupBy("feature_id").agg(
        F.max(move("ox1", by_x, F.col("ox0") < F.col("x0"))).alias("nx0"), F.min(move("ox0", by_x, F.col("ox0") >= F.col("x0"))).alias("nx1"),
        F.max(move("oy1", ~by_x, F.col("oy0") < F.col("y0"))).alias("ny0"), F.min(move("oy0", ~by_x, F.col("oy0") >= F.col("y0"))).alias("ny1"),
    )
    joined = parcels.join(cut, "feature_id", "left")
    return joined.withColumns({c: F.coalesce(f"n{c}", c) for c in ("x0", "y0", "x1", "y1")}).drop("nx0", "ny0", "nx1", "ny1")


def recall(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of planted defects (feature_id, defect) found; a gap may be found as a sliver and back."""
    kind = lambda c: F.when(F.col(c).isin("gap", "sliver"), "gap").otherwise(F.col(c))
    found = issues.select(F.explode("feature_ids").alias("feature_id"), kind("issue_type").alias("kind")).distinct().withColumn("hit", F.lit(1))
    rows = truth.withColumn("kind", kind("defect")).join(found, ["feature_id", "kind"], "left")
    return rows.rollup("defect").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def decided(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """issues with the last decision on each (issue_id, action, at): accept, ignore or reopen.

    Fixed issues stay as they are; only open ones can be accepted or ignored, only ignored ones
    reopened.
    """
    last = Window.partitionBy("issue_id").orderBy(F.desc("at"), "action")
    d = decisions.withColumn("n", F.row_number().over(last)).filter("n = 1").select("issue_id", "action")
    rows = issues.join(d, "issue_id", "left")
    status = (
        F.when((F.col("status") == "open") & (F.col("action") == "accept"), "accepted")
        .when((F.col("status") == "open") & (F.col("action") == "ignore"), "ignored")
        .when((F.col("status") == "ignored") & (F.col("action") == "reopen"), "open")
        .otherwise(F.col("status"))
    )
    return rows.withColumn("status", status).drop("action")


#: Fixes that can be applied without a look at the place (fixed values).
FIXABLE = ["clip_from", "merge_into", "remove_repeated_points"]


def accept_all(issues: DataFrame, sources: DataFrame, at) -> DataFrame:
    """Decisions (issue_id, action, at) that accept every open issue of some sources (source_id) with a fix.

    They are meant for `decided`; issues without a proposed fix, and those that were decided on
    before, get none.
    """
    open_ = issues.filter(F.col("status") == "open").filter(F.col("fix.action").isin(FIXABLE))
    return open_.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("issue_id", F.lit("accept").alias("action"), F.lit(at).alias("at"))


def _share(key: str, salt: str):
    """A number in [0, 1) for each key and salt, from 24 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(salt), F.col(key)).cast("binary")), 1, 6), 16, 10).cast("double") / (1 << 24)


#: Share of the parcels that get a defect, and how far their sides move outwards.
DEFECTS = {"overlap": (0.01, 1.2), "sliver": (0.01, -0.35), "gap": (0.005, -0.7)}


def with_defects(parcels: DataFrame, salt: str = "defects") -> tuple[DataFrame, DataFrame]:
    """A clean fabric of boxes with planted DEFECTS, and the truth (feature_id, defect).

    Which parcels get one follows from their ids alone, so that it comes out alike everywhere.
    """
    share, kind, move = _share("feature_id", salt), F.lit(None).cast("string"), F.lit(0.0)
    top = sum(s for s, _ in DEFECTS.values())
    for name, (part, by) in reversed(DEFECTS.items()):
        kind, move = F.when(share < top, name).otherwise(kind), F.when(share < top, by).otherwise(move)
        top -= part
    rows = parcels.withColumns({"__defect": kind, "__by": move})
    moved = {"x0": F.col("x0") - F.col("__by"), "y0": F.col("y0") - F.col("__by"), "x1": F.col("x1") + F.col("__by"), "y1": F.col("y1") + F.col("__by")}
    truth = rows.filter("__defect is not null").select("feature_id", F.col("__defect").alias("defect"))
    return rows.withColumns(moved).drop("__defect", "__by"), truth


#: Share of the footprints with a change between two epochs.
EPOCH = {"demolished": 0.02, "extension": 0.03, "vertical_extension": 0.02}


def next_epoch(footprints: DataFrame, salt: str = "epoch", grow: float = 0.4, rise: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Footprints (feature_id, box, height) a survey later, and the truth (feature_id, change_type)."""
    share, top = _share("feature_id", salt), sum(EPOCH.values())
    kind = F.lit(None).cast("string")
    for name, part in reversed(EPOCH.items()):
        kind = F.when(share < top, name).otherwise(kind)
        top -= part
    rows = footprints.withColumn("__kind", kind)
    is_ = lambda k: F.coalesce(F.col("__kind") == k, F.lit(False))
    now = rows.filter(~is_("demolished")).withColumns({
        "x1": F.when(is_("extension"), F.col("x1") + grow * (F.col("x1") - F.col("x0"))).otherwise(F.col("x1")),
        "height": F.when(is_("vertical_extension"), F.col("height") + rise).otherwise(F.col("height")),
    })
    return now.drop("__kind"), rows.filter("__kind is not null").select("feature_id", F.col("__kind").alias("change_type"))

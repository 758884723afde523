"""Changes between two epochs of footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmesh.operators.spatial import area, box_pairs, with_overlap


def detect_changes(baseline: DataFrame, current: DataFrame, by: tuple[str, ...] = ("ward",), min_overlap: float = 0.2, area_pct: float = 15.0, height_m: float = 2.5, min_area: float = 10.0) -> DataFrame:
    """New, raised, grown, shrunk and demolished structures.

    Both sides: feature_id, by, box or geom, height; current has confidence (0 and null count as
    0.85). Each current footprint takes the baseline of the largest share of the smaller area; the
    vertical test comes before the area test. A baseline is demolished if no current footprint took
    it and none covers min_overlap of its own area.
    """
    now = current.withColumn("area", area(current)).filter(F.col("area") >= min_area)
    old = baseline.withColumn("area", area(baseline))
    seen = current.withColumn("area", area(current))
    pairs = with_overlap(box_pairs(seen, old, list(by)))
    pairs = pairs.withColumn("ratio", F.coalesce(F.try_divide(F.col("overlap"), F.least("a_area", "b_area")), F.lit(0.0)))
    best = Window.partitionBy("a_feature_id").orderBy(F.desc("ratio"), "b_feature_id")
    top = pairs.filter("ratio > 0").withColumn("n", F.row_number().over(best)).filter("n = 1").select(
        F.col("a_feature_id").alias("feature_id"), F.col("b_feature_id").alias("baseline_id"), "ratio", F.col("b_area").alias("area_before"), F.col("b_height").alias("height_before")
    )
    rows = now.join(top, "feature_id", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    conf = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.85))
    new = F.col("ratio") < min_overlap
    pct = 100 * (F.col("area") - F.col("area_before")) / F.col("area_before")
    rise = F.col("height") - F.col("height_before")
    kind = (
        F.when(new, "new_structure")
        .when(F.coalesce(rise > height_m, F.lit(False)), "vertical_extension")
        .when(F.abs(pct) > area_pct, F.when(pct > 0, "extension").otherwise("reduction"))
    )
    score = F.when(new, conf * (1 - F.col("ratio"))).when(F.col("change_type") == "vertical_extension", conf * F.least(F.lit(1.0), 0.6 + rise / 15)).otherwise(conf * F.col("ratio") * F.least(F.lit(1.0), 0.6 + F.abs(pct) / 100))
    kept = lambda c: F.when(~new, F.col(c)).alias(c)
    changed = rows.withColumn("change_type", kind).filter("change_type is not null").select(
        *by, "change_type", kept("baseline_id"), F.col("feature_id").alias("current_id"), kept("area_before"), F.col("area").alias("area_after"), kept("height_before"), F.col("height").alias("height_after"), F.bround(F.least(F.lit(0.99), score), 4).alias("confidence")
    )
    used = rows.filter(~new).select(F.col("baseline_id").alias("feature_id")).distinct()
    most = pairs.groupBy(F.col("b_feature_id").alias("feature_id")).agg(F.max(F.col("overlap") / F.col("b_area")).alias("covered"))
    gone = old.filter(F.col("area") >= min_area).join(used, "feature_id", "left_anti").join(most, "feature_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0))).filter(F.col("covered") < min_overlap)
    demolished = gone.select(*by, F.lit("demolished").alias("change_type"), F.col("feature_id").alias("baseline_id"), F.col("area").alias("area_before"), F.col("height").alias("height_before"), F.bround(0.8 * (1 - F.col("covered")), 4).alias("confidence"))
    return changed.unionByName(demolished, allowMissingColumns=True)


def change_summary(changes: DataFrame, by: tuple[str, ...] = ("ward",)) -> DataFrame:
    return changes.groupBy(*by, "change_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))

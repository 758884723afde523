"""Validation: source profiles and score cards, ward scores, layer choice, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifier fields in the order in which the first one with any value is taken (fixed values).
ID_FIELDS = ["parcel_id", "khata_no", "survey_no", "bldg_id", "asset_id", "property_tax_id"]


def profile(features: DataFrame) -> DataFrame:
    """Per source: sorted property names, number of features, number of repaired ones."""
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties")))))
    return features.groupBy("source_id").agg(keys.alias("fields"), F.count("*").alias("n_features"), F.count_if(F.coalesce("was_invalid", F.lit(False))).alias("n_repaired"))


def filled(properties: str, fields: str) -> Column:
    """Fields, but those that begin with _, whose values are not empty."""
    counted = F.filter(fields, lambda k: ~k.startswith("_"))
    return F.size(F.filter(counted, lambda k: F.coalesce(F.try_element_at(F.col(properties), k), F.lit("")) != ""))


def check(key: str, value: Column, passed: Column, weight: int) -> Column:
    return F.struct(F.lit(key).alias("key"), F.bround(value.cast("double"), 4).alias("value"), passed.alias("passed"), F.lit(weight).alias("weight"))


def weighted_score(checks: Column) -> Column:
    """0 to 100, one decimal; 100 without weights."""
    total = F.aggregate(checks, F.lit(0), lambda acc, c: acc + c["weight"])
    got = F.aggregate(checks, F.lit(0.0), lambda acc, c: acc + c["weight"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["value"])))
    return F.when(total == 0, 100.0).otherwise(F.bround(100 * got / total, 1))


def source_cards(features: DataFrame, sources: DataFrame, issues: DataFrame, wards: DataFrame, today: Column) -> DataFrame:
    """Seven weighted checks and a score for each source.

    sources: source_id, ward, crs, captured_at; features: source_id, properties, was_invalid, box;
    issues: source_id, status; wards: ward and west, south, east, north (null or 0 west: no check).
    """
    fields = profile(features).select("source_id", "fields")
    box = wards.select("ward", "west", "south", "east", "north")
    rows = features.select("source_id", "properties", "was_invalid", "x0", "y0", "x1", "y1").join(sources, "source_id").join(fields, "source_id").join(box, "ward", "left")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    no_box = F.col("west").isNull() | (F.col("west") == 0)
    inside = no_box | (x.between(F.col("west"), F.col("east")) & y.between(F.col("south"), F.col("north")))
    ids = [F.nullif(F.try_element_at("properties", F.lit(k)), F.lit("")) for k in ID_FIELDS]
    counts = [(F.count(c), F.count_distinct(c)) for c in ids]
    duplicates = F.coalesce(*(F.when(n > 0, n - d) for n, d in counts), F.lit(0))
    n_fields = F.size(F.filter("fields", lambda k: ~k.startswith("_")))
    per = rows.groupBy("source_id", "ward", "crs", "captured_at").agg(
        F.count("*").alias("n"),
        F.avg((~F.coalesce("was_invalid", F.lit(False))).cast("double")).alias("valid"),
        F.coalesce(F.sum(filled("properties", "fields")) / F.nullif(F.sum(n_fields), F.lit(0)), F.lit(1.0)).alias("complete"),
        duplicates.alias("duplicates"),
        F.avg(inside.cast("double")).alias("inside"),
    )
    open_ = issues.filter("status = 'open'").groupBy("source_id").agg(F.count("*").alias("open_issues"))
    per = per.join(open_, "source_id", "left").withColumn("open_issues", F.coalesce("open_issues", F.lit(0)))
    age = F.datediff(today, F.col("captured_at")) / 365.25
    fresh = F.when(age.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), age - 5) / 10))
    checks = F.array(
        check("crs", F.when(F.col("crs").isNotNull(), 1.0).otherwise(0.5), F.col("crs").isNotNull(), 1),
        check("geometry_validity", F.col("valid"), F.col("valid") >= 0.99, 2),
        check("completeness", F.col("complete"), F.col("complete") >= 0.9, 2),
        check("duplicates", 1 - F.least(F.lit(1.0), F.col("duplicates") / F.col("n")), F.col("duplicates") == 0, 1),
        check("coverage", F.col("inside"), F.col("inside") >= 0.95, 1),
        check("topology", 1 / (1 + F.col("open_issues")), F.col("open_issues") == 0, 2),
        check("freshness", fresh, age.isNull() | (age <= 5), 1),
    )
    return per.withColumn("checks", checks).withColumn("score", weighted_score(F.col("checks")))


def ward_scores(cards: DataFrame, structures: DataFrame, findings: DataFrame) -> DataFrame:
    """Summary of each ward from its sources' cards, its structures and its findings by type."""
    of = lambda k: F.count_if(F.col("finding_type") == k).alias(k)
    found = findings.groupBy("ward").agg(*map(of, ("unregistered_structure", "encroachment", "attribute_drift")))
    base = cards.groupBy("ward").agg((F.avg("score") / 100).alias("quality"), F.min("score").alias("worst")).join(structures.groupBy("ward").agg(F.count("*").alias("n_structures")), "ward", "left").join(found, "ward", "left").na.fill(0)
    rate = F.when(F.col("n_structures") > 0, 1 - F.col("unregistered_structure") / F.col("n_structures")).otherwise(1.0)
    part = lambda c: 1 / (1 + F.col(c))
    checks = F.array(
        check("source_quality", F.col("quality"), F.col("worst") >= 70, 3),
        check("registered_structures", rate, rate >= 0.95, 3),
        check("encroachments", part("encroachment"), F.col("encroachment") == 0, 2),
        check("attribute_drift", part("attribute_drift"), F.col("attribute_drift") == 0, 2),
    )
    return base.withColumn("checks", checks).select("ward", "n_structures", weighted_score(F.col("checks")).alias("score"), "checks")


def latest(reports: DataFrame, by: list[str], at: str, n: int = 1) -> DataFrame:
    """The n last rows of each group; nulls of a key are one group, ties break by all columns."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(at), *(c for c in reports.columns if c not in by and c != at and not reports.schema[c].dataType.typeName() == "map"))
    return reports.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def chosen_layer(sources: DataFrame, preferred: list[str]) -> DataFrame:
    """For each ward the last ready source of the first preferred type that it has."""
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col("source_type"))
    order = Window.partitionBy("ward").orderBy(rank, F.desc_nulls_last("captured_at"), F.desc_nulls_last("created_at"), "source_id")
    return sources.filter((F.col("status") == "ready") & F.col("source_type").isin(preferred)).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def findings(unregistered: DataFrame, encroachments: DataFrame, vacant: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """All findings in one table of ward, finding_type, feature_ids and outside_share."""
    out = (
        unregistered.select("ward", F.lit("unregistered_structure").alias("finding_type"), F.array("feature_id").alias("feature_ids"))
        .unionByName(encroachments.select("ward", F.lit("encroachment").alias("finding_type"), F.array("structure_id", "parcel_id").alias("feature_ids"), "outside_share"), allowMissingColumns=True)
        .unionByName(vacant.select("ward", F.lit("vacant_parcel").alias("finding_type"), F.array("feature_id").alias("feature_ids")), allowMissingColumns=True)
    )
    if drift is not None:
        more = drift.filter("status = 'open' and size(fields) > 0").select("ward", F.lit("attribute_drift").alias("finding_type"), F.array("a_id", "b_id").alias("feature_ids"))
        out = out.unionByName(more, allowMissingColumns=True)
    return out

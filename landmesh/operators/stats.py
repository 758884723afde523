"""Indicators, listings, pages and measures of matching and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmesh.functions.scoring import alert_level, alert_score

MOST_ROWS, MOST_PAGE = 5000, 1000
#: Revenue of a square metre by detection type (fixed values).
RATES = {"new_build": 80, "other": 40}


def detection_kpis(detections: DataFrame) -> DataFrame:
    """Totals, types, statuses and revenue by ward and over all (ward null), in one pass."""
    status = F.coalesce("status", F.lit("pending"))
    due = status.isin("pending", "underassessed")
    rate = F.when(F.col("detection_type") == "new_build", RATES["new_build"]).otherwise(RATES["other"])
    is_ = lambda c, v: F.count_if(c == v)
    return detections.rollup("ward").agg(
        F.count("*").alias("total"),
        is_(F.col("detection_type"), "new_build").alias("new_build"),
        is_(F.col("detection_type"), "change_of_use").alias("change_of_use"),
        *(is_(status, v).alias(v) for v in ("pending", "verified", "underassessed", "rejected", "compliant")),
        F.coalesce(F.sum(F.when(due, F.col("area_sqm") * rate)), F.lit(0.0)).alias("revenue"),
    )


def leaderboard(wards: DataFrame, detections: DataFrame, tickets: DataFrame) -> DataFrame:
    """Per ward: detections, new builds, open and resolved tickets; wards without any count 0."""
    d = detections.groupBy("ward").agg(F.count("*").alias("total_detections"), F.count_if(F.col("detection_type") == "new_build").alias("unassessed"))
    t = tickets.groupBy("ward").agg(F.count_if(F.col("status").isin("open", "under_review")).alias("open_tickets"), F.count_if(F.col("status") == "resolved").alias("resolved_tickets"))
    return wards.select("ward", "name").join(d, "ward", "left").join(t, "ward", "left").na.fill(0)


def daily_brief(board: DataFrame, detections: DataFrame, n: int = 10) -> DataFrame:
    """The n wards of most new builds, each beside the city's totals and revenue in crore."""
    rate = F.when(F.col("detection_type") == "new_build", RATES["new_build"]).otherwise(RATES["other"])
    city = detections.agg(F.count("*").alias("city_detections"), (F.sum(F.col("area_sqm") * rate) / 1e7).alias("city_revenue_crore"))
    return board.orderBy(F.desc("unassessed"), "ward").limit(n).join(F.broadcast(city))


def recent_detections(wards: DataFrame, detections: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Per ward: detections of the last days, mean confidence in percent, alert score and level."""
    new = F.count_if(F.col("detected_at") > now - F.make_dt_interval(F.lit(days)))
    d = detections.groupBy("ward").agg(new.alias("new_count"), (F.avg("confidence") * 100).alias("avg_confidence"))
    out = wards.select("ward", "name").join(d, "ward", "left").withColumn("new_count", F.coalesce("new_count", F.lit(0)))
    points = alert_score(F.lit(0), "avg_confidence", F.lit(0.08), F.lit(0))
    return out.withColumn("alert_score", points).withColumn("severity", alert_level(F.col("alert_score")))


def filtered(df: DataFrame, least: dict | None = None, **equal) -> DataFrame:
    """Rows that meet all given conditions; those of None are left out."""
    for k, v in equal.items():
        df = df if v is None else df.filter(F.col(k) == v)
    for k, v in (least or {}).items():
        df = df if v is None else df.filter(F.col(k) >= v)
    return df


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    if west > east or south > north:
        raise ValueError("a box is west, south, east, north")
    return df.filter((F.col("x0") <= east) & (F.col("x1") >= west) & (F.col("y0") <= north) & (F.col("y1") >= south))


def audit(df: DataFrame, entity: str | None = None, action: str | None = None, limit: int = 100) -> DataFrame:
    """Log rows by prefixes of entity and action, newest first, 1 to 500 of them."""
    for k, v in (("entity", entity), ("action", action)):
        df = df if not v else df.filter(F.col(k).startswith(v))
    return df.orderBy(F.desc("created_at"), "id").limit(max(1, min(500, limit)))


def ranked(df: DataFrame, column: str, order: list[str], then: list, limit: int = MOST_ROWS) -> DataFrame:
    """Rows by the place of a value in `order`, then by other columns; unknown values come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), *then).limit(limit)


def page(df: DataFrame, key: str, limit: int = 100, offset: int = 0, after=None) -> DataFrame:
    """One page in order of key with the number of all rows; `after` goes on behind a key instead of counting an offset."""
    limit, offset = max(1, min(MOST_PAGE, limit)), max(0, offset)
    total = df.agg(F.count("*").alias("number_matched"))
    rows = df if after is None else df.filter(F.col(key) > after)
    return rows.orderBy(key).offset(offset).limit(limit).join(F.broadcast(total))


def natural_order(df: DataFrame, key: str) -> list[Column]:
    """Sort columns that put a numeric prefix before text: 2 before 10 before none."""
    return [F.regexp_extract(key, r"^(\d+)", 1).try_cast("long").asc_nulls_last(), F.col(key)]


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Rows in [edge, next edge)."""
    bucket = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        bucket = F.when((F.col(column) >= edges[i]) & (F.col(column) < edges[i + 1]), i).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter("bucket is not null")


def extraction_metrics(footprints: DataFrame) -> DataFrame:
    """One row: number, mean confidence and height (null without any), total area, of extracted footprints."""
    mean = lambda c, n: F.bround(F.avg(c), n)
    return footprints.agg(F.count("*").alias("n"), mean("confidence", 3).alias("mean_confidence"), mean("height", 2).alias("mean_height"), F.bround(F.coalesce(F.sum("area"), F.lit(0.0)), 1).alias("total_area"))


def match_kpis(matches: DataFrame) -> DataFrame:
    """Number, sure ones, and means of IoU, distance (dist_m, if there) and score; nulls don't count."""
    far = [F.avg("dist_m").alias("mean_dist")] if "dist_m" in matches.columns else []
    return matches.agg(F.count("*").alias("n_matches"), F.count_if(F.col("match_score") >= 85).alias("auto_accept"), F.avg("iou").alias("mean_iou"), F.avg("match_score").alias("mean_score"), *far)


def golden_kpis(golden: DataFrame, enough: float = 0.85) -> DataFrame:
    """Records, mean confidence (null if none has any), sure ones, those with conflicts, members."""
    return golden.agg(
        F.count("*").alias("n_records"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") >= enough).alias("n_sure"),
        F.count_if(F.col("conflict_count") > 0).alias("with_conflicts"), F.coalesce(F.sum("n_members"), F.lit(0)).alias("n_members"),
    )


#: States and types that the overview counts (fixed values).
STATES = ["ready", "failed", "processing", "needs_georef", "pending_ocr"]
UPLOADED = ["cadastral", "municipal_gis", "revenue", "building_footprint", "ground_truth", "gnss_cors", "utility", "ori", "drone_imagery", "dsm_dtm"]


def overview_kpis(sources: DataFrame, conflicts: DataFrame, issues: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: sources by state, types covered, layers extracted, open conflicts and issues, mean ward score.

    sources: source_type, status, n_features; reports: source_id (null: of a ward) and score. Each
    table is read once; a report without a finite score doesn't count.
    """
    s = sources.agg(
        F.count("*").alias("sources"), *(F.count_if(F.col("status") == x).alias(x) for x in STATES), F.count_distinct(F.when(F.col("source_type").isin(UPLOADED), F.col("source_type"))).alias("types_covered"),
        F.count_if(F.col("source_type") == "ai_extracted").alias("extracted_layers"), F.coalesce(F.sum(F.when(F.col("source_type") == "ai_extracted", F.col("n_features"))), F.lit(0)).alias("extracted_features"),
    )
    c = conflicts.agg(F.count_if(F.col("status").isin("pending", "needs_review")).alias("open_conflicts"))
    t = issues.agg(F.count_if(F.col("status") == "open").alias("open_issues"))
    score = F.col("score").cast("double")
    r = reports.filter("source_id is null").agg(F.avg(F.when(~F.isnan(score) & (F.abs(score) != float("inf")), score)).alias("mean_ward_score"))
    return s.crossJoin(c).crossJoin(t).crossJoin(r)  # single rows


def classifier_metrics(rows: DataFrame, by: list[str], cut: float = 0.5) -> DataFrame:
    """ROC-AUC by ranks (ties averaged), precision, recall, F1 at a cut, and Brier score, by group.

    rows: label 0/1 and p. Groups of one class have no AUC. Ranks come from counts of each distinct
    score, so that no group is sorted in one task.
    """
    counts = rows.groupBy(*by, "p").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("rank", below + (F.col("n") + 1) / 2)
    yes = F.col("p") >= cut
    return ranks.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("rank_sum"),
        F.sum(F.when(yes, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(yes, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        (F.sum(F.col("pos") * F.pow(1 - F.col("p"), 2) + (F.col("n") - F.col("pos")) * F.pow("p", 2)) / F.sum("n")).alias("brier"),
    ).select(
        *by, "n", "n_pos",
        F.try_divide(F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, (F.col("n_pos") * (F.col("n") - F.col("n_pos"))).cast("double")).alias("auc"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pos")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")), F.lit(0.0)).alias("f1"),
        "brier",
    )


def missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose keys are not in new."""
    return old.join(new.select(key), key, "left_anti")

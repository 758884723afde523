"""Mappings, labels, details and status reports around matches and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmesh.functions.scoring import OCR_LABELS, normal_name, page_pieces, piece_value
from landmesh.operators.matching import unordered, upsert
from landmesh.operators.spatial import box_pairs

#: Source metadata that are no fields (fixed values).
NOT_FIELDS = ["fields", "feature_count", "repaired_count"]


def source_fields(ocr_fields: Column, fields: Column, metadata: Column) -> Column:
    """Field names of a source: what the scan gave, else the profile, else its metadata's keys."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(ocr_fields), some(fields), F.array_except(F.map_keys(metadata), F.array(*map(F.lit, NOT_FIELDS))))


def proposed_mappings(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fields of two sources whose names are equal but for case and signs, at confidence 0.5.

    sources: source_id, fields; pairs: source_a_id, source_b_id. Of several fields of b with one
    name the last wins.
    """
    f = sources.select("source_id", F.posexplode("fields").alias("pos", "field")).withColumn("name", normal_name("field")).filter("name <> ''")
    last = Window.partitionBy("source_id", "name").orderBy(F.desc("pos"))
    b = f.withColumn("n", F.row_number().over(last)).filter("n = 1").select(F.col("source_id").alias("source_b_id"), "name", F.col("field").alias("field_b"))
    a = f.select(F.col("source_id").alias("source_a_id"), "name", F.col("field").alias("field_a"))
    return pairs.join(a, "source_a_id").join(b, ["source_b_id", "name"]).select("source_a_id", "source_b_id", "field_a", "field_b", F.lit(0.5).alias("confidence"))


def rename_maps(mappings: DataFrame) -> DataFrame:
    """Per pair of sources, in both directions, a map from b's fields to a's.

    Rejected mappings are left out, unreviewed ones count; of several for one field that of highest
    confidence wins, then the smaller name.
    """
    ok = mappings.filter("approved is null or approved")
    both = ok.select(F.col("source_a_id").alias("a_source"), F.col("source_b_id").alias("b_source"), F.col("field_b").alias("from"), F.col("field_a").alias("to"), "confidence").unionByName(
        ok.select(F.col("source_b_id").alias("a_source"), F.col("source_a_id").alias("b_source"), F.col("field_a").alias("from"), F.col("field_b").alias("to"), "confidence")
    )
    first = Window.partitionBy("a_source", "b_source", "from").orderBy(F.desc("confidence"), "to")
    one = both.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return one.groupBy("a_source", "b_source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("from", "to")))).alias("renames"))


def displaced(stored: DataFrame, selected: DataFrame) -> DataFrame:
    """Stored matches that were neither selected again nor are locked."""
    return unordered(stored.filter(~F.coalesce("locked", F.lit(False)))).join(unordered(selected).select("__low", "__high").distinct(), ["__low", "__high"], "left_anti").drop("__low", "__high")


def match_details(matches: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Matches with both features' properties, their geometry if they have one, and the officer's label, if there is one."""
    own = ["properties", *(["geom"] if "geom" in features.columns else [])]
    side = lambda p: features.select(F.col("feature_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in own))
    known = unordered(labels).select("__low", "__high", "label")
    return unordered(matches.join(side("a"), "a_id").join(side("b"), "b_id")).join(known, ["__low", "__high"], "left").drop("__low", "__high")


def labelled_by_key(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where both features have one and the same true parcel.

    truth: feature_id, parcel (null where the layer's key says nothing).
    """
    side = lambda p: truth.select(F.col("feature_id").alias(f"{p}_id"), F.col("parcel").alias(f"{p}_parcel"))
    rows = pairs.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    return rows.withColumn("label", (F.col("a_parcel").isNotNull() & F.col("a_parcel").eqNullSafe(F.col("b_parcel"))).cast("int"))


def decide(matches: DataFrame, labels: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Officers' decisions (a_id, b_id, label, at) as labels with the match's features, and the matches left.

    The latest decision on a pair wins and replaces an older label; rejected matches go.
    """
    last = Window.partitionBy("__low", "__high").orderBy(F.desc("at"), "label")
    d = unordered(decisions).withColumn("n", F.row_number().over(last)).filter("n = 1").select("__low", "__high", "label")
    rows = unordered(matches).join(d, ["__low", "__high"])
    kept = [c for c in labels.columns if c in rows.columns]
    new = upsert(labels, rows.select(*kept), ["a_id", "b_id"])
    left = unordered(matches).join(d.filter("not label"), ["__low", "__high"], "left_anti").drop("__low", "__high")
    return new, left


def touching(wards: DataFrame, villages: DataFrame) -> DataFrame:
    """Villages that touch each ward, by boxes."""
    return box_pairs(wards.withColumn("all", F.lit(1)), villages.withColumn("all", F.lit(1)), ["all"], 2000.0).select(F.col("a_ward").alias("ward"), F.col("b_village_id").alias("village_id"))


def ward_counts(wards: DataFrame, detections: DataFrame) -> DataFrame:
    """Wards with their detections; those without stay at 0."""
    n = detections.groupBy("ward").agg(F.count("*").alias("n"))
    return wards.join(n, "ward", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pipeline_status(jobs: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """Jobs by type and status, and the most frequent failures by type and their first 160 characters."""
    failures = jobs.filter("status = 'failed'").groupBy("job_type", F.substring("error", 1, 160).alias("message")).agg(F.count("*").alias("n"))
    return jobs.groupBy("job_type", "status").agg(F.count("*").alias("n")), failures.orderBy(F.desc("n"), "job_type", "message").limit(top)


def sources_by_status(sources: DataFrame) -> DataFrame:
    """Number of sources of each status, null ones too."""
    return sources.groupBy("status").agg(F.count("*").alias("n"))


def totals(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, under its name."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)  # single rows
    return out


def with_source(df: DataFrame, sources: DataFrame, key: str = "source_id", prefix: str = "source", columns: tuple[str, ...] = ("name", "source_type")) -> DataFrame:
    """df with some columns of the source that `key` names, as <prefix>_<column>; rows without one stay.

    Lists of issues and findings take it once, change runs twice: for baseline_id and current_id.
    """
    of = sources.select(F.col("source_id").alias("__s"), *(F.col(c).alias(f"{prefix}_{c}") for c in columns))
    return df.join(of, F.col(key) == F.col("__s"), "left").drop("__s")


def with_actor(audit: DataFrame, profiles: DataFrame) -> DataFrame:
    """Audit rows with the e-mail of who did it, null for the system's own."""
    return audit.join(profiles.select(F.col("profile_id").alias("actor_id"), F.col("email").alias("actor_email")), "actor_id", "left")


def with_ward(df: DataFrame, wards: DataFrame) -> DataFrame:
    """df with ward_name; rows of no or an unknown ward stay."""
    return df.join(wards.select("ward", F.col("name").alias("ward_name")), "ward", "left")


def epochs_to_compare(sources: DataFrame, runs: DataFrame, old: str = "building_footprint", new: str = "ai_extracted") -> DataFrame:
    """For each ward the latest ready source of both types, unless the ward has a run."""
    last = Window.partitionBy("ward", "source_type").orderBy(F.desc_nulls_last("captured_at"), "source_id")
    s = sources.filter(F.col("source_type").isin(old, new) & (F.col("status") == "ready")).withColumn("n", F.row_number().over(last)).filter("n = 1")
    of = lambda t, name: s.filter(F.col("source_type") == t).select("ward", F.col("source_id").alias(name))
    return of(old, "baseline_id").join(of(new, "current_id"), "ward").join(runs.select("ward"), "ward", "left_anti")


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence of a page's words but those of −1, one decimal; 0 without words."""
    mean = F.avg(F.when(F.col("confidence") != -1, F.col("confidence")))
    return words.groupBy("source_id", "page").agg(F.coalesce(F.bround(mean, 1), F.lit(0.0)).alias("confidence"))


def scanned_fields(pages: DataFrame) -> DataFrame:
    """Each field's value on the first page that has it."""
    pieces = pages.select("source_id", "page", page_pieces("text").alias("pieces"))
    cells = pieces.select("source_id", "page", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), piece_value("pieces", k).alias("value")) for k in OCR_LABELS))).alias("c")).select("source_id", "page", "c.*")
    return cells.filter("value is not null").groupBy("source_id", "field").agg(F.min_by("value", "page").alias("value"), F.min("page").alias("page"))


def without_key(bag: Column, key: str) -> Column:
    return F.map_filter(bag, lambda k, v: k != key)


def published(features: DataFrame) -> DataFrame:
    """Properties as they are published: the bag with ward and repair mark over it."""
    extra = F.map_from_arrays(F.array(F.lit("ward_id"), F.lit("_was_invalid")), F.array(F.col("ward").cast("string"), F.coalesce("was_invalid", F.lit(False)).cast("string")))
    plain = F.map_filter("properties", lambda k, v: ~k.isin("ward_id", "_was_invalid"))
    return features.select("feature_id", F.to_json(F.map_concat(plain, extra)).alias("properties"))

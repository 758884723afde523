"""Rolling feeds over arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery



def rolling_detections(stream: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """Detections and mean confidence of each ward in windows of some days that start every day."""
    return (
        stream.withWatermark("detected_at", late)
        .groupBy(F.window("detected_at", f"{days} days", "1 day").alias("w"), "ward")
        .agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ward", "n", "mean_confidence")
    )


def flagged_tiles(stream: DataFrame, least: float = 50.0) -> DataFrame:
    """Tiles with `buffered`, whether their confidence is under the least."""
    return stream.withColumn("buffered", F.col("confidence") < least)


def append_normalized(stream: DataFrame, normalize, path: str, checkpoint: str) -> StreamingQuery:
    """Normalise arriving feature rows and append them by ward; each file counts once."""
    return normalize(stream).writeStream.format("parquet").partitionBy("ward").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

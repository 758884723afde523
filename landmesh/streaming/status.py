"""Latest status of each key from a stream of changes: keyed state, deltas and their compaction.

The last row of every key is state of the stream, in a RocksDB store with change logs. A batch
reads and writes the state of its own keys only, and appends what it changed as one delta; neither
grows with the table. `current` reads a base and the deltas after it, `compact` makes a new base of
them when it is told to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Settings of a session whose streams keep large state (a user's own settings stay).
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class _Latest(StatefulProcessor):
    """Keeps the row of the greatest `at` of a key, and passes on the rows that replace it."""

    def __init__(self, schema: StructType, at: str):
        self.schema, self.at = schema, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the interface's names
        import pandas as pd

        names = self.schema.names
        best = None
        for frame in rows:
            frame = frame[frame[self.at].notna()]
            if len(frame):
                top = frame.loc[[frame[self.at].idxmax()], names]
                best = top if best is None or top[self.at].iloc[0] > best[self.at].iloc[0] else best
        if best is None:
            return
        known = self.state.get()
        if known is not None and pd.Timestamp(known[names.index(self.at)]) >= pd.Timestamp(best[self.at].iloc[0]):
            return
        values = [None if pd.isna(v) else v for v in best.iloc[0].tolist()]
        at = names.index(self.at)
        values[at] = pd.Timestamp(values[at]).to_pydatetime()
        self.state.update(tuple(values))
        yield best

    def close(self) -> None:
        pass


def latest_status(stream: DataFrame, path: str, checkpoint: str, key: str = "property_id", at: str = "updated_at") -> StreamingQuery:
    """Keep the status of each key that has the greatest `at` (a timestamp); what is there runs, then it ends.

    A row that isn't later than the known one changes nothing, and of equal times the first stays;
    rows with a null key or time are left out. A batch that runs again after a failure writes the
    same delta again.
    """
    spark = stream.sparkSession
    for k, v in STATE_STORE.items():
        if spark.conf.get(k, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", "false"):
            spark.conf.set(k, v)
    schema = stream.schema
    changed = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).transformWithStateInPandas(_Latest(schema, at), schema, "Update", "None")

    def append(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(_delta(path, n))

    return changed.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _delta(path: str, n: int) -> str:
    return f"{path.rstrip('/')}/delta/batch={n:010d}"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Batches of the finished folders name=<number> in a folder, ascending."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    done = [p.getPath() for p in fs.listStatus(place) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().rpartition("=")[2]) for p in done)


def current(spark: SparkSession, path: str, schema: StructType, key: str = "property_id", at: str = "updated_at") -> DataFrame:
    """The table as of the last finished batch: the newest base and the deltas after it."""
    base = _numbers(spark, f"{path}/base")
    deltas = [n for n in _numbers(spark, f"{path}/delta") if not base or n > base[-1]]
    files = ([f"{path}/base/upto={base[-1]:010d}"] if base else []) + [_delta(path, n) for n in deltas]
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    if not deltas:
        return rows
    last = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def compact(spark: SparkSession, path: str, schema: StructType, key: str = "property_id", at: str = "updated_at") -> int | None:
    """Write a new base of all finished deltas and drop what it replaces; its last batch, or None.

    Readers of the old base and deltas may still be at work: they go with the next call only.
    """
    deltas, bases = _numbers(spark, f"{path}/delta"), _numbers(spark, f"{path}/base")
    if not deltas or (bases and bases[-1] >= deltas[-1]):
        return bases[-1] if bases else None
    current(spark, path, schema, key, at).write.mode("overwrite").parquet(f"{path}/base/upto={deltas[-1]:010d}")
    old = [f"{path}/base/upto={n:010d}" for n in bases[:-1]] + [_delta(path, n) for n in deltas if bases and n <= bases[-1]]
    for folder in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return deltas[-1]

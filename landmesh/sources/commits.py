"""Features written file by file, each visible as a whole or not at all.

Every attempt writes to a folder of its own; one rename of a small manifest, under the source's
name, makes it part of the table. Where that name is taken already, the attempt is a replay and
changes nothing. What failed on the way was never named, and `vacuum` removes it.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _named(path: str, source_id: str) -> str:
    """A manifest's place; source ids may hold any character."""
    return f"{path.rstrip('/')}/_files/{hashlib.sha256(source_id.encode()).hexdigest()}"


def _listed(spark: SparkSession, folder: str) -> list:
    place, fs = _fs(spark, folder)
    return [s.getPath() for s in fs.listStatus(place)] if fs.exists(place) else []


def _read_text(spark: SparkSession, place) -> str:
    _, fs = _fs(spark, place.toString())
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commit_features(features: DataFrame, path: str, source_id: str) -> bool:
    """Write one file's features, or nothing of them; whether this call did (False for a replay).

    Rows without a geometry are left out where there is a `geom`; without any row it is an error.
    """
    spark = features.sparkSession
    name, fs = _fs(spark, _named(path, source_id))
    if fs.exists(name):
        return False
    attempt = f"attempt={uuid.uuid4().hex}"
    rows = features.filter("geom.xs is not null") if "geom" in features.columns else features
    rows.write.parquet(f"{path.rstrip('/')}/_data/{attempt}")
    written = spark.read.schema(rows.schema).parquet(f"{path.rstrip('/')}/_data/{attempt}")
    if written.isEmpty():
        raise ValueError(f"no features in {source_id}")
    draft, _ = _fs(spark, f"{name.toString()}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(draft)
    stream.write(f"{attempt}\n{source_id}".encode())
    stream.close()
    if fs.exists(name) or not fs.rename(draft, name):  # another attempt was first
        fs.delete(draft, False)
        return False
    return True


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed files."""
    attempts = [_read_text(spark, p).split("\n")[0] for p in _listed(spark, f"{path.rstrip('/')}/_files") if not p.getName().endswith(".tmp")]
    if not attempts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/_data/{a}" for a in attempts))


def sources(spark: SparkSession, path: str) -> list[str]:
    """Ids of the committed files."""
    return sorted(_read_text(spark, p).split("\n", 1)[1] for p in _listed(spark, f"{path.rstrip('/')}/_files") if not p.getName().endswith(".tmp"))


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove what no manifest names, while no attempt is running; how many attempts went."""
    files = _listed(spark, f"{path.rstrip('/')}/_files")
    used = {_read_text(spark, p).split("\n")[0] for p in files if not p.getName().endswith(".tmp")}
    gone = [p for p in _listed(spark, f"{path.rstrip('/')}/_data") if p.getName() not in used]
    for p in gone + [p for p in files if p.getName().endswith(".tmp")]:
        _, fs = _fs(spark, p.toString())
        fs.delete(p, True)
    return len(gone)

"""Helpers shared by the corpus operators: inputs, the shared folder, words and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.sources.scratch import dropped, written

#: White space of every word definition of this subpackage: space and \t \n \v \f \r.
WORD_SPACE = b" \t\n\x0b\x0c\r"

#: Odd 64-bit constants of the polynomial hashes (fixed values, chosen at random once).
BYTE_BASE = np.uint64(0x9E6C63D0676A9A99)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a session on one machine gets a temporary folder; on a cluster
    that is an error, as executors would write where nobody reads.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again."""
    return written(df, shared_dir(df.sparkSession, name))


class Scratch:
    """Tables of one job in the shared folder, dropped when what came of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """As `materialize`, but until `drop`."""
        self.paths.append(shared_dir(self.spark, name))
        return written(df, self.paths[-1])

    def drop(self) -> None:
        dropped(self.spark, self.paths)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits of the input."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        known = (out[0], out[1])
        if size <= 1 << 22:  # larger ones serve a single long document
            _POWERS[int(base)] = known
    return known[0][:n], known[1][:n]


def prefix_hash(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that `span_hash` needs."""
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums, inverse


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of the hashed sequence; equal spans, equal hashes."""
    sums, inverse = prefix
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def rolling_hash(prefix: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """span_hash of the k units from each unit on that has as many."""
    sums, inverse = prefix
    n = max(0, len(sums) - k)
    return mix((sums[k:] - sums[:n]) * inverse[:n] + np.uint64(k))


def width_of(span: int) -> int:
    """Bytes that numbers up to span need."""
    return max(1, (int(span).bit_length() + 7) // 8)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WORD_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a run of texts: byte spans, hashes and, for each text, the first word's index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        """data: UTF-8 bytes of all texts; offsets: where each starts, and the end of the last."""
        offsets = offsets.astype(np.int64)
        n = len(data)
        gap = _SPACE[data]
        word = np.zeros(n + 2, dtype=bool)
        np.logical_not(gap, out=word[1:-1])
        cut = np.zeros(n + 1, dtype=bool)  # a text starts here: words don't run over it
        cut[offsets] = True
        self.start = np.flatnonzero(word[1:] & (~word[:-1] | cut))
        self.end = np.flatnonzero(word[:-1] & (~word[1:] | cut))
        self.hash = span_hash(prefix_hash(_LOWER[data] if lower else data, BYTE_BASE), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def window_hash(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only windows inside one text are of use."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(n - k + 1)
        return span_hash(prefix_hash(self.hash, WORD_BASE), at, at + k)


def text_runs(batches, text: str = "text", most: int = 2 << 20):
    """(batch slice, bytes, offsets) of up to `most` bytes of text each; null counts as empty.

    A longer single text makes a run of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8)
        i, n = 0, len(column)
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
            i = j


def number(batch, name: str) -> np.ndarray:
    """A non-null integer column as numpy."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)

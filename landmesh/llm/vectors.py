"""Integer vectors for the operators on embeddings: which rows count, whole components, exact means.

Components become whole numbers. Up to NARROW in size they are held as float64, in which every
sum and product here is exact; larger ones go through Python's integers, slower and exact too.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared distances of 64 or fewer components of this size stay below 2**53.
NARROW = 1 << 21
#: Means pass Spark as decimals of 38 digits; components beyond this are an error.
WIDEST = 10**25
#: Largest number of a long column; distances above it come out null.
LONG = (1 << 63) - 1

PARTIAL = "slot int, n long, sums array<decimal(38,0)>"


def usable(vector: str, width: int) -> Column:
    """Whether a vector has exactly `width` components, none of them null, NaN or infinite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(v) == width) & fine, F.lit(False))


def whole(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector; Python integers where one is wide."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * scale).reshape(-1, width)
    return out if not out.size or np.abs(out).max() <= NARROW else integers(out)


def integers(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    out = np.empty(values.shape, dtype=object)
    out.ravel()[:] = [int(x) for x in values.ravel()]
    if any(abs(x) > WIDEST for x in out.ravel()):
        raise ValueError("a component is too large for exact means")
    return out


def pieces(rows: np.ndarray, codebook: np.ndarray):
    """(row numbers, rows, codebook) of one kind of number each: most rows fast, wide ones exact."""
    if rows.dtype == object and codebook.dtype != object:
        wide = (np.abs(rows) > NARROW).any(axis=1)
        for at, kind in ((np.flatnonzero(~wide), np.float64), (np.flatnonzero(wide), object)):
            if len(at):
                yield at, rows[at].astype(kind), codebook if kind is np.float64 else integers(codebook)
    elif len(rows):
        yield np.arange(len(rows)), rows if codebook.dtype != object else integers(rows), codebook


class Sums:
    """Sums and counts by slot, of a task's vectors."""

    def __init__(self, slots: int, width: int):
        self.n = np.zeros(slots, dtype=np.int64)
        self.low = np.zeros((slots, width), dtype=np.int64)
        self.high = None  # of wide vectors

    def add(self, slot: np.ndarray, rows: np.ndarray) -> None:
        if not len(slot):
            return
        order = np.argsort(slot, kind="stable")
        first = np.flatnonzero(np.diff(slot[order], prepend=-1))
        at, total = slot[order][first], np.add.reduceat(rows[order], first, axis=0)
        self.n += np.bincount(slot, minlength=len(self.n))
        if rows.dtype == object:
            if self.high is None:
                self.high = np.zeros(self.low.shape, dtype=object)
            self.high[at] += total
        else:
            self.low[at] += total.astype(np.int64)

    def batch(self) -> pa.RecordBatch:
        """A row for each slot that has vectors."""
        at = np.flatnonzero(self.n)
        total = self.low[at].astype(object) + (0 if self.high is None else self.high[at])
        kind = pa.decimal128(38, 0)
        flat = pa.array([Decimal(int(x)) for x in total.ravel()], kind)
        offsets = np.arange(len(at) + 1, dtype=np.int32) * self.low.shape[1]
        sums = pa.ListArray.from_arrays(pa.array(offsets), flat)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(self.n[at]), sums], ["slot", "n", "sums"])


def with_means(codebook: np.ndarray, partial: DataFrame) -> np.ndarray:
    """The codebook with the floor of the mean in every slot that has vectors.

    A task sends a row for each of its slots at most; what reaches the driver is one for each slot.
    """
    width = codebook.shape[1]
    total = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = integers(codebook)
    for r in total.collect():
        out[r.slot] = [int(s) // r.n for s in r.sums]
    return out if any(abs(x) > NARROW for x in out.ravel()) else out.astype(np.float64)


def as_long(values: np.ndarray) -> pa.Array:
    """Whole numbers as a long column; null where they don't fit."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(x) if x <= LONG else None for x in values], pa.int64())


def decimal_text(codebook: np.ndarray) -> str:
    return ",".join(str(int(x)) for x in codebook.ravel())


def summed(distance: str) -> Column:
    """A sum of longs as a long; null where it doesn't fit."""
    return F.sum(F.col(distance).cast("decimal(19,0)")).try_cast("long")

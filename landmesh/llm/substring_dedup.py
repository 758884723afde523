"""Substring dedup: words covered by windows of 50 that a document of smaller id has too.

Candidate contexts come from `anchors`. Each shard builds a compressed FM-index, a wavelet matrix
of packed bits over the Burrows-Wheeler transform of its contexts, and streams the contexts through
it from their ends: backward search with parent intervals gives the matching statistics up to the
threshold. Each word extends the match by one step; a match of more than 50 words goes back to the
interval of its first 50, so that a context costs as many steps as it has words. Where an interval
of 50 words has several suffixes, it says which document holds the window first.

Suffixes are ordered by a little more than 50 words, which is enough: a step from an interval of at
most that many words only counts suffixes by their beginnings, and never within ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from landmesh.llm.anchors import HINT, HOT, HOT_LEAST, NULL_ID, WINDOWS_OF, Spec, covered, numbered, with_windows
from landmesh.llm.common import Words, table, text_runs

WINDOW = 50


def suffix_array(symbols: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence in order of their first symbols, more than `window` of them, and for
    each whether its first `window` differ from those before it. Equal zeros count as smaller the
    earlier they are.

    Ranks of ever longer beginnings: as many of them as 63 bits hold (two or more, of fewer than
    2^31 symbols) are sorted as one number.
    """
    n = len(symbols)
    zeros = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    bits = int(max(n, rank.max(initial=0)) + 1).bit_length()
    step = 1

    def after(by: int) -> np.ndarray:
        """Ranks from 1 of the places so far on; 0 past the end."""
        out = np.zeros(n, dtype=np.int64)
        out[: max(0, n - by)] = known[by:] + 1
        return out

    while step <= window:
        known, depth = rank, step
        key, times = known + 1, 1
        while (times + 1) * bits <= 63 and times * step <= window:
            key = key << bits | after(times * step)
            times += 1
        order = np.argsort(key)
        key = key[order]
        rank = np.zeros(n, dtype=np.int64)
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1])
        step *= times
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for by in (*range(0, window - depth, depth), window - depth):
        part = after(by)[order]
        new[1:] |= part[1:] != part[:-1]
    return order, new


class FmIndex:
    """Counts of symbols in prefixes of the transform, by a wavelet matrix of packed bits."""

    def __init__(self, symbols: np.ndarray, window: int | None = None):
        self.order, new = suffix_array(symbols, len(symbols) if window is None else window)
        #: Where intervals of `window` symbols begin, and each suffix's interval.
        self.heads, self.interval = np.append(np.flatnonzero(new), len(symbols)), np.cumsum(new) - 1
        bwt = symbols[self.order - 1]
        self.size = len(symbols)
        top = int(symbols.max(initial=0)) + 1
        self.levels = max(1, int(top - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            count = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=count[1:])
            self.bits.append(packed)
            self.counts.append(count)
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        #: Where a symbol's suffixes begin, and its run in the last level.
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))])
        self.begin = np.searchsorted(bwt[: self.size], 0) * np.ones(top, dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]])) if self.size else np.zeros(0, int)
        self.begin[bwt[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before a place of the transform."""
        at = at.copy()
        for k in range(self.levels):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            set_ = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(set_, self.zeros[k] + ones, at - ones)
        return at - self.begin[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The intervals of suffixes after a symbol is put before what they matched."""
        both = self.before[symbol] + self.rank(np.stack([symbol, symbol]), np.stack([low, high]))
        return both[0], both[1]

    def parent(self, low: np.ndarray):
        """The intervals of the first `window` symbols of what longer ones matched."""
        at = self.interval[low]
        return self.heads[at], self.heads[at + 1]


def earlier_windows(spec: Spec, doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, raw: np.ndarray):
    """Windows of the contexts that a document of smaller id has in its contexts."""
    _, symbols = np.unique(raw, return_inverse=True)
    size = n + spec.window - 1
    # Each context is followed by a zero.
    text = np.zeros(len(raw) + len(size), dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(raw))
    text[place] = symbols + 1
    index = FmIndex(text, spec.window)
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    #: The least document of each interval of a window.
    least = np.minimum.reduceat(np.repeat(doc, size + 1)[index.order], index.heads[:-1])
    owners, places = [], []
    by = np.argsort(-size, kind="stable")
    length, last = size[by], (begin + size)[by]  # past each context
    low = high = np.zeros(0, np.int64)
    for step in range(1, int(length[0]) + 1):
        live = by[: int(np.searchsorted(-length, -step, side="right"))]
        symbol = text[last[: len(live)] - step]
        if step == 1:
            low, high = index.before[symbol], index.before[symbol + 1]
        else:
            low, high = index.extend(symbol, low[: len(live)], high[: len(live)])
        if step > spec.window:
            low, high = index.parent(low)
        if step >= spec.window:
            # Else no other context goes on with the match.
            hit = np.flatnonzero((high - low > 1) & (least[index.interval[low]] < doc[live]))
            owners.append(live[hit])
            places.append((at + size)[live[hit]] - step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *owners]), np.concatenate([none, *places])


def removal(documents: DataFrame, window: int = WINDOW, gram: int = 10, carry: tuple[str, ...] = (), hot: int = HOT, share: float = HINT, least: int = HOT_LEAST) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept (the kept words joined by one space), and
    the columns named in `carry` as one struct of that name, whatever they are called.

    A word is removed if a window of words covers it that also starts in a document of smaller id,
    judged on the whole input. Null text has no words; texts of fewer words than a window lose
    none; repeats inside one document stay. Each row is a document: rows of equal id don't count
    against each other; a null id is less than all others. An empty table gives no rows.
    """
    spec = Spec(window, gram, words=True, within=False, hot=hot)
    docs = numbered(documents, carry)
    through = [c for c in ("doc_id", "carry") if c in docs.columns]

    def run(batches):
        for batch, data, offsets in text_runs(batches):
            words, raw = Words(data, offsets, lower=False), data.tobytes()
            windows = batch.column(batch.schema.get_field_index(WINDOWS_OF)).to_pylist()
            n_removed, kept = [], []
            for i, w in enumerate(windows):
                a, b = words.first[i], words.first[i + 1]
                start, end = words.start[a:b], words.end[a:b]
                if w:
                    gone = covered(spec, w, b - a)
                    n_removed.append(int(gone.sum()))
                    start, end = start[~gone], end[~gone]
                    kept.append(b" ".join([raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]).decode())
                else:
                    n_removed.append(0)
                    kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in through), pa.array(words.count, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*through, "n_words", "n_removed", "kept"])

    schema = StructType([*(docs.schema[c] for c in through), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    out = with_windows(docs, spec, earlier_windows, share, least).mapInArrow(run, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removal(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

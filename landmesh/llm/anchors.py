"""Equal windows across documents by content-chosen anchors.

Exact search for windows (a fixed number of bytes or words) that occur more than once would have
to move every window. Instead each window names one of its k-grams, that of the least hash: equal
windows name the same k-gram at the same place. The run of consecutive windows that name one
k-gram is a record; its context is the text from the first window's start to the last one's end.

1. Records are dealt by k-gram (hashes and places only). The first two holders of a context that
   is repeated as a whole, and the first of each where a k-gram has several contexts, must be
   compared window by window.
2. The contexts of those are dealt by k-gram, and a shard function compares them: it gets arrays
   of contexts and returns which windows occur in an earlier one. K-grams with very many contexts
   are dealt by window instead, so that no shard gets them all.
3. Each document gets its decided windows back.

So the shard compares the content of every distinct window that is there twice, and finds which of
them occur earlier. Holders of a context from the third on take over what holds for the second by
the context's hash (64 bits beside the 40 of the k-gram): of thousands of copies, two reach a shard.

Hot k-grams, those of a line that a large part of all documents has, are found first in a part of
the texts; this chooses the way, not the result. They name windows only where a window has no
other k-gram, so that the windows around such a line go to rare k-grams; what is left of them is
dealt by k-gram and context. Of equal contexts, and equal lone windows, that meet in one chunk of a
map task two go on, so that what many documents share sends two records for each chunk.

A row is told from others by its id and a hash of its text: rows of equal id and text are one
document with one result, rows of equal id and different texts don't count against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmesh.llm.common import BYTE_BASE, WORD_BASE, Words, materialize, mix, number, prefix_hash, rolling_hash, shuffle_parts, span_hash, text_runs, width_of

#: Units of text in one chunk of a map task, within which equal contexts are decided at once.
CHUNK = 16 << 20
#: Contexts of one k-gram above which they are dealt by window.
HOT = 20_000
#: Share of the rows in which hot k-grams are looked for; bytes of text for each partition.
HINT, PART_BYTES = 1 / 16, 64 << 20
#: A k-gram is hot with this part of a partition's records, and this many places in the sample;
#: each has at least one of MOST_HOT of all places, so that there are at most as many.
HOT_PART, HOT_LEAST, MOST_HOT = 1 / 4, 8, 1_000_000
H_BYTES, C_BYTES = 5, 8
NULL_ID = -(1 << 63)


@dataclass
class Spec:
    """What a window is, and which of two equal ones counts as earlier."""

    window: int
    gram: int
    words: bool
    #: Equal windows of one document count too, by their place; else only those of another document.
    within: bool
    #: Contexts of one k-gram above which they are dealt by window.
    hot: int = HOT

    @property
    def reach(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Run:
    """Units of some documents: hashes for prefix sums, raw content and bounds."""

    prefix: tuple[np.ndarray, np.ndarray]
    raw: np.ndarray
    first: np.ndarray
    count: np.ndarray


def units(spec: Spec, data: np.ndarray, offsets: np.ndarray) -> Run:
    if spec.words:
        w = Words(data, offsets, lower=False)
        return Run(prefix_hash(w.hash, WORD_BASE), w.hash, w.first[:-1], w.count)
    return Run(prefix_hash(data, BYTE_BASE), data, offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64))


class HotGrams:
    """A set of k-gram hashes; what most look-ups need is a table of bits."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(np.uint64))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.grams & np.uint64(0xFFFFF)] = True

    def among(self, gram: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(gram), dtype=bool)
        out = self.bits[gram & np.uint64(0xFFFFF)]
        some = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.grams, gram[some]), len(self.grams) - 1)
        out[some] = self.grams[at] == gram[some]
        return out


def records(spec: Spec, run: Run, hot: HotGrams):
    """Arrays of document index, first window, number of windows, k-gram hash and whether it is
    hot; places in the run."""
    n = len(run.raw)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    if n < spec.window:
        return none
    gram = rolling_hash(run.prefix, spec.gram)
    least = gram >> np.uint64(32)
    least <<= np.uint64(31)
    least |= np.arange(len(gram), dtype=np.uint64)
    is_hot = hot.among(gram)
    if len(hot.grams):
        least[is_hot] |= np.uint64(1 << 63)  # after all others
    size = 1
    while size * 2 <= spec.reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    more = spec.reach - size
    if more:
        least = np.minimum(least[:-more], least[more:])
    anchor = (least & np.uint64(0x7FFFFFFF)).astype(np.int64)
    # Windows inside one document.
    fits = np.zeros(n + 1, dtype=np.int32)
    has = run.count >= spec.window
    np.add.at(fits, run.first[has], 1)
    np.add.at(fits, (run.first + run.count - spec.window + 1)[has], -1)
    valid = np.cumsum(fits)[: len(anchor)] > 0
    change = np.ones(len(anchor), dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    start = np.flatnonzero(change & valid)
    if not len(start):
        return none
    stops = np.flatnonzero(np.concatenate([(change | ~valid)[1:], [True]]))
    stop = stops[np.searchsorted(stops, start)] + 1
    doc = np.searchsorted(run.first, start, side="right") - 1
    # Documents without units share their first place with the next one: take the one that has it.
    return doc, start, stop - start, gram[anchor[start]], is_hot[anchor[start]]


def _count_grams(spec: Spec):
    """(h, n) of the k-grams that a chunk has often, and with a null h the numbers of places and bytes."""

    def flush(held, size):
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= max(2, n.sum() // (4 * MOST_HOT))
        h = pa.array([None, None, *gram[some].view(np.int64).tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([h, pa.array([int(n.sum()), 0, *n[some].tolist()], pa.int64()), pa.array([0, size] + [0] * int(some.sum()), pa.int64())], ["h", "n", "size"])

    def run(batches):
        held, size = [], 0
        for _, data, offsets in text_runs(batches):
            r = units(spec, data, offsets)
            held.append(rolling_hash(r.prefix, spec.gram))
            size += len(data)
            if size >= CHUNK:
                yield flush(held, size)
                held, size = [], 0
        if held:
            yield flush(held, size)

    return run


def plan(documents: DataFrame, spec: Spec, share: float = HINT, least: int = HOT_LEAST) -> tuple[int, HotGrams]:
    """The number of partitions for these texts, and their hot k-grams; at most MOST_HOT of them."""
    seen = documents.select("text").sample(fraction=share, seed=1) if share < 1 else documents.select("text")
    seen = materialize(seen.mapInArrow(_count_grams(spec), "h long, n long, size long"), "grams")
    total = seen.filter("h is null").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    parts = max(shuffle_parts(documents.sparkSession), round((total["size"] or 0) / share / PART_BYTES))
    places = total["n"] or 0
    often = max(least, HOT_PART * places / (spec.reach / 2) / parts, places / MOST_HOT)
    hot = seen.filter("h is not null").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= often).select("h").collect()
    return parts, HotGrams(np.array([r.h for r in hot], dtype=np.int64).view(np.uint64))


def pack(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, dtype=np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of the sorted keys changes."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def earliest(spec: Spec, context: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, *more: np.ndarray):
    """Order by (more, context, doc, row, place), group starts, and who isn't the first of a group:
    what a document of smaller id has too or, within rows, what the same row has before."""
    order = np.lexsort((at, row, doc, context, *more))
    context, doc, row, at = context[order], doc[order], row[order], at[order]
    new = _starts(context, *(m[order] for m in more))
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    later = doc > doc[head][group]
    if spec.within:
        run = new | _starts(doc, row)
        later |= at > at[np.flatnonzero(run)][np.cumsum(run) - 1]
    return order, group, head, later


def beyond_second(group: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Of those that aren't first, all but the next one of each group."""
    out = later.copy()
    some = np.flatnonzero(later)
    if len(some):
        out[some[_starts(group[some])]] = False
    return out


def _by_row(doc: np.ndarray, row: np.ndarray, *columns: np.ndarray):
    """For each row its id and hash and its part of each column, as bytes; equal entries once."""
    order = np.lexsort((*columns[::-1], row, doc))
    order = order[_starts(doc[order], row[order], *(c[order] for c in columns))] if len(order) else order
    doc, row, columns = doc[order], row[order], [c[order] for c in columns]
    head = np.flatnonzero(_starts(doc, row)) if len(doc) else np.zeros(0, int)
    tail = [*head[1:], len(doc)] if len(head) else []
    return doc[head], row[head], [[c[a:b].tobytes() for a, b in zip(head, tail, strict=True)] for c in columns]


#: Rows between the steps: for a bucket its records, or for a row its windows.
RECORDS = "bucket int, doc_id long, row long, hot boolean, width int, a binary, b binary, c binary, d binary, e binary, f binary"
_RECORDS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("hot", pa.bool_()), ("width", pa.int32()), *((c, pa.binary()) for c in "abcdef")])
WINDOWS = "doc_id long, row long, kind int, at binary, n binary"
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
DECIDED, OPEN, OPEN_HOT = 0, 1, 2
#: Column of a document's windows.
WINDOWS_OF = "__windows"


def _windows(kind: int, doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Rows of WINDOWS."""
    ids, rows, (places, counts) = _by_row(doc, row, at.astype("<i4"), n.astype("<i4"))
    for i in range(0, len(ids), 5000):
        j = slice(i, i + 5000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(rows[j]), pa.array([kind] * len(ids[j]), pa.int32()), pa.array(places[j], pa.binary()), pa.array(counts[j], pa.binary())], schema=_WINDOWS)


def _joined(doc: np.ndarray, row: np.ndarray, place: np.ndarray):
    """Single windows as runs of consecutive ones: document, row, first window and number."""
    order = np.lexsort((place, row, doc))
    doc, row, place = doc[order], row[order], place[order]
    new = _starts(doc, row)
    new[1:] |= place[1:] > place[:-1] + 1
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(place)) - 1
    return doc[head], row[head], place[head], place[last[: len(head)]] - place[head] + 1


def _row_bucket(doc: np.ndarray, row: np.ndarray, parts: int) -> np.ndarray:
    return (mix(mix(doc.view(np.uint64)) ^ row.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _emit_records(spec: Spec, parts: int, hot: HotGrams):
    def flush(held):
        doc, row, at, n, h, is_hot, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order, group, _, later = earliest(spec, c, doc, row, at, h)
        later = beyond_second(group, later)
        doc, row, at, n, h, is_hot, c = (x[order] for x in (doc, row, at, n, h, is_hot, c))
        ids, keys, (places, counts) = _by_row(doc[later], row[later], at[later].astype("<i4"), n[later].astype("<i4"))
        rows = [[b, i, r, False, 0, p, k, None, None, None, None] for b, i, r, p, k in zip(_row_bucket(ids, keys, parts).tolist(), ids.tolist(), keys.tolist(), places, counts, strict=True)]
        doc, row, at, n, h, is_hot, c = (x[~later] for x in (doc, row, at, n, h, is_hot, c))
        base = int(doc.min(initial=np.iinfo(np.int64).max))
        size = width_of(int(doc.max(initial=base)) - base)
        bucket = (mix(np.where(is_hot, h ^ mix(c), h)) % np.uint64(parts)).astype(np.int64) * 2 + is_hot
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(2 * parts + 1))
        for b in range(2 * parts):
            i = order[edge[b] : edge[b + 1]]
            if len(i):
                docs = doc[i].view(np.uint64) - np.int64(base).view(np.uint64)
                rows.append([b // 2, None, base, bool(b % 2), size, pack(h[i], H_BYTES), pack(c[i], C_BYTES), pack(docs, size), pack(row[i].view(np.uint64), 8), pack(at[i], 4), pack(n[i], 2)])
        columns = list(zip(*rows, strict=True)) or [()] * len(_RECORDS)
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 2000], f.type) for x, f in zip(columns, _RECORDS, strict=True)], schema=_RECORDS)

    def run(batches):
        held, size = [], 0
        for batch, data, offsets in text_runs(batches):
            ids, keys, r = number(batch, "doc_id"), number(batch, "row"), units(spec, data, offsets)
            doc, at, n, h, is_hot = records(spec, r, hot)
            context = span_hash(r.prefix, at, at + n + spec.window - 1)
            held.append((ids[doc], keys[doc], at - r.first[doc], n, h & np.uint64((1 << 8 * H_BYTES) - 1), is_hot, context))
            size += len(data)
            if size >= CHUNK:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _passed(rows: dict) -> pa.RecordBatch | None:
    """The windows decided in the map task before, of rows that have an id."""
    some = [i for i, d in enumerate(rows["doc_id"]) if d is not None]
    if some:
        return pa.RecordBatch.from_arrays([pa.array([rows["doc_id"][i] for i in some], pa.int64()), pa.array([rows["row"][i] for i in some], pa.int64()), pa.array([DECIDED] * len(some), pa.int32()), pa.array([rows["a"][i] for i in some], pa.binary()), pa.array([rows["b"][i] for i in some], pa.binary())], schema=_WINDOWS)
    return None


def _decide(spec: Spec):
    def run(batches):
        held = []
        for batch in batches:
            rows = batch.to_pydict()
            passed = _passed(rows)
            if passed:
                yield passed
            for i, d in enumerate(rows["doc_id"]):
                if d is None:
                    h, c, doc, row, at, n = (unpack(rows[k][i], size) for k, size in zip("abcdef", (H_BYTES, C_BYTES, rows["width"][i], 8, 4, 2), strict=True))
                    doc = doc + np.int64(rows["row"][i]).view(np.uint64)
                    held.append([h, c, doc.view(np.int64), row.view(np.int64), at.astype(np.int64), n.astype(np.int64), np.full(len(h), rows["hot"][i])])
        if not held:
            return
        h, c, doc, row, at, n, hot = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, group, head, later = earliest(spec, c, doc, row, at, h)
        h, doc, row, at, n, hot = (x[order] for x in (h, doc, row, at, n, hot))
        # Contexts of each k-gram, counted once for their first holder. Those of a hot one are not
        # all here, so that each may have others.
        new = _starts(h)
        gram = np.cumsum(new) - 1
        contexts = np.bincount(gram[head], minlength=int(gram[-1]) + 1)[gram]
        many = hot | (contexts > spec.hot)
        decided = beyond_second(group, later)
        pair = later & ~decided
        pair[head] = np.bincount(group[pair], minlength=len(head)) > 0
        for kind, some in ((DECIDED, decided), (OPEN, ~decided & (pair | (contexts > 1)) & ~many), (OPEN_HOT, ~decided & many)):
            yield from _windows(kind, doc[some], row[some], at[some], n[some])

    return run


def _ints(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts or ()), dtype="<i4").astype(np.int64)


CONTEXTS = "bucket int, doc_id long, row long, a binary, b binary, c binary, d binary, raw binary"
_CONTEXTS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "c", "d", "raw"))])


def _emit_contexts(spec: Spec, parts: int, hot_grams: HotGrams):
    """Of rows with open windows, their contexts by bucket; hot ones window by window, of equal
    windows of a run the first two, while the others are decided."""

    def opened(batch, r):
        doc, at, n, key = [], [], [], []
        for column, hot in (("open", False), ("hot", True)):
            for i, x in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                if x:
                    places, counts = _ints(y["at"] for y in x), _ints(y["n"] for y in x)
                    if hot:
                        places = np.repeat(places, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        counts = np.ones_like(places)
                    doc.append(np.full(len(places), i))
                    at.append(places + r.first[i])
                    n.append(counts)
                    key.append(np.full(len(places), hot))
        return [np.concatenate(x) for x in (doc, at, n, key)] if doc else None

    def run(batches):
        for batch, data, offsets in text_runs(batches):
            ids, keys, r = number(batch, "doc_id"), number(batch, "row"), units(spec, data, offsets)
            found = opened(batch, r)
            if found is None:
                continue
            doc, at, n, hot = found
            out: list[list] = [[] for _ in _CONTEXTS]
            if hot.any():
                i = np.flatnonzero(hot)
                order, group, _, later = earliest(spec, span_hash(r.prefix, at[i], at[i] + spec.window), ids[doc[i]], keys[doc[i]], at[i] - r.first[doc[i]])
                gone = i[order[beyond_second(group, later)]]
                if len(gone):
                    x = doc[gone]
                    some, rows, (places, counts) = _by_row(ids[x], keys[x], (at[gone] - r.first[x]).astype("<i4"), np.ones(len(gone), "<i4"))
                    for column, v in zip(out, (_row_bucket(some, rows, parts).tolist(), some.tolist(), rows.tolist(), places, counts, [None] * len(some), [None] * len(some), [None] * len(some)), strict=True):
                        column += v
                    stay = np.ones(len(doc), dtype=bool)
                    stay[gone] = False
                    doc, at, n, hot = doc[stay], at[stay], n[stay], hot[stay]
            # A record's bucket is that of its k-gram; a lone window's that of the window.
            bucket = (mix(span_hash(r.prefix, at, at + spec.window)) % np.uint64(parts)).astype(np.int64)
            if not hot.all():
                _, rec_at, _, rec_h, _ = records(spec, r, hot_grams)
                where = np.searchsorted(rec_at, at[~hot])
                bucket[~hot] = (mix(rec_h[where] & np.uint64((1 << 8 * H_BYTES) - 1)) % np.uint64(parts)).astype(np.int64)
            size = n + spec.window - 1
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(parts + 1))
            for b in range(parts):
                i = order[edge[b] : edge[b + 1]]
                if len(i):
                    long = size[i]
                    take = np.repeat(at[i] - (np.cumsum(long) - long), long) + np.arange(long.sum())
                    x = doc[i]
                    for column, v in zip(out, (b, None, None, ids[x].astype("<i8").tobytes(), keys[x].astype("<i8").tobytes(), (at[i] - r.first[x]).astype("<i4").tobytes(), n[i].astype("<u2").tobytes(), r.raw[take].tobytes()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _CONTEXTS, strict=True)], schema=_CONTEXTS)

    return run


def _compare(spec: Spec, shard: Callable):
    def run(batches):
        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            passed = _passed(batch.select(["doc_id", "row", "a", "b"]).to_pydict())
            if passed:
                yield passed
            some = batch.filter(batch.column(1).is_null())
            for column, kind, to in zip(range(3, 8), ("<i8", "<i8", "<i4", "<u2", "<u8" if spec.words else "u1"), held, strict=True):
                to += [np.frombuffer(x, dtype=kind) for x in some.column(column).to_pylist()]
        if not held[0]:
            return
        doc, row, at, n, raw = (np.concatenate(x) for x in held)
        held.clear()
        at, n = at.astype(np.int64), n.astype(np.int64)
        which, place = shard(spec, doc, row, at, n, raw)  # windows that occur earlier
        yield from _windows(DECIDED, *_joined(doc[which], row[which], place))

    return run


def repeated_windows(documents: DataFrame, spec: Spec, shard: Callable, share: float = HINT, least: int = HOT_LEAST) -> DataFrame:
    """Per row (doc_id and row, of those that have any) the windows that occur earlier, as an array
    of structs with packed first windows (at) and numbers of windows (n).

    documents: doc_id long, row (hash of the text) and text. shard(spec, doc, row, at, n, raw)
    returns arrays of the context and the window's place for the windows of one shard that occur
    earlier in it.
    """
    parts, hot = plan(documents, spec, share, least)
    rows = documents.mapInArrow(_emit_records(spec, parts, hot), RECORDS).repartitionById(parts, "bucket")
    first = materialize(rows.mapInArrow(_decide(spec), WINDOWS), "windows")
    is_kind = lambda k: F.collect_set(F.when(F.col("kind") == k, F.struct("at", "n")))
    open_ = first.filter(F.col("kind") != DECIDED).groupBy("doc_id", "row").agg(is_kind(OPEN).alias("open"), is_kind(OPEN_HOT).alias("hot"))
    contexts = documents.join(open_.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "row", "text", "open", "hot").mapInArrow(_emit_contexts(spec, parts, hot), CONTEXTS)
    second = contexts.repartitionById(parts, "bucket").mapInArrow(_compare(spec, shard), WINDOWS)
    both = first.filter(F.col("kind") == DECIDED).unionByName(second)
    return both.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "n")).alias("windows"))


def numbered(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (null: the least), row, text and the carried columns in one struct, `carry`."""
    columns = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text")]
    return documents.select(*columns, *([F.struct(*carry).alias("carry")] if carry else []))


def with_windows(documents: DataFrame, spec: Spec, shard: Callable, share: float = HINT, least: int = HOT_LEAST) -> DataFrame:
    """numbered documents with their windows that occur earlier, null if there are none."""
    found = repeated_windows(documents.select("doc_id", "row", "text"), spec, shard, share, least).withColumnRenamed("windows", WINDOWS_OF)
    return documents.join(found.hint("shuffle_hash"), ["doc_id", "row"], "left").select(*documents.columns, WINDOWS_OF)


def covered(spec: Spec, windows, count: int) -> np.ndarray:
    """Which of a document's units the windows cover."""
    mark = np.zeros(count + 1, dtype=np.int32)
    if windows:
        at, n = _ints(w["at"] for w in windows), _ints(w["n"] for w in windows)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + n + spec.window - 1, -1)  # windows of both steps may overlap
    return np.cumsum(mark[:-1]) > 0

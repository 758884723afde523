"""One large GeoJSON collection read by many tasks.

The file is cut into byte ranges. A first pass tells, for each range and either case, inside or
outside of a text at its start, how quotes and brackets change the state; running through these
few numbers gives the state at every range's start. A second pass then reads the features that
begin in each range, up to the bracket that closes the last of them, wherever that is.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.functions.geometry import from_geojson

RANGE = 32 << 20
#: Bytes that a feature's end is looked for at a time.
AHEAD = 1 << 20
QUOTE, SLASH, SPACE = 34, 92, b" \t\r\n"


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def _bytes(source, start: int, size: int) -> np.ndarray:
    source.seek(start)
    return np.frombuffer(source.read(size), dtype=np.uint8)


def _escaped(source, start: int) -> bool:
    """Whether the byte at start comes after an odd run of backslashes."""
    n, step = 0, 64
    while start > n:
        size = min(step, start - n)
        tail = _bytes(source, start - n - size, size)[::-1]
        run = int(np.argmax(tail != SLASH)) if (tail != SLASH).any() else size
        n += run
        if run < size:
            break
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of quotes that no backslash takes away."""
    at = np.flatnonzero(data == QUOTE)
    if not len(at) or not ((data == SLASH).any() or escaped):
        return at
    slash = data == SLASH
    run = np.arange(len(data)) - np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))  # length of the run that ends here
    first = int(np.argmax(~slash)) if (~slash).any() else len(data)
    run[:first] = np.arange(1, first + 1) + (1 if escaped else 0)
    before = np.where(at > 0, run[at - 1] * slash[at - 1], 1 if escaped else 0)
    return at[before % 2 == 0]


def _depths(data: np.ndarray, quotes: np.ndarray, in_text: bool) -> np.ndarray:
    """Change of depth at each byte: brackets outside of texts."""
    change = (np.isin(data, (91, 123)).astype(np.int8) - np.isin(data, (93, 125)).astype(np.int8)).astype(np.int32)
    inside = np.zeros(len(data), dtype=np.int32)
    inside[quotes] = 1
    return np.where((np.cumsum(inside) + in_text) % 2 == 1, 0, change)


def split_geojson(spark: SparkSession, files: list[str], box: tuple[float, float, float, float] | None = None, size: int = RANGE) -> DataFrame:
    """One row per feature of collections: crs (EPSG:4326 if none is named), id, geom, properties.

    files: places that executors can open (local paths or URIs). box (west, south, east, north):
    only features whose first vertex is in it are parsed any further. Features without geometry are
    dropped. A file of `size` bytes or less is one range.
    """
    ranges = []
    for path in files:
        with _open(path) as source:
            ranges += [(path, start, min(size, source.size() - start)) for start in range(0, max(1, source.size()), size)]
    parts = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "n int, path string, start long, size long").repartitionById(len(ranges), "n")

    def look(batches):
        for batch in batches:
            for n, path, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(path) as source:
                    data = _bytes(source, start, length)
                    quotes = _quotes(data, _escaped(source, start))
                    sums = [int(_depths(data, quotes, t).sum()) for t in (False, True)]
                    crs = _crs(data, quotes)
                yield pa.RecordBatch.from_pydict({"n": [n], "odd": [len(quotes) % 2 == 1], "out": [sums[0]], "in": [sums[1]], "crs": [crs]}, pa.schema([("n", pa.int32()), ("odd", pa.bool_()), ("out", pa.int64()), ("in", pa.int64()), ("crs", pa.string())]))

    seen = {r.n: r for r in parts.mapInArrow(look, "n int, odd boolean, out long, in long, crs string").collect()}  # a row for each range
    states, crs = [], {}
    for n, (path, start, _) in enumerate(ranges):
        text, depth = (False, 0) if start == 0 else (text, depth)
        states.append((n, text, depth))
        r = seen[n]
        depth += r["in"] if text else r["out"]
        text ^= r.odd
        if r.crs:
            crs.setdefault(path, r.crs)
    known = spark.createDataFrame(states, "n int, text boolean, depth long")
    names = {p: crs.get(p, "EPSG:4326") for p in files}

    def read(batches):
        for batch in batches:
            for _, path, start, length, text, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[list] = [[], [], [], []]
                for raw in _features(path, start, length, text, depth):
                    f = json.loads(raw)
                    if f.get("type") != "Feature" or (box and not _in_box(f.get("geometry"), box)):
                        continue
                    row = (names[path], None if f.get("id") is None else str(f["id"]), json.dumps(f.get("geometry")), json.dumps(f.get("properties") or {}))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    if len(out[0]) >= 5000:
                        yield _rows(out)
                        out = [[], [], [], []]
                yield _rows(out)

    raw = parts.join(known, "n").repartitionById(len(ranges), "n").mapInArrow(read, "crs string, id string, geometry string, properties string")
    return raw.select("crs", "id", from_geojson("geometry").alias("geom"), F.from_json("properties", "map<string,string>").alias("properties")).filter("geom.xs is not null")


def _rows(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["crs", "id", "geometry", "properties"])


def _crs(data: np.ndarray, quotes: np.ndarray) -> str | None:
    """The name in a `crs` member that lies in this range as a whole."""
    raw = data.tobytes()
    at = raw.find(b'"crs"')
    if at < 0 or at not in quotes:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(raw[at + 5 : at + 2000].decode("utf-8", "replace").lstrip(" \t\r\n:"))
        return value["properties"]["name"]
    except (ValueError, KeyError, TypeError):
        return None


def _in_box(geometry, box) -> bool:
    v = (geometry or {}).get("coordinates")
    while isinstance(v, list) and v and isinstance(v[0], list):
        v = v[0]
    return bool(v) and box[0] <= v[0] <= box[2] and box[1] <= v[1] <= box[3]


def _features(path: str, start: int, length: int, text: bool, depth: int):
    """Bytes of each object that begins in the range as an element of an array at depth 2, or of a
    lone feature at depth 0."""
    with _open(path) as source:
        data = _bytes(source, start, length)
        own, end = len(data), source.size()
        while True:
            quotes = _quotes(data, _escaped(source, start))
            change = _depths(data, quotes, text)
            after = depth + np.cumsum(change)
            opens = np.flatnonzero((change == 1) & (data == 123))
            opens = opens[opens < own]
            opens = opens[(after[opens] == 3) | (after[opens] == 1)]
            opens = np.array([i for i in opens if after[i] == 1 or _in_array(source, data, start, i)], dtype=np.int64)
            closes = np.flatnonzero(change == -1)
            if not len(opens):
                return
            need, at_end = after[opens[-1]] - 1, start + len(data) >= end
            if at_end or ((closes > opens[-1]) & (after[closes] == need)).any():
                break
            data = np.concatenate([data, _bytes(source, start + len(data), AHEAD)])
        raw = data.tobytes()
        by_depth = {d: closes[after[closes] == d] for d in (0, 2)}
        for i in opens:
            ends = by_depth[int(after[i]) - 1]
            j = int(np.searchsorted(ends, i))
            if j < len(ends):
                yield raw[i : ends[j] + 1]


def _in_array(source, data: np.ndarray, start: int, i: int) -> bool:
    """Whether an object follows a comma or an opening bracket, not a colon."""
    back = bytes(data[max(0, i - 256) : i]).rstrip(SPACE)
    if not back and start:
        back = bytes(_bytes(source, max(0, start - 256), min(256, start))).rstrip(SPACE)
    return back[-1:] in (b",", b"[")

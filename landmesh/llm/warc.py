"""Legacy ARC archives converted to WARC.

An ARC file is a version block and records one after another, each a header line, the declared
number of bytes and a line end; usually every record is a gzip member of its own. The version block
says which fields the header lines have: five in version 1, ten in version 2. The converter reads
each header line by its version's fields, takes exactly the declared length, and writes a WARC
record with what ARC doesn't have: an identifier made of the record's content and place, an ISO
timestamp, a record type, digests of block and payload. Records with an equal payload become
revisits of one of them, so that the payload is stored once.

Steps pass small rows (file, record's number, digest, key), never payloads, through shuffles.
Archives are read and written as streams; a task holds one record's block at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.llm.common import materialize, shared_dir, table

# Fields of header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of blocks in a file before the next one begins.
FILE_BYTES = 128 << 20
#: Most tasks over files; beyond, a task reads several.
MOST_TASKS = 20_000
#: Payloads below this are not worth a revisit.
MIN_REVISIT = 1000
#: Date of archive records whose own is unreadable, and of pages, which have none.
NO_DATE = "19700101000000"
KEY_FIELD = "X-Page-Id"
LEVEL = 1


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_stream(inner, compression=None)


def _create(folder: str, name: str):
    fs, inner = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    fs.create_dir(inner, recursive=True)
    return fs.open_output_stream(f"{inner}/{name}", compression=None)


def _plain(raw) -> io.BufferedReader:
    """The stream without gzip, whether or not it has it."""
    peek = io.BufferedReader(raw, 1 << 16)
    return io.BufferedReader(gzip.GzipFile(fileobj=peek), 1 << 16) if peek.peek(2)[:2] == b"\x1f\x8b" else peek


def _exactly(source, n: int, what: str) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError(f"{what}: {n} bytes are declared, {len(data)} are there")
    return data


def read_arc(raw, name: str = "archive") -> Iterator[ArcRecord]:
    """The records of an ARC file of version 1 or 2, gzipped or not, without the version block.

    A header line that its version doesn't know, or fewer bytes than declared, is an error that
    names the file. A URL may hold spaces: the other fields are taken from the line's end.
    """
    source = _plain(raw)
    fields: tuple[str, ...] = ()
    while True:
        line = source.readline()
        while line in (b"\n", b"\r\n"):
            line = source.readline()
        if not line:
            return
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        block = None
        if text.startswith("filedesc:"):  # a version block, also where files were joined
            length = text.rsplit(" ", 1)[-1]
            if not length.isdigit():
                raise ValueError(f"{name}: no length in the version block: {text!r}")
            block = _exactly(source, int(length), f"{name}: version block")
            version = block.split(b"\n", 1)[0].split(b" ")[0]
            if version in (b"1", b"2"):
                fields = ARC_FIELDS[int(version)]
                continue
            if not fields:
                raise ValueError(f"{name}: unknown archive version {version!r}")
        if not fields:
            raise ValueError(f"{name}: a record before the version block")
        parts = text.rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"{name}: not a header line of {len(fields)} fields: {text[:200]!r}")
        head = dict(zip(fields, parts, strict=True))
        if block is None:
            block = _exactly(source, int(head["Archive-length"]), f"{name}: {head['URL'][:200]}")
        yield ArcRecord(head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], block)


class Members:
    """Writes gzip members, one for each record."""

    def __init__(self, sink):
        self.sink, self.size = sink, 0

    def add(self, *pieces: bytes) -> None:
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for piece in pieces:
            self.sink.write(pack.compress(piece))
            self.size += len(piece)
        self.sink.write(pack.flush())


def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int, name: str = "-") -> bytes:
    """A record's header line."""
    more = ["200", "-", "-", "0", name] if version == 2 else []
    return (" ".join([url, ip, date, mime, *more, str(length)]) + "\n").encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 landmesh\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", NO_DATE, "text/plain", len(body), name) + body + b"\n"


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


class _Rolling:
    """Files of one task; each is named anew, so that a task that runs twice harms nothing."""

    def __init__(self, folder: str, kind: str, begin):
        self.folder, self.kind, self.begin = folder, kind, begin
        self.done: list[tuple[int, str, int]] = []
        self.name = self.members = self.sink = None
        self.n = 0

    def add(self, *pieces: bytes) -> None:
        if self.members is not None and self.members.size >= FILE_BYTES:
            self.close()
        if self.members is None:
            self.name = f"{self.kind}-{_task():06d}-{uuid.uuid4().hex}.{self.kind}.gz"
            self.sink = _create(self.folder, self.name)
            self.members = Members(self.sink)
            self.members.add(self.begin(self.name))
        self.members.add(*pieces)
        self.n += 1

    def close(self) -> None:
        if self.members is not None:
            self.sink.close()
            self.done.append((_task(), self.name, self.n))
            self.members, self.n = None, 0

    def manifest(self) -> pa.RecordBatch:
        self.close()
        part, file, n = (list(x) for x in zip(*self.done, strict=True)) if self.done else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(file, pa.string()), pa.array(n, pa.int64())], ["part", "file", "n_records"])


MANIFEST = "part int, file string, n_records long"
_SAFE = str.maketrans({c: f"%{ord(c):02X}" for c in " \t\n\r\x0b\x0c"})


def write_arc(pages: DataFrame, folder: str, version: int = 1) -> DataFrame:
    """Pack page_id, url and html as HTTP responses into ARC files; returns the manifest.

    Null html is an empty body, a null page_id has no field, a null url is "unknown:". White space
    in a url is written as percent codes. Repeated rows are repeated records.
    """

    def pack(batches):
        files = _Rolling(folder, "arc", lambda name: arc_version_block(version, name))
        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (html or "").encode()
                own = "" if key is None else f"{KEY_FIELD}: {key}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode()
                where = (url or "unknown:").translate(_SAFE)
                files.add(arc_header(version, where, "0.0.0.0", NO_DATE, "text/html", len(http) + len(body), files.name or "-"), http, body, b"\n")
        yield files.manifest()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return materialize(rows.mapInArrow(pack, MANIFEST), "arcs")


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """(status line and fields with the empty line, body) of a response; None for another block."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at, n) for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (at := block.find(mark)) >= 0]
    if not ends:
        return block, b""
    at, n = min(ends)
    return block[: at + n], block[at + n :]


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def as_key(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def timestamp(date: str) -> str:
    """ISO 8601 of 14, 12 or 8 digits; NO_DATE's for anything else."""
    digits = date if date.isdigit() and len(date) in (8, 12, 14) else NO_DATE
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(record: ArcRecord, name: str, number: int, digest: bytes) -> str:
    """The same for the same record of the same file, whichever task converts it."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{number} {record.date} {digest.hex()} {record.url}').urn}>"


def _sha1(digest: bytes) -> str:
    return f"sha1:{base64.b32encode(digest).decode()}"


def kind_of(record: ArcRecord) -> tuple[str, str, bytes, bytes]:
    """(WARC type, content type, HTTP head, payload) of a legacy record."""
    http = split_http(record.block)
    if http is not None:
        return "response", "application/http; msgtype=response", *http
    if record.url.startswith("dns:"):
        return "response", "text/dns", b"", record.block
    return "resource", record.mime if "/" in record.mime else "application/octet-stream", b"", record.block


def index(arcs: DataFrame, folder: str) -> DataFrame:
    """A row for each record: part, file, number (in its file), record_id, url, date, key, type, payload_bytes and digest (SHA-1)."""

    def scan(batches):
        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for number, record in enumerate(read_arc(_open(f"{folder}/{name}"), name)):
                    kind, _, head, payload = kind_of(record)
                    digest = hashlib.sha1(payload).digest()
                    rows.append((part, name, number, record_id(record, name, number, digest), record.url, timestamp(record.date), as_key(http_field(head, KEY_FIELD)), kind, len(payload), digest))
                    if len(rows) >= 5000:
                        yield _batch(rows, INDEX_SCHEMA)
                        rows = []
                yield _batch(rows, INDEX_SCHEMA)

    return by_part(arcs).mapInArrow(scan, "part int, file string, number long, record_id string, url string, date string, key long, type string, payload_bytes long, digest binary")


INDEX_SCHEMA = pa.schema([("part", pa.int32()), ("file", pa.string()), ("number", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("key", pa.int64()), ("type", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_part(files: DataFrame) -> DataFrame:
    """Files dealt by the number of the task that wrote them, MOST_TASKS partitions at most."""
    n = (files.agg(F.max("part")).first()[0] or 0) + 1
    parts = min(n, MOST_TASKS)
    return files.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int"))


def revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """part, file, number of the responses that revisit another, and that one's id, url and date.

    Of responses with equal payloads of at least min_bytes the one with the largest key stays (a
    null key is the smallest; of equal keys the first by file and number). A payload may be that of a third of all
    records: groups are aggregated before they are shuffled, and the join splits large partitions.
    """
    fine = records.filter(F.col("payload_bytes") >= min_bytes).filter("type = 'response'")
    order = F.struct(F.col("key").isNull().alias("none"), F.bitwise_not("key").alias("down"), "file", "number")
    kept = fine.groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), F.min_by(F.struct("record_id", "url", "date"), order).alias("of")).filter("n > 1")
    small = kept.select(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"), "of")
    return fine.join(small, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))).filter("record_id != of.record_id").select("part", "file", "number", F.col("of.record_id").alias("to_id"), F.col("of.url").alias("to_url"), F.col("of.date").alias("to_date"))


def warc_record(fields: list[tuple[str, str]], *block: bytes) -> tuple[bytes, ...]:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(sum(map(len, block))))])
    return (f"WARC/1.1\r\n{head}\r\n".encode(), *block, b"\r\n\r\n")


def warcinfo(name: str) -> bytes:
    made = f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", made), ("WARC-Date", timestamp(NO_DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return b"".join(warc_record(fields, b"software: landmesh\r\nformat: WARC File Format 1.1\r\n"))


def convert(arcs: DataFrame, folder: str, out: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Convert the ARC files of a manifest (part, file) in `folder` to WARC files in `out`; returns their manifest.

    A first pass lists the records, a second one writes them. Only files that the returned
    manifest names count. An empty manifest gives no file.
    """
    records = materialize(index(arcs, folder), "index")
    again = revisits(records, min_bytes)
    begin = arcs.select("part", "file", F.lit(-1).cast("long").alias("number"), *(F.lit(None).cast("string").alias(c) for c in ("to_id", "to_url", "to_date")))

    def write(batches):
        files = _Rolling(out, "warc", warcinfo)
        source, number, name = iter(()), 0, ""

        def copy(to: tuple | None) -> bool:
            """Write the next record of the open archive."""
            nonlocal number
            record = next(source, None)
            if record is None:
                return False
            kind, mime, head, payload = kind_of(record)
            digest = hashlib.sha1(payload).digest()
            fields = [("WARC-Type", "revisit" if to else kind), ("WARC-Record-ID", record_id(record, name, number, digest)), ("WARC-Date", timestamp(record.date)), ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip), ("Content-Type", mime), ("WARC-Payload-Digest", _sha1(digest))]
            if to:
                fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", to[0]), ("WARC-Refers-To-Target-URI", to[1]), ("WARC-Refers-To-Date", to[2]), ("X-Payload-Length", str(len(payload)))]
            block = (head,) if to else (head, payload)
            files.add(*warc_record([*fields, ("WARC-Block-Digest", _sha1(_digest(block)))], *block))
            number += 1
            return True

        for batch in batches:
            for _, file, at, *to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at < 0:
                    while copy(None):
                        pass
                    source, number, name = read_arc(_open(f"{folder}/{file}"), file), 0, file
                    continue
                while number < at:
                    copy(None)
                copy(tuple(to))
        while copy(None):
            pass
        yield files.manifest()

    todo = by_part(begin.unionByName(again)).sortWithinPartitions("part", "file", "number")
    return materialize(todo.mapInArrow(write, MANIFEST), "warcs")


def _digest(pieces: tuple[bytes, ...]) -> bytes:
    h = hashlib.sha1()
    for p in pieces:
        h.update(p)
    return h.digest()


def read_warc(raw, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file, gzipped or not."""
    source = _plain(raw)
    while True:
        line = source.readline()
        while line == b"\r\n":
            line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: not the start of a record: {line[:80]!r}")
        fields = {}
        while (line := source.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        yield fields, _exactly(source, int(fields["content-length"]), name)


READ_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])


def read(warcs: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the WARC files of a manifest, without warcinfo.

    payload_digest is bare lower-case hex; a payload that isn't what its digest says is an error.
    A revisit has the digest and length of the full payload, and null as payload.
    """

    def scan(batches):
        for batch in batches:
            for name in batch.column(1).to_pylist():
                rows: list[tuple] = []
                held = 0
                for f, block in read_warc(_open(f"{folder}/{name}"), name):
                    kind = f["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, body = split_http(block) or (b"", block)
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:"))
                    if kind == "revisit":
                        n = int(f["x-payload-length"])
                    elif hashlib.sha1(body).digest() != digest:
                        raise ValueError(f"{name}: the payload of {f['warc-record-id']} is not what its digest says")
                    else:
                        n = len(body)
                    content = body if payload and kind != "revisit" else None
                    rows.append((f["warc-record-id"], kind, f["warc-date"], f["warc-target-uri"], as_key(http_field(head, KEY_FIELD)), n, digest.hex(), f.get("warc-refers-to"), content))
                    held += 500 + (len(body) if content is not None else 0)
                    if held > 4 << 20:
                        yield _batch(rows, READ_SCHEMA)
                        rows, held = [], 0
                yield _batch(rows, READ_SCHEMA)

    return by_part(warcs).mapInArrow(scan, "record_id string, record_type string, date string, target_uri string, key long, payload_bytes long, payload_digest string, refers_to_id string, payload binary")


def with_referred_key(records: DataFrame) -> DataFrame:
    """records with refers_to: the key of the record that a revisit refers to, else null.

    Very many revisits may refer to one record: AQE splits their partition.
    """
    to = records.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    keys = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to")).join(to, "refers_to_id", "left_semi")
    first = records.filter("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return first.unionByName(records.filter("record_type = 'revisit'").join(keys, "refers_to_id", "left"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed as ARC, converted to WARC, and read back."""
    arcs, warcs = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    packed = write_arc(table(spark, sf_dir, "pages"), arcs)
    records = materialize(read(convert(packed, arcs, warcs), warcs, payload=False).drop("payload", "target_uri", "date"), "records")
    return with_referred_key(records).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""

"""Vector codes, centroid clusters and archives against brute force, with odd rows."""

import base64
import datetime
import gzip
import hashlib
import io
import math
import os
import random

import numpy as np
import pytest

from landmesh.llm import centroids, queries, vector_codes, warc
from landmesh.llm.common import shared_dir

VECTORS = "vec_id long, embedding array<double>, label int, code string, cluster string"


def vectors(width: int = 64) -> list[tuple]:
    """Ids that repeat, null ids and labels, copies, ties, wide components and rows that don't count."""
    rng = random.Random(5)
    near = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(6)]
    v = [[x + rng.gauss(0, 0.05) for x in rng.choice(near)] for _ in range(330)]
    v += [[0.25] * width, [-0.25] * width, [0.25] * width, [0.0] * width, v[3], v[3]]
    v += [[1e4 if i == 1 else -0.5 for i in range(width)], [-3e6] * 3 + [0.001] * (width - 3)]
    rows = [(i if i % 50 else -i, x, None if i % 3 == 0 else i % 4) for i, x in enumerate(v)]
    rows += [(7, v[9], 1), (None, v[8], None), (None, v[7], 2)]
    rows += [(900, None, 1), (901, v[0][:-1] + [None], 1), (902, v[0][:-1] + [math.nan], 1), (903, v[0][:-1] + [math.inf], 1), (904, [-math.inf] * width, 1), (905, [], 1), (906, v[0][:-1], 1)]
    return [(*r, "clash", "clash") for r in rows]


def counted(width: int = 64):
    return [r for r in vectors(width) if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def last(i):
    return (i is None, i or 0)


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(x, points):
    return min((gap(x, p), i) for i, p in enumerate(points))


def moved(points, members):
    return [[sum(c) // len(m) for c in zip(*m, strict=True)] if (m := members.get(i)) else p for i, p in enumerate(points)]


def grouped(rows, points):
    out: dict[int, list] = {}
    for x in rows:
        out.setdefault(closest(x, points)[1], []).append(x)
    return out


def joined(v) -> str:
    return ",".join(map(str, v))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(vectors(), VECTORS).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(pages(), "page_id long, url string, html string, record_type string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    return folder


def test_vector_codes_query(spark, tables):
    rows = sorted(counted(), key=lambda r: (last(r[0]), r[1]))
    whole = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    parts = [[x[p * 16 : p * 16 + 16] for x in whole] for p in range(4)]
    books = [p[:256] for p in parts]
    for _ in range(4):
        books = [moved(b, grouped(p, b)) for b, p in zip(books, parts, strict=True)]
    codes, errors, of_label = [], [], {}
    for k, r in enumerate(rows):
        best = [closest(p[k], b) for p, b in zip(parts, books, strict=True)]
        codes.append("".join(f"{i:02x}" for _, i in best))
        errors.append(sum(d for d, _ in best))
        of_label[r[2]] = of_label.get(r[2], 0) + errors[-1]
    digest = sha256(joined(x for b in books for e in b for x in e))
    got = queries.QUERIES["op12_vector_codes"](spark, tables).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    same(got, [(r[0], c, e, of_label[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True)])


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = spark.createDataFrame(vectors(8), VECTORS)
    books = vector_codes.train(rows, width=8, parts=2, size=10, rounds=2)
    out = vector_codes.encode(rows, books, carry=("embedding", "vec_id"))
    assert out.count() == len(counted(8))
    for r in vector_codes.decode(out, books).collect():
        assert gap([math.floor(1024 * x) for x in r.carry.embedding], r.decoded) == r.error


def test_clusters_query(spark, tables):
    rows = counted()
    whole = [[math.floor(256 * x) for x in r[1]] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, sha256(f"2:{rows[i][0]}"), rows[i][1]))
    points = [whole[i] for i in order[:40]]
    for _ in range(5):
        points = moved(points, grouped(whole, points))
    placed = [closest(x, points) for x in whole]
    inertia: dict[int, int] = {}
    for d, i in placed:
        inertia[i] = inertia.get(i, 0) + d
    want = [(r[0], i, d, inertia[i], sum(inertia.values()), sha256(joined(points[i]))) for r, (d, i) in zip(rows, placed, strict=True)]
    same(queries.QUERIES["op13_clusters"](spark, tables).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect(), want)


def test_empty_tables_of_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 1, "", ""), (2, [math.nan] * 64, 1, "", "")], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op11_warc", "op12_vector_codes", "op13_clusters"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_searches_with_ties_and_narrow_steps(monkeypatch):
    """Small whole numbers give very many ties; the steps don't change the result."""
    rng = np.random.default_rng(1)
    for width, n in ((1, 3), (4, 40), (16, 256)):
        x, book = rng.integers(-3, 4, (500, width)).astype(float), rng.integers(-3, 4, (n, width)).astype(float)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        for step, block in ((1, 3), (32, 256)):
            monkeypatch.setattr(vector_codes, "STEP", step)
            monkeypatch.setattr(vector_codes, "BLOCK", block)
            monkeypatch.setattr(centroids, "BLOCK", block * 7)
            for search in (vector_codes.nearest, centroids.nearest):
                index, best = search(x, book)
                assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_searches_leave_most_entries_out(monkeypatch):
    """Far from each other, entries are told apart by their sums and lists alone."""
    book = np.arange(0, 2560, 10, dtype=float)[:, None] * np.ones(8)
    x = book[np.random.default_rng(2).integers(0, 256, 300)] + 1
    seen = []
    monkeypatch.setattr(vector_codes, "STEP", 1)
    monkeypatch.setattr(vector_codes, "BLOCK", 1)
    monkeypatch.setattr(vector_codes.np, "sort", lambda a, f=np.sort: seen.append(len(a)) or f(a))
    index, _ = vector_codes.nearest(x, book)
    assert (index == ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) <= 4 * len(x)


# Archives


def pages() -> list[tuple]:
    big = "<p>" + "é" * 700 + "</p>"  # over 1000 bytes of UTF-8, under 1000 characters
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (None, "http://a/n", big), (5, "http://a/5b", big)]
    rows += [(2, "http://b/ 2\n x", "short"), (4, "", "short"), (6, "http://b/6", None), (7, "http://b/7", ""), (None, None, None)]
    rows += [(8, "http://c", "HTTP/1.1 200 OK\r\n\r\n" + big), (9, "http://c", "\n\n\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 990), (10, "http://d", "x" * 300_000), (11, "http://d", "x" * 300_000), (12, "filedesc://x 1 2 3", "y" * 1000), (13, "u", "y" * 1000), (14, "u", "z" * 999), (15, "u", "z" * 999)]
    return [(*r, "clash") for r in rows]


def test_archive_query(spark, tables):
    got = queries.QUERIES["op11_warc"](spark, tables).collect()
    data = [(r[0], (r[2] or "").encode()) for r in pages()]
    same([(r.page_id, r.payload_bytes, r.payload_digest) for r in got], [(i, len(d), hashlib.sha1(d).hexdigest()) for i, d in data])
    groups: dict[str, list] = {}
    for r in got:
        groups.setdefault(r.payload_digest, []).append(r)
    for digest, of in groups.items():
        ids = [i for i, d in data if hashlib.sha1(d).hexdigest() == digest]
        kept = [r for r in of if r.record_type == "response"]
        if of[0].payload_bytes < 1000:
            assert len(kept) == len(ids) and all(r.refers_to is None for r in of)
        else:
            top = max(ids, key=lambda i: (i is not None, i or 0))
            assert [r.page_id for r in kept] == [top]
            assert all(r.refers_to == top for r in of if r.record_type == "revisit")
            assert all(r.refers_to is None for r in kept)


@pytest.mark.parametrize("version", [1, 2])
def test_archives_hold_what_was_put_in(spark, version, monkeypatch):
    """Whole payloads come back, through files of few records, whatever the archive's version."""
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    arcs, warcs = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    rows = spark.createDataFrame(pages(), "page_id long, url string, html string, record_type string")
    made = warc.convert(warc.write_arc(rows, arcs, version), arcs, warcs)
    back = {}
    for r in warc.read(made, warcs).collect():
        assert r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest
        assert r.date == "1970-01-01T00:00:00Z"
        back[r.record_id] = r
    assert len(back) == len(pages())
    for r in back.values():
        if r.record_type == "revisit":
            assert len(back[r.refers_to_id].payload) == r.payload_bytes
    texts = sorted((r.payload or back[r.refers_to_id].payload if r.refers_to_id else r.payload) for r in back.values())
    assert texts == sorted((p[2] or "").encode() for p in pages())


def legacy(version: int, records: list[bytes]) -> bytes:
    said = warc.ARC_FIELDS[version]
    body = f"{version} 0 Some Archive\n{' '.join(said)}\n".encode()
    more = "200 - - 0 x.arc " if version == 2 else ""
    return f"filedesc://x.arc 0.0.0.0 19970301120000 text/plain {more}{len(body)}\n".encode() + body + b"\n" + b"".join(records)


def test_legacy_records_of_both_versions(tmp_path, spark):
    http = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>old</p>"
    one = legacy(1, [b"http://h/a b 1.2.3.4 19970301123456 text/html %d\n%s\n" % (len(http), http), b"dns:h 1.2.3.4 19970301 text/dns 5\n1.2.3\n", b"ftp://h/f 1.2.3.4 soon text/plain 3\nraw\n"])
    two = legacy(2, [b"http://h/2 1.2.3.4 199703011234 text/html 200 abc - 9 x.arc %d\n%s\n" % (len(http), http)])
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/one.arc").write_bytes(one)
    (tmp_path / "in/two.arc.gz").write_bytes(gzip.compress(two[: two.index(b"\nhttp://h/2") + 1]) + gzip.compress(two[two.index(b"\nhttp://h/2") + 1 :]))
    found = [r for name in ("one.arc", "two.arc.gz") for r in warc.read_arc(io.BytesIO((tmp_path / "in" / name).read_bytes()), name)]
    assert [(r.url, r.ip, r.mime, r.block) for r in found] == [("http://h/a b", "1.2.3.4", "text/html", http), ("dns:h", "1.2.3.4", "text/dns", b"1.2.3"), ("ftp://h/f", "1.2.3.4", "text/plain", b"raw"), ("http://h/2", "1.2.3.4", "text/html", http)]
    files = spark.createDataFrame([(0, "one.arc", 3), (1, "two.arc.gz", 1)], warc.MANIFEST)
    out = shared_dir(spark, "warc")
    made = warc.convert(files, str(tmp_path / "in"), out, min_bytes=5)
    rows = {r.target_uri: r for r in warc.read(made, out).collect()}
    assert {u: (r.record_type, r.date) for u, r in rows.items()} == {
        "http://h/a b": ("response", "1997-03-01T12:34:56Z"), "dns:h": ("response", "1997-03-01T00:00:00Z"),
        "ftp://h/f": ("resource", "1970-01-01T00:00:00Z"), "http://h/2": ("revisit", "1997-03-01T12:34:00Z")}
    out = shared_dir(spark, "warc")
    again = {r.record_id for r in warc.read(warc.convert(files, str(tmp_path / "in"), out, 5), out, False).collect()}
    assert again == {r.record_id for r in rows.values()} and len(again) == 4 and all(i.startswith("<urn:uuid:") for i in again)
    assert rows["http://h/2"].refers_to_id == rows["http://h/a b"].record_id


def test_written_records_are_standard(spark, tables):
    """Fields of a file's records, read without the operator's own reader."""
    arcs, warcs = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    made = warc.convert(warc.write_arc(spark.read.parquet(f"{tables}/pages.parquet"), arcs), arcs, warcs).collect()
    n = 0
    for row in made:
        data = gzip.decompress(open(f"{warcs.removeprefix('file://')}/{row.file}", "rb").read())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            block, data = rest[:size], rest[size + 4 :]
            assert rest[size : size + 4] == b"\r\n\r\n"
            datetime.datetime.strptime(fields[b"WARC-Date"].decode(), "%Y-%m-%dT%H:%M:%SZ")
            if fields[b"WARC-Type"] == b"warcinfo":
                continue
            n += 1
            assert base64.b32decode(fields[b"WARC-Block-Digest"][5:]) == hashlib.sha1(block).digest()
            assert (fields[b"WARC-Type"] == b"revisit") == (b"WARC-Refers-To" in fields) == (b"WARC-Profile" in fields)
    assert n == len(pages())


@pytest.mark.parametrize("damage", [lambda d: d[:-3], lambda d: d.replace(b"1 0 Some", b"7 0 Some"), lambda d: d.replace(b"text/html ", b"text/html x"), lambda d: d[d.index(b"http://h") :]])
def test_damaged_archives_are_errors(damage):
    data = legacy(1, [b"http://h/1 1.2.3.4 19970301123456 text/html 10\n0123456789"])
    assert [r.block for r in warc.read_arc(io.BytesIO(data))] == [b"0123456789"]
    with pytest.raises(ValueError, match="here"):
        list(warc.read_arc(io.BytesIO(damage(data)), "here"))

"""Token ids in sorted-string-table shards, keyed by document.

A shard holds the documents of one range of ids in ascending order:

    blocks | block index | Bloom filter | footer

A block is a run of entries (varint shared key bytes, varint other key bytes, varint value
length, other key bytes, value); its first entry shares nothing. A key is the id as 8 big-endian
bytes with the sign bit flipped, so that bytes sort as the numbers; a null id is the empty key. A
value is the ids, little-endian, 2 bytes each if the vocabulary allows it, else 4. The index has
each block's last key, offset and size. The footer, of fixed size, says where index and filter
are, how many documents and ids there are, the ids' width, a checksum and a magic number.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmesh.llm.bpe import vocabulary_path
from landmesh.llm.common import number, shared_dir, table, text_runs

MAGIC = b"LMTOKEN1"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK = 64 << 10
#: Ids (with their texts' lengths unknown) of one shard, as bytes of text that it should hold.
SHARD_BYTES = 32 << 20
#: Most shards of a store; beyond, shards are larger. Their bounds and last keys pass the driver.
MOST_SHARDS = 20_000
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Chunks of text whose ids a worker keeps.
CACHE = 400_000
#: Bytes of text encoded together.
RUN = 4 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, size: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % size for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries in ascending key order."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.at = self.docs = self.tokens = self.crc = 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.first_key: bytes | None = None

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        if self.first_key is None:
            self.first_key = key
        elif key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block)))
            self._put(bytes(self.block))
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index))
        bloom_at = self.at
        size = max(64, BLOOM_BITS * len(self.keys))
        bits = np.zeros(-(-size // 8), dtype=np.uint8)
        for key in self.keys:
            for bit in _bloom_bits(key, size):
                bits[bit >> 3] |= 1 << (bit & 7)
        self._put(bits.tobytes())
        self.sink.write(FOOTER.pack(index_at, bloom_at, self.at, size, self.docs, self.tokens, self.width, self.crc, MAGIC))


class Shard:
    """Reads a shard through a file object with seek."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - FOOTER.size)
        index_at, bloom_at, after, self.bloom_size, self.docs, self.tokens, self.width, self.crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC or after != end - FOOTER.size:
            raise ValueError("not a token shard")
        source.seek(index_at)
        tail = source.read(after - index_at)
        raw, self.bloom = tail[: bloom_at - index_at], tail[bloom_at - index_at :]
        self.last_keys, self.blocks = [], []
        at = 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            self.last_keys.append(key)
            self.blocks.append((offset, size))

    def _entries(self, block: int):
        offset, size = self.blocks[block]
        self.source.seek(offset)
        data, at, key = self.source.read(size), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + n]
            at += n

    def __iter__(self):
        """(doc_id, ids) in ascending order."""
        for block in range(len(self.blocks)):
            for key, value in self._entries(block):
                yield id_of(key), np.frombuffer(value, dtype=f"<u{self.width}")

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[bit >> 3] >> (bit & 7) & 1 for bit in _bloom_bits(key_of(doc_id), self.bloom_size))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of the documents with that key: filter, then index, then one block or more."""
        found: list[np.ndarray] = []
        if not self.may_have(doc_id):
            return found
        key = key_of(doc_id)
        for block in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            for k, value in self._entries(block):
                if k > key:
                    return found
                if k == key:
                    found.append(np.frombuffer(value, dtype=f"<u{self.width}"))
        return found


def open_shard(path: str) -> Shard:
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return Shard(fs.open_input_file(inner))


class Encoder:
    """The tokenizers library's encoder with the packed ids of chunks met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = 2 if self.kind == "H" else 4
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = special[0] if special else None
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int) -> pa.Array:
        """Packed ids of each text with end_id after them; null counts as empty.

        No token of this vocabulary holds white space, so that what stands between it can be
        encoded by itself; each distinct one goes to the library once, the rest is gathering.
        """
        if len(self.known) > CACHE:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [c for c in chunks if c not in known]
        again = [c for c in new if c in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        if again:
            new = [c for c in new if c not in older]
        known.update(zip(new, self._encode_chunks(new), strict=True))
        values = [*map(known.__getitem__, chunks), array(self.kind, [end_id]).tobytes()]
        for chunk in new:
            if len(chunk) > 64:
                del known[chunk]
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(values), dtype=f"<u{self.width}")
        # The end stands after each text's chunks as one chunk more.
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.insert(coded.indices.to_numpy(), ends, len(chunks))
        n = size[at]
        total = np.cumsum(n)
        take = np.repeat(first[at] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        offsets[1:] = total[ends + np.arange(len(ends))] * self.width
        out = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(pool[take])])
        return out.cast(pa.binary())

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """One call for all, with a special token between them that tells their ids apart."""
        mark = self.mark
        if mark is None or any(mark in c for c in chunks):
            return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(chunks)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        data, width = ids.tobytes(), self.width
        cut = np.flatnonzero(ids == self.tokenizer.token_to_id(mark)) * width
        return [data[a:b] for a, b in zip([0, *(cut + width).tolist()], [*cut.tolist(), len(data)], strict=True)] if chunks else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _placed(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, place (where it sorts; null first), salt and more columns."""
    doc_id = F.col("doc_id").cast("long")
    salt = F.xxhash64(F.monotonically_increasing_id())
    return documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("place"), salt.alias("salt"), *more)


def shard_bounds(documents: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest (id, salt) of each shard but the last, at most MOST_SHARDS; only ids are read.

    The salt spreads rows of one id over shards that follow each other; any value will do.
    """
    ids = _placed(documents).select("place", "salt").repartitionByRange(min(shards, MOST_SHARDS), "place", "salt")
    tops = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("place", "salt")).alias("top")).orderBy("top").collect()
    return np.array([r.top.place for r in tops][:-1], dtype=np.int64), np.array([r.top.salt for r in tops][:-1], dtype=np.int64)


def shard_of(bounds: tuple[np.ndarray, np.ndarray], place: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The shard of each (id, salt): how many bounds are smaller."""
    tops, salts = bounds
    at, end = np.searchsorted(tops, place, side="left"), np.searchsorted(tops, place, side="right")
    for x in np.unique(place[at < end]):  # ids that several shards have, or that a shard ends with
        i = place == x
        a, b = at[i][0], end[i][0]
        at[i] = a + np.searchsorted(salts[a:b], salt[i], side="left")
    return at


def write(documents: DataFrame, folder: str, path: str | None = None, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode documents (doc_id, text) and write shards to `folder`; returns the manifest.

    Null text counts as empty and becomes end_id alone. Documents of equal or null id are all
    kept, in any order among themselves (null first); an empty table gives no shards. Only files that the manifest names count: a task that runs twice writes another file.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = shard_bounds(documents, max(1, -(-total // shard_bytes)))
    width = encoder(path).width

    def encode(batches):
        for batch, _, _ in text_runs(batches, most=RUN):
            at = shard_of(bounds, number(batch, "place"), number(batch, "salt"))
            values = encoder(path).encode(batch.column(3), end_id)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), values], ["shard", "doc_id", "ids"])

    def store(batches):
        fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        now = sink = writer = name = None
        done: dict[str, list] = {k: [] for k in ("shard", "file", "n_docs", "n_tokens")}

        def finish():
            if writer is not None:
                writer.finish()
                sink.close()
                for k, v in zip(done, (now, name, writer.docs, writer.tokens), strict=True):
                    done[k].append(v)

        for batch in batches:
            for shard, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    finish()
                    now, name = shard, f"shard-{shard:08d}-{uuid.uuid4().hex}.tokens"
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = ShardWriter(sink, width)
                writer.add(doc_id, ids)
        finish()
        yield pa.RecordBatch.from_pydict(done, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    coded = _placed(documents, "text").mapInArrow(encode, "shard int, doc_id long, ids binary")
    coded.repartitionById(len(bounds[0]) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id")).mapInArrow(
        store, "shard int, file string, n_docs long, n_tokens long"
    ).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """All documents of the shards: doc_id, start (ids before it in ascending order), ids as
    little-endian unsigned 32-bit integers."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("base"))

    def scan(batches):
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out: tuple[list, list, list] = ([], [], [])
                size = 0
                for doc_id, ids in open_shard(f"{folder}/{name}"):
                    for column, v in zip(out, (doc_id, base, ids.astype("<u4").tobytes()), strict=True):
                        column.append(v)
                    base += len(ids)
                    size += len(ids)
                    if size > 1 << 20:
                        yield _rows(out)
                        out, size = ([], [], []), 0
                yield _rows(out)

    n = (manifest.agg(F.max("shard")).first()[0] or 0) + 1
    return files.repartitionById(n, "shard").mapInArrow(scan, "doc_id long, start long, ids binary")


def _rows(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["doc_id", "start", "ids"])


def lookup(keys: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """The ids of the documents in `keys` (doc_id), by filter, index and block, not by scans.

    One row for each document of a key, also where keys repeat; null and unknown keys give none.
    The shards' last keys, at most MOST_SHARDS, go to all tasks.
    """
    files = manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays(
                [pa.array([f]), pa.array([id_of(s.last_keys[-1])], pa.int64())], ["file", "last"]
            )
            for b in batches
            for f in b.column(0).to_pylist()
            for s in [open_shard(f"{folder}/{f}")]
        ),
        "file string, last long",
    )
    tops = sorted((r.last if r.last is not None else -(1 << 63), r.file) for r in files.collect())
    lasts, names = np.array([t for t, _ in tops]), [f for _, f in tops]

    def find(batches):
        opened: dict[str, Shard] = {}
        for batch in batches:
            ids = sorted(x for x in batch.column(0).to_pylist() if x is not None)
            rows: tuple[list, list] = ([], [])
            for doc_id in ids:
                at = int(np.searchsorted(lasts, doc_id, side="left"))
                while at < len(names):
                    shard = opened.get(names[at]) or opened.setdefault(names[at], open_shard(f"{folder}/{names[at]}"))
                    for value in shard.get(doc_id):
                        rows[0].append(doc_id)
                        rows[1].append(value.astype("<u4").tobytes())
                    if lasts[at] != doc_id:  # else the next shard may go on with it
                        break
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["doc_id", "ids"])

    return keys.select(F.col("doc_id").cast("long")).mapInArrow(find, "doc_id long, ids binary")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    manifest = write(table(spark, sf_dir, "documents"), folder)
    return read(manifest, folder).select("doc_id", "start", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

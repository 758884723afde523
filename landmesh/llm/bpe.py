"""BPE encoding and decoding of a public byte-level vocabulary.

Encoding is the backtracking encoder: the longest token at a position is tried first; it may
follow the previous token only if no merge across their border would come before the merges
inside them (the pair-compatibility test), else shorter prefixes are tried, else the previous
token is taken back. A position that failed once is never tried again, so the work is linear
and the ids are those of the merge procedure. Longest tokens come from an Aho-Corasick automaton.
Decoding gathers bytes through an offset table.

Pieces (the pre-tokenizer's words) are encoded once per worker and reused.
"""

from __future__ import annotations

import json
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from landmesh.llm.common import table

#: The pre-tokenizer's pattern of the byte-level vocabulary (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks and pieces held by a worker; beyond, those not used again go.
CACHE = 120_000
#: Rows that a worker takes at a time.
ROWS = 128
#: White space other than single spaces and line ends (fixed values).
_UNUSUAL_SPACE = ["  ", "\n\n", " \n", "\n ", *map(chr, [9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one vocabulary file (tokenizers' JSON, byte-level BPE without word ends)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        #: The pair that a token was merged from; a single byte is its own.
        self.split = [(i, i) for i in range(size)]
        self.pair: dict[tuple[int, int], int] = {}
        #: When a token is merged; bytes come before all merges.
        self.rank = [-1] * size
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            if self.rank[both] < 0:
                self.split[both], self.rank[both] = (left, right), rank
            self.pair.setdefault((left, right), rank)
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = to_bytes(token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.offset = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(t) for t in token_bytes], out=self.offset[1:])
        self.bytes = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.length = [len(t) for t in token_bytes]
        self.machine = ahocorasick.Automaton()
        self.id_of: dict[bytes, int] = {}
        for i in sorted(vocab.values(), key=lambda i: self.rank[i]):
            if self._reachable(i):
                self.id_of[token_bytes[i]] = i
                self.machine.add_word(token_bytes[i].decode("latin-1"), (len(token_bytes[i]) - 1, i))
        self.machine.make_automaton()
        #: Longest token that is a proper prefix of the token, or -1.
        self.shorter = [-1] * size
        for token, i in self.id_of.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := self.id_of.get(token[:n])) is not None:
                    self.shorter[i] = j
                    break
        specials = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(f"({regex.escape(s)})" for s in specials)) if specials else None
        self.pieces = regex.compile(PIECES)
        self.cache = Pieces(self)
        self.spaced = Chunks(self)
        #: Pairs of tokens that were tested before.
        self.tested: dict[int, bool] = {}

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's bytes gives this token again."""
        left, right = self.split[token]
        if left == token:
            return True
        ready = self.length[left] == 1 or self._known(left)
        return ready and (self.length[right] == 1 or self._known(right)) and self.compatible(left, right, self.rank[token])

    def _known(self, token: int) -> bool:
        a, b = int(self.offset[token]), int(self.offset[token + 1])
        return self.id_of.get(self.bytes[a:b].tobytes()) == token

    def compatible(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether the two tokens stay side by side: no merge over their border comes first.

        From the border outwards the tokens are taken apart in reverse order of their merges; a
        merge over the border that ranks before the merge just undone would have happened.
        """
        rank, split, pair = self.rank, self.split, self.pair
        while True:
            over = pair.get((left, right))
            if over is not None and over < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # Of equal merges the left one is made first, so the right one is undone first.
            if a > b:
                limit, left = a, split[left][1]
            else:
                limit, right = b + 1, split[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * (n + 1)
        length = self.length
        for end, (before, token) in self.machine.iter(piece.decode("latin-1")):
            longest[end - before] = token  # ends rise, so that the longest comes last
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        tested, shorter = self.tested, self.shorter
        last = -1
        while at < n:
            end = at + length[token]
            if open_[end]:
                fits = last < 0
                if not fits:
                    pair = last << 32 | token
                    fits = tested.get(pair)
                    if fits is None:
                        fits = tested[pair] = self.compatible(last, token)
                if fits:
                    out.append(token)
                    last, at, token = token, end, longest[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:  # no token fits here: take back the last one and try a shorter one there
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]
                while token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= length[token]
                    last = out[-1] if out else -1
                    token = shorter[token]
        return out

    def encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.pieces.findall(text)))

    def encode_ordinary(self, text: str) -> bytes:
        """The ids of a text without special tokens.

        A piece holds a space only at its start, so that a text whose white space is single
        spaces and line ends is the sequence of its chunks, each with the space before it.
        """
        if any(space in text for space in _UNUSUAL_SPACE):
            return b"".join(map(self.cache.__getitem__, self.pieces.findall(text)))
        out: list[bytes] = []
        for line in text.split("\n"):
            chunks = line.split(" ")
            out.append(self.encode_pieces(chunks[0]))
            out += map(self.spaced.__getitem__, chunks[1:])
            out.append(self.cache["\n"])
        return b"".join(out[:-1])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        self.cache.renew()
        self.spaced.renew()
        if len(self.tested) > CACHE:
            self.tested.clear()
        if not any(s in text for s in self.special):
            return self.encode_ordinary(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self.encode_ordinary(text[at : m.start()]), np.uint32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_ordinary(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after the other."""
        length = self.offset[ids + 1] - self.offset[ids]
        end = np.cumsum(length)
        at = np.repeat(self.offset[ids] - (end - length), length)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


class Pieces(dict):
    """The packed ids of pieces met so far."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.older = bpe, {}

    def make(self, key: str) -> bytes:
        ids = self.bpe.encode_piece(key.encode())
        return pack(f"<{len(ids)}I", *ids)

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= 64:
            self[key] = ids
        return ids

    def renew(self) -> None:
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()


class Chunks(Pieces):
    """The packed ids of what stands between spaces, with a space before it."""

    def make(self, key: str) -> bytes:
        return self.bpe.encode_pieces(" " + key)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _mapped(df: DataFrame, source: str, path: str | None, added: dict[str, DataType], make) -> DataFrame:
    """df with the columns that make(bpe, values of source) gives; columns of those names go."""
    path = path or vocabulary_path()
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = StructType([*kept, *(StructField(k, v) for k, v in added.items())])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                new = make(bpe, part.column(part.schema.get_field_index(source)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), *new], schema.names)

    return df.mapInArrow(run, schema)


def _ids(bpe: Bpe, texts) -> list[bytes]:
    return [bpe.encode(t) for t in texts]


def _texts(bpe: Bpe, packed) -> list[str]:
    return [bpe.decode(np.frombuffer(x or b"", dtype="<u4").astype(np.int64)).decode("utf-8", "replace") for x in packed]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with a binary column of token ids, little-endian unsigned 32-bit; null text: no ids.

    Strings of special tokens in a text get the special ids, as the tokenizers library does it.
    An existing column of that name is replaced.
    """
    return _mapped(df, text, path, {ids: BinaryType()}, lambda bpe, texts: [pa.array(_ids(bpe, texts), pa.binary())])


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of a column of ids as `encode` makes it; bytes that are no UTF-8 become U+FFFD."""
    return _mapped(df, ids, path, {text: StringType()}, lambda bpe, packed: [pa.array(_texts(bpe, packed), pa.string())])


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """Both of `encode` and `decode` with one pass through Python workers.

    Null counts as empty and gives no ids and an empty text. Every row stays, also of equal ones;
    columns named `ids` and `decoded` are replaced. An empty table gives no rows.
    """

    def make(bpe: Bpe, texts):
        packed = _ids(bpe, texts)
        return [pa.array(packed, pa.binary()), pa.array(_texts(bpe, packed), pa.string())]

    return _mapped(df, text, path, {ids: BinaryType(), decoded: StringType()}, make)


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of tokens and digests of the ids and of the decoded text.

    A row for each row, also of null or repeated id; a null text counts as empty. An empty table
    gives no rows.
    """
    return round_trip(documents.select("doc_id", "text"), path=path).select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

"""Benchmark decontamination: an Aho-Corasick automaton over the items' word windows.

Texts are normalised by lower-casing A-Z and keeping words of digits, letters and non-ASCII
characters. Every word of the benchmark's vocabulary is one symbol, every other word of a
document one more symbol that no pattern contains; the automaton holds the items' windows as
strings of symbols, reads each document once, and word numbers map hits back to offsets of the
original text.

A benchmark of up to BLOCK_BYTES is one automaton, broadcast after its size is known. A larger one
is dealt in blocks by hash, one automaton each: a written pass over the documents for each block,
so that driver and tasks hold one block at a time.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from landmesh.llm.common import materialize, table

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes about 70 times as much memory.
BLOCK_BYTES = 4 << 20

#: Bytes that belong to words after lower-casing: digits, letters, and all of non-ASCII characters.
_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO_SPACE = bytes(b if b in _KEEP else 32 for b in _LOWER)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[list(_KEEP)] = True
_IS_WORD[65:91] = True

ADDED = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
]


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_SPACE).split()


def _symbol(i: int) -> str:
    """The i-th code point outside the surrogates; 0 is kept for unknown words."""
    i += 1
    return chr(i if i < 0xD800 else i + 0x800)


class Windows:
    """The automaton over all windows of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, str] = {}
        found: dict[str, set[str | None]] = {}
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            for w in words:
                self.symbol.setdefault(w, _symbol(len(self.symbol)))
            coded = "".join(self.symbol[w] for w in words)
            for i in range(max(1, len(coded) - window + 1)):
                found.setdefault(coded[i : i + window], set()).add(item_id)
        self.machine = ahocorasick.Automaton()
        for pattern, ids in found.items():
            self.machine.add_word(pattern, (len(pattern), tuple(ids)))
        if found:
            self.machine.make_automaton()
        self.any = bool(found)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str | None]]:
        """Number of words; which of them are hit; items whose windows occur."""
        words = normal_words(text)
        hit = np.zeros(0, dtype=bool)
        items: set[str | None] = set()
        if self.any and words:
            symbol = self.symbol
            for end, (length, ids) in self.machine.iter("".join([symbol.get(w, "\0") for w in words])):
                if not len(hit):
                    hit = np.zeros(len(words), dtype=bool)
                hit[end - length + 1 : end + 1] = True
                items.update(ids)
        return len(words), hit, items


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets of the words of the original text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    word = np.concatenate([[False], _IS_WORD[data], [False]])
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars[start], chars[end]


def _item_order(item: str | None):
    return item is None, item or ""


_BUILT: dict[int, Windows] = {}


def _scan_batches(shared, text_col: str, window: int, before: bool):
    """before: the batches have spans and items of earlier blocks, which the new ones join."""

    def run(batches):
        key = hash(tuple(shared.value))
        machine = _BUILT.get(key)
        if machine is None:
            _BUILT.clear()
            machine = _BUILT[key] = Windows(shared.value, window)
        names = [f.name for f in ADDED]
        for batch in batches:
            earlier = [batch.column(batch.schema.get_field_index(c)).to_pylist() if before else [[]] * batch.num_rows for c in ("items", "spans")]
            made: list[list] = [[], [], [], []]
            for text, items, spans in zip(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), *earlier, strict=True):
                n, hit, found = machine.scan(text)
                if spans or hit.any():
                    start, end = word_offsets(text)
                    if spans:
                        hit = hit if len(hit) else np.zeros(n, dtype=bool)
                        for s in spans:
                            hit[np.searchsorted(start, s["start"]) : np.searchsorted(start, s["end"])] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    spans = [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                for column, v in zip(made, (n, int(hit.sum()), sorted({*items, *found}, key=_item_order), spans), strict=True):
                    column.append(v)
            keep = [i for i, f in enumerate(batch.schema) if f.name not in names]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], [*(batch.schema.field(i).name for i in keep), *names])

    return run


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with n_words, n_hit, items and spans (character offsets of the hit words).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is
    one window. Null or empty text has no words and no hits; items without words match nothing.
    Items are named by their id as text, equal ones all, each id once; items of null id hit as
    any other and stand last, as one null. Every row of documents stays, columns of the four
    names are replaced. An empty table gives no rows, an empty benchmark no hits.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = documents
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        block = [(r.item, r.text) for r in mine.collect()]
        out = _with_block(materialize(out, "blocks") if k else out, block, window, text, k > 0)
    return out


def _with_block(documents: DataFrame, block, window: int, text: str, before: bool) -> DataFrame:
    names = [f.name for f in ADDED]
    schema = StructType([*(f for f in documents.schema.fields if f.name not in names), *ADDED])
    shared = documents.sparkSession.sparkContext.broadcast(block)
    return documents.mapInArrow(_scan_batches(shared, text, window, before), schema)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with their own columns, whatever they are called.

    Null and empty texts have no hits and stay, as do rows of null or repeated id.
    """
    rows = documents.select("text", F.struct(*documents.columns).alias("__row"))
    return find(rows, benchmark, window).filter("n_hit = 0").select("__row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("spans").cast("long").alias("n_spans"),
    )

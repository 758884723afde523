"""Product codes of vectors, with the nearest entries found by equal-average search.

A vector is cut into equal parts; each part position has a codebook of at most 256 entries, and a
part's code is the index of its nearest entry. Squared distance over `width` components is at
least (difference of component sums)**2 / width. So entries are kept in order of their sums, and a
part looks at those around its own sum, outward on both sides, until on each side that bound
strictly exceeds its best distance; what is left can neither be nearer nor tie.

Parts are searched in blocks that are sorted by their sums, and a side goes on by several entries
at once; every part of a block stops by its own bound.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.llm.common import materialize, table
from landmesh.llm.vectors import PARTIAL, Sums, as_long, decimal_text, pieces, summed, usable, whole, with_means

#: Parts searched together, and entries that a side goes on by.
BLOCK, STEP = 256, 32


@dataclass(frozen=True)
class Codebooks:
    """`entries`: parts x entries x width whole numbers; a code is the index of an entry."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        """Components of a whole vector."""
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(decimal_text(self.entries).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry; ties go to the lower index."""
    index, best = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=parts.dtype)
    for at, some, book in pieces(parts, entries):
        i, d = _search(some, book)
        if best.dtype != d.dtype:
            best = best.astype(object)
        index[at], best[at] = i, d
    return index, best


def _search(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = entries.shape[1]
    average = entries.sum(axis=1)
    ranked = np.argsort(average, kind="stable")
    sums = average[ranked]
    own = parts.sum(axis=1)
    order = np.argsort(own, kind="stable")
    x, own = parts[order], own[order]
    entry_norm, norm = (entries * entries).sum(axis=1), (x * x).sum(axis=1)
    best = np.full(len(x), np.inf, dtype=x.dtype)
    index = np.zeros(len(x), dtype=np.int64)

    def visit(rows: np.ndarray, a: int, b: int) -> None:
        """Compare rows with the entries of rank a to b."""
        some = np.sort(ranked[a:b])  # so that the first of equal distances has the lowest index
        d = norm[rows][:, None] + entry_norm[some][None, :] - 2 * (x[rows] @ entries[some].T)
        j = d.argmin(axis=1)
        d, i = d[np.arange(len(rows)), j], some[j]
        closer = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
        best[rows[closer]], index[rows[closer]] = d[closer], i[closer]

    for start in range(0, len(x), BLOCK):
        rows = np.arange(start, min(start + BLOCK, len(x)))
        low = high = int(np.searchsorted(sums, own[rows[len(rows) // 2]]))
        left = right = rows
        while True:
            if low > 0:
                gap = np.maximum(own[left] - sums[low - 1], 0)
                left = left[~(gap * gap > best[left] * width)]  # once beyond, always beyond
            if high < len(sums):
                gap = np.maximum(sums[high] - own[right], 0)
                right = right[~(gap * gap > best[right] * width)]
            go_left, go_right = low > 0 and len(left), high < len(sums) and len(right)
            if not (go_left or go_right):
                break
            if go_left:
                visit(left, max(0, low - STEP), low)
                low = max(0, low - STEP)
            if go_right:
                visit(right, high, min(len(sums), high + STEP))
                high = min(len(sums), high + STEP)
    back = np.empty(len(x), dtype=np.int64)
    back[order] = np.arange(len(x))
    return index[back], best[back]


def _kept(rows: DataFrame, vector: str, width: int) -> DataFrame:
    return rows.filter(usable(vector, width))


def train(rows: DataFrame, vector: str = "embedding", order: str = "vec_id", width: int = 64, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks that begin as the parts of the first `size` vectors in `order` and move `rounds` times.

    Vectors that are null, of another width, or hold null, NaN or infinite components don't count;
    a null in `order` comes last, vectors of one `order` go by their components. With fewer
    vectors than `size` the codebooks have fewer entries, without any they have none. Entries are
    moved to the floor of their parts' mean; unused ones stay. All arithmetic is exact.
    """
    if width % parts:
        raise ValueError("parts must divide the width")
    kept = _kept(rows, vector, width).select(F.col(vector).alias("v"), F.col(order).alias("o"))
    first = kept.orderBy(F.asc_nulls_last("o"), "v").limit(size).collect()
    sub = width // parts
    if not first:
        return Codebooks(np.zeros((parts, 0, sub)), scale)
    start = whole(pa.array([list(r.v) for r in first], pa.list_(pa.float64())), width, scale)
    entries = np.stack([start[:, p * sub : (p + 1) * sub] for p in range(parts)])
    for _ in range(rounds):

        def sums(batches, entries=entries, n=entries.shape[1]):
            out = Sums(parts * n, sub)
            for batch in batches:
                x = whole(batch.column(0), width, scale)
                for p in range(parts):
                    mine = x[:, p * sub : (p + 1) * sub]
                    out.add(nearest(mine, entries[p])[0] + p * n, mine)
            yield out.batch()

        flat = with_means(entries.reshape(-1, sub), kept.select("v").mapInArrow(sums, PARTIAL))
        entries = flat.reshape(entries.shape)
    return Codebooks(entries, scale)


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """`carry` as a struct of that name, code (hex, two digits a part), error (squared distance).

    A row for each vector that counts in `train`, repeated ones too. error is null where a long
    can't hold it.
    """
    parts, n, sub = books.entries.shape
    kept = _kept(rows, vector, books.width).select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry"), F.col(vector).alias("v"))

    def code(batches):
        digits = np.array([f"{i:02x}" for i in range(max(n, 1))])
        for batch in batches:
            x = whole(batch.column(1), books.width, books.scale)
            text, error = np.full(len(x), "", dtype=f"<U{max(2, len(digits[-1])) * parts}"), 0
            for p in range(parts):
                i, d = nearest(x[:, p * sub : (p + 1) * sub], books.entries[p])
                text, error = np.char.add(text, digits[i]), error + d
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text.tolist(), pa.string()), as_long(error)], ["carry", "code", "error"])

    schema = kept.select("carry").schema.add("code", "string").add("error", "long")
    if not n:  # nothing counts
        return kept.limit(0).select("carry", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return kept.mapInArrow(code, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """codes with `decoded`: the whole-number vector that each code stands for, by column functions.

    The codebooks are at most 256 entries a part; a null code gives null.
    """
    parts = []
    for p, book in enumerate(books.entries):
        entries = F.array(*(F.array(*(F.lit(int(x)).cast("long") for x in e)) for e in book))
        parts.append(F.get(entries, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")))
    return codes.withColumn("decoded", F.flatten(F.array(*parts)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and their sums by label; nulls of `label` are one group."""
    rows = table(spark, sf_dir, "embeddings")
    books = train(rows)
    coded = materialize(encode(rows, books).select("carry.vec_id", "carry.label", "code", "error"), "codes")
    total = coded.groupBy("label").agg(summed("error").alias("label_error")).withColumnRenamed("label", "of_label")
    # A label may hold a third of all rows: AQE splits its partition, the other side has one row.
    return coded.join(total, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment to the codebooks of round k, and the codebooks of round k + 1."""
    return f""", a{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, e := entry)) AS best FROM (
  SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comps c JOIN b{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY c.vec_id, c.part, b.entry) GROUP BY vec_id, part)
, b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
  SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
    SELECT c.part, a.best.e AS entry, c.pos, sum(c.x) AS s, count(*) AS n FROM comps c JOIN a{k} a ON c.vec_id = a.vec_id AND c.part = a.part GROUP BY ALL)) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""


OP12_SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (SELECT vec_id, i // 16 AS part, i % 16 AS pos, CAST(floor(1024 * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, range(64) t(i)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256),
b0 AS MATERIALIZED (SELECT part, entry, pos, x FROM comps JOIN firsts USING (vec_id))
{"".join(map(_round, range(5)))},
coded AS (SELECT a.vec_id, string_agg(lower(printf('%02x', a.best.e)), '' ORDER BY a.part) AS code, CAST(sum(a.best.d) AS BIGINT) AS error FROM a4 a GROUP BY a.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b4) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""

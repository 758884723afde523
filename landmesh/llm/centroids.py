"""Clusters of vectors around centroids, the nearest found by Orchard's search.

For every centroid the others are listed by their distance from it. A vector that is at distance d
of one centroid reads that one's list from the near end: a centroid farther than 2 d from it can't
be nearer to the vector, so the search stops there. Where a nearer one is met, the search jumps to
that one's list. Centroids that were compared already are marked and passed over.

All vectors of a batch take their steps together; each stops and jumps by itself.
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

#: Vectors that take their steps together.
BLOCK = 4096


@dataclass(frozen=True)
class Centroids:
    """`points`: centroids x width whole numbers."""

    points: np.ndarray
    scale: int

    def sha256(self) -> list[str]:
        """Of each centroid's components in decimal, joined by commas."""
        return [hashlib.sha256(decimal_text(p).encode()).hexdigest() for p in self.points]


class Lists:
    """For each centroid the others by distance, and those squared distances."""

    def __init__(self, points: np.ndarray):
        self.points = points
        norm = (points * points).sum(axis=1)
        apart = norm[:, None] + norm[None, :] - 2 * (points @ points.T)
        apart[np.arange(len(points)), np.arange(len(points))] = -1  # itself first, to be left out
        order = np.argsort(apart, axis=1, kind="stable")
        self.near = order[:, 1:]
        self.apart = np.take_along_axis(apart, order, axis=1)[:, 1:]


def nearest(rows: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; ties go to the smaller number."""
    number, best = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=rows.dtype)
    lists: dict = {}
    for at, some, book in pieces(rows, points):
        known = lists.get(book.dtype) or lists.setdefault(book.dtype, Lists(book))
        if best.dtype != some.dtype:
            best = best.astype(object)
        for a in range(0, len(at), BLOCK):
            number[at[a : a + BLOCK]], best[at[a : a + BLOCK]] = _search(some[a : a + BLOCK], known)
    return number, best


def _search(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    points, near, apart = lists.points, lists.near, lists.apart
    n, last = len(x), near.shape[1]
    current, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    gap = x - points[0]
    best = (gap * gap).sum(axis=1)
    marked = np.zeros((n, len(points)), dtype=bool)
    marked[:, 0] = True
    going = np.arange(n)
    while len(going):
        going = going[place[going] < last]
        at, k = current[going], place[going]
        more = ~(apart[at, k] > 4 * best[going])  # squared: strictly beyond twice the distance
        going, at, k = going[more], at[more], k[more]
        other = near[at, k]
        place[going] = k + 1
        new = ~marked[going, other]
        rows, other = going[new], other[new]
        marked[rows, other] = True
        gap = x[rows] - points[other]
        d = np.einsum("ij,ij->i", gap, gap) if gap.dtype != object else (gap * gap).sum(axis=1)
        closer = (d < best[rows]) | ((d == best[rows]) & (other < current[rows]))
        rows = rows[closer]
        best[rows], current[rows], place[rows] = d[closer], other[closer], 0
    return current, best


def fit(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", width: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2") -> Centroids:
    """Centroids that begin as the k vectors of smallest hash of `salt`:key and move `rounds` times.

    Vectors that are null, of another width, or hold null, NaN or infinite components don't count.
    A null key comes last; vectors of one key go by their components. With fewer vectors than k
    there are fewer centroids, without any there is none. A centroid moves to the floor of its
    vectors' mean; empty ones stay. All arithmetic is exact.
    """
    kept = rows.filter(usable(vector, width)).select(F.col(vector).alias("v"), F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256).alias("h"))
    first = kept.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not first:
        return Centroids(np.zeros((0, width)), scale)
    points = whole(pa.array([list(r.v) for r in first], pa.list_(pa.float64())), width, scale)
    for _ in range(rounds):

        def sums(batches, points=points):
            out = Sums(len(points), width)
            for batch in batches:
                x = whole(batch.column(0), width, scale)
                out.add(nearest(x, points)[0], x)
            yield out.batch()

        points = with_means(points, kept.select("v").mapInArrow(sums, PARTIAL))
    return Centroids(points, scale)


def assign(rows: DataFrame, centroids: Centroids, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """`carry` as a struct of that name, cluster (int), distance (squared; null where it is no long).

    A row for each vector that counts in `fit`, repeated ones too.
    """
    width = centroids.points.shape[1]
    kept = rows.filter(usable(vector, width)).select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry"), F.col(vector).alias("v"))
    if not len(centroids.points):  # nothing counts
        return kept.limit(0).select("carry", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))

    def place(batches):
        for batch in batches:
            number, d = nearest(whole(batch.column(1), width, centroids.scale), centroids.points)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), as_long(d)], ["carry", "cluster", "distance"])

    return kept.mapInArrow(place, kept.select("carry").schema.add("cluster", "integer").add("distance", "long"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster and distance, with inertia of the cluster and of all.

    What is joined by a broadcast has a row for each centroid, 40 at most.
    """
    rows = table(spark, sf_dir, "embeddings")
    centroids = fit(rows)
    placed = materialize(assign(rows, centroids).select("carry.vec_id", "cluster", "distance"), "clusters")
    each = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s"))
    total = each.agg(F.sum("s").try_cast("long").alias("inertia"))
    named = spark.createDataFrame(list(enumerate(centroids.sha256())), "cluster int, centroid_sha256 string")
    facts = each.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total)).select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(k: int) -> str:
    """Assignment to the centroids of round k, and the centroids of round k + 1."""
    return f""", a{k} AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := d, e := entry)) AS best FROM (
  SELECT c.vec_id, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comps c JOIN b{k} b ON c.pos = b.pos GROUP BY c.vec_id, b.entry) GROUP BY vec_id)
, b{k + 1} AS MATERIALIZED (SELECT b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
  SELECT entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
    SELECT a.best.e AS entry, c.pos, sum(c.x) AS s, count(*) AS n FROM comps c JOIN a{k} a ON c.vec_id = a.vec_id GROUP BY ALL)) m
  ON b.entry = m.entry AND b.pos = m.pos)"""


OP13_SQL = f"""
WITH kept AS (SELECT vec_id, embedding AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (SELECT vec_id, i AS pos, CAST(floor(256 * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(64) t(i)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS entry FROM kept QUALIFY entry < 40),
b0 AS MATERIALIZED (SELECT entry, pos, x FROM comps JOIN firsts USING (vec_id))
{"".join(map(_round, range(6)))},
names AS (SELECT entry, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM b5 GROUP BY entry)
SELECT a.vec_id, CAST(a.best.e AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
  CAST(sum(a.best.d) OVER (PARTITION BY a.best.e) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, n.centroid_sha256
FROM a5 a JOIN names n ON n.entry = a.best.e
"""

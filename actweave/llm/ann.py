"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of a bounded number of bytes; every block of queries meets every block of candidates in a
task of its own, in tiles, and sends on the k best of each query. Nothing but two counts reaches the driver.
A tile's int8 product gives every inner product up to an error bound; only pairs whose upper bound reaches the k-th best
lower bound are recomputed in double precision and go into the query's heap. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block of query vectors, and of a block of candidates.
BLOCK_BYTES, CANDIDATE_BYTES = 32_000_000, 64_000_000
#: Blocks that small tables are dealt into nevertheless, to use several cores; every block sends k rows for each query, so more are not made.
LEAST_BLOCKS = 8
TILE = 2048
K = 20


class Quantised:
    """Rows as int8 codes times a scale, with the norms that bound the error of a product of two such rows."""

    def __init__(self, rows: np.ndarray):
        self.scale = np.abs(rows).max(axis=1) / 127
        # exact in float32: products of codes sum to less than 2**24 up to 1,000 dimensions; longer sums are covered by `slack`
        self.code = np.rint(rows / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        self.error = np.sqrt(((rows - near) ** 2).sum(axis=1))
        self.near = np.sqrt((near**2).sum(axis=1))
        self.norm = np.sqrt((rows**2).sum(axis=1))
        self.slack = 1e-6 if rows.shape[1] <= 1000 else 1e-7 * rows.shape[1]


def bounds(a: Quantised, b: Quantised, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """Products of rows i of a and rows j of b, and how far each can be off."""
    product = (a.code[i].astype(np.float32) @ b.code[j].astype(np.float32).T).astype(np.float64)
    product *= a.scale[i, None] * b.scale[None, j]
    off = a.error[i, None] * b.norm[None, j] + a.near[i, None] * b.error[None, j] + max(a.slack, b.slack) * a.norm[i, None] * b.norm[None, j]
    return product, off


class Heaps:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)
        self.last = np.full(n, np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = (score > self.least[q]) | ((score == self.least[q]) & (ids < self.last[q]))
        q, ids, score = q[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        top = rank < self.k
        for a, i, s in zip(q[top].tolist(), ids[top].tolist(), score[top].tolist(), strict=True):
            heap = self.heaps[a]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            else:
                heapq.heappushpop(heap, (s, -i))
        for a in np.unique(q):
            if len(self.heaps[a]) == self.k:
                self.least[a], self.last[a] = self.heaps[a][0][0], -self.heaps[a][0][1]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, components added in their order: equal vectors give equal products wherever they stand."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def search(queries: np.ndarray, query_ids: np.ndarray, q8: Quantised, rows: np.ndarray, ids: np.ndarray, heaps: Heaps) -> None:
    """Adds the rows that are among the k nearest so far to the queries' heaps."""
    r8 = Quantised(rows)
    for j0 in range(0, len(rows), TILE):
        j = slice(j0, min(j0 + TILE, len(rows)))
        for i0 in range(0, len(queries), TILE):
            i = slice(i0, min(i0 + TILE, len(queries)))
            product, off = bounds(q8, r8, i, j)
            product[query_ids[i, None] == ids[None, j]] = -np.inf
            low = heaps.least[i].copy()
            if (low == -np.inf).any() and product.shape[1] > heaps.k:
                low = np.maximum(low, np.partition(product - off, product.shape[1] - heaps.k, axis=1)[:, product.shape[1] - heaps.k])
            q, c = np.nonzero((product + off >= low[:, None]) & (product > -np.inf))
            for at in range(0, len(q), 50_000):
                a, b = q[at : at + 50_000] + i0, c[at : at + 50_000] + j0
                heaps.add(a, ids[b], products(queries[a], rows[b]))


def _usable(rows: DataFrame) -> DataFrame:
    """Vectors that are null, empty, all zero or hold a null or non-finite component take no part; nor do rows without an id."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)


def nearest(vectors: DataFrame, every: int = 20, k: int = K, vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each row whose vec_id is divisible by `every`.

    Candidates are all rows with another vec_id; ties go to the smaller vec_id. Vectors are compared with those of the same
    number of dimensions. A query id that occurs on several rows is asked once, with the smallest of its vectors; candidates that repeat an
    id each count. Other columns are ignored. No vectors, or none that is usable, give no rows.
    """
    rows = _usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-asked.count() * (widest or 1) * 8 // block_bytes))
    others = max(-(-n * (widest or 1) * 8 // CANDIDATE_BYTES), -(-LEAST_BLOCKS // blocks))
    # candidates are dealt by their place in the table, so rows that repeat an id spread as others do
    left = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
    right = rows.withColumn("c", F.pmod(F.monotonically_increasing_id(), F.lit(others))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    out = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_met(k), "query_id long, vec_id array<long>, score array<double>")
    out = out.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select("query_id", "x.vec_id", "x.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) for each number of dimensions."""
    v = table.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.diff(v.offsets.to_numpy())
    flat, ids = v.flatten().to_numpy(zero_copy_only=False), table.column("vec_id").to_numpy()
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        yield ids[own], flat[start[own][:, None] + np.arange(d)]


def _met(k: int):
    """The k best candidates of one block for each query of another."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        found = {r.shape[1]: (ids, r) for ids, r in _matrix(rows)} if rows.num_rows else {}
        for i, q in _matrix(asked) if found else ():
            if q.shape[1] in found:
                heaps = Heaps(len(q), k)
                ids, r = found[q.shape[1]]
                search(q, i, Quantised(q), r, ids, heaps)
                best = [sorted(h, reverse=True) for h in heaps.heaps]
                out[0] += i.tolist()
                out[1] += [[-x for _, x in h] for h in best]
                out[2] += [[s for s, _ in h] for h in best]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return run


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20
"""

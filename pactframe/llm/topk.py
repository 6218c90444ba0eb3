"""Exact top-k inner-product search: tiled matrix products, partial selection, tree merging.

Vectors are turned to integers, ``floor(256 * x)`` with x as double. The query set is cut into chunks of a
bounded number of rows; only such a chunk is ever broadcast, and a larger query set takes more chunks, each
against all rows. A task multiplies its shard with the chunk tile by tile, selects each query's best k of a
tile, and merges them into the query's running list; the shards' lists are then merged in two levels.

Products are exact: 32-bit floats while every sum stays below 2**24, 64-bit floats below 2**53, else
64-bit integers (sums beyond 2**62 are outside the domain).

Defined results: null ids, null vectors and vectors with null or non-finite components take no part, nor do
empty ones; vectors of different lengths never meet. Ties go to the smaller id. Rows that carry the
query's id are its own. If an id is repeated, its query is the smallest vector; as candidates, repeated rows stand
for themselves. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactframe.llm.common import importable, saved

#: Queries broadcast at once, queries and rows of a tile, groups of the first merging level.
CHUNK, QUERY_TILE, ROW_TILE, FAN_IN = 32_768, 512, 8_192, 32
SCALE = 256.0
#: Stands for the score of a query's own row.
LOWEST = -(2**62)


def quantised(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(row numbers, matrix)] by vector length, of the vectors that take part."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    out = []
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        m = flat[starts[rows][:, None] + np.arange(dim)[None, :]]
        good = np.isfinite(m).all(axis=1)
        out.append((rows[good], np.floor(SCALE * m[good])))
    return [(r, m) for r, m in out if len(r)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact, as 64-bit integers or floats that hold them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 2**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """Running lists of k for a fixed set of queries."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.zeros((len(ids), k), dtype=np.int64)
        self.row = np.zeros((len(ids), k), dtype=np.int64)
        self.full = np.zeros((len(ids), k), dtype=bool)

    def add(self, at: slice, scores: np.ndarray, rows: np.ndarray) -> None:
        """Merge a tile: rows ascend, so a stable order by score settles ties."""
        k = self.k
        own = self.ids[at][:, None] == rows[None, :]
        s = scores.astype(np.int64)
        if s.shape[1] > 4 * k:  # partial selection: everything above the k-th score, then ties by place
            key = np.where(own, LOWEST, s)
            kth = -np.partition(-key, k - 1, axis=1)[:, k - 1]
            more = key > kth[:, None]
            tie = key == kth[:, None]
            take = more | (tie & (np.cumsum(tie, axis=1) <= k - more.sum(axis=1)[:, None]))
            pick = np.argsort(~take, axis=1, kind="stable")[:, :k]
        else:
            pick = np.broadcast_to(np.arange(s.shape[1]), s.shape)
        new_s, new_r, new_f = np.take_along_axis(s, pick, 1), rows[pick], ~np.take_along_axis(own, pick, 1)
        s, r, f = np.hstack([self.score[at], new_s]), np.hstack([self.row[at], new_r]), np.hstack([self.full[at], new_f])
        order = np.lexsort((r, -s, ~f), axis=1)[:, :k]
        self.score[at], self.row[at], self.full[at] = (np.take_along_axis(x, order, 1) for x in (s, r, f))


def _scan(chunk, k: int):
    """A task's work: best k of its rows for each query of the broadcast chunk."""

    def run(batches):
        lists = {dim: Best(ids, k) for dim, (ids, _) in chunk.value.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, m in quantised(batch.column(1)):
                dim = m.shape[1]
                if dim not in lists:
                    continue
                order = np.argsort(ids[rows], kind="stable")
                own, m = ids[rows][order], m[order]
                best, q = lists[dim], chunk.value[dim][1]
                for c in range(0, len(own), ROW_TILE):
                    for at in range(0, len(q), QUERY_TILE):
                        part = slice(at, min(at + QUERY_TILE, len(q)))
                        best.add(part, products(q[part], m[c : c + ROW_TILE]), own[c : c + ROW_TILE])
        for best in lists.values():
            for at in range(0, len(best.ids), QUERY_TILE):
                f = best.full[at : at + QUERY_TILE]
                q = np.broadcast_to(best.ids[at : at + QUERY_TILE, None], f.shape)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (q[f], best.row[at : at + QUERY_TILE][f], best.score[at : at + QUERY_TILE][f])], names=["query_id", "vec_id", "score"])

    return run


def _best(df: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``vectors`` besides its own."""
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    # only vectors that take part may stand for their id
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asked = saved(asked.filter(good).groupBy("id").agg(F.min("v").alias("v")))
    n = max(1, math.ceil(asked.count() / CHUNK))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)))
    done = None
    for c in range(n):  # each pass broadcasts about CHUNK queries and ends before the next, whatever their number
        got = asked.filter(F.col("chunk") == c).select("id", "v").toArrow()
        ids = got.column(0).to_numpy()
        chunk = spark.sparkContext.broadcast({m.shape[1]: (ids[r], m) for r, m in quantised(got.column(1))})
        part = _merged(rows.mapInArrow(_scan(chunk, k), "query_id long, vec_id long, score long"), k)
        if n > 1:
            part = saved(part)
            chunk.unpersist()
        done = part if done is None else done.unionByName(part)
    return done


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The tasks' lists, merged in two levels."""
    found = found.withColumn("group", F.spark_partition_id() % FAN_IN)
    merged = _best(_best(found, k, "query_id", "group").drop("rank"), k, "query_id")
    return merged.select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by tiles of queries and shards of candidates.

Queries and candidates are dealt round robin into groups of bounded size; each pair (query group, shard) meets in
one task, where tiles of queries are multiplied with the shard's matrix, a partial selection keeps the best k of each tile,
and the lists are merged: per task, then by Spark's partial group limit on the map side, then finally per query.

Defined cases: a row takes part only with a non-null id and a non-null vector of finite, non-null components. Vectors of
another length than the query's aren't its candidates; empty vectors score 0. Rows that repeat an id are rows of their own;
a query never meets a row of its own id. Equal scores go by the smaller id. Tables without queries give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table

TILE = 256
OUT = "query_key long, query_id long, vec_id long, score long"


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole)


def _matrix(t: pa.Table, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: ids, row keys and floor(scale * x), in order of id."""
    ids, keys = t.column("id").to_numpy(), t.column("k").to_numpy()
    v = t.column("v").combine_chunks()
    at = v.offsets.to_numpy().astype(np.int64)
    flat = np.floor(scale * v.values.to_numpy(zero_copy_only=False))
    out = {}
    for width in np.unique(size := at[1:] - at[:-1]):
        rows = np.flatnonzero(size == width)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[int(width)] = ids[rows], keys[rows], flat[at[rows][:, None] + np.arange(width)].reshape(len(rows), width)
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while they are exact there, else in Python's integers, held within 64 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(big(a) @ big(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest of each row that aren't own, ties to the first column."""
    low = np.iinfo(np.int64).min
    held = np.where(own, low, scores)
    n = held.shape[1]
    kth = np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.full(len(held), low)
    r, c = np.nonzero((held >= kth[:, None]) & ~own)
    order = np.lexsort((c, -1 - held[r, c], r))  # -1 - x: no overflow at the least value
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(held)))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, query_rows: int = 4096, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of floor(scale * x) for each query row."""
    q, c = _vectors(queries, id_col, vec_col), _vectors(candidates, id_col, vec_col)
    n_q = max(1, math.ceil(queries.select(F.count(F.lit(1))).first()[0] / query_rows))
    n_c = max(1, math.ceil(candidates.select(F.count(F.lit(1))).first()[0] / shard_rows))
    key = F.monotonically_increasing_id()
    q = q.withColumn("k", key).withColumn("g", (F.col("k") % n_q).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = c.withColumn("k", key).withColumn("s", (F.col("k") % n_c).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        shards = _matrix(right, scale) if right.num_rows else {}
        for width, (ids, keys, m) in (_matrix(left, scale) if left.num_rows else {}).items():
            if width not in shards:
                continue
            cid, _, cm = shards[width]
            for at in range(0, len(ids), TILE):
                part = slice(at, at + TILE)
                score = _product(m[part], cm)
                r, col = best(score, ids[part][:, None] == cid[None, :], k)
                found.append((keys[part][r], ids[part][r], cid[col], score[r, col]))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_key", "query_id", "vec_id", "score"), cols, strict=True)})

    lists = q.groupBy("g", "s").cogroup(c.groupBy("g", "s")).applyInArrow(search, OUT)
    w = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(e.where(F.col("vec_id") % 50 == 0), e)


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

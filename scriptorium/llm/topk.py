"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are scaled to integers and read as sparse rows. Candidates and queries are cut into
blocks of bounded size; each pair of blocks is one task's work. There the candidates become
postings (one list of row numbers and weights a dimension), and each query scatters its
non-zero weights over the postings into a dense array of scores. A partition selection keeps
the k best of the block, and the blocks' winners are merged by rank.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parallelism

#: Most queries and candidates that meet in one task. A candidate is copied to each block of
#: queries: one copy for 6.5 million vectors, since every hundredth of them asks.
QUERY_BLOCK, CANDIDATE_BLOCK = 65536, 32768
LEAST_BLOCK = 512
_LOW, _HIGH = -(2**63), 2**63 - 1


def _rows(vectors: list, scale: int) -> np.ndarray:
    """Integer rows, short ones filled up with zeros; Python integers where 64 bits could overflow."""
    width = max((len(v) for v in vectors), default=0)
    dense = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    dense = np.floor(dense * float(scale))
    if dense.size and np.abs(dense).max() ** 2 * max(width, 1) >= 2.0**62:
        return np.vectorize(int, otypes=[object])(dense)
    return dense.astype(np.int64)


def _postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each dimension the rows that have it, and their weights."""
    out = []
    for column in rows.T:
        at = np.flatnonzero(column != 0)
        out.append((slice(None), np.ascontiguousarray(column)) if len(at) == len(column) else (at, column[at]))
    return out


def _block(tile: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    is_query = tile["is_query"].to_numpy()
    queries, pool = tile[is_query], tile[~is_query].sort_values("vec_id", kind="stable")
    if not len(queries) or not len(pool):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    query_rows, pool_rows = _rows(queries["v"].tolist(), scale), _rows(pool["v"].tolist(), scale)
    kind = object if object in (query_rows.dtype, pool_rows.dtype) else np.int64
    query_rows, pool_rows = query_rows.astype(kind), pool_rows.astype(kind)
    if kind is not object and query_rows.size and pool_rows.size:
        top = float(np.abs(query_rows).max()) * float(np.abs(pool_rows).max()) * query_rows.shape[1]
        if top >= 2.0**62:
            kind = object
            query_rows, pool_rows = query_rows.astype(object), pool_rows.astype(object)
    postings, ids = _postings(pool_rows), pool["vec_id"].to_numpy(dtype=np.int64)
    own_ids = queries["vec_id"].to_numpy(dtype=np.int64)
    told_id, told_score, told_n = [], [], np.zeros(len(own_ids), np.int64)
    for q, (own, row) in enumerate(zip(own_ids, query_rows, strict=True)):
        scores = np.zeros(len(ids), dtype=kind)
        for t in np.flatnonzero(row[: len(postings)] != 0):
            at, weights = postings[t]
            scores[at] += row[t] * weights
        others = np.flatnonzero(ids != own)
        scores = scores[others]
        if len(others) > k:  # partition selection, with every tie of the k-th score; ids ascend
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = np.flatnonzero(scores >= least)
        else:
            keep = np.arange(len(others))
        keep = keep[np.argsort(-scores[keep], kind="stable")][:k]
        told_n[q] = len(keep)
        told_id.append(ids[others[keep]])
        told_score.append(np.array([min(max(int(s), _LOW), _HIGH) for s in scores[keep]], np.int64))
    return pd.DataFrame({"query_id": np.repeat(own_ids, told_n), "vec_id": np.concatenate(told_id), "score": np.concatenate(told_score)})


def exact_top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best by integer inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all rows with
    another id. Rows with a null id, or a vector that is null or has a null or non-finite
    component (also once scaled), take no part. Missing components of shorter vectors count
    0. An id is one vector: of rows that repeat an id, the one with the smallest vector
    counts. Scores beyond 64 bits are set to the nearest long. No rows: no result. Further
    columns, of any name, are ignored.
    """
    spark = vectors.sparkSession
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    valid = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)
    valid = valid.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = valid.count()
    asked = valid.where(F.col("vec_id") % every == 0).count()
    n_query = max(1, ceil(asked / QUERY_BLOCK))
    n_pool = max(1, ceil(n / CANDIDATE_BLOCK), min(2 * parallelism(spark), n // LEAST_BLOCK))
    block = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every_block = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    pool = valid.select("vec_id", "v", F.lit(False).alias("is_query"), block(n_pool).alias("pool"), every_block(n_query).alias("query"))
    queries = valid.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.lit(True).alias("is_query"), every_block(n_pool).alias("pool"), block(n_query).alias("query"))
    winners = pool.unionByName(queries).groupBy("pool", "query").applyInPandas(lambda tile: _block(tile, k, scale), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return winners.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by tiled matrix products.

Queries are dealt into blocks and candidates into shards, both of bounded size; each pair of a block and a shard is one tile, a task's
unit. A tile multiplies its two matrices in parts, selects each query's best by partial selection and sends only these on; a
tree of merges, ``FAN_IN`` tiles at a time, makes the final lists. Components are integers floor(1024 * x), so products are exact: in doubles while
no sum can pass 2 ** 53, else in Python's integers (scores beyond 64 bits are clipped to them).

Only vectors of equal length are compared; empty ones score 0 with each other. Rows without an id, and vectors that are null or hold null or
non-finite components take no part. Every other row is a candidate of every query of another id, also where its id repeats; query rows of one id
share one list. Ties go to the smaller id. An empty table gives no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut, table
from sparkfolio.llm.vectors import QUERY_MOD, TOP, best_rows, dealt, matrix, merge_top, usable

SCALE = 1024
#: Most rows of a query block or candidate shard, most numbers in its matrix, most numbers in one product.
ROWS, NUMBERS, CELLS = 32_768, 1 << 22, 1 << 22


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether a score is among the k largest of its row, ties to the left."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    above = scores > least
    ties = scores == least
    return above | ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True))


def _tile(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(left) and len(right):
        (qid, q, _), (cid, c, _) = matrix(left), matrix(right.rename(columns={"other_id": "vec_id", "other": "v"}))
        q, c = np.floor(SCALE * q), np.floor(SCALE * c)
        exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53
        step = max(1, CELLS // len(cid))
        for at in range(0, len(qid), step):
            ids = qid[at : at + step]
            own = ids[:, None] == cid[None, :]
            if exact:
                scores = q[at : at + step] @ c.T
                scores[own] = -np.inf
                r, s = np.nonzero(_best(scores, TOP) & ~own)
                values = scores[r, s].astype(np.int64)
            else:
                whole = q[at : at + step].astype(object).dot(c.astype(object).T)
                whole = np.array([[min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in row] for row in whole], dtype=object)
                picked = [(i, j) for i, row in enumerate(whole) for j in sorted(np.nonzero(~own[i])[0], key=lambda j, row=row: (-row[j], j))[:TOP]]
                r, s = np.array(picked, dtype=np.int64).reshape(-1, 2).T
                values = np.array([whole[i, j] for i, j in picked], dtype=np.int64)
            out.append(best_rows(pd.DataFrame({"query_id": ids[r], "vec_id": cid[s], "score": values, "shard": np.int32(key[2])}), descending=True))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []}).astype("int64")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_mod: int = QUERY_MOD) -> DataFrame:
    """(query_id, rank, vec_id, score): the TOP largest inner products of every query with all other rows."""
    rows = cut(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")))
    asked = F.col("vec_id") % query_mod == 0
    n, n_asked, widest = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.max("dim")).first()
    size = min(ROWS, max(1, NUMBERS // max(widest or 1, 1)))
    blocks, shards = n_asked // size + 1, n // size + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", dealt(F.lit(blocks))).where(asked).withColumn("shard", every(shards))
    right = rows.withColumn("shard", dealt(F.lit(shards))).withColumn("block", every(blocks))
    right = right.select(F.col("vec_id").alias("other_id"), F.col("v").alias("other"), F.col("dim").alias("d"), F.col("block").alias("b"), F.col("shard").alias("s"))
    tiles = left.groupBy("dim", "block", "shard").cogroup(right.groupBy("d", "b", "s")).applyInPandas(_tile, "query_id long, vec_id long, score long, shard int")
    return merge_top(tiles, [F.desc("score"), "vec_id"], "shard", shards)


def op8_exact_topk(spark, sf_dir) -> DataFrame:
    """The ten largest integer inner products of every query of ``embeddings`` with all other rows."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

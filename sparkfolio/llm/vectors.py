"""What the vector searches share: usable rows, tiles of bounded size and the merging of per-query top lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every query whose id this divides; its nearest others to return.
QUERY_MOD, TOP = 100, 10
#: Partial top lists of a query that are merged at a time.
FAN_IN = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite components; floats stay floats, other numbers become doubles."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = v if vectors.select(v).schema[0].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), kept.alias("v"))


def matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, order) in order of id; every row counts, ids may repeat."""
    ids = rows["vec_id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    vectors = np.stack(rows["v"].to_numpy()).astype(np.float64)
    return ids[order], vectors[order], order


def best_rows(rows: pd.DataFrame, descending: bool) -> pd.DataFrame:
    """The TOP best rows (query_id, vec_id, score) of each query of a tile; a query id that repeats has one list."""
    key = -rows["score"] if descending else rows["score"]
    rows = rows.iloc[np.lexsort((rows["vec_id"], key, rows["query_id"]))]
    return rows[rows.groupby("query_id").cumcount() < TOP]


def dealt(parts: Column) -> Column:
    """A bucket of a row by its place in its partition, so rows that repeat an id are dealt like any others. For checkpointed rows."""
    return F.pmod(F.monotonically_increasing_id(), parts).cast("int")


def merge_top(partial: DataFrame, best_first: list, tile: str, tiles: int) -> DataFrame:
    """The TOP best rows of each query with their rank: lists of FAN_IN neighbouring tiles are merged until one is left."""
    width = FAN_IN
    while width < tiles:
        order = Window.partitionBy("query_id", F.floor(F.col(tile) / width)).orderBy(*best_first)
        partial = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).drop("rank")
        width *= FAN_IN
    order = Window.partitionBy("query_id").orderBy(*best_first)
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

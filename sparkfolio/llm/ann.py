"""Approximate nearest neighbours by an adaptive dimension scan within probed lists.

Lists are the cells of centroids fitted on a bounded sample; their number grows with the table. Every vector is in its nearest centroid's
list. A query scans its nearest lists first, whole; the distance of its TOP-th neighbour there is its bound. How many vectors within the bound each other list
can be expected to hold follows from the list's size, its distance, and the mean and spread of its vectors' distances from their centroid; the query probes the lists
that promise most until ``PROMISED`` of the expected are covered. On clustered data these are few lists; on data without any structure they must be most of them.

Vectors are turned by one random rotation, so any leading columns are a fair sample of a distance. A list is scanned in column blocks:
after each, a partial distance is tested against the query's bound, and a candidate goes once it is too far beyond what such a sample of
a distance within the bound can be (``EPSILON`` sets how sure). Those that stay get the exact distance on the original vectors. The bound of a query
falls within a task as its best candidates are found.

Lists are packed into groups of about ``SHARD`` rows; groups of more are scanned in shards, and their queries in blocks, so no task holds a whole one. Only
vectors of the length that most have are in lists; those of another length are scanned against all of that length.
Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components take no part. Every other row is a candidate of every
query of another id, also where its id repeats; query rows of one id share one list. Ties go to the smaller id. An empty table gives no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut, join_small, table
from sparkfolio.llm.vectors import QUERY_MOD, TOP, best_rows, dealt, matrix, merge_top, usable

#: The fitting sample: most rows, most numbers; rows a list in it; most lists; rounds of k-means.
SAMPLE, NUMBERS, ROWS_A_LIST, LISTS, ROUNDS, SEED = 20_000, 1 << 22, 8, 4096, 8, 11
#: Lists scanned first, and at least so many rows in them; share of the expected neighbours to cover; columns of a block; sureness of a test.
FIRST, FIRST_ROWS, PROMISED, COLUMNS, EPSILON = 4, 100, 0.96, 16, 2.1
BLOCK, SHARD, CELLS = 4096, 8192, 1 << 21
_FOUND = "query_id long, vec_id long, score double, tile int"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """k-means on the sample; empty cells stay where they were."""
    centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([_squares(part, centres).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        counts = np.bincount(nearest, minlength=len(centres))
        order = np.argsort(nearest, kind="stable")
        held = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[held])[:-1]])
        centres[held] = np.add.reduceat(sample[order], starts, axis=0) / counts[held][:, None]
    return centres


def spread_dimensions(sample: np.ndarray, centres: np.ndarray) -> float:
    """In how many directions the sample spreads around its centroids, at most its dimension."""
    near = np.concatenate([_squares(part, centres).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
    rest = sample - centres[near]
    values = np.linalg.eigvalsh(rest.T @ rest)
    return float(values.sum() ** 2 / max((values**2).sum(), 1e-300)) or 1.0


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _tail(z: np.ndarray) -> np.ndarray:
    """About the share of a normal distribution below z; close enough to rank lists by."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -700, 700)))


def _scan(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One tile: the queries of a block against the rows of a group's shard that stand in the lists each probes."""
    out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "tile": np.zeros(0, np.int32)})]
    if len(left) and len(right):
        (qid, q, at_q), (cid, c, at_c) = matrix(left), matrix(right)
        bound = left["bound"].to_numpy()[at_q]  # squared
        lists, place = np.unique(right["list"].to_numpy()[at_c], return_inverse=True)
        probed = left["lists"].to_numpy()[at_q]
        dim = q.shape[1]
        turn = rotation(dim)
        tq, tc = q @ turn, c @ turn
        tile = np.int32(key[1] * 31 + key[2])
        step = max(1, CELLS // len(cid))
        for at in range(0, len(qid), step):
            asked = np.stack([np.isin(lists, x) for x in probed[at : at + step]])
            r, s = np.nonzero(asked[:, place] & (qid[at : at + step, None] != cid[None]))
            limit = bound[at : at + step].copy()
            partial = np.zeros(len(r))
            for first in range(0, dim, COLUMNS):
                done = min(first + COLUMNS, dim)
                if first == 0:
                    partial = _squares(tq[at : at + step, :done], tc[:, :done])[r, s]
                else:
                    partial = partial + ((tq[at + r, first:done] - tc[s, first:done]) ** 2).sum(1)
                slack = min(done / dim * (1 + EPSILON / np.sqrt(done)) ** 2, 1) if done < dim else 1
                near = partial <= limit[r] * (slack * (1 + 1e-9)) + 1e-12
                r, s, partial = r[near], s[near], partial[near]
                if first == 0 and len(r):  # the candidates that look best so far tighten the bound
                    order = np.lexsort((partial, r))
                    few = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < TOP]
                    whole = ((q[at + r[few]] - c[s[few]]) ** 2).sum(1)
                    worst = np.full(len(limit), -np.inf)
                    np.maximum.at(worst, r[few], whole)
                    full = np.bincount(r[few], minlength=len(limit)) == TOP
                    limit = np.where(full, np.minimum(limit, worst * (1 + 1e-9)), limit)
            exact = np.sqrt(((q[at + r] - c[s]) ** 2).sum(1))
            out.append(best_rows(pd.DataFrame({"query_id": qid[at + r], "vec_id": cid[s], "score": exact, "tile": tile}), descending=False))
    return pd.concat(out)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_mod: int = QUERY_MOD) -> DataFrame:
    """(query_id, rank, vec_id, score): the TOP nearest found of every query among all other rows, by Euclidean distance."""
    rows = cut(usable(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")))
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = sizes[0] if sizes else (1, 0)
    most = max(1, min(SAMPLE, NUMBERS // dim))
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20))
    sample = rows.where((F.col("dim") == dim) & share).orderBy(F.xxhash64("vec_id", "v")).limit(most).toPandas()
    sample = matrix(sample)[1] if len(sample) else np.zeros((1, dim))
    centres = fit_centroids(sample, int(max(1, min(LISTS, np.sqrt(n), len(sample) // ROWS_A_LIST))))
    spread = spread_dimensions(sample, centres)
    packed = max(1, int(SHARD * len(centres) / max(n, 1)))  # lists of mean size to a group

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            places, away = np.zeros(len(part), np.int32), np.zeros(len(part))
            fit = np.flatnonzero((part["dim"] == dim).to_numpy())
            if len(fit):
                squares = _squares(np.stack(part["v"].to_numpy()[fit]).astype(np.float64), centres)
                places[fit], away[fit] = squares.argmin(1), squares.min(1)
            yield part.assign(list=places, away=away)

    kind = rows.schema["v"].dataType.simpleString()
    query = f"vec_id long, v {kind}, dim int, grp int, lists array<int>, bound double"
    held = cut(rows.mapInPandas(listed, f"vec_id long, v {kind}, dim int, list int, away double"))
    held = held.withColumn("grp", F.floor(F.col("list") / packed).cast("int"))
    about = held.where(F.col("dim") == dim).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("away").alias("m"), F.coalesce(F.var_pop("away"), F.lit(0.0)).alias("s"))
    count, mean, var = np.zeros((3, len(centres)))
    for r in about.collect():  # LISTS rows at most
        count[r.list], mean[r.list], var[r.list] = r.n, r.m, r.s

    def asked(vec_id, v, lists, bound):
        """A row for each group that holds some of a query's lists."""
        lists = np.sort(lists)
        parts = np.split(lists, np.flatnonzero(np.diff(lists // packed)) + 1)
        return pd.DataFrame({"vec_id": vec_id, "v": [v] * len(parts), "dim": np.int32(len(v)), "grp": [np.int32(p[0] // packed) for p in parts], "lists": [p.astype(np.int32) for p in parts], "bound": bound})

    def nearest(v) -> tuple[np.ndarray, np.ndarray]:
        """(distances of the centroids, lists scanned first)."""
        squares = _squares(v[None], centres)[0]
        order = np.argsort(squares, kind="stable")
        rows_before = np.concatenate([[0], np.cumsum(count[order])[:-1]])
        return squares, order[(rows_before < FIRST_ROWS) | (np.arange(len(order)) < FIRST)]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for vec_id, v in zip(part["vec_id"], part["v"], strict=True):
                yield asked(vec_id, v, nearest(v.astype(np.float64))[1] if len(v) == dim else np.zeros(1, np.int64), np.inf)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for vec_id, v, bound in zip(part["vec_id"], part["v"], part["bound"], strict=True):
                bound = np.inf if np.isnan(bound) else bound
                squares, done = nearest(v.astype(np.float64))
                if np.isfinite(bound):
                    sd = np.sqrt(4 * squares * mean / spread + var) + 1e-12 * (squares + mean) + 1e-300
                    hits = count * _tail((bound - squares - mean) / sd)
                else:
                    hits = count.copy()
                known, hits[done] = hits[done].sum(), 0
                order = np.argsort(-hits, kind="stable")
                covered = known + np.concatenate([[0], np.cumsum(hits[order])[:-1]])
                chosen = order[(hits[order] > 0) & (covered < PROMISED * (known + hits.sum()))]
                if len(chosen):
                    yield asked(vec_id, v, chosen, bound)

    def scanned(queries: DataFrame) -> DataFrame:
        queries = cut(queries)
        tally = lambda df, name, size: df.groupBy("dim", "grp").agg((F.floor(F.count(F.lit(1)) / size) + 1).cast("int").alias(name))
        parts = cut(tally(held, "shards", SHARD).join(tally(queries, "blocks", BLOCK), ["dim", "grp"]))
        every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        keys = ["dim", "grp", "shard", "block"]
        left = join_small(queries, parts, ["dim", "grp"]).where("shards IS NOT NULL").withColumn("block", dealt(F.col("blocks"))).withColumn("shard", every("shards"))
        right = join_small(held, parts, ["dim", "grp"]).where("shards IS NOT NULL").withColumn("shard", dealt(F.col("shards"))).withColumn("block", every("blocks"))
        pairs = left.select("vec_id", "v", "lists", "bound", *keys).groupBy(keys).cogroup(right.select("vec_id", "v", "list", *keys).groupBy(keys))
        return pairs.applyInPandas(_scan, _FOUND)

    tiles = 31 * (len(centres) // packed + 1) + n // SHARD + 1
    queries = rows.where(F.col("vec_id") % query_mod == 0)
    near = cut(scanned(queries.mapInPandas(first, query)))
    bounds = merge_top(near, ["score", "vec_id"], "tile", tiles)
    bounds = bounds.where(F.col("rank") == TOP).select(F.col("query_id").alias("vec_id"), (F.col("score") ** 2 * (1 + 1e-9)).alias("bound"))
    more = scanned(queries.where(F.col("dim") == dim).join(bounds, "vec_id", "left").mapInPandas(second, query))
    return merge_top(near.unionByName(more), ["score", "vec_id"], "tile", tiles)


def op9_nearest_neighbours(spark, sf_dir) -> DataFrame:
    """The ten nearest found of every query of ``embeddings`` among all other rows."""
    return search(table(spark, sf_dir, "embeddings"))

"""Ranked lexical search over a length-stratified index.

Documents with equal length normaliser m are one stratum; within it the postings of a term are ordered by tf, and the impact of (m, tf) is
computed once for all postings that share it. For an item, the largest impact of each of its terms bounds what a stratum can score, so strata are visited
from the largest bound on until it lies below the item's last kept score: what is left can't enter the list, and none of it is scored.

The index has one row a document (its terms of the asked vocabulary and their tf), written to the shared folder. Strata are dealt into bands of neighbouring m by
approximate quantiles, and bands into shards of about ``SHARD`` documents, so a stratum of any size is spread over tasks. One shard of each band is searched first;
the last kept scores of those lists are floors for all other shards. Items come in blocks of about ``ITEM_TERMS`` (item, term) pairs, which tasks hold.

Terms are found on UTF-8 bytes: ``bytes.lower`` lowers A-Z alone, and every byte of a character beyond ASCII belongs to a term. Null texts have no terms, and documents or items without
any give no rows. Rows of one item id are one item of all their terms (null ids: one item); every document row counts, also where its id repeats or is null. Equal scores go by
ascending doc_id, nulls last. Texts of any length are whole, read in parts. An empty table on either side gives no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut, table, written

#: Length of the lists; most documents of a shard and bands of strata; (item, term) pairs of a block of items; bytes of a text read at a time.
TOP, SHARD, BANDS, ITEM_TERMS, PART = 50, 8192, 32, 200_000, 1 << 20
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOUND = "item_id long, doc_id long, score long"


def term_counts(text: bytes | None) -> tuple[int, Counter]:
    """Number of terms of a text and how often each occurs."""
    text, n, counts, at = (text or b"").lower(), 0, Counter(), 0
    while at < len(text):
        within = _TERM.match(text, at + PART) if at + PART < len(text) else None
        end = within.end() if within else at + PART
        found = _TERM.findall(text, at, end)
        n += len(found)
        counts.update(found)
        at = end
    return n, counts


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each pair once."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                found += [(i, t) for t in term_counts(text)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["item_id", "term"])

    named = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary"))
    return named.mapInArrow(terms, "item_id long, term binary").distinct()


def build_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: number of all terms, and those of the vocabulary with their tf."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, places, tfs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, counts = term_counts(text)
                if n:
                    held = sorted((terms[t], counts[t]) for t in counts.keys() & terms.keys())
                    ids.append(i)
                    sizes.append(n)
                    places.append([t for t, _ in held])
                    tfs.append([f for _, f in held])
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary"))
    return written(named.mapInArrow(indexed, "doc_id long, n long, terms array<int>, tfs array<int>"), "ranked-index")


def shards(index: DataFrame, n_docs: int, n_terms: int) -> tuple[DataFrame, int]:
    """(m, doc_id, terms, tfs, band, shard) of documents that hold asked terms, and the number of shards of the largest band."""
    m = (F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")).alias("m")
    rows = index.where(F.size("terms") > 0).select(m, "doc_id", "terms", "tfs")
    total = rows.count()
    bands = min(BANDS, total // SHARD + 1)
    edges = rows.agg(F.percentile_approx("m", [i / bands for i in range(1, bands)])).first()[0] if bands > 1 else []
    edges = sorted(set(edges or []))
    band = F.size(F.filter(F.lit(edges), lambda x: x < F.col("m"))) if edges else F.lit(0)
    rows = rows.withColumn("band", band)
    sizes = {r["band"]: r["count"] for r in rows.groupBy("band").count().collect()}  # at most BANDS rows
    dealt = [sizes.get(b, 0) // SHARD + 1 for b in range(len(edges) + 1)]
    return rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.element_at(F.lit(dealt), F.col("band") + 1)).cast("int")), max(dealt)


class Strata:
    """The postings of a shard by stratum, term and tf."""

    def __init__(self, m: np.ndarray, doc_id: np.ndarray, unknown: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        by_m = np.argsort(m, kind="stable")
        values, starts = np.unique(m[by_m], return_index=True)
        self.doc_id, self.unknown = doc_id[by_m], unknown[by_m]
        self.docs = np.append(starts, len(m))
        place = np.empty(len(m), np.int64)
        place[by_m] = np.arange(len(m))
        doc = np.repeat(place, sizes)
        stratum = np.searchsorted(starts, doc, "right") - 1
        order = np.lexsort((tfs, terms, stratum))
        self.doc, stratum, self.term, tf = doc[order], stratum[order], terms[order], tfs[order].astype(np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (stratum[1:] != stratum[:-1]) | (self.term[1:] != self.term[:-1]) | (tf[1:] != tf[:-1])
        first = np.flatnonzero(new)  # one impact for all postings of a (stratum, term, tf)
        impacts = (1_000_000_000 * tf[first]) // (1000 * tf[first] + 20 * values[stratum[first]])
        self.impact = np.repeat(impacts, np.diff(np.append(first, len(order)))).astype(np.float64)
        self.postings = np.searchsorted(stratum, np.arange(len(values) + 1))
        self.lists = []  # of each stratum: (term, start, end) of its lists; a list's last posting has its largest impact
        for a, b in zip(self.postings[:-1], self.postings[1:], strict=True):
            terms_, at = np.unique(self.term[a:b], return_index=True)
            self.lists.append((terms_, a + at, np.append(a + at[1:], b)))

    def search(self, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places of documents, scores) of each item's TOP; exact in doubles, since all sums are whole numbers far below 2 ** 53."""
        bounds = np.zeros((len(self.lists), len(items.ids)))
        at = np.full(items.n_terms, -1, np.int64)
        for s, (terms, _, ends) in enumerate(self.lists):
            at[terms] = ends - 1
            held = at[items.term] >= 0
            bounds[s] = np.bincount(items.item[held], items.weight[held] * self.impact[at[items.term[held]]], len(items.ids))
            at[terms] = -1
        for i in range(len(items.ids)):
            best = np.zeros(0, np.int64), np.zeros(0)
            least = items.floor[i]
            own = slice(items.starts[i], items.starts[i + 1])
            for s in np.argsort(-bounds[:, i], kind="stable"):
                if bounds[s, i] <= 0 or bounds[s, i] < least:
                    break
                best = self._visit(s, items.term[own], items.weight[own], best, least)
                if len(best[1]) == TOP:
                    least = max(least, best[1][-1])
            if len(best[0]):
                yield i, *best

    def _visit(self, s: int, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
        known, starts, ends = self.lists[s]
        at = np.searchsorted(known, terms)
        held = known[np.minimum(at, len(known) - 1)] == terms
        starts, sizes = starts[at[held]], (ends - starts)[at[held]]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        base = self.docs[s]
        scores = np.bincount(self.doc[flat] - base, self.impact[flat] * np.repeat(weights[held], sizes), self.docs[s + 1] - base)
        places = np.flatnonzero((scores > 0) & (scores >= least))
        scores = scores[places]
        if len(places) > TOP:
            enough = scores >= np.partition(scores, len(scores) - TOP)[-TOP]
            places, scores = places[enough], scores[enough]
        places, scores = np.concatenate([best[0], places + base]), np.concatenate([best[1], scores])
        order = np.lexsort((self.doc_id[places], self.unknown[places], -scores))[:TOP]
        return places[order], scores[order]


class Items:
    """A block of items: their (item, term, weight) pairs by item, and the least score that each still asks for."""

    def __init__(self, ids: list, pairs: list[tuple[int, int]], weights: list[float]):
        self.ids, self.n_terms = ids, len(weights)
        self.item = np.array([i for i, _ in pairs], np.int64)
        self.term = np.array([t for _, t in pairs], np.int64)
        self.weight = np.array(weights)[self.term]
        self.starts = np.searchsorted(self.item, np.arange(len(ids) + 1))
        self.floor = np.zeros(len(ids))


def _searched(rows: DataFrame, items: Items) -> DataFrame:
    def search(shard: pa.Table) -> pa.Table:
        terms, tfs = shard.column("terms").combine_chunks(), shard.column("tfs").combine_chunks()
        ids = shard.column("doc_id").combine_chunks()
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        numbers = lambda x: x.to_numpy(zero_copy_only=False)
        strata = Strata(shard.column("m").to_numpy(), numbers(ids.fill_null(0)), numbers(ids.is_null()), sizes, numbers(terms.flatten()), numbers(tfs.flatten()))
        item_ids, doc_ids, scores = [], [], []
        for i, places, found in strata.search(items):
            item_ids += [items.ids[i]] * len(places)
            doc_ids += [None if strata.unknown[p] else int(strata.doc_id[p]) for p in places]
            scores += [int(x) for x in found]
        return pa.table({"item_id": pa.array(item_ids, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return rows.groupBy("band", "shard").applyInArrow(search, _FOUND)


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _block(docs: DataFrame, pairs: list, id_col: str, text_col: str) -> DataFrame:
    """The lists of one block of items."""
    names = {t: k for k, t in enumerate(dict.fromkeys(bytes(r["term"]) for r in pairs))}
    ids = list(dict.fromkeys(r["item_id"] for r in pairs))
    numbered = {i: k for k, i in enumerate(ids)}
    index = build_index(docs, names, id_col, text_col)
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's terms
    weights = [float(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))) for t in range(len(names))]
    items = Items(ids, sorted((numbered[r["item_id"]], names[bytes(r["term"])]) for r in pairs), weights)
    rows, most = shards(index, n_docs, n_terms or 0)
    first = cut(_searched(rows.where(F.col("shard") == 0), items))
    if most == 1:
        return first
    for r in _ranked(first).where(F.col("rank") == TOP).collect():  # at most one row an item of the block
        items.floor[numbered[r["item_id"]]] = r["score"]
    return first.unionByName(_searched(rows.where(F.col("shard") > 0), items))


def rank_documents(docs: DataFrame, items: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each item with a score above 0. Eager where the index is written."""
    pairs = cut(item_terms(items, item_col, text_col))
    blocks = pairs.count() // ITEM_TERMS + 1
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = [_block(docs, asked, id_col, text_col) for b in range(blocks) if (asked := dealt.where(F.col("block") == b).orderBy("item_id", "term").collect())]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _ranked(reduce(DataFrame.unionByName, found)).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir) -> DataFrame:
    """The fifty highest-scoring documents of each item of ``benchmark``."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM len),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, big_n),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark)),
norm AS (SELECT doc_id, 100 - 50 + ((50 * n * big_n) // l) AS m FROM len, totals),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norm USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

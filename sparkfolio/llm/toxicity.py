"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled and holds an unknown part of toxic ones. A linear numpy
classifier minimises the class-prior-corrected risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: the risk of calling
unlabelled text clean, less what the positives in it add, held at zero or more. Where the corrected part turns negative the
step goes back up on it, so the classifier doesn't fit the unlabelled text.

Features are whether a text holds a word (lower case, without punctuation at its ends) or a word's beginning of 4 or 5
characters. Which features count is found in Spark: their document counts among positives and unlabelled texts are tallied over
the training sample and those far more frequent in the positives are kept. Weights are held at zero or more: a word can speak for
toxicity, and no length of clean text around it, nor a large group of clean copies, speaks against it. Equal texts count once in training. Training sees a bounded sample (``MAX_POSITIVE``, ``MAX_UNLABELLED``,
taken by hash of the text, so reruns agree); scoring reads whole texts of all rows.

Null and empty texts have no feature and get the score of the bias. Labels other than 1 are unlabelled text. Without
any positive, every score is 0. Repeated label rows count once; a document is positive if any says so. Features of equal distance rank by hash; equal texts have
equal scores. Very long texts are scored whole. Other columns play no part, whatever their names; ``reject`` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkfolio.llm.common import cut, table

#: Bounds of the training sample, rows.
MAX_POSITIVE, MAX_UNLABELLED = 20_000, 60_000
#: Features kept at most: the farthest from equal shares; their least distance in standard errors and least count of positives.
MAX_FEATURES, MIN_Z, MIN_POSITIVE = 20_000, 5.0, 3
FOLDS, STEPS, RATE, DECAY = 5, 1500, 0.05, 1e-5
#: Words that a task remembers, and features that it counts before it sends the counts on.
MEMORY = 100_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class _Words:
    """A text's feature numbers: hashes of its words and their beginnings, restricted to ``known`` if given."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known, self.memory = known, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        word = word.strip(string.punctuation)
        if not word:
            return ()
        names = {f"w {word}"} | {f"b {word[:n]}" for n in (4, 5) if len(word) > n}
        hashes = [zlib.crc32(n.encode("utf-8", "replace")) for n in names]
        return tuple(hashes if self.known is None else [self.known[h] for h in hashes if h in self.known])

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for word in set((text or "").lower().split()):
            got = self.memory.get(word)
            if got is None:
                got = self.of_word(word)
                if len(word) <= 64:
                    if len(self.memory) >= MEMORY:
                        self.memory.clear()
                    self.memory[word] = got
            found.update(got)
        return found


@dataclass
class Model:
    """Feature hashes with their weights; small enough to travel with the tasks (at most MAX_FEATURES)."""

    features: list[int] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf
    prior: float = 0.0

    def score(self, text: Column) -> Column:
        """Probability-like score of whole texts, 0 to 1."""
        features, weights, bias = self.features, self.weights, self.bias

        @F.pandas_udf(DoubleType())
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = _Words({h: i for i, h in enumerate(features)})
            for texts in batches:
                sums = np.array([bias + weights[list(words(x))].sum() for x in texts], dtype=float)
                with np.errstate(over="ignore"):
                    yield pd.Series(1 / (1 + np.exp(-sums)))

        return scored(text)


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, counts = _Words(), (Counter(), Counter())

    def out():
        keys = counts[0].keys() | counts[1].keys()
        return pd.DataFrame({"h": list(keys), "p": [counts[1][k] for k in keys], "u": [counts[0][k] for k in keys]})

    for rows in batches:
        for positive, text in zip(rows["positive"], rows["text"], strict=True):
            counts[int(positive)].update(words(text))
            if len(counts[0]) + len(counts[1]) > MEMORY:
                yield out()
                counts[0].clear(), counts[1].clear()
    yield out()


def _select(sample: DataFrame, positives: int, unlabelled: int) -> list[int]:
    """The features whose shares among positives exceed those among unlabelled texts most, two-proportion test."""
    counts = sample.mapInPandas(_tally, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / positives, F.col("u") / unlabelled
    mean = (F.col("p") + F.col("u")) / (positives + unlabelled)
    z = (a - b) / F.sqrt(mean * (1 - mean) * (1 / positives + 1 / unlabelled) + F.lit(1e-12))
    kept = counts.withColumn("z", z).where((F.col("p") >= MIN_POSITIVE) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "h").limit(MAX_FEATURES)
    return sorted(r.h for r in kept.select("h").collect())


def _train(rows: list[np.ndarray], positive: np.ndarray, times: np.ndarray, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the sigmoid loss, weights projected to zero or more.

    Rows of equal features are one row with how often it stands; most unlabelled texts have no feature at all.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    p, u = positive, ~positive
    n_p, n_u = times[p].sum(), max(1, times[u].sum())
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        margin = theta[width] + np.bincount(owner, theta[column], len(rows))
        up = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))  # the loss of calling a row clean; 1 - up of calling it toxic
        corrected = (up * times)[u].sum() / n_u - prior * (up * times)[p].sum() / n_p
        slope = up * (1 - up) * times
        clean = np.where(p, -prior / n_p, 1 / n_u) * slope
        grad_rows = np.where(p, -prior / n_p, 0.0) * slope + clean if corrected >= 0 else -clean
        grad = np.append(np.bincount(column, grad_rows[owner], width), grad_rows.sum())
        grad[:width] += DECAY * theta[:width]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[:width] = np.maximum(theta[:width], 0)
    return theta[:width], float(theta[width])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic) outside the held-out fold.

    ``prior`` is the share of toxic text among the unlabelled; by default that among the labelled rows.
    """
    marks = labels.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 0)
    n_marks, n_toxic = marks.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    n_docs = usable.count()
    if not n_toxic or not n_docs:
        return Model()
    prior = prior or n_toxic / n_marks
    positive = F.coalesce(F.col("toxic") == 1, F.lit(False))
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(positive, min(1.0, MAX_POSITIVE / n_toxic)).otherwise(min(1.0, MAX_UNLABELLED / n_docs))
    drawn = usable.select("doc_id", draw.alias("draw")).join(marks, "doc_id", "left").withColumn("positive", positive)
    chosen = drawn.where(F.col("draw") < share).select("doc_id", "draw", "positive").distinct()  # about MAX_POSITIVE + MAX_UNLABELLED rows at most
    texts = usable.withColumn("draw", draw).join(F.broadcast(chosen), ["doc_id", "draw"])  # so no text is shuffled but the sample's
    sample = cut(texts.groupBy("text").agg(F.max("positive").alias("positive")))
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_p or not n_u:
        return Model()
    features = _select(sample, n_p, n_u)
    known = {h: i for i, h in enumerate(features)}

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(known)
        for rows in batches:
            yield pd.DataFrame({"positive": rows["positive"], "at": [np.array(sorted(words(x)), "<i4").tobytes() for x in rows["text"]]})

    got = sample.mapInPandas(indexed, "positive boolean, at binary").groupBy("positive", "at").agg(F.count(F.lit(1)).alias("times")).toPandas()
    order = np.lexsort((got["at"].map(bytes), got["positive"]))
    got = got.iloc[order]
    rows = [np.frombuffer(x, "<i4") for x in got["at"]]
    weights, bias = _train(rows, got["positive"].to_numpy(bool), got["times"].to_numpy(np.float64), len(features), prior)
    return Model(features, weights, bias, prior)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, in their own columns."""
    return docs.where(model.score(F.col("text")) < threshold)


def op7_toxicity(spark, sf_dir) -> DataFrame:
    """Score and prediction of every document; only labels outside the held-out fold are learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

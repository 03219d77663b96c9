"""Mixing sources to target weights by capped water-filling.

Sources get a share of ``share * (all words)`` by weight. A source whose share is above ``max_epochs`` times
its words is clamped there and the excess goes to the others by weight, until none is above. Each document is
then taken as often as its source's target has whole epochs, and the rest of the target takes a seeded
sample of documents once more: those whose hash comes first, until their words reach the rest.

Null texts have no words; null sources are one source, last in order; rows with equal ids share one fate
(null ids: rows with equal texts); an empty table gives an empty plan. Very long texts count whole. Documents whose hashes tie are taken or left together; the same seed gives the
same mix in any run and partitioning. Columns of other names are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import BROADCAST_ROWS, cut, join_small, table

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"
#: Leading hex digits of the sampling key that pre-aggregate a source: 65536 buckets.
PREFIX = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """32 hex digits, the same in any run: of the id, or of the text where the id is null."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))))


def _ranked(sources: DataFrame) -> DataFrame:
    """A running number from 0 in code point order, nulls last, without a global sort in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = cut(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(offsets), "_part").withColumn("rank", local + F.col("_before")).drop("_part", "_before")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to rows of (source, weight, source_size). Each round is one small aggregate."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        n, full, weight = sources.agg(
            F.count_if(over), F.sum(F.when(over, cap).otherwise(F.lit(0.0))), F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("weight")))
        ).first()
        if n == clamped or not weight:
            break
        level, clamped = (total - full) / weight, n
    return sources.withColumn("target", F.least(cap, F.lit(level or 0.0) * F.col("weight")) if weight else cap)


def _cut_keys(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source the largest sampling key that is taken once more, found over buckets of keys first."""
    same = F.col("b.source").eqNullSafe(F.col("t.source"))
    buckets = sized.groupBy("source", F.substring("key", 1, PREFIX).alias("bucket")).agg(F.sum("size").alias("n"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("after", F.sum("n").over(running))
    edge = buckets.alias("b").join(targets.alias("t"), same).where((F.col("after") - F.col("n") <= F.col("rest")) & (F.col("rest") < F.col("after")))
    edge = cut(edge.select("b.source", "bucket", (F.col("after") - F.col("n")).alias("before"), "rest"))
    small = F.broadcast(edge) if edge.count() <= BROADCAST_ROWS else edge
    keyed = sized.withColumn("bucket", F.substring("key", 1, PREFIX)).alias("d").join(
        small.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.bucket"))
    )
    keys = keyed.groupBy("e.source", "e.bucket", "before", "rest", "key").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("n").over(order) - F.col("n") / 2
    taken = keys.withColumn("taken", middle <= F.col("rest"))
    return taken.groupBy("source", "bucket").agg(F.max(F.when(F.col("taken"), F.col("key"))).alias("last")).select(
        "source", F.coalesce("last", "bucket").alias("cut_key")
    )


def plan(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(sources, sized): per source its size, target, whole epochs and cut key; per document id, size and key."""
    sized = cut(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        sampling_key(F.col(id_col), F.col(text_col), seed).alias("key"),
    ))
    ranked = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = water_fill(cut(ranked.withColumn("weight", weight)), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = _cut_keys(sized, filled)
    joined = filled.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return joined.select("t.source", "source_size", "target", "whole", "cut_key"), sized


def with_repeats(rows: DataFrame, sources: DataFrame, source_col: str, key: Column) -> DataFrame:
    """Adds source_size, target and repeats to rows by their source and sampling key."""
    null = F.lit("\0null")  # joins take no null keys; a real source of this name would have to hold the NUL
    small = sources.withColumn("_source", F.coalesce("source", null)).drop("source")
    out = join_small(rows.withColumn("_source", F.coalesce(F.col(source_col), null)).withColumn("_key", key), small, ["_source"])
    more = F.coalesce(F.col("_key") <= F.col("cut_key"), F.lit(False)).cast("long")
    return out.withColumn("repeats", F.col("whole") + more).drop("_source", "_key", "whole", "cut_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, in the columns of ``docs``."""
    sources, _ = plan(docs, **options)
    key = sampling_key(F.col(options.get("id_col", "doc_id")), F.col(options.get("text_col", "text")), options.get("seed", SEED))
    kept = docs.columns
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(options.get("source_col", "source")).alias("s"), key.alias("k"))
    dealt = with_repeats(renamed, sources, "s", F.col("k")).where(F.col("repeats") > 0)
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


def op1_mix_sources(spark, sf_dir) -> DataFrame:
    """Size, source, target and taken words of every document."""
    sources, sized = plan(table(spark, sf_dir, "documents"))
    out = with_repeats(sized, sources, "source", F.col("key"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


#: The clamped sources are a prefix in order of cap over weight; the first feasible prefix gives the level.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, md5(text), '')) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources),
steps AS (
  SELECT *, sum(cap) OVER w - cap AS full_before, sum(weight) OVER () - (sum(weight) OVER w - weight) AS weight_left
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max((total - full_before) / weight_left) FILTER ((total - full_before) / weight_left * weight <= cap) AS level FROM steps),
filled AS (
  SELECT *, least(cap, level * weight) AS target FROM weighed, level),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM filled),
keys AS (SELECT source, key, sum(size) AS n FROM sized GROUP BY ALL),
running AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) AS after FROM keys),
taken AS (
  SELECT r.source, r.key, p.source_size, p.target, p.whole,
         p.whole + (r.n > 0 AND r.after - r.n / 2.0::DOUBLE <= p.target - p.whole * p.source_size)::BIGINT AS repeats
  FROM running r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.size, t.source_size, t.target, t.repeats * s.size AS taken
FROM sized s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.key = t.key
"""

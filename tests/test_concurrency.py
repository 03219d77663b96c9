"""Limits of calls against a plain loop: over spans and chunks, with nulls, ties and odd parameters."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import jobs


def loop(calls, start, least, most, window, tolerance, cooldown):
    limit, wins, total, mean, hold, out = start, 0, 0.0, None, 0, []
    for _, _, ok, pressure, ms in calls:
        wins, total = (wins + 1, total + ms) if ok else (0, 0.0)
        full = wins >= window
        if pressure:
            limit = max(limit // 2, least)
        elif full and (mean is None or total / window <= mean * tolerance) and hold <= 0:
            limit = min(limit + 1, most)
        if full:
            wins, total, mean = 0, 0.0, total / window
        hold = cooldown if pressure else max(hold - 1, 0)
        out.append(limit)
    return out


@pytest.mark.parametrize("rule", [(2, 1, 16, 4, 1.2, 3), (9, 2, 5, 1, 0.9, 0), (1, 3, 7, 3, 1.0, 6)])
def test_limits_against_a_loop(spark, rule):
    rng = random.Random(3)
    rows = [(e, rng.choice([None, *range(0, 90_000, 7)]), i, rng.choice([True, True, True, None, False]), rng.choice([False, False, False, None, True]), rng.random() * 9) for i in range(700) for e in (None, 5)]
    rows += [(8, i, i, True, False, 1.0) for i in range(900)]  # one run through all spans and chunks
    df = spark.createDataFrame(rows, "endpoint long, s long, event_id long, ok boolean, pressure boolean, ms double").withColumn("ts", F.timestamp_seconds("s"))
    got = jobs.concurrency_limits(df, *rule, span_us=600_000_000, chunk=16).collect()
    for key in (None, 5, 8):
        calls = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        mine = sorted((r["n"], r["limit"]) for r in got if r["endpoint"] == key)
        assert mine == list(enumerate(loop(calls, *rule)))


def test_one_long_endpoint(spark):
    """400,000 calls of one endpoint; a list that grows call by call takes hours."""
    calls = spark.range(400_000).select(F.lit(1).alias("endpoint"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 9 > 0).alias("ok"), (F.col("id") % 9 == 0).alias("pressure"), F.lit(1.0).alias("ms"))
    out = jobs.concurrency_limits(calls).agg(F.count(F.lit(1)), F.max("n"), F.min("limit"), F.max("limit")).first()
    assert tuple(out) == (400_000, 399_999, 1, 3)

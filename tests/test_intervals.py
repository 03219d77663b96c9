"""Interval joins against all pairs, and what a large document costs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import layout
from sparkfolio.operators.intervals import overlaps


def spans(rng, n, docs=4):
    out = []
    for i in range(n):
        a = rng.randrange(-50, 4000)
        out.append((rng.randrange(docs) if rng.random() < 0.95 else None, i, None if rng.random() < 0.03 else a, a + rng.choice([0, 1, 2, 7, 8, 9, 64, 100, 511, 3000, -3])))
    return out


@pytest.mark.parametrize("small", [0, 40, 10_000])
def test_pairs_are_those_of_all_pairs(spark, small):
    rng = random.Random(small)
    left, right = spans(rng, 250), spans(rng, 200)
    left.append(left[0])
    schema = "doc long, id long, start long, end long"
    got = overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["doc"], small=small).select(F.col("l.id"), F.col("r.id").alias("other")).collect()
    fine = lambda x: x[0] is not None and x[2] is not None and x[3] >= x[2]
    want = [(a[1], b[1]) for a in left for b in right if fine(a) and fine(b) and a[0] == b[0] and a[2] < b[3] and a[3] > b[2]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500


def test_keys_of_several_columns_and_empty_sides(spark):
    rows = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 3, 9)], "x int, y string, start int, end int")
    assert overlaps(rows, rows, ["x", "y"]).count() == 2
    assert overlaps(rows, rows, ["x"], small=0).count() == 4
    assert overlaps(rows.limit(0), rows, ["x"]).count() == 0 and overlaps(rows, rows.limit(0), ["x"]).count() == 0


def test_a_document_of_a_million_blocks_is_many_groups(spark):
    n = 1_000_000
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("order"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    asked = spark.range(0, n // 100).select(F.lit(1).alias("doc_id"), F.col("id").alias("question_id"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 995).alias("end"))
    out = layout.items_in_span(items, asked)
    assert out.count() == n
    tasks = overlaps(items, asked, ["doc_id"]).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < n


def test_blocks_between_the_first_and_the_last_hit(spark):
    items = spark.createDataFrame([(1, 0, 0, 5), (1, 1, None, None), (1, 2, 6, 9), (1, 3, 20, 30)], "doc_id int, order int, start int, end int")
    asked = spark.createDataFrame([(1, "q", 2, 8), (1, "r", 30, 40), (2, "s", 0, 9)], "doc_id int, question_id string, start int, end int")
    assert sorted(tuple(r) for r in layout.items_in_span(items, asked).collect()) == [(1, "q", 0), (1, "q", 1), (1, "q", 2)]


def test_images_in_options_parts_and_stems(spark):
    schema = "doc_id int, kind string, target_id int, start int, end int"
    held = spark.createDataFrame([(1, "stem", 1, 0, 100), (1, "part", 2, 10, 50), (1, "option", 3, 20, 30), (1, "option", 4, 15, 30)], schema)
    images = spark.createDataFrame([(1, 1, 25, True), (1, 2, 40, False), (1, 3, 99, None), (1, 4, 100, True), (2, 5, 5, True), (1, 6, None, True)], "doc_id int, image_id int, start int, has_box boolean")
    got = {r["image_id"]: (r["kind"], r["target_id"], r["auto"]) for r in layout.place_images_by_offset(images, held).collect()}
    assert got == {1: ("option", 4, True), 2: ("part", 2, False), 3: ("stem", 1, False), 4: ("unassigned", None, False), 5: ("unassigned", None, False), 6: ("unassigned", None, False)}


def test_few_large_keys_are_broadcast(spark):
    rows = spark.createDataFrame([("a", i, i + 3) for i in range(40)] + [("b", 1, 9)], "doc string, start long, end long")
    out = overlaps(rows, rows, ["doc"], small=8)
    assert out.count() == overlaps(rows, rows, ["doc"]).count()
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()

"""Stored tables: versions, refusals, failures, rollback; pruning by owner; pages at any depth."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from sparkfolio.sources import store

SCHEMA = "task_id int, id int, text string"
ROWS = [(t, i, f"text {t} {i}") for t in range(20) for i in range(t % 4 + 1)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def kept(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store", buckets=4)
    df = spark.createDataFrame(ROWS, SCHEMA)
    made, refused = s.commit(df, df.select("task_id", F.lit(None).cast("string").alias("token")).distinct(), "import")
    assert made.number == 1 and refused.count() == 0
    return s


def test_of_two_writers_with_one_token_the_second_is_refused(spark, kept):
    seen, token = kept.head(), kept.tokens().where("task_id = 5")
    token.cache().count()
    _, refused = kept.commit(spark.createDataFrame([(5, 9, "first")], SCHEMA), token, "edit", seen)
    assert rows(refused) == []
    made, refused = kept.commit(spark.createDataFrame([(5, 9, "second")], SCHEMA), token, "edit", seen)  # began before the first was done
    assert rows(refused) == [(5,)] and made.number == 3
    assert rows(kept.read()) == sorted([r for r in ROWS if r[0] != 5] + [(5, 9, "first")])
    assert rows(kept.read(kept.version(1))) == sorted(ROWS)


def test_writers_of_different_tasks_both_win(spark, kept):
    seen, tokens = kept.head(), kept.tokens().cache()
    tokens.count()
    for t in (3, 4, 7):
        assert rows(kept.commit(spark.createDataFrame([(t, 0, "new")], SCHEMA), tokens.where(f"task_id = {t}"), "edit", seen)[1]) == []
    assert rows(kept.read()) == sorted([r for r in ROWS if r[0] not in (3, 4, 7)] + [(t, 0, "new") for t in (3, 4, 7)])


def test_a_failed_commit_leaves_the_version_before(spark, kept):
    broken = spark.createDataFrame([(1, 0, "x")], SCHEMA).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        kept.commit(broken, kept.tokens().where("task_id = 1"))
    assert kept.head().number == 1 and rows(kept.read()) == sorted(ROWS)
    assert kept.files.names(f"{kept.root}/manifests") == [f"{1:012d}"]


def test_tasks_come_and_go_and_untouched_buckets_are_kept(spark, kept):
    first = kept.head()
    gone = kept.tokens().where("task_id = 2")
    new = spark.createDataFrame([(99, None)], "task_id int, token string")
    made, refused = kept.commit(spark.createDataFrame([(99, 1, None)], SCHEMA), gone.unionByName(new))
    assert rows(refused) == [] and rows(kept.read().where("text is not null")) == sorted(r for r in ROWS if r[0] != 2)
    assert kept.read().where("task_id = 99").count() == 1
    assert 0 < sum(first.buckets.get(b) == p for b, p in made.buckets.items()) < 4
    assert rows(kept.commit(spark.createDataFrame([(99, 2, "x")], SCHEMA), new)[1]) == [(99,)]  # it has rows by now


def test_rollback_is_a_manifest(spark, kept):
    kept.commit(spark.createDataFrame([(1, 0, "x")], SCHEMA), kept.tokens().where("task_id = 1"), "canonicalization")
    kept.commit(spark.createDataFrame([(6, 0, "y")], SCHEMA), kept.tokens().where("task_id = 6"), "edit")
    data = kept.files.names(f"{kept.root}/data")
    back = kept.rollback(kept.before_last("canonicalization"))
    assert back.number == 4 and rows(kept.read()) == sorted(ROWS) and kept.files.names(f"{kept.root}/data") == data
    assert (6, 0, "y") in rows(kept.read(kept.version(3)))
    with pytest.raises(ValueError):
        kept.before_last("import")


def test_nothing_committed(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/none")
    assert s.head().number == 0
    with pytest.raises(ValueError):
        s.read()


def test_owners_prune_partitions_at_run_time(spark, tmp_path):
    files = spark.range(4000).select(F.element_at(F.array(F.lit("paper"), F.lit("answer")), (F.col("id") % 2 + 1).cast("int")).alias("business_type"), (F.col("id") % 500).alias("business_id"), F.col("id").alias("file_id"))
    path = f"file://{tmp_path}/files"
    store.write_owned(files, path, 8)
    owners = spark.createDataFrame([("paper", 4, "x"), ("paper", 8, "y"), ("answer", 4, "y")], "business_type string, business_id long, kind string")
    owners.write.parquet(f"file://{tmp_path}/owners")
    out = store.owned_by(spark, path, spark.read.parquet(f"file://{tmp_path}/owners").where("kind = 'x'"), 8)
    assert sorted(r.file_id for r in out.collect()) == list(range(4, 4000, 500))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    held = spark.read.parquet(path).where("business_type = 'paper'").select("id_bucket").distinct().collect()
    mine = spark.range(1).select(F.pmod(F.xxhash64(F.lit(4).cast("long")), F.lit(8))).first()[0]
    for r in held:  # what isn't the owner's is never opened
        if r.id_bucket != mine:
            shutil.rmtree(f"{tmp_path}/files/business_type=paper/id_bucket={r.id_bucket}")
    assert store.owned_by(spark, path, owners.where("kind = 'x'"), 8).count() == 8


def test_pages_read_their_ranges_alone(spark, tmp_path):
    rng = random.Random(1)
    listed = [(i, rng.choice([None, *range(50)])) for i in range(3000)]
    df = spark.createDataFrame(listed, "id int, score int").repartition(6)
    path = f"file://{tmp_path}/pages"
    store.write_pages(df, path, [("score", True), ("id", False)], 6)
    want = sorted(listed, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for page, size in ((1, 10), (0, 10), (7, 400), (300, 10), (8, 400), (9, 400), (2, 2999)):
        got = [tuple(r) for r in store.read_page(spark, path, page, size).collect()]
        assert got == [(*r, 3000) for r in want[max(page - 1, 0) * size : max(page, 1) * size]]
    sizes = {r.part: r["count"] for r in spark.read.parquet(f"{path}/_sizes").collect()}
    assert len(sizes) > 1
    for part in sorted(sizes)[:-1]:
        shutil.rmtree(f"{tmp_path}/pages/part={part}")
    assert [tuple(r) for r in store.read_page(spark, path, 300, 10).collect()] == [(*r, 3000) for r in want[-10:]]

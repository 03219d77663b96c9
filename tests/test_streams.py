"""Streams over all input available give what their batch forms give."""

from pyspark.sql import functions as F

from sparkfolio.operators import jobs
from sparkfolio.plans import jobs_queries, views
from sparkfolio.streaming import jobs as streams

SF = "/root/testdata/sf0.001"


def test_fold_steps(spark, tmp_path):
    stream = streams.event_stream(spark, f"{SF}/events.parquet")
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "running").when(kind == "click", "skipped").when(kind == "purchase", "success").otherwise("failed")
    steps = stream.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 12).alias("step"), status.alias("status"), "ts", "event_id")
    got = streams.run_available(streams.fold_steps(steps), f"file://{tmp_path}", "update").drop("_batch")
    want = jobs_queries.fold_step_events(spark, SF).select("job_id", "step", "status", "started_us", "finished_us")
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(got) == key(want) and want.count() > 50


def test_deliveries(spark, tmp_path):
    attempts = streams.event_stream(spark, f"{SF}/events.parquet").select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") == "purchase").alias("success"))
    got = streams.run_available(streams.deliveries(attempts), f"file://{tmp_path}", "update").select("key", "status", "attempt", "due_us")
    batch = jobs.delivery_outcome(views.callbacks(spark, SF).withColumn("key", F.col("user_id")))
    want = batch.select("key", "status", F.col("attempt").cast("long").alias("attempt"), F.unix_micros("next_retry_at").alias("due_us"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blank_keys_pass_and_repeats_go(spark, tmp_path):
    stream = streams.event_stream(spark, f"{SF}/events.parquet").withColumn("idempotency_key", F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(""))
    got = streams.run_available(streams.idempotent_events(stream, "3650 days"), f"file://{tmp_path}")
    rows = views.callbacks(spark, SF).withColumn("idempotency_key", F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(""))
    assert got.count() == jobs.idempotent_events(rows).count()


def test_many_keys_share_few_states(spark, tmp_path, monkeypatch):
    """Two batches of more keys than groups; nulls among keys and times; as many state rows as groups."""
    rows = spark.range(6000).select(F.when(F.col("id") % 97 > 0, F.col("id") % 2500 + (1 << 60)).alias("job_id"), (F.col("id") % 2).alias("step"), F.when(F.col("id") % 3 == 0, "running").otherwise("success").alias("status"), F.when(F.col("id") % 89 > 0, F.timestamp_seconds("id")).alias("ts"), F.col("id").alias("event_id"))
    made = lambda: streams.fold_steps(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for part in ("id < 3000", "id >= 3000"):
        rows.where(part.replace("id", "event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = streams.run_available(made(), f"file://{tmp_path}/run", "update")
    got = out.groupBy("job_id", "step").agg(F.max_by(F.struct("status"), "_batch")["status"].alias("status"))
    want = rows.groupBy("job_id", "step").agg(F.max_by("status", F.struct(F.col("event_id") >= 3000, "ts", "event_id")).alias("status"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    state = spark.read.format("statestore").load(f"file://{tmp_path}/run/checkpoint")
    assert state.count() <= 1024 < got.count()

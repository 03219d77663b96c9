"""Live tables: the same rows however events come in batches, late events and restarts included; timers without input; state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import jobs
from sparkfolio.streaming import live

T0 = 1_700_000_000_000_000
STATUS = ("pending", "running", "running", "skipped", "success", "failed")
SCHEMA = "job_id long, step long, status string, us long, event_id long, success boolean"


def events(seed, n, keys=9):
    rng, out, at = random.Random(seed), [], T0
    for i in range(n):
        at += rng.choice([0, 1_000, 2_000_000, 9_000_000, 45_000_000])
        out.append((rng.randrange(keys), rng.randrange(5), rng.choice(STATUS), at, i, rng.random() < 0.2))
    return out


def files(rows, parts, seed):
    """The rows in files, in order but for neighbours within half a minute."""
    rng = random.Random(seed)
    moved = sorted(rows, key=lambda r: r[3] + rng.randrange(30_000_000))
    size = -(-len(moved) // parts)
    return [moved[at : at + size] for at in range(0, len(moved), size)]


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    df.coalesce(1).write.mode("append").parquet(folder)
    return df


def stream(spark, folder):
    return spark.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, tmp_path, made, parts, name="s"):
    """Runs a live table file by file, and stops and restarts it after each but the last."""
    source, target = f"file://{tmp_path}/{name}-in", f"file://{tmp_path}/{name}-out"
    for part in parts:
        put(spark, source, part)
        out = live.run_live(made(stream(spark, source)), target)
    return out


def passed(rows, delay_ms):
    limit = max(r[3] for r in rows) // 1000 - delay_ms
    return [r for r in rows if r[3] // 1000 < limit], limit


def flow_of(spark, rows):
    steps = jobs.fold_step_events(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")))
    fixed = jobs.repair_stale_steps(steps, F.lit(None).cast("timestamp"))
    told = jobs.flow_summary(fixed).select("job_id", F.col("status").alias("flow_status"), "current_step", "completed", "elapsed_ms")
    shown = fixed.select("job_id", "step", "status", F.unix_micros("started_at").alias("a"), F.unix_micros("finished_at").alias("z"))
    return sorted((tuple(r) for r in shown.join(told, "job_id").collect()), key=repr)


def last_flow(out):
    last = out.groupBy("job_id").agg(F.max("_batch").alias("_batch"))
    rows = out.join(last, ["job_id", "_batch"]).select("job_id", "step", "status", "started_us", "finished_us", "flow_status", "current_step", "completed", "elapsed_ms")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_flow_over_batches_restarts_and_late_events(spark, tmp_path):
    rows = events(1, 260)
    parts = files(rows, 3, 2)
    late = [(0, 0, "failed", T0 - 10**12, 10_000, False), (77, 1, "running", T0 - 10**12, 10_001, False)]
    out = run(spark, tmp_path, lambda s: live.live_flow(s, "1 minute"), [parts[0], parts[1], parts[2] + late])
    want = flow_of(spark, passed(rows, 60_000)[0])
    assert last_flow(out) == want
    assert any(r[2] == "skipped" and r[3] is not None for r in want) and out.select("_batch").distinct().count() >= 2


def test_a_running_step_is_closed_by_time_alone(spark, tmp_path):
    other = [(2, 0, "running", T0 + 7_200_000_000, 3, False)]
    rows = [(1, 0, "running", T0, 0, False), (1, 2, "running", T0 + 5_000_000, 1, False), (1, 2, "success", T0 + 9_000_000, 2, False)]
    out = run(spark, tmp_path, lambda s: live.live_flow(s, "1 minute"), [rows, other])
    got = {tuple(r) for r in out.where("job_id = 1").select("step", "status", "finished_us", "flow_status", "completed").collect()}
    assert got == {(0, "skipped", T0 + 5_000_000, "success", 2), (2, "success", T0 + 9_000_000, "success", 2)}


def test_state_of_silent_jobs_goes(spark, tmp_path):
    day = 86_400_000_000
    first = [(1, s, "running", T0 + s, s, False) for s in range(5)]
    parts = [first, [(2, 0, "pending", T0 + day, 10, False)], [(2, 0, "pending", T0 + 2 * day, 11, False)], [(1, 3, "success", T0 + 2 * day, 12, False), (2, 0, "running", T0 + 3 * day, 13, False)]]
    out = run(spark, tmp_path, lambda s: live.live_flow(s, "1 minute", keep_ms=3_600_000), parts)
    last = out.where("job_id = 1").groupBy("_batch").agg(F.sort_array(F.collect_list("step")).alias("s")).orderBy("_batch").collect()
    assert [r["s"] for r in last] == [[0, 1, 2, 3, 4], [3]]
    kept = run(spark, tmp_path, lambda s: live.live_flow(s, "1 minute"), parts, "kept").where("job_id = 1")
    assert kept.groupBy("_batch").count().orderBy("_batch").collect()[-1]["count"] == 5


def test_retries_fall_due_as_in_batch(spark, tmp_path):
    rows = events(3, 200, keys=30)
    parts = files(rows, 3, 4)
    source, target, seen = f"file://{tmp_path}/in", f"file://{tmp_path}/out", []
    for part in parts:
        put(spark, source, part)
        out = live.run_live(live.live_retries(stream(spark, source).withColumnRenamed("job_id", "key"), "1 minute"), target)
        seen += part
        known, limit = passed(seen, 60_000)
        state = jobs.delivery_outcome(spark.createDataFrame(known, SCHEMA).select(F.col("job_id").alias("key"), F.timestamp_micros("us").alias("ts"), "event_id", "success"))
        table = state.select(F.col("key").alias("event_id"), "status", "next_retry_at", F.col("attempt").alias("retry_count"))
        now = F.timestamp_millis(F.lit(limit - 1)) + F.expr("INTERVAL 999 MICROSECONDS")
        due = {(r["event_id"], r["retry_count"]) for r in jobs.callback_due(table, now, 99).collect()}
        dead = {r["key"] for r in state.where("status = 'dead_letter'").collect()}
        latest = {r["key"]: r["attempt"] for r in state.collect()}
        told = [tuple(r) for r in out.select("key", "status", "attempt").collect()]
        assert len(told) == len(set(told))
        assert {(k, n) for k, s, n in told if s == "due" and latest[k] == n} == due
        assert {k for k, s, _ in told if s == "dead_letter"} == dead
    assert dead and due


@pytest.mark.parametrize("parts", [1, 3])
def test_reuse_of_two_streams(spark, tmp_path, parts):
    rows = events(5, 240, keys=4)
    within = 60_000_000

    def made(s):
        named = s.select(F.col("event_id").alias("id"), F.col("job_id").alias("hash"), "ts", "success")
        return live.live_reuse(named.where("not success"), named.where("success"), within, "1 minute")

    out = run(spark, tmp_path, made, files(rows, parts, 6), f"p{parts}")
    known = spark.createDataFrame(passed(rows, 60_000)[0], SCHEMA).select(F.col("event_id").alias("id"), F.col("job_id").alias("hash"), F.timestamp_micros("us").alias("ts"), "success")
    want = jobs.reuse_within(known.where("not success"), known.where("success"), within)
    got = sorted(tuple(r) for r in out.select("id", "hash", F.coalesce("cached_from", F.lit(-1))).collect())
    assert got == sorted(tuple(r) for r in want.select("id", "hash", F.coalesce("cached_from", F.lit(-1))).collect())
    assert len({c == -1 for _, _, c in got}) == 2


def test_reuse_within_against_brute_force(spark):
    rows = events(7, 300, keys=3)
    within = 30_000_000
    known = spark.createDataFrame(rows, SCHEMA).select(F.col("event_id").alias("id"), F.col("job_id").alias("hash"), F.timestamp_micros("us").alias("ts"), "success")
    got = {r["id"]: r["cached_from"] for r in jobs.reuse_within(known.where("not success"), known.where("success"), within).collect()}
    for key, _, _, us, i, ok in rows:
        if not ok:
            found = [(u, j) for k, _, _, u, j, good in rows if good and k == key and us - within <= u <= us]
            assert got[i] == (max(found)[1] if found else None)


def test_many_keys_share_few_states(spark, tmp_path):
    """More keys than groups, keys and ids beyond what a float holds; as many state rows as groups."""
    big = 1 << 60
    rows = [(big + i, 0, "running", T0 + i * 1000, big + i, False) for i in range(1500)] + [(7, 0, "running", T0 + 10**10, 1, False)]
    out = run(spark, tmp_path, lambda s: live.live_retries(s.withColumnRenamed("job_id", "key"), "1 minute"), [rows])
    assert sorted(tuple(r) for r in out.select("key", "status", "attempt", "due_us").collect()) == [(r[0], "due", 1, r[3] + 5_000_000) for r in rows[:-1]]
    state = spark.read.format("statestore").option("stateVarName", "known").load(f"file://{tmp_path}/s-out/checkpoint")
    assert 0 < state.count() <= 1024

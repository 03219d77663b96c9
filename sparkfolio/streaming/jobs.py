"""Streaming forms of the job operators: idempotent events, flows of steps, deliveries, call metrics and sessions.

Event time is ``ts``; state is bounded by watermarks or by key. Each form, run over all input available, gives what its batch form gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkfolio.operators.jobs import TERMINAL, given
from sparkfolio.streaming.packed import bucket, frame, pack, unpack


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return (stream.load(folder, format="parquet", pathGlobFilter=name) if name.endswith(".parquet") else stream.parquet(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark; events of blank keys all pass."""
    timed = events.withWatermark("ts", delay)
    keyed = timed.where(given(F.col("idempotency_key"))).dropDuplicatesWithinWatermark(["idempotency_key"])
    return keyed.unionByName(timed.where(~given(F.col("idempotency_key"))))


def call_windows(calls: DataFrame, size: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Calls, failures and time per window and route."""
    w = F.window("ts", size)
    return calls.withWatermark("ts", delay).groupBy(w, "route").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("ms").alias("ms")).select(F.col("window.start").alias("start"), "route", "calls", "failed", "ms")


def job_sessions(steps: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a job: its events with no gap of ``gap`` between them."""
    s = F.session_window("ts", gap)
    return steps.withWatermark("ts", delay).groupBy(s, "job_id").agg(F.count(F.lit(1)).alias("events")).select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


#: Stands for null in whole numbers, which pandas would make floats; first in order, as null is in the batch forms.
_NULL = -(1 << 63)
_STEP = {"job_id": "long", "step": "long", "status": "string", "start": "long", "finish": "long"}
_DELIVERY = {"key": "long", "status": "string", "attempt": "long", "due": "long"}


def _whole(*names: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("long"), F.lit(_NULL)).alias(c) for c in names]


def _in_order(batches: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
    return zip(*(rows[c].tolist() for c in (*names, "us")), strict=True)


def _named(key: int) -> int | None:
    return None if key == _NULL else key


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = {r[:2]: r[2:] for r in unpack(state.get[0])} if state.exists else {}
    touched = {}
    for job, step, now, us in _in_order(batches, "job_id", "step", "status"):
        at, place = _named(us), (job, step)
        status, start, end = known.get(place, ("pending", None, None))
        if now == "running":
            status, start, end = now, start if start is not None else at, None
        elif now in TERMINAL:
            status, end = now, at
        else:
            status, start, end = now, None, None
        known[place] = touched[place] = status, start, end
    state.update((pack([(*k, *v) for k, v in known.items()], _STEP),))
    rows = [(_named(k[0]), _named(k[1]), *v) for k, v in touched.items()]
    yield frame(rows, ["job_id", "step", "status", "started_us", "finished_us"], {"job_id", "step", "started_us", "finished_us"})


def fold_steps(steps: DataFrame) -> DataFrame:
    """The current row of each job's step (update mode): state is one small tuple a job and step, those of a group of keys together."""
    out = "job_id long, step long, status string, started_us long, finished_us long"
    rows = steps.select(*_whole("job_id", "step", "event_id"), "status", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NULL)).alias("us"))
    return rows.withColumn("bucket", bucket(F.col("job_id"), F.col("step"))).groupBy("bucket").applyInPandasWithState(_fold, out, "rows binary", "update", GroupStateTimeout.NoTimeout)


def _deliver(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = {r[0]: r[1:] for r in unpack(state.get[0])} if state.exists else {}
    touched = {}
    for name, ok, us in _in_order(batches, "key", "success"):
        status, attempt, due = known.get(name, ("pending", 0, None))
        if status not in ("sent", "dead_letter"):
            attempt += 1
            status = "sent" if ok else "dead_letter" if attempt >= 5 else "failed"
            due = us + 1_000_000 * min(60, 5 * attempt) if status == "failed" and us != _NULL else None
        known[name] = touched[name] = status, attempt, due
    state.update((pack([(k, *v) for k, v in known.items()], _DELIVERY),))
    yield frame([(_named(k), *v) for k, v in touched.items()], ["key", "status", "attempt", "due_us"], {"key", "attempt", "due_us"})


def deliveries(attempts: DataFrame) -> DataFrame:
    """The delivery state of each event key after its attempts (update mode); states of a group of keys are kept together."""
    rows = attempts.select(*_whole("key", "event_id"), F.coalesce("success", F.lit(False)).alias("success"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NULL)).alias("us"))
    return rows.withColumn("bucket", bucket(F.col("key"))).groupBy("bucket").applyInPandasWithState(_deliver, "key long, status string, attempt long, due_us long", "rows binary", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all input available into Parquet below ``folder``; update streams append their batches' last rows."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")

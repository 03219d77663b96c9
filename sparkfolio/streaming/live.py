"""Live tables of jobs, with state and event-time timers: flows of steps, retries that fall due, cached results.

Rows of a key wait in its state until the watermark has passed them and are then applied in order of time and id. So what a stream emits depends on the events
and the watermark alone, not on how they came in batches; rows later than the watermark are dropped, as Spark does. Timers fire when the watermark passes
them, also without input of their key. Keys are dealt into ``packed.BUCKETS`` groups: a group's rows and states are a few Arrow blobs, read and written as a whole, since a call and a state
of its own for each key cost more than its events. Times in rows are microseconds (``us``) beside the event time ``ts``; state stores are RocksDB's, kept in the checkpoint,
so a restarted stream goes on where it stopped. Rows whose ts is null have no place in event time and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkfolio.operators.jobs import TERMINAL
from sparkfolio.streaming.packed import bucket, frame, pack, pack_columns, unpack

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them; ``ready`` then gets a key's in order. A timer at the first waiting row, or at what ``ready`` asks for, wakes the group."""

    #: A waiting row: its key's columns, then its time, its id and others; names are columns of the input.
    waits: dict[str, str]
    #: How many columns the key has.
    n_key: int = 1
    #: A row of a key's state, after the key's columns and the time of its wake.
    holds: dict[str, str]
    #: Columns of the output.
    gives: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.known = handle.getValueState("known", "rows binary")
        self.keeps = {c: t for c, t in list(self.waits.items())[: self.n_key]} | {"wake": "long"} | self.holds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendValue((pack_columns({c: part[c] for c in self.waits}, self.waits),))
            low = int(part["us"].min())
            first = low if first is None else min(first, low)
        self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, n = timerValues.getCurrentWatermarkInMs(), self.n_key
        rows = [r for (blob,) in self.waiting.get() for r in unpack(blob)] if self.waiting.exists() else []
        passed: dict[tuple, list[tuple]] = {}
        left = []
        for r in rows:
            if r[n] // 1000 < now:
                passed.setdefault(r[:n], []).append(r[n:])
            else:
                left.append(r)
        if passed:
            if left:
                self.waiting.put([(pack(left, self.waits),)])
            else:
                self.waiting.clear()
        waits_on = {r[:n] for r in left}
        held = self.known.get()
        states: dict[tuple, list[tuple]] = {}
        for r in unpack(held[0]) if held is not None else ():
            states.setdefault(r[:n], []).append(r[n:])
        out, changed = [], bool(passed)
        for k in [*passed, *(k for k, state in states.items() if k not in passed and state[0][0] <= now)]:
            rows, wake, state = self.ready(k, sorted(passed.get(k, ())), now, k in waits_on, [r[1:] for r in states.get(k, ())])
            out += rows
            new = [(wake, *r) for r in state]
            changed |= new != states.get(k, [])
            if new:
                states[k] = new
            else:
                states.pop(k, None)
        if changed:
            if states:
                self.known.update((pack([(*k, *r) for k, state in states.items() for r in state], self.keeps),))
            else:
                self.known.clear()
        wakes = [r[n] // 1000 for r in left] + [state[0][0] for state in states.values()]
        if wakes:
            self.handle.registerTimer(max(min(wakes), now))
        if out:
            yield frame(out, list(self.gives), {c for c in self.gives if c not in ("job_id", "key", "hash", "status", "flow_status")})

    def ready(self, key: tuple, rows: list[tuple], now: int, more: bool, state: list[tuple]) -> tuple[list[tuple], int | None, list[tuple]]:
        """(output rows, when the key is to be woken next in milliseconds, its state's rows) after ``rows``; ``more``: some still wait. A state without rows is gone."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def _grouped(rows: DataFrame, *key: Column):
    """Rows in groups of keys."""
    return rows.withColumn("_bucket", bucket(*key)).groupBy("_bucket")


class _Flow(_InOrder):
    waits = {"job_id": "string", "us": "long", "event_id": "long", "step": "long", "status": "string"}
    holds = {"last": "long", "step": "long", "status": "string", "started": "long", "finished": "long"}
    gives = ("job_id", "step", "status", "started_us", "finished_us", "flow_status", "current_step_us", "completed", "elapsed_ms")

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def ready(self, key, rows, now, more, state):
        if not rows:
            last = state[0][0]
            if last + self.keep_ms >= now or more:
                return [], last + self.keep_ms + 1, state
            return [], None, []  # silent for so long that its row is history
        steps = {step: held for _, step, *held in state}
        for us, _, step, status in rows:
            _, started, finished = steps.get(step, ("pending", None, None))
            if status == "running":
                steps[step] = status, us if started is None else started, None
            elif status in TERMINAL:
                steps[step] = status, started, us
            else:
                steps[step] = status, None, None
        last = rows[-1][0] // 1000
        return self.shown(key[0], steps), last + self.keep_ms + 1, [(last, step, *held) for step, held in steps.items()]

    def shown(self, job_id, steps):
        """The job's rows as they stand: a running step before a finished one counts as skipped, since when that one began."""
        rows, later = [], None
        for step in sorted(steps, reverse=True):
            status, started, finished = steps[step]
            if status == "running" and later is not None:
                status, finished = "skipped", later
            elif status in TERMINAL:
                later = started if started is not None else finished
            rows.append((step, status, started, finished))
        rows.reverse()
        first = {}
        for step, status, _, _ in rows:
            first.setdefault(status, step)
        flow = next((s for s in ("failed", "running", "pending") if s in first), "success")
        starts, ends = [r[2] for r in rows if r[2] is not None], [r[3] for r in rows if r[3] is not None]
        elapsed = max(max(ends) // 1000 - min(starts) // 1000, 0) if starts and ends else 0
        done = sum(r[1] in ("success", "skipped") for r in rows)
        return [(job_id, *r, flow, first.get(flow) if flow != "success" else None, done, elapsed) for r in rows]


def live_flow(steps: DataFrame, delay: str = "1 hour", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """The flow table of jobs from step events (job_id, step, status, ts, event_id): all rows of a job, repaired, each time events of it have passed the watermark.

    A row: (job_id, step, status, started_us, finished_us, flow_status, current_step, completed, elapsed_ms). A job's state is one small row a step; it goes when the
    job has been silent for ``keep_ms`` of event time.
    """
    timed = steps.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    rows = timed.select(F.col("job_id").cast("string").alias("job_id"), "step", "status", "event_id", "ts", F.unix_micros("ts").alias("us"))
    schema = "job_id string, step long, status string, started_us long, finished_us long, flow_status string, current_step_us long, completed long, elapsed_ms long"
    out = _grouped(rows, F.col("job_id")).transformWithStateInPandas(_Flow(keep_ms), schema, "Update", "EventTime")
    return out.withColumn("job_id", F.col("job_id").cast(_type(steps, "job_id"))).withColumnRenamed("current_step_us", "current_step")


class _Retry(_InOrder):
    waits = {"key": "string", "us": "long", "event_id": "long", "success": "boolean"}
    holds = {"status": "string", "attempt": "long", "due": "long", "last": "long"}
    gives = ("key", "status", "attempt", "due_us", "at_us")

    def __init__(self, max_attempts: int, keep_ms: int):
        self.max_attempts, self.keep_ms = max_attempts, keep_ms

    def ready(self, key, rows, now, more, state):
        status, attempt, due, last = state[0] if state else ("pending", 0, None, None)
        out = []
        for us, _, success in [*rows, (None, None, None)]:
            if status == "failed" and due // 1000 < now and (us is None or due <= us):  # nothing was tried until then
                status = "due"
                out.append((key[0], status, attempt, due, due))
            if us is None:
                break
            last = us
            if status in ("sent", "dead_letter"):
                continue
            attempt += 1
            status = "sent" if success else "dead_letter" if attempt >= self.max_attempts else "failed"
            due = us + 1_000_000 * min(60, 5 * attempt) if status == "failed" else None
            if status == "dead_letter":
                out.append((key[0], status, attempt, None, us))
        if last // 1000 + self.keep_ms < now and not more and status != "failed":
            return out, None, []
        return out, due // 1000 if status == "failed" else last // 1000 + self.keep_ms + 1, [(status, attempt, due, last)]


def live_retries(attempts: DataFrame, delay: str = "1 minute", max_attempts: int = 5, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """Deliveries to retry and dead letters, from attempts (key, ts, event_id, success), when their time has come: (key, status, attempt, due_us, at_us).

    A failure waits min(60, 5 * attempt) seconds; if the key isn't tried again before, it is emitted as ``due`` once the watermark passes that time, without any input of the
    key. The max_attempts-th failure is a dead letter; nothing follows that or a success. State goes after ``keep_ms`` of silence.
    """
    timed = attempts.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    rows = timed.select(F.col("key").cast("string").alias("key"), "event_id", F.coalesce("success", F.lit(False)).alias("success"), "ts", F.unix_micros("ts").alias("us"))
    out = _grouped(rows, F.col("key")).transformWithStateInPandas(_Retry(max_attempts, keep_ms), "key string, status string, attempt long, due_us long, at_us long", "Update", "EventTime")
    return out.withColumn("key", F.col("key").cast(_type(attempts, "key")))


class _Reuse(_InOrder):
    waits = {"hash": "string", "span": "long", "us": "long", "kind": "long", "id": "long"}
    n_key = 2
    holds = {"id": "long", "us": "long"}
    gives = ("id", "hash", "cached_from_us")

    def __init__(self, within_us: int):
        self.within_us = within_us

    def ready(self, key, rows, now, more, state):
        result, out = state[0] if state else None, []
        for us, kind, row_id in rows:
            if kind == 0:
                result = row_id, us
            else:
                out.append((row_id, key[0], result[0] if result is not None and us - result[1] <= self.within_us else None))
        end = (key[1] + 1) * self.within_us // 1000 + 1
        if end < now and not more or result is None:  # nothing of this span can come any more, or nothing is known
            return out, None, []
        return out, end + 1, [result]


def live_reuse(calls: DataFrame, results: DataFrame, within_us: int, delay: str = "1 hour") -> DataFrame:
    """Calls (id, hash, ts) with the latest result (id, hash, ts) of their hash at most ``within_us`` old (``cached_from``; null: none), from two streams.

    Keys are a hash in one span of time as long as ``within_us``; a result is put into its span and the next, where it is still young enough. So one busy hash is
    many keys over time, and a key's state goes when the watermark passes its span.
    """
    span = F.floor(F.unix_micros("ts") / within_us)
    asked = calls.select("id", "hash", "ts", F.lit(1).cast("long").alias("kind"), span.alias("span"))
    known = results.select("id", "hash", "ts", F.lit(0).cast("long").alias("kind"), F.explode(F.array(span, span + 1)).alias("span"))
    timed = asked.unionByName(known).where(F.col("ts").isNotNull() & F.col("hash").isNotNull()).withWatermark("ts", delay)
    rows = timed.select("id", F.col("hash").cast("string").alias("hash"), "kind", "span", "ts", F.unix_micros("ts").alias("us"))
    out = _grouped(rows, F.col("hash"), F.col("span")).transformWithStateInPandas(_Reuse(within_us), "id long, hash string, cached_from_us long", "Update", "EventTime")
    return out.withColumn("hash", F.col("hash").cast(_type(timed, "hash"))).withColumnRenamed("cached_from_us", "cached_from")


def run_live(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a live table over all input available; what it emitted, with the number of the batch (``_batch``), is a Parquet table below ``folder``.

    Called again with the same folder it takes up the state where it was left. A batch that is repeated after a failure replaces its own part of the table.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode("update")
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/_batch={n}")).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").withColumn("_batch", F.col("_batch").cast("long"))

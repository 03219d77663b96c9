"""Job state and telemetry: status, flows of steps, retries, batches, callbacks and call logs.

Tables are rows of one job, step, item, call or attempt each; folds that depend on order sort within a key's array. Null
and empty texts are "not given". Times are timestamps; differences are in milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The steps of a processing flow in order, and the states of tasks.
FLOW_STEPS = tuple(range(12))
FAILED, RETRY, RUNNING, DONE, PARTIAL, WAITING = "失败", "可重试", "处理中", "已完成", "部分完成", "待校验"
BANKED, REVIEWED = "已入库", "已校验"
TERMINAL = ("success", "failed", "skipped")


def given(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""


def failure_reason(paper_error: Column, answer_error: Column) -> Column:
    """Errors of both sides in lines with their prefix; empty without any."""
    return F.concat_ws("\n", F.when(given(paper_error), F.concat(F.lit("paper: "), F.trim(paper_error))), F.when(given(answer_error), F.concat(F.lit("answer: "), F.trim(answer_error))))


def retryable(flag: Column, retry_count: Column, max_retries: Column) -> Column:
    """The flag if set, else whether the count is below the maximum if both are known, else true."""
    return F.coalesce(flag, retry_count < max_retries, F.lit(True))


def task_status(tasks: DataFrame, questions: DataFrame) -> DataFrame:
    """(task_id, status): failed, running, banked, reviewed and waiting in this order of precedence.

    Failure text or a failed run gives retryable or failed; a running one running; a task without questions its raw status, else
    running; all questions banked done; any reviewed or banked partly done; else waiting.
    """
    counts = questions.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == BANKED).alias("banked"), F.count_if(F.col("status").isin(BANKED, REVIEWED)).alias("reviewed"))
    failed = (F.col("ocr_status") == "failed") | given(failure_reason(F.col("paper_error"), F.col("answer_error")))
    can = retryable(F.col("retry_flag"), F.col("retry_count"), F.col("max_retries"))
    status = (
        F.when(failed, F.when(can, RETRY).otherwise(FAILED)).when(F.col("ocr_status") == "running", RUNNING)
        .when(F.coalesce("n", F.lit(0)) == 0, F.when(given(F.col("raw_status")), F.col("raw_status")).otherwise(RUNNING))
        .when(F.col("banked") == F.col("n"), DONE).when(F.col("reviewed") > 0, PARTIAL).otherwise(WAITING)
    )
    return tasks.join(counts, "task_id", "left").select("task_id", status.alias("status"))


def retry(tasks: DataFrame, default_max: int = 3) -> DataFrame:
    """Failed tasks that may be retried, with their counter one up and the maximum defaulted."""
    reason = failure_reason(F.col("paper_error"), F.col("answer_error"))
    most = F.coalesce("max_retries", F.lit(default_max))
    can = retryable(F.col("retry_flag"), F.col("retry_count"), most)
    return tasks.where(given(reason) & can).select("task_id", (F.coalesce("retry_count", F.lit(0)) + 1).cast("int").alias("retry_count"), most.cast("int").alias("max_retries"))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")), F.lit(0))


def flow_summary(steps: DataFrame) -> DataFrame:
    """Per job: status (failed, running, pending, success in this order), the first step in that state, completed steps and elapsed time.

    steps: (job_id, step, status, started_at, finished_at). Current step is null where all are done.
    """
    first = lambda s: F.min(F.when(F.col("status") == s, F.col("step")))
    agg = steps.groupBy("job_id").agg(
        first("failed").alias("f"), first("running").alias("r"), first("pending").alias("p"), F.count_if(F.col("status").isin("success", "skipped")).alias("completed"),
        F.count(F.lit(1)).alias("steps"), F.min("started_at").alias("started"), F.max("finished_at").alias("finished"),
    )
    status = F.when(F.col("f").isNotNull(), "failed").when(F.col("r").isNotNull(), "running").when(F.col("p").isNotNull(), "pending").otherwise("success")
    return agg.select("job_id", status.alias("status"), F.coalesce("f", "r", "p").alias("current_step"), "completed", "steps", F.coalesce(elapsed_ms(F.col("started"), F.col("finished")), F.lit(0)).alias("elapsed_ms"))


def repair_stale_steps(steps: DataFrame, now: Column) -> DataFrame:
    """A running step before a terminal one becomes skipped, finished when that one started (else finished, else now)."""
    after = Window.partitionBy("job_id").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    later = F.first(F.when(F.col("status").isin(*TERMINAL), F.struct(F.coalesce("started_at", "finished_at").alias("at"))), ignorenulls=True).over(after)
    stale = (F.col("status") == "running") & F.col("_later").isNotNull()
    out = steps.withColumn("_later", later)
    out = out.withColumn("finished_at", F.when(stale, F.coalesce(F.col("_later.at"), now)).otherwise(F.col("finished_at")))
    return out.withColumn("status", F.when(stale, "skipped").otherwise(F.col("status"))).drop("_later")


def finalize_flow(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Open steps of successful jobs (job_id, status, finished_at) become skipped at the job's finish."""
    j = jobs.where(F.col("status") == "success").select("job_id", F.col("finished_at").alias("_done"))
    open_ = F.col("_done").isNotNull() & F.col("status").isin("running", "pending")
    out = steps.join(j, "job_id", "left").withColumn("finished_at", F.when(open_, F.col("_done")).otherwise(F.col("finished_at")))
    return out.withColumn("status", F.when(open_, "skipped").otherwise(F.col("status"))).drop("_done")


def complete_steps(steps: DataFrame, defined: Sequence[int] = FLOW_STEPS) -> DataFrame:
    """Every job with every defined step in order; missing ones are pending. Each job is copied once per step of a fixed list."""
    jobs = steps.select("job_id").distinct().withColumn("step", F.explode(F.array(*[F.lit(s) for s in defined])))
    return jobs.join(steps, ["job_id", "step"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def fold_step_events(events: DataFrame) -> DataFrame:
    """(job_id, step, status, started_at, finished_at) from events (job_id, step, status, ts, event_id) in order of time and id.

    Running keeps the first start of its run; a terminal state sets the finish and keeps the start; another clears both.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "status")))
    none = F.lit(None).cast("timestamp")
    zero = F.struct(F.lit("pending").alias("status"), none.alias("started_at"), none.alias("finished_at"))

    def step(s, e):
        terminal = e["status"].isin(*TERMINAL)
        start = F.when(e["status"] == "running", F.coalesce(s["started_at"], e["ts"])).when(terminal, s["started_at"])
        return F.struct(e["status"].alias("status"), start.cast("timestamp").alias("started_at"), F.when(terminal, e["ts"]).cast("timestamp").alias("finished_at"))

    typed = events.select("job_id", "step", "status", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    folded = typed.groupBy("job_id", "step").agg(ordered.alias("e")).withColumn("s", F.aggregate("e", zero, step))
    return folded.select("job_id", "step", "s.status", "s.started_at", "s.finished_at")


def call_metrics(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls (route, duration_ms, cache_hit) counted and timed, by route class; negative or unreadable durations are 0. With keys: rolled up."""
    ms = F.greatest(F.coalesce(F.expr("try_cast(duration_ms AS DOUBLE)"), F.lit(0.0)), F.lit(0.0))
    aggs = [
        F.count(F.lit(1)).alias("calls"), F.round(F.sum(ms), 6).alias("total_ms"), F.round(F.sum(F.when(F.col("route") == "external", ms).otherwise(F.lit(0.0))), 6).alias("external_ms"),
        F.count_if(F.col("route") == "external").alias("external_calls"), F.count_if(F.col("route") == "local").alias("local_calls"), F.count_if("cache_hit").alias("cache_hits"),
    ]
    return calls.rollup(*keys).agg(*aggs) if keys else calls.agg(*aggs)


def batch_rollup(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Per batch job: item counts and final status. jobs (job_id, status), items (job_id, status, total, review)."""
    counts = items.groupBy("job_id").agg(
        F.sum(F.when(F.col("status") == "success", F.col("total")).otherwise(0)).alias("succeeded"), F.sum(F.when(F.col("status") == "failed", F.col("total")).otherwise(0)).alias("failed"),
        F.sum(F.col("review").cast("int")).alias("review"), F.count_if(F.col("status").isin("success", "failed")).alias("completed"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("succeeded", "failed", "review", "completed")]
    joined = jobs.select("job_id", F.col("status").alias("was")).join(counts, "job_id", "left").select("job_id", "was", *zero)
    status = (
        F.when(F.col("was") == "cancelling", "cancelled").when((F.col("failed") == 0) & (F.col("review") > 0), "partial_review")
        .when(F.col("failed") == 0, "completed").when(F.col("succeeded") == 0, "failed").otherwise("partial_failed")
    )
    return joined.select("job_id", status.alias("status"), "succeeded", "failed", "review", "completed")


def input_hash(*parts: Column) -> Column:
    """SHA-256 of the parts' text joined by a pipe, null being empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def reuse_by_hash(items: DataFrame, history: DataFrame) -> DataFrame:
    """Items (id, hash) with the latest other successful history row (id, hash, status, finished_at) of the same hash: ``cached_from``.

    Two rows a hash are enough to leave the item itself out, so history is reduced to them before the join.
    """
    order = Window.partitionBy("hash").orderBy(F.desc("finished_at"), F.desc("id"))
    good = history.where(F.col("status") == "success").withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2)
    best = good.groupBy("hash").agg(F.max(F.when(F.col("k") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("id"))).alias("second"))
    return items.join(best, "hash", "left").withColumn("cached_from", F.when(F.col("first") == F.col("id"), F.col("second")).otherwise(F.col("first"))).drop("first", "second")


def reuse_within(calls: DataFrame, results: DataFrame, within_us: int) -> DataFrame:
    """Calls (id, hash, ts) with the latest result (id, hash, ts) of their hash that is not after them and at most ``within_us`` old: ``cached_from``.

    A window over a hash's calls and results in one span of time as long as ``within_us``; a result stands in its span and the next, so no busy hash is one partition.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    span = F.floor(F.col("us") / within_us)
    asked = calls.select("id", "hash", us).select("*", F.lit(1).alias("kind"), span.alias("span"))
    known = results.select("id", "hash", us).select("*", F.lit(0).alias("kind"), F.explode(F.array(span, span + 1)).alias("span"))
    before = Window.partitionBy("hash", "span").orderBy("us", "kind", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 0, F.struct("id", "us")), ignorenulls=True).over(before)
    found = asked.unionByName(known).withColumn("last", last).where(F.col("kind") == 1)
    return found.select("id", "hash", F.when(F.col("us") - F.col("last.us") <= within_us, F.col("last.id")).alias("cached_from"))


def enrich_missing(rows: DataFrame, cache: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], fields: str) -> DataFrame:
    """Rows (id, hash, ...) with enrichment (``fields``, DDL): from the cache (hash, fields) where known, else by the user's function.

    The function gets rows' columns in batches and yields (id, fields); ids it doesn't yield get nulls. ``from_cache`` says which.
    """
    names = [f.split()[0] for f in fields.split(",")]
    id_type = dict(rows.dtypes)["id"]
    known = rows.join(cache.select("hash", *names).dropDuplicates(["hash"]), "hash").withColumn("from_cache", F.lit(True))
    missing = rows.join(cache.select("hash").distinct(), "hash", "left_anti")
    made = missing.mapInPandas(fn, f"id {id_type}, {fields}")
    fresh = missing.join(made, "id", "left").withColumn("from_cache", F.lit(False))
    return known.select(*rows.columns, *names, "from_cache").unionByName(fresh.select(*rows.columns, *names, "from_cache"))


def reset_items(items: DataFrame, failed_only: bool = False) -> DataFrame:
    """Requeues items: failed ones, or all that aren't successful."""
    again = F.col("status") == "failed" if failed_only else F.col("status") != "success"
    return items.withColumn("status", F.when(again, "queued").otherwise(F.col("status")))


def recover(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with running set back to queued, tasks that have more than one active job)."""
    back = jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))
    active = F.count_if(F.col("status").isin("queued", "running", "cancelling"))
    return back, jobs.groupBy("task_id").agg(active.alias("active")).where(F.col("active") > 1)


def callback_due(events: DataFrame, now: Column, max_retries: int = 5) -> DataFrame:
    """Failed events whose next retry is due, oldest first; those out of retries are dead letters."""
    due = events.where((F.col("status") == "failed") & (F.col("next_retry_at") <= now))
    dead = F.col("retry_count") >= max_retries
    return due.withColumn("status", F.when(dead, "dead_letter").otherwise("due")).orderBy("next_retry_at", "event_id")


def delivery_outcome(attempts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """(key, status, attempt, next_retry_at) after all attempts (key, ts, event_id, success) in order; nothing follows a success or dead letter.

    A failure waits min(60, 5 * attempt) seconds; the max_attempts-th is a dead letter.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "success")))
    zero = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(None).cast("timestamp").alias("next_retry_at"))

    def one(s, e):
        n = s["attempt"] + 1
        status = F.when(e["success"], F.lit("sent")).when(n >= max_attempts, F.lit("dead_letter")).otherwise(F.lit("failed"))
        wait = F.when(status == "failed", F.timestamp_seconds(F.unix_micros(e["ts"]) / 1e6 + F.least(F.lit(60), 5 * n)))
        new = F.struct(status.alias("status"), n.alias("attempt"), wait.cast("timestamp").alias("next_retry_at"))
        return F.when(s["status"].isin("sent", "dead_letter"), s).otherwise(new)

    typed = attempts.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id", "success")
    return typed.groupBy("key").agg(ordered.alias("e")).withColumn("s", F.aggregate("e", zero, one)).select("key", "s.*")


def idempotent_events(events: DataFrame) -> DataFrame:
    """The first event of each key that isn't blank; all events of blank keys."""
    keyed = given(F.col("idempotency_key"))
    first = events.where(keyed).groupBy("idempotency_key").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    return events.join(first.select("event_id"), "event_id", "left_semi").where(keyed).unionByName(events.where(~keyed | keyed.isNull()))


def job_list(jobs: DataFrame, **equal) -> DataFrame:
    """Jobs that equal every filter given (None: any), newest first."""
    for name, value in equal.items():
        if value is not None and value != "":
            jobs = jobs.where(F.col(name) == F.lit(value))
    return jobs.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def failure_class(message: Column) -> Column:
    """Class of a provider's failure message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: text.rlike("|".join(words))
    return F.when(has("429", "rate limit", "too many requests"), "rate_limit").when(has("503", "unavailable", "overloaded"), "service_unavailable").when(has("timeout", "timed out"), "timeout").otherwise("other")


def http_retryable(code: Column, message: Column) -> Column:
    return (F.coalesce(code, F.lit(0)) == 429) | (F.coalesce(code, F.lit(0)) >= 500) | F.lower(F.coalesce(message, F.lit(""))).rlike("timeout|timed out")


def risk_score(base: Column, *evidence: tuple[Column, float], route_at: float = 0.92) -> tuple[Column, Column]:
    """(score within 0 and 1, whether to route outside): the task type's base or the highest evidence that holds."""
    score = F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(0.0), *[F.when(F.coalesce(test, F.lit(False)), F.lit(float(v))).otherwise(F.lit(0.0)) for test, v in evidence])
    score = F.least(score, F.lit(1.0))
    return score, score >= route_at


def concurrency_limits(
    calls: DataFrame, start: int = 2, least: int = 1, most: int = 16, window: int = 4, tolerance: float = 1.2, cooldown: int = 3, span_us: int = 3_600_000_000, chunk: int = 1024
) -> DataFrame:
    """(endpoint, n, limit): the limit after each logged call (endpoint, ts, event_id, ok, pressure, ms), numbered from 0, of an additive-increase rule.

    After ``window`` successes the limit rises by one if their mean time is within ``tolerance`` of the mean before; pressure halves it
    and keeps it from rising for ``cooldown`` calls. Calls are numbered within spans of time upon the counts of the spans before. What a call does follows from the last failure and the
    last pressure before it and from the successes since. A chunk of calls maps each limit it may begin with to the one it ends with, and chunks are
    folded over these maps, so a busy endpoint is many partitions and no array is longer than a chunk or the list of chunks.
    """
    span = F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / span_us), F.lit(-(1 << 62)))
    rows = calls.select(F.struct("endpoint").alias("e"), span.alias("span"), "ts", "event_id", "ok", "pressure", "ms")  # a struct, so that a null endpoint joins
    order = Window.partitionBy("e", "span").orderBy("ts", "event_id", "ok", "pressure", "ms")
    to_here, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("i", F.row_number().over(order))
    bad, pressed = F.when(~F.coalesce("ok", F.lit(False)), F.col("i")), F.when(F.col("pressure"), F.col("i"))
    rows = rows.select("e", "span", "i", "ok", "pressure", "ms", F.max(bad).over(to_here).alias("bad"), F.max(pressed).over(before).alias("pressed"))
    spans = rows.groupBy("e", "span").agg(F.max("i").alias("count"), F.max("bad").alias("bad"), F.max(pressed).alias("pressed"))
    earlier = Window.partitionBy("e").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    spans = spans.withColumn("base", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    spans = spans.select("e", "span", "base", *[F.max(F.col("base") + F.col(c)).over(earlier).alias(f"{c}_before") for c in ("bad", "pressed")])
    last = lambda c: F.coalesce(F.col("base") + F.col(c), F.col(f"{c}_before"))
    rows = rows.join(spans, ["e", "span"]).select("e", (F.col("base") + F.col("i")).alias("n"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("pressure", F.lit(False)).alias("down"), "ms", last("bad").alias("bad"), last("pressed").alias("pressed"))

    nth = F.col("n") - F.coalesce("bad", F.lit(0)) - 1
    free = F.coalesce(F.col("n") - F.col("pressed") > cooldown, F.lit(True))
    won = rows.where("ok").select("e", (F.col("n") - nth % window).alias("first"), F.struct("n", "ms", (free & ~F.col("down")).alias("rises")).alias("call"))
    won = won.groupBy("e", "first").agg(F.array_sort(F.collect_list("call")).alias("calls")).where(F.size("calls") == window)
    mean = F.aggregate("calls", F.lit(0.0), lambda s, x: s + x["ms"]) / window
    won = won.select("e", F.element_at("calls", -1)["n"].alias("n"), F.element_at("calls", -1)["rises"].alias("rises"), F.struct(mean.alias("mean")).alias("m")).withColumn("chunk", F.floor(F.col("n") / chunk))
    ends = won.groupBy("e", "chunk").agg(F.max_by("m", "n").alias("m"))
    ends = ends.select("e", "chunk", F.last("m", ignorenulls=True).over(Window.partitionBy("e").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("was"))
    was = F.coalesce(F.lag("m").over(Window.partitionBy("e", "chunk").orderBy("n")), F.col("was"))["mean"]
    up = won.join(ends, ["e", "chunk"]).select("e", "n", "rises", F.col("m.mean").alias("mean"), was.alias("was")).where(F.col("rises") & (F.col("was").isNull() | (F.col("mean") <= F.col("was") * tolerance))).select("e", "n", F.lit(1).alias("up"))

    at = F.floor((F.col("n") - 1) / chunk)
    moves = rows.select("e", "n", "down").join(up, ["e", "n"], "left").select("e", at.alias("chunk"), F.struct("n", F.when(F.col("down"), -1).otherwise(F.coalesce("up", F.lit(0))).alias("d")).alias("move"))
    moved = lambda x, d: F.when(d < 0, F.greatest(F.floor(x / 2).cast("int"), F.lit(least))).when(d > 0, F.least(x + 1, F.lit(most))).otherwise(x)
    low, high = min(start, least), max(start, most)
    moves = moves.groupBy("e", "chunk").agg(F.transform(F.array_sort(F.collect_list("move")), lambda x: x["d"]).alias("moves"))
    maps = moves.select("e", "chunk", F.aggregate("moves", F.sequence(F.lit(low), F.lit(high)), lambda s, d: F.transform(s, lambda x: moved(x, d))).alias("to"))
    trail = lambda items, first, then: F.aggregate(items, F.array(first), lambda s, x: F.concat(s, F.array(then(F.element_at(s, -1), x))))
    begins = maps.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("chunk", "to"))).alias("maps"))
    begins = begins.select("e", F.posexplode(trail(F.col("maps"), F.lit(start), lambda s, x: F.get(x["to"], s - low))).alias("chunk", "begin"))
    limits = moves.join(begins.withColumn("chunk", F.col("chunk").cast("long")), ["e", "chunk"]).select("e", "chunk", trail(F.col("moves"), F.col("begin"), moved).alias("limits"))
    rows = limits.select("e", "chunk", F.posexplode(F.slice("limits", F.lit(2), F.size("limits") - 1)).alias("n", "limit"))
    return rows.select("e.endpoint", (F.col("chunk") * chunk + F.col("n")).cast("int").alias("n"), "limit")


def concurrency_trace(calls: DataFrame, start: int = 2, least: int = 1, most: int = 16, window: int = 4, tolerance: float = 1.2, cooldown: int = 3) -> DataFrame:
    """(endpoint, limits): the limits of concurrency_limits in order, an array an endpoint."""
    rows = concurrency_limits(calls, start, least, most, window, tolerance, cooldown)
    return rows.groupBy("endpoint").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "limit"))), lambda x: x["limit"]).alias("limits"))


def concurrency_peaks(calls: DataFrame, span_us: int = 3_600_000_000) -> DataFrame:
    """(endpoint, calls, peak, peak_us): the most calls (endpoint, ts, ms) of an endpoint that ran at once, and when first; a call that ends as another starts isn't beside it.

    Starts and ends are summed within spans of time, upon the sums of the spans before, so a busy endpoint is many partitions. Calls without a start or time are left out.
    """
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    known = calls.where(F.col("ts").isNotNull() & (F.col("ms") > 0))
    steps = known.select("endpoint", F.explode(F.array(F.struct(start.alias("us"), F.lit(1).alias("d")), F.struct((start + F.ceil(F.col("ms") * 1000)).alias("us"), F.lit(-1).alias("d")))).alias("s")).select("endpoint", "s.*")
    steps = steps.withColumn("span", F.floor(F.col("us") / span_us))
    before = Window.partitionBy("endpoint").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    sums = steps.groupBy("endpoint", "span").agg(F.sum("d").alias("d")).select("endpoint", "span", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("endpoint", "span").orderBy("us", "d").rowsBetween(Window.unboundedPreceding, 0)
    running = steps.withColumn("n", F.sum("d").over(within)).join(sums, ["endpoint", "span"]).withColumn("n", F.col("n") + F.col("base"))
    return running.groupBy("endpoint").agg(F.count_if(F.col("d") > 0).alias("calls"), F.max(F.struct("n", (-F.col("us")).alias("m"))).alias("p")).select("endpoint", "calls", F.col("p.n").alias("peak"), (-F.col("p.m")).alias("peak_us"))


def retention_report(files: DataFrame, tasks: DataFrame, references: DataFrame, before: Column) -> DataFrame:
    """Files older than the limit whose task isn't in work and that no package refers to."""
    busy = tasks.where(F.col("status").isin("PROCESSING", "WAITING_REVIEW", "RETRYABLE")).select("task_id")
    return files.where(F.col("created_at") < before).join(busy, "task_id", "left_anti").join(references.select("file_id"), "file_id", "left_anti")


def ttl_cache_view(cache: DataFrame, now: Column) -> DataFrame:
    """The newest entry of each key that hasn't expired."""
    live = cache.where(F.col("expires_at") > now)
    return live.groupBy("key").agg(F.max_by("value", F.struct("expires_at", "value")).alias("value"), F.max("expires_at").alias("expires_at"))


def stale_outputs(outputs: DataFrame, can_enrich: bool = False) -> DataFrame:
    """Outputs that lack sections, hold glued formulas, or (if enrichment is at hand) semantic warnings that nothing repaired."""
    test = F.col("sections").isNull() | F.exists(F.coalesce("issues", F.array().cast("array<string>")), lambda i: i == "glued_formula")
    if can_enrich:
        test |= F.exists(F.coalesce("issues", F.array().cast("array<string>")), lambda i: i == "exponent_as_quote") & ~F.coalesce("repaired", F.lit(False))
    return outputs.where(test)


def evidence_filter(rows: DataFrame, doubt: str = "unsure|guess|不确定|推测") -> DataFrame:
    """Enriched answers stay only with matched context or evidence and no doubt in the warnings; children empty the parent's; odd enums are defaulted."""
    sure = (F.coalesce("context_matched", F.lit(False)) | given(F.col("evidence"))) & ~F.lower(F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), " ")).rlike(doubt)
    answer = F.when(F.coalesce("n_children", F.lit(0)) > 0, "").when(sure, F.coalesce("answer", F.lit(""))).otherwise("")
    return rows.withColumn("answer", answer).withColumn("type", F.when(F.col("type").isin("choice", "fill_blank", "solution"), F.col("type")).otherwise("unknown")).withColumn(
        "difficulty", F.when(F.col("difficulty").isin("easy", "medium", "hard"), F.col("difficulty")).otherwise("medium"))


def standardize_decisions(responses: DataFrame, current: DataFrame) -> DataFrame:
    """(question_id, decision, reason) of responses (question_id, hash, text, gate, requested) against current rows (question_id, hash, text)."""
    now = current.select("question_id", F.col("hash").alias("now_hash"), F.col("text").alias("now_text"))
    stale = F.col("now_hash").isNull() | (F.col("hash") != F.col("now_hash"))
    decision = F.when(stale, "review_required").when(F.col("text") == F.col("now_text"), "unchanged").when(~F.col("requested"), "candidate").when(F.col("gate"), "applied").otherwise("review_required")
    return responses.join(now, "question_id", "left").select("question_id", decision.alias("decision"), F.when(stale, "stale_input").otherwise("").alias("reason"))

"""Queries of job state and telemetry."""

from pyspark.sql import functions as F

from sparkfolio.operators import jobs
from sparkfolio.plans import views
from sparkfolio.plans.views import ctes
from sparkfolio.sources.tables import table

QUERIES = {}


def query(sql):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


_REASON = "concat_ws(chr(10), CASE WHEN paper_error <> '' THEN 'paper: ' || paper_error END, CASE WHEN answer_error <> '' THEN 'answer: ' || answer_error END)"


@query(ctes("tasks", "task_questions") + f""", q AS (SELECT task_id, count(*) AS n, count(*) FILTER (status = '已入库') AS banked, count(*) FILTER (status IN ('已入库', '已校验')) AS reviewed FROM task_questions GROUP BY 1)
SELECT task_id, CASE WHEN {_REASON} <> '' THEN CASE WHEN coalesce(retry_flag, retry_count < max_retries, true) THEN '可重试' ELSE '失败' END WHEN ocr_status = 'running' THEN '处理中'
  WHEN coalesce(n, 0) = 0 THEN CASE WHEN raw_status <> '' THEN raw_status ELSE '处理中' END WHEN banked = n THEN '已完成' WHEN reviewed > 0 THEN '部分完成' ELSE '待校验' END AS status
FROM tasks LEFT JOIN q USING (task_id)""")
def task_status(spark, sf_dir):
    return jobs.task_status(views.tasks(spark, sf_dir), views.task_questions(spark, sf_dir))


@query(ctes("tasks") + f" SELECT task_id, {_REASON} AS reason FROM tasks")
def failure_reason(spark, sf_dir):
    return views.tasks(spark, sf_dir).select("task_id", jobs.failure_reason(F.col("paper_error"), F.col("answer_error")).alias("reason"))


@query(ctes("tasks") + f""" SELECT task_id, (retry_count + 1)::INT AS retry_count, coalesce(max_retries, 3)::INT AS max_retries FROM tasks
WHERE {_REASON} <> '' AND coalesce(retry_flag, retry_count < coalesce(max_retries, 3))""")
def retryable(spark, sf_dir):
    return jobs.retry(views.tasks(spark, sf_dir))


def _flow(spark, sf_dir):
    """The latest event of each job and step, as a step row."""
    last = views.steps(spark, sf_dir).groupBy("job_id", "step").agg(F.max(F.struct("ts", "event_id", "status")).alias("e"))
    start = F.when(F.col("e.status") != "pending", F.col("e.ts"))
    end = F.when(F.col("e.status").isin("success", "failed", "skipped"), F.timestamp_add("SECOND", F.lit(30), F.col("e.ts")))
    return last.select("job_id", "step", F.col("e.status").alias("status"), start.alias("started_at"), end.alias("finished_at"))


_FLOW = ctes("steps") + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, step ORDER BY ts DESC, event_id DESC) AS k FROM steps),
flow AS (SELECT job_id, step, status, CASE WHEN status <> 'pending' THEN ts END AS started_at, CASE WHEN status IN ('success', 'failed', 'skipped') THEN ts + INTERVAL 30 SECOND END AS finished_at FROM ranked WHERE k = 1)"""


@query(_FLOW + """, s AS (SELECT job_id, min(step) FILTER (status = 'failed') AS f, min(step) FILTER (status = 'running') AS r, min(step) FILTER (status = 'pending') AS p,
  count(*) FILTER (status IN ('success', 'skipped')) AS completed, count(*) AS steps, min(started_at) AS a, max(finished_at) AS z FROM flow GROUP BY 1)
SELECT job_id, CASE WHEN f IS NOT NULL THEN 'failed' WHEN r IS NOT NULL THEN 'running' WHEN p IS NOT NULL THEN 'pending' ELSE 'success' END AS status,
  coalesce(f, r, p) AS current_step, completed, steps, coalesce(greatest(epoch_us(z) // 1000 - epoch_us(a) // 1000, 0), 0) AS elapsed_ms FROM s""")
def flow_summary(spark, sf_dir):
    return jobs.flow_summary(_flow(spark, sf_dir))


_SHOWN = "job_id, step, status, epoch_us(started_at) AS started_us, epoch_us(finished_at) AS finished_us"


def _shown(steps):
    return steps.select("job_id", "step", "status", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_us"))


@query(_FLOW + f""", s AS (SELECT *, list(CASE WHEN status IN ('success', 'failed', 'skipped') THEN started_at END ORDER BY step) FILTER (status IN ('success', 'failed', 'skipped')) OVER (PARTITION BY job_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM flow),
r AS (SELECT job_id, step, CASE WHEN status = 'running' AND len(later) > 0 THEN 'skipped' ELSE status END AS status, started_at, CASE WHEN status = 'running' AND len(later) > 0 THEN coalesce(later[1], TIMESTAMP '2030-01-01') ELSE finished_at END AS finished_at FROM s)
SELECT {_SHOWN} FROM r""")
def repair_stale_steps(spark, sf_dir):
    return _shown(jobs.repair_stale_steps(_flow(spark, sf_dir), F.lit("2030-01-01").cast("timestamp_ntz")))


@query(_FLOW + f""", d AS (SELECT job_id, max(ts) AS done FROM steps WHERE job_id % 2 = 0 GROUP BY 1),
r AS (SELECT f.job_id, step, CASE WHEN done IS NOT NULL AND status IN ('running', 'pending') THEN 'skipped' ELSE status END AS status, started_at, CASE WHEN done IS NOT NULL AND status IN ('running', 'pending') THEN done ELSE finished_at END AS finished_at FROM flow f LEFT JOIN d USING (job_id))
SELECT {_SHOWN} FROM r""")
def finalize_flow(spark, sf_dir):
    done = views.steps(spark, sf_dir).groupBy("job_id").agg(F.max("ts").alias("finished_at")).withColumn("status", F.when(F.col("job_id") % 2 == 0, "success").otherwise("failed"))
    return _shown(jobs.finalize_flow(_flow(spark, sf_dir), done))


@query(_FLOW + """ SELECT j.job_id, s.step, coalesce(f.status, 'pending') AS status FROM (SELECT DISTINCT job_id FROM flow WHERE step <> 5) j, range(12) s(step) LEFT JOIN flow f ON f.job_id = j.job_id AND f.step = s.step AND f.step <> 5""")
def complete_steps(spark, sf_dir):
    return jobs.complete_steps(_flow(spark, sf_dir).where("step <> 5")).select("job_id", F.col("step").cast("long").alias("step"), "status")


@query(ctes("steps") + """, o AS (SELECT *, row_number() OVER (PARTITION BY job_id, step ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY job_id, step) AS n FROM steps),
p AS (SELECT *, max(k) FILTER (status = 'pending') OVER (PARTITION BY job_id, step) AS lastp FROM o)
SELECT job_id, step, max(status) FILTER (k = n) AS status, epoch_us(min(ts) FILTER (status = 'running' AND k > coalesce(lastp, 0))) AS started_us, epoch_us(max(ts) FILTER (k = n AND status IN ('success', 'failed', 'skipped'))) AS finished_us FROM p GROUP BY 1, 2""")
def fold_step_events(spark, sf_dir):
    return _shown(jobs.fold_step_events(views.steps(spark, sf_dir)))


_CALLS = """WITH calls AS (SELECT event_id, ts, user_id, CASE WHEN user_id % 3 = 0 THEN 'external' ELSE 'local' END AS route, CASE WHEN event_type = 'click' THEN 'bad' WHEN event_type = 'view' THEN '-5' ELSE CAST(event_id AS VARCHAR) END AS duration_ms,
  event_type = 'signup' AS cache_hit, user_id % 4 AS provider, user_id % 6 AS model FROM events)"""


def _calls(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("user_id") % 3 == 0, "external").otherwise("local").alias("route"), F.when(kind == "click", "bad").when(kind == "view", "-5").otherwise(F.col("event_id").cast("string")).alias("duration_ms"),
        (kind == "signup").alias("cache_hit"), (F.col("user_id") % 4).alias("provider"), (F.col("user_id") % 6).alias("model"))


_METRICS = """count(*) AS calls, round(sum(greatest(coalesce(try_cast(duration_ms AS DOUBLE), 0), 0)), 6) AS total_ms, round(sum(CASE WHEN route = 'external' THEN greatest(coalesce(try_cast(duration_ms AS DOUBLE), 0), 0) ELSE 0 END), 6) AS external_ms,
  count(*) FILTER (route = 'external') AS external_calls, count(*) FILTER (route = 'local') AS local_calls, count(*) FILTER (cache_hit) AS cache_hits FROM calls"""


@query(_CALLS + " SELECT " + _METRICS)
def call_metrics(spark, sf_dir):
    return jobs.call_metrics(_calls(spark, sf_dir))


@query(_CALLS + " SELECT provider, model, " + _METRICS + " GROUP BY ROLLUP (provider, model)")
def call_metrics_rollup(spark, sf_dir):
    return jobs.call_metrics(_calls(spark, sf_dir), "provider", "model")


def _batches(spark, sf_dir):
    key = F.col("o_custkey")
    parent = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 10 == 0, "cancelling").otherwise("running").alias("status"))
    items = table(spark, sf_dir, "orders").select(key.alias("job_id"), F.when(F.col("o_orderstatus") == "F", "success").when((F.col("o_orderstatus") == "P"), "failed").otherwise("queued").alias("status"), F.lit(2).alias("total"), (F.col("o_totalprice") > 400000).alias("review"))
    return parent, items


@query("""WITH i AS (SELECT o_custkey AS job_id, sum(CASE o_orderstatus WHEN 'F' THEN 2 ELSE 0 END) AS succeeded, sum(CASE o_orderstatus WHEN 'P' THEN 2 ELSE 0 END) AS failed, sum((o_totalprice > 400000)::INT) AS review, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS completed FROM orders GROUP BY 1),
j AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 10 = 0 THEN 'cancelling' ELSE 'running' END AS was, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(review, 0) AS review, coalesce(completed, 0) AS completed FROM customer LEFT JOIN i ON i.job_id = c_custkey)
SELECT job_id, CASE WHEN was = 'cancelling' THEN 'cancelled' WHEN failed = 0 AND review > 0 THEN 'partial_review' WHEN failed = 0 THEN 'completed' WHEN succeeded = 0 THEN 'failed' ELSE 'partial_failed' END AS status, succeeded, failed, review, completed FROM j""")
def batch_rollup(spark, sf_dir):
    return jobs.batch_rollup(*_batches(spark, sf_dir))


@query(ctes("questions") + " SELECT doc_id, position, sha256(concat_ws('|', coalesce(doc_id::VARCHAR, ''), type, stem, answer)) AS hash FROM questions")
def input_hash(spark, sf_dir):
    q = views.questions(spark, sf_dir)
    return q.select("doc_id", "position", jobs.input_hash(F.col("doc_id"), F.col("type"), F.col("stem"), F.col("answer")).alias("hash"))


@query("""WITH h AS (SELECT event_id AS id, user_id % 97 AS hash, event_type, ts FROM events),
best AS (SELECT i.id, g.id AS other, row_number() OVER (PARTITION BY i.id ORDER BY g.ts DESC, g.id DESC) AS k FROM h i JOIN h g ON g.hash = i.hash AND g.id <> i.id AND g.event_type = 'purchase')
SELECT h.id, hash, other AS cached_from FROM h LEFT JOIN best b ON b.id = h.id AND k = 1""")
def reuse_by_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 97).alias("hash"), F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"), F.col("ts").alias("finished_at"))
    return jobs.reuse_by_hash(rows.select("id", "hash"), rows)


#: Calls and their results by hash, of which one has a third of all rows; a result counts for a day.
DAY_US = 86_400_000_000
_REUSE = """WITH e AS (SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS hash, ts, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS kind FROM events {}),
l AS (SELECT *, last_value(CASE WHEN kind = 0 THEN id END IGNORE NULLS) OVER w AS found, last_value(CASE WHEN kind = 0 THEN ts END IGNORE NULLS) OVER w AS at_ FROM e WINDOW w AS (PARTITION BY hash ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING))
SELECT id, hash, CASE WHEN epoch_us(ts) - epoch_us(at_) <= 86400000000 THEN found END AS cached_from FROM l WHERE kind = 1"""


def calls_and_results(events):
    rows = events.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("hash"), "ts", "event_type")
    return rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'")


@query(_REUSE.format(""))
def reuse_within(spark, sf_dir):
    return jobs.reuse_within(*calls_and_results(table(spark, sf_dir, "events")), DAY_US)


def _lengths(batches):
    for rows in batches:
        yield rows[["id"]].assign(n=rows["stem"].str.len().astype("int64"))


@query("""WITH r AS (SELECT conv_id * 1000 + turn AS id, md5(text) AS hash, text FROM conversations), c AS (SELECT DISTINCT hash FROM r WHERE id % 5 = 0)
SELECT id, CASE WHEN c.hash IS NULL THEN len(text) ELSE -1 END AS n, c.hash IS NOT NULL AS from_cache FROM r LEFT JOIN c USING (hash)""")
def enrich_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.md5("text").alias("hash"), F.col("text").alias("stem"))
    cache = rows.where("id % 5 = 0").select("hash", F.lit(-1).cast("long").alias("n"))
    return jobs.enrich_missing(rows, cache, _lengths, "n long").select("id", "n", "from_cache")


@query("SELECT event_id AS id, CASE WHEN event_type <> 'purchase' THEN 'queued' ELSE 'success' END AS status FROM events")
def reset_items(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"))
    return jobs.reset_items(items)


@query("SELECT o_custkey AS task_id, count(*) FILTER (o_orderstatus <> 'F') AS active FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'F') > 1")
def recover(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"))
    return jobs.recover(rows)[1]


@query("""SELECT event_id, CASE WHEN user_id % 7 >= 5 THEN 'dead_letter' ELSE 'due' END AS status FROM events WHERE event_type = 'error' AND value <= 20""")
def callback_due(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"), F.col("value").alias("next_retry_at"), (F.col("user_id") % 7).alias("retry_count"))
    return jobs.callback_due(rows, F.lit(20.0)).select("event_id", "status")


_ATTEMPTS = ctes("callbacks") + """, a AS (SELECT idempotency_key AS key, user_id, ts, success, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM callbacks),
f AS (SELECT user_id, min(n) FILTER (success) AS sent_at, count(*) AS n FROM a GROUP BY 1),
e AS (SELECT user_id, CASE WHEN sent_at IS NOT NULL AND sent_at <= 5 THEN sent_at ELSE least(n, 5) END AS attempt, sent_at IS NOT NULL AND sent_at <= 5 AS sent FROM f)"""


@query(_ATTEMPTS + """ SELECT e.user_id AS key, CASE WHEN sent THEN 'sent' WHEN attempt >= 5 THEN 'dead_letter' ELSE 'failed' END AS status, attempt, CASE WHEN NOT sent AND attempt < 5 THEN epoch_us(ts) + 1000000 * least(60, 5 * attempt) END AS due_us
FROM e JOIN a ON a.user_id = e.user_id AND a.n = e.attempt""")
def delivery_outcome(spark, sf_dir):
    attempts = views.callbacks(spark, sf_dir).withColumn("key", F.col("user_id"))
    return jobs.delivery_outcome(attempts).select("key", "status", F.col("attempt").cast("long").alias("attempt"), F.unix_micros("next_retry_at").alias("due_us"))


@query(ctes("callbacks") + """, b AS (SELECT *, CASE WHEN user_id % 50 = 0 THEN '' ELSE idempotency_key END AS k FROM callbacks)
SELECT event_id, k AS idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS n FROM b) WHERE n = 1 OR k = ''""")
def idempotent_events(spark, sf_dir):
    rows = views.callbacks(spark, sf_dir).withColumn("idempotency_key", F.when(F.col("user_id") % 50 == 0, "").otherwise(F.col("idempotency_key")))
    return jobs.idempotent_events(rows).select("event_id", "idempotency_key")


@query("SELECT event_id AS id, event_type FROM events WHERE event_type = 'error' AND user_id = 3")
def job_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "id", "ts": "created_at"})
    return jobs.job_list(rows, event_type="error", user_id=3, value=None).select("id", "event_type")


_MESSAGES = "CASE event_type WHEN 'error' THEN 'HTTP 429 Too Many Requests' WHEN 'view' THEN 'Service Unavailable' WHEN 'click' THEN 'read Timed out' ELSE 'bad' END"


@query(f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'view' THEN 'service_unavailable' WHEN 'click' THEN 'timeout' ELSE 'other' END AS class, user_id % 600 = 429 OR user_id % 600 >= 500 OR event_type = 'click' AS retryable FROM events""")
def classify_failures(spark, sf_dir):
    kind = F.col("event_type")
    text = F.when(kind == "error", "HTTP 429 Too Many Requests").when(kind == "view", "Service Unavailable").when(kind == "click", "read Timed out").otherwise("bad")
    return table(spark, sf_dir, "events").select("event_id", jobs.failure_class(text).alias("class"), jobs.http_retryable(F.col("user_id") % 600, text).alias("retryable"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_discount * 9, 0, CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0 END, CASE WHEN l_quantity > 45 THEN 0.95 ELSE 0 END), 1) AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(score, 6) AS score, score >= 0.92 AS outside FROM s""")
def risk_scores(spark, sf_dir):
    score, outside = jobs.risk_score(F.col("l_discount") * 9, (F.col("l_returnflag") == "R", 0.5), (F.col("l_quantity") > 45, 0.95))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"), outside.alias("outside"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 16 AS endpoint, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS n, event_type <> 'error' AS ok, value AS ms FROM events),
w AS (SELECT n, endpoint, ok, ms FROM e), f AS (
  SELECT endpoint, 0::BIGINT AS n, 2 AS lim, 0 AS wins, 0.0::DOUBLE AS total, NULL::DOUBLE AS mean, 0 AS hold FROM (SELECT DISTINCT endpoint FROM e) UNION ALL
  SELECT f.endpoint, w.n,
    CASE WHEN NOT ok THEN greatest(lim // 2, 1) WHEN wins + 1 >= 4 AND (mean IS NULL OR (total + ms) / 4 <= mean * 1.2) AND hold <= 0 THEN least(lim + 1, 16) ELSE lim END,
    CASE WHEN NOT ok OR wins + 1 >= 4 THEN 0 ELSE wins + 1 END, CASE WHEN NOT ok OR wins + 1 >= 4 THEN 0.0 ELSE total + ms END,
    CASE WHEN ok AND wins + 1 >= 4 THEN (total + ms) / 4 ELSE mean END, CASE WHEN NOT ok THEN 3 ELSE greatest(hold - 1, 0) END
  FROM f JOIN w ON w.endpoint = f.endpoint AND w.n = f.n + 1)
SELECT endpoint, (n - 1)::INT AS n, lim AS "limit" FROM f WHERE n > 0""")
def concurrency_trace(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("endpoint"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "error").alias("pressure"), F.col("value").alias("ms"))
    return jobs.concurrency_limits(calls)


@query("""WITH s AS (SELECT user_id % 16 AS endpoint, epoch_us(ts) AS us, 1 AS d FROM events WHERE value > 0 UNION ALL SELECT user_id % 16, epoch_us(ts) + ceil(value * 60000 * 1000)::BIGINT, -1 FROM events WHERE value > 0),
r AS (SELECT *, sum(d) OVER (PARTITION BY endpoint ORDER BY us, d ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM s)
SELECT endpoint, count(*) FILTER (d > 0) AS calls, max(n) AS peak, arg_max(us, (n, -us)) AS peak_us FROM r GROUP BY 1""")
def concurrency_peaks(spark, sf_dir):
    """Events as calls that take as many minutes as their value."""
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("endpoint"), "ts", (F.col("value") * 60000).alias("ms"))
    return jobs.concurrency_peaks(calls)


@query("""SELECT event_id AS file_id, user_id AS task_id FROM events WHERE value < 50 AND user_id % 3 <> 0 AND event_id NOT IN (SELECT page_id FROM pages)""")
def retention_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    files = rows.select(F.col("event_id").alias("file_id"), F.col("user_id").alias("task_id"), F.col("value").alias("created_at"))
    tasks = rows.select(F.col("user_id").alias("task_id"), F.when(F.col("user_id") % 3 == 0, "PROCESSING").otherwise("COMPLETED").alias("status")).distinct()
    return jobs.retention_report(files, tasks, table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id")), F.lit(50.0)).select("file_id", "task_id")


@query("SELECT user_id AS key, max(struct_pack(e := value, v := event_id)).v AS value, max(value) AS expires_at FROM events WHERE value > 10 GROUP BY 1")
def ttl_cache_view(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("value").alias("expires_at"))
    return jobs.ttl_cache_view(rows, F.lit(10.0))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_totalprice < 100000)")
def stale_outputs(spark, sf_dir):
    priority = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", 1).alias("sections"), F.when(priority == "1-URGENT", F.array(F.lit("x"), F.lit("glued_formula"))).when(priority == "2-HIGH", F.array(F.lit("exponent_as_quote"))).alias("issues"), (F.col("o_totalprice") >= 100000).alias("repaired"))
    return jobs.stale_outputs(rows, can_enrich=True).select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 = 0 THEN '' WHEN (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_orderpriority <> '1-URGENT' THEN 'answer' ELSE '' END AS answer, CASE WHEN o_custkey % 2 = 0 THEN 'choice' ELSE 'unknown' END AS type, CASE WHEN o_custkey % 3 = 0 THEN 'hard' ELSE 'medium' END AS difficulty FROM orders""")
def evidence_filter(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("answer").alias("answer"), (F.col("o_custkey") % 9 == 0).cast("int").alias("n_children"), F.when(status != "P", status == "F").alias("context_matched"), F.when(status == "O", "line").alias("evidence"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("a Guess"))).alias("warnings"), F.when(F.col("o_custkey") % 2 == 0, "choice").otherwise("essay").alias("type"), F.when(F.col("o_custkey") % 3 == 0, "hard").alias("difficulty"))
    return jobs.evidence_filter(rows).select("id", "answer", "type", "difficulty")


@query("""WITH r AS (SELECT l_partkey AS question_id, l_linenumber AS n, l_quantity::BIGINT % 3 AS hash, l_tax AS tax, l_discount AS disc FROM lineitem),
c AS (SELECT p_partkey AS question_id, p_size % 3 AS now_hash, p_size % 2 AS now_text FROM part WHERE p_size < 40)
SELECT r.question_id, CASE WHEN now_hash IS NULL OR hash <> now_hash THEN 'review_required' WHEN n % 2 = now_text THEN 'unchanged' WHEN tax <= 0.04 THEN 'candidate' WHEN disc > 0.05 THEN 'applied' ELSE 'review_required' END AS decision,
  CASE WHEN now_hash IS NULL OR hash <> now_hash THEN 'stale_input' ELSE '' END AS reason FROM r LEFT JOIN c USING (question_id)""")
def standardize_decisions(spark, sf_dir):
    responses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id"), (F.col("l_quantity").cast("long") % 3).alias("hash"), (F.col("l_linenumber") % 2).alias("text"), (F.col("l_discount") > 0.05).alias("gate"), (F.col("l_tax") > 0.04).alias("requested"))
    current = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("question_id"), (F.col("p_size") % 3).alias("hash"), (F.col("p_size") % 2).alias("text"))
    return jobs.standardize_decisions(responses, current)

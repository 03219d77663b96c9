"""Queries of sources, sinks and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.plans import jobs_queries, views
from sparkfolio.plans.views import ctes
from sparkfolio.sources import corpus
from sparkfolio.sources.tables import shared_folder, table
from sparkfolio.streaming import jobs as streams
from sparkfolio.streaming import live

QUERIES = {}


def query(sql):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


@query(ctes("tasks") + " SELECT task_id, CASE raw_status WHEN '待校验' THEN 'WAITING_REVIEW' ELSE 'UNKNOWN' END AS status FROM tasks")
def standardize_status(spark, sf_dir):
    return views.tasks(spark, sf_dir).select("task_id", corpus.standardize_status(F.col("raw_status")).alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events")
def typed_json_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(F.col("props")).alias("props"))
    return corpus.typed_json_columns(rows, {"props": "map<string,bigint>"}).select("event_id", F.coalesce(F.try_element_at("props", F.lit("k")), F.lit(0)).alias("k"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand || ':' || p_name ELSE p_type || ':' || p_brand END AS options FROM part")
def normalize_options_children(spark, sf_dir):
    entry = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("label"), F.lit(" "), F.lit("key"), "p_brand", F.lit("text"), "p_name")).otherwise(F.create_map(F.lit("option"), F.col("p_type"), F.lit("value"), F.col("p_brand")))
    out = corpus.normalize_options(F.array(entry))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(out, lambda o: F.concat_ws(":", o["label"], o["content"])), ",").alias("options"))


@query(ctes("tasks", "task_questions") + """, q AS (SELECT task_id, count(*) AS n, string_agg(question_id::VARCHAR, ',' ORDER BY question_id) AS ids FROM task_questions GROUP BY 1)
SELECT task_id, coalesce(ids, '') AS ids, concat_ws(',', CASE WHEN paper_error <> '' OR answer_error <> '' THEN 'JOB_FAILURE_REASON' END, CASE WHEN n IS NULL THEN 'EMPTY_QUESTION_PACKAGE' END) AS warnings FROM tasks LEFT JOIN q USING (task_id)""")
def question_package(spark, sf_dir):
    questions = views.task_questions(spark, sf_dir).withColumn("number", F.col("question_id")).withColumn("manual_stem", F.lit(""))
    out = corpus.question_package(views.tasks(spark, sf_dir).withColumn("status", F.col("raw_status")), questions)
    return out.select("task_id", F.array_join(F.transform("questions", lambda q: q["id"].cast("string")), ",").alias("ids"), F.array_join("warnings", ",").alias("warnings"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS t FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 5 > 0), o AS (SELECT *, o_custkey IN (SELECT t FROM s) AS synced FROM orders)
SELECT o_custkey AS task_id, o_orderkey AS id, CASE WHEN NOT synced THEN 'kept' WHEN o_orderkey % 4 = 1 THEN 'inserted' WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'same' END AS change FROM o
WHERE CASE WHEN synced THEN o_orderkey % 5 > 0 ELSE o_orderkey % 4 <> 1 END""")
def sync_snapshot(spark, sf_dir):
    k = F.col("id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stem"), F.col("o_orderstatus").alias("answer"), F.lit(0).alias("n_children"))
    incoming = rows.where((F.col("task_id") % 3 == 0) & (k % 5 > 0)).withColumn("stem", F.when(k % 2 == 0, "new").otherwise(F.col("stem")))
    return corpus.sync_snapshot(rows.where(k % 4 != 1), incoming).select("task_id", "id", "change")


@query("""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey, l_quantity FROM lineitem),
b AS (SELECT l_orderkey, string_agg(n || '. q' || l_partkey || chr(10) || 'A. x' || chr(10) || 'B. y', chr(10) || chr(10) ORDER BY n) AS body, sum(l_quantity)::BIGINT AS total, count(*) AS n FROM i GROUP BY 1)
SELECT l_orderkey AS paper_id, '# ' || o_orderpriority || chr(10) || chr(10) || '满分：' || total || ' 题数：' || n || chr(10) || chr(10) || body AS markdown FROM b JOIN orders ON o_orderkey = l_orderkey""")
def render_paper_markdown(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), n.alias("position"), F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("stem"), F.col("l_quantity").alias("score"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.lit("").alias("answer"))
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("title"))
    return corpus.render_paper_markdown(papers, items)


@query("SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 3 > 0 UNION SELECT o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'F'")
def insert_missing(spark, sf_dir):
    """Insert when the id is absent."""
    target = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("id"))
    incoming = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("id"))
    return corpus.insert_missing(target, incoming)


@query("""SELECT 'tasks' AS kind, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS detail FROM customer WHERE c_custkey % 10 > 0
UNION ALL SELECT 'knowledgePoints', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation WHERE n_nationkey % 7 > 0
UNION ALL SELECT 'bankQuestions', p_partkey::VARCHAR, p_name, p_size::VARCHAR FROM part WHERE p_partkey % 9 > 0
UNION ALL SELECT 'papers', o_orderkey::VARCHAR, o_orderpriority, o_custkey::VARCHAR FROM orders""")
def load_library_store(spark, sf_dir):
    """JSON stores of a thousand entries each, written as files and read back as four tables; entries with a blank id, name or title don't count."""
    def stores(kind, rows, id_, entry):
        grouped = rows.groupBy(F.floor(F.col(id_) / 1000).cast("string").alias("job_id")).agg(F.collect_list(entry).alias(kind))
        return grouped.select("job_id", F.lit(f"{kind}.json").alias("relative"), F.to_json(F.struct(kind)).cast("binary").alias("content"))

    blank = lambda test, c: F.when(test, " ").otherwise(F.col(c).cast("string"))
    text = lambda c: F.col(c).cast("string")
    tasks = F.struct(text("c_custkey").alias("id"), blank(F.col("c_custkey") % 10 == 0, "c_name").alias("title"), F.col("c_mktsegment").alias("status"))
    points = F.struct(blank(F.col("n_nationkey") % 7 == 0, "n_nationkey").alias("id"), F.col("n_name").alias("name"), text("n_regionkey").alias("parentId"))
    bank = F.struct(blank(F.col("p_partkey") % 9 == 0, "p_partkey").alias("id"), F.col("p_name").alias("stemMarkdown"), text("p_size").alias("answer"), F.col("p_retailprice").alias("score"))
    papers = F.struct(text("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.array(text("o_custkey")).alias("questionIds"))
    files = stores("tasks", table(spark, sf_dir, "customer"), "c_custkey", tasks).unionAll(stores("knowledgePoints", table(spark, sf_dir, "nation"), "n_nationkey", points))
    files = files.unionAll(stores("bankQuestions", table(spark, sf_dir, "part"), "p_partkey", bank)).unionAll(stores("papers", table(spark, sf_dir, "orders"), "o_orderkey", papers))
    root = shared_folder(spark)
    corpus.write_files(files, root)
    found = corpus.load_library_store(spark, f"{root}/*/*.json")
    shown = lambda kind, name, detail: found[kind].select(F.lit(kind).alias("kind"), "id", F.col(name).alias("name"), detail.alias("detail"))
    out = shown("tasks", "title", F.col("status")).unionAll(shown("knowledgePoints", "name", F.col("parentId")))
    return out.unionAll(shown("bankQuestions", "stemMarkdown", F.col("answer"))).unionAll(shown("papers", "title", F.get("questionIds", F.lit(0))))


@query("""SELECT 'j' || page_id AS job_id, CASE WHEN length(html) > 1 THEN 'a/full.md' ELSE 'a/short.markdown' END AS path, md5(html) AS md5 FROM pages""")
def read_markdown_corpus(spark, sf_dir):
    """Pages written as files of their jobs beside a shorter one and one of another kind, read back as a corpus."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("j"), "page_id").alias("job_id"), F.explode(F.array(
        F.struct(F.lit("a/full.md").alias("relative"), F.col("html").alias("t")), F.struct(F.lit("a/short.markdown").alias("relative"), F.lit("x").alias("t")), F.struct(F.lit("b.txt").alias("relative"), F.concat("html", F.lit("longer")).alias("t")))).alias("f"))
    root = shared_folder(spark)
    corpus.write_files(pages.select("job_id", "f.relative", F.col("f.t").cast("binary").alias("content")), root)
    return corpus.read_markdown_corpus(spark, root).select("job_id", "path", F.md5("markdown").alias("md5"))


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS job_id, (row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY 'img/' || page_id || '.PNG') - 1)::INT AS position, page_id || '.PNG' AS name, 'img/' || page_id || '.PNG' AS path, length(html)::BIGINT AS size, 'png' AS type
FROM pages WHERE page_id % 2 = 0""")
def asset_manifest(spark, sf_dir):
    ending = F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".txt")
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("job_id"), F.concat(F.lit("img/"), F.col("page_id").cast("string"), ending).alias("relative"), F.length("html").cast("long").alias("length"))
    return corpus.asset_manifest(files)


@query("""SELECT 'j' || conv_id AS job_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS "order", CASE WHEN conv_id % 2 = 0 THEN 'middle ' ELSE '' END || text AS text, turn::INT AS page_index FROM conversations WHERE turn % 3 > 0""")
def read_layout_json(spark, sf_dir):
    """Each conversation's blocks as JSON files, for half of them one of either kind; every third block has an empty box and goes."""
    high = F.when(F.col("turn") % 3 > 0, 5.0).otherwise(0.0)
    item = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit("").alias("img_path"), F.array(F.lit(0.0), F.lit(0.0), high, high).alias("bbox"), F.col("turn").cast("int").alias("page_idx"))
    listed = lambda t: F.to_json(F.sort_array(F.collect_list(F.struct("turn", item(t).alias("i")))).getField("i")).cast("binary")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed(F.col("text")).alias("plain"), listed(F.concat(F.lit("middle "), "text")).alias("middle"))
    files = rows.select(F.concat(F.lit("j"), "conv_id").alias("job_id"), F.explode(F.array(
        F.struct(F.lit("a/x_content_list.json").alias("relative"), F.col("plain").alias("content")), F.struct(F.when(F.col("conv_id") % 2 == 0, "a/x_middle.json").otherwise("a/x_other.json").alias("relative"), F.col("middle").alias("content")))).alias("f"))
    root = shared_folder(spark)
    corpus.write_files(files.select("job_id", "f.*"), root)
    return corpus.read_layout_json(spark, root).select("job_id", "order", "text", "page_index")


_EVENTS = "events"


def _events(spark, sf_dir):
    return streams.event_stream(spark, f"{sf_dir}/{_EVENTS}.parquet")


@query(jobs_queries.QUERIES["fold_step_events"][1])
def stream_fold_steps(spark, sf_dir):
    """The streaming fold over all events: the state of each job and step in the last batch that touched it."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "running").when(kind == "click", "skipped").when(kind == "purchase", "success").otherwise("failed")
    steps = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), (F.col("event_id") % 12).alias("step"), status.alias("status"), "ts", "event_id")
    out = streams.run_available(streams.fold_steps(steps), shared_folder(spark), "update")
    last = F.max_by(F.struct("status", "started_us", "finished_us"), "_batch")
    return out.groupBy("job_id", "step").agg(last.alias("r")).select("job_id", "step", "r.*")


@query(jobs_queries.QUERIES["delivery_outcome"][1])
def stream_deliveries(spark, sf_dir):
    attempts = _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") == "purchase").alias("success"))
    out = streams.run_available(streams.deliveries(attempts), shared_folder(spark), "update")
    last = F.max_by(F.struct("status", "attempt", "due_us"), "_batch")
    return out.groupBy("key").agg(last.alias("r")).select("key", "r.*")


@query("SELECT user_id::VARCHAR AS idempotency_key, user_id, 1::BIGINT AS kept FROM events GROUP BY user_id")
def stream_idempotent_events(spark, sf_dir):
    """The kept events by key: one each, and an event of that key."""
    events = _events(spark, sf_dir).withColumn("idempotency_key", F.col("user_id").cast("string"))
    out = streams.run_available(streams.idempotent_events(events, "3650 days"), shared_folder(spark)).select("idempotency_key", "event_id")
    return out.join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id").groupBy("idempotency_key", "user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH c AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, CASE WHEN user_id % 3 = 0 THEN 'external' ELSE 'local' END AS route, event_type <> 'error' AS ok FROM events), m AS (SELECT max(ts) AS last FROM events)
SELECT epoch_us(start) AS start_us, route, count(*) AS calls, count(*) FILTER (NOT ok) AS failed FROM c, m WHERE start + INTERVAL 10 MINUTE <= last - INTERVAL 30 MINUTE GROUP BY 1, 2""")
def stream_call_windows(spark, sf_dir):
    calls = _events(spark, sf_dir).select("ts", F.when(F.col("user_id") % 3 == 0, "external").otherwise("local").alias("route"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"))
    out = streams.run_available(streams.call_windows(calls), shared_folder(spark))
    return out.select(F.unix_micros("start").alias("start_us"), "route", "calls", "failed")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
g AS (SELECT user_id, n, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z, count(*) AS events FROM s GROUP BY 1, 2), m AS (SELECT max(ts) AS last FROM events)
SELECT user_id AS job_id, epoch_us(a) AS start_us, events FROM g, m WHERE z <= last - INTERVAL 1 HOUR""")
def stream_job_sessions(spark, sf_dir):
    steps = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts")
    return streams.run_available(streams.job_sessions(steps), shared_folder(spark)).select("job_id", F.unix_micros("start").alias("start_us"), "events")


#: What a watermark that lags by so many milliseconds has passed after all events.
_PASSED = "epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - {} FROM events)"


@query(ctes("steps") + f""", o AS (SELECT *, row_number() OVER (PARTITION BY job_id, step ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY job_id, step) AS n FROM steps WHERE {_PASSED.format(3600000)}),
p AS (SELECT *, max(k) FILTER (status = 'pending') OVER (PARTITION BY job_id, step) AS lastp FROM o),
f AS (SELECT job_id, step, max(status) FILTER (k = n) AS status, epoch_us(min(ts) FILTER (status = 'running' AND k > coalesce(lastp, 0))) AS a, epoch_us(max(ts) FILTER (k = n AND status IN ('success', 'failed', 'skipped'))) AS z FROM p GROUP BY 1, 2),
s AS (SELECT *, list(coalesce(a, z) ORDER BY step) FILTER (status IN ('success', 'failed', 'skipped')) OVER (PARTITION BY job_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM f),
r AS (SELECT job_id, step, CASE WHEN status = 'running' AND len(later) > 0 THEN 'skipped' ELSE status END AS status, a, CASE WHEN status = 'running' AND len(later) > 0 THEN later[1] ELSE z END AS z FROM s),
j AS (SELECT job_id, min(step) FILTER (status = 'failed') AS f, min(step) FILTER (status = 'running') AS r, min(step) FILTER (status = 'pending') AS p, count(*) FILTER (status IN ('success', 'skipped')) AS completed,
  coalesce(greatest(max(z) // 1000 - min(a) // 1000, 0), 0) AS elapsed_ms FROM r GROUP BY 1)
SELECT r.job_id, step, status, a AS started_us, z AS finished_us, CASE WHEN j.f IS NOT NULL THEN 'failed' WHEN j.r IS NOT NULL THEN 'running' WHEN j.p IS NOT NULL THEN 'pending' ELSE 'success' END AS flow_status,
  coalesce(j.f, j.r, j.p) AS current_step, completed, elapsed_ms FROM r JOIN j ON r.job_id = j.job_id""")
def stream_live_flow(spark, sf_dir):
    """The live flow table after all events: each job's rows as the watermark left them."""
    out = live.run_live(live.live_flow(views.step_rows(_events(spark, sf_dir)), "1 hour"), shared_folder(spark))
    last = F.max_by(F.struct("status", "started_us", "finished_us", "flow_status", "current_step", "completed", "elapsed_ms"), "_batch")
    return out.groupBy("job_id", "step").agg(last.alias("r")).select("job_id", "step", "r.*")


@query(ctes("callbacks") + f""", a AS (SELECT user_id, ts, success, row_number() OVER w AS n, lead(ts) OVER w AS following FROM callbacks WHERE {_PASSED.format(60000)} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, min(n) FILTER (success) OVER (PARTITION BY user_id) AS sent, epoch_us(ts) + 1000000 * least(60, 5 * n) AS due FROM a)
SELECT user_id AS key, CASE WHEN n = 5 THEN 'dead_letter' ELSE 'due' END AS status, n AS attempt, CASE WHEN n < 5 THEN due END AS due_us, CASE WHEN n < 5 THEN due ELSE epoch_us(ts) END AS at_us FROM f
WHERE n <= 5 AND (sent IS NULL OR n < sent) AND (n = 5 OR (due // 1000 < (SELECT epoch_ms(max(ts)) - 60000 FROM events) AND (following IS NULL OR epoch_us(following) >= due)))""")
def stream_live_retries(spark, sf_dir):
    """All retries that fell due, and dead letters, while the watermark went over the events."""
    attempts = _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") == "purchase").alias("success"))
    return live.run_live(live.live_retries(attempts), shared_folder(spark)).drop("_batch")


@query(jobs_queries._REUSE.format("WHERE " + _PASSED.format(3600000)))
def stream_live_reuse(spark, sf_dir):
    """Calls with the results they can reuse, joined as two streams."""
    calls, results = jobs_queries.calls_and_results(_events(spark, sf_dir)), jobs_queries.calls_and_results(_events(spark, sf_dir))
    return live.run_live(live.live_reuse(calls[0], results[1], jobs_queries.DAY_US), shared_folder(spark)).drop("_batch")

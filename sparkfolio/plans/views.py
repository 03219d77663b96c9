"""Projection views: the given tables seen as item bank, papers, questions, steps and so on.

Each view has a Spark form and a SQL form (a CTE) that say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.sources.tables import table

SQL = {
    "bank": """bank AS (SELECT p_partkey AS id, p_name AS stem, p_type AS type, p_brand AS subject,
  CASE p_size % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  p_retailprice AS score, p_size AS grade, p_size AS created_at FROM part)""",
    "paper_items": """paper_items AS (SELECT l_orderkey AS paper_id, l_linenumber AS position, l_partkey AS question_id,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS override_score FROM lineitem)""",
    "papers": """papers AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS subject, CAST(year(o_orderdate) AS VARCHAR) AS grade,
  CASE WHEN o_totalprice > 200000 THEN 'draft' ELSE 'final' END AS status, o_orderdate AS created_at FROM orders)""",
    "rules": """rules AS (SELECT n_nationkey AS paper_id, CASE WHEN n_regionkey = 0 THEN '' END AS type, CASE n_regionkey WHEN 1 THEN 'easy' WHEN 2 THEN 'hard' END AS difficulty,
  CASE WHEN n_nationkey % 2 = 0 THEN '#' || CAST(n_nationkey % 5 AS VARCHAR) END AS subject, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS count FROM nation)""",
    "questions": """questions AS (SELECT conv_id AS doc_id, turn AS position, CASE role WHEN 'assistant' THEN 'answer' ELSE 'paper' END AS zone,
  turn // 2 + 1 AS number, CASE length(text) % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'fill_blank' ELSE 'solution' END AS type, text AS stem,
  CASE WHEN role = 'assistant' THEN text ELSE '' END AS answer FROM conversations)""",
    "steps": """steps AS (SELECT user_id AS job_id, event_id % 12 AS step, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
  WHEN 'click' THEN 'skipped' WHEN 'purchase' THEN 'success' ELSE 'failed' END AS status, ts, event_id, value FROM events)""",
    "callbacks": """callbacks AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR) AS idempotency_key, ts, event_type = 'purchase' AS success, user_id FROM events)""",
    "boxes": """boxes AS (SELECT l_orderkey AS question_id, l_linenumber AS page_index, l_quantity / 60 AS x, l_tax * 10 AS y, l_discount + 0.02 AS w, 0.05::DOUBLE AS h,
  l_extendedprice / 200000 AS confidence, l_partkey AS item_id FROM lineitem)""",
    "assets": """assets AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*', 0) AS path, regexp_extract(regexp_extract(url, '^[^?#]*', 0), '[^/]*$', 0) AS name FROM pages)""",
    "tasks": """tasks AS (SELECT c_custkey AS task_id, c_name AS title, CASE WHEN c_acctbal < -500 THEN 'paper failed' ELSE '' END AS paper_error,
  CASE WHEN c_acctbal < -800 THEN 'answer failed' ELSE '' END AS answer_error, CASE WHEN c_custkey % 11 = 0 THEN 'running' ELSE 'success' END AS ocr_status,
  CASE c_mktsegment WHEN 'BUILDING' THEN '待校验' ELSE '' END AS raw_status, c_custkey % 4 AS retry_count, CASE WHEN c_custkey % 5 = 0 THEN 2 END AS max_retries,
  CASE WHEN c_custkey % 7 = 0 THEN false END AS retry_flag, c_nationkey AS owner FROM customer)""",
    "task_questions": """task_questions AS (SELECT o_custkey AS task_id, o_orderkey AS question_id, CASE o_orderstatus WHEN 'F' THEN '已入库' WHEN 'O' THEN '已校验' ELSE '待校验' END AS status,
  o_orderpriority AS stem, o_totalprice AS score FROM orders)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), F.col("p_type").alias("type"), F.col("p_brand").alias("subject"),
        F.when(size % 3 == 0, "easy").when(size % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
        F.col("p_retailprice").alias("score"), size.alias("grade"), size.alias("created_at"),
    )


def paper_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("override_score"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("subject"), F.year("o_orderdate").cast("string").alias("grade"),
        F.when(F.col("o_totalprice") > 200000, "draft").otherwise("final").alias("status"), F.col("o_orderdate").alias("created_at"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("paper_id"), F.when(region == 0, "").alias("type"), F.when(region == 1, "easy").when(region == 2, "hard").alias("difficulty"),
        F.when(key % 2 == 0, F.concat(F.lit("#"), (key % 5).cast("string"))).alias("subject"), F.when(key % 3 > 0, key).alias("count"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.when(F.col("role") == "assistant", "answer").otherwise("paper").alias("zone"),
        (F.floor(F.col("turn") / 2) + 1).alias("number"), F.when(size % 3 == 0, "choice").when(size % 3 == 1, "fill_blank").otherwise("solution").alias("type"),
        F.col("text").alias("stem"), F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("answer"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_rows(table(spark, sf_dir, "events"))


def step_rows(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as step events."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "running").when(kind == "click", "skipped").when(kind == "purchase", "success").otherwise("failed")
    return events.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 12).alias("step"), status.alias("status"), "ts", "event_id", "value")


def callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("idempotency_key"), "ts", (F.col("event_type") == "purchase").alias("success"), "user_id"
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("page_index"), (F.col("l_quantity") / 60).alias("x"), (F.col("l_tax") * 10).alias("y"),
        (F.col("l_discount") + 0.02).alias("w"), F.lit(0.05).alias("h"), (F.col("l_extendedprice") / 200000).alias("confidence"), F.col("l_partkey").alias("item_id"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"), F.regexp_extract(path, "[^/]*$", 0).alias("name"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        key.alias("task_id"), F.col("c_name").alias("title"), F.when(balance < -500, "paper failed").otherwise("").alias("paper_error"), F.when(balance < -800, "answer failed").otherwise("").alias("answer_error"),
        F.when(key % 11 == 0, "running").otherwise("success").alias("ocr_status"), F.when(F.col("c_mktsegment") == "BUILDING", "待校验").otherwise("").alias("raw_status"),
        (key % 4).alias("retry_count"), F.when(key % 5 == 0, 2).alias("max_retries"), F.when(key % 7 == 0, False).alias("retry_flag"), F.col("c_nationkey").alias("owner"),
    )


def task_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("question_id"), F.when(status == "F", "已入库").when(status == "O", "已校验").otherwise("待校验").alias("status"),
        F.col("o_orderpriority").alias("stem"), F.col("o_totalprice").alias("score"),
    )


SQL["turns"] = """turns AS (SELECT conv_id, turn, role, replace(replace(text, chr(10), ' '), chr(13), ' ') AS t, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations)"""
SQL["papers_md"] = """papers_md AS (SELECT conv_id AS doc_id, '1. 考生注意 请先填写' || chr(10) || '## 解答题' || chr(10)
  || coalesce(string_agg(n || '. 已知 ' || t || chr(10), '' ORDER BY turn) FILTER (role = 'user'), '') || '# 参考答案' || chr(10) || '专题二' || chr(10)
  || coalesce(string_agg(n || '. 已知 ' || t || chr(10), '' ORDER BY turn) FILTER (role = 'assistant'), '') AS markdown FROM turns GROUP BY conv_id)"""
SQL["lines"] = r"""raw_lines AS (SELECT doc_id, unnest(regexp_extract_all(markdown, '[^\n]*\n|[^\n]+')) AS raw, generate_subscripts(regexp_extract_all(markdown, '[^\n]*\n|[^\n]+'), 1) - 1 AS line FROM papers_md),
lines AS (SELECT doc_id, line, sum(length(raw)) OVER w - length(raw) AS start, sum(length(raw)) OVER w AS "end", raw, trim(ltrim(trim(raw, E' \n\t'), '#'), E' \n\t') AS heading FROM raw_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))"""


def papers_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper a conversation: a preface, a section with the user turns as questions, and an answer zone with the assistant's."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    body = F.translate("text", "\n\r", "  ")
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.count(F.when(F.col("role") == "user", 1)).over(before))
    line = F.struct("turn", F.concat(F.col("n").cast("string"), F.lit(". 已知 "), body, F.lit("\n")).alias("l"))
    side = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, line))), lambda x: x["l"]), "")
    whole = F.concat(F.lit("1. 考生注意 请先填写\n## 解答题\n"), side("user"), F.lit("# 参考答案\n专题二\n"), side("assistant"))
    return rows.groupBy(F.col("conv_id").alias("doc_id")).agg(whole.alias("markdown"))

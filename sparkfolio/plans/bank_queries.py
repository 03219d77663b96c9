"""Queries of the item bank and papers."""

from datetime import datetime

from pyspark.sql import functions as F

from sparkfolio.operators import bank
from sparkfolio.plans import views
from sparkfolio.plans.views import ctes
from sparkfolio.sources.tables import table

QUERIES = {}


def query(sql):
    """Registers a query under its function's name, with its oracle (None: not sayable in SQL)."""

    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


@query(ctes("bank", "paper_items") + """
SELECT i.paper_id, count(*) AS question_count, round(sum(coalesce(i.override_score, b.score, 0.0)), 6) AS total_score
FROM paper_items i JOIN bank b ON b.id = i.question_id GROUP BY i.paper_id""")
def paper_totals(spark, sf_dir):
    return bank.paper_totals(bank.expand_papers(views.paper_items(spark, sf_dir), views.bank(spark, sf_dir)))


@query(ctes("bank") + """
SELECT id, type, subject, difficulty, score FROM bank WHERE contains(lower(stem), 'an') AND difficulty = 'easy' AND contains(lower(subject), 'brand#1')""")
def bank_filter(spark, sf_dir):
    return bank.bank_filter(views.bank(spark, sf_dir), keyword=" An ", difficulty="easy", subject="BRAND#1", region=" ").select("id", "type", "subject", "difficulty", "score")


@query(ctes("bank") + ", f AS (SELECT * FROM bank WHERE difficulty = 'hard') SELECT id, created_at, (SELECT count(*) FROM f) AS total FROM f")
def bank_list(spark, sf_dir):
    return bank.bank_list(views.bank(spark, sf_dir), difficulty="hard").select("id", "created_at", "total")


@query(ctes("papers") + ", c AS (SELECT count(*) AS total FROM papers) SELECT id, created_at, total FROM papers, c ORDER BY created_at DESC, id LIMIT 25 OFFSET 50")
def paginate(spark, sf_dir):
    return bank.paginate(views.papers(spark, sf_dir), [F.desc("created_at"), "id"], 3, 25).select("id", "created_at", "total")


@query(ctes("papers") + " SELECT id, created_at FROM papers WHERE created_at < TIMESTAMP '1996-06-01' OR created_at = TIMESTAMP '1996-06-01' AND id > 100 ORDER BY created_at DESC, id LIMIT 25")
def page_after(spark, sf_dir):
    last = {"created_at": datetime(1996, 6, 1), "id": 100}
    return bank.page_after(views.papers(spark, sf_dir), [("created_at", True), ("id", False)], last, 25).select("id", "created_at")


@query(ctes("papers") + """
SELECT id, title, subject, grade, status FROM papers WHERE contains(lower(subject), 'o') AND contains(grade, '199')
  AND (contains(lower(title), 'raft') OR contains(lower(subject), 'raft') OR contains(grade, 'raft') OR contains(status, 'raft'))""")
def paper_filter(spark, sf_dir):
    return bank.paper_filter(views.papers(spark, sf_dir), "RAFT", "O", "199").select("id", "title", "subject", "grade", "status")


@query(ctes("bank", "rules") + """
SELECT paper_id, position, question_id FROM (
  SELECT r.paper_id, b.id AS question_id, row_number() OVER (PARTITION BY r.paper_id ORDER BY b.id) AS position, coalesce(r.count, 10) AS n FROM bank b JOIN rules r
  ON (coalesce(r.type, '') = '' OR b.type = r.type) AND (coalesce(r.difficulty, '') = '' OR b.difficulty = r.difficulty) AND contains(lower(b.subject), lower(coalesce(r.subject, '')))) WHERE position <= n""")
def select_by_rules(spark, sf_dir):
    return bank.select_by_rules(views.bank(spark, sf_dir), views.rules(spark, sf_dir))


@query(ctes("bank", "rules") + """
SELECT paper_id, position, question_id FROM (
  SELECT r.paper_id, b.id AS question_id, row_number() OVER (PARTITION BY r.paper_id ORDER BY b.created_at DESC, b.id) AS position, greatest(coalesce(r.count, 10), 1) AS n FROM bank b, rules r) WHERE position <= n""")
def select_newest(spark, sf_dir):
    return bank.select_by_rules(views.bank(spark, sf_dir), views.rules(spark, sf_dir), use_filters=False)


@query(ctes("bank", "paper_items") + """
SELECT i.paper_id, i.position, i.question_id, b.type, b.subject, coalesce(i.override_score, b.score, 0.0) AS score FROM paper_items i JOIN bank b ON b.id = i.question_id""")
def expand_papers(spark, sf_dir):
    return bank.expand_papers(views.paper_items(spark, sf_dir), views.bank(spark, sf_dir))


@query(ctes("bank", "paper_items") + """
SELECT i.paper_id, i.question_id, min(struct_pack(p := i.position, s := coalesce(i.override_score, b.score, 0.0))).s AS score
FROM paper_items i LEFT JOIN bank b ON b.id = i.question_id AND b.difficulty <> 'hard' GROUP BY i.paper_id, i.question_id""")
def build_scores(spark, sf_dir):
    known = views.bank(spark, sf_dir).where(F.col("difficulty") != "hard")
    return bank.build_scores(views.paper_items(spark, sf_dir), known).select("paper_id", F.explode("scores").alias("question_id", "score"))


def _with_children(spark, sf_dir):
    children = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 5 + 1)), lambda k: F.struct(k.alias("id"), (k * F.col("p_size")).cast("double").alias("score")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), children.alias("children"))
    picked = F.when(F.col("l_returnflag") != "N", F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"), picked.alias("selected")).join(parts, "question_id")


_CHILDREN = """WITH l AS (SELECT *, row_number() OVER () AS rid FROM lineitem),
c AS (SELECT p_partkey, unnest(range(1, (p_size % 5 + 2)::BIGINT)) AS k, p_size FROM part),
s AS (SELECT rid, l_orderkey AS paper_id, l_linenumber AS position, l_partkey AS question_id, k, k * p_size::DOUBLE AS score, coalesce(l_returnflag <> 'N' AND k IN (l_linenumber, l_linenumber + 1), false) AS hit
  FROM l JOIN c ON p_partkey = l_partkey),
t AS (SELECT *, bool_or(hit) OVER (PARTITION BY rid) AS some_hit FROM s) """


@query(_CHILDREN + "SELECT paper_id, position, question_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS children FROM t WHERE hit OR NOT some_hit GROUP BY rid, paper_id, position, question_id")
def apply_sub_selections(spark, sf_dir):
    kept = bank.apply_sub_selections(_with_children(spark, sf_dir))
    return kept.select("paper_id", "position", "question_id", F.array_join(F.transform("children", lambda c: c["id"].cast("string")), ",").alias("children"))


@query(_CHILDREN + "SELECT paper_id, position, question_id, sum(score) AS sub_score FROM t WHERE hit OR NOT some_hit GROUP BY rid, paper_id, position, question_id")
def selected_sub_score(spark, sf_dir):
    return bank.selected_sub_score(bank.apply_sub_selections(_with_children(spark, sf_dir))).select("paper_id", "position", "question_id", "sub_score")


@query("""SELECT l_orderkey AS paper_id, l_linenumber AS position, CASE WHEN l_returnflag = 'N' OR l_returnflag = 'A' AND l_linestatus = 'F' THEN
  CASE WHEN l_linenumber > 3 THEN least(greatest(72 + 7 * l_quantity, 72), 150) ELSE least(greatest(118 + 10 * l_quantity, 118), 260) END ELSE 0 END::DOUBLE AS height FROM lineitem""")
def answer_space(spark, sf_dir):
    flag = F.col("l_returnflag")
    kind = F.when(flag == "N", "solution").when(flag == "A", "unknown").otherwise("choice")
    parent = F.when(F.col("l_linestatus") == "F", "solution").otherwise("choice")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), bank.answer_space(kind, F.col("l_quantity"), parent, F.col("l_linenumber") > 3).alias("height"))


def _points(spark, sf_dir):
    top = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"), F.lit(0).alias("created_at"))
    low = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("created_at"))
    leaf = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10000).alias("id"), F.col("s_nationkey").alias("parent_id"), F.when(F.col("s_suppkey") % 9 > 0, F.col("s_name")).alias("name"), F.lit(5).alias("created_at"))
    return top.unionByName(low).unionByName(leaf)


_POINTS = """WITH RECURSIVE points AS (SELECT r_regionkey + 1000 AS id, NULL::BIGINT AS parent_id, r_name AS name, 0 AS created_at FROM region
  UNION ALL SELECT n_nationkey, n_regionkey + 1000, n_name, n_nationkey FROM nation
  UNION ALL SELECT s_suppkey + 10000, s_nationkey, CASE WHEN s_suppkey % 9 > 0 THEN s_name END, 5 FROM supplier)"""


@query(_POINTS + " SELECT id, name, created_at FROM points WHERE name IS NOT NULL")
def knowledge_points(spark, sf_dir):
    return bank.knowledge_points(_points(spark, sf_dir)).select("id", "name", "created_at")


@query(_POINTS + """, up AS (SELECT id AS ancestor, id, 0 AS level FROM points UNION ALL SELECT p.parent_id, u.id, level + 1 FROM up u JOIN points p ON p.id = u.ancestor WHERE p.parent_id IS NOT NULL)
SELECT ancestor, count(*) AS points, max(level)::INT AS depth FROM up GROUP BY ancestor""")
def point_subtrees(spark, sf_dir):
    return bank.point_subtrees(_points(spark, sf_dir), 3).groupBy("ancestor").agg(F.count(F.lit(1)).alias("points"), F.max("level").alias("depth"))


@query("SELECT lower(trim(text)) AS title_key, count(DISTINCT doc_id) AS times FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1 AND lower(trim(text)) <> ''")
def repeated_titles(spark, sf_dir):
    return bank.repeated_titles(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def batch_delete(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return bank.batch_delete(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ids)[0]


@query("SELECT count(DISTINCT l_partkey) AS deleted FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 AND p_size < 20")
def batch_delete_count(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return bank.batch_delete(table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("id")), ids)[1]


@query(ctes("assets") + """, w AS (SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN event_id % 977 END AS id, CASE WHEN event_id % 3 = 1 THEN a.url END AS url, CASE WHEN event_id % 3 = 2 THEN a.path END AS path
  FROM events JOIN assets a ON a.page_id = event_id % 101)
SELECT w.key, arg_min(a.page_id, a.page_id) AS image_id FROM w JOIN assets a ON w.id = a.page_id OR w.url = a.url OR w.path = a.path GROUP BY w.key""")
def source_lookup(spark, sf_dir):
    library, key = views.assets(spark, sf_dir), F.col("event_id")
    wanted = table(spark, sf_dir, "events").join(library, key % 101 == F.col("page_id")).select(
        key.alias("key"), F.when(key % 3 == 0, key % 977).alias("id"), F.when(key % 3 == 1, F.col("url")).alias("url"), F.when(key % 3 == 2, F.col("path")).alias("path"))
    return bank.source_lookup(wanted, library.select(F.col("page_id").alias("id"), "url", "path", F.col("page_id").alias("position")))


@query("SELECT event_id, value FROM events WHERE event_type = 'view' AND user_id = 7")
def files_by_owner(spark, sf_dir):
    files = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "business_type", "user_id": "business_id"})
    return bank.files_by_owner(files, "view", 7).select("event_id", "value")


def _diffs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    diffs = rows.select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("question_id"), F.when(flag == "A", "added").when(flag == "R", "removed").otherwise("unchanged").alias("change"), F.col("l_linenumber").cast("string").alias("detail"))
    issues = rows.where("l_quantity > 30").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("question_id"), F.col("l_linestatus").alias("code"), (F.col("l_quantity") > 45).alias("blocking"))
    return diffs, issues


@query("""WITH i AS (SELECT l_orderkey AS task_id, l_partkey AS question_id, bool_or(l_quantity > 45) AS blocking FROM lineitem WHERE l_quantity > 30 GROUP BY ALL),
t AS (SELECT task_id, count(*) FILTER (blocking) AS blocking, count(*) AS review_required FROM i GROUP BY task_id),
c AS (SELECT l_orderkey AS task_id, count(*) AS changed, string_agg(l_partkey || ' ' || CASE l_returnflag WHEN 'A' THEN 'added' ELSE 'removed' END || ' ' || l_linenumber, chr(10) ORDER BY l_partkey || ' ' || CASE l_returnflag WHEN 'A' THEN 'added' ELSE 'removed' END || ' ' || l_linenumber) AS lines FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT task_id, coalesce(changed, 0) AS changed, coalesce(blocking, 0) AS blocking, coalesce(review_required, 0) AS review_required, coalesce(lines, '') AS lines FROM c FULL JOIN t USING (task_id)""")
def review_queue(spark, sf_dir):
    return bank.review_queue(*_diffs(spark, sf_dir))[1]


@query("""SELECT l_orderkey AS task_id, l_partkey AS question_id, bool_or(l_quantity > 45) AS blocking, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS reasons FROM lineitem WHERE l_quantity > 30 GROUP BY ALL""")
def review_questions(spark, sf_dir):
    return bank.review_queue(*_diffs(spark, sf_dir))[0].withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH i AS (SELECT l_orderkey AS paper_id, l_linenumber AS position, l_partkey AS question_id FROM lineitem WHERE l_linenumber <= 3),
p AS (SELECT l_orderkey AS paper_id, l_partkey % 50 AS question_id, min(l_linenumber) AS first_at FROM lineitem GROUP BY ALL),
n AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.paper_id = p.paper_id AND i.question_id = p.question_id)),
m AS (SELECT paper_id, max(position) AS last FROM i GROUP BY 1)
SELECT paper_id, position, question_id FROM i UNION ALL
SELECT paper_id, (coalesce(last, 0) + row_number() OVER (PARTITION BY paper_id ORDER BY first_at, question_id))::INT, question_id FROM n LEFT JOIN m USING (paper_id)""")
def unique_appends(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"))
    return bank.unique_appends(rows.where("position <= 3"), rows.withColumn("question_id", F.col("question_id") % 50))

"""Queries of canonicalisation, over questions made of conversation turns and the item bank's tables."""

from pyspark.sql import functions as F

from sparkfolio.operators import canon
from sparkfolio.plans import views
from sparkfolio.plans.views import ctes
from sparkfolio.sources.tables import table

QUERIES = {}


def query(sql):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def _sides(spark, sf_dir):
    """Turns as questions, with their whole texts: user turns are the paper; the answer zone repeats them with some change and holds the assistant's turns."""
    rows = table(spark, sf_dir, "conversations")
    q = rows.select(
        F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("turn").alias("position"), (F.floor(F.col("turn") / 2) + 1).alias("number"),
        F.when(F.col("turn") % 5 > 0, F.when(F.col("conv_id") % 2 == 0, "choice").otherwise("solution")).alias("type"), F.col("text").alias("stem"), "role",
        F.when(F.col("turn") % 3 > 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("options"), F.array(F.lit("图1")).alias("images"))
    paper = q.where("role = 'user'").drop("role")
    # the answer side: every paper question again, a third shortened, a third under another number
    n = F.col("question_id") % 3
    answers = paper.withColumn("stem", F.when(n == 1, F.expr("substring(stem, 1, length(stem) div 2)")).otherwise(F.col("stem"))).withColumn("number", F.when(n == 2, F.col("number") + 1).otherwise(F.col("number")))
    answers = answers.unionByName(q.where("role = 'assistant'").drop("role"))
    answers = answers.withColumn("question_id", F.col("question_id") + 500).withColumn("position", F.col("position") + 500)
    return paper, answers


#: DuckDB's levenshtein counts bytes: each pair's characters are numbered, so that those of up to 127 different ones are a byte each.
_SIDES = r"""WITH q AS (SELECT conv_id AS doc_id, conv_id * 1000 + turn AS id, turn AS position, turn // 2 + 1 AS number, CASE WHEN turn % 5 > 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'choice' ELSE 'solution' END END AS type, coalesce(text, '') AS stem, role FROM conversations),
p AS (SELECT * EXCLUDE role FROM q WHERE role = 'user'),
a AS (SELECT doc_id, id + 500 AS id, CASE WHEN id % 3 = 2 THEN number + 1 ELSE number END AS number, type, CASE WHEN id % 3 = 1 THEN substr(stem, 1, length(stem) // 2) ELSE stem END AS stem FROM p
  UNION ALL SELECT doc_id, id + 500, number, type, stem FROM q WHERE role = 'assistant'),
pairs AS (SELECT a.doc_id, a.id AS answer_id, p.id AS paper_id, p.position, p.type AS p_type, a.type AS a_type, list_transform([p.stem, a.stem], lambda x:
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\begin\{tasks\}.*?\\end\{tasks\}', '', 'gis'), '^\s*\d+\s*[.．、]\s*', ''), '【\s*(?:分析|解答|答案|点评|详解)\s*】.*$', '', 's'), '[\s\p{Z}]+', '', 'g'), '。．')) AS cores FROM p JOIN a ON a.doc_id = p.doc_id AND a.number = p.number),
chars AS (SELECT *, list_distinct(string_split(cores[1] || cores[2], '')) AS c FROM pairs),
coded AS (SELECT *, list_transform(cores, lambda x: translate(x, array_to_string(c, ''), array_to_string(list_transform(range(1, len(c) + 1), lambda i: chr(i::INT)), ''))) AS s FROM chars),
core AS (SELECT doc_id, answer_id, paper_id, position, 0.45 + 0.35 * CASE WHEN cores[1] <> '' AND cores[2] <> '' THEN 1 - levenshtein(s[1], s[2])::DOUBLE / greatest(length(s[1]), length(s[2])) ELSE 0 END
  + 0.1 + 0.1 * CASE WHEN p_type IS NULL OR a_type IS NULL THEN 0.5 WHEN p_type = a_type THEN 1 ELSE 0 END AS s FROM coded),
scores AS (SELECT doc_id, answer_id, paper_id, position, round_even(s, 6) AS score FROM core),
ranked AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS runner_up FROM scores WINDOW w AS (PARTITION BY doc_id, answer_id ORDER BY score DESC, position)),
decisions AS (SELECT doc_id, answer_id, paper_id, score, runner_up, CASE WHEN score >= 0.75 AND score - runner_up >= 0.12 THEN 'merge' WHEN score >= 0.65 THEN 'review' ELSE 'none' END AS decision FROM ranked WHERE k = 1)"""


def _decisions(spark, sf_dir):
    return canon.merge_decisions(canon.match_scores(*_sides(spark, sf_dir), ratio="levenshtein"))


@query(ctes("turns", "papers_md") + " SELECT doc_id, instr(markdown, '# 参考答案') - 1 AS zone_start FROM papers_md")
def answer_zone(spark, sf_dir):
    return canon.answer_zone(views.papers_md(spark, sf_dir)).withColumn("zone_start", F.col("zone_start").cast("long"))


@query(_SIDES + " SELECT doc_id, answer_id, paper_id, position, score FROM scores")
def match_scores(spark, sf_dir):
    return canon.match_scores(*_sides(spark, sf_dir), ratio="levenshtein")


@query(None)
def match_scores_ratcliff(spark, sf_dir):
    return canon.match_scores(*_sides(spark, sf_dir))


@query(_SIDES + " SELECT doc_id, answer_id, paper_id, decision FROM decisions")
def merge_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("doc_id", "answer_id", "paper_id", "decision")


def _answered(spark, sf_dir):
    paper, answers = _sides(spark, sf_dir)
    bare = paper.withColumn("answer", F.when(F.col("position") % 4 == 0, "own").otherwise(" ")).withColumn("analysis", F.lit(""))
    full = answers.withColumn("answer", F.col("number").cast("string")).withColumn("analysis", F.lit("why"))
    return bare.unionByName(full).select("doc_id", "question_id", "position", "answer", "analysis")


@query(_SIDES + """, m AS (SELECT d.paper_id, a.id, a.number, row_number() OVER (PARTITION BY d.paper_id ORDER BY a.id) AS k FROM decisions d JOIN a ON a.id = d.answer_id WHERE decision = 'merge'),
f AS (SELECT paper_id, min(number) FILTER (k = 1) AS first, count(*) AS n, bool_or(number <> 0) AS odd FROM m GROUP BY 1)
SELECT p.doc_id, p.id AS question_id, CASE WHEN p.position % 4 = 0 THEN 'own' ELSE coalesce(f.first::VARCHAR, ' ') END AS answer, CASE WHEN n IS NULL THEN '' ELSE 'why' END AS analysis, coalesce(n, 0)::INT AS merged, CASE WHEN n > 0 AND p.position % 4 = 0 THEN 'answer-conflict' ELSE '' END AS conflicts FROM p LEFT JOIN f ON f.paper_id = p.id
UNION ALL SELECT a.doc_id, a.id, a.number::VARCHAR, 'why', 0, '' FROM a WHERE a.id NOT IN (SELECT id FROM m)""")
def apply_merges(spark, sf_dir):
    out = canon.apply_merges(_answered(spark, sf_dir), _decisions(spark, sf_dir))
    return out.select("doc_id", "question_id", "answer", "analysis", F.size("merged_from").alias("merged"), F.array_join("conflicts", ",").alias("conflicts"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, l_quantity::INT % 9 AS x FROM lineitem),
w AS (SELECT id, n, x, x AS last, 'kept' AS what FROM l WHERE n = 1 UNION ALL
  SELECT l.id, l.n, l.x, greatest(l.x, w.last), CASE WHEN l.x > w.last THEN 'kept' WHEN l.x = w.last THEN 'repeated' ELSE 'regressing' END FROM w JOIN l ON l.id = w.id AND l.n = w.n + 1)
SELECT id, string_agg('(' || x || ')', ',' ORDER BY n) AS labels, coalesce(string_agg('(' || x || ')', ',' ORDER BY n) FILTER (what = 'kept'), '') AS kept, coalesce(string_agg('(' || x || ')', ',' ORDER BY n) FILTER (what = 'repeated'), '') AS repeated,
  coalesce(string_agg('(' || x || ')', ',' ORDER BY n) FILTER (what = 'regressing'), '') AS regressing FROM w GROUP BY id""")
def clean_label_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: F.concat(F.lit("("), (x["l_quantity"].cast("int") % 9).cast("string"), F.lit(")"))).alias("labels"))
    return canon.clean_label_runs(rows).select("id", *[F.array_join(c, ",").alias(c) for c in ("labels", "kept", "repeated", "regressing")])


@query(_SIDES + """ SELECT doc_id, id AS source_id, id AS canonical_id FROM p UNION ALL SELECT a.doc_id, a.id, coalesce(d.paper_id, a.id) FROM a LEFT JOIN decisions d ON d.answer_id = a.id AND decision = 'merge'""")
def id_map(spark, sf_dir):
    return canon.id_map(_answered(spark, sf_dir), _decisions(spark, sf_dir))


@query("""WITH r AS (SELECT user_id AS doc_id, event_type AS id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT doc_id, event_id, CASE WHEN n > 1 THEN id || '__occurrence_' || n ELSE id END AS unique_id FROM r""")
def occurrence_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("id"), F.col("event_id").alias("position"), "event_id")
    return canon.occurrence_ids(rows).select("doc_id", "event_id", "unique_id")


@query("SELECT o_orderkey, 'import_question_' || substr(sha256(o_custkey || ':' || o_orderkey), 1, 24) AS question, substr(sha1(o_orderkey::VARCHAR), 1, 12) AS placement FROM orders")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", canon.stable_question_id(F.col("o_custkey"), F.col("o_orderkey")).alias("question"), canon.stable_placement_id(F.col("o_orderkey")).alias("placement"))


def _versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    base = rows.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") % 5).alias("number"), F.col("o_orderpriority").alias("stem"), (F.col("o_orderkey") % 4).alias("options"), F.col("o_orderstatus").alias("placements"))
    k = F.col("source_id")
    before = base.where(k % 11 > 0)
    after = base.where(k % 13 > 0).withColumn("number", F.when(k % 3 == 0, F.col("number") + 1).otherwise(F.col("number"))).withColumn("stem", F.when(k % 7 == 0, "new").otherwise(F.col("stem"))).withColumn("placements", F.when(k % 2 == 0, F.lit("F")).otherwise(F.col("placements")))
    return before, after


@query("""SELECT o_custkey AS doc_id, o_orderkey AS source_id, CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' ELSE
  concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'renumbered' END, CASE WHEN o_orderkey % 7 = 0 THEN 'stem' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'placement' END) END AS changes FROM orders WHERE o_orderkey % 11 > 0 OR o_orderkey % 13 > 0""")
def structure_diff(spark, sf_dir):
    return canon.structure_diff(*_versions(spark, sf_dir)).withColumn("changes", F.array_join("changes", ","))


@query("""SELECT o_custkey AS doc_id, o_orderkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN 'edited' ELSE o_orderpriority END AS stem, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 AND o_orderkey % 3 > 0 THEN 'a' ELSE 'gen' END AS answer,
  CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 2 END AS options, concat_ws(',', CASE WHEN o_orderkey % 5 > 0 THEN 'i:new' ELSE 'i:old' END, 'j:new') AS placements FROM orders""")
def preserve_edits(spark, sf_dir):
    k = F.col("question_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("question_id"), "o_orderpriority")
    place = lambda t, s: F.struct(F.lit(t).alias("target"), s.alias("status"))
    existing = rows.select("doc_id", "question_id", F.when(k % 3 == 0, "edited").alias("stem"), F.when(k % 4 == 0, "a").otherwise("").alias("answer"), F.lit("choice").alias("type"), F.array(F.lit("A"), F.lit("B")).alias("options"), (k % 2 == 1).alias("reviewed"),
                           F.create_map(F.lit("i"), place("old", F.when(k % 5 == 0, "confirmed").otherwise("auto"))).alias("placements"))
    generated = rows.select("doc_id", "question_id", F.col("o_orderpriority").alias("stem"), F.lit("gen").alias("answer"), F.lit("choice").alias("type"), F.array(*[F.lit(x) for x in "ABCD"]).alias("options"), F.lit(False).alias("reviewed"),
                            F.create_map(F.lit("i"), place("new", F.lit("auto")), F.lit("j"), place("new", F.lit("auto"))).alias("placements"))
    out = canon.preserve_edits(existing, generated)
    shown = F.array_join(F.sort_array(F.transform(F.map_entries("placements"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["target"]))), ",")
    return out.select("doc_id", "question_id", "stem", "answer", F.size("options").alias("options"), shown.alias("placements"))


@query("""WITH r AS (SELECT user_id AS doc_id, event_id AS start, event_id % 6 AS number, event_id % 2 = 0 AS in_answers, event_type FROM events), s AS (SELECT * FROM r WHERE event_type <> 'click'),
h AS (SELECT doc_id, number, in_answers, count(*) AS n FROM s GROUP BY ALL), x AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id, r.number, r.in_answers ORDER BY r.start) AS nth, coalesce(h.n, 0) AS have FROM r LEFT JOIN h USING (doc_id, number, in_answers))
SELECT doc_id, start, number FROM s UNION ALL SELECT doc_id, start, number FROM x WHERE nth > have AND event_type IN ('click', 'view')""")
def recover_missing(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), k.alias("start"), (k % 6).alias("number"), (k % 2 == 0).alias("in_answers"), F.when(F.col("event_type").isin("click", "view"), "inline-section").otherwise("line-start").alias("kind"), "event_type")
    return canon.recover_missing(rows.where("event_type <> 'click'"), rows).select("doc_id", "start", "number")


def _bank(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("source_task"), F.when(F.col("doc_id") % 10 == 0, (F.col("doc_id") % 100).cast("string")).otherwise("").alias("source_question"), F.col("text").alias("stem"), F.lit("").alias("answer"))


@query("""WITH b AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 10 = 0 THEN (doc_id % 100)::VARCHAR ELSE '' END AS q, lower(trim(text)) AS k FROM documents),
s AS (SELECT source, q, min(id) AS a, max(id) AS z FROM b WHERE q <> '' GROUP BY ALL), c AS (SELECT k, min(id) AS a, max(id) AS z FROM b GROUP BY 1)
SELECT id, coalesce(CASE WHEN s.a <> id THEN s.a WHEN s.z <> id THEN s.z END, CASE WHEN c.a <> id THEN c.a WHEN c.z <> id THEN c.z END) AS duplicate_of,
  CASE WHEN s.a <> id OR s.z <> id THEN 'same-source' WHEN c.a <> id OR c.z <> id THEN 'same-content' END AS reason FROM b LEFT JOIN s USING (source, q) LEFT JOIN c USING (k)""")
def exact_duplicates(spark, sf_dir):
    bank = _bank(spark, sf_dir)
    return canon.exact_duplicates(bank, bank)


@query("""WITH d AS (SELECT doc_id, source, lower(trim(text)) AS k, text FROM documents), b AS (SELECT * FROM d WHERE doc_id % 3 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM d WHERE doc_id % 3 > 0)
SELECT doc_id AS id, source AS source_task, length(text) AS n_chars FROM b UNION ALL SELECT doc_id + 1000000, source, length(text) FROM f WHERE n = 1 AND k NOT IN (SELECT k FROM b)""")
def bank_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bank = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("source_task"), F.col("doc_id").alias("source_question"), F.col("text").alias("stem"), F.lit("").alias("answer"), F.lit(1).alias("created_at"))
    batch = d.where("doc_id % 3 > 0").select((F.col("doc_id") + 1000000).alias("new_id"), F.col("source").alias("source_task"), F.col("doc_id").alias("source_question"), F.col("text").alias("stem"), F.lit("").alias("answer"), F.lit(2).alias("created_at"),
                                             F.col("doc_id").alias("position"), F.lit("已校验").alias("status"), F.lit(None).cast("long").alias("bank_id"))
    return canon.bank_upsert(batch, bank)[0].select("id", "source_task", F.length("stem").alias("n_chars"))


@query("""SELECT o_custkey AS task_id, sha256(string_agg(h, '' ORDER BY h)) AS token FROM (SELECT o_custkey, sha256('{"o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders) GROUP BY 1""")
def content_token(spark, sf_dir):
    return canon.content_token(table(spark, sf_dir, "orders").withColumn("task_id", F.col("o_custkey")), "o_orderstatus", "o_orderkey")


@query("SELECT DISTINCT o_custkey AS task_id, o_custkey % 2 = 0 AS fresh FROM orders")
def fresh_tokens(spark, sf_dir):
    tokens = content_token(spark, sf_dir)
    offered = tokens.withColumn("token", F.when(F.col("task_id") % 2 == 0, F.col("token")).otherwise("old"))
    return canon.fresh_tokens(tokens, offered)


@query("""WITH s AS (SELECT o_custkey AS task_id, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F')
SELECT task_id, version AS question_id FROM s WHERE k = 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT task_id FROM s)""")
def rollback_latest(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.lit(-1).cast("long").alias("question_id"))
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"), F.array(F.struct(F.col("o_orderkey").alias("question_id"))).alias("rows"))
    return canon.rollback_latest(current, snapshots, "F")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'c1:(1):new1,c2:(2):new2,:(9):extra' ELSE 'c1:(1):new2,c2:(2):old2,:(9):extra' END AS merged FROM part""")
def merge_child_updates(spark, sf_dir):
    child = lambda i, label, content: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(content).alias("content"))
    current = F.array(child("c1", "(1)", "old1"), child("c2", "(2)", "old2"))
    even = F.array(child("", "(9)", "extra"), child("", "(2)", "new2"), child("c1", "", "new1"))
    odd = F.array(child("", "(9)", "extra"), child("", "(1)", "new2"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), current.alias("current"), F.when(F.col("p_size") % 2 == 0, even).otherwise(odd).alias("incoming"))
    out = canon.merge_child_updates(rows)
    return out.select("id", F.array_join(F.transform("merged", lambda c: F.concat_ws(":", c["id"], c["label"], c["content"])), ",").alias("merged"))


@query(ctes("assets") + """, i AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS owner_id, page_id % 3 AS priority, page_id AS position, CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 5 < 3 THEN path ELSE nullif(name, '') END AS key FROM assets)
SELECT owner_id, position, key FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, key ORDER BY priority, position) AS k FROM i WHERE key IS NOT NULL) WHERE k = 1""")
def dedupe_images(spark, sf_dir):
    n = F.col("page_id")
    rows = views.assets(spark, sf_dir).select(
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("owner_id"), (n % 3).alias("priority"), n.alias("position"), F.lit(None).cast("string").alias("storage_id"), F.when(n % 5 == 0, F.col("url")).alias("url"), F.when(n % 5 < 3, F.col("path")).otherwise("").alias("path"), "name")
    return canon.dedupe_images(rows).select("owner_id", "position", "key")


@query(_SIDES + """, c AS (SELECT doc_id, count(*) FILTER (decision = 'merge') AS merges, count(*) FILTER (decision = 'review') AS reviews FROM decisions GROUP BY 1), t AS (SELECT doc_id, count(*) AS questions FROM (SELECT doc_id FROM p UNION ALL SELECT doc_id FROM a) GROUP BY 1)
SELECT doc_id, questions, coalesce(merges, 0) AS merges, coalesce(reviews, 0) AS reviews, coalesce(reviews, 0) > 0 AS blocked FROM t LEFT JOIN c USING (doc_id)""")
def canonicalize(spark, sf_dir):
    paper, answers = _sides(spark, sf_dir)
    both = paper.withColumn("start", F.lit(0)).unionByName(answers.withColumn("start", F.lit(10))).withColumn("answer", F.lit("")).withColumn("analysis", F.lit(""))
    docs = both.select("doc_id").distinct().withColumn("markdown", F.lit("题目\n\n# 参考答案\n1. x"))
    return canon.canonicalize(docs, both, ratio="levenshtein")[1]


@query("""WITH s AS (SELECT o_custkey AS t, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey AS task_id, 'edit' AS kind, coalesce(any_value(last), 0) + 1 AS version, count(*)::INT AS n FROM orders LEFT JOIN s ON t = o_custkey GROUP BY 1""")
def snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "task_id")
    past = orders.where("o_orderstatus = 'F'").select("task_id", F.col("o_orderkey").alias("version"))
    return canon.snapshot(orders.select("task_id", "o_orderkey", "o_totalprice"), past, "edit", F.lit("2024-01-01")).select("task_id", "kind", "version", F.size("rows").alias("n"))


@query("""WITH h AS (SELECT p_partkey AS id, md5(p_name) AS h FROM part)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INT & 3), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS image_id FROM h""")
def stable_image_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), canon.stable_image_id(F.col("p_name")).alias("image_id"))

"""Queries of document segmentation, over papers made of conversations."""

from pyspark.sql import functions as F

from sparkfolio.functions import patterns as P
from sparkfolio.operators import segment
from sparkfolio.plans import views
from sparkfolio.plans.views import ctes
from sparkfolio.sources.tables import table

QUERIES = {}
_LINES = ctes("turns", "papers_md", "lines")


#: What the folds come to on these papers: user turns count on from 1 and are all taken; answers are taken from a 1 on, each number once, if there are two questions or more.
_TAKEN = _LINES + r""", numbered AS (
  SELECT doc_id, line, start, raw, try_cast(regexp_extract(heading, '^(\d{1,3})\. 已知', 1) AS INT) AS number, count(*) FILTER (heading = '专题二') OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) + 1 AS section FROM lines),
sides AS (SELECT *, max(number) FILTER (section = 1) OVER (PARTITION BY doc_id) AS last, bool_or(section = 2 AND number = 1) OVER (PARTITION BY doc_id) AS one, row_number() OVER (PARTITION BY doc_id, section, number ORDER BY line) AS nth FROM numbered WHERE number IS NOT NULL),
taken AS (SELECT doc_id, number, start::INT AS start, section::INT AS section, CASE section WHEN 1 THEN 'solution' ELSE 'unknown' END AS type, section = 2 AND number = 1 AS reset, raw FROM sides WHERE section = 1 OR last >= 2 AND one AND number > 0 AND nth = 1),
starts AS (SELECT doc_id, start FROM taken UNION SELECT doc_id, start::INT FROM lines WHERE heading IN ('解答题', '专题二')),
spans AS (
  SELECT t.*, 'q_' || number || CASE WHEN row_number() OVER (PARTITION BY doc_id, number ORDER BY start) > 1 THEN '_2' ELSE '' END AS question_id, coalesce((SELECT min(s.start) FROM starts s WHERE s.doc_id = t.doc_id AND s.start > t.start), length(markdown))::INT AS stop
  FROM taken t JOIN papers_md USING (doc_id)),
trimmed AS (SELECT *, CASE WHEN section = 1 AND row_number() OVER (PARTITION BY doc_id, section ORDER BY start DESC) = 1 THEN start + length(rtrim(raw, E' \n\t\r')) ELSE stop END::INT AS cut FROM spans)"""


def query(sql):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def _lines(spark, sf_dir):
    return segment.classify_headings(segment.index_lines(views.papers_md(spark, sf_dir)))


def _accepted(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return segment.accept_anchors(segment.anchor_candidates(lines), segment.structure_contract(lines))


def _spans(spark, sf_dir):
    return segment.question_spans(_accepted(spark, sf_dir), _lines(spark, sf_dir), views.papers_md(spark, sf_dir))


def _texts(spark, sf_dir):
    return segment.span_text(_spans(spark, sf_dir), views.papers_md(spark, sf_dir))


@query(_LINES + ' SELECT doc_id, line::INT AS line, start::INT AS start, "end"::INT AS "end", heading FROM lines')
def index_lines(spark, sf_dir):
    return segment.index_lines(views.papers_md(spark, sf_dir)).drop("raw")


@query(_LINES + """ SELECT doc_id, line::INT AS line, CASE WHEN contains(heading, '选择') THEN 'choice' WHEN contains(heading, '填空') THEN 'fill_blank' WHEN regexp_matches(heading, '解答|证明|计算') THEN 'solution' ELSE 'unknown' END AS section_type,
  heading = '解答题' AS is_section, heading = '专题二' AS is_topic FROM lines""")
def classify_headings(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", "section_type", "is_section", "is_topic")


@query(_LINES + " SELECT doc_id, NULL::INT AS total, min(start)::INT AS first_section_start, count(*) AS sections FROM lines WHERE heading = '解答题' GROUP BY 1")
def structure_contract(spark, sf_dir):
    return segment.structure_contract(_lines(spark, sf_dir)).select("doc_id", "total", "first_section_start", F.size("sections").cast("long").alias("sections"))


@query(_LINES + r""", numbered AS (SELECT doc_id, start, heading, try_cast(regexp_extract(heading, '^(\d{1,3})\. ', 1) AS INT) AS number FROM lines WHERE regexp_matches(heading, '^\d{1,3}\. '))
SELECT doc_id, number, contains(heading, '考生注意') AS preface, contains(heading, '已知') AS strong FROM numbered""")
def score_anchors(spark, sf_dir):
    """The context-free marks of numbered lines."""
    c = segment.anchor_candidates(_lines(spark, sf_dir)).where("number IS NOT NULL")
    return c.select("doc_id", "number", "preface", "strong")


@query(_TAKEN + " SELECT doc_id, number, start, section, type, reset, 'line-start' AS kind FROM taken")
def accept_anchors(spark, sf_dir):
    return _accepted(spark, sf_dir).drop("score")


@query(_TAKEN + ' SELECT doc_id, question_id, number, start, stop AS "end" FROM spans')
def question_spans(spark, sf_dir):
    return _spans(spark, sf_dir).select("doc_id", "question_id", "number", "start", "end")


@query(_TAKEN + ' SELECT doc_id, question_id, start, cut AS "end" FROM trimmed')
def trim_tail(spark, sf_dir):
    return segment.trim_tail(_texts(spark, sf_dir)).select("doc_id", "question_id", "start", "end")


def _labelled(spark, sf_dir):
    """Stems with two parts and, after them, four options; the length and id make the positions differ."""
    q = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("题"), F.col("n_chars").cast("string"), F.lit(" (1) 已知"), F.col("doc_id").cast("string"), F.lit(" （2）求\nA. x"), F.col("doc_id").cast("string"), F.lit(" B. y C. z\nD、w"))
    return q.select("doc_id", F.lit("solution").alias("type"), F.lit(0).alias("start"), F.length(body).alias("end"), body.alias("text"))


_LABELLED = """WITH d AS (SELECT doc_id, '题' || n_chars || ' (1) 已知' || doc_id || ' （2）求' || chr(10) || 'A. x' || doc_id || ' B. y C. z' || chr(10) || 'D、w' AS t, length(n_chars::VARCHAR) AS a, length(doc_id::VARCHAR) AS b FROM documents)"""


@query(_LABELLED + """ SELECT doc_id, 0 AS n, '(1)' AS label, (2 + a)::INT AS start, (5 + a)::INT AS content_start, (9 + a + b)::INT AS "end" FROM d
UNION ALL SELECT doc_id, 1, '(2)', (9 + a + b)::INT, (12 + a + b)::INT, length(t)::INT FROM d""")
def sub_question_spans(spark, sf_dir):
    return segment.sub_question_spans(_labelled(spark, sf_dir)).select("doc_id", F.posexplode("parts").alias("n", "p")).select("doc_id", "n", "p.*")


@query(_LABELLED + """, p AS (SELECT doc_id, t, instr(t, 'A. ') - 1 AS pa, instr(t, 'B. ') - 1 AS pb, instr(t, 'C. ') - 1 AS pc, instr(t, 'D、') - 1 AS pd FROM d)
SELECT doc_id, 0 AS n, 'A' AS label, pa::INT AS start, (pa + 3)::INT AS content_start, pb::INT AS "end" FROM p UNION ALL SELECT doc_id, 1, 'B', pb::INT, (pb + 3)::INT, pc::INT FROM p
UNION ALL SELECT doc_id, 2, 'C', pc::INT, (pc + 3)::INT, pd::INT FROM p UNION ALL SELECT doc_id, 3, 'D', pd::INT, (pd + 2)::INT, length(t)::INT FROM p""")
def option_spans(spark, sf_dir):
    return segment.option_spans(_labelled(spark, sf_dir)).select("doc_id", F.posexplode("options").alias("n", "o")).select("doc_id", "n", "o.*")


_WITH_REFS = "SELECT page_id AS doc_id, 'see ![x](' || regexp_extract(regexp_extract(url, '^[^?#]*', 0), '[^/]*$', 0) || ') and ![](<none.png>)' AS markdown FROM pages"


@query(ctes("assets") + f""", d AS ({_WITH_REFS}), f AS (SELECT name, arg_min(path, page_id) AS path FROM assets GROUP BY name)
SELECT d.doc_id, a.name AS path, 4 AS start, (4 + 6 + length(a.name))::INT AS "end", f.path AS asset_path FROM d JOIN assets a ON a.page_id = d.doc_id JOIN f ON f.name = a.name WHERE a.name <> ''
UNION ALL SELECT d.doc_id, 'none.png', (4 + 6 + length(a.name) + 5)::INT, length(markdown)::INT, NULL FROM d JOIN assets a ON a.page_id = d.doc_id WHERE a.name <> ''""")
def image_refs(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    docs = a.where("name <> ''").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("see ![x]("), "name", F.lit(") and ![](<none.png>)")).alias("markdown"))
    exact = a.select("path", F.col("page_id").alias("position"))
    found = segment.image_refs(docs, exact)
    by_name = a.groupBy("name").agg(F.min_by("path", "page_id").alias("first"))
    return found.join(by_name, found["path"] == by_name["name"], "left").select("doc_id", "path", "start", "end", F.coalesce(F.when(F.col("asset_path").isNotNull(), F.col("first")), "asset_path").alias("asset_path"))


@query(r"""SELECT conv_id, turn, 'Q' AS stem, CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) > 0 THEN trim(regexp_replace(text, '[\n\r]', ' ', 'g'), E' \t\n\r\x0b\x0c') ELSE '' END AS answer, 'why' AS analysis FROM conversations""")
def extract_solutions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.lit("Q\n【答案】"), F.regexp_replace("text", "[\n\r]", " "), F.lit("【解析】why")))
    out = segment.extract_solutions(rows).select("conv_id", "turn", "stem", "answer", "analysis")
    return out


@query(_TAKEN + """ SELECT doc_id, question_id, number, type, start, cut AS "end", cut - start AS n_chars, '' AS answer, 0 AS parts FROM trimmed""")
def build_questions(spark, sf_dir):
    q = segment.build_questions(_texts(spark, sf_dir))
    return q.select("doc_id", "question_id", "number", "type", "start", "end", F.length("stem").alias("n_chars"), "answer", F.size("parts").alias("parts"))


@query(_TAKEN + """, w AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM taken),
a AS (SELECT doc_id, count(*) AS n, count(DISTINCT number) AS d, bool_or(prev IS NOT NULL AND NOT reset AND number <> prev + 1) AS gap, bool_or(reset) AS resets, bool_or(reset AND prev < 2) AS odd FROM w GROUP BY 1)
SELECT p.doc_id, coalesce(n, 0) AS question_count, concat_ws(',', CASE WHEN n IS NULL THEN 'no-question-boundaries' END, CASE WHEN d < n AND NOT (resets AND NOT gap AND NOT odd) THEN 'duplicate-question-number' END, CASE WHEN gap THEN 'question-number-gap' END) AS reasons FROM papers_md p LEFT JOIN a USING (doc_id)""")
def boundary_confidence(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    q = segment.option_spans(_texts(spark, sf_dir))
    return segment.boundary_confidence(views.papers_md(spark, sf_dir), q, segment.structure_contract(lines)).withColumn("reasons", F.array_join("reasons", ","))


@query(_TAKEN + " SELECT doc_id, CASE WHEN count(DISTINCT number) < count(*) THEN 'duplicate-number' ELSE '' END AS errors, 'unanswered' AS warnings FROM taken GROUP BY 1")
def validate_structure(spark, sf_dir):
    q = segment.build_questions(_texts(spark, sf_dir))
    out = segment.validate_structure(q, segment.structure_contract(_lines(spark, sf_dir)))
    return out.select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def _candidates(spark, sf_dir, shift):
    rows = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") + shift * F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("doc_id"), (F.col("k") % 3 == 0).alias("valid"), (F.col("k") % 5).alias("evidence"), (F.col("k") % 2).alias("choices"), (F.col("k") % 7).alias("options"), (F.col("k") % 4).alias("images"))


@query("""WITH c AS (SELECT o_orderkey AS doc_id, o_custkey AS a, o_custkey + o_orderkey AS b FROM orders)
SELECT doc_id, CASE WHEN a % 3 <> 0 AND (b % 3 = 0 OR (b % 5, b % 2, b % 7, b % 4) > (a % 5, a % 2, a % 7, a % 4)) THEN 'fallback' ELSE 'primary' END AS chosen FROM c""")
def choose_candidate(spark, sf_dir):
    return segment.choose_candidate(_candidates(spark, sf_dir, 0), _candidates(spark, sf_dir, 1))


@query(_LINES + r""", n AS (SELECT *, try_cast(regexp_extract(heading, '^(\d{1,3})\. ', 1) AS INT) AS number FROM lines),
q AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS question, last_value(CASE WHEN heading = '解答题' THEN 'solution' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM n)
SELECT doc_id, question, coalesce(arg_min(coalesce(section, 'unknown'), line), 'unknown') AS section, max(number) AS number, length(trim(string_agg(raw, '' ORDER BY line), E' \t\n\r')) AS n_chars FROM q WHERE question > 0 AND heading <> '解答题' GROUP BY 1, 2""")
def split_simple(spark, sf_dir):
    return segment.split_simple(_lines(spark, sf_dir)).select("doc_id", "question", "section", "number", F.length("body").alias("n_chars"))


def _line_items(spark, sf_dir):
    step = F.col("l_linenumber") * 1000
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), step.alias("start")).agg((F.max("l_quantity").cast("int") + step).cast("int").alias("end"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber) - 1 AS k FROM s)
SELECT doc_id, (k // 3)::INT AS chunk, min(k)::INT AS first, max(k)::INT AS last FROM n GROUP BY 1, 2""")
def plan_chunks(spark, sf_dir):
    return segment.plan_chunks(_line_items(spark, sf_dir), 3, 100000).select("doc_id", "chunk", "first", "last")


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS chunk, l_linenumber AS start FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY ALL), r AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS chunk, 10 + l_linenumber AS start FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY ALL),
a AS (SELECT *, 'refined' AS kind FROM r UNION ALL SELECT *, 'local' FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.chunk = l.chunk))
SELECT doc_id, start + 100 * chunk AS start, kind FROM a GROUP BY ALL""")
def merge_chunk_results(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("chunk"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 5).alias("end"), (F.col("l_linenumber") % 2 * 100).alias("offset"), "l_partkey")
    local = rows.where("l_partkey % 3 > 0").drop("l_partkey").withColumn("kind", F.lit("local"))
    refined = rows.where("l_partkey % 3 = 0").drop("l_partkey").withColumn("start", F.col("start") + 10).withColumn("kind", F.lit("refined"))
    return segment.merge_chunk_results(local, refined).select("doc_id", "start", "kind")


@query(_LINES + r""", n AS (SELECT doc_id, start, try_cast(regexp_extract(heading, '^(\d{1,3})\. ', 1) AS INT) AS number FROM lines), f AS (SELECT doc_id, number, min(start) AS start FROM n WHERE number IS NOT NULL GROUP BY 1, 2),
e AS (SELECT f.doc_id, f.number, f.start, min(n.start) AS stop FROM f LEFT JOIN n ON n.doc_id = f.doc_id AND n.start > f.start AND n.number > f.number GROUP BY 1, 2, 3)
SELECT e.doc_id, number, length(substr(trim(substr(markdown, (start + 1)::BIGINT, (coalesce(stop, length(markdown)) - start)::BIGINT), E' \t\n\r'), 1, 6000)) AS n_chars FROM e JOIN papers_md USING (doc_id)""")
def question_context(spark, sf_dir):
    docs = views.papers_md(spark, sf_dir)
    wanted = segment.anchor_candidates(_lines(spark, sf_dir)).where("number IS NOT NULL")
    return segment.question_context(docs, wanted).select("doc_id", "number", F.length("context").alias("n_chars"))


@query("SELECT doc_id, CASE WHEN length(doc_id::VARCHAR) >= 0 THEN 2 ELSE 0 END AS parts FROM documents")
def local_sub_split(spark, sf_dir):
    return segment.local_sub_split(_labelled(spark, sf_dir)).select("doc_id", F.size("parts").alias("parts"))


@query("""SELECT o_orderkey AS doc_id, l_linenumber - 1 AS n, -1 AS m, l_partkey::VARCHAR AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 0
UNION ALL SELECT DISTINCT doc_id, n, m, id FROM (WITH l AS (SELECT l_orderkey AS doc_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) - 1 AS n FROM lineitem)
  SELECT doc_id, n, -1 AS m, l_partkey::VARCHAR AS id FROM l UNION ALL SELECT doc_id, n, 0 AS m, l_partkey || 'a' FROM l)""")
def flatten_questions(spark, sf_dir):
    part = F.col("l_partkey").cast("string")
    q = F.struct(part.alias("id"), F.array(F.struct(F.concat(part, F.lit("a")).alias("id"))).alias("children"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_suppkey", q.alias("q")))), lambda x: x["q"])
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(ordered.alias("questions"))
    return segment.flatten_questions(docs).select("doc_id", F.col("path")[0].alias("n"), F.coalesce(F.get("path", F.lit(1)), F.lit(-1)).alias("m"), "id")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, greatest(least(l_partkey - 50, n), 0) AS start, greatest(least(l_partkey - 50 + 400, n), 0) AS stop FROM lineitem JOIN (SELECT doc_id AS d, length(text) AS n FROM documents) ON d = l_orderkey),
c AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, stop) AS nxt FROM s WHERE stop > start)
SELECT doc_id, start::INT AS start, least(stop, coalesce(nxt, stop))::INT AS "end" FROM c WHERE least(stop, coalesce(nxt, stop)) > start""")
def safe_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") - 50).cast("int").alias("start"), (F.col("l_partkey") + 350).cast("int").alias("end"))
    return segment.safe_spans(spans, table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown")))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS position, l_quantity::INT % 3 AS number, l_partkey % 20 AS image, l_returnflag FROM lineitem GROUP BY ALL),
d AS (SELECT doc_id, position, min(number) AS number, min(image) AS image, min(l_returnflag) AS f FROM l GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY position) AS n FROM d),
o AS (SELECT p.doc_id, p.position, s.image, row_number() OVER (PARTITION BY p.doc_id, s.image ORDER BY p.position) AS k FROM p JOIN p s ON s.doc_id = p.doc_id AND s.number = p.number AND s.n = p.n
  WHERE p.f <> 'A' AND NOT EXISTS (SELECT 1 FROM d x WHERE x.doc_id = p.doc_id AND x.f = 'A' AND x.image = s.image))
SELECT doc_id, position, image FROM o WHERE k = 1""")
def adopt_side_images(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position")).agg(
        F.min(F.col("l_quantity").cast("int") % 3).alias("number"), F.min(F.col("l_partkey") % 20).alias("image"), F.min("l_returnflag").alias("f"))
    side = rows.withColumn("images", F.array("image"))
    primary = side.withColumn("images", F.when(F.col("f") == "A", F.col("images")).otherwise(F.array().cast("array<bigint>")))
    return segment.adopt_side_images(primary.drop("image", "f"), side.drop("image", "f"))


@query("""SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS start FROM lineitem WHERE l_linenumber <= 3 OR l_linenumber >= 5 OR l_returnflag = 'A'""")
def restore_truncated(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), "l_returnflag").distinct()
    refined = rows.where("start <= 3 OR l_returnflag = 'A'").select("doc_id", "start").distinct()
    return segment.restore_truncated(refined, rows.select("doc_id", "start").distinct(), 5)


@query("SELECT doc_id, regexp_matches(text, '填空|横线|空格|空白|空缺|补全|填写|填入|填上|写在|填在|_{2,}|＿{2,}|\\\\_') AS blank FROM documents")
def exam_type_hints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(P.FILL_BLANK).alias("blank"))


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN '题' || doc_id || chr(10) || '![](z.png)' WHEN 1 THEN '题' || doc_id ELSE '无' END AS stem, CASE k WHEN 0 THEN 'A=x,B=y' WHEN 1 THEN 'A=p' || doc_id || ',B=q,C=r' ELSE '' END AS choices FROM d""")
def split_options(spark, sf_dir):
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    t = F.when(k == 0, F.concat(F.lit("题"), i, F.lit("\nA. x B. y ![](z.png)"))).when(k == 1, F.concat(F.lit("题"), i, F.lit("\n\\begin{tasks}(2)\n\\task p"), i, F.lit("\n\\task q\\task r\n\\end{tasks}"))).otherwise("无")
    out = segment.split_options(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")))
    return out.select("doc_id", "stem", F.array_join(F.transform("choices", lambda c: F.concat_ws("=", c["label"], c["content"])), ",").alias("choices"))

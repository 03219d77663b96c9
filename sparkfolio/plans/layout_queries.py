"""Queries of layout geometry: blocks are lines of the papers, boxes are made of order lines."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.operators import layout, segment
from sparkfolio.plans import views
from sparkfolio.plans.views import ctes
from sparkfolio.sources.tables import table

QUERIES = {}


def query(sql):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def _items(spark, sf_dir):
    lines = segment.index_lines(views.papers_md(spark, sf_dir))
    row = F.col("line") % 40
    return lines.select(
        "doc_id", F.floor(F.col("line") / 40).cast("int").alias("page_index"), F.lit(50.0).alias("x0"), (row * 20).cast("double").alias("y0"), F.lit(550.0).alias("x1"), (row * 20 + 18).cast("double").alias("y1"),
        F.col("line").alias("order"), F.regexp_replace("raw", "\n", "").alias("text"), F.lit("").alias("image_ref"), "start", "end")


_BOX = ctes("boxes")
_ROWS = """WITH b AS (SELECT *, row_number() OVER (PARTITION BY question_id, page_index ORDER BY item_id, x, y, w, confidence) AS region_id FROM boxes)"""


@query("""SELECT l_orderkey AS doc_id, l_partkey AS item, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_tax, l_quantity, l_partkey) - 1)::INT AS "order" FROM lineitem""")
def reading_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("page_index"), F.col("l_tax").alias("y0"), F.col("l_quantity").alias("x0"), F.col("l_partkey").alias("order"))
    return layout.reading_order(rows).select("doc_id", "item", "order")


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, line::INT AS line, length(t) AS n_chars, round(10 + line * (100.0::DOUBLE / n), 6) AS y0, round(10 + line * (100.0::DOUBLE / n) + 100.0::DOUBLE / n, 6) AS y1 FROM d""")
def expand_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(10.0).alias("y0"), F.lit(110.0).alias("y1"))
    return layout.expand_lines(rows).select("doc_id", "line", F.length("text").alias("n_chars"), F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query(ctes("turns", "papers_md", "lines") + ' SELECT doc_id, line::INT AS "order", start::INT AS start FROM lines')
def locate_in_text(spark, sf_dir):
    return layout.locate_in_text(_items(spark, sf_dir).drop("start", "end"), views.papers_md(spark, sf_dir), prefix=1000000)


@query(ctes("turns", "papers_md", "lines") + r""", n AS (SELECT *, try_cast(regexp_extract(heading, '^(\d{1,3})\. ', 1) AS INT) AS number FROM lines),
g AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS grp FROM n)
SELECT doc_id, line::INT AS "order", max(number) OVER (PARTITION BY doc_id, grp) AS number, CASE WHEN count(*) OVER (PARTITION BY doc_id, grp) = 1 THEN 0.96 ELSE 0.94 END::DOUBLE AS confidence FROM g WHERE grp > 1""")
def anchor_groups(spark, sf_dir):
    return layout.anchor_groups(_items(spark, sf_dir)).select("doc_id", "order", "number", "confidence")


@query("WITH RECURSIVE " + ctes("turns", "papers_md", "lines", "questions")[5:] + r""", n AS (SELECT *, try_cast(regexp_extract(heading, '^(\d{1,3})\. ', 1) AS INT) AS number FROM lines),
r AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS grp FROM n),
g AS (SELECT doc_id, grp, max(number) AS number, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS size FROM r WHERE grp > 1 GROUP BY doc_id, grp),
q AS (SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id ORDER BY position, number) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS size FROM questions WHERE zone = 'paper'),
m AS (SELECT g.doc_id, g.j, coalesce(min(q.k) FILTER (h.number IS NULL OR h.number <> q.number), any_value(q.size)) AS n FROM g JOIN q ON q.doc_id = g.doc_id LEFT JOIN g h ON h.doc_id = g.doc_id AND h.j = g.j + q.k GROUP BY 1, 2),
s AS (SELECT doc_id, arg_max(j, (n, -j)) AS first FROM m GROUP BY 1),
f AS (SELECT doc_id, first - 1 AS j, 0::BIGINT AS k, false AS stop, NULL::BIGINT AS hit, NULL::BIGINT AS grp FROM s UNION ALL
  SELECT f.doc_id, g.j, f.k + (NOT stop AND coalesce(g.number = q.number, false))::BIGINT, stop OR coalesce(g.number > q.number, true), CASE WHEN NOT stop AND g.number = q.number THEN f.k END, g.grp
  FROM f JOIN g ON g.doc_id = f.doc_id AND g.j = f.j + 1 LEFT JOIN q ON q.doc_id = f.doc_id AND q.k = f.k)
SELECT doc_id, hit::INT AS question, grp AS "group" FROM f WHERE hit IS NOT NULL""")
def align_sequences(spark, sf_dir):
    groups = layout.anchor_groups(_items(spark, sf_dir)).select("doc_id", "group", "number", F.lit(False).alias("preface")).distinct()
    q = views.questions(spark, sf_dir).where("zone = 'paper'").select("doc_id", "position", F.col("number"))
    return layout.align_sequences(q, groups)


@query("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS o, l_partkey AS s, l_partkey + l_quantity::INT AS e FROM lineitem), q AS (SELECT o_orderkey AS doc_id, o_custkey AS a, o_custkey + 400 AS z FROM orders),
r AS (SELECT q.doc_id, min(o) AS low, max(o) AS high FROM q JOIN i ON i.doc_id = q.doc_id AND i.s < q.z AND i.e > q.a GROUP BY 1)
SELECT r.doc_id, 'q' AS question_id, i.o AS "order" FROM r JOIN i ON i.doc_id = r.doc_id AND i.o BETWEEN low AND high""")
def items_in_span(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("order"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("end"))
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("q").alias("question_id"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + 400).alias("end"))
    return layout.items_in_span(items, spans)


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS question_id FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag = 'A') >= max(l_partkey % 2) AND sum(l_tax * l_discount) >= 0.0005""")
def region_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("question_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("l_tax").alias("x1"), F.col("l_discount").alias("y1"), F.when(F.col("l_returnflag") == "A", "i.png").alias("image_ref"), (F.col("l_partkey") % 2).alias("expected_images"))
    return layout.region_filter(rows)


@query(_BOX + """, r AS (SELECT question_id, greatest(min(x) - 0.006, 0) AS a, greatest(min(y) - 0.006, 0) AS b, least(max(x + w) + 0.006, 1) AS c, least(max(y + h) + 0.006, 1) AS d FROM boxes GROUP BY 1)
SELECT question_id, 0 AS page_index, round(a, 5) AS x, round(b, 5) AS y, round(c - a, 5) AS w, round(d - b, 5) AS h FROM r""")
def question_regions(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    rows = b.select("question_id", F.lit(0).alias("page_index"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), F.lit(1.0).alias("page_width"), F.lit(1.0).alias("page_height"))
    return layout.question_regions(rows).select("question_id", "page_index", *[F.round(c, 5).alias(c) for c in "xywh"])


@query("WITH RECURSIVE " + ctes("boxes").removeprefix("WITH ") + """, b AS (SELECT l_orderkey AS question_id, 0 AS page_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS region_id, l_quantity / 60 AS x, l_tax * 10 AS y, l_discount + 0.02 AS w, 0.05::DOUBLE AS h, l_extendedprice / 200000 AS confidence FROM lineitem),
e AS (SELECT a.question_id AS q, a.region_id AS u, b.region_id AS v FROM b a JOIN b ON a.question_id = b.question_id AND a.region_id <> b.region_id AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= 0.25 * least(a.w, b.w) AND greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= 0.02),
reach AS (SELECT question_id AS q, region_id AS u, region_id AS c FROM b UNION SELECT r.q, e.v, r.c FROM reach r JOIN e ON e.q = r.q AND e.u = r.u),
comp AS (SELECT q, u, min(c) AS component FROM reach GROUP BY 1, 2)
SELECT question_id, component, round(min(x), 5) AS x, round(min(y), 5) AS y, round(max(x + w) - min(x), 5) AS w, round(max(y + h) - min(y), 5) AS h, min(confidence) AS confidence, count(*) AS sources FROM b JOIN comp ON q = question_id AND u = region_id GROUP BY 1, 2""")
def union_regions(spark, sf_dir):


    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.lit(0).alias("page_index"), n.alias("region_id"), (F.col("l_quantity") / 60).alias("x"), (F.col("l_tax") * 10).alias("y"), (F.col("l_discount") + 0.02).alias("w"), F.lit(0.05).alias("h"), (F.col("l_extendedprice") / 200000).alias("confidence"))
    out = layout.union_regions(rows)
    return out.select("question_id", "component", *[F.round(c, 5).alias(c) for c in "xywh"], "confidence", F.size("sources").cast("long").alias("sources"))


@query("""WITH i AS (SELECT o_orderkey AS doc_id, o_custkey AS image_id, (o_custkey * 7 % 2000)::INT AS start, o_orderstatus = 'F' AS has_box FROM orders),
s AS (SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'option' WHEN 1 THEN 'part' ELSE 'stem' END AS kind, l_linenumber AS target_id, l_partkey AS a, l_partkey + 600 AS z FROM lineitem),
m AS (SELECT i.*, s.kind, s.target_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY CASE s.kind WHEN 'option' THEN 0 WHEN 'part' THEN 1 ELSE 2 END, s.a, s.target_id) AS k FROM i LEFT JOIN s ON s.doc_id = i.doc_id AND i.start >= s.a AND i.start < s.z)
SELECT doc_id, image_id, coalesce(kind, 'unassigned') AS kind, target_id, CASE WHEN kind IS NULL THEN 0 WHEN has_box THEN 0.96 ELSE 0.9 END::DOUBLE AS confidence, kind IS NOT NULL AND has_box AS auto FROM m WHERE k = 1""")
def place_images_by_offset(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("image_id"), (F.col("o_custkey") * 7 % 2000).cast("int").alias("start"), (F.col("o_orderstatus") == "F").alias("has_box"))
    n = F.col("l_linenumber")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(n % 3 == 0, "option").when(n % 3 == 1, "part").otherwise("stem").alias("kind"), n.alias("target_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 600).alias("end"))
    return layout.place_images_by_offset(images, spans)


@query("""WITH i AS (SELECT l_orderkey AS q, l_partkey, l_linenumber AS o, CASE WHEN l_linenumber = 1 THEN 'A.' WHEN l_linenumber = 2 THEN 'B.' WHEN l_linenumber = 3 THEN 'text C' ELSE 'x' END AS t FROM lineitem),
own AS (SELECT q, substr(t, 1, 1) AS label, min(o) AS o FROM i WHERE t IN ('A.', 'B.') GROUP BY 1, 2), h AS (SELECT q, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'B') AS b FROM own GROUP BY 1)
SELECT q AS question_id, label, false AS synthetic FROM own UNION ALL SELECT DISTINCT h.q, 'C', true FROM h JOIN i ON i.q = h.q AND t = 'text C' WHERE a > 0 AND b > 0""")
def option_labels(spark, sf_dir):
    n = F.col("l_linenumber")
    t = F.when(n == 1, "A.").when(n == 2, "B.").when(n == 3, "text C").otherwise("x")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), n.alias("order"), t.alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(20.0).alias("y1"))
    return layout.option_labels(rows).select("question_id", "label", "synthetic")


def _nodes(spark, sf_dir):
    n = F.col("l_linenumber")
    alone = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").withColumn("alone", alone).where("alone = 1").select(
        F.col("l_orderkey").alias("question_id"), n, (F.col("l_partkey") % 2).cast("int").alias("page_index"), (F.col("l_quantity") / 60).alias("x0"), (F.col("l_tax") * 10).alias("y0"), (F.col("l_quantity") / 60 + 0.05).alias("x1"), (F.col("l_tax") * 10 + 0.05).alias("y1"))
    labels = rows.where((n <= 4) & ((F.col("question_id") % 7 > 0) | (n > 2))).withColumn("label", F.char(F.lit(64) + n)).drop("l_linenumber")
    images = rows.where(n <= 3).withColumn("image_id", n.cast("string")).withColumns({c: F.col(c) * 0.9 + 0.05 for c in ("x0", "y0", "x1", "y1")}).drop("l_linenumber")
    return labels, images


_COSTS = """WITH RECURSIVE r AS (SELECT l_orderkey AS q, l_linenumber AS n, any_value(l_partkey % 2) AS page, any_value(l_quantity / 60) AS x, any_value(l_tax * 10) AS y FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1),
l AS (SELECT q, chr(64 + n) AS label, page, x AS x0, x + 0.05 AS x1, y AS y0, y + 0.05 AS y1 FROM r WHERE n <= 4 AND (q % 7 > 0 OR n > 2)), i AS (SELECT q, n::VARCHAR AS image_id, page, x * 0.9 + 0.05 AS x0, (x + 0.05) * 0.9 + 0.05 AS x1, y * 0.9 + 0.05 AS y0, (y + 0.05) * 0.9 + 0.05 AS y1 FROM r WHERE n <= 3),
c AS (SELECT l.q, label, image_id, round_even(CASE WHEN l.page <> i.page THEN 5 + abs(l.page - i.page) ELSE greatest(1.4 * abs((l.x0 + l.x1) / 2 - (i.x0 + i.x1) / 2) + 2 * abs((l.y0 + l.y1) / 2 - (i.y0 + i.y1) / 2) - CASE WHEN least(l.x1, i.x1) > greatest(l.x0, i.x0) THEN 0.08 ELSE 0 END, 0) END::DOUBLE, 9) AS cost FROM l JOIN i ON l.q = i.q)"""


#: All one-to-one choices, image by image; the cheapest, the first in order of labels among equals, and the cheapest of the others.
@query(_COSTS + """,
ni AS (SELECT q, count(*) AS images FROM i GROUP BY q), nl AS (SELECT q, count(*) AS labels FROM l GROUP BY q), s AS (SELECT ni.q, images, coalesce(labels, 0) AS labels FROM ni LEFT JOIN nl ON nl.q = ni.q),
o AS (SELECT c.*, dense_rank() OVER (PARTITION BY c.q ORDER BY image_id) AS k FROM c JOIN s ON s.q = c.q WHERE images <= labels),
t AS (SELECT q, k, [label] AS chosen, [image_id] AS ids, cost AS total FROM o WHERE k = 1 UNION ALL SELECT t.q, o.k, list_append(t.chosen, o.label), list_append(t.ids, o.image_id), t.total + o.cost FROM t JOIN o ON o.q = t.q AND o.k = t.k + 1 AND NOT list_contains(t.chosen, o.label)),
f AS (SELECT t.q, chosen, ids, round_even(total, 9) AS total FROM t JOIN s ON s.q = t.q AND t.k = s.images), g AS (SELECT *, row_number() OVER w AS k, lead(total) OVER w - total AS margin FROM f WINDOW w AS (PARTITION BY q ORDER BY total, chosen))
SELECT q AS question_id, unnest(chosen) AS label, unnest(ids) AS image_id, round(total, 6) AS total, margin IS NULL OR margin < 0.015 AS ambiguous, round(CASE WHEN margin IS NULL OR margin < 0.015 THEN 0.84 ELSE least(0.98, 0.92 + 2 * margin) END, 4)::DOUBLE AS confidence, NULL::VARCHAR AS reason FROM g WHERE k = 1
UNION ALL SELECT i.q, NULL, image_id, NULL, true, 0.0, 'option_image_one_to_one_violation' FROM i JOIN s ON s.q = i.q WHERE images > labels""")
def assign_images(spark, sf_dir):
    return layout.assign_images(*_nodes(spark, sf_dir)).withColumn("total", F.round("total", 6)).withColumn("confidence", F.round("confidence", 4))


@query(_COSTS + " SELECT q AS question_id, label, image_id, round(cost, 4) AS cost FROM c")
def assignment_costs(spark, sf_dir):
    return layout.assignment_costs(*_nodes(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


@query("""WITH p AS (SELECT o_orderkey AS image_id, CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN 'A' ELSE 'B' END AS target, CASE WHEN o_orderstatus = 'P' THEN 'confirmed' ELSE 'auto' END AS status, 0.8 AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'A' END AS label FROM orders),
o AS (SELECT *, CASE WHEN label IS NULL OR status = 'confirmed' AND target = label THEN 'kept' WHEN status = 'confirmed' THEN 'protected' WHEN target = '' THEN 'adopted' WHEN target = label THEN 'agreed' ELSE 'replaced' END AS outcome FROM p)
SELECT image_id, CASE WHEN outcome IN ('adopted', 'replaced') THEN label ELSE target END AS target, CASE WHEN outcome IN ('adopted', 'replaced', 'agreed') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, outcome, CASE outcome WHEN 'protected' THEN label WHEN 'replaced' THEN target END AS alternative FROM o""")
def reconcile_placements(spark, sf_dir):
    k = F.col("o_custkey") % 3
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.when(k == 0, "").when(k == 1, "A").otherwise("B").alias("target"), F.when(F.col("o_orderstatus") == "P", "confirmed").otherwise("auto").alias("status"), F.lit(0.8).alias("confidence"))
    assigned = rows.where("image_id % 2 = 0").select("image_id", F.lit("A").alias("label"), F.lit(0.9).alias("confidence"))
    return layout.reconcile_placements(rows, assigned).drop("status")


@query(ctes("assets") + """, r AS (SELECT page_id AS id, lower(path) AS p, regexp_extract(lower(path), '[^/]*$', 0) AS name FROM assets WHERE name <> ''), l AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN lower(path) ELSE lower(name) END AS p, lower(name) AS name FROM assets WHERE name <> ''),
m AS (SELECT l.id, r.id AS rid, l.p = r.p AS exact FROM l JOIN r ON r.name = l.name WHERE l.p = r.p OR ends_with(r.p, '/' || l.p)), g AS (SELECT id, count(*) FILTER (exact) AS e, count(*) AS n, min(rid) FILTER (exact) AS er, min(rid) AS nr FROM m GROUP BY 1)
SELECT id AS left_id, CASE WHEN e = 1 THEN er ELSE nr END AS right_id FROM g WHERE e = 1 OR e = 0 AND n = 1""")
def match_image_paths(spark, sf_dir):
    a = views.assets(spark, sf_dir).where("name <> ''")
    left = a.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.col("name")).alias("path"))
    return layout.match_image_paths(left, a.select(F.col("page_id").alias("id"), "path"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 5 AS m FROM lineitem WHERE l_linenumber <= 3), p AS (SELECT l_orderkey AS q, l_partkey % 5 AS m, l_returnflag AS kind, l_linenumber AS label, l_tax > 0.01 AS has_box FROM lineitem WHERE l_linenumber >= 2),
per AS (SELECT q, m, count(*) AS n, count(DISTINCT kind) AS kinds FROM p GROUP BY 1, 2), j AS (SELECT coalesce(i.q, per.q) AS q, i.q IS NULL OR per.q IS NULL AS lost, n, kinds FROM i FULL JOIN per ON i.q = per.q AND i.m = per.m),
a AS (SELECT q, count(*) FILTER (lost) AS lost, count(*) FILTER (n > 1) AS several, count(*) FILTER (kinds > 1) AS kinds FROM j GROUP BY 1), b AS (SELECT q, count(*) FILTER (NOT has_box) AS bare FROM p GROUP BY 1)
SELECT a.q AS question_id, concat_ws(',', CASE WHEN lost > 0 THEN 'conservation' END, CASE WHEN several > 0 THEN 'one-to-one' END, CASE WHEN bare > 0 THEN 'missing-geometry' END, CASE WHEN kinds > 0 THEN 'stem-option-conflict' END) AS codes FROM a LEFT JOIN b USING (q)""")
def validate_placements(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    image = F.col("l_partkey") % 5
    images = rows.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("question_id"), image.alias("image_id")).distinct()
    placements = rows.where("l_linenumber >= 2").select(F.col("l_orderkey").alias("question_id"), image.alias("image_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("label"), (F.col("l_tax") > 0.01).alias("has_box"), F.lit(False).alias("conflict"), F.lit(0).alias("option_count"))
    return layout.validate_placements(images, placements).withColumn("codes", F.array_join("codes", ","))


@query("""WITH p AS (SELECT l_orderkey AS q, l_partkey % 7 AS image, l_returnflag AS label, l_linestatus = 'O' OR l_discount >= 0.05 AS sure, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 7) AS n FROM lineitem)
SELECT q AS question_id, label, string_agg(image::VARCHAR, ',' ORDER BY image) AS images FROM p WHERE sure AND n = 1 GROUP BY 1, 2""")
def trusted_option_refs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") % 7).alias("image_id"), F.col("l_returnflag").alias("label"), F.when(F.col("l_linestatus") == "O", "confirmed").otherwise("auto").alias("status"), F.when(F.col("l_discount") >= 0.05, 0.95).otherwise(0.9).alias("confidence"), F.lit("option").alias("kind"))
    out = layout.trusted_option_refs(rows)
    return out.withColumn("images", F.array_join(F.transform("images", lambda x: x.cast("string")), ","))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS image FROM lineitem), e AS (SELECT q, count(*) AS n FROM c GROUP BY 1)
SELECT q AS question_id, q % 2 = 0 AND q % 3 > 0 AND n <= 4 AS accepted FROM e""")
def accept_external_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("image_id")).distinct()


    n = F.row_number().over(Window.partitionBy("question_id").orderBy("image_id"))
    candidates = rows.select("*", F.when(F.col("question_id") % 2 == 0, 0.85).otherwise(0.99).alias("confidence"), F.lit(False).alias("conflict"), F.array(*[F.lit(x) for x in "ABCD"]).alias("labels"))
    mapping = rows.withColumn("n", n).withColumn("label", F.char(F.lit(64) + F.col("n"))).where("question_id % 3 > 0 OR n > 1")
    return layout.accept_external_assignment(candidates, mapping)


@query(ctes("turns", "papers_md", "lines") + r""", n AS (SELECT doc_id, line, try_cast(regexp_extract(heading, '^(\d{1,3})\. ', 1) AS INT) AS number FROM lines), f AS (SELECT doc_id, number, min(line) AS line FROM n GROUP BY 1, 2)
SELECT q.conv_id AS doc_id, q.turn AS question_id, f.line::INT AS "order" FROM conversations q LEFT JOIN f ON f.doc_id = q.conv_id AND f.number = q.turn // 2 + 1""")
def locate_question_block(spark, sf_dir):
    q = views.questions(spark, sf_dir).select("doc_id", F.col("position").alias("question_id"), F.col("number").cast("int").alias("number"), F.lit("").alias("stem"))
    return layout.locate_question_block(q, _items(spark, sf_dir))

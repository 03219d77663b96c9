"""Queries of text hygiene: documents' whole texts with one of eight endings behind them, and nested columns made of the bank's tables.

DuckDB's patterns have no look-around, so rules over whole texts have no SQL here; tests hold these queries against plain Python forms of the rules.
"""

from pyspark.sql import functions as F

from sparkfolio.operators import hygiene
from sparkfolio.sources.tables import table

QUERIES = {}
#: Endings by doc_id % 8: formulas of all states.
ENDINGS = (
    " plain", " a $x^{2}$ b", " $$y_{1}$$", " x\" = 2", " $\\frac {1} {2}$ and $z$$w$", " \\sqrt{2} bare", " $a{b$", " $p$ + $q$ odd $",
)


def query(sql):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), ending).alias("t"))


@query(None)
def math_issues(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(hygiene.math_issues(F.col("t")), ",").alias("issues"))


@query(None)
def severe_latex(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(hygiene.severe_latex(F.col("t")), ",").alias("codes"))


@query(None)
def render_check(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(hygiene.render_check(F.col("t")), ",").alias("codes"))


@query(None)
def normalize_math(spark, sf_dir):
    return hygiene.normalize_math(_docs(spark, sf_dir), "t").select("doc_id", F.md5("t").alias("md5"), "status", "changed")


@query(None)
def math_report(spark, sf_dir):
    fields = hygiene.normalize_math(_docs(spark, sf_dir), "t").select((F.col("doc_id") % 40).alias("doc_id"), F.col("doc_id").alias("question_id"), "status", "changed")
    return hygiene.math_report(fields).select(F.col("doc_id").alias("doc"), "questions", "changed", "fixed", "warnings")


@query(None)
def repair_delimiters(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("t", hygiene.repair_delimiters(F.col("t")))
    return d.select("doc_id", F.md5("t").alias("md5"), F.array_join(hygiene.severe_latex(F.col("t")), ",").alias("codes"))


@query(None)
def collapse_repeats(spark, sf_dir):
    """Documents, a quarter of them twice, a quarter begun again behind a number, a quarter both, with white space and case changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    k, again = F.col("doc_id") % 4, F.regexp_replace(F.upper("t"), " ", "  ")
    numbered = F.concat(F.lit("7. "), "t", F.lit("\n"), again)
    twice = d.withColumn("t", F.when(k == 1, F.concat("t", F.lit("\n"), again)).when(k == 2, numbered).when(k == 3, F.concat(numbered, F.lit("\n\n"), numbered)).otherwise(F.col("t")))
    out = hygiene.collapse_repeats(twice, "t")
    return out.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("md5"))


@query(None)
def repeated_suffix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    doubled = d.withColumn("text", F.when(F.col("id") % 2 == 0, F.concat(F.lit("7. "), "text", F.lit("\n"), "text")).otherwise(F.col("text")))
    return hygiene.repeated_suffix(doubled).select("id", F.length("kept").alias("n_chars"))


@query(None)
def strip_solutions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    k = F.col("doc_id") % 3
    stem = F.concat("t", F.when(k == 0, "x\n【答案】 5\n解析：why").when(k == 1, "x\n故答案为：5").otherwise("，长为 $5$。"))
    return d.select("doc_id", hygiene.strip_solutions(stem, F.lit("5"), F.lit("")).alias("stem"))


@query(None)
def plain_text(spark, sf_dir):
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" $\\frac{1}{2}$ $\\sqrt{3}$ $x^{2} \\leq 5$\n![a](b.png)\n\n# **bold**"))
    return table(spark, sf_dir, "documents").select("doc_id", hygiene.plain_text(body).alias("t"))


def _images(n, kept=True):
    one = lambda i: F.struct(F.concat(F.lit("u"), (n % i).cast("string")).alias("url"), F.lit("").alias("path"), F.when(n % 3 == 0, F.lit("题图4")).otherwise("").alias("label"))
    return F.array(one(2), one(3), one(5))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 2 AS a, p_partkey % 3 AS b, p_partkey % 5 AS c, p_partkey % 3 = 0 AS four FROM part),
l AS (SELECT id, 'u' || a AS x, CASE WHEN b <> a THEN 'u' || b END AS y, CASE WHEN c <> a AND c <> b THEN 'u' || c END AS z, four FROM p)
SELECT id, concat_ws(',', x || ':' || CASE WHEN four THEN '图4' ELSE '图1' END, y || ':' || CASE WHEN four THEN '图4' ELSE '图2' END, z || ':' || CASE WHEN four THEN '图4' WHEN y IS NULL THEN '图2' ELSE '图3' END) AS images FROM l""")
def image_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _images(F.col("p_partkey")).alias("images"))
    out = hygiene.image_labels(F.col("images"))
    return rows.select("id", F.array_join(F.transform(out, lambda x: F.concat_ws(":", x["url"], x["label"])), ",").alias("images"))


def _labelled(*names):
    return F.array(*[F.struct(F.lit(f"u{n}").alias("url"), F.lit("").alias("path"), F.lit(f"图{n}").alias("label")) for n in names])


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN 2 WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 5 = 0 THEN 2 ELSE 0 END AS n FROM part")
def image_context_filter(spark, sf_dir):
    size = F.col("p_size")
    stem = F.concat("p_name", F.when(size % 3 == 0, "![](图1)").when(size % 5 == 0, "如图").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.size(hygiene.image_context_filter(_labelled(1, 2), stem, F.when(size % 2 == 0, "choice").otherwise("solution"))).alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'x ![图1](u1),y ![图2](u2)' ELSE 'x,y' END AS options FROM part")
def attach_option_images(spark, sf_dir):
    stem = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "下图").otherwise(""))
    out = hygiene.attach_option_images(F.array(F.lit("x"), F.lit("y")), _labelled(1, 2), stem)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(out, ",").alias("options"))


@query(None)
def risk_reasons(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("t").alias("stem"), F.lit("choice").alias("type"), F.array(F.lit("a"), F.lit("b")).alias("options"), (F.col("doc_id") % 8 == 3).cast("int").alias("math_warnings"))
    return hygiene.risk_reasons(rows).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(None)
def candidate_gate(spark, sf_dir):
    d = _docs(spark, sf_dir)
    side = lambda stem, n: d.select(F.col("doc_id").alias("question_id"), stem.alias("stem"), F.array(*[F.lit("o")] * n).alias("options"), F.array(F.lit("图1")).alias("labels"), F.lit(0).alias("children"))
    after = side(F.concat("t", F.when(F.col("doc_id") % 8 == 3, " ![](图9)").otherwise("")), 3)
    return hygiene.candidate_gate(side(F.lit("plain"), 4), after).withColumn("errors", F.array_join("errors", ","))


@query(None)
def rule_standardize(spark, sf_dir):
    out = hygiene.rule_standardize(_docs(spark, sf_dir).withColumnRenamed("t", "stem"))
    return out.select("doc_id", F.md5("stem").alias("md5"), "path", "status", "recommendation")


@query(r"""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN trim(p_name) || chr(10) || chr(10) || '\begin{tasks}(' || CASE WHEN length(p_type) <= 12 THEN '4' ELSE '2' END || ')' || chr(10) || '\task ' || p_type || chr(10) || '\task b' || chr(10) || '\end{tasks}' ELSE p_name END AS stem FROM part""")
def choice_block(spark, sf_dir):
    options = F.when(F.col("p_size") % 3 == 0, F.array("p_type", F.lit("b"))).otherwise(F.array("p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hygiene.choice_block(F.col("p_name"), options).alias("stem"))


@query(r"""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name || ' ![x](图1) end' || chr(10) || '![图2](图2)' ELSE p_name || chr(10) || '![图1](图1)' || chr(10) || '![图2](图2)' || chr(10) || chr(10) || '\begin{tasks}(2)' END AS stem FROM part""")
def conserve_image_refs(spark, sf_dir):
    stem = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " ![x](<u1>) end").otherwise(" \\begin{tasks}(2)"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hygiene.conserve_image_refs(stem, _labelled(1, 2)).alias("stem"))


@query(None)
def repair_candidates(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("t").alias("stem"), F.when(F.col("doc_id") % 2 == 0, "fill_blank").otherwise("solution").alias("type"), F.array().cast("array<string>").alias("options"), F.lit(0).alias("children"))
    return hygiene.repair_candidates(rows).select("doc_id", "need")


@query("SELECT p_partkey AS question_id, length(p_name)::INT + CASE WHEN p_size < 50 THEN 5 + 5 * least(greatest(p_size % 12 - 1, 0), 8) ELSE 5 END AS n_chars, CASE WHEN p_size < 50 AND p_size % 12 > 1 THEN 'fill_blank' ELSE 'solution' END AS type FROM part")
def apply_blank_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("question_id"), F.concat("p_name", F.lit(" ____")).alias("stem"), F.lit("solution").alias("type"))
    counts = p.where("p_size < 50").select(F.col("p_partkey").alias("question_id"), (F.col("p_size") % 12).alias("blanks"))
    return hygiene.apply_blank_counts(rows, counts).select("question_id", F.length("stem").alias("n_chars"), "type")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 < 2 THEN 'second' ELSE 'first' END AS taken FROM part")
def prefer_second_text(spark, sf_dir):
    k = F.col("p_size") % 4
    first = F.concat(F.lit("3. "), "p_name")
    second = F.when(k == 0, F.concat(first, F.lit(" and a much longer ending")), ).when(k == 1, F.concat(first, F.lit(" and ____ more"))).when(k == 2, F.concat(F.lit("4. "), "p_name", F.lit(" and a much longer ending"))).otherwise(F.concat(first, F.lit(" Error: a much longer ending")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(hygiene.prefer_second_text(first, second) == first, "first").otherwise("second").alias("taken"))


@query("SELECT p_partkey AS id, p_name || ' ____ (____)' || chr(10) || '值为____' AS stem FROM part")
def restore_blanks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hygiene.restore_blanks(F.concat("p_name", F.lit(" __ ( $ )\n值为 "))).alias("stem"))

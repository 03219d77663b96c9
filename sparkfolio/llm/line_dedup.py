"""Line dedup by winnowing over line hashes; DataFrame functions only.

A run of consecutive non-blank lines with at least ``MIN_WORDS`` words that stands earlier in the corpus (in order of doc_id, then line)
is deleted where it stands again; its first copy stays. Lines are compared without white space at their ends.

* Windows. From each line the least run of lines with ``MIN_WORDS`` words or more: forwards from its first line and backwards from its last.
* Winnowing. Each window selects its line of least hash. A shared run holds whole windows, the same in both copies, so both
  copies select the same line: the fingerprints are guaranteed to meet. Windows whose fingerprint line is selected at one position
  of the corpus only go at once.
* Positions. The windows left are joined by their content: all positions of one content are one class, whose first is the original.
  That takes one aggregate; no pairs of positions are made, so a passage in a third of all documents costs no more than others.
* Both ways. A maximal repeated run begins with a forward window and ends with a backward one, and windows cover what is between. So the
  union of later windows of both kinds is the match extended as far as it goes to either side.

Texts of fewer than MIN_WORDS words keep all lines. Blank lines have no words: they take no part and stay. Null text stays null, an empty one
empty. Rows of the same doc_id and text are one document (each keeps the same lines); a null doc_id comes last, ties go by
text hash. Extra columns are kept, whatever their names. Very long texts are whole; a document's lines are the largest group in one task. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import table, written
from sparkfolio.llm.mixing import word_count

MIN_WORDS = 50
_EDGE = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_EDGE))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, pos, n, start, stop, h) for each non-blank line of each distinct (id, text)."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    line = _trimmed(F.col("line"))
    rows = rows.select("id", "th", "pos", word_count(F.col("line")).alias("n"), F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b")).alias("h"))
    rows = rows.where(F.col("n") > 0).repartition("id", "th").dropDuplicates(["id", "th", "pos"])
    stop = F.sum("n").over(Window.partitionBy("id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("n"))


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, th, first, last, content, mark, at): forward and backward windows, their content, selected hash and its position."""
    doc = Window.partitionBy("id", "th")
    forward = doc.orderBy("start").rangeBetween(0, min_words - 1)
    backward = doc.orderBy("stop").rangeBetween(-(min_words - 1), 0)

    def side(frame, back):
        return F.struct(
            F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.sum("n").over(frame).alias("words"),
            F.sort_array(F.collect_list(F.struct("pos", "h")).over(frame)).alias("held"), F.min(F.struct("h", "pos")).over(frame).alias("mark"), F.lit(back).alias("back"),
        )

    both = lines.select("id", "th", side(forward, False).alias("f"), side(backward, True).alias("b"))
    rows = both.select("id", "th", F.explode(F.array("f", "b")).alias("w")).select("id", "th", "w.*").where(F.col("words") >= min_words)
    hashes = F.col("held.h")
    content = F.struct(F.xxhash64(hashes).alias("a"), F.hash(hashes).alias("b"), F.size("held").alias("n"), "back")
    return rows.select("id", "th", "first", "last", content.alias("content"), F.col("mark.h").alias("mark"), F.col("mark.pos").alias("at"))


def later_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): for each document the (first, last) line positions of windows that stand earlier."""
    found = written(windows(line_table(docs, id_col, text_col), min_words), "windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "at")
    marks = found.groupBy("mark").agg(F.min(place).alias("one"), F.max(place).alias("other")).where(F.col("one") != F.col("other"))
    shared = found.join(marks.select("mark"), "mark", "left_semi")
    here = F.struct(F.col("id").isNull().alias("none"), "id", "th", "first")
    firsts = shared.groupBy("content").agg(F.min(here).alias("original"), F.max(here).alias("latest")).where(F.col("original") != F.col("latest"))
    later = shared.join(firsts.select("content", "original"), "content").where(here > F.col("original"))
    return later.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted, and how many: column ``_deleted``, which replaces one of that name."""
    runs = later_runs(docs, id_col, text_col, min_words)
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th")
    )
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))
    joined = rows.join(runs, same, "left").withColumn("_lines", F.split(F.col(f"row.`{text_col}`"), "\n", -1))
    blank = lambda line: F.length(_trimmed(line)) == 0
    hit = lambda i: F.exists("_gone", lambda g: (g["first"] <= i) & (i <= g["last"]))
    left = F.filter("_lines", lambda line, i: blank(line) | ~hit(i))
    joined = joined.withColumn("_gone", F.coalesce("runs", F.expr("array()"))).withColumn("_left", F.when(F.size("_gone") == 0, F.col("_lines")).otherwise(left))
    columns = [F.array_join("_left", "\n", "").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names if c != "_deleted"]
    return joined.select(*columns, F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).alias("_deleted"))


def op3_line_dedup(spark, sf_dir) -> DataFrame:
    """What line dedup deletes from and leaves of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_deleted").cast("long").alias("n_deleted"), word_count(F.col("text")).alias("n_words_left"), F.md5("text").alias("text_md5"))


#: The same runs by brute force over window contents; hashes play no part.
ORACLE = r"""
WITH raw AS (SELECT doc_id AS id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
lines AS (
  SELECT id, pos, trim(line, E' \t\n\x0b\x0c\r') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
placed AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS stop, sum(n) OVER (PARTITION BY id ORDER BY pos)::BIGINT - n AS start FROM lines),
windows AS (
  SELECT id, 'f' AS kind, min(pos) OVER f AS first, max(pos) OVER f AS last, sum(n) OVER f AS words, string_agg(line, chr(10) ORDER BY pos) OVER f AS content
  FROM placed WINDOW f AS (PARTITION BY id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT id, 'b' AS kind, min(pos) OVER b AS first, max(pos) OVER b AS last, sum(n) OVER b AS words, string_agg(line, chr(10) ORDER BY pos) OVER b AS content
  FROM placed WINDOW b AS (PARTITION BY id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT id, first, last, row_number() OVER (PARTITION BY kind, content ORDER BY id, first) AS k FROM windows WHERE words >= 50),
gone AS (
  SELECT DISTINCT r.id, r.pos FROM raw r JOIN ranked w ON w.id = r.id AND w.k > 1 AND r.pos BETWEEN w.first AND w.last
  WHERE regexp_matches(r.line, '[^\x20\x09-\x0D]')),
left_over AS (
  SELECT r.id, count(g.pos) AS n_deleted, coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL), '') AS text
  FROM raw r LEFT JOIN gone g ON g.id = r.id AND g.pos = r.pos GROUP BY r.id)
SELECT d.doc_id, coalesce(l.n_deleted, 0) AS n_deleted, coalesce(len(regexp_extract_all(l.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_words_left, md5(l.text) AS text_md5
FROM documents d LEFT JOIN left_over l ON l.id = d.doc_id
"""

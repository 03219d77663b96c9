"""Grouping spelling variants: words one edit apart, found by scanning sorted word lists with banded edit rows.

Words are counted with DataFrame functions. Two words one edit apart share either the first half of the shorter one or its other half at the end, so
each word stands in two sorted lists: one of words, one of words spelt backwards. Lists are cut into segments by their first ``KEY``
letters; a segment is a task's unit, and one of more than ``SEGMENT`` words is dealt into blocks that meet in tiles, so none grows with the input.

In a segment a word's scan runs over the range that shares its exact half. The scan keeps a row of the edit matrix for each letter it has read; the next word starts
from the row at the length of the prefix it shares with the last one (adjacent LCPs), and where all cells of a row exceed one edit, every word that shares
the prefix read so far is skipped. Only three cells of a row can be within one edit; each is 0, 1 or more, so what follows a row is looked up in a table of 27 rows and 8 ways to match.

Null texts have no words; a null id counts as empty in what is hashed. Rows with equal ids are documents of their own (their equal words share one fate). Ties of a form go to the
smaller word in code-point order. Texts and words of any length are whole. An empty table gives no rows. Columns other than the two named play no part.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut, join_small, table

#: Shortest word, least occurrences, how many times as frequent a form is, and of how many words one loses a letter.
LETTERS, LEAST, TIMES, EVERY = 7, 2, 10, 31
#: Letters that cut a list into segments (LETTERS of 7 and more share 3 exactly), and words of a segment's block.
KEY, SEGMENT = 3, 20_000
_NEAR = "word string, n_near long, form string, form_n long"
_LAST = "\U0010ffff"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n): letter runs of at least ``letters``, A-Z lower-cased; every ``every``-th of a document's words by hash loses one letter."""
    runs = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(text_col, F.lit(f"([A-Za-zÀ-ÿ]{{{letters},}})"))).alias("run"))
    runs = runs.select("doc", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("doc").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _successors() -> list[int]:
    """Row after row: entry 8 * row + match. A row's cells are the edits between what was read and the word's letters up to one less, as many, one more."""
    steps = []
    for row in range(27):
        a, b, c = row // 9, row // 3 % 3, row % 3
        for match in range(8):
            x = min(b + 1, a + (not match & 1), 2)
            y = min(c + 1, x + 1, b + (not match & 2), 2)
            z = min(y + 1, c + (not match & 4), 2)
            steps.append(8 * (9 * x + 3 * y + z))
    return steps


_STEP, _DEAD, _EXACT = _successors(), 8 * 26, 8 * (9 + 0 + 1)
#: Cell k of a row, by 8 * row + k.
_CELL = [(row // 9, row // 3 % 3, row % 3, 2, 2, 2, 2, 2)[k] for row in range(27) for k in range(8)]


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _jumps(lcp: list[int]) -> list[int]:
    """For each place the next one that shares less with the word before it."""
    jump, open_ = [len(lcp)] * len(lcp), []
    for i, n in enumerate(lcp):
        while open_ and lcp[open_[-1]] > n:
            jump[open_.pop()] = i
        open_.append(i)
    return jump


def scan(asked: list[str], listed: list[str], backward: bool = False):
    """(place in asked, place in listed) of all pairs one edit apart whose first difference lies in this direction's half; ``listed`` is sorted.

    Backward, both hold words spelt backwards, and a pair counts where the words' first halves differ.
    """
    lcp = [0, *map(_shared, listed, listed[1:])]
    jump = _jumps(lcp)
    rows = [0] * (max(map(len, listed), default=0) + 2)
    step, cell = _STEP, _CELL
    for place, q in enumerate(asked):
        size = len(q)
        half = (size - 1) // 2
        start = size - 1 - half if backward else half
        lo, hi = bisect_left(listed, q[:start]), bisect_left(listed, q[:start] + _LAST)
        if hi - lo < 2:
            if lo == hi or listed[lo] == q:
                continue
        rows[start], matches = _EXACT, [None] * start
        for d in range(start, size + 2):
            at = {}
            for bit, x in enumerate(q[d - 1 : d + 2]):
                at[x] = at.get(x, 0) | 1 << bit
            matches.append(at)
        i, depth = lo, start
        while i < hi:
            w, row = listed[i], rows[depth]
            n = len(w)
            while depth < n:
                row = step[row + matches[depth].get(w[depth], 0)]
                depth += 1
                rows[depth] = row
                if row == _DEAD:
                    break
            i += 1
            if row == _DEAD:
                while i < hi and lcp[i] >= depth:
                    i = jump[i]
                if i < hi:
                    depth = lcp[i]
                continue
            k = size - n + 1
            if 0 <= k <= 2 and cell[row + k] == 1:
                m = min(size, n) // 2
                if (q[-m:] != w[-m:]) if backward else (q[:m] == w[:m]):
                    yield place, i - 1
            if i < hi:
                depth = lcp[i]


def _tile(rows: pa.Table) -> pa.Table:
    """One tile of a segment: each asked word's number of near words and the most frequent of them."""
    backward = rows.column("side")[0].as_py() == "s"
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    spelt = [w[::-1] for w in words] if backward else words
    listed = sorted((s, n) for s, n, x in zip(spelt, counts, rows.column("listed").to_pylist(), strict=True) if x)
    names = [s for s, _ in listed]
    asked = sorted(s for s, x in zip(spelt, rows.column("asks").to_pylist(), strict=True) if x)
    best, near = {}, {}
    for p, i in scan(asked, names, backward):
        near[p] = near.get(p, 0) + 1
        found = -listed[i][1], names[i][::-1] if backward else names[i]
        if p not in best or found < best[p]:
            best[p] = found
    places = list(near)
    return pa.table(
        {
            "word": pa.array([asked[p][::-1] if backward else asked[p] for p in places], pa.string()), "n_near": pa.array([near[p] for p in places], pa.int64()),
            "form": pa.array([best[p][1] for p in places], pa.string()), "form_n": pa.array([-best[p][0] for p in places], pa.int64()),
        }
    )


def near_words(words: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(word, n_near, form, form_n) of each word of (word, n) that has near ones; form is the most frequent of them. Words are distinct, of at least LETTERS letters."""
    sides = F.explode(F.array(F.struct(F.lit("p").alias("side"), F.substring("word", 1, KEY).alias("part")), F.struct(F.lit("s").alias("side"), F.substring("word", -KEY, KEY).alias("part"))))
    rows = words.select("word", "n", sides.alias("_s")).select("word", "n", "_s.*")
    large = rows.groupBy("side", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > segment)
    rows = join_small(rows, large.select("side", "part", F.ceil(F.col("size") / segment).cast("int").alias("blocks")), ["side", "part"])
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asks = F.transform(every, lambda j: F.struct(F.col("own").alias("q"), j.alias("c"), F.lit(True).alias("asks"), (j == F.col("own")).alias("listed")))
    lists = F.transform(F.filter(every, lambda j: j != F.col("own")), lambda j: F.struct(j.alias("q"), F.col("own").alias("c"), F.lit(False).alias("asks"), F.lit(True).alias("listed")))
    tiles = rows.select("side", "part", "word", "n", F.explode(F.concat(asks, lists)).alias("_t")).select("side", "part", "word", "n", "_t.*")
    found = tiles.groupBy("side", "part", "q", "c").applyInArrow(_tile, _NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("f"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.f").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(links: DataFrame, most: int, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps taken. A form is ``times`` as frequent, so ``most`` occurrences bound the chain."""
    reached = cut(links.select("word", F.col("form").alias("root")))
    steps = int(math.log(max(most, least) / least, times)) + 1
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = cut(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return reached


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word. Eager where lineage is cut."""
    words = cut(word_counts(docs, id_col, text_col))
    most = words.agg(F.max("n")).first()[0] or 0
    joined = words.join(near_words(words), "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    told = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")))
    ends = roots(told.where(F.col("form").isNotNull()), most, times)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    """Words of all documents with the frequent spelling each is a variant of."""
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
    ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS b FROM runs),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT)) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.cut = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS best FROM pairs GROUP BY 1),
told AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN best END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS here FROM told UNION ALL SELECT walk.word, form FROM walk JOIN told ON here = told.word WHERE form IS NOT NULL),
ends AS (SELECT walk.word, here AS root FROM walk JOIN told ON here = told.word WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""

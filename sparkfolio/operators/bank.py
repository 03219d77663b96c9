"""Item bank and paper operators: filters, lists, selection by rules, expansion, scores and totals.

Conventions: the empty string and null both mean "not given"; ids that are null match nothing; ties in a list
go by id. No operator collects rows; lists are ordered DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Text columns that a keyword is looked for in, as far as a bank has them.
SEARCHED = ("stem", "answer", "analysis", "source", "children_json")
CONTAINED = ("subject", "grade", "region", "year", "source")


def _has(value) -> bool:
    return value is not None and str(value).strip() != ""


def bank_filter(bank: DataFrame, mode: str = "typed", **wanted) -> DataFrame:
    """Rows that meet every filter given; blank filters are none.

    keyword: substring of any searched text, case aside. type, difficulty: equal. subject, grade, region, year, source:
    contained, case aside. knowledge_point: member of ``knowledge_points`` (mode "text": substring of the column's text).
    score: equal as a number (mode "text": as text). A filter whose column the bank lacks meets no row.
    """
    has = lambda name: name in bank.columns
    tests: list[Column] = []
    if _has(wanted.get("keyword")):
        joined = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in SEARCHED if has(c)]))
        tests.append(joined.contains(str(wanted["keyword"]).strip().lower()))
    for name in ("type", "difficulty"):
        if _has(wanted.get(name)):
            tests.append(F.col(name) == F.lit(wanted[name]) if has(name) else F.lit(False))
    for name in CONTAINED:
        if _has(wanted.get(name)):
            tests.append(F.lower(F.col(name).cast("string")).contains(str(wanted[name]).strip().lower()) if has(name) else F.lit(False))
    if _has(wanted.get("knowledge_point")):
        point = str(wanted["knowledge_point"])
        member = F.col("knowledge_points").cast("string").contains(point) if mode == "text" else F.array_contains("knowledge_points", point)
        tests.append(member if has("knowledge_points") else F.lit(False))
    if _has(wanted.get("score")):
        equal = F.col("score").cast("string") == str(wanted["score"]) if mode == "text" else F.col("score") == F.lit(float(wanted["score"]))
        tests.append(equal if has("score") else F.lit(False))
    for test in tests:
        bank = bank.where(test)
    return bank


def with_total(rows: DataFrame) -> DataFrame:
    """Adds the number of all rows; a broadcast of one row."""
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def bank_list(bank: DataFrame, mode: str = "typed", **wanted) -> DataFrame:
    """Filtered rows, newest first, with the total."""
    return with_total(bank_filter(bank, mode, **wanted)).orderBy(F.desc_nulls_last("created_at"), "id")


def paginate(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of an ordered list with the total; page and size are at least 1. For shallow pages."""
    page, size = max(1, page), max(1, size)
    return with_total(rows).orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(rows: DataFrame, keys: list[tuple[str, bool]], last: dict | None, size: int) -> DataFrame:
    """The ``size`` rows behind the last one seen, in order of ``keys`` (name, whether downwards), which must be unique together and not null.

    For deep pages: the keys are a filter that reaches the scan, nothing before them is sorted or counted. Without ``last`` the first page.
    """
    if last is not None:
        beyond, level = F.lit(False), F.lit(True)
        for name, down in keys:
            value = F.lit(last[name])
            beyond = beyond | (level & (F.col(name) < value if down else F.col(name) > value))
            level = level & (F.col(name) == value)
        rows = rows.where(beyond)
    return rows.orderBy(*[F.desc(n) if down else F.asc(n) for n, down in keys]).limit(max(1, size))


def paper_filter(papers: DataFrame, keyword: str | None = None, subject: str | None = None, grade: str | None = None) -> DataFrame:
    """Papers whose subject and grade contain what is given and that hold the keyword in title, subject, grade or status."""
    for name, value in (("subject", subject), ("grade", grade)):
        if _has(value):
            papers = papers.where(F.lower(F.col(name).cast("string")).contains(value.strip().lower()))
    if _has(keyword):
        word = keyword.strip().lower()
        texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(word) for c in ("title", "subject", "grade", "status")]
        papers = papers.where(texts[0] | texts[1] | texts[2] | texts[3])
    return papers


def select_by_rules(bank: DataFrame, rules: DataFrame, default_count: int = 10, use_filters: bool = True) -> DataFrame:
    """(paper_id, position, question_id): for each paper the first ``count`` bank rows that meet its rule.

    rules: (paper_id, type, difficulty, subject, count), blanks being no filter. With filters in bank order (by id); without, newest first
    and at least one. The first rows are found per task before they meet (a limit within each group), so a rule
    that all rows meet costs ``count`` rows a task. The rules side is broadcast when Spark finds it small.
    """
    b, r = bank.alias("b"), rules.alias("r")
    fits = F.lit(True)
    if use_filters:
        for name in ("type", "difficulty"):
            fits &= (F.coalesce(F.col(f"r.{name}"), F.lit("")) == "") | (F.col(f"b.{name}") == F.col(f"r.{name}"))
        fits &= F.lower("b.subject").contains(F.lower(F.coalesce("r.subject", F.lit(""))))
    count = F.coalesce("r.count", F.lit(default_count))
    order = [F.col("b.id")] if use_filters else [F.desc_nulls_last("b.created_at"), F.col("b.id")]
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))
    found = b.join(r, fits).select("r.paper_id", F.col("b.id").alias("question_id"), place.alias("position"), (count if use_filters else F.greatest(count, F.lit(1))).alias("n"))
    return found.where(F.col("position") <= F.col("n")).select("paper_id", "position", "question_id")


def expand_papers(items: DataFrame, bank: DataFrame) -> DataFrame:
    """Ordered paper items (paper_id, position, question_id, override_score) to bank rows.

    Ids that the bank lacks are dropped; the score is the paper's override, else the bank's, else 0.
    Null ids never match. Both sides shuffle on question_id unless the bank is small.
    """
    q = bank.select(F.col("id").alias("question_id"), "type", "subject", F.col("score").alias("bank_score"))
    return items.join(q, "question_id").select(
        "paper_id", "position", "question_id", "type", "subject",
        F.coalesce("override_score", "bank_score", F.lit(0.0)).alias("score"),
    )


def paper_totals(expanded: DataFrame) -> DataFrame:
    """Question count and total score (6 decimals) of each paper; nothing for papers without a known question."""
    return expanded.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("question_count"), F.round(F.sum("score"), 6).alias("total_score")
    )


def build_scores(items: DataFrame, bank: DataFrame) -> DataFrame:
    """(paper_id, scores): a map over all ids of a paper; ids that the bank lacks stay with 0, of repeated ids the first counts, at one position the least."""
    q = bank.select(F.col("id").alias("question_id"), F.col("score").alias("bank_score"))
    scored = items.where(F.col("question_id").isNotNull()).join(q, "question_id", "left")
    scored = scored.groupBy("paper_id", "question_id").agg(
        F.min(F.struct("position", F.coalesce("override_score", "bank_score", F.lit(0.0)).alias("s")))["s"].alias("score")
    )
    return scored.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("question_id", "score"))).alias("scores"))


def apply_sub_selections(rows: DataFrame) -> DataFrame:
    """``children`` reduced to those whose id is in ``selected``; none given or none known means all."""
    kept = F.filter("children", lambda c: F.array_contains("selected", c["id"]))
    none = F.coalesce(F.size(kept), F.lit(0)) <= 0
    return rows.withColumn("children", F.when(F.col("selected").isNull() | none, F.col("children")).otherwise(kept))


def selected_sub_score(rows: DataFrame) -> DataFrame:
    """``sub_score``: the sum of the children's scores, null scores being 0."""
    return rows.withColumn("sub_score", F.aggregate("children", F.lit(0.0), lambda s, c: s + F.coalesce(c["score"], F.lit(0.0))))


def answer_space(kind: Column, score: Column, parent_kind: Column, is_child: Column) -> Column:
    """Height to leave for an answer: solutions 118 to 260, their parts 72 to 150, all else 0; an unknown kind is its parent's."""
    kind = F.when(kind.isNull() | kind.isin("", "unknown"), parent_kind).otherwise(kind)
    points = F.coalesce(score, F.lit(0.0))
    whole = F.least(F.greatest(118 + 10 * points, F.lit(118.0)), F.lit(260.0))
    part = F.least(F.greatest(72 + 7 * points, F.lit(72.0)), F.lit(150.0))
    return F.when(kind == "solution", F.when(is_child, part).otherwise(whole)).otherwise(F.lit(0.0))


def knowledge_points(points: DataFrame) -> DataFrame:
    """Points with a name, newest first."""
    return points.where(F.trim(F.coalesce("name", F.lit(""))) != "").orderBy(F.desc_nulls_last("created_at"), "id")


def point_subtrees(points: DataFrame, depth: int = 8) -> DataFrame:
    """(ancestor, id, level) for each point and each of its ancestors, itself at level 0; one join a level, until none is left."""
    up = points.select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    layer = points.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("level"))
    found = layer
    for level in range(1, depth + 1):
        layer = layer.join(up, F.col("ancestor") == F.col("child")).where(F.col("parent").isNotNull()).select(F.col("parent").alias("ancestor"), "id", F.lit(level).alias("level"))
        found = found.unionAll(layer)
    return found


def repeated_titles(tasks: DataFrame) -> DataFrame:
    """(title_key, times): titles that more than one task has, case and outer white space aside. ``lower``, not case folding."""
    key = F.lower(F.trim("title"))
    return tasks.groupBy(key.alias("title_key")).agg(F.countDistinct("id").alias("times")).where((F.col("times") > 1) & (F.col("title_key") != ""))


def batch_delete(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows left, deleted count): distinct ids that aren't blank; those that rows don't have don't count."""
    wanted = ids.where(F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) != "").select("id").distinct()
    return rows.join(wanted, "id", "left_anti"), wanted.join(rows, "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def source_lookup(wanted: DataFrame, library: DataFrame) -> DataFrame:
    """For each wanted image (key, id, url, path) the first library row (by position) that has any of the three."""
    parts = [
        wanted.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").select("key", F.col(c).alias("v"))
        .join(library.select(F.col(c).alias("v"), "position", F.col("id").alias("image_id")), "v")
        .select("key", "position", "image_id")
        for c in ("id", "url", "path")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("key").agg(F.min(F.struct("position", "image_id"))["image_id"].alias("image_id"))


def files_by_owner(files: DataFrame, business_type: str, business_id) -> DataFrame:
    """A business object's files; on a table partitioned by business_type the filter prunes."""
    return files.where((F.col("business_type") == business_type) & (F.col("business_id") == F.lit(business_id)))


def review_queue(diffs: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, tasks) to review from diffs (task_id, question_id, change, detail) and issues (task_id, question_id, code, blocking)."""
    marks = issues.groupBy("task_id", "question_id").agg(F.bool_or("blocking").alias("blocking"), F.sort_array(F.collect_set("code")).alias("reasons"))
    changed = diffs.where(F.col("change") != "unchanged")
    line = F.concat_ws(" ", F.col("question_id").cast("string"), "change", "detail")
    changes = changed.groupBy("task_id").agg(F.count(F.lit(1)).alias("changed"), F.concat_ws("\n", F.sort_array(F.collect_list(line))).alias("lines"))
    totals = marks.groupBy("task_id").agg(F.count_if("blocking").alias("blocking"), F.count(F.lit(1)).alias("review_required"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    tasks = changes.join(totals, "task_id", "full_outer").select("task_id", zero("changed").alias("changed"), zero("blocking").alias("blocking"), zero("review_required").alias("review_required"), F.coalesce("lines", F.lit("")).alias("lines"))
    return marks, tasks


def unique_appends(items: DataFrame, picks: DataFrame) -> DataFrame:
    """Items (paper_id, position, question_id) with picks that aren't in the paper appended in order, each once."""
    new = picks.groupBy("paper_id", "question_id").agg(F.min("position").alias("at")).join(items, ["paper_id", "question_id"], "left_anti")
    last = items.groupBy("paper_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("at", "question_id"))
    added = new.withColumn("n", place).join(last, "paper_id", "left").select("paper_id", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("int").alias("position"), "question_id")
    return items.select("paper_id", "position", "question_id").unionByName(added)

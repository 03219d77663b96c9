"""Canonicalisation: matching answer-side questions to paper-side ones, merging, ids, diffs, dedup and versions.

Questions are rows keyed by (doc_id, question_id) with a position in their document. Scores are doubles rounded half-even to 6 places where the rule
says so. Null and empty texts mean "not given".
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkfolio.functions import patterns as P
from sparkfolio.functions.text import text
from sparkfolio.operators.jobs import given

MERGE_AT, MARGIN, REVIEW_AT = 0.75, 0.12, 0.65


def answer_zone(docs: DataFrame) -> DataFrame:
    """(doc_id, zone_start): where the first answer heading begins, else one behind the text's length."""
    t = text(F.col("markdown"))
    at = F.regexp_instr(t, F.lit(P.ANSWER_HEADING))
    return docs.select("doc_id", F.when(at > 0, at - 1).otherwise(F.length(t) + 1).alias("zone_start"))


def stem_core(stem: Column) -> Column:
    """A stem without task blocks, number, bracketed solutions and white space."""
    t = F.regexp_replace(text(stem), r"(?is)\\begin\{tasks\}.*?\\end\{tasks\}", "")
    t = F.regexp_replace(t, r"(?U)^\s*\d+\s*[.．、]\s*", "")
    t = F.regexp_replace(t, r"(?sU)【\s*(?:分析|解答|答案|点评|详解)\s*】.*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", ""), "^[。．]+|[。．]+$", "")


@F.pandas_udf(DoubleType())
def ratcliff(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff/Obershelp ratio; no JVM expression has it. Only blocked pairs come here."""
    for left, right in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


def stem_ratio(left: Column, right: Column, ratio: str) -> Column:
    if ratio == "ratcliff":
        return ratcliff(left, right)
    most = F.greatest(F.length(left), F.length(right))
    return F.when((F.length(left) > 0) & (F.length(right) > 0), 1 - F.levenshtein(left, right) / most).otherwise(F.lit(0.0))


def ratio_bounds(left: Column, right: Column) -> tuple[Column, Column]:
    """Two bounds that the Ratcliff/Obershelp ratio doesn't pass: by lengths, and by the characters that both have, counted."""
    size = F.length(left) + F.length(right)
    share = lambda n: F.when(size > 0, 2.0 * n / size).otherwise(0.0)
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c))
    common = F.aggregate(F.array_distinct(F.split(left, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(left, c), times(right, c))))
    return share(F.least(F.length(left), F.length(right))), share(common)


def jaccard(a: Column, b: Column) -> Column:
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def match_scores(paper: DataFrame, answers: DataFrame, ratio: str = "ratcliff", exact_runner_up: bool = False, least: float | None = None) -> DataFrame:
    """(doc_id, answer_id, paper_id, position, score) of pairs with an equal positive number.

    0.45 for the number, 0.35 times the stem ratio, 0.10 times the Jaccard index of option labels (image labels where a side has no
    options), 0.10 for the type. Pairs of other numbers stay below both thresholds and outside the margin, so the
    equi join decides alike; ``exact_runner_up`` pairs all of a document for the reported runner-up. With ``least``, pairs that can't score it by their lengths and common
    characters are left out before the ratio is worked out; below MERGE_AT - MARGIN no pair plays a part in a merge or review.
    Rows: doc_id, question_id, position, number, type, stem, options (labels), images (labels).
    """
    side = lambda df, p: df.select("doc_id", *[F.col(c).alias(f"{p}_{c}") for c in ("question_id", "position", "number", "type", "options", "images")], stem_core(F.col("stem")).alias(f"{p}_core"))
    p, a = side(paper, "p"), side(answers, "a")
    same = (F.col("p_number") == F.col("a_number")) & (F.col("p_number") > 0)
    pairs = p.join(a, "doc_id") if exact_runner_up else p.where("p_number > 0").join(a, (p["doc_id"] == a["doc_id"]) & same).drop(a["doc_id"])
    kind = lambda c: F.lower(F.trim(text(F.col(c))))
    types = F.when((kind("p_type") != "") & (kind("a_type") != ""), (kind("p_type") == kind("a_type")).cast("double")).otherwise(0.5)
    visual = F.coalesce(jaccard(F.col("p_options"), F.col("a_options")), jaccard(F.col("p_images"), F.col("a_images")), F.lit(0.0))
    scored = lambda stems: F.when(same, 0.45).otherwise(0.0) + 0.35 * stems + 0.10 * visual + 0.10 * types
    if least is not None:
        for bound in ratio_bounds(F.col("p_core"), F.col("a_core")):
            pairs = pairs.where(scored(bound) >= least - 1e-6)
    score = scored(stem_ratio(F.col("p_core"), F.col("a_core"), ratio))
    return pairs.select("doc_id", F.col("a_question_id").alias("answer_id"), F.col("p_question_id").alias("paper_id"), F.col("p_position").alias("position"), F.bround(score, 6).alias("score"))


def merge_decisions(scores: DataFrame) -> DataFrame:
    """(doc_id, answer_id, paper_id, score, runner_up, decision): merge at 0.75 with a margin of 0.12, else review at 0.65; ties by paper order."""
    order = Window.partitionBy("doc_id", "answer_id").orderBy(F.desc("score"), "position")
    ranked = scores.withColumn("k", F.row_number().over(order)).withColumn("runner_up", F.coalesce(F.lead("score").over(order), F.lit(0.0))).where("k = 1")
    decision = F.when((F.col("score") >= MERGE_AT) & (F.col("score") - F.col("runner_up") >= MARGIN), "merge").when(F.col("score") >= REVIEW_AT, "review").otherwise("none")
    return ranked.select("doc_id", "answer_id", "paper_id", "score", "runner_up", decision.alias("decision"))


def apply_merges(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Paper questions with the answers of what merges into them, in order of position: the first given value fills, another one is a conflict.

    questions: (doc_id, question_id, position, answer, analysis). Adds merged_from and conflicts; merged rows go.
    """
    merges = decisions.where(F.col("decision") == "merge").select("doc_id", F.col("answer_id").alias("question_id"), "paper_id")
    from_ = questions.join(merges, ["doc_id", "question_id"]).groupBy("doc_id", F.col("paper_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("position", F.col("question_id").alias("id"), "answer", "analysis"))).alias("d"))
    left = questions.join(merges.select("doc_id", "question_id"), ["doc_id", "question_id"], "left_anti").join(from_, ["doc_id", "question_id"], "left")
    left = left.withColumn("d", F.coalesce("d", F.array().cast(left.schema["d"].dataType)))
    first = lambda f: F.when(given(F.col(f)), F.col(f)).otherwise(F.coalesce(F.get(F.filter(F.transform("d", lambda x: x[f]), lambda v: given(v)), F.lit(0)), F.col(f)))
    left = left.withColumn("_answer", first("answer")).withColumn("_analysis", first("analysis"))
    odd = lambda f: F.exists("d", lambda x: given(x[f]) & (F.trim(x[f]) != F.trim(F.col(f"_{f}"))))
    conflicts = F.array_compact(F.array(F.when(odd("answer"), "answer-conflict"), F.when(odd("analysis"), "analysis-conflict")))
    out = left.withColumn("merged_from", F.transform("d", lambda x: x["id"])).withColumn("conflicts", conflicts)
    return out.withColumn("answer", F.col("_answer")).withColumn("analysis", F.col("_analysis")).drop("d", "_answer", "_analysis")


def clean_label_runs(rows: DataFrame) -> DataFrame:
    """``labels`` (array) to ``kept``, ``repeated`` and ``regressing``: the first increasing run, each label against the last one kept.

    Numbers rank before letters; labels that are neither are kept as they stand and don't count.
    """
    bare = lambda x: F.lower(F.regexp_replace(x, r"[()（）\s]", ""))
    rank = lambda x: F.when(bare(x).rlike(r"^\d+$"), bare(x).cast("int")).when(bare(x).rlike("^[a-z]$"), 1000 + F.ascii(bare(x)) - 96)
    text_ = "array<string>"
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast(text_).alias("kept"), F.array().cast(text_).alias("repeated"), F.array().cast(text_).alias("regressing"))

    def step(s, x):
        r = rank(x)
        free = r.isNull() | s["last"].isNull() | (r > s["last"])
        add = lambda name, test: F.when(test, F.concat(s[name], F.array(x))).otherwise(s[name]).alias(name)
        return F.struct(F.when(free, F.coalesce(r, s["last"])).otherwise(s["last"]).alias("last"), add("kept", free), add("repeated", ~free & (r == s["last"])), add("regressing", ~free & (r < s["last"])))

    return rows.withColumn("_s", F.aggregate("labels", zero, step)).select(*rows.columns, "_s.kept", "_s.repeated", "_s.regressing")


def id_map(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, source_id, canonical_id) for every question."""
    m = decisions.where(F.col("decision") == "merge").select("doc_id", F.col("answer_id").alias("source_id"), "paper_id")
    return questions.select("doc_id", F.col("question_id").alias("source_id")).join(m, ["doc_id", "source_id"], "left").select("doc_id", "source_id", F.coalesce("paper_id", "source_id").alias("canonical_id"))


def occurrence_ids(rows: DataFrame) -> DataFrame:
    """``unique_id``: repeats of an id within a document become id__occurrence_n in order of position."""
    n = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("position"))
    name = F.when(n > 1, F.concat(F.col("id").cast("string"), F.lit("__occurrence_"), n.cast("string"))).otherwise(F.col("id").cast("string"))
    return rows.withColumn("unique_id", name)


def stable_question_id(task: Column, source: Column) -> Column:
    return F.concat(F.lit("import_question_"), F.substring(F.sha2(F.concat_ws(":", text(task), text(source)), 256), 1, 24))


def stable_placement_id(key: Column) -> Column:
    return F.substring(F.sha1(text(key)), 1, 12)


def structure_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, source_id, changes) of what was added, removed, renumbered, or changed in stem, option count or placements."""
    fields = ("number", "stem", "options", "placements")
    b = before.select("doc_id", "source_id", F.struct(*fields).alias("b"))
    a = after.select("doc_id", "source_id", F.struct(*fields).alias("a"))
    j = b.join(a, ["doc_id", "source_id"], "full_outer")
    moved = lambda f, name: F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), name)
    changes = F.array_compact(F.array(F.when(F.col("b").isNull(), "added"), F.when(F.col("a").isNull(), "removed"), moved("number", "renumbered"), moved("stem", "stem"), moved("options", "option-count"), moved("placements", "placement")))
    return j.select("doc_id", "source_id", changes.alias("changes"))


def preserve_edits(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated rows with what was edited before: existing texts win if given, options change only for the same choice type and no manual review,
    confirmed and overridden placements stay. Rows: (doc_id, question_id, stem, answer, type, options, reviewed, placements map<image, struct<target, status>>)."""
    e = existing.select("doc_id", "question_id", *[F.col(c).alias(f"e_{c}") for c in ("stem", "answer", "type", "options", "reviewed", "placements")])
    j = generated.join(e, ["doc_id", "question_id"], "left")
    known = F.col("e_stem").isNotNull() | F.col("e_type").isNotNull()
    keep = lambda c: F.when(given(F.col(f"e_{c}")), F.col(f"e_{c}")).otherwise(F.col(c)).alias(c)
    renew = ~known | ((F.col("type") == "choice") & (F.col("e_type") == "choice") & ~F.coalesce("e_reviewed", F.lit(False)))
    held = F.map_filter(F.coalesce("e_placements", F.create_map().cast("map<string,struct<target:string,status:string>>")), lambda k, v: v["status"].isin("confirmed", "overridden"))
    fresh = F.map_filter("placements", lambda k, v: ~F.map_contains_key(held, k))
    return j.select("doc_id", "question_id", keep("stem"), keep("answer"), keep("type"), F.when(renew, F.col("options")).otherwise(F.col("e_options")).alias("options"), F.coalesce("e_reviewed", "reviewed").alias("reviewed"), F.map_concat(fresh, held).alias("placements"))


def recover_missing(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Stored rows plus the rebuilt inline-section ones beyond how many of their (number, in_answers) are stored."""
    keys = ["doc_id", "number", "in_answers"]
    have = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    extra = rebuilt.withColumn("nth", nth).join(have, keys, "left").where((F.col("kind") == "inline-section") & (F.col("nth") > F.coalesce("have", F.lit(0))))
    return stored.unionByName(extra.select(*stored.columns))


def content_key(stem: Column, answer: Column) -> Column:
    """Hash of a row's stem and answer, outer white space and case aside (``lower``)."""
    norm = lambda c: F.lower(F.trim(text(c)))
    return F.sha2(F.concat_ws("\u001f", norm(stem), norm(answer)), 256)


def exact_duplicates(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """Candidates (id, source_task, source_question, stem, answer) with ``duplicate_of`` and ``reason``: another bank row of the same source, else of the same content; the least id, or the greatest where that is the row itself."""
    source = bank.where(given(F.col("source_question"))).groupBy("source_task", "source_question").agg(F.min("id").alias("s1"), F.max("id").alias("s2"))
    content = bank.where(given(F.col("stem"))).groupBy(content_key(F.col("stem"), F.col("answer")).alias("key")).agg(F.min("id").alias("c1"), F.max("id").alias("c2"))
    other = lambda low, high: F.when(F.col(low) != F.col("id"), F.col(low)).when(F.col(high) != F.col("id"), F.col(high))
    j = candidates.withColumn("key", content_key(F.col("stem"), F.col("answer"))).join(source, ["source_task", "source_question"], "left").join(content, "key", "left")
    s, c = other("s1", "s2"), other("c1", "c2")
    return j.select("id", F.coalesce(s, c).alias("duplicate_of"), F.when(s.isNotNull(), "same-source").when(c.isNotNull(), "same-content").alias("reason"))


def bank_upsert(batch: DataFrame, bank: DataFrame, status: str = "已校验") -> tuple[DataFrame, DataFrame]:
    """(new bank, counts): checked rows overwrite the bank row they name (bank_id) or came from (task, question), else they are inserted unless their content is known.

    Of new rows of equal content in the batch the first by position is inserted. Bank: (id, source_task, source_question, stem, answer, created_at); batch: the same with position, status, bank_id.
    """
    rows = batch.where(F.col("status") == status).withColumn("key", content_key(F.col("stem"), F.col("answer")))
    by_source = bank.groupBy("source_task", "source_question").agg(F.min("id").alias("by_source"))
    known = bank.select(F.col("id").alias("bank_id"), F.lit(True).alias("named"))
    rows = rows.join(by_source, ["source_task", "source_question"], "left").join(known, "bank_id", "left").withColumn("target", F.coalesce(F.when(F.col("named"), F.col("bank_id")), "by_source"))
    updates = rows.where(F.col("target").isNotNull()).groupBy(F.col("target").alias("id")).agg(F.max(F.struct("position", "stem", "answer")).alias("u"))
    content = bank.select(content_key(F.col("stem"), F.col("answer")).alias("key")).distinct()
    fresh = rows.where(F.col("target").isNull()).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("position"))).join(content.withColumn("in_bank", F.lit(True)), "key", "left")
    new = F.col("in_bank").isNull() & (F.col("k") == 1)
    inserted = fresh.where(new).select(F.col("new_id").alias("id"), "source_task", "source_question", "stem", "answer", "created_at")
    kept = bank.join(updates, "id", "left").select("id", "source_task", "source_question", F.coalesce("u.stem", "stem").alias("stem"), F.coalesce("u.answer", "answer").alias("answer"), "created_at")
    counts = fresh.agg(F.count_if(new).alias("created"), F.count_if(~new).alias("duplicates"))
    return kept.unionByName(inserted), counts


def content_token(rows: DataFrame, *columns: str) -> DataFrame:
    """(task_id, token): SHA-256 over the sorted hashes of a task's rows; times and row order play no part."""
    one = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)
    return rows.groupBy("task_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), ""), 256).alias("token"))


def fresh_tokens(tokens: DataFrame, offered: DataFrame) -> DataFrame:
    """(task_id, fresh): whether the token that a caller offers is still the task's."""
    return offered.withColumnRenamed("token", "offered").join(tokens, "task_id", "left").select("task_id", F.coalesce(F.col("offered") == F.col("token"), F.lit(False)).alias("fresh"))


def rollback_latest(current: DataFrame, snapshots: DataFrame, kind: str) -> DataFrame:
    """Rows (task_id, ...) restored from each task's latest snapshot of a kind (highest version, then newest); tasks without one keep theirs.

    snapshots: (task_id, kind, version, created_at, rows array<struct>).
    """
    k = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("version"), F.desc("created_at")))
    last = snapshots.where(F.col("kind") == kind).withColumn("k", k).where("k = 1")
    restored = last.select("task_id", F.inline("rows"))
    return current.join(last.select("task_id"), "task_id", "left_anti").unionByName(restored)


def merge_child_updates(rows: DataFrame) -> DataFrame:
    """``current`` children with ``incoming`` ones matched by id, then label, then place, each used once; given fields win, the unmatched are appended.

    Children: array<struct<id, label, content>>. A fold in order, since each match takes one away.
    """
    kind = "array<struct<id:string,label:string,content:string>>"
    indexed = F.transform("incoming", lambda x, i: F.struct(i.alias("i"), x["id"].alias("id"), x["label"].alias("label"), x["content"].alias("content")))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("out"))

    def step(s, c):
        open_ = lambda x: ~F.array_contains(s["used"], x["i"])
        by = lambda f: F.get(F.filter("_in", lambda x: open_(x) & given(x[f]) & (x[f] == c[f])), F.lit(0))
        place = F.get(F.filter("_in", lambda x: open_(x) & (x["i"] == s["n"]) & ~given(x["id"]) & ~given(x["label"])), F.lit(0))
        m = F.coalesce(by("id"), by("label"), place)
        pick = lambda f: F.when(given(m[f]), m[f]).otherwise(c[f]).alias(f)
        return F.struct((s["n"] + 1).alias("n"), F.when(m.isNotNull(), F.concat(s["used"], F.array(m["i"]))).otherwise(s["used"]).alias("used"), F.concat(s["out"], F.array(F.struct(pick("id"), pick("label"), pick("content")))).alias("out"))

    rows = rows.withColumn("_in", indexed).withColumn("_s", F.aggregate("current", zero, step))
    rest = F.transform(F.filter("_in", lambda x: ~F.array_contains(F.col("_s.used"), x["i"])), lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["content"].alias("content")))
    return rows.withColumn("merged", F.concat(F.col("_s.out"), rest)).drop("_in", "_s")


def dedupe_images(images: DataFrame) -> DataFrame:
    """First image of each key (storage id, else url, path, name) of an owner, by priority then position; those without any go."""
    key = F.coalesce(*[F.when(given(F.col(c)), F.col(c).cast("string")) for c in ("storage_id", "url", "path", "name")])
    k = F.row_number().over(Window.partitionBy("owner_id", "key").orderBy("priority", "position"))
    return images.withColumn("key", key).where(F.col("key").isNotNull()).withColumn("k", k).where("k = 1").drop("k")


def canonicalize(docs: DataFrame, questions: DataFrame, ratio: str = "ratcliff") -> tuple[DataFrame, DataFrame]:
    """(merged questions, summary per document) of a corpus: zones, scores, decisions and merges; read-only.

    questions: doc_id, question_id, position, start, number, type, stem, options, images, answer, analysis.
    """
    zoned = questions.join(answer_zone(docs), "doc_id")
    paper, answers = zoned.where("start < zone_start"), zoned.where("start >= zone_start")
    decisions = merge_decisions(match_scores(paper, answers, ratio, least=MERGE_AT - MARGIN if ratio == "ratcliff" else None))
    merged = apply_merges(questions.select("doc_id", "question_id", "position", "answer", "analysis"), decisions)
    counts = decisions.groupBy("doc_id").agg(F.count_if(F.col("decision") == "merge").alias("merges"), F.count_if(F.col("decision") == "review").alias("reviews"))
    total = questions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return merged, total.join(counts, "doc_id", "left").select("doc_id", "questions", zero("merges"), zero("reviews"), (F.coalesce("reviews", F.lit(0)) > 0).alias("blocked"))


def snapshot(current: DataFrame, snapshots: DataFrame, kind: str, now: Column) -> DataFrame:
    """The rows to append for a new version of each task: (task_id, kind, version, created_at, rows); versions count on from the task's last of any kind."""
    columns = [c for c in current.columns if c != "task_id"]
    rows = current.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    last = snapshots.groupBy("task_id").agg(F.max("version").alias("last"))
    return rows.join(last, "task_id", "left").select("task_id", F.lit(kind).alias("kind"), (F.coalesce("last", F.lit(0)) + 1).alias("version"), now.alias("created_at"), "rows")


def stable_image_id(key: Column) -> Column:
    """The name-based UUID (version 3) of a key's UTF-8 bytes."""
    h = F.md5(text(key).cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

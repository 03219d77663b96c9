"""Segmentation of papers: lines, headings, declared structure, question anchors, spans and parts.

Documents are rows (doc_id, markdown); positions count code points from 0 and spans are half-open. What needs a
document's lines in order is a window over doc_id or a fold over its array of lines, so a document is the largest unit and
nothing crosses documents. Null markdown is empty; rows that repeat a doc_id would be one document, so ids are to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkfolio.functions import patterns as P
from sparkfolio.functions.text import find_all, has_any, let, once, question_type, strip, text


def index_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, end, raw, heading) with the newline inside the span; heading is without # marks. Lines end at newlines only."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text(F.col("markdown")), F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("line", "raw"))
    end = F.sum(F.length("raw")).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("raw"))
    heading = strip(F.regexp_replace(strip(F.col("raw")), "^#+", ""))
    return rows.withColumn("heading", heading).select("doc_id", "line", "start", "end", "raw", "heading")


def classify_headings(lines: DataFrame) -> DataFrame:
    """Adds section_type, is_section (names a type) and is_topic (generic) to lines; numbered lines are neither."""
    stripped, heading = strip(F.col("raw")), F.col("heading")
    kind = question_type(heading)
    numbered = heading.rlike(P.QUESTION_NUMBER)
    typed = (kind != "unknown") & (stripped.startswith("#") | heading.rlike(P.NUMBERED_HEADING))
    topic = (F.length(heading) > 0) & (F.length(heading) <= 48) & heading.rlike(P.GENERIC_HEADING)
    return lines.withColumn("section_type", kind).withColumn("is_section", typed & ~numbered).withColumn("is_topic", topic & ~numbered)


def looks_like_question(raw: Column, body: Column) -> Column:
    """Whether a numbered line reads like a question and not like an item of an overview."""
    one_line = F.regexp_replace(F.when(F.length(body) > 0, body).otherwise(raw), r"(?U)\s+", " ")
    return let(one_line, lambda t: t.rlike(P.SOURCE_TAG) | (t.rlike(P.STEM_CUE) & ~has_any(t, P.LIST_EXPLANATION)))  # a blank text has no cue


def structure_contract(lines: DataFrame) -> DataFrame:
    """(doc_id, total, total_source, first_section_start, sections) from classified lines.

    A section's range is what it states, else it follows the range before; a stated range sets the cursor behind its end. The total is the
    paper's, else the sum of the sections if all declare one.
    """
    heading = F.col("heading")
    ranges = F.filter(
        F.zip_with(F.regexp_extract_all(heading, F.lit(P.SECTION_RANGE), F.lit(1)), F.regexp_extract_all(heading, F.lit(P.SECTION_RANGE), F.lit(2)), lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))),
        lambda r: r["b"] >= r["a"],
    )
    count = F.nullif(F.regexp_extract(heading, P.SECTION_COUNT, 1), F.lit("")).cast("int")
    section = F.when(F.col("is_section"), F.struct("start", F.col("section_type").alias("type"), count.alias("declared"), F.array_min(F.transform(ranges, lambda r: r["a"])).alias("low"), F.array_max(F.transform(ranges, lambda r: r["b"])).alias("high")))
    like = heading.rlike(P.QUESTION_NUMBER) & ~has_any(heading, P.PREFACE) & looks_like_question(heading, F.regexp_extract(heading, P.QUESTION_NUMBER, 2))
    total = F.nullif(F.regexp_extract("raw", P.PAPER_TOTAL, 1), F.lit("")).cast("int")
    doc = lines.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(section)).alias("s"), F.min(F.when(total.isNotNull(), F.struct("line", total.alias("n"))))["n"].alias("paper_total"), F.min(F.when(like, F.col("start"))).alias("first_like")
    )
    zero = F.struct(F.lit(1).alias("cursor"), F.lit(0).alias("sum"), F.lit(True).alias("all"), F.array().cast("array<struct<start:int,type:string,declared:int,low:int,high:int>>").alias("out"))

    def add(state, x):
        stated = x["low"].isNotNull()
        n = F.when(stated & ~(F.coalesce(x["declared"], F.lit(0)) > 0), x["high"] - x["low"] + 1).otherwise(x["declared"])
        known = stated | (F.coalesce(n, F.lit(0)) > 0)
        low = F.when(stated, x["low"]).when(known, state["cursor"])
        high = F.when(stated, x["high"]).when(known, state["cursor"] + n - 1)
        row = F.struct(x["start"].alias("start"), x["type"].alias("type"), n.alias("declared"), low.alias("low"), high.alias("high"))
        return F.struct(F.coalesce(high + 1, state["cursor"]).alias("cursor"), (state["sum"] + F.when(known, n).otherwise(0)).alias("sum"), (state["all"] & known).alias("all"), F.concat(state["out"], F.array(row)).alias("out"))

    doc = doc.withColumn("f", F.aggregate("s", zero, add))
    complete = (F.size("s") > 0) & F.col("f.all")
    first = F.col("s")[0]["start"]
    sure = F.col("paper_total").isNotNull() | complete | ~F.coalesce(F.col("first_like") < first, F.lit(False))
    return doc.select(
        "doc_id", F.coalesce("paper_total", F.when(complete, F.col("f.sum"))).alias("total"), F.when(F.col("paper_total").isNotNull(), "paper").when(complete, "sections").alias("total_source"),
        F.when((F.size("s") > 0) & sure, F.get("s", F.lit(0))["start"]).alias("first_section_start"), F.col("f.out").alias("sections"),
    )


def anchor_candidates(lines: DataFrame) -> DataFrame:
    """Classified lines with their question number and the context-free marks of score_anchors (of numbered lines), and inline numbers with theirs."""
    heading, raw = F.col("heading"), F.col("raw")
    lines = lines.withColumn("_number", F.regexp_extract(heading, P.QUESTION_NUMBER, 1))
    numbered = F.col("_number") != ""
    lines = lines.withColumn("_body", F.when(numbered, F.regexp_extract(heading, P.QUESTION_NUMBER, 2)).otherwise(""))
    body = F.col("_body")

    def inline(m, images):
        rest = F.substring(raw, m["end"] + 1, F.length(raw))
        parts = F.struct(rest.alias("rest"), strip(F.substring(raw, m["start"] + 1, F.length(raw))).alias("own"))
        return let(parts, lambda p: F.struct(
            F.regexp_extract(m["match"], r"^(\d{1,3})", 1).cast("int").alias("number"), (F.col("start") + m["start"]).alias("start"), looks_like_question(p["own"], p["rest"]).alias("strong"),
            (has_any(p["own"], P.PREFACE) | has_any(p["rest"], P.PREFACE)).alias("preface"), (F.length(strip(p["rest"])) > 0).alias("has_body"),
            (~p["rest"].rlike(P.IMAGE_EXTENSION) & ~F.exists(images, lambda i: (i["start"] <= m["start"]) & (m["start"] < i["end"]))).alias("valid"),
        ))

    inlines = let(find_all(raw, P.IMAGE_REF), lambda images: F.filter(F.transform(find_all(raw, P.INLINE_NUMBER), lambda m: inline(m, images)), lambda x: x["valid"]))
    marks = lines.withColumn("number", F.nullif("_number", F.lit("")).cast("int")).withColumn("strong", numbered & looks_like_question(heading, body)).withColumn("preface", numbered & (has_any(heading, P.PREFACE) | has_any(body, P.PREFACE)))
    return marks.withColumn("has_body", body.rlike(r"(?U)\S")).withColumn("inlines", inlines).drop("raw", "heading", "line", "_number", "_body")


_ACCEPTED = "number int, start int, section int, type string, score int, reset boolean, kind string"


class _Anchors:
    """The state of accepting one document's anchors in order."""

    def __init__(self, first: int | None, strict: bool, declared: dict):
        self.first, self.strict, self.declared = first, strict, declared
        self.section, self.type, self.low, self.high, self.typed, self.sections = None, "unknown", None, None, False, 0
        self.last, self.last_section = None, None
        self.out = []

    def consider(self, x: dict | None, kind: str) -> None:
        """Accepts candidate x (number, start, strong, preface, has_body), or doesn't."""
        if x is None or x["number"] is None:
            return
        n, last, strong = x["number"], self.last, bool(x["strong"])
        before = self.first is not None and x["start"] < self.first
        outside = not before and self.strict and self.section is None
        opens = last is None
        weak = not strong and (opens or n == 1) and not self.typed
        ranged = self.low is not None and self.high is not None
        inside = ranged and self.low <= n <= self.high
        follows = not opens and n == last + 1
        moved = self.section is not None and self.last_section is not None and self.section != self.last_section
        reset = not opens and not follows and n == 1 and last >= 2 and strong and (moved or last >= 3)
        falls = not opens and not follows and not reset and n <= last
        score = 30 * (not before and not outside) + 20 * (not x["preface"]) + 15 * strong + 25 * (self.section is not None) + 20 * inside + (15 if follows else 10 if reset else 0) + 10 * bool(x["has_body"])
        if score < 45 or before or outside or x["preface"] or weak or (ranged and not inside) or falls:
            return
        self.section = self.section or 0
        self.out.append((n, x["start"], self.section, self.type, score, reset, kind))
        self.last, self.last_section = n, self.section

    def inline(self, line: dict, kind: str, strong: bool = False) -> None:
        wanted = (self.last or 0) + 1
        self.consider(next((i for i in line["inlines"] or () if i["number"] == wanted and (i["strong"] or not strong)), None), kind)

    def line(self, x: dict) -> None:
        if (x["is_section"] or x["is_topic"]) and x["number"] is None:
            known = self.declared.get(x["start"], {})
            self.sections += 1
            self.section, self.type, self.low, self.high = self.sections, x["section_type"], known.get("low"), known.get("high")
            self.typed = self.type != "unknown" or self.low is not None or known.get("declared") is not None
            self.inline(x, "inline-section", strong=True)
            return
        self.consider(x, "line-start")
        if self.section is not None and self.last is not None:
            self.inline(x, "inline")


def accept_anchors(candidates: DataFrame, contract: DataFrame) -> DataFrame:
    """(doc_id, number, start, section, type, score, reset, kind): anchors accepted in order.

    "Previous" is the last anchor accepted. Points: 30 in scope, 20 no preface, 15 reads like a question, 25 inside a section, 20 within its
    declared range, 15 next number (10: allowed restart), 10 with a body; 45 and no hard reason are needed. An inline anchor counts
    only within a section, after a question, with the next number, one a line; behind a heading it also has to read like a question.
    Each acceptance depends on those before it, so a document's candidate lines, put in order by Spark, go through one loop; lines that are neither candidates nor headings never get there.
    """
    c = contract.select("doc_id", "total", F.col("first_section_start").alias("first"), "sections")
    telling = F.col("number").isNotNull() | F.col("is_section") | F.col("is_topic") | (F.size("inlines") > 0)
    lines = once(candidates).where(telling).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "is_section", "is_topic", "section_type", "number", "strong", "preface", "has_body", "inlines"))).alias("lines"))
    sections = F.coalesce("sections", F.array().cast("array<struct<start:int,type:string,declared:int,low:int,high:int>>"))
    authority = F.col("first").isNotNull() | F.col("total").isNotNull() | F.exists("sections", lambda s: s["low"].isNotNull())
    rows = lines.join(c, "doc_id", "left").withColumn("sections", sections).select("doc_id", "lines", "first", "sections", (authority & (F.size("sections") > 0)).alias("strict"))
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    types = [id_type, *[pa.int32()] * 3, pa.string(), pa.int32(), pa.bool_(), pa.string()]
    names = ["doc_id", *[f.split()[0] for f in _ACCEPTED.split(", ")]]

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                doc_id, own, first, known, strict = (batch.column(i)[at].as_py() for i in range(5))
                state = _Anchors(first, strict, {s["start"]: s for s in reversed(known)})
                for line in own:
                    state.line(line)
                found += [(doc_id, *row) for row in state.out]
            columns = zip(*found, strict=True) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(accept, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_ACCEPTED}")


def question_spans(accepted: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Accepted anchors with id and end: the next question or section start, else the document's end. Repeated numbers get q_n_2, q_n_3."""
    heads = once(lines.select("doc_id", "start", "is_section", "is_topic")).where((F.col("is_section") | F.col("is_topic"))).select("doc_id", "start", F.lit(None).cast("int").alias("number"))
    starts = accepted.select("doc_id", "start").unionByName(heads.select("doc_id", "start")).distinct()
    ends = starts.withColumn("next", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))
    size = docs.select("doc_id", F.length(text(F.col("markdown"))).alias("size"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("start"))
    out = accepted.join(ends, ["doc_id", "start"]).join(size, "doc_id").withColumn("n", nth)
    name = F.concat(F.lit("q_"), F.col("number").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""))
    return out.withColumn("question_id", name).withColumn("end", F.coalesce("next", "size")).drop("next", "size", "n")


def span_text(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with their text."""
    body = F.substring(F.col("markdown"), F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.join(docs.select("doc_id", "markdown"), "doc_id").withColumn("text", body).drop("markdown")


def trim_tail(spans: DataFrame) -> DataFrame:
    """Cuts titles and answer headings behind some text off (text, end)."""
    first = F.regexp_instr(F.col("text"), F.lit(r"(?U)\S"))
    spans = spans.withColumn("_cut", let(first, lambda at: F.get(F.filter(find_all(F.col("text"), P.TAIL), lambda m: (at > 0) & (at <= m["start"])), F.lit(0))["start"]))
    kept = F.regexp_replace(F.substring(F.col("text"), F.lit(1), F.col("_cut")), r"(?U)\s+$", "")
    out = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept)
    spans = spans.withColumn("text", out).drop("_cut")
    return spans.withColumn("end", F.col("start") + F.length("text"))


def _parts(found: Column, base: Column, stop: Column) -> Column:
    """Matches (label, start, end) to parts that each end where the next begins."""
    return F.transform(found, lambda m, i: F.struct(m["label"].alias("label"), (base + m["start"]).alias("start"), (base + m["end"]).alias("content_start"), F.coalesce(base + F.get(found, i + 1)["start"], stop).alias("end")))


def sub_question_spans(spans: DataFrame) -> DataFrame:
    """``parts``: labelled sub-questions of (text, start, end, type); fewer than two, or a choice question, have none."""
    found = find_all(F.col("text"), P.SUB_LABEL)

    def one(m):
        label = F.regexp_extract(m["match"], P.SUB_LABEL, 1)
        compact = F.regexp_replace(label, r"(?U)\s+", "")
        circled = F.instr(F.lit("①②③④⑤⑥⑦⑧⑨⑩"), compact)
        name = F.when(circled > 0, F.concat(F.lit("("), circled.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("("), F.regexp_extract(compact, "[（(](.*?)[）)]", 1), F.lit(")")))
        return F.struct(name.alias("label"), (m["end"] - F.length(label)).alias("start"), m["end"].alias("end"))

    spans = spans.withColumn("_m", F.transform(found, one))
    parts = F.when((F.size("_m") >= 2) & (F.col("type") != "choice"), _parts(F.col("_m"), F.col("start"), F.col("end")))
    return spans.withColumn("parts", F.coalesce(parts, F.array().cast("array<struct<label:string,start:int,content_start:int,end:int>>"))).drop("_m")


def option_spans(spans: DataFrame) -> DataFrame:
    """``options``: the first run of labels A, B, C, ... of two or more in (text, start, end); another label ends the run."""

    def one(m):
        letter = F.translate(F.upper(F.regexp_extract(m["match"], "([A-Ha-hＡ-Ｈａ-ｈ])", 1)), "ＡＢＣＤＥＦＧＨ", "ABCDEFGH")
        lead = F.length(F.regexp_extract(m["match"], r"(?U)^(?:[\r\n]+|[ \t　]+|[。；;：:，,、?？）)]\s*)", 0))
        return F.struct(letter.alias("label"), (m["start"] + lead).alias("start"), m["end"].alias("end"))

    spans = spans.withColumn("_m", F.transform(find_all(F.col("text"), P.OPTION_MARKER), one))
    zero = F.struct(F.lit(False).alias("done"), F.array().cast("array<struct<label:string,start:int,end:int>>").alias("run"))

    def step(s, m):
        wanted = F.char(F.lit(65) + F.size(s["run"]))
        grown = F.struct(F.lit(False).alias("done"), F.concat(s["run"], F.array(m)).alias("run"))
        fresh = F.struct(F.lit(False).alias("done"), F.when(m["label"] == "A", F.array(m)).otherwise(zero["run"]).alias("run"))
        closed = F.struct(F.lit(True).alias("done"), s["run"].alias("run"))
        return F.when(s["done"], s).when(m["label"] == wanted, grown).when(F.size(s["run"]) >= 2, closed).otherwise(fresh)

    run = F.aggregate("_m", zero, step, lambda s: s["run"])
    spans = spans.withColumn("_r", run)
    options = F.when(F.size("_r") >= 2, _parts(F.col("_r"), F.col("start"), F.col("end"))).otherwise(F.array().cast("array<struct<label:string,start:int,content_start:int,end:int>>"))
    return spans.withColumn("options", options).drop("_m", "_r")


def image_refs(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, path, start, end, asset_path): references with the asset of the same path, else a path ending in it, else the same file name."""
    rows = docs.select("doc_id", F.inline(find_all(text(F.col("markdown")), P.IMAGE_REF)))
    rows = rows.withColumn("path", F.regexp_extract("match", P.IMAGE_REF, 1)).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    a = assets.select(F.col("path").alias("asset_path"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("position"))
    rank = F.when(F.col("asset_path") == F.col("path"), 0).when(F.col("asset_path").endswith(F.concat(F.lit("/"), F.col("path"))), 1).otherwise(2)
    joined = rows.join(a, "name", "left").groupBy("doc_id", "start", "end", "path").agg(F.min(F.when(F.col("asset_path").isNotNull(), F.struct(rank.alias("k"), "position", "asset_path")))["asset_path"].alias("asset_path"))
    return joined.select("doc_id", "path", "start", "end", "asset_path")


def extract_solutions(rows: DataFrame, col: str = "text") -> DataFrame:
    """``stem``, ``answer``, ``analysis`` of a text by its solution marks; a short first paragraph or line of an answer stays, the rest is analysis."""
    t = text(F.col(col))
    rows = rows.withColumn("_m", find_all(t, P.SOLUTION_MARKER))
    piece = F.transform("_m", lambda m, i: F.struct(m["match"].contains("答案").alias("is_answer"), strip(F.substring(t, m["end"] + 1, F.coalesce(F.get("_m", i + 1)["start"], F.length(t)) - m["end"])).alias("body")))
    rows = rows.withColumn("_p", piece)

    def short(x):
        compact = F.regexp_replace(x, r"(?U)\s+", "")
        return (F.length(compact) > 0) & (F.length(compact) <= 80) & ~compact.rlike(P.REASONING)

    def halves(body):
        para, line = F.split(body, r"(?U)\n\s*\n", 2), F.split(body, "\n", 2)
        two = lambda a: F.struct(strip(a[0]).alias("answer"), strip(a[1]).alias("rest"))
        whole = F.struct(body.alias("answer"), F.lit("").alias("rest"))
        return F.when((F.size(para) == 2) & short(para[0]), two(para)).when((F.size(line) == 2) & short(line[0]), two(line)).otherwise(whole)

    pairs = F.transform("_p", lambda p: F.when(p["is_answer"], halves(p["body"])).otherwise(F.struct(F.lit("").alias("answer"), p["body"].alias("rest"))))
    joined = lambda f: F.array_join(F.filter(F.transform(pairs, lambda p: p[f]), lambda x: x != ""), "\n\n")
    stem = F.when(F.size("_m") > 0, strip(F.substring(t, F.lit(1), F.col("_m")[0]["start"]))).otherwise(t)
    return rows.withColumn("stem", stem).withColumn("answer", joined("answer")).withColumn("analysis", joined("rest")).drop("_m", "_p")


def refine_type(kind: Column, body: Column) -> Column:
    return F.when(kind == "choice", kind).when(body.rlike(P.FILL_BLANK), "fill_blank").when(kind.isin("fill_blank", "solution"), kind).otherwise("unknown")


def build_questions(spans: DataFrame) -> DataFrame:
    """Questions from spans with text: tail cut, solutions split off, parts and options found, type refined; parts empty the parent's own answer and options."""
    q = option_spans(sub_question_spans(trim_tail(spans).withColumn("type", refine_type(F.col("type"), F.col("text")))))
    q = extract_solutions(q)
    has = F.size("parts") > 0
    none = F.array().cast("array<struct<label:string,start:int,content_start:int,end:int>>")
    return q.withColumn("answer", F.when(has, "").otherwise(F.col("answer"))).withColumn("analysis", F.when(has, "").otherwise(F.col("analysis"))).withColumn("options", F.when(has, none).otherwise(F.col("options")))


def boundary_confidence(docs: DataFrame, questions: DataFrame, contract: DataFrame) -> DataFrame:
    """(doc_id, question_count, reasons): empty reasons mean high confidence. Questions: number, start, end, reset, type, options (array)."""
    order = Window.partitionBy("doc_id").orderBy("start")
    prev = F.lag("number").over(order)
    q = questions.withColumn("_prev", prev)
    gap = F.col("_prev").isNotNull() & ~F.col("reset") & (F.col("number") != F.col("_prev") + 1)
    odd_reset = F.col("_prev").isNotNull() & F.col("reset") & ((F.col("number") != 1) | (F.col("_prev") < 2))
    agg = q.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("d"), F.bool_or(gap).alias("gap"), (F.bool_or(F.col("reset")) & ~F.bool_or(gap | odd_reset)).alias("resets"),
        F.bool_or(F.col("end") <= F.col("start")).alias("bad"), F.bool_or((F.col("type") == "choice") & ~F.size("options").isin(0, 4)).alias("options"), F.transform(F.array_sort(F.collect_list(F.struct("start", "number"))), lambda x: x["number"]).alias("numbers"),
    )
    expected = F.flatten(F.transform(F.filter("sections", lambda s: s["low"].isNotNull()), lambda s: F.sequence(s["low"], s["high"])))
    joined = docs.select("doc_id").join(agg, "doc_id", "left").join(contract.select("doc_id", "total", expected.alias("expected")), "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(n == 0, "no-question-boundaries"), F.when(yes((F.col("total") > 0) & (n != F.col("total"))), "question-count-mismatch"),
        F.when(yes((F.size("expected") > 0) & ~F.coalesce(F.col("numbers") == F.col("expected"), F.lit(False))), "question-number-contract-mismatch"),
        F.when(yes((F.col("d") < F.col("n")) & ~F.col("resets")), "duplicate-question-number"), F.when(yes(F.col("gap")), "question-number-gap"), F.when(yes(F.col("bad")), "invalid-question-range"), F.when(yes(F.col("options")), "unstable-choice-options"),
    ))
    return joined.select("doc_id", n.alias("question_count"), reasons.alias("reasons"))


def validate_structure(questions: DataFrame, contract: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings) over questions (number, text, parts, answer, analysis): evidence that doesn't begin with its number, parents with answers, repeats, declared totals missed."""
    begins = F.regexp_extract("text", P.QUESTION_NUMBER, 1) == F.col("number").cast("string")
    agg = questions.groupBy("doc_id").agg(
        F.count_if(~begins).alias("odd"), F.count_if((F.size("parts") > 0) & ((F.col("answer") != "") | (F.col("analysis") != ""))).alias("parent"), F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("d"), F.count_if(F.col("answer") == "").alias("unanswered"))
    j = agg.join(contract.select("doc_id", "total"), "doc_id", "left")
    errors = F.array_compact(F.array(F.when(F.col("odd") > 0, "evidence-number"), F.when(F.col("parent") > 0, "parent-answer"), F.when(F.coalesce(F.col("total") != F.col("n"), F.lit(False)), "count-mismatch"), F.when(F.col("d") < F.col("n"), "duplicate-number")))
    return j.select("doc_id", errors.alias("errors"), F.array_compact(F.array(F.when(F.col("unanswered") > 0, "unanswered"))).alias("warnings"))


def choose_candidate(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(doc_id, chosen): per document the fallback where only it is valid, or where neither is and its quality (evidence, complete choices, options, images) is higher."""
    quality = F.struct("evidence", "choices", "options", "images")
    p = primary.select("doc_id", F.col("valid").alias("pv"), quality.alias("pq"))
    f = fallback.select("doc_id", F.col("valid").alias("fv"), quality.alias("fq"))
    use = F.coalesce(~F.coalesce("pv", F.lit(False)) & (F.col("fv") | F.col("pq").isNull() | (F.col("fq") > F.col("pq"))), F.lit(False))
    return p.join(f, "doc_id", "full_outer").select("doc_id", F.when(use, "fallback").otherwise("primary").alias("chosen"))


def split_simple(lines: DataFrame) -> DataFrame:
    """(doc_id, question, section, number, body): the plain splitter over classified lines. A numbered line opens a question of the last typed section."""
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    number = F.nullif(F.regexp_extract("heading", P.QUESTION_NUMBER, 1), F.lit("")).cast("int")
    rows = lines.withColumn("number", number).withColumn("question", F.sum(number.isNotNull().cast("int")).over(order)).withColumn("section", F.last(F.when(F.col("is_section"), F.col("section_type")), ignorenulls=True).over(order))
    rows = rows.where((F.col("question") > 0) & ~F.col("is_section"))
    return rows.groupBy("doc_id", "question").agg(
        F.min(F.struct("line", F.coalesce("section", F.lit("unknown")).alias("s")))["s"].alias("section"), F.max("number").alias("number"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "")).alias("body"))


def plan_chunks(spans: DataFrame, size: int = 5, max_chars: int = 12000) -> DataFrame:
    """(doc_id, chunk, first, last, start, end): greedy groups of consecutive questions, cut where one would have more than ``size`` or span too far."""
    limit = max(1000, max_chars)
    spans_ = F.array_sort(F.collect_list(F.struct("start", "end")))
    chunk = "array<struct<first:int,last:int,start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("n"), F.array().cast(chunk).alias("out"))

    def step(s, q):
        joins = (F.size(s["out"]) > 0) & (s["n"] - F.try_element_at(s["out"], F.lit(-1))["first"] < size) & (q["end"] - F.try_element_at(s["out"], F.lit(-1))["start"] <= limit)
        last = F.try_element_at(s["out"], F.lit(-1))
        grown = F.struct(last["first"].alias("first"), s["n"].alias("last"), last["start"].alias("start"), q["end"].alias("end"))
        new = F.struct(s["n"].alias("first"), s["n"].alias("last"), q["start"].alias("start"), q["end"].alias("end"))
        out = F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(s["out"], F.array(new)))
        return F.struct((s["n"] + 1).alias("n"), out.alias("out"))

    return spans.groupBy("doc_id").agg(spans_.alias("q")).select("doc_id", F.posexplode(F.aggregate("q", zero, step, lambda s: s["out"])).alias("chunk", "c")).select("doc_id", "chunk", "c.*")


def merge_chunk_results(local: DataFrame, refined: DataFrame) -> DataFrame:
    """Rows of chunks: (doc_id, chunk, offset, start, end, ...) refined where a chunk has any, else local; positions shifted back, one row a start (the first chunk's)."""
    done = refined.select("doc_id", "chunk").distinct()
    rows = local.join(done, ["doc_id", "chunk"], "left_anti").unionByName(refined)
    rows = rows.withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset"))
    k = F.row_number().over(Window.partitionBy("doc_id", "start").orderBy("chunk", "end"))
    return rows.withColumn("k", k).where("k = 1").drop("k", "offset")


def question_context(docs: DataFrame, questions: DataFrame, limit: int = 6000) -> DataFrame:
    """(doc_id, number, context): text from the first line of a number to the next line of a greater one, cut to ``limit``; null where no line has it.

    A document's numbered lines are read from its end with a stack: those nearer than all greater ones. What remains of it above a line's number is the line's end.
    Numbers have at most three digits, so neither stack nor result holds more than 999 entries, and the work is linear in the lines.
    """
    lines = index_lines(docs).withColumn("number", F.nullif(F.regexp_extract("heading", P.QUESTION_NUMBER, 1), F.lit("")).cast("int")).where(F.col("number").isNotNull())
    nth = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("start"))
    ordered = lines.withColumn("first", nth == 1).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "number", "first")), asc=False).alias("l"))
    zero = F.struct(F.array().cast("array<struct<start:int,number:int>>").alias("above"), F.array().cast("array<struct<number:int,start:int,end:int>>").alias("out"))

    def back(s, x):
        above = F.filter(s["above"], lambda a: a["number"] > x["number"])
        row = F.struct(x["number"].alias("number"), x["start"].alias("start"), F.get(above, F.lit(0))["start"].alias("end"))
        return F.struct(F.concat(F.array(F.struct(x["start"].alias("start"), x["number"].alias("number"))), above).alias("above"), F.when(x["first"], F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    ends = ordered.select("doc_id", F.inline(F.aggregate("l", zero, back, lambda s: s["out"])))
    wanted = questions.select("doc_id", "number").distinct().join(ends, ["doc_id", "number"]).join(docs, "doc_id")
    body = F.substring(F.col("markdown"), F.col("start") + 1, F.coalesce("end", F.length("markdown")) - F.col("start"))
    return wanted.select("doc_id", "number", F.substring(strip(body), 1, limit).alias("context"))


def flatten_questions(docs: DataFrame, with_children: bool = True) -> DataFrame:
    """(doc_id, path, id, parent_id) from (sections: array<struct<questions>>, questions): parents from the sections, else the flat list, with children behind them."""
    source = F.when(F.size(F.coalesce(F.flatten("sections.questions"), F.array().cast("array<string>").cast("array<string>"))) > 0, F.flatten("sections.questions")).otherwise(F.col("questions")) if "sections" in docs.columns else F.col("questions")
    parents = docs.select("doc_id", F.posexplode(source).alias("n", "q"))
    out = parents.select("doc_id", F.array("n").alias("path"), F.col("q.id").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    if with_children:
        kids = parents.select("doc_id", "n", F.col("q.id").alias("parent_id"), F.posexplode("q.children").alias("m", "c"))
        out = out.unionByName(kids.select("doc_id", F.array("n", "m").alias("path"), F.col("c.id").alias("id"), "parent_id"))
    return out


def safe_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, ...) from outside, clamped to their text, empty ones dropped, each cut at the next start."""
    size = docs.select("doc_id", F.length(text(F.col("markdown"))).alias("_size"))
    within = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.col("_size"))
    rows = spans.join(size, "doc_id").withColumn("start", within("start")).withColumn("end", within("end")).where("end > start")
    cut = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start", "end"))
    return rows.withColumn("end", F.least("end", F.coalesce(cut, F.col("end")))).where("end > start").drop("_size")


def adopt_side_images(primary: DataFrame, side: DataFrame) -> DataFrame:
    """(doc_id, position, image): images of the n-th side question of a number for the n-th primary one without images, unless another question owns them.

    primary and side: (doc_id, position, number, images). An image that several would adopt goes to the first.
    """
    nth = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("position")))
    p, s = nth(primary), nth(side)
    owned = primary.select("doc_id", F.explode("images").alias("image")).distinct()
    bare = p.where(F.size("images") <= 0).select("doc_id", "position", "number", "n")
    offered = bare.join(s.select("doc_id", "number", "n", F.explode("images").alias("image")), ["doc_id", "number", "n"]).join(owned, ["doc_id", "image"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "image").orderBy("position"))
    return offered.withColumn("k", first).where("k = 1").select("doc_id", "position", "image")


def restore_truncated(refined: DataFrame, local: DataFrame, limit: int) -> DataFrame:
    """Refined spans plus local ones that start at or behind the limit where the text was cut and aren't among them."""
    lost = local.where(F.col("start") >= limit).join(refined.select("doc_id", "start"), ["doc_id", "start"], "left_anti")
    return refined.unionByName(lost)


def local_sub_split(rows: DataFrame, cue: str = P.STEM_CUE, least: int = 6) -> DataFrame:
    """``parts`` of solution stems whose labelled bodies are all long enough or have a cue; others keep none."""
    split = sub_question_spans(rows)
    fine = F.forall("parts", lambda p: (p["end"] - p["content_start"] >= least) | F.substring(F.col("text"), p["content_start"] - F.col("start") + 1, p["end"] - p["content_start"]).rlike(cue))
    keep = (F.col("type") == "solution") & fine
    return split.withColumn("parts", F.when(keep, F.col("parts")).otherwise(F.filter("parts", lambda p: F.lit(False))))


def split_options(rows: DataFrame, col: str = "text") -> DataFrame:
    """``stem`` and ``choices`` (array<struct<label, content>>) of a text: from its tasks environment, else its marked options; images at the end of the last option belong to the stem."""
    t = text(F.col(col))
    body = F.regexp_extract(t, r"(?s)\\begin\{tasks\}(?:\([^)]+\)|\[[^\]]+\])?(.*?)\\end\{tasks\}", 1)
    tasks = F.filter(F.transform(F.slice(F.split(body, r"\\task\b"), 2, 26), strip), lambda x: x != "")
    letter = lambda i: F.char(F.lit(65) + i)
    rows = rows.withColumn("start", F.lit(0)).withColumn("end", F.length(t)).withColumn("text", t) if "start" not in rows.columns else rows
    marked = option_spans(rows).withColumn("_t", tasks)
    own = F.transform("options", lambda o: F.struct(o["label"].alias("label"), strip(F.substring(t, o["content_start"] - F.col("start") + 1, o["end"] - o["content_start"])).alias("content")))
    from_tasks = F.transform("_t", lambda x, i: F.struct(letter(i).alias("label"), x.alias("content")))
    marked = marked.withColumn("choices", F.when(F.size("_t") >= 2, from_tasks).otherwise(own))
    stem = F.when(F.size("_t") >= 2, strip(F.regexp_replace(t, r"(?s)\\begin\{tasks\}.*?\\end\{tasks\}", ""))).when(F.size("options") > 0, strip(F.substring(t, F.lit(1), F.get("options", F.lit(0))["start"] - F.col("start")))).otherwise(t)
    tail = F.regexp_extract(F.coalesce(F.try_element_at("choices", F.lit(-1))["content"], F.lit("")), r"(?U)((?:\s*!\[[^\]]*]\s*\([^)]+\)\s*)+)$", 1)
    marked = marked.withColumn("stem", stem).withColumn("_tail", tail)
    last = F.size("choices") - 1
    trimmed = F.transform("choices", lambda c, i: F.struct(c["label"].alias("label"), F.when((i == last) & (F.length(c["content"]) > F.length("_tail")), strip(F.substring(c["content"], F.lit(1), F.length(c["content"]) - F.length("_tail")))).otherwise(c["content"]).alias("content")))
    moved = (F.length("_tail") > 0) & (F.length(F.coalesce(F.try_element_at("choices", F.lit(-1))["content"], F.lit(""))) > F.length("_tail"))
    return marked.withColumn("stem", F.when(moved, F.concat(F.col("stem"), F.lit("\n"), strip(F.col("_tail")))).otherwise(F.col("stem"))).withColumn("choices", trimmed).drop("_t", "_tail", "options")

"""Text hygiene: formulas, duplicated stems, solutions, figures and options, as column expressions.

Columns in, columns out; null is empty text. Issues are arrays of short codes. Case is folded with ``lower``. Spans of formulas are
found by tokens that cover the whole text, so an opening delimiter without an end makes the rest plain.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sparkfolio.functions import patterns as P
from sparkfolio.functions.text import find_all, let, strip, text
from sparkfolio.operators.jobs import given

# Formula tokens, commands, environments, symbols.
MATH_TOKEN = r"\$\$[\s\S]*?\$\$|\$\$[\s\S]*$|\$(?!\$)[\s\S]*?\$|\$[\s\S]*$|[^$]+"
MATH_COMMAND = r"\\(?:frac|sqrt|pi|angle|circ|leq|geq|times|div|cdot|bullet|left|right|textcircled)\b"
NAKED_COMMAND = r"(?U)(?<!\$)((?:[-+]\s*)?(?:\{?\s*)?\\(?:frac|sqrt|pi|angle|leq|geq|times|div|cdot|bullet|textcircled)\b(?:\s*(?:\[[^\]]+\]|\{[^{}]*\}|[A-Za-z0-9+\-^_]+))*)"
GLUED = r"(?U)(?<=[^\s$])\$\$(?=[^\s$])"
QUOTE_EXPONENT = r"(?U)\b[\dA-Za-z]\s*[\"“”]\s*(?:=|，|,|、|\)|$)"
SINGLE_DOLLAR = r"(?<!\$)\$(?!\$)"
OPENING = r"(?mdU)^[ \t]*\S[^\n]*"
ENVIRONMENTS = ("array", "cases", "aligned", "matrix", "pmatrix", "bmatrix")
OPERATOR_CUT = r"(?U)\$([^$\n]+)\$\s*(\\(?:cdot|times|div|pm|leq|geq|neq|le|ge|ne)|[+\-=<>])\s*\$([^$\n]+)\$"
TIDY = (
    (r"(?U)(?<=\d)\s+(?=\d)", ""), (r"(?U)\\([A-Za-z]+)\s+(?=[{\[])", r"\\$1"), (r"(?U)\{\s+", "{"), (r"(?U)\s+\}", "}"), (r"(?U)\}\s+\{", "}{"), (r"(?U)\[\s+", "["),
    (r"(?U)\s+\]", "]"), (r"(?U)\]\s+\{", "]{"), (r"(?U)\^\s*\{", "^{"), (r"(?U)_\s*\{", "_{"), (r"(?U)\s{2,}", " "),
)
SYMBOLS = (("leq", "≤"), ("le", "≤"), ("geq", "≥"), ("ge", "≥"), ("neq", "≠"), ("ne", "≠"), ("approx", "≈"), ("pm", "±"), ("times", "×"), ("div", "÷"), ("cdot", "·"), ("pi", "π"), ("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("theta", "θ"), ("Delta", "Δ"))
BLANK = r"_{2,}|＿{2,}|\\_"


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def tokens(c: Column) -> Column:
    """array<struct<math, mark, body>>: formulas with their delimiter, and the text between."""
    def one(t):
        display = (F.length(t) >= 4) & t.startswith("$$") & t.endswith("$$")
        inline = (F.length(t) >= 2) & t.startswith("$") & ~t.startswith("$$") & t.endswith("$")
        mark = F.when(display, "$$").when(inline, "$").otherwise("")
        n = F.length(mark)
        return F.struct((n > 0).alias("math"), mark.alias("mark"), F.substring(t, n + 1, F.length(t) - 2 * n).alias("body"))

    return F.transform(F.regexp_extract_all(c, F.lit(MATH_TOKEN), F.lit(0)), one)


def balanced(c: Column, left: str, right: str) -> Column:
    """Whether brackets close in order: depth never below zero and zero at the end."""
    marks = F.split(F.regexp_replace(c, f"[^\\{left}\\{right}]+", ""), "")
    step = lambda s, x: F.when(s < 0, s).when(x == left, s + 1).when(x == right, s - 1).otherwise(s)
    return F.aggregate(marks, F.lit(0), step) == 0


def math_issues(c: Column) -> Column:
    """glued-dollars, quote-exponent, odd-dollars, unbalanced-braces, unbalanced-brackets, naked-command."""
    c = text(c)
    parts = tokens(c)
    dollar, slash = c.contains("$"), c.contains("\\")
    any_ = lambda test: F.exists(parts, test)
    return F.array_compact(F.array(
        F.when(c.contains("$$") & c.rlike(GLUED), "glued-dollars"), F.when(c.rlike("[\"“”]") & c.rlike(QUOTE_EXPONENT), "quote-exponent"), F.when(dollar & (count(c, SINGLE_DOLLAR) % 2 == 1), "odd-dollars"),
        F.when(dollar & any_(lambda p: p["math"] & ~balanced(p["body"], "{", "}")), "unbalanced-braces"), F.when(dollar & any_(lambda p: p["math"] & ~balanced(p["body"], "[", "]")), "unbalanced-brackets"),
        F.when(slash & any_(lambda p: ~p["math"] & p["body"].rlike(MATH_COMMAND)), "naked-command"),
    ))


def _map_tokens(c: Column, math, plain) -> Column:
    return F.array_join(F.transform(tokens(c), lambda p: F.when(p["math"], F.concat(p["mark"], math(p["body"]), p["mark"])).otherwise(plain(p["body"]))), "")


def _tidy(body: Column) -> Column:
    body = strip(body)
    for pattern, new in TIDY:
        body = F.regexp_replace(body, pattern, new)
    return body


def normalize_once(c: Column) -> Column:
    """One pass over text: glued $$ apart, naked commands wrapped, formulas tidied, an odd $ closed. Text without a dollar or backslash is as it should be."""
    split = F.regexp_replace(F.regexp_replace(c, GLUED, r"\$ \$"), r"(?<!\$)\$\$(?=\\[A-Za-z])", r"\$ \$")
    wrapped = _map_tokens(split, lambda b: b, lambda b: F.when(b.contains("\\"), F.regexp_replace(b, NAKED_COMMAND, r"\$$1\$")).otherwise(b))
    closed = let(_map_tokens(wrapped, _tidy, lambda b: b), lambda x: F.when(count(x, SINGLE_DOLLAR) % 2 == 1, F.concat(x, F.lit("$"))).otherwise(x))
    return F.when(c.contains("$") | c.contains("\\"), closed).otherwise(c)


def normalize_math(df: DataFrame, col: str, passes: int = 4) -> DataFrame:
    """The column normalised in at most ``passes`` passes, with ``status`` (ok, fixed, warning), ``issues`` and ``changed``. A pass that changes nothing is the last."""
    df = df.withColumn(col, text(F.col(col))).withColumn("_before", F.col(col)).withColumn("_moved", F.lit(True))
    for _ in range(passes):
        df = df.withColumn("_next", F.when(F.col("_moved"), normalize_once(F.col(col))).otherwise(F.col(col)))
        df = df.withColumn("_moved", F.col("_next") != F.col(col)).withColumn(col, F.col("_next"))
    df = df.drop("_next", "_moved")
    df = df.withColumn("issues", math_issues(F.col(col))).withColumn("changed", F.col(col) != F.col("_before"))
    return df.withColumn("status", F.when(F.size("issues") > 0, "warning").when(F.col("changed"), "fixed").otherwise("ok")).drop("_before")


def math_report(fields: DataFrame) -> DataFrame:
    """(doc_id, questions, changed, fixed, warnings, warned_ids) over fields (doc_id, question_id, status, changed); a question counts once."""
    q = fields.groupBy("doc_id", "question_id").agg(F.bool_or("changed").alias("changed"), F.bool_or(F.col("status") == "fixed").alias("fixed"), F.bool_or(F.col("status") == "warning").alias("warning"))
    return q.groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if("changed").alias("changed"), F.count_if("fixed").alias("fixed"), F.count_if("warning").alias("warnings"), F.sort_array(F.collect_list(F.when(F.col("warning"), F.col("question_id")))).alias("warned_ids"))


def severe_latex(c: Column) -> Column:
    """Codes of badly damaged formulas. Each test runs only where its mark stands."""
    c = text(c)
    dollar, slash, brace = c.contains("$"), c.contains("\\"), c.contains("{") | c.contains("}")
    display = F.regexp_extract_all(c, F.lit(r"(?s)(?<!\\)\$\$(.*?)(?<!\\)\$\$"), F.lit(1))
    braces = F.split(F.regexp_replace(F.regexp_replace(c, r"(?<=\\)[{}]", ""), r"[^{}]+", ""), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))
    fold = F.aggregate(braces, zero, lambda s, x: F.struct(F.when(s["bad"], s["depth"]).when(x == "{", s["depth"] + 1).when((x == "}") & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"]).alias("depth"), (s["bad"] | ((x == "}") & (s["depth"] == 0))).alias("bad")))
    odd_env = [F.when(slash & (count(c, rf"\\begin\{{{e}\}}") != count(c, rf"\\end\{{{e}\}}")), f"environment-{e}") for e in ENVIRONMENTS]
    left, right = count(c, r"\\left(?:\b|[.({\[\|\\])"), count(c, r"\\right(?:\b|[.})\]\|\\])")
    codes = F.array(
        F.when(c.contains("$$$$"), "four-dollars"), F.when(c.contains("$$") & (count(c, r"(?<!\\)\$\$") % 2 == 1), "odd-display"), F.when(slash & dollar & c.rlike(r"\\frac\s*(?<!\\)\$"), "frac-dollar"),
        F.when(c.contains("$$") & F.exists(display, lambda d: d.rlike(r"(?<!\\)\$(?!\$)")), "nested-dollar"), F.when(dollar & c.rlike(OPERATOR_CUT), "cut-operator"), *odd_env,
        F.when(slash & (left != right), "left-right"), F.when(brace & fold["bad"], "right-brace"), F.when(brace & (fold["depth"] > 0), "left-brace"),
    )
    return F.when(dollar | slash | brace, F.array_compact(codes)).otherwise(F.array().cast("array<string>"))


def repair_delimiters(c: Column) -> Column:
    """Single $ out of display formulas, formulas cut at an operator joined (4 rounds), display formulas on lines of their own."""
    plain = text(c)
    c = F.array_join(F.transform(tokens(text(c)), lambda p: F.when(p["mark"] == "$$", F.concat(p["mark"], F.regexp_replace(p["body"], r"(?<!\\)\$", ""), p["mark"])).otherwise(F.concat(p["mark"], p["body"], p["mark"]))), "")
    for _ in range(4):
        c = F.regexp_replace(c, OPERATOR_CUT, r"\$$1$2$3\$")
    c = F.regexp_replace(c, r"(?s)(?U)\s*(?<!\\)\$\$\s*(.*?)\s*(?<!\\)\$\$[ \t]*(?:\n\s*)?", "\n\n\\$\\$\n$1\n\\$\\$\n\n")
    return strip(F.when(plain.contains("$"), c).otherwise(plain))


def render_check(c: Column) -> Column:
    """Severe issues, and display delimiters without a line break at their inner side or text glued to them."""
    return F.concat(severe_latex(c), _display_issues(c))


def _display_issues(c: Column) -> Column:
    t = text(c)
    issues = F.array(F.when(t.rlike(r"(?U)(?<!\\)\$\$\S"), "display-start"), F.when(t.rlike(r"(?U)\S(?<!\\)\$\$"), "display-end"))
    return F.when(t.contains("$$"), F.array_compact(issues)).otherwise(F.array().cast("array<string>"))


def compare_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text(c), P.IMAGE_REF, ""), r"(?U)\s+", ""))


def question_key(c: Column) -> Column:
    """compare_key of a question without its number."""
    return compare_key(strip(F.regexp_replace(c, P.LEADING_NUMBER, "")))


def _first_alike(pairs: list[dict], ratio_at: float) -> int | None:
    """The place of the first pair (at, a, b) whose Ratcliff/Obershelp ratio is high enough; upper bounds of the ratio come first."""
    for p in pairs:
        a, b = p["a"], p["b"]
        m = None if a == b else difflib.SequenceMatcher(None, a, b)
        if m is None or m.real_quick_ratio() >= ratio_at and m.quick_ratio() >= ratio_at and m.ratio() >= ratio_at:
            return p["at"]
    return None


def with_suffix_place(df: DataFrame, c: Column, least: int = 80, ratio_at: float = 0.86) -> DataFrame:
    """``df`` with ``_again``, where a text begins again: at a line equal to its opening one (number aside), behind 80 characters and a quarter of it, if what follows resembles what precedes; null if nowhere.

    Lines and keys are compared here; only texts with such a line meet Python, for the ratio.
    """
    low = F.greatest(F.lit(least), F.floor(F.length(c) * 0.25))

    def again(lines):
        facts = F.struct(question_key(F.get(lines, F.lit(0))["match"]).alias("k"), low.alias("low"))
        return let(facts, lambda f: F.filter(lines, lambda x, i: (i > 0) & (F.length(f["k"]) >= 12) & (x["start"] >= f["low"]) & (question_key(x["match"]) == f["k"])))

    def pair(x):
        keys = F.struct(question_key(F.substring(c, F.lit(1), x["start"])).alias("a"), question_key(F.substring(c, x["start"] + 1, F.length(c))).alias("b"))
        return let(keys, lambda k: F.struct(x["start"].alias("at"), k["a"].alias("a"), k["b"].alias("b")))

    found = F.filter(F.transform(let(find_all(c, OPENING), again), pair), lambda p: (F.length(p["b"]) >= least) & (F.length(p["a"]) >= F.length(p["b"]) * 0.75))
    cut = lambda p, side: F.substring(p[side], F.lit(1), F.least(F.length(p["a"]), F.length(p["b"]))).alias(side)
    schema = StructType([*df.schema.fields, StructField("_again", IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(schema) - 1
        for batch in batches:
            again = pa.array([_first_alike(x, ratio_at) if x else None for x in batch.column(n).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), again], names=schema.names)

    return df.select("*", F.transform(found, lambda p: F.struct(p["at"].alias("at"), cut(p, "a"), cut(p, "b"))).alias("_pairs")).mapInArrow(place, schema)


def collapse_repeats(df: DataFrame, col: str, least: int = 80, points: int = 80, rounds: int = 2, ratio_at: float = 0.86) -> DataFrame:
    """A text that holds itself twice is cut to the first copy: at a line where it begins again (with_suffix_place), else in halves at a line break or the middle, equal but for white space, case and images.

    Of up to ``points`` splits nearest to the middle the nearest that fits counts; two rounds, the second for texts that the first cut. Texts of fewer than ``least`` characters but for white space and images stay.
    """
    df = df.withColumn(col, strip(F.regexp_replace(text(F.col(col)), r"\r\n?", "\n"))).withColumn("_moved", F.lit(True))
    for _ in range(rounds):
        df = df.withColumn("_key", F.when(F.col("_moved"), compare_key(F.col(col))).otherwise(""))
        n = F.floor(F.length("_key") / 2).cast("int")
        twice = (F.substring(F.col("_key"), F.lit(1), n) == F.substring(F.col("_key"), n + 1, F.length("_key"))) | F.col(col).contains("![") | F.col(col).contains("Σ")  # else no split can fit
        odd = F.col(col).contains("![") | F.col(col).contains("Σ")  # keys of parts need not be parts of the key
        held = lambda k: (F.length(k) >= 12) & (F.length("_key") - F.length(F.replace("_key", k)) >= 2 * F.length(k))
        opening = question_key(F.regexp_extract(F.col(col), OPENING, 0))  # no line can equal it unless its key stands twice
        df = df.withColumn("_long", F.length("_key") >= least).withColumn("_twice", twice).withColumn("_held", F.col("_long") & (odd | let(opening, held))).drop("_key")
        df = with_suffix_place(df, F.when(F.col("_held"), F.col(col)).otherwise(""), least, ratio_at)
        middle = F.floor(F.length(col) / 2).cast("int")
        breaks = F.transform(find_all(F.col(col), r"\n{1,3}"), lambda m: m["end"])
        near = F.slice(F.array_sort(F.transform(F.filter(F.array_distinct(F.concat(F.array(middle), breaks)), lambda p: (p > 0) & (p < F.length(col))), lambda p: F.struct(F.abs(p - middle).alias("d"), p.alias("p")))), 1, points)

        def fits(x):
            a, b = compare_key(F.substring(F.col(col), F.lit(1), x["p"])), compare_key(F.substring(F.col(col), x["p"] + 1, F.length(col)))
            return (F.length(a) >= least) & (a == b)

        halves = F.when(F.col("_long") & F.col("_twice") & F.col("_again").isNull(), F.coalesce(*[F.get(F.filter(F.slice(near, at, n), fits), F.lit(0))["p"] for at, n in ((1, 4), (5, points))]))  # mostly one of the nearest fits
        df = df.withColumn("_cut", F.coalesce("_again", halves)).withColumn("_moved", F.col("_cut").isNotNull())
        df = df.withColumn(col, F.when(F.col("_moved"), strip(F.substring(F.col(col), F.lit(1), F.col("_cut")))).otherwise(F.col(col))).drop("_cut", "_again", "_long", "_twice", "_held")
    return df.drop("_moved")


def repeated_suffix(rows: DataFrame, ratio_at: float = 0.86) -> DataFrame:
    """(id, kept): texts (id, text) cut where they begin again."""
    out = with_suffix_place(rows.select("id", text(F.col("text")).alias("text")), F.col("text"), ratio_at=ratio_at)
    return out.select("id", F.when(F.col("_again").isNotNull(), strip(F.substring("text", F.lit(1), F.col("_again")))).otherwise(F.col("text")).alias("kept"))


def strip_solutions(stem: Column, answer: Column, analysis: Column) -> Column:
    """The stem without its solution block, answer lines and an answer at its end, where an answer or analysis is known; the stem if nothing is left."""
    t = text(stem)
    block = r"(?imU)(^|\n)\s*(?:[-*+]\s*)?(?:[【\[]\s*)?(答案解析|参考答案|答案|解析|解答|详解|解)\s*(?:[】\]]|[:：])"
    at = F.regexp_instr(t, F.lit(block))
    head = strip(F.substring(t, F.lit(1), at - 1))
    cut = F.when((at > 0) & (head != ""), head).otherwise(t)
    cut = F.regexp_replace(cut, r"(?imU)^\s*(?:[-*+]\s*)?(?:故)?答案(?:是|为)?\s*[:：]?.*$", "")
    core = F.regexp_replace(text(answer), r"(?U)^[\s$]+|[\s$]+$", "")
    tail = F.concat(F.lit(r"(?U)((?:的\s*)?(?:长|长度|值|结果|答案)?\s*(?:是|为|等于)\s*[:：]?)\s*\$?\s*\Q"), core, F.lit(r"\E\s*\$?\s*([。．.,，；;\s]*)$"))
    cut = F.when((core != "") & ~core.contains("\\E"), F.regexp_replace(cut, tail, F.lit("$1（ ）$2"))).otherwise(cut)
    cut = strip(F.regexp_replace(F.regexp_replace(cut, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    known = given(answer) | given(analysis)
    return F.when(known & (cut != ""), cut).otherwise(t)


def plain_text(c: Column) -> Column:
    """Markdown and LaTeX as plain text: fractions, roots, powers and symbols written out, marks and images dropped, one line a line."""
    c = F.regexp_replace(text(c), r"(?m)^.*!\[[^\]]*\]\([^)]+\).*$\n?", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\begin\{tasks\}(?:\([^)]+\))?", ""), r"\\end\{tasks\}", ""), r"\\task\s*", "• ")
    for _ in range(4):
        c = F.regexp_replace(c, r"(?U)\\frac\s*\{\s*([\w+\-π∞]+)\s*\}\s*\{\s*([\w+\-π∞]+)\s*\}", "$1/$2")
        c = F.regexp_replace(c, r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "($1)/($2)")
        c = F.regexp_replace(F.regexp_replace(c, r"\\sqrt\s*\[([^\]\[]+)\]\s*\{([^{}]+)\}", "$1√$2"), r"\\sqrt\s*\{([^{}]+)\}", "√$1")
        c = F.regexp_replace(c, r"([\^_])\{([^{}]+)\}", "$1$2")
    c = F.regexp_replace(F.regexp_replace(c, r"\\(?:left|right|displaystyle|textstyle)\s*", ""), r"\\\\", "；")
    for name, symbol in SYMBOLS:
        c = F.regexp_replace(c, rf"\\{name}(?![a-zA-Z])", symbol)
    c = F.regexp_replace(F.regexp_replace(c, r"\\(?:text|mathrm|mathbf)\s*\{([^{}]*)\}", "$1"), r"\\[a-zA-Z]+|[${}`]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\*\*([^*]+)\*\*", "$1"), r"__([^_]+)__", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^\s{0,3}(?:#{1,6}\s*|>\s?)", ""), r"(?m)^[ \t]*[-*+]\s+", "")
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != ""), "\n")


def image_labels(images: Column) -> Column:
    """Images (array<struct<url, path, label>>) first of each url or path, labels as 图N: the number given, else the next free one upwards."""
    kind = "array<struct<url:string,path:string,label:string>>"
    key = lambda x: F.when(given(x["url"]), x["url"]).otherwise(F.coalesce(x["path"], F.lit("")))
    number = lambda x: F.nullif(F.regexp_extract(F.trim(text(x["label"])), r"(?i)^(?:题图|图|#)?\s*([1-9]\d*)$", 1), F.lit("")).cast("int")
    zero = F.struct(F.lit(0).alias("top"), F.array().cast(kind).alias("out"))

    def step(s, x):
        n = F.coalesce(number(x), s["top"] + 1)
        new = F.struct(F.greatest(s["top"], n).alias("top"), F.concat(s["out"], F.array(F.struct(x["url"].alias("url"), x["path"].alias("path"), F.concat(F.lit("图"), n.cast("string")).alias("label")))).alias("out"))
        return F.when((key(x) == "") | F.exists(s["out"], lambda o: key(o) == key(x)), s).otherwise(new)

    return F.aggregate(images, zero, step, lambda s: s["out"])


def image_context_filter(images: Column, stem: Column, kind: Column) -> Column:
    """For choice questions with images that the stem doesn't refer to: those it refers to, else all if it speaks of a figure, else none."""
    used = F.filter(images, lambda x: F.contains(text(stem), F.concat(F.lit("]("), x["label"], F.lit(")"))))
    none = F.filter(images, lambda x: F.lit(False))
    return F.when((kind != "choice") | (F.size(used) == F.size(images)), images).when(F.size(used) > 0, used).when(text(stem).rlike(P.IMAGE_CUE), images).otherwise(none)


def attach_option_images(options: Column, images: Column, stem: Column) -> Column:
    """Options with the trailing images of a question in order, if there are as many and the stem speaks of figures."""
    zipped = F.zip_with(options, F.slice(images, F.greatest(F.size(images) - F.size(options) + 1, F.lit(1)), F.greatest(F.size(options), F.lit(0))), lambda o, i: F.concat_ws(" ", o, F.concat(F.lit("!["), i["label"], F.lit("]("), F.coalesce(i["url"], i["path"]), F.lit(")"))))
    return F.when((F.size(options) >= 2) & (F.size(images) >= F.size(options)) & text(stem).rlike(P.IMAGE_CUE), zipped).otherwise(options)


def risk_reasons(df: DataFrame) -> DataFrame:
    """``reasons`` of questions (stem, type, options array, images array<struct<label>>, math_warnings): what speaks against automatic use."""
    refs = F.regexp_extract_all(text(F.col("stem")), F.lit(P.IMAGE_REF), F.lit(1))
    half = collapse_repeats(df.withColumn("_t", F.col("stem")), "_t", rounds=1).withColumn("_severe", F.size(severe_latex(F.col("stem"))))
    reasons = F.array_compact(F.array(
        F.when(F.col("_severe") > 0, "severe-latex"), F.when((F.col("_severe") > 0) | (F.size(_display_issues(F.col("stem"))) > 0), "render-risk"), F.when(F.length("_t") < F.length(strip(text(F.col("stem")))), "duplicate-markdown"),
        F.when((F.col("type") == "choice") & (F.size("options") < 4), "option-count-low"), F.when(F.size(F.array_distinct(refs)) < F.size(refs), "duplicate-image-ref"),
        F.when(F.exists("options", lambda o: o.rlike(r"(?U)[一-鿿）)][B-H][.．、]")), "option-glued"), F.when(F.coalesce("math_warnings", F.lit(0)) > 0, "math-warning"),
    ))
    return half.withColumn("reasons", reasons).drop("_t", "_severe")


def candidate_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question_id, errors): why an edited version is refused: more severe issues, it doesn't render, options, required image labels or sub-questions dropped, unknown labels.

    Rows: question_id, stem, options (array), labels (known image labels), children.
    """
    b = before.select("question_id", *[F.col(c).alias(f"b_{c}") for c in ("stem", "options", "labels", "children")])
    j = after.join(b, "question_id").withColumn("_severe", F.size(severe_latex(F.col("stem"))))
    refs = lambda c: F.array_distinct(F.regexp_extract_all(text(F.col(c)), F.lit(P.IMAGE_REF), F.lit(1)))
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    required = F.array_intersect(refs("b_stem"), "b_labels")
    errors = F.array_compact(F.array(
        F.when((F.col("_severe") > 0) & (F.col("_severe") > F.size(severe_latex(F.col("b_stem")))), "severe-issues-increased"), F.when((F.col("_severe") > 0) | (F.size(_display_issues(F.col("stem"))) > 0), "render-invalid"), F.when(size("options") < size("b_options"), "dropped-options"),
        F.when(F.size(F.array_except(required, refs("stem"))) > 0, "dropped-images"), F.when(F.size(F.array_except(refs("stem"), "b_labels")) > 0, "unknown-images"), F.when((F.col("b_children") > 0) & (F.col("children") == 0), "dropped-subquestions"),
    ))
    return j.select("question_id", errors.alias("errors"))


def rule_standardize(df: DataFrame, col: str = "stem") -> DataFrame:
    """The rules path: repaired, collapsed and normalised text unless that adds severe issues; ``path`` rules or fallback, ``recommendation`` safe_to_apply or review_required."""
    out = df.withColumn("_in", text(F.col(col))).withColumn(col, repair_delimiters(F.col(col)))
    out = collapse_repeats(out, col).withColumn("_mid", F.col(col))
    out = normalize_math(out, col)
    out = out.withColumn("_worse", F.size(severe_latex(F.col(col))) > F.size(severe_latex(F.col("_mid"))))
    out = out.withColumn(col, F.when(F.col("_worse"), F.col("_mid")).otherwise(F.col(col))).withColumn("path", F.when(F.col("_worse"), "fallback").otherwise("rules"))
    return out.withColumn("recommendation", F.when((F.size(render_check(F.col(col))) == 0) & (F.col("status") != "warning"), "safe_to_apply").otherwise("review_required")).drop("_in", "_mid", "_worse")


def choice_block(stem: Column, options: Column) -> Column:
    """The stem with a tasks block of its options (4 columns for short ones, else 2) where there are two or more and no block yet."""
    short = F.forall(options, lambda o: F.length(o) <= 12)
    block = F.concat(F.lit("\n\n\\begin{tasks}("), F.when(short, "4").otherwise("2"), F.lit(")\n"), F.array_join(F.transform(options, lambda o: F.concat(F.lit("\\task "), o)), "\n"), F.lit("\n\\end{tasks}"))
    return F.when((F.size(options) >= 2) & ~text(stem).contains("\\begin{tasks}"), F.concat(strip(text(stem)), block)).otherwise(text(stem))


def conserve_image_refs(stem: Column, images: Column) -> Column:
    """References to a question's images rewritten to their labels; those that it lacks are added before the tasks block or at the end."""
    swapped = F.aggregate(images, text(stem), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"\]\(\s*<?\Q"), F.coalesce(x["url"], x["path"], F.lit("")), F.lit(r"\E>?\s*\)")), F.concat(F.lit("]("), x["label"], F.lit(")"))))
    lacking = F.filter(images, lambda x: ~F.contains(swapped, F.concat(F.lit("]("), x["label"], F.lit(")"))))
    added = F.array_join(F.transform(lacking, lambda x: F.concat(F.lit("!["), x["label"], F.lit("]("), x["label"], F.lit(")"))), "\n")
    at = F.instr(swapped, "\\begin{tasks}")
    placed = F.when(at > 0, F.concat(strip(F.substring(swapped, F.lit(1), at - 1)), F.lit("\n"), added, F.lit("\n\n"), F.substring(swapped, at, F.length(swapped)))).otherwise(F.concat(strip(swapped), F.lit("\n"), added))
    return F.when(F.size(lacking) > 0, placed).otherwise(swapped)


def repair_candidates(df: DataFrame) -> DataFrame:
    """Questions that need a semantic repair (an exponent read as a quote) or blanks (a fill-blank question without options or children): column ``need``."""
    semantic = F.array_contains(math_issues(F.col("stem")), "quote-exponent")
    blank = (F.col("type") == "fill_blank") & (F.coalesce(F.size("options"), F.lit(0)) <= 0) & (F.coalesce("children", F.lit(0)) == 0)
    return df.withColumn("need", F.when(semantic, "semantic").when(blank, "blank")).where("need IS NOT NULL")


def apply_blank_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Questions with as many blanks as were detected (question_id, blanks): up to 8 are appended and the type becomes fill_blank."""
    lacking = F.least(F.greatest(F.col("blanks") - count(text(F.col("stem")), BLANK), F.lit(0)), F.lit(8))
    j = df.join(counts.select("question_id", "blanks"), "question_id", "left").withColumn("_n", F.coalesce(lacking, F.lit(0)))
    return j.withColumn("stem", F.when(F.col("_n") > 0, F.concat(text(F.col("stem")), F.repeat(F.lit(" ____"), F.col("_n").cast("int")))).otherwise(F.col("stem"))).withColumn("type", F.when(F.col("_n") > 0, "fill_blank").otherwise(F.col("type"))).drop("_n", "blanks")


def prefer_second_text(primary: Column, secondary: Column, error: str = "(?i)error|traceback|失败", limit: int = 6000) -> Column:
    """The second reading of a text (cut to ``limit``) if it is long enough, has the same number, and is over 20 characters longer or has more blanks."""
    a, b = strip(text(primary)), F.substring(strip(text(secondary)), 1, limit)
    number = lambda c: F.regexp_extract(c, P.QUESTION_NUMBER, 1)
    better = (F.length(b) > F.length(a) + 20) | (count(b, BLANK) > count(a, BLANK))
    return F.when((F.length(b) >= F.greatest(F.lit(20), F.length(a) * 0.8)) & (number(a) == number(b)) & better & ~b.rlike(error), b).otherwise(text(primary))


def restore_blanks(c: Column) -> Column:
    """Blank marks of all shapes as four underscores, empty or quoted brackets as a blank in brackets, blanks behind a trailing 是 or 为."""
    c = F.regexp_replace(text(c), "[＿_]{2,}", "____")
    c = F.regexp_replace(c, r"(?U)\(\s*(?:\\_+|_+|＿+|\$|[\"“”'])\s*\)", "(____)")
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.when(~x.rlike(BLANK) & x.rlike(r"(?U)(算术平方根是|平方根是|取值范围是|实数.*?值是|值为|值是|为|是)\s*$"), F.concat(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit("____"))).when(~x.rlike(BLANK) & x.rlike(r"(?U)=\s*$"), F.concat(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit("____"))).otherwise(x))
    return F.array_join(lines, "\n")

"""The hygiene rules in plain Python, one text at a time, against the queries over whole documents and the columns over random fragments."""

import difflib
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import patterns as P
from sparkfolio.operators import hygiene as H
from sparkfolio.plans import hygiene_queries as Q

SF = "/root/testdata/sf0.001"


def py(pattern):
    return re.sub(r"\(\?([a-z]*)[dU]+\)", lambda m: f"(?{m[1].replace('d', '')})" if m[1].replace("d", "") else "", pattern)


def sub(pattern, new, t):
    return re.sub(py(pattern), new, t)


def has(pattern, t):
    return re.search(py(pattern), t) is not None


def count(pattern, t):
    return len(re.findall(py(pattern), t))


def tokens(t):
    out = []
    for m in re.finditer(H.MATH_TOKEN, t):
        x = m[0]
        mark = "$$" if len(x) >= 4 and x.startswith("$$") and x.endswith("$$") else "$" if len(x) >= 2 and x[0] == "$" and not x.startswith("$$") and x[-1] == "$" else ""
        out.append((mark, x[len(mark) : len(x) - len(mark)]))
    return out


def balanced(t, left, right):
    depth = 0
    for c in t:
        depth += (c == left) - (c == right)
        if depth < 0:
            return False
    return depth == 0


def math_issues(t):
    parts = tokens(t)
    tests = (
        ("glued-dollars", has(H.GLUED, t)), ("quote-exponent", has(H.QUOTE_EXPONENT, t)), ("odd-dollars", count(H.SINGLE_DOLLAR, t) % 2), ("unbalanced-braces", any(m and not balanced(b, "{", "}") for m, b in parts)),
        ("unbalanced-brackets", any(m and not balanced(b, "[", "]") for m, b in parts)), ("naked-command", any(not m and has(H.MATH_COMMAND, b) for m, b in parts)),
    )
    return [name for name, test in tests if test]


def tidy(t):
    t = t.strip()
    for pattern, new in H.TIDY:
        t = sub(pattern, new.replace("$1", r"\1"), t)
    return t


def once(t):
    t = sub(r"(?<!\$)\$\$(?=\\[A-Za-z])", "$ $", sub(H.GLUED, "$ $", t))
    t = "".join(m + b + m if m else sub(H.NAKED_COMMAND, r"$\1$", b) for m, b in tokens(t))
    t = "".join(m + tidy(b) + m if m else b for m, b in tokens(t))
    return t + "$" * (count(H.SINGLE_DOLLAR, t) % 2)


def normalize(t):
    before = t
    for _ in range(4):
        now = once(t)
        if now == t:
            break
        t = now
    issues = math_issues(t)
    return t, "warning" if issues else "fixed" if t != before else "ok", issues


def severe(t):
    if not t.strip():
        return []
    out = ["four-dollars"] * has(r"\${4,}", t) + ["odd-display"] * (count(r"(?<!\\)\$\$", t) % 2) + ["frac-dollar"] * has(r"\\frac\s*(?<!\\)\$", t)
    out += ["nested-dollar"] * any(has(r"(?<!\\)\$(?!\$)", d) for d in re.findall(r"(?s)(?<!\\)\$\$(.*?)(?<!\\)\$\$", t)) + ["cut-operator"] * has(H.OPERATOR_CUT, t)
    out += [f"environment-{e}" for e in H.ENVIRONMENTS if t.count(f"\\begin{{{e}}}") != t.count(f"\\end{{{e}}}")]
    out += ["left-right"] * (count(r"\\left(?:\b|[.({\[\|\\])", t) != count(r"\\right(?:\b|[.})\]\|\\])", t))
    depth, bad = 0, False
    for at, c in enumerate(t):
        if c in "{}" and t[at - 1 : at] != "\\" and not bad:
            bad = c == "}" and depth == 0
            depth += 0 if bad else 1 if c == "{" else -1
    return out + ["right-brace"] * bad + ["left-brace"] * (depth > 0)


def render(t):
    return severe(t) + ["display-start"] * has(r"(?<!\\)\$\$\S", t) + ["display-end"] * has(r"\S(?<!\\)\$\$", t)


def repair(t):
    t = "".join(m + (re.sub(r"(?<!\\)\$", "", b) if m == "$$" else b) + m for m, b in tokens(t))
    for _ in range(4):
        t = sub(H.OPERATOR_CUT, r"$\1\2\3$", t)
    return re.sub(r"(?s)\s*(?<!\\)\$\$\s*(.*?)\s*(?<!\\)\$\$[ \t]*(?:\n\s*)?", "\n\n$$\n\\1\n$$\n\n", t).strip()


def compare(t):
    return re.sub(r"\s+", "", sub(P.IMAGE_REF, "", t)).lower()


def question(t):
    return compare(sub(P.LEADING_NUMBER, "", t).strip())


def begins_again(t):
    lines = list(re.finditer(r"(?m)^[ \t]*(\S[^\n]*)", t))
    if len(lines) < 2 or len(question(lines[0][1])) < 12:
        return None
    for m in lines[1:]:
        if m.start() < max(80, int(len(t) * 0.25)) or question(m[1]) != question(lines[0][1]):
            continue
        a, b = question(t[: m.start()].strip()), question(t[m.start() :].strip())
        if len(b) >= 80 and len(a) >= len(b) * 0.75:
            n = min(len(a), len(b))
            if a[:n] == b[:n] or difflib.SequenceMatcher(None, a[:n], b[:n]).ratio() >= 0.86:
                return m.start()
    return None


def collapse(t, rounds=2):
    for _ in range(rounds):
        t = re.sub(r"\r\n?", "\n", t).strip()
        if len(compare(t)) < 80:
            break
        at = begins_again(t)
        if at is None:
            middle = len(t) // 2
            points = sorted({middle, *(m.end() for m in re.finditer(r"\n{1,3}", t))}, key=lambda p: (abs(p - middle), p))
            fits = (p for p in [p for p in points if 0 < p < len(t)][:80] if len(compare(t[:p])) >= 80 and compare(t[:p]) == compare(t[p:]))
            at = next(fits, None)
        if at is None:
            break
        t = t[:at].strip()
    return t


def strip_solutions(t, answer, analysis):
    cut = t
    m = re.search(r"(?im)(^|\n)\s*(?:[-*+]\s*)?(?:[【\[]\s*)?(答案解析|参考答案|答案|解析|解答|详解|解)\s*(?:[】\]]|[:：])", t)
    if m and t[: m.start()].strip():
        cut = t[: m.start()].strip()
    cut = re.sub(r"(?im)^\s*(?:[-*+]\s*)?(?:故)?答案(?:是|为)?\s*[:：]?.*$", "", cut)
    core = re.sub(r"^[\s$]+|[\s$]+$", "", answer)
    if core:
        cut = re.sub(r"((?:的\s*)?(?:长|长度|值|结果|答案)?\s*(?:是|为|等于)\s*[:：]?)\s*\$?\s*" + re.escape(core) + r"\s*\$?\s*([。．.,，；;\s]*)$", r"\1（ ）\2", cut)
    cut = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", cut)).strip()
    return cut if (answer.strip() or analysis.strip()) and cut else t


def plain(t):
    t = re.sub(r"(?m)^.*!\[[^\]]*\]\([^)]+\).*$\n?", "", t)
    t = re.sub(r"\\task\s*", "• ", re.sub(r"\\end\{tasks\}", "", re.sub(r"\\begin\{tasks\}(?:\([^)]+\))?", "", t)))
    for _ in range(4):
        t = re.sub(r"\\frac\s*\{\s*([\w+\-π∞]+)\s*\}\s*\{\s*([\w+\-π∞]+)\s*\}", r"\1/\2", t)
        t = re.sub(r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"(\1)/(\2)", t)
        t = re.sub(r"\\sqrt\s*\{([^{}]+)\}", r"√\1", re.sub(r"\\sqrt\s*\[([^\]\[]+)\]\s*\{([^{}]+)\}", r"\1√\2", t))
        t = re.sub(r"([\^_])\{([^{}]+)\}", r"\1\2", t)
    t = re.sub(r"\\\\", "；", re.sub(r"\\(?:left|right|displaystyle|textstyle)\s*", "", t))
    for name, symbol in H.SYMBOLS:
        t = re.sub(rf"\\{name}(?![a-zA-Z])", symbol, t)
    t = re.sub(r"\\[a-zA-Z]+|[${}`]", "", re.sub(r"\\(?:text|mathrm|mathbf)\s*\{([^{}]*)\}", r"\1", t))
    t = re.sub(r"__([^_]+)__", r"\1", re.sub(r"\*\*([^*]+)\*\*", r"\1", t))
    t = re.sub(r"(?m)^[ \t]*[-*+]\s+", "", re.sub(r"(?m)^\s{0,3}(?:#{1,6}\s*|>\s?)", "", t))
    return "\n".join(x for line in t.split("\n") if (x := re.sub("[ \t]+", " ", line).strip()))


def standardize(t):
    middle = collapse(repair(t))
    new, status, _ = normalize(middle)
    worse = len(severe(new)) > len(severe(middle))
    new = middle if worse else new
    return new, "fallback" if worse else "rules", status, "safe_to_apply" if not render(new) and status != "warning" else "review_required"


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: (r.text or "") for r in rows}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def ended(docs):
    return {i: t + Q.ENDINGS[i % 8] for i, t in docs.items()}


def test_issue_queries_over_whole_texts(spark, docs):
    texts = ended(docs)
    assert rows(Q.math_issues(spark, SF), "doc_id", "issues") == sorted((i, ",".join(math_issues(t))) for i, t in texts.items())
    assert rows(Q.severe_latex(spark, SF), "doc_id", "codes") == sorted((i, ",".join(severe(t))) for i, t in texts.items())
    assert rows(Q.render_check(spark, SF), "doc_id", "codes") == sorted((i, ",".join(render(t))) for i, t in texts.items())
    want = {i: "semantic" if "quote-exponent" in math_issues(t) else "blank" if i % 2 == 0 else None for i, t in texts.items()}
    assert rows(Q.repair_candidates(spark, SF), "doc_id", "need") == sorted((i, n) for i, n in want.items() if n)


def test_rewriting_queries_over_whole_texts(spark, docs):
    texts = ended(docs)
    normal = {i: normalize(t) for i, t in texts.items()}
    assert rows(Q.normalize_math(spark, SF), "doc_id", "md5", "status", "changed") == sorted((i, md5(n), s, n != texts[i]) for i, (n, s, _) in normal.items())
    report = {}
    for i, (n, s, _) in normal.items():
        r = report.setdefault(i % 40, [0, 0, 0, 0])
        for k, test in enumerate((True, n != texts[i], s == "fixed", s == "warning")):
            r[k] += test
    assert rows(Q.math_report(spark, SF), "doc", "questions", "changed", "fixed", "warnings") == sorted((d, *r) for d, r in report.items())
    assert rows(Q.repair_delimiters(spark, SF), "doc_id", "md5", "codes") == sorted((i, md5(repair(t)), ",".join(severe(repair(t)))) for i, t in texts.items())
    ruled = {i: standardize(t) for i, t in texts.items()}
    assert rows(Q.rule_standardize(spark, SF), "doc_id", "md5", "path", "status", "recommendation") == sorted((i, md5(r[0]), *r[1:]) for i, r in ruled.items())


def test_gates_over_whole_texts(spark, docs):
    texts = ended(docs)
    refs = lambda t: re.findall(py(P.IMAGE_REF), t)
    risks = {}
    for i, t in texts.items():
        found = refs(t)
        tests = (("severe-latex", severe(t)), ("render-risk", render(t)), ("duplicate-markdown", len(collapse(t, 1)) < len(t.strip())), ("option-count-low", True), ("duplicate-image-ref", len(set(found)) < len(found)), ("math-warning", i % 8 == 3))
        risks[i] = ",".join(name for name, test in tests if test)
    assert rows(Q.risk_reasons(spark, SF), "doc_id", "reasons") == sorted(risks.items())
    errors = {}
    for i, t in texts.items():
        t += " ![](图9)" if i % 8 == 3 else ""
        tests = (("severe-issues-increased", len(severe(t)) > 0), ("render-invalid", render(t)), ("dropped-options", True), ("unknown-images", set(refs(t)) - {"图1"}))
        errors[i] = ",".join(name for name, test in tests if test)
    assert rows(Q.candidate_gate(spark, SF), "question_id", "errors") == sorted(errors.items())


def test_repeats_solutions_and_plain_text_over_whole_texts(spark, docs):
    twice = {}
    for i, t in docs.items():
        again = t.upper().replace(" ", "  ")
        numbered = f"7. {t}\n{again}"
        twice[i] = (t, f"{t}\n{again}", numbered, f"{numbered}\n\n{numbered}")[i % 4]
    want = sorted((i, len(c), md5(c)) for i, t in twice.items() for c in [collapse(t)])
    assert rows(Q.collapse_repeats(spark, SF), "doc_id", "n_chars", "md5") == want
    assert sum(n < len(twice[i]) for i, n, _ in want) > len(want) / 2
    stems = {i: t + ("x\n【答案】 5\n解析：why", "x\n故答案为：5", "，长为 $5$。")[i % 3] for i, t in docs.items()}
    assert rows(Q.strip_solutions(spark, SF), "doc_id", "stem") == sorted((i, strip_solutions(t, "5", "")) for i, t in stems.items())
    bodies = {i: t + " $\\frac{1}{2}$ $\\sqrt{3}$ $x^{2} \\leq 5$\n![a](b.png)\n\n# **bold**" for i, t in docs.items()}
    assert rows(Q.plain_text(spark, SF), "doc_id", "t") == sorted((i, plain(t)) for i, t in bodies.items())


FRAGMENTS = ["$", "$$", "$", "{", "}", "[", "]", "\\frac", "\\frac{1}{2}", "\\sqrt{x}", "\\left(", "\\right)", "\\begin{cases}", "\\end{cases}", "\\cdot", "+", "=", " ", " ", "\n", "x", "^{2}", "_ {a}", "12 3", "y\"", ",", "中", "**b**", "\\leq", "# h\n", "- i\n", "![a](b.png)", "é", "\\$"]


def test_random_fragments(spark):
    rng = random.Random(11)
    texts = {i: "".join(rng.choices(FRAGMENTS, k=rng.randrange(0, 16))) for i in range(700)}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = df.select("id", H.math_issues(F.col("t")).alias("a"), H.severe_latex(F.col("t")).alias("b"), H.render_check(F.col("t")).alias("c"), H.repair_delimiters(F.col("t")).alias("d"), H.plain_text(F.col("t")).alias("e")).collect()
    for r in got:
        t = texts[r.id]
        assert (r.a, r.b, r.c, r.d, r.e) == (math_issues(t), severe(t), render(t), repair(t), plain(t)), repr(t)
    for r in H.normalize_math(df, "t").collect():
        assert (r.t, r.status, r.issues) == normalize(texts[r.id]), repr(texts[r.id])


def test_a_stem_that_begins_again_is_cut_before_halves_are_tried(spark):
    stem = "已知函数的图象关于原点对称，且在区间上单调递增，求实数的取值范围，并说明理由，写出必要的文字说明、证明过程或演算步骤。" * 2
    texts = {1: f"12. {stem}\n{stem}", 2: f"12. {stem}\n{stem}\n12. {stem}\n{stem}", 3: f"{stem}\n\n{stem}", 4: f"3. {stem}\nx{stem[1:]}", 5: f"3. short\n{stem}\n short\n{stem.replace('实数', '整数')}", 6: None, 7: "", 8: stem}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {r.id: r.t for r in H.collapse_repeats(df, "t").collect()}
    assert got == {i: collapse(t or "") for i, t in texts.items()}
    assert got[1] == got[2] == f"12. {stem}"
    kept = {r.id: r.kept for r in H.repeated_suffix(df.withColumnRenamed("t", "text")).collect()}
    assert kept == {i: (t or "")[: begins_again(t or "")].strip() if begins_again(t or "") else t or "" for i, t in texts.items()}


def test_marks_of_long_texts_in_time(spark):
    """Brackets are kept by runs, not one by one, and a second round works only on texts that the first cut."""
    plan = H.collapse_repeats(spark.createDataFrame([("a",)], "t string"), "t")._jdf.queryExecution().analyzed().toString()
    assert "_moved" in plan and "[^{}]+" in spark.range(1).select(H.severe_latex(F.lit("{a}")))._jdf.queryExecution().analyzed().toString()


def test_guards_change_nothing(spark):
    texts = ["", " ", "plain", "a } b", "{", "\\frac{1", "x $$ y", "$$$$", "\\left( x", "a $$x$ y$$ b", "\\{ \\}", "\\begin{array}", "$a$ + $b$", "$$a", "\\}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", H.severe_latex(F.col("t")).alias("s"), H.render_check(F.col("t")).alias("r"), H.repair_delimiters(F.col("t")).alias("d")).collect()
    got = {texts[r.id]: list(r.s) for r in rows}
    assert got["plain"] == got[" "] == got[""] == got["\\{ \\}"] == [] and got["a } b"] == ["right-brace"] and got["{"] == ["left-brace"]
    assert got["\\begin{array}"] == ["environment-array"] and got["\\left( x"] == ["left-right"] and "odd-display" in got["x $$ y"] and "four-dollars" in got["$$$$"]
    assert got["a $$x$ y$$ b"] == ["nested-dollar"] and got["$a$ + $b$"] == ["cut-operator"] and got["\\}"] == []


def test_begins_again_behind_images_and_second_cut(spark):
    """An image in the opening line hides it from the whole text's key; a text of four copies is cut twice."""
    body = "".join(f"word{i} " for i in range(30))
    line = "7. ![a\nb](c.png) opening line of the stem\n"
    texts = [line + body + "\n" + line + body, "\n".join([body] * 4), f"1. Opening of the stem\n{body}\n2. opening OF the stem\n{body}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.t for r in H.collapse_repeats(df, "t").collect()}
    assert got[1] == body.strip() and got[2] == f"1. Opening of the stem\n{body}".strip() and got[0] == (line + body).strip()

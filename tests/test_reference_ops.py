"""Behaviours of the reference operators on small hand-made tables: every threshold on both sides."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions.text import find_all
from sparkfolio.operators import bank, canon, hygiene, jobs, layout, segment
from sparkfolio.sources import corpus


def run_paper(spark, markdown):
    docs = spark.createDataFrame([(1, markdown)], "doc_id long, markdown string")
    lines = segment.classify_headings(segment.index_lines(docs))
    contract = segment.structure_contract(lines)
    accepted = segment.accept_anchors(segment.anchor_candidates(lines), contract)
    spans = segment.question_spans(accepted, lines, docs)
    return docs, contract, spans


def test_find_all_positions(spark):
    row = spark.createDataFrame([("ab12cd3é45",)], "t string").select(find_all(F.col("t"), r"\d+").alias("m")).first()
    assert [(m.start, m.end, m.match) for m in row.m] == [(2, 4, "12"), (6, 7, "3"), (8, 10, "45")]


@pytest.mark.parametrize("text", [None, "", "x", "7", "7é日8", "ab12 x" * 3000 + "end", "1" + "a1" * 100_000])
def test_find_all_equals_finditer(spark, text):
    """A hundred thousand matches take seconds."""
    row = spark.createDataFrame([(text,)], "t string").select(find_all(F.col("t"), r"\d+").alias("m")).first()
    assert [(m.start, m.end, m.match) for m in row.m or []] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9]+", text or "")]


def test_match_image_paths_equals_pairs(spark):
    rng = random.Random(7)
    path = lambda: "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) + rng.choice(["", "/", "./", "A/"]) + rng.choice(["1.png", "2.png", "image.png", "?x", ""])
    left, right = [(i, path()) for i in range(120)], [(1000 + i, path()) for i in range(120)]
    norm = lambda p: re.sub(r"^[./]+", "", re.sub(r"[?#].*$", "", p).replace("\\", "/")).lower()
    want = {}
    for i, p in left:
        a = norm(p)
        if a.rsplit("/", 1)[-1]:
            exact = [j for j, q in right if norm(q) == a]
            ends = [j for j, q in right if norm(q) != a and norm(q) and (norm(q).endswith("/" + a) or a.endswith("/" + norm(q)))]
            if len(exact) == 1 or not exact and len(ends) == 1:
                want[i] = (exact or ends)[0]
    frame = lambda rows: spark.createDataFrame(rows, "id long, path string")
    assert {r.left_id: r.right_id for r in layout.match_image_paths(frame(left), frame(right)).collect()} == want and len(want) > 5


def test_repeated_suffix_equals_brute_force(spark):
    """Whole texts: cut before the first later line like the opening one whose rest resembles what precedes."""
    rng = random.Random(3)
    body = lambda n: "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(8)) for _ in range(n))
    texts = {}
    for i in range(12):
        t = body(rng.randrange(3, 40))
        texts[i] = t if i % 3 == 0 else f"7. {t}\n{t}" if i % 3 == 1 else f"{t}\n{t.splitlines()[0]}\n{body(4)}"
    squeeze = lambda x: re.sub(r"\s+", "", x).lower()
    key = lambda x: squeeze(re.sub(r"^\s*(\d{1,3})[.．、]\s*", "", x))
    want = {}
    for i, t in texts.items():
        want[i] = t
        lines = list(re.finditer(r"[^\n]+", t))
        for m in lines[1:]:
            a, b = key(t[: m.start()]), key(t[m.start() :])  # without the question's number, as lines are compared
            n = min(len(a), len(b))
            if key(m[0]) == key(lines[0][0]) and len(key(m[0])) >= 12 and m.start() >= max(80, len(t) // 4) and len(b) >= 80 and len(a) >= 0.75 * len(b) and difflib.SequenceMatcher(None, a[:n], b[:n]).ratio() >= 0.86:
                want[i] = t[: m.start()].strip()
                break
    got = hygiene.repeated_suffix(spark.createDataFrame(list(texts.items()), "id long, text string")).collect()
    assert {r.id: r.kept for r in got} == want and sum(want[i] != t for i, t in texts.items()) >= 2


def test_ratcliff_scores_equal_brute_force(spark):
    rng = random.Random(4)
    stem = lambda: " ".join(rng.choice(["set", "sum", "函数", "root", "value"]) for _ in range(rng.randrange(1, 400)))
    paper = [(1, i, i, i % 5 + 1, "choice", stem(), ["A"], ["图1"]) for i in range(20)]
    answers = [(1, 100 + i, 100 + i, n, t, s[: len(s) // 2] if i % 2 else s, o, g) for (_, i, _, n, t, s, o, g) in paper]
    schema = "doc_id long, question_id long, position long, number long, type string, stem string, options array<string>, images array<string>"
    both = [spark.createDataFrame(x, schema) for x in (paper, answers)]
    exact = {(r.answer_id, r.paper_id): r.score for r in canon.match_scores(*both).collect()}
    assert set(exact) == {(a[1], p[1]) for a in answers for p in paper if a[3] == p[3]}
    same = [exact[100 + i, i] for i in range(0, 20, 2)]
    assert min(same) == max(same) and all(s <= same[0] for s in exact.values())


def test_fallback_names_its_path(spark):
    rows = spark.createDataFrame([(1, "abc $p$ + $q$ odd $"), (2, "plain")], "id long, stem string")
    got = {r.id: (r.stem, r.path) for r in hygiene.rule_standardize(rows).collect()}
    assert got == {1: ("abc $p+q$ odd $", "fallback"), 2: ("plain", "rules")}


def test_pages_after_equal_one_list(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(40)], "id long, at long")
    whole = [(r.id, r.at) for r in rows.orderBy(F.desc("at"), "id").collect()]
    seen, last = [], None
    while page := bank.page_after(rows, [("at", True), ("id", False)], last, 7).collect():
        seen += [(r.id, r.at) for r in page]
        last = page[-1].asDict()
    assert seen == whole


def test_files_written_from_tasks(spark, tmp_path):
    rows = [("j1", "a/x.md", b"one"), ("j1", "b.md", b""), ("j2", "c.md", "日本".encode())]
    assert corpus.write_files(spark.createDataFrame(rows, "job_id string, relative string, content binary").repartition(3), f"file://{tmp_path}/out") == 3
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {f"{j}/{r}": c for j, r, c in rows}
    assert corpus.write_files(spark.createDataFrame([], "job_id string, relative string, content binary"), f"file://{tmp_path}/none") == 0


def test_paper_is_cut_into_questions(spark):
    paper = "1. 考生注意：本试卷共3题\n一、选择题（共2题）\n1. 已知 x=1，则（ ）\nA. 1 B. 2\nC. 3\nD. 4\n2. 下列正确的是 A、甲 B、乙 C、丙 D、丁\n二、解答题（共1题）\n3. 计算 (1) 求 a 的值 （2）求 b 的值\n# 参考答案\n"
    docs, contract, spans = run_paper(spark, paper)
    c = contract.first()
    assert (c.total, c.total_source) == (3, "paper")
    assert [(s.type, s.declared, s.low, s.high) for s in c.sections] == [("choice", 2, 1, 2), ("solution", 1, 3, 3)]
    rows = sorted(spans.collect(), key=lambda r: r.start)
    assert [(r.question_id, r.type) for r in rows] == [("q_1", "choice"), ("q_2", "choice"), ("q_3", "solution")]
    q = {r.number: r for r in segment.build_questions(segment.span_text(spans, docs)).collect()}
    assert [o.label for o in q[1].options] == ["A", "B", "C", "D"] == [o.label for o in q[2].options]
    assert [p.label for p in q[3].parts] == ["(1)", "(2)"] and "参考答案" not in q[3].text
    conf = segment.boundary_confidence(docs, segment.option_spans(segment.span_text(spans, docs)), contract).first()
    assert (conf.question_count, list(conf.reasons)) == (3, [])


def test_inline_and_glued_anchors(spark):
    _, _, spans = run_paper(spark, "## 解答题\n1. 已知 a=1。2. 已知 b=2\n3. 形式 覆盖面\n")
    assert [(r.number, r.kind) for r in sorted(spans.collect(), key=lambda r: r.start)] == [(1, "line-start"), (2, "inline"), (3, "line-start")]
    _, _, spans = run_paper(spark, "## 解答题 1. 已知 a=1\n2. 求 b\n")
    assert [(r.number, r.kind) for r in sorted(spans.collect(), key=lambda r: r.start)] == [(1, "inline-section"), (2, "line-start")]


def test_weak_first_anchor_needs_a_cue_without_typed_section(spark):
    _, _, spans = run_paper(spark, "专题一\n1. 你好\n")
    assert spans.count() == 0
    _, _, spans = run_paper(spark, "专题一\n1. 已知 x\n2. 你好\n")
    assert spans.count() == 2


def test_restart_only_with_cue_in_new_section_after_two(spark):
    body = "## 解答题\n1. 已知 a\n2. 已知 b\n专题二\n1. 已知 c\n"
    _, _, spans = run_paper(spark, body)
    assert [(r.question_id, r.reset) for r in sorted(spans.collect(), key=lambda r: r.start)] == [("q_1", False), ("q_2", False), ("q_1_2", True)]
    _, _, spans = run_paper(spark, body.replace("2. 已知 b\n", ""))
    assert spans.count() == 1


def test_empty_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, markdown string")
    assert segment.index_lines(docs).count() == 0
    assert canon.answer_zone(docs).where("zone_start = 1").count() == 2


QUESTION = "doc_id long, question_id string, position int, number int, type string, stem string, options array<string>, images array<string>"


@pytest.mark.parametrize("ratio", ["ratcliff", "levenshtein"])
def test_match_thresholds(spark, ratio):
    paper = spark.createDataFrame([(1, "p1", 1, 1, "choice", "1. 已知集合 A", ["A", "B"], []), (1, "p2", 2, 2, None, "2. 完全不同的题目", [], [])], QUESTION)
    answers = spark.createDataFrame([(1, "a1", 3, 1, "choice", "1. 已知集合 A", ["A", "B"], []), (1, "a2", 4, 2, None, "2. 无关", [], []), (1, "a3", 5, 9, "choice", "1. 已知集合 A", ["A", "B"], [])], QUESTION)
    got = {r.answer_id: (r.decision, r.score) for r in canon.merge_decisions(canon.match_scores(paper, answers, ratio)).collect()}
    assert got["a1"] == ("merge", 1.0) and got["a2"][0] == "none" and "a3" not in got
    whole = canon.match_scores(paper, answers, ratio, exact_runner_up=True)
    assert max(r.score for r in whole.where("answer_id = 'a3'").collect()) == 0.55


def test_merge_margin_and_review(spark):
    rows = [(1, "a", "p", 1, 0.75), (1, "a", "q", 2, 0.63), (1, "b", "p", 1, 0.75), (1, "b", "q", 2, 0.631), (1, "c", "p", 1, 0.65), (1, "d", "p", 1, 0.649999)]
    got = {r.answer_id: r.decision for r in canon.merge_decisions(spark.createDataFrame(rows, "doc_id long, answer_id string, paper_id string, position int, score double")).collect()}
    assert got == {"a": "merge", "b": "review", "c": "review", "d": "none"}


def test_clean_label_runs_against_last_kept(spark):
    rows = spark.createDataFrame([(1, ["(1)", "(3)", "(2)", "(3)", "(4)", "x y"])], "id long, labels array<string>")
    r = canon.clean_label_runs(rows).first()
    assert (r.kept, r.repeated, r.regressing) == (["(1)", "(3)", "(4)", "x y"], ["(3)"], ["(2)"])


def test_fold_of_step_events(spark):
    rows = [(1, 0, s, f"2024-01-01 00:00:0{i}", i) for i, s in enumerate(["running", "running", "success", "pending", "running", "failed"])]
    ev = spark.createDataFrame(rows, "job_id long, step long, status string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    r = jobs.fold_step_events(ev).first()
    assert (r.status, r.started_at.second, r.finished_at.second) == ("failed", 4, 5)
    r = jobs.fold_step_events(ev.where("event_id <= 2")).first()
    assert (r.status, r.started_at.second, r.finished_at.second) == ("success", 0, 2)


def test_delivery_backoff_and_dead_letter(spark):
    make = lambda oks: spark.createDataFrame([("k", f"2024-01-01 00:00:{i:02d}", i, ok) for i, ok in enumerate(oks)], "key string, ts string, event_id long, success boolean").withColumn("ts", F.to_timestamp("ts"))
    r = jobs.delivery_outcome(make([False, False])).first()
    assert (r.status, r.attempt, r.next_retry_at.second) == ("failed", 2, 11)
    assert jobs.delivery_outcome(make([False] * 7)).first().attempt == 5
    assert jobs.delivery_outcome(make([False, True, False])).first().status == "sent"
    assert jobs.delivery_outcome(make([False] * 13), max_attempts=20).first().next_retry_at.minute == 1


def test_concurrency_limit_rises_and_halves(spark):
    rows = [("e", i, i, i != 8, i == 8, 10.0) for i in range(12)]
    df = spark.createDataFrame(rows, "endpoint string, ts long, event_id long, ok boolean, pressure boolean, ms double")
    assert jobs.concurrency_trace(df).first().limits == [2, 2, 2, 3, 3, 3, 3, 4, 2, 2, 2, 2]


def test_union_regions_components(spark):
    box = lambda i, x, y: (i, 1, 0, x, y, 0.2, 0.1, 0.9)
    rows = [box(1, 0.0, 0.0), box(2, 0.1, 0.11), box(3, 0.2, 0.22), box(4, 0.0, 0.6), box(5, 0.16, 0.0)]
    df = spark.createDataFrame(rows, "region_id long, question_id long, page_index int, x double, y double, w double, h double, confidence double")
    got = sorted((list(r.sources), r.y, r.h) for r in layout.union_regions(df).collect())
    assert [g[0] for g in got] == [[1, 2, 3, 5], [4]]
    apart = df.where("region_id IN (1, 5)")
    assert layout.union_regions(apart).count() == 2


def test_image_assignment_margin(spark):
    label = lambda n, x: (1, n, 0, x, 0.5, x + 0.02, 0.52)
    labels = spark.createDataFrame([label("A", 0.1), label("B", 0.4)], "question_id long, label string, page_index int, x0 double, y0 double, x1 double, y1 double")
    image = lambda n, x: (1, n, 0, x, 0.55, x + 0.1, 0.6)
    schema = "question_id long, image_id string, page_index int, x0 double, y0 double, x1 double, y1 double"
    sure = layout.assign_images(labels, spark.createDataFrame([image("i", 0.1), image("j", 0.4)], schema)).collect()
    assert {(r.label, r.image_id) for r in sure} == {("A", "i"), ("B", "j")} and not sure[0].ambiguous and sure[0].confidence == 0.98
    even = layout.assign_images(labels, spark.createDataFrame([image("i", 0.21)], schema)).collect()
    assert even[0].ambiguous and even[0].confidence == 0.84


def test_math_normalising(spark):
    rows = [(1, "a $\\frac {1} {2}$ b"), (2, "x \\sqrt{2} y"), (3, "$a$$b$"), (4, "p $q"), (5, None), (6, "$\\frac{1}{2$ z")]
    out = {r.id: (r.t, r.status) for r in hygiene.normalize_math(spark.createDataFrame(rows, "id long, t string"), "t").collect()}
    assert out[1] == ("a $\\frac{1}{2}$ b", "fixed") and out[2] == ("x$\\sqrt{2} y$", "fixed") and out[3] == ("$a$ $b$", "fixed")
    assert out[4] == ("p $q$", "fixed") and out[5] == ("", "ok") and out[6][1] == "warning"


def test_answers_split_off(spark):
    df = spark.createDataFrame([("题干\n【答案】C\n\n因为 x\n【解析】略",), ("无标记",), ("题\n答案：因为 a 所以 b",)], "text string")
    got = [(r.stem, r.answer, r.analysis) for r in segment.extract_solutions(df).collect()]
    assert got == [("题干", "C", "因为 x\n\n略"), ("无标记", "", ""), ("题", "因为 a 所以 b", "")]


def test_bank_filters_both_modes(spark):
    rows = [(1, "Foo", "choice", 5.0, ["k1"]), (2, "bar", "choice", 5.5, ["k12"]), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, stem string, type string, score double, knowledge_points array<string>")
    ids = lambda **kw: [r.id for r in bank.bank_filter(df, **kw).collect()]
    assert ids() == [1, 2, 3] and ids(keyword="FOO") == [1] and ids(score="5") == [1] and ids(knowledge_point="k1") == [1]
    assert ids(knowledge_point="k1", mode="text") == [1, 2] and ids(score="5", mode="text") == [] and ids(region="x") == []


def test_sources_from_files(spark, tmp_path):
    for job, files in {"j1": {"a.md": "# small", "b/c.md": "# the larger one", "x_content_list.json": [{"type": "text", "text": "t", "bbox": [0, 0, 1, 1], "page_idx": 0}]},
                       "j2": {"only.markdown": "日本", "p_middle.json": [{"type": "text", "text": "m", "bbox": [0, 0, 0, 1], "page_idx": 0}, {"type": "image", "img_path": "i.png", "bbox": [0, 0, 5, 5], "page_idx": 1}], "p_content_list.json": []}}.items():
        for name, content in files.items():
            p = tmp_path / "out" / job / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    (tmp_path / "out/j2/bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "out/j2/pic.JPG").write_bytes(b"12345")
    root = str(tmp_path / "out")
    assert {r.job_id: r.markdown for r in corpus.read_markdown_corpus(spark, root).collect()} == {"j1": "# the larger one", "j2": "日本"}
    assert sorted((r.job_id, r.order, r.type, r.image_ref) for r in corpus.read_layout_json(spark, root).collect()) == [("j1", 0, "text", ""), ("j2", 0, "image", "i.png")]
    m = corpus.asset_manifest(corpus.job_files(spark, root)).collect()
    assert [(r.job_id, r.name, r.size, r.type) for r in m] == [("j2", "pic.JPG", 5, "jpg")]


def test_library_store(spark, tmp_path):
    store = {"tasks": [{"id": "t", "title": "x"}, {"id": " ", "title": "y"}], "knowledgePoints": [{"id": "k", "name": ""}], "bankQuestions": [{"id": "b", "score": 2}], "papers": []}
    (tmp_path / "store.json").write_text(json.dumps(store))
    tables = corpus.load_library_store(spark, str(tmp_path / "store.json"))
    assert {t: df.count() for t, df in tables.items()} == {"tasks": 1, "knowledgePoints": 0, "bankQuestions": 1, "papers": 0}


def test_results_do_not_depend_on_partitions_or_order(spark):
    rows = [(1, i, s, f"2024-01-01 00:{i:02d}:00", i) for i, s in enumerate(["running", "success", "running", "failed", "pending"] * 4)]
    df = spark.createDataFrame(rows, "job_id long, step long, status string, started_at string, event_id long").withColumns({"started_at": F.to_timestamp("started_at"), "finished_at": F.lit(None).cast("timestamp")})
    now = F.lit("2030-01-01").cast("timestamp")
    one = sorted(map(tuple, jobs.repair_stale_steps(df.coalesce(1), now).collect()))
    assert one == sorted(map(tuple, jobs.repair_stale_steps(df.orderBy(F.desc("event_id")).repartition(16), now).collect()))


def test_inline_numbers_are_searched_once(spark):
    """Neither the filter of telling lines nor a later column repeats the search of a line; word lists are no patterns."""
    docs = spark.createDataFrame([(1, "## 解答题\n1. 已知 a 2. 求 b\n考生注意\n")], "doc_id long, markdown string")
    lines = segment.classify_headings(segment.index_lines(docs))
    out = segment.accept_anchors(segment.anchor_candidates(lines), segment.structure_contract(lines))
    assert [(r.number, r.kind) for r in out.orderBy("start").collect()] == [(1, "line-start"), (2, "inline")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<![A-Za-z0-9_])(\\d{1,3})") == 2  # the texts between and the matches


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """No reader of Spark lists the files, so none of their names pass through the driver; hidden names are passed over, other names are taken as they are."""
    files = {"j1/a.md": b"#", "j1/b c%20/\u65e5.MD": b"longer", "j1/_x/y.md": b"the longest one", "j1/.z.md": b"the longest one", "j1/k=1/_p=2/q.md": b"loner2", "j2/n.txt": b"t", "_j3/a.md": b"x", "top.markdown": b"alone", "j4/a.md": b"\xff"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "j5").mkdir()
    monkeypatch.setattr(type(spark.read), "load", None)
    monkeypatch.setattr(corpus, "_READ", 1)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {(r.job_id, r.path, r.markdown) for r in corpus.read_markdown_corpus(spark, root).collect()}
        assert got == {("j1", "b c%20/\u65e5.MD", "longer"), ("top.markdown", "", "alone"), ("j4", "a.md", "\ufffd")}
        names = {(r.job_id, r.relative, r.length) for r in corpus.job_files(spark, root).collect()}
        assert names == {("j1", "a.md", 1), ("j1", "b c%20/\u65e5.MD", 6), ("j1", "k=1/_p=2/q.md", 6), ("j2", "n.txt", 1), ("top.markdown", "", 5), ("j4", "a.md", 1)}

"""Pairs left out by bounds of their ratio change no decision."""

import difflib
import random

from pyspark.sql import functions as F

from sparkfolio.operators import canon

SCHEMA = "doc_id int, question_id int, position int, number int, type string, stem string, options array<string>, images array<string>"


def test_bounds_hold(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcé日 .") for _ in range(rng.randrange(0, 30)))
    rows = [(text(), text()) for _ in range(300)] + [("", ""), ("a", ""), ("ab", "ba")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[c.alias(n) for c, n in zip(canon.ratio_bounds(F.col("a"), F.col("b")), "xy", strict=True)]).collect()
    for r in got:
        m = difflib.SequenceMatcher(None, r.a, r.b)
        if r.a or r.b:
            assert r.x >= r.y - 1e-12 and r.y >= m.ratio() - 1e-12
            assert abs(r.x - m.real_quick_ratio()) < 1e-12 and abs(r.y - m.quick_ratio()) < 1e-12


def test_decisions_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    words = ["已知函数", "求证", "alpha", "beta", "gamma", "delta", "取值范围", "x+y=1", "triangle", "圆心"]
    stem = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
    paper, answers = [], []
    for d in range(12):
        for i in range(25):
            s = stem()
            paper.append((d, i, i, i % 9 + 1, rng.choice(["choice", "solution", None]), s, rng.choice([["A", "B"], []]), ["图1"]))
            changed = s[: rng.randrange(len(s) // 2, len(s) + 1)] if rng.random() < 0.6 else stem()
            answers.append((d, 100 + i, 100 + i, i % 9 + 1, rng.choice(["choice", "solution", None]), changed, rng.choice([["A", "B"], ["A"], []]), ["图1"]))
    p, a = spark.createDataFrame(paper, SCHEMA), spark.createDataFrame(answers, SCHEMA)
    every = canon.match_scores(p, a).cache()
    near = canon.match_scores(p, a, least=canon.MERGE_AT - canon.MARGIN).cache()
    told = lambda scores: {(r.doc_id, r.answer_id, r.paper_id, r.score, r.decision) for r in canon.merge_decisions(scores).where("decision <> 'none'").collect()}
    assert told(near) == told(every) and {r[-1] for r in told(every)} == {"merge", "review"}
    dropped = 1 - near.count() / every.count()
    print(f"share of pairs dropped before Python: {dropped:.2f}")
    assert dropped > 0.1

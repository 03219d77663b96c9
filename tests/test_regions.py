"""United regions against a plain search over all pairs, and many boxes of one page."""

import random
import time

import numpy as np

from sparkfolio.operators import layout
from sparkfolio.operators.components import touching_groups


def brute(boxes):
    group = list(range(len(boxes)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (x, y, w, h) in enumerate(boxes):
        for j, (a, b, c, d) in enumerate(boxes[:i]):
            if min(x + w, a + c) - max(x, a) >= 0.25 * min(w, c) and max(y, b) - min(y + h, b + d) <= 0.02:
                one, other = root(i), root(j)
                group[max(one, other)] = min(one, other)
    return [root(i) for i in range(len(boxes))]


def boxes(rng, n, size):
    return [(rng.random(), rng.random(), rng.choice([0.0, size, size * 3, rng.random() * size]), rng.choice([0.0, size, rng.random() * size])) for _ in range(n)] + [(0.1, 0.1, 0.9, 0.0)]


def test_groups_equal_those_of_all_pairs():
    rng = random.Random(1)
    for n, size in ((1, 0.1), (40, 0.02), (150, 0.05), (300, 0.01), (200, 0.9), (60, 0.0)):
        many = boxes(rng, n, size)
        assert touching_groups(*np.array(many).T).tolist() == brute(many)


def test_pages_of_few_and_of_many_regions(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for page, n in enumerate((3, 30, 64, 65, 200)):
        held = boxes(rng, n - 1, 0.03)
        group = brute(held)
        rows += [(100 + i, 7, page, *map(float, b), 0.5 + i / 1000) for i, b in enumerate(held)]
        for g in set(group):
            own = [i for i, k in enumerate(group) if k == g]
            want.add((page, 100 + g, tuple(100 + i for i in own), 0.5 + min(own) / 1000))
    df = spark.createDataFrame(rows, "region_id long, question_id int, page_index int, x double, y double, w double, h double, confidence double").repartition(3)
    got = layout.union_regions(df).collect()
    assert {(r.page_index, r.component, tuple(r.sources), r.confidence) for r in got} == want
    assert {(r.page_index, r.component, tuple(r.sources), r.confidence) for r in layout.union_regions(df, small=0).collect()} == want


def test_a_hundred_thousand_boxes_of_one_page():
    rng = np.random.default_rng(3)
    n = 100_000
    began = time.process_time()
    scattered = touching_groups(rng.random(n), rng.random(n), rng.random(n) * 0.001, rng.random(n) * 0.001)
    heap = touching_groups(rng.random(n) * 0.01, rng.random(n) * 0.01, np.full(n, 0.1), np.full(n, 0.1))
    chain = touching_groups(np.zeros(n), np.arange(n) * 0.03, np.full(n, 0.1), np.full(n, 0.015))
    assert len(set(scattered)) > 1 and set(heap) == set(chain) == {0}
    assert time.process_time() - began < 120


def test_pages_of_few_regions_meet_in_one_shuffle(spark):
    rows = spark.createDataFrame([(i, i // 4, 0, (i % 4) * 0.2, 0.1, 0.3, 0.1, 0.9) for i in range(40)], "region_id long, question_id long, page_index int, x double, y double, w double, h double, confidence double")
    out = layout.union_regions(rows)
    assert [r.sources for r in out.orderBy("question_id").collect()] == [list(range(4 * q, 4 * q + 4)) for q in range(10)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 1 and "LeftAnti" not in plan and "LeftSemi" not in plan

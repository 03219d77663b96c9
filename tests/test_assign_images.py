"""Figure assignment of any size, against all permutations and the reference's refusal."""

import random
from itertools import permutations

from sparkfolio.operators import layout


def test_two_cheapest_equal_all_permutations():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 5)
        m = rng.randrange(n, 6)
        costs = [[rng.randrange(6) / 4 for _ in range(m)] for _ in range(n)]
        every = sorted((round(sum(costs[i][j] for i, j in enumerate(p)), 9), p) for p in permutations(range(m), n))
        best, chosen, second = layout._two_cheapest(costs)
        assert (best, tuple(chosen), second) == (*every[0], every[1][0] if len(every) > 1 else None)


def test_ten_images_and_too_many_images(spark):
    box = lambda q, name, x: (q, name, 0, x, 0.5, x + 0.02, 0.52)
    schema = "question_id long, {} string, page_index int, x0 double, y0 double, x1 double, y1 double"
    labels = spark.createDataFrame([box(1, chr(65 + i), i / 10) for i in range(10)] + [box(2, "A", 0.1), box(2, "B", 0.5)], schema.format("label"))
    images = spark.createDataFrame([box(1, f"i{i}", i / 10) for i in range(10)] + [box(2, f"i{i}", i / 10) for i in range(3)] + [box(3, "i0", 0.1)], schema.format("image_id"))
    rows = layout.assign_images(labels, images).collect()
    assert {(r.label, r.image_id) for r in rows if r.question_id == 1} == {(chr(65 + i), f"i{i}") for i in range(10)}
    refused = [(r.question_id, r.image_id, r.label, r.reason) for r in rows if r.question_id > 1]
    assert sorted(refused, key=str) == [(q, i, None, "option_image_one_to_one_violation") for q, i in [(2, "i0"), (2, "i1"), (2, "i2"), (3, "i0")]]

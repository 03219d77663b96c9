"""Exact and approximate searches against brute force."""

import numpy as np
import pytest

from sparkfolio.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, dim int"


def rows_of(n=700, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim))
    x = (centres[rng.integers(0, 5, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)
    x[50:200] = x[50]  # a large group of equal vectors
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    bad = [(5000, None, 0, 1), (5100, [], 0, 1), (5200, [nan] * dim, 0, 1), (5300, [inf] + [0.0] * (dim - 1), 0, 1), (5400, [None] + [1.0] * (dim - 1), 0, 1), (None, x[0].tolist(), 0, 1)]
    return rows, bad + [rows[3], rows[300], (7001, [1.0, 2.0], 0, 1), (7100, [1.0, 2.5], 0, 1), (7002, [3.0, 2.0], 0, 1)]


def brute(rows, better):
    """Every row of another id is a candidate; query rows of one id share a list."""
    out = []
    by_dim = {}
    for i, v, *_ in rows:
        by_dim.setdefault(len(v), []).append((i, np.array(v, dtype=np.float64)))
    for vectors in by_dim.values():
        for q in {i for i, _ in vectors if i % 100 == 0}:
            scored = sorted((better(a, v), i) for j, a in vectors if j == q for i, v in vectors if i != q)[:10]
            out += [(q, k + 1, i, s) for k, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("size", [32_768, 9])
def test_top_k_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "ROWS", size)  # 9: over 64 shards, so merges of merges
    monkeypatch.setattr(topk, "CELLS", 1 << 10)
    rows, more = rows_of()
    more += [rows[300]] * 40 + [(8000, [], 0, 1)]
    good = rows + [r for r in more if r[0] in (3, 300, 5100, 7001, 7100, 7002, 8000)]
    got = sorted((r.query_id, r.rank, r.vec_id, -r.score) for r in topk.top_k(spark.createDataFrame(rows + more, SCHEMA)).collect())
    assert got == brute(good, lambda a, b: -int(np.floor(1024 * a) @ np.floor(1024 * b)))


def test_top_k_with_huge_components(spark):
    rows = [(0, [1e12, -1.0], 0, 1), (1, [1e12, 3.0], 0, 1), (2, [1e12, 2.0], 0, 1), (3, [1e30, 2.0], 0, 1)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3)]
    assert got[0].score == (1 << 63) - 1
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_neighbours_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 100)
    monkeypatch.setattr(ann, "SHARD", 60)
    rows, more = rows_of()
    good = rows + more[-5:]
    want = {(q, i): s for q, _, i, s in brute(good, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))}
    zero = [(6000, [0.0] * 24, 0, 1)]
    got = ann.search(spark.createDataFrame(rows + more + zero, SCHEMA)).collect()
    assert len({(r.query_id, r.vec_id) for r in got}) <= len(got) == len(brute(good, lambda a, b: float(((a - b) ** 2).sum())))
    hits = {(r.query_id, r.vec_id): r.score for r in got if (r.query_id, r.vec_id) in want}
    assert len(hits) >= 0.9 * len(want)
    assert all(s == want[k] for k, s in hits.items())
    ordered = sorted(got, key=lambda r: (r.query_id, r.rank))
    assert all((a.score, a.vec_id) <= (b.score, b.vec_id) for a, b in zip(ordered, ordered[1:], strict=False) if a.query_id == b.query_id)
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.search(spark.createDataFrame(rows[:3], SCHEMA)).count() == 2


def recall(spark, x, mod=100):
    ids = np.arange(len(x))
    frame = spark.createDataFrame(list(enumerate(x.astype(np.float64).tolist())), "vec_id long, embedding array<float>")
    found = {}
    for r in ann.search(frame, query_mod=mod).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), mod):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found[q] & set(np.lexsort((ids, d))[:10].tolist()))
    return hit / (10 * len(range(0, len(x), mod)))


@pytest.mark.parametrize("n", [500, 2000, 30_000])
def test_recall_without_any_structure(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 64))
    assert recall(spark, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 100 if n < 10_000 else 500) >= 0.9


def test_recall_where_the_sample_is_small(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 400)
    x = np.random.default_rng(1).standard_normal((20_000, 32)).astype(np.float32)
    assert recall(spark, x, 500) >= 0.9

import math
import random
import re
from collections import Counter

from sparkfolio.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, rank, None if unknown else d, -s) for rank, (s, unknown, d) in enumerate(sorted(scored)[:50], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(30)] + ["Über", "日本", "a1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i if i % 11 else None, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 20, 200]))).upper() if i % 5 else "same words w1 w2 w3, w1") for i in range(n)]
    return docs + [(5, None), (6, ""), (7, " .,;"), (7, "w1-w1 é"), (8, "W1 " * 30_000)]


ITEMS = [(1, "W1, w2 and w29"), (2, "w0 w1 w2 w3 w4 über 日本"), (2, "w5"), (3, "nowhere"), (4, None), (None, "w1 w7"), (6, "w1 w1 w1"), (7, "é")]


def test_whole_lists_against_brute_force(spark):
    docs = corpus(random.Random(1), 700)
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], "doc_id long, text string, n long, item_id long, terms string").repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(ranked.rank_documents(df, items)) == brute(docs, ITEMS)


def test_many_shards_and_blocks_give_the_same(spark, monkeypatch):
    docs = corpus(random.Random(2), 600)
    monkeypatch.setattr(ranked, "SHARD", 40)
    monkeypatch.setattr(ranked, "BANDS", 5)
    monkeypatch.setattr(ranked, "ITEM_TERMS", 8)
    df, items = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(ranked.rank_documents(df, items)) == brute(docs, ITEMS)


def test_texts_read_in_parts(monkeypatch):
    text = ("Ab-é日 x9 " * 500).encode()
    whole = ranked.term_counts(text)
    for part in (1, 2, 7, 100):
        monkeypatch.setattr(ranked, "PART", part)
        assert ranked.term_counts(text) == whole


def test_strata_below_the_floor_are_not_visited(monkeypatch):
    import numpy as np

    m = np.repeat([50, 60, 900], 60)
    strata = ranked.Strata(m, np.arange(180), np.zeros(180, bool), np.ones(180, int), np.zeros(180, int), np.ones(180, int))
    seen, visit = [], ranked.Strata._visit
    monkeypatch.setattr(ranked.Strata, "_visit", lambda self, s, *a: (seen.append(s), visit(self, s, *a))[1])
    items = ranked.Items([9], [(0, 0)], [3.0])
    [(_, places, scores)] = strata.search(items)
    assert seen == [0] and places.tolist() == list(range(50)) and set(scores) == {3.0 * (10**9 // 2000)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.rank_documents(none, items).collect() == []
    assert ranked.rank_documents(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(0)).collect() == []

"""Toxicity held-out accuracy on the given tables, edge cases, and the pipeline's stages."""

import math
import random
import string
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sparkfolio.llm import toxicity
from sparkfolio.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=1500, seed=9):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        text = [rng.choice(words) for _ in range(rng.choice([20, 60, 300]))]
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["vilest", "rotter", "rotters", "nasty!"])
        lines = [" ".join(text[k : k + 12]) for k in range(0, len(text), 12)]
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}" if i % 5 else None, 1))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_reruns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, None, None, None, None), (9000, "", "", "", 0)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = docs.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("text")).alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert 200 < len(held) < 400
    wrong = [r.doc_id for r in held if (r.score >= 0.5) != (r.doc_id % 7 == 0)]
    assert len(wrong) <= 0.02 * len(held)
    again = toxicity.fit(docs.repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"))
    assert again.features == model.features and abs(again.weights - model.weights).max() < 1e-9


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, None, 1)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.s for r in docs.select(model.score(F.col("text")).alias("s")).collect()] == [0.0]
    assert toxicity.reject(docs, model).count() == 1
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).features == []


def test_toxicity_edges(spark):
    """Very long texts, repeated ids and labels, clashing columns, nulls everywhere."""
    rows, labels = corpus(900)
    long = " ".join(["plain"] * 300_000 + ["vilest", "nasty!", "rotters"])
    rows += [(9001, long, None, None, None), (9001, long, "en", "a", 1), (None, "vilest nasty! rotters", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("positive", F.lit("own")).withColumn("draw", F.lit(1)).withColumn("toxic", F.lit(5))
    marks = spark.createDataFrame([*labels, *labels[:40], (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 9001 not in ids and sum(i in ids for i in range(900) if i % 7) >= 0.98 * sum(1 for i in range(900) if i % 7)
    assert kept.where("doc_id IS NULL").count() == 1
    assert toxicity.reject(docs.limit(0), model).count() == 0


def test_pipeline_keeps_rows_with_nulls_and_repeated_ids(spark, tmp_path):
    rows, labels = corpus(300)
    texts = {i: " ".join(f"n{i}x{j}" for j in range(30)) for i in range(6)}
    rows += [(None, texts[0], None, None, None), (None, texts[1], "en", None, 1), (7000, texts[2], "en", "s1", 1), (7000, texts[3], "en", "s1", 1), (7001, None, None, None, None), (7002, "", "en", "s2", 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        found = [r.text for r in docs.select("text").collect()]
        assert {texts[k] for k in range(4)} <= set(found)
    assert sum(not t for t in found) == 1  # null and empty texts are copies of each other
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, str(tmp_path)), name)
        assert empty.count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows, labels = corpus(400)
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(20)) for i in range(4))
    rows += [(5000, passage, "en", "s1", 1), (5001, f"own line here\n{passage}\nown end there", "en", "s1", 1), (5002, passage, "en", "s2", 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("quality", F.lit(1)).select(corpus_pipeline.COLUMNS)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in kept[:-1])
    clean = {r.doc_id for r in kept[0].collect()}
    assert {i for i, *_ in rows if i % 7 and i < 5000} <= clean and len([i for i in clean if i < 400 and i % 7 == 0]) <= 3
    texts = {r.doc_id: r.text for r in kept[1].collect()}
    assert texts.keys() == clean and texts[5000] == passage and texts[5001] == "own line here\nown end there" and texts[5002] == ""
    assert {5000, 5001} <= {r.doc_id for r in kept[2].collect()}
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in kept[4].collect())


def test_run_over_a_data_directory(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    assert out.count() > 100


def names_of(text):
    found = set()
    for word in (text or "").lower().split():
        word = word.strip(string.punctuation)
        if word:
            found |= {f"w {word}"} | {f"b {word[:n]}" for n in (4, 5) if len(word) > n}
    return found


def test_training_against_a_slow_minimiser(spark):
    """Features by plain counts; the risk that training reaches against a search over each weight in turn; scores by plain sums."""
    rows, labels = corpus(700, seed=4)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    toxic = {i for i, _, t in labels if t == 1}
    texts = {}
    for i, text, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            texts[text] = texts.get(text, False) or i in toxic
    sides = [[names_of(t) for t, positive in texts.items() if positive == want] for want in (True, False)]
    n_p, n_u = map(len, sides)
    p, u = (Counter(n for s in side for n in s) for side in sides)

    def z(name):
        mean = (p[name] + u[name]) / (n_p + n_u)
        return (p[name] / n_p - u[name] / n_u) / math.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u) + 1e-12)

    chosen = [n for n in p if p[n] >= 3 and z(n) >= 5]
    known = {zlib.crc32(n.encode()): n for n in chosen}
    assert sorted(known) == model.features and 3 <= len(chosen) < 40
    order = [known[h] for h in model.features]
    marks = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    prior = len(toxic & set(marks)) / len(marks)
    assert abs(model.prior - prior) < 1e-12
    held = [Counter(tuple(i for i, n in enumerate(order) if n in s) for s in side) for side in sides]

    def risk(weights, bias):
        up = [sum(k / (1 + math.exp(-max(-500, min(500, bias + sum(weights[i] for i in at))))) for at, k in side.items()) / n for side, n in zip(held, (n_p, n_u), strict=True)]
        return prior * (1 - up[0]) + max(0.0, up[1] - prior * up[0])

    weights, bias = [0.0] * len(order), 0.0
    for _ in range(4):
        bias = min((-12 + k / 2 for k in range(49)), key=lambda x: risk(weights, x))
        for i in range(len(order)):
            weights[i] = min((k / 2 for k in range(41)), key=lambda x: risk([*weights[:i], x, *weights[i + 1 :]], bias))
    assert risk(list(model.weights), model.bias) <= risk(weights, bias) + 0.01
    scored = {r.doc_id: r.score for r in docs.select("doc_id", model.score(F.col("text")).alias("score")).collect()}
    for i, text, *_ in rows:
        margin = model.bias + sum(w for n, w in zip(order, model.weights, strict=True) if n in names_of(text))
        assert abs(scored[i] - 1 / (1 + math.exp(-margin))) < 1e-9

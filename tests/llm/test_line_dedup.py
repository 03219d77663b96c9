"""Line dedup against brute force over maximal runs, and edge cases."""

import random

from pyspark.sql import functions as F

from sparkfolio.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, least):
    """Deletes each line in a run of >= least words, all of whose lines stand consecutively earlier (blank lines aside)."""
    docs = {i: [(p, x.strip(" \t\n\x0b\x0c\r"), len(x.split())) for p, x in enumerate(t.split("\n")) if x.split()] for i, t in texts.items() if t is not None}
    seen = [(i, k) for i in sorted(docs) for k in range(len(docs[i]))]
    gone = {i: set() for i in docs}
    for i in docs:
        for start in range(len(docs[i])):
            for j, k in seen:
                if (j, k) >= (i, start):
                    break
                n = words = 0
                while start + n < len(docs[i]) and k + n < len(docs[j]) and docs[i][start + n][1] == docs[j][k + n][1]:
                    words += docs[i][start + n][2]
                    n += 1
                if words >= least:
                    gone[i] |= {docs[i][start + m][0] for m in range(n)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in texts.items()}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 2, 5, 9])))
    pool = [[line() for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    texts = {}
    for i in range(60):
        parts = [x for _ in range(rng.randrange(1, 6)) for x in rng.choice([rng.choice(pool), [line()], pool[0]])]
        texts[i] = "\n".join(parts)
    texts |= {60: None, 61: "", 62: "\n\n", 63: texts[0], 64: "  " + texts[1] + "\t"}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], SCHEMA)
    for least in (3, 12):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_words=least).collect()}
        assert got == brute(texts, least)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (None, f"x\n{long}\ny", "en", "a", 1), (None, None, None, None, None), (2, f"{long}\n{long}", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit("kept")).withColumn("id", F.lit(3)).withColumn("row", F.lit(4))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_deleted"]
    assert sorted((r.doc_id or 0, r.text or "", r._deleted) for r in out.collect()) == [(0, "", 0), (0, "x\ny", 1), (1, long, 0), (1, long, 0), (2, "", 2)]
    again = line_dedup.dedup_lines(out.withColumn("_deleted", F.lit(9)))
    assert again.columns == out.columns and {r._deleted for r in again.collect()} == {0}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a", None, None, 1)], SCHEMA)
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

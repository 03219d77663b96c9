import random
import zlib
from collections import Counter
from re import findall

from sparkfolio.llm import spelling

LETTERS = "abcé"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(n):
    rows = {}
    for w, k in n.items():
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * k else None
        rows[w] = [form, None, k, len(near), n[form] if form else None]
    for w in rows:
        root = w
        while rows[root][0]:
            root = rows[root][0]
        rows[w][1] = root
    return {(w, *r) for w, r in rows.items()}


def result(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_scan_finds_each_pair_once_in_one_direction():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab" if rng.random() < 0.7 else LETTERS) for _ in range(rng.randint(7, 12))) for _ in range(900)})
    backward = sorted(w[::-1] for w in words)
    found = [(words[p], words[i]) for p, i in spelling.scan(words, words)] + [(backward[p][::-1], backward[i][::-1]) for p, i in spelling.scan(backward, backward, True)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert len(found) > 500


def test_forms_roots_and_tiles_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(7, 10))) for _ in range(40)]
    bag = []
    for w in base:
        bag += [w] * rng.choice([2, 5, 60, 700])
        for _ in range(6):
            i, kind = rng.randrange(len(w)), rng.choice("idr")
            v = w[:i] + (rng.choice(LETTERS) if kind != "d" else "") + w[i + (kind != "i") :]
            bag += [v] * rng.choice([1, 2, 5, 30])
    bag += ["planted"] * 700 + ["plantet"] * 45 + ["plantett"] * 4  # a chain of two forms
    rng.shuffle(bag)
    docs = [(i if i % 7 else None, " ".join(w.upper() if rng.random() < 0.1 else w for w in bag[at : at + 60]), "x") for i, at in enumerate(range(0, len(bag), 60))]
    docs += [(1, None, "x"), (2, "", "x"), (3, "1234 -- short", None), (9, "x" * 50_000 + " " + "x" * 50_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string").repartition(5)
    want = brute(counted([d[:2] for d in docs]))
    assert result(spelling.spelling_variants(df)) == want
    assert any(r[1] and r[1] != r[2] for r in want)
    words = spelling.word_counts(df).cache()
    whole = {tuple(r) for r in spelling.near_words(words).collect()}
    assert {tuple(r) for r in spelling.near_words(words, segment=3).collect()} == whole  # segments in many tiles


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spelling.op12_spelling_variants(spark, sf)) == brute_by_deletions(counted(docs))


def brute_by_deletions(n):
    """brute(), with near words from a table of words that lack one letter."""
    less = {}
    for w in n:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (_, short), held in less.items():
        for w in held:
            near[w] |= held - {w}
            if short in n:
                near[w].add(short)
                near[short].add(w)
    rows = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * k else None
        rows[w] = [form, None, k, len(near[w]), n[form] if form else None]
    for w in rows:
        root = w
        while rows[root][0]:
            root = rows[root][0]
        rows[w][1] = root
    return {(w, *r) for w, r in rows.items()}

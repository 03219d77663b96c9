"""BPE against the tokenizers library."""

import hashlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfolio.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
MODEL = bpe._model(bpe.VOCABULARY)


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def own(text):
    raw = MODEL.encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)], MODEL.decode(raw)


@pytest.mark.parametrize("text", [
    "", "  a", "Hello  World", "it's I'LL we'd 'S x'tx", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "日本 é É é ΣΣ İ ß ﬁ",
    "123 4.5 ½ ²³", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "thethethethethe", "\x1c\x1da\x85b​c\xa0d", "</w> a</w>", "😀😀 a😀b", "́a", "\n\n\t", "!!!???..." * 40,
])
def test_equals_library(text):
    assert own(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeiontrshl' .,!1é"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_equals_library_on_any_text(text):
    assert own(text) == library(text)


def test_equals_library_on_all_code_points():
    """Between letters, and among combining marks and digits; of the planes that hold nothing, every 97th."""
    chosen = [*range(0xD800), *range(0xE000, 0x40000), *range(0x40000, 0xE0000, 97), *range(0xE0000, 0xE0200), *range(0xE0200, 0x110000, 97)]
    for at in range(0, len(chosen), 20_000):
        texts = [f"a{c}b e{c}\u0323\u0301x 7{c}" for c in map(chr, chosen[at : at + 20_000])]
        for text, found in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
            assert MODEL.encode(text) == b"".join(i.to_bytes(4, "little") for i in found.ids), ascii(text)


def test_equals_library_on_newer_compositions():
    for cp in range(0x110000):
        apart = unicodedata.normalize("NFD", chr(cp)) if not 0xD800 <= cp < 0xE000 else ""
        if len(apart) > 1:
            assert own(f"x{apart}y") == library(f"x{apart}y"), ascii(apart)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([".", ",", "'", "'s", "'ll", "abc", "é", "7", "\u1c89", "\ua7ce", "-", "!)", '"', " ", "\x1c", "Σ", "\u0301"]), max_size=12))
def test_equals_library_on_punctuation(parts):
    text = "".join(parts)
    assert own(text) == library(text)


def test_memories_and_long_words(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdet") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", "!?", "'s"]) for _ in range(40))
        assert own(text) == library(text)
    assert len(MODEL.memory) <= 50 and len(MODEL.older) <= 50
    long = "".join(rng.choice("etaoin") for _ in range(30_000))
    assert own(long) == library(long)


def test_equals_library_on_random_letter_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    for w in words:
        assert own(w) == library(w)


def test_table_edges(spark):
    long = "wordy " * 200_000
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (2, "A b", 7), (2, "A b", 7), (None, long, 8)], "doc_id long, text string, ids long")
    rows = bpe.tokenize(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("h"), "decoded").collect()
    assert [r.n_tokens for r in rows] == [0, 0, 2, 2, len(library(long)[0])]
    assert rows[0].h == hashlib.sha256(b"").hexdigest()
    assert rows[4].decoded == library(long)[1]
    assert bpe.tokenize(docs.limit(0)).count() == 0


def test_digests_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "A b", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_tokens long, decoded string")
    full = bpe.tokenize(docs).collect()
    made = bpe.tokenize(docs, digests=True)
    assert made.columns == ["doc_id", "text", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    for a, b in zip(full, made.collect(), strict=True):
        assert (a.n_tokens, hashlib.sha256(a.ids).hexdigest(), hashlib.sha256(a.decoded.encode()).hexdigest()) == (b.n_tokens, b.ids_sha256, b.decoded_sha256)
    assert [r.n_tokens for r in full] == [2, 0] and [r.decoded for r in made.collect()] == ["x", "y"]


def rows(texts, **kwargs):
    """encode_rows, a list of ids a text."""
    ids, sizes = bpe.encode_rows(pa.array(texts, pa.string()), **kwargs)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []


def test_rows_equal_library(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " ", "<|endoftext|>a", "x\x1cy", "日本 É", "a" * 200 + " " + "é" * 40, "Thé, cat's... ÀÉ!%% 12.5 \x85 b\xa0c", "\n\nend"]
    texts += ["".join(f"{chr(c)} a{chr(c)}b {chr(c)}, " for c in range(at, at + 64)) for at in range(0, 256, 64)]
    texts += [" ".join("".join(rng.choice("etaoinshrdluéß") for _ in range(rng.randrange(1, 24))) + rng.choice(["", ",", ".%%", '."', "'s", "-a", "7"]) for _ in range(60)) for _ in range(200)]
    want = [library(x or "")[0] for x in texts]
    assert rows(texts) == want
    assert rows(texts, end=[2]) == [[*x, 2] for x in want]
    assert rows([]) == [] and rows([None]) == [[]]
    odd = pa.array(["skipped", *texts, "skipped"])
    ids, sizes = bpe.encode_rows(odd.slice(1, len(texts)))
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    assert [(at, n) for at, n in bpe.portions(odd)] == [(0, len(odd))]
    monkeypatch.setattr(bpe, "_BYTES", 10)
    assert list(bpe.portions(pa.array(["12345", "12345", "1", None, "x" * 30, "", "1"]))) == [(0, 2), (2, 2), (4, 1), (5, 2)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeiontrshl' .,!1é<|>"), st.characters(max_codepoint=255), st.characters(blacklist_categories=("Cs",))), max_size=40), max_size=5))
def test_rows_equal_library_on_any_text(texts):
    assert rows(texts) == [library(x)[0] for x in texts]


def test_rows_merge_words_side_by_side(monkeypatch):
    """Words of letters don't go through the encoder of single words."""
    seen = []
    monkeypatch.setattr(bpe._Model, "word", lambda self, word, own=bpe._Model.word: seen.append(word) or own(self, word))
    bpe.forget()
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 20))) + rng.choice(["", ",", "."]) for _ in range(3000))
    assert rows([text]) == [library(text)[0]] and len(seen) <= 2

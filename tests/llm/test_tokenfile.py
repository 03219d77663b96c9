import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkfolio.llm import tokenfile
from sparkfolio.llm.common import shared_dir


def library(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def brute(docs):
    """(doc_id, start, n, crc) of documents in order."""
    out, start = [], 0
    for (doc_id, _), ids in zip(docs, library([t for _, t in docs]), strict=True):
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 2 * tokenfile.BLOCK + 1])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.3, n), 65535), rng.integers(0, 65536, n), np.full(n, 65535), np.zeros(n), np.arange(n) % 60)[: 5 if n < 1000 else 2]:
        blocks = tokenfile.encode_blocks(ids.astype("<u4"))
        assert [b[0] for b in blocks] == [min(tokenfile.BLOCK, n - at) for at in range(0, n, tokenfile.BLOCK)]
        got = np.concatenate([np.zeros(0, "<u4"), *tokenfile.decode_blocks(blocks)])
        assert (got == ids).all()


def test_blocks_stand_alone_and_find_damage():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 3 * tokenfile.BLOCK), 65535).astype("<u4")
    blocks = tokenfile.encode_blocks(ids)
    assert (next(tokenfile.decode_blocks([blocks[2]])) == ids[2 * tokenfile.BLOCK :]).all()
    assert blocks[1] == tokenfile.encode_blocks(ids[tokenfile.BLOCK : 2 * tokenfile.BLOCK])[0]
    n, crc, data = blocks[0]
    with pytest.raises(ValueError, match="checksum"):
        list(tokenfile.decode_blocks([(n, crc, data[:50] + bytes([data[50] ^ 4]) + data[51:])]))
    with pytest.raises(ValueError, match="65,536"):
        tokenfile.encode_blocks(np.array([65536], "<u4"))


def test_predictions_pay():
    again = np.tile(np.random.default_rng(2).integers(0, 49000, 64), 128).astype("<u4")
    assert sum(len(x) for _, _, x in tokenfile.encode_blocks(again)) < len(again) * 2 / 20
    skewed = np.minimum(np.random.default_rng(3).zipf(1.5, tokenfile.BLOCK), 65535).astype("<u4")
    assert sum(len(x) for _, _, x in tokenfile.encode_blocks(skewed)) < len(skewed)


def test_files_against_library(spark):
    docs = [(i * 7 % 101, f"Document {i}: naïve Ünïcode {'word ' * (i % 50)}<|endoftext|>") for i in range(101)] + [(200, None), (201, ""), (202, " \n"), (203, "long text " * 40_000)]
    docs += [(None, "no id"), (300, "same"), (300, "same"), (300, "other")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start long, part string").repartition(7)
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfile.write_tokens(df, folder)
    read = tokenfile.read_tokens(tokenfile.token_index(spark, folder)).cache()
    got = rows(read)
    hashed = {r["text"]: r["h"] for r in df.where("text is not null").selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    want = brute(sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashed.get(d[1], 42))))
    assert got == want
    texts = {d: ids for (d, _), ids in zip(docs, library([t for _, t in docs]), strict=True) if d not in (None, 300)}
    for r in read.where("doc_id between 200 and 203").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == texts[r["doc_id"]]
    files = {r["file"] for r in tokenfile.token_index(spark, folder).collect()}
    known = {(r["file"], r["offset"], r["length"]) for r in tokenfile.token_index(spark, folder).collect()}
    assert {(f, *g) for f in files for g in tokenfile.groups_of(f)} == known
    assert all(Path(f.removeprefix("file://")).read_bytes()[:8] == tokenfile.MAGIC for f in files)


def test_groups_split_and_long_documents():
    ids = np.arange(3 * tokenfile.BLOCK, dtype="<u4") % 50_000
    sizes = [0, 5, 2 * tokenfile.BLOCK, tokenfile.BLOCK - 5, 0]
    got = list(tokenfile.unpack_group(tokenfile.pack_group([1, None, 3, 4, 5], sizes, ids)))
    assert [(d, b, n) for d, b, n, _ in got] == [(1, 0, 0), (None, 0, 5), (3, 5, sizes[2]), (4, 5 + sizes[2], sizes[3]), (5, len(ids), 0)]
    assert (np.concatenate([x for *_, parts in got for x in parts]) == ids).all()


def test_empty_table(spark):
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert rows(tokenfile.read_tokens(tokenfile.token_index(spark, folder))) == []


def test_query_matches_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert rows(tokenfile.op13_token_files(spark, sf)) == brute(docs)


def test_blocks_are_coded_in_few_steps(monkeypatch):
    """A step codes an id of every lane, so the number of steps doesn't grow with the block."""
    calls = []
    for kind in (tokenfile._Encoder, tokenfile._Decoder):
        monkeypatch.setattr(kind, "code", lambda self, *args, code=kind.code, kind=kind: calls.append(kind) or code(self, *args))
    ids = np.minimum(np.random.default_rng(4).zipf(1.3, 1 << 18), 65535).astype("<u4")
    assert (np.concatenate(list(tokenfile.decode_blocks(tokenfile.encode_blocks(ids)))) == ids).all()
    assert 2048 <= calls.count(tokenfile._Encoder) == calls.count(tokenfile._Decoder) <= 2 * 2048

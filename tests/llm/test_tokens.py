"""Token counts and token shards against the tokenizers library itself."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tidemark.llm import mphf, pretokens, queries, shards, tokencount

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key int, n_bytes string, shard string"
ODD = [
    None,
    "",
    " ",
    "\n\n a  b\t\tc \n",
    "It's we'll THEY'RE I'd ''s 'S",
    "a<|endoftext|>b <|endoftext|> <|startoftext|>x<|",
    "naïve café ÀÉÎ ß ĳ Ŀ ŉ",
    "x²½ ⅷ ٣ १२ ǅ İstanbul ΑΣ ΣΑΣ ﬁ ａ",
    "é ñ 가     ​ \x1c\x85 ",
    "日本語 мир مرحبا 👩‍👩‍👧 🇩🇪",
    "_a__b -- !!! ... “q” – €5 «x»",
    "x" * 100_000,
    "word " * 300_000,
    "1234567 12.5e10",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", "s") for i, t in rows], SCHEMA)


def library(name):
    own = Tokenizer.from_file(path(name))
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, monkeypatch):
    ids = library(name)
    letters = [chr(c) for c in [*range(0x20), *range(0x20, 0x250), *range(0x2000, 0x2070), 0x20AC]]
    texts = [*ODD, *[f"a{c}b {c}{c} 1{c}" for c in letters], "".join(letters)]
    want = [np.array(ids(t), "<u4").tobytes() for t in texts]
    assert list(pretokens.Encoder(name, "ids").encode(texts)) == want
    monkeypatch.setattr(pretokens, "KEPT", 10)  # most pre-tokens are encoded each time
    assert list(pretokens.Encoder(name, "lengths", {"a": 1}).encode(texts)) == [len(w) // 4 for w in want]


def test_counts_equal_library(spark):
    ids = library("byte_bpe_50k.json")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op1_token_counts"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(ids(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_counts_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "FREQUENT", 3)
    monkeypatch.setattr(tokencount, "COUNTERS", 2)
    ids = library("byte_bpe_50k.json")
    rows = [*enumerate(ODD), (None, "a b"), (3, "again"), (3, "again")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(ids(t))) for i, t in rows), key=str)
    assert tokencount.token_counts(frame(spark, [])).collect() == []


def expected(rows, ids):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = [*ids(t), 2]
        out.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def test_shards_round_trip(spark):
    ids = library("word_bpe_49k.json")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op9_token_shards"](spark, SMALL).collect())
    assert got == expected(rows, ids)


def test_shards_of_odd_rows(spark):
    ids = library("word_bpe_49k.json")
    rows = [*((-5 * i, t) for i, t in enumerate(ODD)), (None, "a b"), (7, "same"), (7, "same"), (1 << 62, "q")]
    manifest = shards.write_shards(frame(spark, rows))
    got = sorted((tuple(r) for r in shards.read_documents(frame(spark, rows), manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows, ids)
    one = shards.read_documents(frame(spark, [(7, None)]), manifest).collect()
    assert len(one) == 2 and {r.n_tokens for r in one} == {2}
    assert shards.read_documents(frame(spark, []), shards.write_shards(frame(spark, []))).collect() == []
    with pytest.raises(Exception, match="missing"):
        shards.read_documents(frame(spark, [(3, None)]), manifest).collect()


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    hashed = mphf.PerfectHash.build(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    arrays = mphf.unpack(mphf.pack([hashed.sizes, hashed.words, np.zeros(0, np.uint8), np.array([3], np.uint8)]))
    again = mphf.PerfectHash(arrays[0], arrays[1])
    assert (again.index(keys) == hashed.index(keys)).all() and arrays[3].tolist() == [3]
    assert len(hashed.words) * 64 < 5 * len(keys)
    strange = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    assert set(hashed.index(strange).tolist()) <= set(range(-1, len(keys)))
    assert mphf.PerfectHash.build(keys[:0]).index(keys[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError):
        mphf.PerfectHash.build(np.array([5, 5], np.uint64))

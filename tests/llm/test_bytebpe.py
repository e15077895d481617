"""Byte-level BPE against the tiktoken library, and round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bytebpe, queries
from test_tokens import ODD, SMALL, frame


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library(codec):
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={}
    )
    return own.encode_ordinary


def test_classes_of_every_code_point():
    every = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and c not in bytebpe._WHITE]
    assert bytebpe._class_table()[every].tolist() == bytebpe._asked(list(map(chr, every)))


def test_code_points_in_context(codec, library):
    """Each beside a letter, a digit, a sign, blanks and an apostrophe."""
    for points in (range(0x600), range(0x1680, 0x1690), range(0x2000, 0x2070), range(0x2FF0, 0x3010), range(0x10EC0, 0x10EF0)):
        text = "".join(f"a{c}a 1{c}1!{c}! {c} {c}{c}'{c}s" for c in map(chr, points))
        assert codec.encode([text])[0].tolist() == library(text)


@pytest.mark.parametrize("short", [0, 64])
def test_random_texts(codec, library, monkeypatch, short):
    monkeypatch.setattr(bytebpe, "SHORT", short)
    rng = random.Random(3)
    letters = "aest'rvldm1٣ \n\t  !é中.'''  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for kept in (0, 200_000):
        monkeypatch.setattr(bytebpe, "KEPT", kept)
        codec.cache.clear()
        ids, borders = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:], strict=False)] == [library(t) for t in texts]


@pytest.mark.parametrize("segment", [1, 7, 1 << 19])
def test_parts_of_long_texts(codec, library, monkeypatch, segment):
    monkeypatch.setattr(bytebpe, "SEGMENT", segment)
    texts = ["it's  we'll\n\n they're 've   x" * 40, "", "a", " " * 500 + "b", "'" * 300 + "ll", "x" * 700, "don't", "\n \n" * 90]
    ids, borders = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:], strict=False)] == [library(t) for t in texts]


def test_closure_is_associative():
    scan = bytebpe.Scanner()
    table = scan.compose.reshape(scan.n, scan.n)
    a, b, c = np.meshgrid(*[np.arange(scan.n)] * 3)
    assert (table[table[a, b], c] == table[a, table[b, c]]).all()


def test_odd_rows_and_starts(spark, library):
    rows = [*enumerate(ODD), (None, "a b"), (3, "again"), (3, "again"), (20, "word " * 200_000 + "中" * 1000)]
    got = bytebpe.decode(bytebpe.encode(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in got), key=str) == want
    texts = dict(rows)
    for r in got:
        if r.doc_id not in (None, 3):
            assert r.ids == library(texts[r.doc_id] or "")
            # A range of tokens is a range of bytes.
            raw, half = bytes(r.bytes), len(r.ids) // 2
            if half:
                tail = bytebpe.Vocabulary("byte_bpe_multi_50k.tiktoken") if r.doc_id == 4 else None
                assert tail is None or b"".join(k for i in r.ids[half:] for k, v in tail.ranks.items() if v == i) == raw[r.starts[half] :]
    assert bytebpe.decode(bytebpe.encode(frame(spark, []))).collect() == []


def test_unknown_ids_are_an_error(spark):
    rows = spark.createDataFrame([(1, [0, 50_300], [0, 1])], "doc_id long, ids array<int>, starts array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        bytebpe.decode(rows).collect()
    none = spark.createDataFrame([(1, None, None)], "doc_id long, ids array<int>, starts array<int>")
    assert bytes(bytebpe.decode(none).collect()[0].bytes) == b""


def test_query_equals_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op13_byte_bpe"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library(docs[r.doc_id])
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), docs[r.doc_id].encode())]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digests)

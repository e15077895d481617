"""Packing: every id in exactly one piece, little padding, right checksums."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, start int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, 1) for i, t in rows], SCHEMA)


def library():
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]


def verify(pieces, rows, window=1024, waste=None):
    """`rows`: (id, text) with distinct ids.  Returns ids per sequence."""
    encode = library()
    ids = {i: encode(t) for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length, own))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < window  # only the last sequence is padded
    return {s: sum((own for *_, own in sorted(parts)), []) for s, parts in by_sequence.items()}


def test_query_packs_everything(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    verify(queries.QUERIES["op5_packing"](spark, SMALL).collect(), rows)


def test_combinations_are_used(spark):
    rows = [(i, "word " * (10 + i % 37)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "a " * 5000)]
    packed = packing.pack_documents(frame(spark, rows), window=64)
    made = verify(packed.pieces.collect(), rows, 64)
    uncut = sum(1 for r in packed.pieces.groupBy("row").count().collect() if r["count"] == 1)
    assert uncut > 300
    got = {r.sequence_id: r for r in packed.sequences().collect()}
    assert {s: list(r.ids) for s, r in got.items()} == made
    assert all(r.padded == (r.n if r.n & (r.n - 1) == 0 else 64) for r in got.values())


def test_edges(spark):
    assert packing.pack_documents(frame(spark, [])).pieces.collect() == []
    rows = [(None, "a"), (None, None), (5, "x"), (5, "x")]
    got = packing.pack_documents(frame(spark, rows)).pieces.collect()
    assert len(got) == 4 and {(p.sequence_id, p.length) for p in got} == {(0, 1), (0, 2)}
    rows = [(1, "word " * 300_000), (2, "z" * 200_000)]
    verify(packing.pack_documents(frame(spark, rows)).pieces.collect(), rows)


def test_solution_fits_the_histogram():
    rng = np.random.default_rng(3)
    histogram = np.zeros(1024, np.int64)
    histogram[1:] = rng.poisson(np.linspace(400, 20, 1023))
    made = packing.plan(histogram, 1024)
    used = np.zeros(1024, np.int64)
    np.add.at(used, made.length, made.end - made.first)
    assert (used + made.left == histogram).all() and (made.left >= 0).all()
    assert (made.left * np.arange(1024)).sum() < 0.35 * (histogram * np.arange(1024)).sum()
    # Every slot of every sequence is filled once, and the lengths fill the window.
    filled = defaultdict(int)
    for length, first, end, sequence in zip(made.length, made.first, made.end, made.sequence, strict=True):
        for k in range(end - first):
            filled[sequence + k] += length
    assert len(filled) == made.sequences and set(filled.values()) == {1024}

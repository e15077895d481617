"""Periodic runs against a scan of all lags, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic, queries
from test_tokens import SMALL, frame


def brute(words) -> list[tuple[int, int, int]]:
    """All runs by comparing every word with the one q before it, for every q."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sample(rng) -> list[int]:
    letters, n, words = rng.choice([1, 2, 3, 5]), rng.randint(0, 60), []
    while len(words) < n:
        if rng.random() < 0.5:
            unit = [rng.randrange(letters + 3) for _ in range(rng.randint(1, 6))]
            words += (unit * rng.randint(1, 7))[: rng.randint(1, 40)]
        else:
            words.append(rng.randrange(letters))
    return words


@pytest.mark.parametrize("rounds", [0, 1, 64])
def test_runs_equal_all_lags(monkeypatch, rounds):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng = random.Random(rounds)
    for _ in range(4000):
        words = sample(rng)
        assert periodic.text_runs(np.array(words, np.int32), max(words, default=-1) + 1) == brute(words), words


def test_equal_hashes_are_checked(monkeypatch):
    """With hashes that tell nothing apart, only the comparison of words decides."""
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0))
    rng = random.Random(9)
    for _ in range(1000):
        words = sample(rng)
        got = periodic.text_runs(np.array(words, np.int32), max(words, default=-1) + 1)
        assert got == brute(words), words


def test_splitting_keeps_frequent_words_only():
    words = [0, 1] * 5 + [9] + list(range(20, 30)) + [0, 0, 0, 1, 1, 5, 5, 5]
    assert periodic.surviving(np.array(words), 30) == [(0, 10)]
    assert periodic.surviving(np.zeros(5, int), 1) == []


def test_long_segments_take_linear_steps():
    for words in (np.zeros(100_000, np.int32), np.tile(np.arange(20_000, dtype=np.int32), 5)):
        found = periodic.text_runs(words, int(words.max()) + 1)
        assert found == [(0, 100_000, int(words.max()) + 1)]


def test_words_in_parts(monkeypatch):
    raw = " a  bb\tccc\r\n\x0bd\x0c a b \x1c é ".encode() + b"x" * 100
    whole = periodic.numbered(raw)
    assert whole[1] == re.findall(rb"[^\x20\x09-\x0D]+", raw)[:4] + ["a b".encode(), b"\x1c", "é".encode(), b"x" * 100]
    for part in (1, 2, 3, 7):
        monkeypatch.setattr(periodic, "PART", part)
        ids, words = periodic.numbered(raw)
        assert ids.tolist() == whole[0].tolist() and words == whole[1]


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a " * 7), (4, "a " * 7), (None, "x y " * 4 + "z"), (5, "a A a A a A"),
        (6, "k " * 200_000 + "end"), (7, "w" * 300_000),
    ]
    got = {}
    for r in periodic.periodic_runs(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(7, [(0, 7, 1)], "a")] * 2
    assert got[None] == [(9, [(0, 8, 2)], "x y z")]
    assert got[5] == [(6, [], "a A a A a A")]
    assert got[6] == [(200_001, [(0, 200_000, 1)], "k end")]
    assert got[7] == [(1, [], "w" * 300_000)]
    assert periodic.periodic_runs(frame(spark, [])).collect() == []


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = brute([number[w] for w in words])
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        len(found), *best, best[1] * 1000 // best[2] if found else None,
        *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)],
    )


def test_query_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for r in got:
        assert tuple(r)[1:] == expected(r.doc_id, docs[r.doc_id])


def test_query_of_odd_rows(spark, tmp_path):
    rows = [(i, t) for i in range(40) for t in (None, "", "a", "b c d e f g h")][:80]
    frame(spark, [*rows, (None, "a a a a a a")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, [*((i, *expected(i, t)) for i, t in rows), (None, *expected("1", "a a a a a a"))]))

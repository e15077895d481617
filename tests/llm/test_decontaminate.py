"""Decontamination against a plain dynamic programme over whole documents."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import decontaminate, queries, text

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, items string, edits int, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "i", 1, 2) for i, t in rows], SCHEMA)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain(t):
    return decontaminate.normalised((t or "").encode())[0].tobytes()


def least_edits(item: bytes, text: bytes) -> int:
    """Edits to the nearest stretch of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    chars = np.frombuffer(text, np.uint8)
    for i, c in enumerate(item):
        new = np.minimum(np.r_[i + 1, row[:-1] + (chars != c)], np.r_[row + 1])
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def edited(rng, t: str, n: int) -> str:
    t = list(t)
    for _ in range(n):
        at = rng.integers(0, len(t))
        kind = rng.integers(0, 3)
        t[at : at + (kind != 1)] = [] if kind == 0 else ["abcdefghij"[rng.integers(0, 10)]]
    return "".join(t)


def test_equals_brute_force_around_the_budget(spark):
    rng = np.random.default_rng(4)
    alphabet = np.array(list("abcdefghijklmno    "))
    items = [(k, "".join(rng.choice(alphabet, rng.integers(60, 260)))) for k in range(12)]
    rows = []
    for i in range(120):
        k = i % 12
        allowed = decontaminate.budget(len(plain(items[k][1])))
        t = edited(rng, items[k][1], max(0, allowed + int(rng.integers(-allowed, 4))))
        around = ["".join(rng.choice(alphabet, 200)) for _ in range(2)]
        rows.append((i, around[0] + " " + t + " " + around[1]))
    got = {r.doc_id: set(r.items) for r in decontaminate.contaminations(frame(spark, rows), bench(spark, items)).collect()}
    clean = 0
    for i, t in rows:
        want = {k for k, item in items if least_edits(plain(item), plain(t)) <= decontaminate.budget(len(plain(item)))}
        assert got[i] == want
        clean += not want
    assert 5 < clean < 100


def test_query_finds_what_contains_an_item(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op8_decontaminate"](spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        r, text = got[i], plain(t)
        assert set(r["items"]) >= {k for k, item in items.items() if plain(item) in text}
        assert r.contaminated == bool(r["items"])
        for k, a, b, e in zip(r["items"], r.starts, r.ends, r.edits, strict=True):
            stretch = plain(t[a:b])
            assert least_edits(plain(items[k]), stretch) == e <= decontaminate.budget(len(plain(items[k])))


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(8)
    for _ in range(200):
        item = rng.integers(97, 101, rng.integers(12, 40)).astype(np.uint8)
        data = np.r_[rng.integers(97, 101, 30), item, rng.integers(97, 101, 30)].astype(np.uint8)
        data = np.delete(data, rng.integers(30, 30 + len(item), rng.integers(0, 4)))
        edits = int(rng.integers(0, 6))
        best = least_edits(item.tobytes(), data.tobytes())
        found = decontaminate.align(item, data, -10, len(data), edits)
        assert (found[2] if found else None) == (best if best <= edits else None)
        if found:
            assert least_edits(item.tobytes(), data[found[0] : found[1]].tobytes()) == best


ITEM = "The quick brown fox jumps over the lazy dog, near the river bank, at noon."


@pytest.mark.parametrize("block", [4_000_000, 80])
def test_edges(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontaminate, "PART", 1000)
    items = [(1, ITEM), (2, None), (None, ITEM), (3, ""), (4, "short"), (5, "éÀ straße über die Brücke gegangen"), (6, ITEM), (7, "tencharsss")]
    rows = [
        (1, None),
        (2, ""),
        (3, "x " * 200_000 + ITEM.upper().replace(" ", "  ") + " y" * 200_000),
        (4, "xx ÉÀ--STRASSE! éà Straße, ÜBER die brücke GEGANGEN."),
        (5, ITEM[:40]),
        (6, "short"),
        (7, "tencharsss"),
        (None, ITEM),
        (3, ITEM),
        (3, ITEM),
    ]
    docs = frame(spark, rows)
    got = sorted(((r.doc_id, sorted(r["items"])) for r in decontaminate.contaminations(docs, bench(spark, items)).collect()), key=str)
    want = [(1, []), (2, []), (3, [1, 6]), (3, [1, 6]), (3, [1, 6]), (4, [5]), (5, []), (6, [4]), (7, [7]), (None, [1, 6])]
    assert got == sorted(want, key=str)
    left = decontaminate.drop_contaminated(docs, bench(spark, items))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert decontaminate.contaminations(frame(spark, []), bench(spark, items)).collect() == []
    assert not any(r.contaminated for r in decontaminate.contaminations(docs, bench(spark, [])).collect())
    assert decontaminate.drop_contaminated(docs, bench(spark, [])).count() == len(rows)


@pytest.mark.parametrize("block", [4_000_000, 8])
def test_short_items_occur_as_whole_words(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    items = [(1, "a"), (2, "Ab 1"), (3, "nine byte"), (4, "é"), (5, "???"), (6, "ab 1!")]
    rows = [
        (1, "a"), (2, "ba ab"), (3, "x, ab-1"), (4, "ab 12"), (5, "cab 1"), (6, "the NINE  bytes nine byte"), (7, "É."), (8, "éa à"),
        (9, "a a"), (10, "??? ???"), (11, "nine byt"), (12, "o " * 300_000 + "ab 1"),
    ]
    got = {r.doc_id: r for r in decontaminate.contaminations(frame(spark, rows), bench(spark, items)).collect()}
    words = {k: plain(t).split() for k, t in items}
    for i, t in rows:
        own = plain(t).split()
        want = sorted(k for k, w in words.items() for j in range(len(own)) if w and own[j : j + len(w)] == w)
        assert sorted(got[i]["items"]) == want, (i, t)
        for k, a, b in zip(got[i]["items"], got[i].starts, got[i].ends, strict=True):
            assert plain(t[a:b]) == plain(dict(items)[k])
    assert got[9].starts == [0, 2] and got[12].starts[0] == 600_000


def test_findings_of_long_texts_take_linear_work(monkeypatch):
    """Bytes looked at for offsets grow with the text, not with text times findings."""
    looked = []
    count = np.count_nonzero
    monkeypatch.setattr(np, "count_nonzero", lambda x: looked.append(len(x)) or count(x))
    points = text.Points(np.frombuffer("é ".encode() * 200_000, np.uint8))
    assert [points.before(k) for k in range(0, 600_000, 3000)] == [k // 3 * 2 for k in range(0, 600_000, 3000)]
    assert max(looked) <= text.Points.STEP

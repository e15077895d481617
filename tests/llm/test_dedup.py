"""Exact and near deduplication against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact, idset, near, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, kept boolean, digest string, id int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, False, "x", 1) for i, t in rows], SCHEMA)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for o in {o for x in s for o in at[x] if o < k}:
            both = len(s & sets[o])
            if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                a, b = find(k), find(o)
                parent[max(a, b)] = min(a, b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[find(k)] = min(i, smallest.get(find(k), i))
    return {(i, len(sets[k]), smallest[find(k)], i == smallest[find(k)]) for k, (i, _) in enumerate(rows)}


def got_near(df):
    return {tuple(r) for r in near.near_groups(df).collect()}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_near_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.QUERIES["op3_near_dedup"](spark, folder).collect()}
    assert got == brute(rows)


def test_near_links_that_no_star_sees(spark):
    """Copies with more and more edits: chains, and pairs below the threshold in one bucket."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, 1 + i % 5):
            words[at] = f"e{rng.integers(0, 3 if i % 2 else 10**6)}"
        rows.append((i, " ".join(words)))
    assert got_near(frame(spark, rows)) == brute(rows)


def test_near_blocks(spark, monkeypatch):
    """Blocks of two members give what one block gives."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    rows = []
    for i in range(40):
        words = list(base)
        for at in rng.integers(0, 60, 1 + i % 3):
            words[at] = f"e{rng.integers(0, 4)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near, "BLOCK_MEMBERS", 2)
    assert got_near(frame(spark, rows)) == brute(rows)


def test_near_common_passages_below_the_threshold(spark):
    """Thousands of documents share 80 % of their words: they meet in buckets, and are never compared in pairs."""
    rng = np.random.default_rng(8)
    shared = " ".join(f"s{k}" for k in range(100))
    rows = [(i, shared + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 20))) for i in range(4000)]
    rows += [(4000, rows[7][1] + " z"), (4001, rows[8][1])]
    got = {(r.doc_id, r.component_id) for r in near.near_groups(frame(spark, rows)).collect() if r.doc_id != r.component_id}
    assert got == {(4000, 7), (4001, 8)}


def test_near_edges(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " x"), (9, "x" * 3_000_000)]
    got = got_near(frame(spark, [*rows, (None, "a b"), (None, None)]))
    assert got == brute(rows) | {(None, 1, None, True), (None, 0, None, True)}
    assert got_near(frame(spark, [])) == set()
    twice = near.near_groups(frame(spark, [(4, "a b"), (4, "a b"), (3, "A b")])).collect()
    assert sorted(tuple(r) for r in twice) == [(3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False)]


def test_near_drop_keeps_columns(spark):
    docs = frame(spark, [(4, "a b"), (3, "A b"), (None, "a b"), (5, None)])
    left = near.drop_near(docs)
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {(3, "A b"), (None, "a b"), (5, None)}


def test_near_repeated_ids_are_judged_by_their_text(spark):
    near_a = "a b c d e f g h i j k l m n o p q r s t u v w x"
    docs = frame(spark, [(7, near_a), (7, "something else entirely here"), (3, near_a + " y"), (7, near_a), (9, None)])
    groups = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.near_groups(docs).collect())
    assert groups == [(3, 21, 3), (7, 1, 7), (7, 20, 3), (7, 20, 3), (9, 0, 9)]
    left = sorted(((r.doc_id, r.text) for r in near.drop_near(docs).collect()), key=str)
    assert left == sorted([(3, near_a + " y"), (7, "something else entirely here"), (9, None)], key=str)


def test_large_id_sets_are_joined(spark, monkeypatch):
    rows = [(i, f"w{i % 7} b c d e f {'g' * (i % 5)} h") for i in range(60)] + [(None, "x y"), (None, None)]
    docs = frame(spark, rows)
    want = sorted(map(str, near.drop_near(docs).collect()))
    monkeypatch.setattr(idset, "PROBED", 0)
    assert sorted(map(str, near.drop_near(docs).collect())) == want and len(want) < len(rows)


CLASHING = "doc_id long, text string, __key string, __digest int, __id int, __d int, KEY int, sha int, other_key int, `row` int, upto int"


@pytest.mark.parametrize("drop", [exact.drop_exact, near.drop_near])
def test_stages_keep_columns_of_any_name(spark, monkeypatch, drop):
    rows = [(i, t, "k", *range(8)) for i, t in [(1, "a b"), (2, "a b"), (2, "a b"), (3, None), (4, "x " * 300_000)]]
    docs = spark.createDataFrame(rows, CLASHING)
    for probed in (32, 0):
        monkeypatch.setattr(idset, "PROBED", probed)
        left = drop(docs)
        assert left.columns == docs.columns and all(tuple(r)[2:] == rows[0][2:] for r in left.collect())
        assert {r.doc_id for r in left.collect()} == {2 if drop is exact.drop_exact else 1, 3, 4}


def test_exact_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    got = queries.QUERIES["op10_exact_dedup"](spark, SMALL)
    want = con.execute(queries.ORACLE["op10_exact_dedup"])
    names = [c[0] for c in want.description]
    assert {tuple(r) for r in got.select(*names).collect()} == set(want.fetchall())


def test_exact_heavy_and_light_agree(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 17}") for i in range(600)]
    split = {tuple(r) for r in exact.exact_groups(frame(spark, rows)).collect()}
    monkeypatch.setattr(exact, "HEAVY_SHARE", 2.0)  # nothing is heavy
    assert {tuple(r) for r in exact.exact_groups(frame(spark, rows)).collect()} == split
    assert {(r[0], r[1]) for r in split if r[3]} == {(max(i for i, t in rows if t == x),) * 2 for x in {t for _, t in rows}}


def test_exact_edges(spark):
    rows = [(1, None), (2, ""), (3, "A"), (4, "a"), (5, "a "), (6, "x" * 2_000_000), (None, "a"), (7, "q"), (7, "q"), (None, "z")]
    got = exact.exact_groups(frame(spark, rows)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).digest()
    assert all(bytes(r.digest) in {sha(t) for i, t in rows if i == r.doc_id} for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(2, 2, False)] and by[2] == [(2, 2, True)] and by[3] == [(3, 1, True)]
    assert by[4] == [(4, 2, True)] and by[5] == [(5, 1, True)] and by[6] == [(6, 1, True)]
    assert sorted(by[7]) == [(7, 2, False), (7, 2, True)]
    assert sorted(by[None], key=str) == [(4, 2, False), (None, 1, True)]
    assert exact.exact_groups(frame(spark, [])).collect() == []


def test_exact_drop_keeps_columns(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (7, "q"), (7, "q"), (None, "a"), (None, "z"), (None, "z")]
    docs = frame(spark, rows)
    left = exact.drop_exact(docs)
    assert left.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert kept == sorted([(2, "a"), (4, ""), (7, "q"), (None, "z")], key=str)
    assert exact.drop_exact(frame(spark, [])).count() == 0


def test_exact_is_native(spark):
    docs = frame(spark, [(1, "a"), (2, "a")])
    plan = exact.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert docs.select(F.lit(1)).count() == 2

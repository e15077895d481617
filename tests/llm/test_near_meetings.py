"""pipeline: sets and texts are not sent more often than needed."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

from tidemark.llm import exact, near


def _pairs(rows):
    at = defaultdict(set)
    for r in rows:
        at[r["whole"], r["key"], r["i"], r["j"]].add(r["id"])
    return {p for ids in at.values() for p in combinations(sorted(ids), 2)}


def test_meetings_keep_every_pair_and_send_sets_once(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_MEMBERS", 6)
    meets = {100 + k: [0, 1 + k % 4, 2 + k % 3] for k in range(9)} | {200: list(range(10, 20)), 201: [10, 11]}
    rows = [(s, i, i, 5, min(ids), i % 2, 2 if s == 200 else 1) for s, ids in meets.items() for i in set(ids)]
    rows = [(*r[:5], r[5] if r[6] == 2 else 0, r[6]) for r in rows]
    schema = "shingle long, id long, component long, size int, anchor long, block int, blocks int"
    got = near._meetings(spark.createDataFrame(rows, schema)).collect()
    want = {p for ids in meets.values() for p in combinations(sorted(set(ids)), 2)}
    assert want <= _pairs(got)
    assert sum(r["whole"] for r in got) == 5  # ids 0 to 4, each once instead of once a shingle


def test_few_copies_move_no_texts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "doc_id long, text string")
        left = exact.drop_exact(docs)
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, left.collect())) == [(2, "a"), (3, "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

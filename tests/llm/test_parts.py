"""Components of random graphs and long chains; sets of ids in several files."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import idset
from tidemark.llm.components import components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    links += [(2000, 2001 + i) for i in range(50)] + [(3000, 3000), (3001, 3002), (3002, 3001)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == brute(links)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_id_sets(spark, monkeypatch):
    monkeypatch.setattr(idset, "FILE_IDS", 3)
    held = [5, 5, -7, 0, 1 << 60, None, 11, 12, 13]
    found = idset.IdSet(spark.createDataFrame([(x,) for x in held], "x long"))
    asked = [*range(-10, 20), 1 << 60, None]
    rows = spark.createDataFrame([(x,) for x in asked], "x long").select("x", found.has("x").alias("y")).collect()
    assert {r["x"] for r in rows if r["y"]} == {x for x in held if x is not None} and len(rows) == len(asked)
    empty = idset.IdSet(spark.createDataFrame([], "x long"))
    assert not any(r["y"] for r in spark.createDataFrame([(1,), (None,)], "x long").select(empty.has("x").alias("y")).collect())

"""Thresholds of near-duplicates: the pipeline links from 80 %, with bands enough for it."""

from __future__ import annotations

import corpus_pipeline
import pytest
from test_dedup import shingle_set

from tidemark.llm import near

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def kept_ids(rows, percent):
    """The smallest id of each component, by all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    at, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for o in {o for x in sets[i] for o in at.get(x, ())}:
            both = len(sets[i] & sets[o])
            if 100 * both >= percent * (len(sets[i]) + len(sets[o]) - both):
                a, b = find(i), find(o)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            at.setdefault(x, []).append(i)
    return {i for i in sets if find(i) == i}


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_stage_links_from_80_percent(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = kept_ids(rows, 80)
    assert want != kept_ids(rows, 85)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, folder)
    assert {r.doc_id for r in got.collect()} == want


def test_bands_follow_the_threshold():
    assert near.n_bands(85) == 25
    for percent in (50, 70, 80, 85, 90, 99):
        assert (1 - (percent / 100) ** near.ROWS) ** near.n_bands(percent) <= near.MISS
    assert near.n_bands(100) == 1
    with pytest.raises(ValueError):
        near.n_bands(0)

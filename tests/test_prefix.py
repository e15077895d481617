from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.prefix import CHUNK, running, with_chunk, with_parts
from tidemark.operators.sizing import Sizing

def outputs():
    return {"hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "total": ("sum", F.col("v"))}


def rows(seed: int, n: int = 600):
    rng = random.Random(seed)
    # One key holds a third of all rows, and positions are far from evenly spaced.
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([1, 1, 1, 5000])
        # The hot key is null now and then in a whole run.
        key = (None if seed % 2 else "hot") if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        out.append((key, at, rng.choice([None, rng.randrange(1000)])))
    rng.shuffle(out)
    return out


def expected(data, keyed: bool, inclusive: bool):
    state, want = {}, {}
    for key, at, v in sorted(data, key=lambda r: r[1]):
        k = key if keyed else None
        seen = state.setdefault(k, [])
        before = [x for x in seen if x is not None]
        seen.append(v)
        here = [x for x in seen if x is not None] if inclusive else before
        want[at] = (max(here), min(here), sum(here)) if here else (None, None, None)
    return want


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("rows_per_chunk", [10_000, 37, 5])
def test_running_equals_a_loop(spark, keyed, inclusive, rows_per_chunk):
    data = rows(rows_per_chunk)
    df = spark.createDataFrame(data, "key string, at bigint, v bigint")
    got = running(
        df, ["key"] if keyed else [], "at", outputs(), inclusive=inclusive, size=Sizing(rows_per_chunk=rows_per_chunk)
    )
    assert {r["at"]: (r["hi"], r["lo"], r["total"]) for r in got.collect()} == expected(data, keyed, inclusive)


def test_chunks_split_a_hot_key(spark):
    df = spark.createDataFrame(rows(1), "key string, at bigint, v bigint")
    bounds = Sizing(rows_per_chunk=50).bounded(df, "at").bounds
    assert len(bounds) >= 10
    edges = [float("-inf"), *bounds, float("inf")]
    sizes = [df.filter((F.col("at") >= a) & (F.col("at") < b)).count() for a, b in zip(edges, edges[1:])]
    assert max(sizes) <= 75 and sum(sizes) == 600


def test_known_upper_bound_saves_the_count(spark):
    class Uncountable:
        def count(self):
            raise AssertionError("counted")

    assert Sizing(at_most=10).bounded(Uncountable(), "at").bounds == ()


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("max_chunks", [2, 3, 7])
def test_chunks_of_chunks_equal_a_loop(spark, keyed, inclusive, max_chunks):
    """More rows than chunks whose boundaries the driver may hold."""
    data = rows(4)
    df = spark.createDataFrame(data, "key string, at bigint, v bigint")
    size = Sizing(rows_per_chunk=10, max_chunks=max_chunks)
    got = running(df, ["key"] if keyed else [], "at", outputs(), inclusive=inclusive, size=size)
    assert {r["at"]: (r["hi"], r["lo"], r["total"]) for r in got.collect()} == expected(data, keyed, inclusive)


def test_chunks_of_chunks_hold_few_rows(spark):
    df = spark.createDataFrame(rows(1, 2000), "key string, at bigint, v bigint")
    size = Sizing(rows_per_chunk=20, max_chunks=12)
    parts = size.parts(df)
    assert parts == 9
    cut = with_parts(with_chunk(df, "at", size.bounded(df, "at").bounds), "at", parts)
    found = cut.groupBy(CHUNK).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy(CHUNK).collect()
    assert len(found) > 90 and max(r["n"] for r in found) <= 2 * size.rows_per_chunk
    assert all(a["hi"] < b["lo"] for a, b in zip(found, found[1:]))


def test_no_window_holds_more_carries_than_chunks(spark):
    """The carry over chunks of chunks goes in two levels: within a chunk, then over chunks."""
    df = spark.createDataFrame(rows(1, 300), "key string, at bigint, v bigint")
    plan = running(df, [], "at", outputs(), size=Sizing(rows_per_chunk=10, max_chunks=5))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3 and "__super" in plan

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.histograms import merged, sliding, summary, value_counts
from tidemark.operators.ranks import aggregate_with_ranks, nearest_ranks, ranks_by_running_count, value_at_rank
from tidemark.operators.sizing import Sizing

Q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def rule(values, q):
    values = sorted(values)
    return values[max(0, min(len(values) - 1, math.ceil(q * len(values)) - 1))] if values else None


@pytest.mark.parametrize("n", [1, 2, 3, 20, 99, 100, 101, 333])
def test_both_forms_follow_the_rule(spark, n):
    rng = random.Random(n)
    data = [("hot" if i % 3 else f"g{i % 5}", rng.randrange(50 if n > 50 else 1000)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, v bigint")
    want = {g: {k: rule([v for h, v in data if h == g], q) for k, q in Q.items()} for g in {g for g, _ in data}}
    for got in (
        nearest_ranks(df, ["g"], "v", Q),
        ranks_by_running_count(df, ["g"], "v", Q, size=Sizing(rows_per_chunk=7)),
    ):
        assert {r["g"]: {k: r[k] for k in Q} for r in got.collect()} == want


def test_no_group_and_ends(spark):
    df = spark.createDataFrame([(1,), (100,)], "v bigint")
    assert nearest_ranks(df, [], "v", {"p99": 0.99}).first()["p99"] == 100
    big = Sizing(rows_in_memory=0, rows_per_chunk=1)
    assert nearest_ranks(df, [], "v", {"p0": 0.0, "p99": 0.99}, size=big).first().asDict() == {"p0": 1, "p99": 100}
    assert value_at_rank(df, "v", 1).first()["v"] == 1
    assert value_at_rank(df, "v", 3).first()["v"] is None


LARGE = Sizing(rows_in_memory=0, rows_per_chunk=3)


@pytest.mark.parametrize("data", [[], [(None, None)], [("a", None)], [(None, 3), (None, 1), ("a", 2), (None, 2), (None, 9)] * 4])
@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_the_size_changes_nothing(spark, data, by, kind):
    df = spark.createDataFrame(data, "g string, v bigint").withColumn("v", F.col("v").cast(kind))
    forms = [
        lambda size: nearest_ranks(df, by, "v", Q, size=size),
        lambda size: aggregate_with_ranks(df, by, [F.count("v").alias("n")], {"p": ("v", 0.5)}, size=size),
    ]
    for form in forms:
        small, large = form(Sizing()), form(LARGE)
        assert small.dtypes == large.dtypes
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_value_at_rank_by_ranges(spark):
    values = [7, 7, 7, 1, 2, None, 30, 30, 11, 12, 13, 40]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    known = sorted(v for v in values if v is not None)
    for rank in range(1, 14):
        want = known[rank - 1] if rank <= len(known) else None
        assert value_at_rank(df, "v", rank, size=Sizing(rows_per_chunk=2)).first()["v"] == want


def test_aggregates_with_ranks_agree_in_both_forms(spark):
    rng = random.Random(3)
    data = [(i % 4, rng.choice([None, rng.randrange(99)]), rng.randrange(99)) for i in range(400)] + [(9, None, None)]
    df = spark.createDataFrame(data, "g int, a bigint, b bigint")
    aggs = [F.count("a").alias("n"), F.max("b").alias("m")]
    ranks = {"a50": ("a", 0.5), "a99": ("a", 0.99), "b95": ("b", 0.95)}
    small = aggregate_with_ranks(df, ["g"], aggs, ranks).orderBy("g").collect()
    large = aggregate_with_ranks(
        df, ["g"], aggs, ranks, size=Sizing(rows_in_memory=0, rows_per_chunk=20)
    ).select(*small[0].asDict()).orderBy("g").collect()
    assert [tuple(map(lambda x: None if x is None else float(x), r)) for r in small] == [
        tuple(map(lambda x: None if x is None else float(x), r)) for r in large
    ]


@pytest.mark.parametrize("length, step", [(6, 2), (4, 4), (3, 1)])
def test_histograms_equal_the_samples(spark, length, step):
    rng = random.Random(length)
    data = [(rng.choice("ab"), rng.randrange(60) * 1_000_000 + rng.randrange(1000), rng.randrange(40)) for _ in range(500)]
    data += [("a", None, 3), ("a", 5, None)]
    df = spark.createDataFrame(data, "g string, at bigint, v bigint")
    halves = [value_counts(df.filter(c), ["g"], "at", "v", grain_us=1_000_000) for c in ("v < 20", "v >= 20")]
    windows = sliding(merged(halves, ["g"]), ["g"], length=length, step=step)
    for size in (Sizing(), Sizing(rows_per_chunk=5, max_chunks=3)):
        got = {(r["g"], r["window"]): r for r in summary(windows, ["g", "window"], size=size).collect()}
        want = {}
        for g, at, v in data:
            for w in range(0, 80):
                if None not in (at, v) and w * step - length < at // 1_000_000 <= w * step:
                    want.setdefault((g, w), []).append(v)
        assert got.keys() == want.keys()
        for key, values in want.items():
            assert got[key]["sample_count"] == len(values) and got[key]["max_staleness_ms"] == max(values) / 1000
            assert [got[key][f"{n}_staleness_ms"] for n in Q] == [rule(values, q) / 1000 for q in Q.values()]


def test_empty_histograms(spark):
    df = spark.createDataFrame([], "g string, at bigint, v bigint")
    counts = value_counts(df, ["g"], "at", "v")
    assert summary(sliding(counts, ["g"], length=2, step=1), ["g", "window"]).collect() == []
    with pytest.raises(ValueError):
        sliding(counts, ["g"], length=3, step=2)

"""Whitening against numpy's dense eigenvectors, and exact deviations."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c") for i, v in rows], SCHEMA)


def lattice(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(got, rows, components=16):
    """`rows`: (id, lattice point) of all remaining rows."""
    listed = np.array(sorted({tuple(x) for _, x in rows}))
    n, sums = len(listed), listed.sum(axis=0)
    middle = listed - listed.mean(axis=0)
    values, vectors = np.linalg.eigh(middle.T @ middle / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    k = int((values > 1e-10 * values[0]).sum())
    assert len(got) == k * len(rows)
    want = {}
    for i, x in rows:
        whole = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        want.setdefault(i, []).append((whole, (np.array(x) - sums / n) @ vectors[:, :k] / np.sqrt(values[:k])))
    for r in got:
        whole, projected = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, whole)
        assert abs(abs(r.whitened) - abs(projected[r.component - 1])) < 1e-6
        assert abs(r.explained - values[r.component - 1] / np.var(listed, axis=0).sum()) < 1e-9
        assert r.identity_error < 1e-8


def test_query_equals_dense(spark):
    rows = [(r.vec_id, lattice(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(queries.QUERIES["op11_whitening"](spark, SMALL).collect(), rows)


def test_signs_agree_over_rows(spark):
    got = queries.QUERIES["op11_whitening"](spark, SMALL).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(16)).max() < 1e-8


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 3, 5)]) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (None, rows[1][1])]
    bad = [
        (200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, float("nan"), 2.0, 3.0, 4.0]),
        (204, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]),
    ]
    monkeypatch.setattr(whitening, "PARTS", 2)  # partial sums are added in two steps
    got = whitening.whiten(frame(spark, [*rows, *bad]).repartition(7)).collect()
    check(got, [(i, lattice(v)) for i, v in rows], 5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [float("nan")])]])
def test_no_variance_gives_no_rows(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_large_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None}  # beyond a long
    assert all(math.isfinite(r.whitened) for r in got)


def test_deviations_are_exact():
    base = np.array([1_000_000, 1_000_001])
    x = np.array([[1_000_000, 1_000_005], [1 << 40, 7]])
    for n in (3, 10**6, 10**12):
        sums = [n * 1_000_000 + 1, n * 1_000_002 - 5]
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        assert whitening.deviations(x, n, sums, base) == [w if w < 1 << 63 else None for w in want]


@pytest.mark.parametrize(
    "spectrum",
    [np.linspace(1, 2, 300), np.r_[np.ones(190), np.arange(2.0, 12)], np.arange(5.0), np.ones(100), np.r_[np.zeros(70), np.ones(10)],
     1 / np.arange(1, 401.0) ** 2, np.r_[1e6, np.linspace(1, 1.2, 99)], np.zeros(40)],
)
def test_leading_pairs(spectrum):
    rng = np.random.default_rng(0)
    d = len(spectrum)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (turn * spectrum) @ turn.T
    values, vectors = whitening.leading_pairs(lambda q: a @ q, d, 16)
    top = max(spectrum.max(), 1e-300)
    assert np.abs(values - np.sort(spectrum)[::-1][:16]).max() <= 1e-10 * top
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-10 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10

"""Attempts are counted once per batch, and by chunks only where a message is larger than one."""

from __future__ import annotations

import pytest

from tidemark.operators.quarantine import attempt_runs
from tidemark.operators.sizing import Sizing
from tidemark.streaming.deliveries import DeliveryStore


def test_no_boundaries_without_a_large_message(spark, monkeypatch):
    rows = [(f"m{i % 9}", i, i % 4 == 0) for i in range(36)]
    df = spark.createDataFrame(rows, "message_id string, attempt_ts_us bigint, ok boolean")
    want = sorted(map(tuple, attempt_runs(df).collect()))
    chunked = Sizing(rows_per_chunk=3)
    assert sorted(map(tuple, attempt_runs(df, size=chunked).select(*attempt_runs(df).columns).collect())) == want
    monkeypatch.setattr(Sizing, "bounded", lambda *_: pytest.fail("boundaries worked out for nothing"))
    assert sorted(map(tuple, attempt_runs(df, size=Sizing(rows_per_chunk=5)).collect())) == want


def test_newest_attempt_survives_compaction(spark, tmp_path):
    store = DeliveryStore(spark, str(tmp_path / "d"))
    schema = "message_id string, attempt_ts_us bigint, ok boolean, event string, error string"
    for batch_id, rows in enumerate(([("a", 1, False, "e", "x")], [("a", 5, True, "e", "x"), ("b", 4, False, "e", "x")])):
        store.apply(spark.createDataFrame(rows, schema), batch_id, compact_every=1)
    assert store.newest_attempt() == 5  # of a message that the state has forgotten
    assert sorted(r["attempt"] for r in store.attempts.delta(1).collect()) == [1, 1]

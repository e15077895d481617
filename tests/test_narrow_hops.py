"""What a verdict does not look at is not carried along."""

from __future__ import annotations

from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.operators import markers
from tidemark.plans import documents, verdicts


def test_hops_hand_on_the_position_and_lines_are_not_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(verdicts, "materialized", lambda df, label: kept.append((label, df.columns)) or df)
    hops = verdicts._hops(spark, SMALL, keep=["lsn"])
    assert kept == [("service-log", ["line_no", "record"])]
    assert hops.columns == ["event_id", "lsn", "queue_ms", "processing_ms", "staleness_ms", "passed"]
    assert hops.filter(F.col("lsn").isNull()).isEmpty()


def test_markers_of_few_columns(spark):
    schema = "event_id string, document_id string, op string, commit_lsn string, commit_ts_us bigint, result string, arrival bigint"
    log = spark.createDataFrame([("a", "1", "u", "0/1", 5, "applied", 1), ("a", "1", "u", "0/1", 5, "superseded", 2)], schema)
    assert [tuple(r) for r in markers.marker_state(log, first_outcome=True, columns=["result"]).collect()] == [("a", "applied")]
    wide, narrow = documents.stored_markers(spark, SMALL), documents.stored_markers(spark, SMALL, ["result"])
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.select(*narrow.columns).collect()))

"""A batch is classified once, and markers are read no wider than they are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import resolve
from tidemark.streaming import materialize as streams


def test_documents_and_markers_share_the_classified_batch(spark):
    schema = "key bigint, op string, lsn bigint, seq int, arrival bigint, a struct<v:int>"
    batch = spark.createDataFrame([(1, "u", 5, 0, 1, (1,)), (1, "u", 4, 0, 2, (2,)), (2, "c", 6, 0, 3, None)], schema)
    stored = spark.createDataFrame([(2, (7,), 9, 0, False)], "key bigint, a struct<v:int>, _lsn bigint, _seq int, _deleted boolean")
    changed, judged = resolve.incremental_apply(stored, batch, fields=["a"], judge=DataFrame.persist)
    try:
        assert "InMemory" in changed._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["arrival"], r["result"]) for r in judged.collect()) == [(1, "applied"), (2, "superseded"), (3, "superseded")]
        assert [(r["key"], r["a"][0]) for r in changed.collect()] == [(1, 1)]
    finally:
        judged.unpersist()


def test_newest_commit_and_narrow_markers(spark, tmp_path):
    store = streams.DocumentStore(spark, str(tmp_path / "s"), {})
    assert store.newest_commit() is None
    day = streams.DAY_US
    rows = [(f"e{i}", "1", "u", "0/1", i * day // 2, "applied", i) for i in range(6)]
    store.markers.append(spark.createDataFrame(rows, streams.MARKER_SCHEMA), 0)
    store.markers.append(spark.createDataFrame([(*rows[2][:5], "superseded", 9)], streams.MARKER_SCHEMA), 1)
    for batch_id in (0, 1):
        store.ledger.commit(batch_id)
    assert store.newest_commit() == 5 * day // 2
    narrow = store.current_markers(["event_id", "result"])
    above, _ = narrow._jdf.queryExecution().optimizedPlan().toString().split("Relation", 1)
    assert "max_by" in above and "document_id" not in above
    assert {tuple(r) for r in narrow.collect()} == {(f"e{i}", "superseded" if i == 2 else "applied") for i in range(6)}
    assert store.current_markers(["result"]).columns == ["result"]

"""Events that are settled are not judged at every trigger."""

from __future__ import annotations

from tidemark.operators.visibility import ProbeGrid
from tidemark.streaming import freshness


def test_settled_events_rest(spark, tmp_path, monkeypatch):
    judged, write = [], freshness.materialized

    def counting(df, label):
        out = write(df, label)
        if label == "judged":
            judged.append(sorted(r["event_id"] for r in out.select("event_id").collect()))
        return out

    monkeypatch.setattr(freshness, "materialized", counting)
    store = freshness.FreshnessStore(spark, str(tmp_path / "f"), probes=ProbeGrid(120_000))
    second = 1_000_000
    # The first stays open, so that no other can be forgotten.
    first = [("open", 1, 0, second, None), *[(f"e{i}", 2 + i, 0, second, None) for i in range(3)], *[(f"e{i}", 2 + i, None, None, 2 * second) for i in range(3)], ("late", 9, 0, 60 * second, None)]
    for batch_id, facts in enumerate((first, [("e1", 3, None, None, 70 * second), ("new", 20, 0, 70 * second, None)])):
        store.apply(spark.createDataFrame(facts, freshness.FACT_SCHEMA), batch_id)
    assert judged == [["e0", "e1", "e2", "late", "open"], ["e1", "late", "new", "open"]]
    states = {r["event_id"]: r["state"] for r in store.events.as_of().collect()}
    assert states == {"open": "open", "e0": "settled", "e1": "settled", "e2": "settled", "late": "open", "new": "open"}

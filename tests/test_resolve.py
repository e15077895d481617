from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from model import LOG_SCHEMA, apply_log, as_docs, frame, random_log
from tidemark.operators import markers as mk
from tidemark.operators import resolve
from tidemark.operators.sizing import Sizing

FIELDS = ["a", "b"]


def change(key, op, lsn, arrival, a=None, b=None, seq=0, event_id=None):
    return {
        "event_id": event_id or f"e{arrival}", "key": key, "op": op, "lsn": lsn, "seq": seq,
        "a": a, "b": b, "commit_ts_us": 123, "arrival": arrival,
    }


def documents(spark, log, **options):
    return as_docs(resolve.materialize(frame(spark, log), fields=FIELDS, **options))


def stored(spark, *docs):
    schema = "key bigint, a struct<v:bigint>, b struct<v:bigint>, _lsn bigint, _seq int, _deleted boolean"
    return spark.createDataFrame(list(docs), schema)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("tie", ["first", "last"])
@pytest.mark.parametrize("rows_per_chunk", [10_000, 15])
def test_equals_the_change_by_change_model(spark, seed, tie, rows_per_chunk):
    log = random_log(seed)
    size = Sizing(rows_per_chunk=rows_per_chunk)
    insert_mode = "merge" if seed % 2 else "replace"
    docs, results = apply_log(log, tie, insert_mode)
    judged = resolve.classify_events(frame(spark, log), tie=tie, size=size)
    assert {r["arrival"]: r["result"] for r in judged.collect()} == results
    assert documents(spark, log, tie=tie, insert_mode=insert_mode, size=size) == docs


@pytest.mark.parametrize("seed", range(2))
def test_batches_on_stored_state_equal_the_whole_log(spark, seed):
    log = sorted(random_log(seed + 10), key=lambda r: r["arrival"])
    want, _ = apply_log(log)
    snapshot = stored(spark)
    for lo in range(0, len(log), 50):
        changed, _ = resolve.incremental_apply(snapshot, frame(spark, log[lo : lo + 50]), fields=FIELDS)
        merged = resolve.merge_documents(snapshot, changed).collect()
        snapshot = spark.createDataFrame(merged, snapshot.schema)
    assert as_docs(snapshot) == want


def test_delete_of_unknown_key_leaves_a_bare_tombstone(spark):
    log = [change(7, "d", 0x20, 1)]
    assert documents(spark, log) == {7: {"v": (0x20, 0), "deleted": True}}
    marks = mk.markers(resolve.classify_events(frame(spark, log))).collect()
    assert [(m["document_id"], m["commit_lsn"], m["result"]) for m in marks] == [("7", "0/20", "applied")]


def test_older_update_does_not_touch_newer_document(spark):
    batch = frame(spark, [change(7, "u", 0x20, 1, a=(5,))])
    changed, judged = resolve.incremental_apply(stored(spark, (7, None, None, 0x30, 0, True)), batch, fields=FIELDS)
    assert changed.count() == 0
    assert [r["result"] for r in judged.collect()] == ["superseded"]


def test_partial_update_keeps_the_other_fields(spark):
    batch = frame(spark, [change(7, "u", 0x20, 1, a=(None,))])
    changed, _ = resolve.incremental_apply(stored(spark, (7, (1,), (2,), 0x10, 0, False)), batch, fields=FIELDS)
    assert as_docs(changed) == {7: {"a": None, "b": 2, "v": (0x20, 0), "deleted": False}}


def test_update_on_a_tombstone_revives_with_sent_fields_only(spark):
    log = [change(1, "c", 16, 1, a=(1,), b=(1,)), change(1, "d", 32, 2), change(1, "u", 48, 3, b=(9,))]
    assert documents(spark, log) == {1: {"b": 9, "v": (48, 0), "deleted": False}}


def test_insert_replaces_or_merges(spark):
    log = [change(1, "c", 16, 1, a=(1,), b=(1,)), change(1, "c", 32, 2, a=(2,))]
    assert documents(spark, log) == {1: {"a": 2, "v": (32, 0), "deleted": False}}
    assert documents(spark, log, insert_mode="merge") == {1: {"a": 2, "b": 1, "v": (32, 0), "deleted": False}}


def test_tie_rule_within_one_commit(spark):
    log = [change(1, "c", 16, 1, a=(1,), seq=0), change(1, "u", 16, 2, a=(2,), seq=1)]
    assert documents(spark, log)[1]["a"] == 1
    assert documents(spark, log, tie="last")[1]["a"] == 2


def test_update_before_its_insert(spark):
    log = [change(1, "u", 32, 1, a=(2,)), change(1, "c", 16, 2, a=(1,), b=(1,))]
    assert documents(spark, log) == {1: {"a": 2, "v": (32, 0), "deleted": False}}
    assert documents(spark, log, order="commit") == {1: {"a": 2, "b": 1, "v": (32, 0), "deleted": False}}


def test_commit_order_does_not_depend_on_delivery(spark):
    log = random_log(5)
    want = documents(spark, log, order="commit")
    arrivals = [r["arrival"] for r in log]
    random.Random(1).shuffle(arrivals)
    shuffled = [{**r, "arrival": a} for r, a in zip(log, arrivals)]
    assert documents(spark, shuffled, order="commit") == want


def test_replaying_a_prefix_changes_no_document(spark):
    log = random_log(6)
    last = max(r["arrival"] for r in log)
    again = [{**r, "arrival": r["arrival"] + last + 1} for r in log[:60]]
    assert documents(spark, log + again) == documents(spark, log)


def test_burst_on_one_key(spark):
    log = [change(1, "c", 16, 1, a=(100,), b=(1,))]
    log += [change(1, "u", 16 + 16 * i, 1 + i, a=(1000 + i,), b=(i % 2 == 0,)) for i in range(1, 151)]
    rows = [{**r, "b": (int(r["b"][0]),)} for r in log]
    doc = documents(spark, rows)[1]
    assert (doc["a"], doc["b"], doc["v"][0]) == (1150, 1, 16 + 16 * 150)
    assert mk.marker_state(mk.markers(resolve.classify_events(frame(spark, rows)))).count() == 151


def test_map_fold_equals_typed_fold(spark):
    log = random_log(8)
    df = frame(spark, log)
    judged = resolve.classify_events(df).filter(F.col("result") == "applied")
    pairs = F.array_compact(
        F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f), F.col(f"{f}.v").cast("string"))) for f in FIELDS])
    )
    got = resolve.fold_documents_map(judged.withColumn("after", F.map_from_entries(pairs)))
    want, _ = apply_log(log)
    for r in got.collect():
        doc = want[r["key"]]
        fields = {f: None if doc[f] is None else str(doc[f]) for f in FIELDS if f in doc}
        assert (r["fields"], r["_lsn"], r["_deleted"]) == (fields, doc["v"][0], doc["deleted"])


def test_marker_state_last_and_first_outcome(spark):
    log = [change(1, "c", 16, 1, a=(1,), event_id="x"), change(1, "c", 16, 2, a=(1,), event_id="x")]
    marks = mk.markers(resolve.classify_events(frame(spark, log)))
    assert mk.marker_state(marks).first()["result"] == "superseded"
    assert mk.marker_state(marks, first_outcome=True).first()["result"] == "applied"
    assert resolve.dedupe_events(frame(spark, log)).count() == 1


def test_upsert_expire_and_purge_markers(spark):
    schema = "event_id string, document_id string, op string, commit_lsn string, commit_ts_us bigint, result string, arrival bigint"
    old = spark.createDataFrame([("a", "1", "c", "0/10", 0, "applied", 1), ("b", "1", "u", "0/20", 5, "applied", 2)], schema)
    new = spark.createDataFrame([("a", "1", "c", "0/10", 0, "superseded", 9)], schema)
    merged = {r["event_id"]: r["result"] for r in mk.upsert_markers(old, new).collect()}
    assert merged == {"a": "superseded", "b": "applied"}
    now = 604_800 * 1_000_000 + 5
    assert [r["event_id"] for r in mk.expired_markers(old, now).collect()] == ["a"]
    assert [r["event_id"] for r in mk.purge_markers(old, now + 1).collect()] == []
    assert [r["event_id"] for r in mk.purge_markers(old, now + 1, max_rounds=1, per_round=1).collect()] == ["b"]


def test_projection_of_one_change(spark):
    log = [change(7, "d", 0x20, 1), change(8, "u", 0x30, 2, a=(1,))]
    rows = {r["key"]: r for r in resolve.apply_projection(frame(spark, log), fields=FIELDS).collect()}
    assert (rows[7]["a"], rows[7]["_lsn"], rows[7]["_deleted"]) == (None, "0/20", True)
    assert (rows[8]["a"]["v"], rows[8]["b"], rows[8]["_deleted"]) == (1, None, False)


def test_two_keys_in_one_batch(spark):
    log = [change(7, "c", 0x20, 1, a=(1,)), change(8, "c", 0x21, 2, a=(2,))]
    changed, judged = resolve.incremental_apply(stored(spark), frame(spark, log), fields=FIELDS)
    assert changed.count() == 2 and judged.count() == 2
    assert resolve.duplicate_keys(frame(spark, log), []).count() == 0


def test_log_schema_matches_model(spark):
    assert frame(spark, random_log(0)).schema.names == [c.split()[0] for c in LOG_SCHEMA.split(", ")]

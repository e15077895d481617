from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, gates, metrics, rebuild, resolve, retention
from tidemark.operators.sizing import Sizing
from tidemark.sources import logs

METRICS = "sample_count bigint, p99_staleness_ms double, p99_detection_delay_ms double, violation_count bigint, active_violation_count bigint"


@pytest.mark.parametrize(
    "row, plain, violation",
    [
        ((100, 1000.0, 500.0, 1, 0), None, None),
        ((99, 10.0, 10.0, 1, 0), "too few samples", "too few samples"),
        ((100, 1000.001, None, 1, 1), "p99 staleness over bound", "detection delay over bound"),
        ((100, None, 500.001, 1, 0), "p99 staleness over bound", "detection delay over bound"),
        ((100, 5.0, 5.0, 0, 0), None, "no violation observed"),
    ],
)
def test_slo_gate(spark, row, plain, violation):
    df = spark.createDataFrame([row], METRICS)
    got = gates.slo_gate(df).first()
    assert (got["reason"], got["passed"]) == (plain, plain is None)
    got = gates.slo_gate(df, violation_test=True).first()
    assert (got["reason"], got["passed"]) == (violation, violation is None)


def test_violation_artifact_keeps_unknown_unknown(spark):
    df = spark.createDataFrame([(1, 1.0, None, 0, 0), (1, 1.0, 500.0, 2, 0), (1, 1.0, 501.0, 2, 1)], METRICS)
    got = [(r["violation_detected"], r["detection_within_slo"]) for r in gates.violation_artifact(df).collect()]
    assert got == [(False, None), (True, True), (True, False)]


def test_health_and_alerts(spark):
    schema = "source string, t bigint, active_violation_count bigint, p99_staleness_ms double, replication_ready boolean, probe_ready boolean, dlq_len bigint"
    df = spark.createDataFrame(
        [("s", 1, 0, 10.0, True, True, 3), ("s", 2, 1, 2000.0, True, True, 3), ("s", 3, 0, None, True, False, 5)], schema
    )
    assert [r["status"] for r in metrics.health_status(df).orderBy("t").collect()] == ["ok", "STALE", "unavailable"]
    got = {(r["t"], r["alert"]) for r in gates.alerts(df, ["source"], "t").collect()}
    assert got == {(2, "active_violations"), (2, "p99_staleness"), (3, "probe_not_ready"), (3, "dead_letter_growth")}


def test_run_history_and_capacity_matrix(spark, tmp_path):
    schema = "label string, p50_staleness_ms double, p99_staleness_ms double, max_staleness_ms double, active_violation_count bigint, sample_count bigint, documents bigint, source_rows bigint"
    rows = [(f"capacity-{n}replicas", 1.0, 2.0, 3.0, 0, 10 * n, n, n) for n in (8, 1)] + [("baseline", 1.0, 2.0, 3.0, 0, 1, 1, 1)]
    record = gates.run_record(
        spark.createDataFrame(rows, schema), {"counts": F.struct("documents", "source_rows")}, F.col("label"), F.lit("now")
    )
    gates.append_run_history(record, str(tmp_path / "runs"))
    gates.append_run_history(record.limit(0), str(tmp_path / "runs"))
    back = spark.read.schema(record.schema).json(str(tmp_path / "runs"))
    assert [(r["replicas"], r["samples"]) for r in gates.capacity_matrix(back).collect()] == [(1, 10), (8, 80)]


RUN = "run string, stream_len bigint, sample_count bigint, dlq_len bigint, pending_count bigint, active_violation_count bigint, lag_bytes bigint"
MEASURES = RUN.replace(" bigint", "").replace("run string, ", "").split(", ")


@pytest.mark.parametrize(
    "after, exit_status, want",
    [
        (("r", 15, 25, 2, 0, 0, 5_000_000), 0, True),
        (("r", 15, 25, 2, 0, 0, 5_000_001), 0, False),
        (("r", 15, 24, 2, 0, 0, 0), 0, False),
        (("r", 15, 25, 3, 0, 0, 0), 0, False),
        (("r", 15, 25, 2, 1, 0, 0), 0, False),
        (("r", 15, 25, 2, 0, 1, 0), 0, False),
        (("r", 15, 25, 2, 0, 0, 0), 1, False),
    ],
)
def test_recovery_audit(spark, after, exit_status, want):
    before = spark.createDataFrame([("r", 10, 20, 2, 4, 1, 0)], RUN)
    compared = gates.compare_runs(before, spark.createDataFrame([after], RUN), ["run"], MEASURES)
    runs = compared.withColumns({"writes": F.lit(5), "exit_status": F.lit(exit_status)})
    assert gates.recovery_audit(runs).first()["recovered"] is want


def test_backlog_growth(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, 9), ("s", 3, 8)], "s string, t bigint, n bigint")
    got = gates.backlog_growth(df, ["s"], "t", "n").orderBy("t").collect()
    assert [(r["step"], r["since_start"]) for r in got] == [(None, 0), (4, 4), (-1, 3)]


def test_conservation_and_lag(spark):
    df = spark.createDataFrame([(5, 5, 5), (5, 5, 4)], "writes bigint, log_delta bigint, sample_delta bigint")
    assert [r["conserved"] for r in metrics.conservation(df).collect()] == [True, False]
    slots = spark.createDataFrame(
        [("a", "1/40", "0/FFFFFFC0"), ("b", "1/40", "1/40"), ("a", "1/0", "1/0")],
        "consumer string, head_lsn string, confirmed_lsn string",
    )
    assert {r["consumer"]: r["lag_bytes"] for r in metrics.lag_by_consumer(slots).collect()} == {"a": 0x40, "b": 0}


def test_metrics_long(spark):
    row = (5, 1.0, 2.0, 3.0, 4.0, 0, None, 0, 0, None, 0.0)
    df = spark.createDataFrame([row], ", ".join(f"{c} double" if "ms" in c or "seconds" in c else f"{c} bigint" for c in metrics.EXPOSED_METRICS))
    got = {r["metric"]: (r["kind"], r["value"]) for r in metrics.metrics_long(df).collect()}
    assert len(got) == 11 and got["cdc_staleness_samples_total"] == ("counter", 5.0)
    kind, value = got["cdc_staleness_detection_delay_p99_milliseconds"]
    assert kind == "gauge" and value != value


def test_hop_budget(spark):
    df = spark.createDataFrame([(9_000, 60_000), (11_000, 40_000)], "p bigint, q bigint")
    got = {r["hop"]: r["within_budget"] for r in metrics.hop_latency_summary(df, {"publish": "p", "index": "q"}).collect()}
    assert got == {"publish": False, "index": True}


def test_trim_keeps_newest_and_never_cuts_past_the_reader(spark):
    df = spark.range(1, 101).select((F.col("id") * F.col("id")).alias("arrival"))
    size = Sizing(rows_per_chunk=9)
    assert retention.trim_log(df, 30, size=size).agg(F.min("arrival"), F.count("*")).first()[:] == (71**2, 30)
    assert retention.trim_log(df, 30, keep_from=50**2, size=size).count() == 51
    assert retention.trim_log(df, 100).count() == 100


def test_range_key_and_order(spark):
    df = spark.createDataFrame([(3, 1, 10), (1, 2, 10), (2, 2, 5)], "lsn bigint, arrival bigint, key bigint")
    assert [r["lsn"] for r in retention.commit_order(df).collect()] == [1, 2, 3]
    assert retention.read_range(df, 1).count() == 2
    assert retention.events_for_key(df, 10).count() == 2


def test_backlog_counts(spark):
    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "message_id string")

    got = metrics.backlog(ids("a", "b", "c", "d"), ids("a"), ids("b", "b", "a", "d"), ids("d")).first()
    assert got.asDict() == {"stream_len": 4, "pending_count": 2, "retry_keys": 1, "dlq_len": 1}


def test_reserved_keys(spark):
    df = spark.createDataFrame([(1, {"_Document__doc": "x", "a": "1"}), (2, {"a": "1"})], "key bigint, fields map<string,string>")
    got = {r["key"]: (r["reserved_keys"], r["clean"]) for r in audit.reserved_key_audit(df).collect()}
    assert got == {1: (["_Document__doc"], False), 2: ([], True)}


DOCS = "key bigint, a bigint, _deleted boolean"


def test_convergence(spark):
    source = spark.createDataFrame([(1, 1), (2, None), (3, 3), (5, 5)], "key bigint, a bigint")
    docs = spark.createDataFrame([(1, 1, False), (2, None, False), (3, 4, False), (4, 4, False), (5, 5, True)], DOCS)
    found = audit.convergence(source, docs, ["key"], ["a"])
    assert {r["key"]: r["difference"] for r in found.collect()} == {3: "different", 4: "extra", 5: "missing"}
    report = audit.convergence_report(source, docs, ["key"], ["a"]).first()
    assert (report["source_rows"], report["live_documents"], report["converged"]) == (4, 4, False)
    same = docs.filter("key in (1, 2)")
    assert audit.convergence_report(source.filter("key in (1, 2)"), same, ["key"], ["a"]).first()["converged"]


def test_validate_source_rows(spark):
    rows = [(1, "s1", 5), (2, "s1", -1), (3, None, 0), (3, "s3", 1)]
    df = spark.createDataFrame(rows, "id bigint, sku string, price_cents bigint")
    found = audit.validate_source_rows(df, required=["sku"], non_negative=["price_cents"], unique=["sku", "id"])
    assert sorted((r["id"], r["constraint"]) for r in found.collect()) == [
        (1, "sku is not unique"), (2, "price_cents is negative"), (2, "sku is not unique"),
        (3, "id is not unique"), (3, "id is not unique"), (3, "sku is null"),
    ]


def test_rebuild_from_snapshot_and_tail(spark):
    source = spark.createDataFrame([(1, 10, 1), (2, 20, 2), (3, 30, 3)], "key bigint, a bigint, b bigint")
    tail = spark.createDataFrame(
        [(1, "u", 90, 0, (99,), None), (1, "u", 110, 0, (11,), None), (2, "d", 120, 0, None, None), (4, "c", 130, 0, (4,), None)],
        "key bigint, op string, lsn bigint, seq int, a struct<v:bigint>, b struct<v:bigint>",
    )
    docs = rebuild.rebuild(source, tail, ["key"], ["a", "b"], F.lit(100))
    got = {r["key"]: (r["a"] and r["a"]["v"], r["b"] and r["b"]["v"], r["_lsn"], r["_deleted"]) for r in docs.collect()}
    assert got == {1: (11, 1, 110, False), 2: (None, None, 120, True), 3: (30, 3, 100, False), 4: (4, None, 130, False)}
    assert resolve.live_documents(docs).count() == 3


def test_ordering_audit(spark):
    events = spark.createDataFrame(
        [("a", 1, "c", 16, 0, (1,)), ("b", 1, "u", 32, 0, (2,)), ("c", 2, "c", 16, 0, (5,)), ("d", 3, "d", 16, 0, None)],
        "event_id string, key bigint, op string, lsn bigint, seq int, a struct<v:bigint>",
    )
    marks = spark.createDataFrame(
        [("a", 16, "superseded"), ("b", 32, "applied"), ("c", 16, "applied"), ("d", 16, "superseded")],
        "event_id string, lsn bigint, result string",
    )
    docs = spark.createDataFrame(
        [(1, (2,), 32, False), (2, (4,), 16, False), (3, None, 16, True)],
        "key bigint, a struct<v:bigint>, _lsn bigint, _deleted boolean",
    )
    got = {r["key"]: (r["version_is_newest"], r["payload_is_newest"], r["markers_consistent"], r["passed"])
           for r in audit.ordering_audit(events, marks, docs, ["a"]).collect()}
    assert got == {1: (True, True, True, True), 2: (True, False, True, False), 3: (True, True, False, False)}


def test_lag_rule_holds_for_each_consumer(spark):
    schema = "run int, consumer string, lag_before bigint, lag_after bigint"
    rows = [
        (1, "a", 100, 100 + 5_000_000), (1, "b", None, 0),
        (2, "a", 10**9, 0), (2, "b", 0, 5_000_001),  # one stays behind, though the sum fell
        (3, "a", 0, 0), (3, "b", 0, None),
    ]
    lags = spark.createDataFrame(rows, schema)
    got = {r["run"]: r["lags_recovered"] for r in gates.lag_recovered(lags, ["run"]).collect()}
    assert got == {1: True, 2: False, 3: False}
    runs = spark.createDataFrame(
        [(n, 5, 5, 5, 0, 0, 0, 0) for n in (1, 2, 3, 4)],
        "run int, writes bigint, sample_count_delta bigint, stream_len_delta bigint, dlq_len_delta bigint, "
        "pending_count_after bigint, active_violation_count_after bigint, exit_status int",
    )
    audited = gates.recovery_audit(runs, lags=lags, on=["run"])
    assert {r["run"]: (r["lag_recovered"], r["recovered"]) for r in audited.collect()} == {
        1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False)
    }
    assert "lags_recovered" not in audited.columns


def test_hops_come_from_the_first_readable_line(spark):
    lines = spark.createDataFrame(
        [
            (3, 'svc | {"event":"indexer_event","document_id":"1","commit_lsn":"0/A","stream_queue_latency_ms":7,"batch_processing_ms":2}'),
            (2, 'svc | {"event":"indexer_event","document_id":"1","commit_lsn":"0/A","stream_queue_latency_ms":'),
            (5, 'svc | {"event":"indexer_event","document_id":"1","commit_lsn":"0/A","stream_queue_latency_ms":9,"batch_processing_ms":2}'),
            (6, 'svc | {"event":"staleness_sample","document_id":"1","commit_lsn":"0/A","staleness_ms":1000}'),
            (7, 'svc | {"event":"indexer_event","document_id":"2","commit_lsn":"0/B","stream_queue_latency_ms":"x","batch_processing_ms":1}'),
            (8, 'svc | {"event":"staleness_sample","document_id":"2","commit_lsn":"0/B","staleness_ms":1000.5}'),
        ],
        "line_no bigint, line string",
    )
    said = logs.parse_log_lines(lines)
    events = spark.createDataFrame([("e1", 1, "0/A"), ("e2", 2, "0/B"), ("e3", 3, "0/C")], "event_id string, key bigint, commit_lsn string")
    hops = audit.hop_latencies(events, logs.log_records(said, "indexer_event"), logs.log_records(said, "staleness_sample"))
    got = {r["event_id"]: tuple(r)[1:] for r in hops.collect()}
    assert got == {"e1": (7.0, 2.0, 1000.0, True), "e2": (None, 1.0, 1000.5, False), "e3": (None, None, None, False)}


def test_counts_join_the_snapshot_pass(spark):
    schema = "g string, k int, commit_ts_us bigint, visible_ts_us bigint, rejected_ts_us bigint, violation_ts_us bigint, staleness_us bigint, detection_delay_us bigint"
    rows = [("a", 1, 0, 5, None, None, 5, None), ("a", 1, 1, None, None, None, None, None), ("b", 2, 0, 9, None, None, 9, None)]
    obs = spark.createDataFrame(rows, schema)
    counts = {"keys": ("k", F.count_distinct("k")), "rows": ("k", F.count(F.lit(1)))}
    for size in (Sizing(), Sizing(rows_in_memory=0, rows_per_chunk=1)):
        got = metrics.metrics_snapshot(obs, 10, ["g"], counts=counts, size=size)
        assert {r["g"]: (r["keys"], r["rows"], r["sample_count"]) for r in got.collect()} == {"a": (1, 2, 1), "b": (1, 1, 1)}
    with pytest.raises(ValueError):
        metrics.metrics_snapshot(obs, 10, counts=counts, sample_window=3)

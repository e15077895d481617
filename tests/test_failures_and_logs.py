from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from model import apply_log, as_docs, frame, random_log
from tidemark.operators import quarantine, resolve
from tidemark.operators.sizing import Sizing
from tidemark.sources import changelog, logs

DELIVERIES = "message_id string, attempt_ts_us bigint, ok boolean, event string, error string"


def attempts(spark, pattern, rows_per_chunk=10_000):
    data = [(m, 10 * i, c == "o", "{}", "boom") for m, marks in pattern.items() for i, c in enumerate(marks, 1)]
    # Times must differ within a message only; shift messages so that they interleave.
    data = [(m, at + ord(m[0]) % 7, ok, e, x) for m, at, ok, e, x in data]
    return quarantine.delivery_attempts(spark.createDataFrame(data, DELIVERIES), size=Sizing(rows_per_chunk=rows_per_chunk))


def test_fifth_failure_is_quarantined_and_success_clears(spark):
    counted = attempts(spark, {"a": "fffff", "b": "ffff", "c": "fffofffff", "d": "ffffo"})
    dead = {r["source_message_id"]: r for r in quarantine.dead_letters(counted, "cdc_events").collect()}
    assert set(dead) == {"a", "c"}
    assert dead["a"]["attempts"] == 5 and dead["a"]["source_stream"] == "cdc_events" and dead["a"]["event"] == "{}"
    assert quarantine.dead_letters(counted, "cdc_events", max_attempts=4).count() == 4


def test_attempts_in_chunks(spark):
    rng = random.Random(1)
    pattern = {f"{c}{i}": "".join(rng.choice("ffo") for _ in range(rng.randrange(1, 40))) for i, c in enumerate("abcdef")}
    key = lambda df: sorted((r["message_id"], r["attempt_ts_us"], r["attempt"]) for r in df.collect())
    assert key(attempts(spark, pattern)) == key(attempts(spark, pattern, 6))


def test_reclaimable(spark):
    rows = [("1-0", 0), ("2-0", 5_000_000), ("3-0", 29_000_000), ("4-0", 0)]
    tried = spark.createDataFrame(rows, "message_id string, attempt_ts_us bigint")
    acked = spark.createDataFrame([("4-0",)], "message_id string")
    now = 35_000_000
    assert {r["message_id"] for r in quarantine.reclaimable(tried, acked, now).collect()} == {"1-0", "2-0"}
    assert quarantine.reclaimable(tried, acked, now, count=1).count() == 1
    assert quarantine.reclaimable(tried, acked, 1_000).count() == 0


def test_report_by_reason(spark):
    rows = [("decode: x", 1), ("batch-level failure", 2), ("boom", 3), ("boom", 4)]
    dead = spark.createDataFrame(rows, "error string, failed_ts_us bigint")
    got = {r["reason"]: r["dead_letters"] for r in quarantine.dead_letter_report(dead).collect()}
    assert got == {"decode_error": 1, "batch_error": 1, "processing": 2}


def envelope(**over):
    base = {
        "event_id": "e", "op": "u", "pk": {"id": 7}, "after": {"id": 7, "name": None}, "commit_lsn": "0/20",
        "commit_ts_us": 123,
    }
    base.update(over)
    return {k: v for k, v in base.items() if v != "gone"}


CASES = {
    "valid": json.dumps(envelope()),
    "decode_error": '{"event_id": "e", ',
    "decode_error2": json.dumps(envelope()) + " extra",
    "decode_error3": json.dumps(envelope()) + json.dumps(envelope()),
    "decode_error4": "not json",
    "missing pk.id": json.dumps(envelope(pk={})),
    "missing pk.id2": json.dumps(envelope(pk="gone")),
    "missing commit_lsn": json.dumps(envelope(commit_lsn="gone")),
    "unreadable commit_lsn": json.dumps(envelope(commit_lsn="zz")),
    "missing event_id": json.dumps(envelope(event_id=None)),
    "missing commit_ts_us": json.dumps(envelope(commit_ts_us="gone")),
    "missing op": json.dumps(envelope(op="x")),
}


def test_malformed_deliveries_are_set_apart(spark):
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(CASES.items())], changelog.LOG_SCHEMA)
    good, bad = quarantine.split_valid(changelog.parse_events(df))
    assert [r["message_id"] for r in good.collect()] == ["valid"]
    assert all(r["message_id"].rstrip("234") == r["reason"] for r in bad.collect()) and bad.count() == len(CASES) - 1
    flat = changelog.flatten_events(good, {"name": "string", "other": "string"}).first()
    assert (flat["key"], flat["lsn"], flat["name"], flat["other"]) == (7, 0x20, (None,), None)


def test_unreadable_keys_and_values_have_a_reason(spark):
    cases = {
        "fine": envelope(pk={"id": "7"}, after={"id": "7", "n": "5"}),
        "null": envelope(pk={"id": "7"}, after={"id": "7", "n": None}),
        "text key": envelope(pk={"id": "SKU-7"}, after={"id": "SKU-7"}),
        "bad value": envelope(pk={"id": "7"}, after={"id": "7", "n": "abc"}),
    }
    rows = [(k, i, json.dumps(v)) for i, (k, v) in enumerate(cases.items())]
    parsed = changelog.parse_events(spark.createDataFrame(rows, changelog.LOG_SCHEMA))
    good, bad = quarantine.split_valid(parsed, {"n": "bigint"}, "bigint")
    assert {r["message_id"] for r in good.collect()} == {"fine", "null"}
    assert {r["message_id"]: r["reason"] for r in bad.collect()} == {"text key": "unreadable pk.id", "bad value": "unreadable n"}
    good, _ = quarantine.split_valid(parsed, {"n": "bigint"})
    keys = changelog.flatten_events(good, {"n": "bigint"}, key_type="string").collect()
    assert {r["key"] for r in keys} == {"7", "SKU-7"}


def test_reclaim_takes_the_oldest_by_number(spark):
    deliveries = spark.createDataFrame([("10-0", 1), ("9-5", 1), ("9-0", 1), ("9-12", 1)], "message_id string, attempt_ts_us bigint")
    none = spark.createDataFrame([], "message_id string")
    first = quarantine.reclaimable(deliveries, none, 10**9, count=3).collect()
    assert [r["message_id"] for r in first] == ["9-0", "9-5", "9-12"]


def test_log_survives_json_and_files(spark, tmp_path):
    log = random_log(3)
    df = frame(spark, log).withColumns({"xid": F.col("lsn"), "message_id": F.col("event_id")})
    text = df.withColumn("event", changelog.envelope_json(F.col("commit_ts_us") + 1, ["a", "b"]))
    assert all(json.loads(r["event"]) for r in text.collect())
    changelog.write_change_log(text.withColumn("day", F.lit(1)), str(tmp_path / "log"), by_day=True)
    good, bad = quarantine.split_valid(changelog.read_change_log(spark, str(tmp_path / "log")))
    assert bad.count() == 0
    back = changelog.flatten_events(good, {"a": "bigint", "b": "bigint"})
    assert as_docs(resolve.materialize(back, fields=["a", "b"])) == apply_log(log)[0]


def test_replay_is_idempotent(spark):
    log = random_log(4)
    df = frame(spark, log)
    again = quarantine.replay(df, df.filter(F.col("key") == 0))
    assert again.count() == len(log) + sum(r["key"] == 0 for r in log)
    assert as_docs(resolve.materialize(again, fields=["a", "b"])) == apply_log(log)[0]


LINES = [
    'svc-1 | {"event":"indexer_event","document_id":"7","n":1}', "no json here", 'x {"broken":', '{"event":"VIOLATION","pk":"7"}',
    'svc {"a":1} tail', "tok-secret-1 and tok-secret-1 again, short", "",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, line string")


def python_records():
    out = []
    for line in LINES:
        at = line.find("{")
        if at >= 0:
            try:
                out.append(json.loads(line[at:]))
            except json.JSONDecodeError:
                pass
    return out


def test_json_log_lines(lines):
    got = logs.parse_log_lines(lines).orderBy("line_no").collect()
    assert [r["record"] for r in got] == [{k: str(v) for k, v in r.items()} for r in python_records()]
    assert logs.log_records(logs.parse_log_lines(lines), "indexer_event", match={"document_id": "7"}).count() == 1
    assert logs.log_records(logs.parse_log_lines(lines), "indexer_event", match={"document_id": "8"}).count() == 0


def test_read_json_logs_from_text(spark, tmp_path, lines):
    lines.select("line").write.text(str(tmp_path / "t"))
    assert logs.read_json_logs(spark, str(tmp_path / "t")).count() == len(python_records())


def test_excerpt_and_masking(lines):
    got = logs.log_excerpt(lines, ["VIOLATION", "svc"], "line_no", limit=2)
    assert [r["line_no"] for r in got.collect()] == [0, 3]
    settings = {"OPS_TOKEN": "tok-secret-1", "API_KEY": "short", "NAME": "indexer_event"}
    assert logs.secret_values(settings) == ["tok-secret-1"]
    masked = logs.mask_secrets(lines, "line", settings)
    assert masked.filter("line_no = 5").first()["line"] == "[REDACTED] and [REDACTED] again, short"
    assert logs.leaked_secrets(lines, "line", settings).count() == 1
    assert logs.leaked_secrets(masked, "line", settings).count() == 0


def test_dead_letters_are_appended(spark, tmp_path):
    dead = quarantine.dead_letters(attempts(spark, {"a": "fffff"}), "cdc_events")
    for _ in range(2):
        changelog.write_dead_letters(dead, str(tmp_path / "dead"), quarantine.DEAD_LETTER_COLUMNS)
    back = spark.read.parquet(str(tmp_path / "dead"))
    assert back.columns == quarantine.DEAD_LETTER_COLUMNS and back.count() == 2


def test_source_snapshot_takes_one_source(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "rows"))
    assert changelog.read_source_snapshot(spark, str(tmp_path / "rows")).count() == 3
    with pytest.raises(ValueError):
        changelog.read_source_snapshot(spark)
    with pytest.raises(ValueError):
        changelog.read_source_snapshot(spark, "x", jdbc={"url": "jdbc:none"})

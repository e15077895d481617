from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from model import apply_log, as_docs, frame, random_log
from tidemark.operators import markers as mk
from tidemark.operators import metrics, resolve, visibility
from tidemark.sources import changelog
from tidemark.sources.tables import BatchLedger, VersionedTable
from tidemark.streaming import materialize as streams
from tidemark.streaming.deliveries import DeliveryStore
from tidemark.streaming.freshness import FACT_SCHEMA, FreshnessStore

TYPES = {"a": "bigint", "b": "bigint"}


def log_text(spark, log):
    df = frame(spark, log).withColumns({"xid": F.col("lsn"), "message_id": F.col("arrival").cast("string")})
    text = df.withColumn("event", changelog.envelope_json(F.col("commit_ts_us") + 1, ["a", "b"]))
    return text.select("message_id", "arrival", "event").coalesce(1)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    log = sorted(random_log(21), key=lambda r: r["arrival"])
    path, state = str(tmp_path / "log"), str(tmp_path / "store")
    want, results = apply_log(log)

    def drain():
        store = streams.DocumentStore(spark, state, TYPES)
        parsed = changelog.stream_change_log(spark, path, files_per_trigger=1)
        streams.stream_materialize(parsed, store, str(tmp_path / "ck"), available_now=True).awaitTermination()
        return store

    for lo in (0, 40, 80):
        changelog.write_change_log(log_text(spark, log[lo : lo + 40]), path)
    drain()
    broken = spark.createDataFrame([("bad", 10**6, "{oops")], changelog.LOG_SCHEMA)
    changelog.write_change_log(log_text(spark, log[120:]).unionByName(broken).coalesce(1), path)
    store = drain()
    assert as_docs(store.current_documents()) == want
    assert store.ledger.last() == 3
    batch = mk.marker_state(mk.markers(resolve.classify_events(frame(spark, log))))
    key = lambda df: sorted((r["event_id"], r["result"], r["arrival"]) for r in df.collect())
    assert key(store.current_markers()) == key(batch)
    assert [(r["message_id"], r["error"]) for r in store.current_failures().collect()] == [("bad", "decode_error")]


def test_a_batch_done_twice_changes_nothing(spark, tmp_path):
    log = sorted(random_log(22), key=lambda r: r["arrival"])
    store = streams.DocumentStore(spark, str(tmp_path / "store"), TYPES)
    parts = [changelog.parse_events(log_text(spark, log[i : i + 70])) for i in (0, 70)]
    store.apply(parts[0], 0)
    store.apply(parts[1], 1)
    want = as_docs(store.current_documents())
    store.apply(parts[1], 1)
    assert as_docs(store.current_documents()) == want == apply_log(log[:140])[0]

    # A crash between the documents and the ledger entry: the batch is decided again, equally.
    half = streams.DocumentStore(spark, str(tmp_path / "half"), TYPES)
    half.apply(parts[0], 0)
    half.ledger = BatchLedger(spark, str(tmp_path / "lost"))
    half.ledger.commit(0)
    half.apply(parts[1], 1)
    again = streams.DocumentStore(spark, str(tmp_path / "half"), TYPES)
    assert again.ledger.last() == 0
    again.apply(parts[1], 1)
    assert as_docs(again.current_documents()) == want


def test_compaction_keeps_the_state(spark, tmp_path):
    log = sorted(random_log(23), key=lambda r: r["arrival"])
    store = streams.DocumentStore(spark, str(tmp_path / "store"), TYPES)
    for batch_id, lo in enumerate(range(0, len(log), 30)):
        store.apply(changelog.parse_events(log_text(spark, log[lo : lo + 30])), batch_id, compact_every=2)
    assert as_docs(store.current_documents()) == apply_log(log)[0]
    # What the last base replaced is gone, and so are old ledger entries.
    last = store.ledger.last()
    held = {p.name for p in (tmp_path / "store" / "documents").rglob("version=*")}
    assert min(int(n.split("=")[1]) for n in held) >= last - last % 2
    assert len(list((tmp_path / "store" / "ledger").glob("batch=*"))) <= 2


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v bigint").schema
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], schema)
    table.append(spark.createDataFrame([(f"key{i}", i) for i in range(100)], schema), 0)
    only = spark.createDataFrame([("key7",), ("none",)], "k string")
    found = table.as_of(0, only=only)
    assert [tuple(r) for r in found.collect()] == [("key7", 7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "bucket" in pruned.split("PartitionFilters")[1]


def test_text_keys_retries_and_expiry(spark, tmp_path):
    store = streams.DocumentStore(spark, str(tmp_path / "store"), TYPES, key_type="string")

    def deliver(batch_id, rows):
        log = spark.createDataFrame(rows, changelog.LOG_SCHEMA)
        store.apply(changelog.parse_events(log), batch_id)

    def event(key, lsn, ts, **after):
        return json.dumps({"event_id": f"e{lsn}", "op": "u", "pk": {"id": key}, "after": after, "commit_lsn": f"0/{lsn:X}", "commit_ts_us": ts})

    deliver(0, [("m1", 1, event("SKU-7", 1, 100, a="5")), ("m2", 2, event("SKU-8", 2, 200, a="x")), ("m3", 3, "{")])
    deliver(1, [("m2", 4, event("SKU-8", 2, 200, a="x")), *[("m3", 5 + i, "{") for i in range(4)], ("m4", 9, event("SKU-7", 3, 300, b="1"))])
    assert {r["key"]: (r["a"], r["b"]) for r in store.current_documents().collect()} == {"SKU-7": ((5,), (1,))}
    dead = store.current_dead_letters("s").collect()
    assert [(r["source_message_id"], r["error"], r["attempts"], r["failed_arrival"]) for r in dead] == [("m3", "decode_error", 5, 8)]
    store.expire_markers(250)
    assert [r["event_id"] for r in store.current_markers().collect()] == ["e3"]


def test_empty_table_and_ledger(spark, tmp_path):
    schema = spark.createDataFrame([], "k bigint, v string").schema
    table = VersionedTable(spark, str(tmp_path / "none"), ["k"], schema)
    assert table.as_of().count() == 0 and BatchLedger(spark, str(tmp_path / "no")).last() == -1
    table.append(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    table.append(spark.createDataFrame([(1, None)], schema), 1)
    assert sorted(table.as_of().collect()) == sorted([(1, None), (2, "b")], key=lambda r: r[0])
    assert changelog.lookup(table.as_of(0), "k", 1).first()["v"] == "a"
    assert changelog.lookup(table.as_of(0), "k", 9).first() is None


def test_stream_stream_breaches(spark, tmp_path):
    c, m = str(tmp_path / "c"), str(tmp_path / "m")
    commits = "event_id string, lsn bigint, s double"
    rows = [("ok", 1, 0.0), ("late", 2, 1.0), ("never", 3, 2.0), ("edge", 4, 3.0), ("wrong", 5, 4.0), ("end", 0, 9e6)]
    marks = [("ok", 1, 0.5), ("late", 2, 2.5), ("edge", 4, 4.0), ("wrong", 6, 4.1), ("end", 0, 9e6)]
    for data, path, time in ((rows, c, "commit_time"), (marks, m, "marker_time")):
        df = spark.createDataFrame(data, commits)
        df.select("event_id", "lsn", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias(time)).write.parquet(path)
    source = lambda p, t: spark.readStream.schema(f"event_id string, lsn bigint, {t} timestamp").parquet(p)
    streams.stream_violations(
        source(c, "commit_time"), source(m, "marker_time"), str(tmp_path / "out"), str(tmp_path / "ck")
    ).awaitTermination()
    got = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got - {"end"} == {"late", "never", "wrong"}


def test_first_deliveries_and_guard_stream(spark, tmp_path):
    rows = [("a", 1), ("a", 1), ("b", 2)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "event_id string, s bigint").select(
        "event_id", (F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).alias("commit_time")
    ).unionByName(
        spark.createDataFrame([("old",)], "event_id string").withColumn("commit_time", F.current_timestamp() - F.expr("INTERVAL 2 DAYS"))
    ).write.parquet(src)
    stream = spark.readStream.schema("event_id string, commit_time timestamp").parquet(src)
    guarded = streams.within_guard(stream).dropDuplicatesWithinWatermark(["event_id"])
    query = (
        guarded.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    plain = streams.first_deliveries(stream, "commit_time")
    assert plain.isStreaming and plain.columns == ["event_id", "commit_time"]


def test_metrics_per_trigger(spark, tmp_path):
    schema = "event_id string, lsn bigint, seq int, commit_ts_us bigint, visible_ts_us bigint, rejected_ts_us bigint, violation_ts_us bigint, staleness_us bigint, detection_delay_us bigint"
    obs = spark.createDataFrame([("a", 1, 0, 0, 500, None, None, 500, None)], schema)
    body = streams.metrics_batch(lambda batch: batch, str(tmp_path / "m"))
    body(obs, 0)
    body(obs, 1)
    body(obs, 1)
    back = spark.read.parquet(str(tmp_path / "m"))
    assert [r["sample_count"] for r in back.collect()] == [1, 1]
    assert metrics.metrics_snapshot(obs, 10).first()["in_flight_count"] == 1


def test_buckets_split_as_the_table_grows(spark, tmp_path):
    """A batch of few keys reads only the files that may hold them, in tables of any size."""
    schema = spark.createDataFrame([], "k string, v bigint").schema
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], schema, rows_per_bucket=50)
    rows = [(f"key{i}", i) for i in range(3000)]
    table.append(spark.createDataFrame(rows, schema), 0, at_most=3000)
    table.append(spark.createDataFrame([("key7", -7), ("new", 1)], schema), 1, at_most=2)
    assert [table.depth_for(n) for n in (0, 50, 51, 100, 101, 3000)] == [0, 0, 1, 1, 2, 6]

    def files(df) -> int:
        return len(df.select(F.input_file_name()).distinct().collect())

    every = files(spark.read.parquet(str(tmp_path / "t")))
    wanted = spark.createDataFrame([("key7",), ("key8",), ("none",)], "k string")
    read = table._touched(table._needed(1), wanted)
    assert every > 40 and files(read) <= 4
    assert sorted(map(tuple, table.as_of(1, only=wanted).collect())) == [("key7", -7), ("key8", 8)]
    plan = table.as_of(1, only=wanted)._jdf.queryExecution().executedPlan().toString()
    pruned = next(x for x in plan.splitlines() if "PartitionFilters" in x).split("PartitionFilters")[1]
    assert "depth" in pruned
    table.compact(1)
    assert files(table._touched(table._needed(1), wanted)) <= 3
    assert table.as_of().count() == 3001
    table.vacuum(1)
    assert sorted(p.name for p in (tmp_path / "t").glob("kind=*/version=*")) == ["version=1"]
    assert table.as_of().count() == 3001


def test_vacuum_can_keep_bases_for_readers(spark, tmp_path):
    schema = spark.createDataFrame([], "k bigint, v bigint").schema
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], schema)
    for version in range(6):
        table.append(spark.createDataFrame([(version % 2, version)], schema), version)
        if version % 2:
            table.compact(version)
    old = table.as_of(3)
    table.vacuum(5, bases=2)
    assert sorted(map(tuple, old.collect())) == [(0, 2), (1, 3)]
    table.vacuum(5)
    assert sorted(map(tuple, table.as_of().collect())) == [(0, 4), (1, 5)]


def test_markers_expire_by_day(spark, tmp_path):
    day = streams.DAY_US
    schema = streams.MARKER_SCHEMA
    store = streams.DocumentStore(spark, str(tmp_path / "s"), TYPES)

    def marker(i, at, result="applied"):
        return (f"e{i:02}", "1", "u", "0/1", at, result, i)

    rows = [marker(i, i * day // 4) for i in range(20)]  # four a day
    store.markers.append(spark.createDataFrame(rows, schema), 0)
    store.markers.append(spark.createDataFrame([marker(1, day // 4, "superseded"), marker(9, 9 * day // 4)], schema), 1)
    for batch in (0, 1):
        store.ledger.commit(batch)

    def held():
        return sorted(r["event_id"] for r in store.current_markers().collect())

    def touched():
        return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "s" / "markers").rglob("*.parquet")}

    # Two days and a half are older; a run of six takes day 0 whole and two of day 1.
    cutoff = 10 * day // 4
    assert store.expire_markers(cutoff, max_markers=6) == 6
    assert held() == [f"e{i:02}" for i in range(6, 20)]
    before = touched()
    assert not [p for p in before if "part=0/" in p]
    assert store.expire_markers(cutoff) == 4
    assert held() == [f"e{i:02}" for i in range(10, 20)]
    after = touched()
    # Other days are not written again.
    assert all(after[p] == t for p, t in before.items() if "part=3" in p or "part=4" in p)
    assert store.expire_markers(cutoff) == 0 and held() == [f"e{i:02}" for i in range(10, 20)]


def test_batches_count_their_work(spark, tmp_path):
    log = sorted(random_log(25), key=lambda r: r["arrival"])
    store = streams.DocumentStore(spark, str(tmp_path / "store"), TYPES)
    for batch_id, lo in enumerate((0, 60, 60, 120)):
        store.apply(changelog.parse_events(log_text(spark, log[lo : lo + 60])), batch_id if batch_id < 2 else batch_id - 1, compact_every=1)
    got = {r["batch_id"]: tuple(r)[1:] for r in store.batch_metrics().collect()}
    judged = {r["arrival"]: r["result"] for r in resolve.classify_events(frame(spark, log[:180])).collect()}
    for batch_id, lo in enumerate((0, 60, 120)):
        part = [judged[r["arrival"]] for r in log[lo : lo + 60]]
        assert got[batch_id] == (len(part), part.count("applied"), len(part))


def _attempts(rows):
    """Attempt numbers by a loop."""
    count, out = {}, []
    for m, at, ok in sorted(rows, key=lambda r: r[1]):
        failed = count.get(m, 0) + (not ok)
        out.append((m, at, ok, failed))
        count[m] = 0 if ok else failed
    return sorted(out)


def test_delivery_state_across_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"{rng.randrange(12)}-0", at, rng.random() < 0.3) for at in range(0, 400_000_000, 1_000_000)]
    store = DeliveryStore(spark, str(tmp_path / "d"))
    schema = "message_id string, attempt_ts_us bigint, ok boolean, event string, error string"
    cuts = [0, 37, 150, 151, 300, 400]
    for batch_id, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame([(*r, "e", "x") for r in rows[a:b]], schema)
        store.apply(part, batch_id, compact_every=2)
        store.apply(part, batch_id)  # done twice, counted once
    got = store.current_attempts().select("message_id", "attempt_ts_us", "ok", "attempt").collect()
    want = _attempts(rows)
    assert sorted(map(tuple, got)) == want
    last = {m: (at, ok, n) for m, at, ok, n in sorted(want, key=lambda r: r[1])}
    pending = {r["message_id"]: (r["delivered_ts_us"], r["attempts"]) for r in store.pending().collect()}
    assert pending == {m: (at, n) for m, (at, ok, n) in last.items() if not ok}
    now = 400_000_000
    idle = [r["message_id"] for r in store.reclaimable(now, idle_ms=10_000, count=2).collect()]
    assert idle == sorted((m for m, (at, _) in pending.items() if now - at >= 10_000_000), key=lambda m: int(m.split("-")[0]))[:2]
    dead = {(r["source_message_id"], r["failed_ts_us"]) for r in store.current_dead_letters("s", max_attempts=3).collect()}
    assert dead == {(m, at) for m, at, ok, n in want if not ok and n == 3}


def test_freshness_across_triggers(spark, tmp_path):
    """Each trigger's row equals the snapshot of all that was told by then."""
    rng = random.Random(8)
    second = 1_000_000
    commits, marks = [], []
    for i in range(160):
        at = i * 3 * second + rng.randrange(second)
        commits.append((f"e{i}", 100 + i // 2, i % 2, at))
        if i < 90 or i % 9:
            marks.append((f"e{i}", 100 + i // 2 + (i > 60 and i % 13 == 5), at + rng.randrange(40 * second)))
    told = [(i, lsn, seq, at, None) for i, lsn, seq, at in commits] + [(i, lsn, None, None, at) for i, lsn, at in marks]
    told.sort(key=lambda r: r[3] or r[4])
    # Markers of some events come before their commits are told.
    told[20:60] = rng.sample(told[20:60], 40)
    grid = visibility.ProbeGrid(120_000)
    store = FreshnessStore(spark, str(tmp_path / "f"), probes=grid, sample_window=25)
    cuts, now = [0, 1, 30, 45, 46, 200, len(told)], 0
    for batch_id, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(told[a:b], FACT_SCHEMA)
        store.apply(part, batch_id, compact_every=2)
        if batch_id == 2:
            store.apply(part, batch_id)  # done twice, told once
        now = max(now, *(r[3] or r[4] for r in told[a:b]))
        known_c = spark.createDataFrame([r[:4] for r in told[:b] if r[3] is not None], "event_id string, lsn bigint, seq int, commit_ts_us bigint")
        known_m = spark.createDataFrame([(r[0], r[1], r[4]) for r in told[:b] if r[4] is not None], "event_id string, lsn bigint, marker_ts_us bigint")
        obs = visibility.observations(known_c, known_m, grid)
        want = metrics.metrics_snapshot(obs, now, sample_window=25).first().asDict()
        got = store.history().filter(F.col("batch") == batch_id).first().asDict()
        assert {k: got[k] for k in want} == want and got["now_us"] == now, batch_id
    history = sorted((r["batch"], r["frontier_lsn"]) for r in store.history().collect())
    reached = [f for _, f in history if f is not None]
    assert reached == sorted(reached) and reached
    # What is settled below the frontier is forgotten.
    store.events.compact(store.ledger.last(), keep=F.col("state") != "done")
    left = store.events.as_of().collect()
    assert len(left) < 160 and all(r["state"] == "open" or r["lsn"] > reached[-1] for r in left if r["commit_ts_us"] is not None)

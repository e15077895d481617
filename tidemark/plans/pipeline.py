"""Queries over assembly, failures, logs, rebuild, audits and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.latency import micros_to_iso
from tidemark.functions.lsn import lsn_diff, long_to_lsn
from tidemark.operators import assemble, audit, gates, metrics, quarantine, rebuild, resolve, visibility
from tidemark.operators.sizing import Sizing
from tidemark.plans import documents as docs
from tidemark.plans import freshness, inputs
from tidemark.plans.base_sql import CLASSIFIED, COMMITS, DOC_COLUMNS, LOG, OBSERVED, fold, with_
from tidemark.plans.inputs import FIELDS
from tidemark.session import materialized, scratch_path
from tidemark.sources import changelog, logs
from tidemark.streaming import materialize as streams

FIELD_TYPES = {"value": "double", "props": "string", "event_type": "string"}
# Settings of the kind a service reads from its environment; two of them are secrets.
SETTINGS = {
    "REDIS_PASSWORD": "redis-pass-2024",
    "OPS_TOKEN": "ops-token-1f9a77",
    "API_KEY": "short",
    "INDEX_NAME": "accounts-index",
}


# ---- assembly ------------------------------------------------------------------------


def landed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenised messages as a landing table, the form in which they reach the engine."""
    path = scratch_path(spark, "messages")
    inputs.messages(spark, sf_dir).write.parquet(path)
    return changelog.read_replication_messages(spark, path)


def txn_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = inputs.messages(spark, sf_dir).select("slot", "msg_seq", "tag")
    numbered = assemble.number_transactions(slim, size=Sizing(rows_per_chunk=4_000))
    return numbered.select("slot", "msg_seq", "tag", "txn", "row_no")


def txn_row_numbers_chunks_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with more rows than the driver may hold chunk boundaries for: chunks are cut again."""
    slim = inputs.messages(spark, sf_dir).select("slot", "msg_seq", "tag")
    numbered = assemble.number_transactions(slim, size=Sizing(rows_per_chunk=500, max_chunks=3))
    return numbered.select("slot", "msg_seq", "tag", "txn", "row_no")


def relation_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = assemble.resolve_relation(landed_messages(spark, sf_dir), size=inputs.size(spark, sf_dir, 6))
    return resolved.select(
        "msg_seq", "relation_id", F.col("rel.msg_seq").alias("announced_seq"),
        F.size("rel.rel_columns").cast("bigint").alias("columns"),
    )


def txn_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = assemble.assemble_transactions(
        landed_messages(spark, sf_dir), inputs.DB, size=inputs.size(spark, sf_dir, 6)
    )
    row = F.coalesce("after", "before")

    def has(name: str):
        return F.map_contains_key(row, F.lit(name))

    return events.select(
        "event_id", "op", F.col("pk")["id"].alias("pk_id"), "commit_lsn", "commit_ts_us", "xid",
        F.col("seq").cast("bigint").alias("seq"),
        has("value").alias("has_value"), row["value"].alias("value"),
        has("props").alias("has_props"), row["props"].alias("props"),
        has("event_type").alias("has_event_type"), row["event_type"].alias("event_type"),
        row["big"].alias("big"),
    )


def message_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.message_errors(landed_messages(spark, sf_dir), size=inputs.size(spark, sf_dir, 6))


# Takes the forms for long logs, whatever the size.
LONG_LOG = Sizing(rows_per_chunk=1_000)


def message_errors_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.message_errors(landed_messages(spark, sf_dir), size=LONG_LOG)


def txn_assembly_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of the assembled events, by the form for long logs."""
    events = assemble.assemble_transactions(landed_messages(spark, sf_dir), inputs.DB, size=LONG_LOG)
    return events.select("event_id", "op", "commit_lsn", "xid", F.col("seq").cast("bigint").alias("seq"))


def txn_assembly_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction ids around the end of the counter, read as signed numbers, also in identities.

    The first thousand ids lie below 2^32 and come out negative; the counter then begins anew.
    """
    far = landed_messages(spark, sf_dir).withColumn("xid", F.pmod(F.col("xid") + (2**32 - 1000), F.lit(2**32)))
    events = assemble.assemble_transactions(far, inputs.DB, signed_xids=True, size=inputs.size(spark, sf_dir, 6))
    return events.select("event_id", "commit_lsn", "xid", F.col("seq").cast("bigint").alias("seq"))


def take_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transactions until at least 5 000 events are taken."""
    rows = inputs.commits(spark, sf_dir).select("event_no", "lsn", "seq")
    return assemble.take_until(rows, 5_000, size=inputs.size(spark, sf_dir, 1))


# ---- delivery failures ----------------------------------------------------------------


def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).select("message_id", "attempt_ts_us", "ok", "attempt")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.delivery_attempts(inputs.deliveries(spark, sf_dir), size=inputs.size(spark, sf_dir, 7))


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.dead_letters(_attempts(spark, sf_dir), "cdc_events")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dead(spark, sf_dir)


def dead_letter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.dead_letter_report(_dead(spark, sf_dir))


def _acked(deliveries: DataFrame) -> DataFrame:
    last = deliveries.groupBy("message_id").agg(F.max_by("ok", "attempt_ts_us").alias("ok"))
    return last.filter("ok").select("message_id")


def reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = inputs.deliveries(spark, sf_dir)
    now = (tried.agg(F.max("attempt_ts_us")).scalar() + F.lit(30_000_000)).cast("bigint")
    return quarantine.reclaimable(tried, _acked(tried), now, count=None)


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = inputs.deliveries(spark, sf_dir)
    dead = _dead(spark, sf_dir).select(F.col("source_message_id").cast("bigint").alias("message_id"))
    retries = tried.filter(~F.col("ok")).select("message_id")
    sent = inputs.commits(spark, sf_dir).select(F.col("event_no").alias("message_id"))
    return metrics.backlog(sent, _acked(tried), retries, dead)


def replayed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined deletes never applied at first, then replayed after everything else."""
    log = inputs.change_log(spark, sf_dir)
    failed = _dead(spark, sf_dir).select(F.col("source_message_id").cast("bigint").alias("event_no"))
    dead = log.join(failed, "event_no", "left_semi")
    alive = log.join(failed, "event_no", "left_anti").select(*dead.columns)
    return docs.flat(resolve.materialize(quarantine.replay(alive, dead), fields=FIELDS, size=inputs.size(spark, sf_dir)))


def _delivered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries as JSON text; some damaged on the way."""
    log = inputs.change_log(spark, sf_dir).withColumn("message_id", F.concat_ws("-", "event_no", "redelivery"))
    number = F.col("event_no")
    text = changelog.envelope_json(F.col("commit_ts_us") + 5_000, FIELDS)
    damaged = (
        F.when(number % 101 == 7, F.substring(text, 1, 60))
        .when(number % 103 == 9, F.replace(text, F.lit('"commit_lsn"'), F.lit('"position"')))
        .when(number % 107 == 11, F.replace(text, F.lit('"pk":{"id"'), F.lit('"pk":{"no"')))
        .otherwise(text)
    )
    return log.withColumn("event", damaged)


def invalid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = changelog.parse_events(_delivered_log(spark, sf_dir))
    _, bad = quarantine.split_valid(parsed)
    return bad.groupBy("reason").agg(F.count("*").alias("deliveries"), F.max("arrival").alias("last_arrival"))


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through JSON and back: valid deliveries folded into documents."""
    parsed = changelog.parse_events(_delivered_log(spark, sf_dir))
    good, _ = quarantine.split_valid(parsed)
    changes = changelog.flatten_events(good, FIELD_TYPES)
    return docs.flat(resolve.materialize(changes, fields=FIELDS, size=inputs.size(spark, sf_dir)))


# ---- logs ------------------------------------------------------------------------------


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_log_lines(inputs.log_lines(spark, sf_dir))
    applied = logs.log_records(parsed, "indexer_event")
    return applied.select(
        "line_no", F.col("record")["document_id"].alias("document_id"),
        F.col("record")["commit_lsn"].alias("commit_lsn"),
    )


def log_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_excerpt(inputs.log_lines(spark, sf_dir), ["VIOLATION", "worker started"], "line_no")


def masked_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.mask_secrets(inputs.log_lines(spark, sf_dir), "line", SETTINGS)


def leaked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard counts before and after masking, over all lines."""
    raw = inputs.log_lines(spark, sf_dir)
    masked = logs.mask_secrets(raw, "line", SETTINGS)
    before = logs.leaked_secrets(raw, "line", SETTINGS).select(F.lit("raw").alias("text"))
    after = logs.leaked_secrets(masked, "line", SETTINGS).select(F.lit("masked").alias("text"))
    return before.unionByName(after).groupBy("text").agg(F.count("*").alias("leaks"))


def reserved_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose change carried a reserved field fail the audit."""
    log = inputs.change_log(spark, sf_dir)
    leak = (F.col("event_no") % 50 == 1) & (F.col("op") == "c")
    after = F.when(leak, F.create_map(F.lit("_Document__doc"), F.lit("x"), F.lit("note"), F.lit("y")))
    changes = log.withColumn("after", F.coalesce(after, F.create_map(F.lit("note"), F.col("op"))))
    judged = resolve.classify_events(changes, size=inputs.size(spark, sf_dir)).filter(F.col("result") == resolve.APPLIED)
    audited = audit.reserved_key_audit(resolve.fold_documents_map(judged, insert_mode="merge"))
    return audited.select("key", F.concat_ws(",", "reserved_keys").alias("reserved_keys"), "clean")


# ---- rebuild and audits -----------------------------------------------------------------


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = inputs.order_snapshot(spark, sf_dir)
    # The snapshot was taken when half of the orders had seen their changes.
    at = (source.agg(F.max("key")).scalar() * F.lit(4) + F.lit(inputs.LSN_BASE)).cast("bigint")
    return rebuild.rebuild(source, inputs.order_changes(spark, sf_dir), ["key"], ["status", "price"], at)


def rebuild_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rebuilt(spark, sf_dir)
    return out.select(
        "key", F.col("status.v").alias("status"), F.col("price.v").alias("price"),
        F.col("_lsn").alias("lsn"), F.col("_deleted").alias("deleted"),
    )


def _plain(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"status": F.col("status.v"), "price": F.col("price.v")})


def convergence_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the snapshot, every order changed since shows up as missing or different."""
    source = inputs.order_snapshot(spark, sf_dir)
    return audit.convergence(source, _plain(_rebuilt(spark, sf_dir)), ["key"], ["status", "price"])


def convergence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, rebuilt = inputs.order_snapshot(spark, sf_dir), _plain(_rebuilt(spark, sf_dir))
    return audit.convergence_report(source, rebuilt, ["key"], ["status", "price"])


def validate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.validate_source_rows(
        inputs.table(spark, sf_dir, "customer"), required=["c_name", "c_mktsegment"],
        non_negative=["c_acctbal"], unique=["c_name", "c_acctbal"], key="c_custkey",
    )


def ordering_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = freshness.events(spark, sf_dir)
    stored = docs.stored_markers(spark, sf_dir)
    current = resolve.materialize(inputs.change_log(spark, sf_dir), fields=FIELDS, size=inputs.size(spark, sf_dir))
    return audit.ordering_audit(events, stored, current, FIELDS)


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_no")
    events = freshness.events(spark, sf_dir).withColumn(
        "published_ts_us", F.col("commit_ts_us") + 1000 * (5 + (number * 31) % 40)
    )
    applied_log = events.select(
        "event_id", "lsn", (1000 * ((number * 17) % 60)).alias("queue_us"),
        (1000 * (20 + (number * 13) % 80)).alias("processing_us"),
    )
    obs = freshness.observed(spark, sf_dir)
    return audit.trace_events(events, docs.stored_markers(spark, sf_dir), obs, applied_log)


def lsn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log bytes each key's changes span, from positions in text form."""
    rows = inputs.commits(spark, sf_dir)
    ends = rows.groupBy("key").agg(
        long_to_lsn(F.max("lsn")).alias("newest"), long_to_lsn(F.min("lsn")).alias("oldest")
    )
    return ends.withColumn("bytes", lsn_diff("newest", "oldest"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per operation, written as JSON and read back for comparison."""
    obs = freshness.observed(spark, sf_dir)
    now = freshness.now_of(freshness.events(spark, sf_dir))
    measured = metrics.metrics_snapshot(obs, now, ["op"], size=inputs.size(spark, sf_dir, 1))
    record = gates.run_record(
        measured, {"counts": F.struct(F.col("in_flight_count").alias("pending"))},
        F.concat(F.lit("run-"), F.col("op")), micros_to_iso(now),
    )
    path = scratch_path(spark, "runs")
    gates.append_run_history(record, path)
    back = spark.read.schema(record.schema).json(path)
    return back.select(
        "label", "captured_at", F.col("staleness.sample_count").alias("samples"),
        F.col("staleness.p99_staleness_ms").alias("p99_ms"), F.col("counts.pending").alias("pending"),
    )


# ---- streams ------------------------------------------------------------------------------


def _store_after_stream(spark: SparkSession, sf_dir: str, *, slices: int = 3, files: int | None = None) -> streams.DocumentStore:
    """The delivered log lands in slices of delivery order; each is drained before the next lands.

    The files of a slice overlap in delivery position, so a trigger takes a slice as a whole,
    however many files it has.
    """
    root = scratch_path(spark, "stream")
    store = streams.DocumentStore(spark, f"{root}/store", FIELD_TYPES)
    log = materialized(_delivered_log(spark, sf_dir).select("message_id", "arrival", "event"), "delivered")
    for part in inputs.log_slices(log, slices):
        changelog.write_change_log(part.repartition(files) if files else part, f"{root}/log")
        parsed = changelog.stream_change_log(spark, f"{root}/log")
        streams.stream_materialize(parsed, store, f"{root}/checkpoint", available_now=True).awaitTermination()
    return store


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.flat(_store_after_stream(spark, sf_dir).current_documents())


def stream_documents_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with slices of 24 files that overlap in delivery position, and more slices."""
    return docs.flat(_store_after_stream(spark, sf_dir, slices=4, files=24).current_documents())


def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why deliveries were set apart while streaming: nothing unreadable stops a batch or becomes a null."""
    root = scratch_path(spark, "poison")
    number = F.col("arrival") % 10
    log = _delivered_log(spark, sf_dir).select("message_id", "arrival", "event").withColumn(
        "event",
        F.when(number == 4, F.regexp_replace("event", '"pk":\\{"id":[0-9]+', '"pk":{"id":"SKU-7"'))
        .when(number == 6, F.regexp_replace("event", '"value":[-0-9.E]+', '"value":"abc"'))
        .otherwise(F.col("event")),
    )
    changelog.write_change_log(log, f"{root}/log")
    store = streams.DocumentStore(spark, f"{root}/store", FIELD_TYPES)
    parsed = changelog.stream_change_log(spark, f"{root}/log")
    streams.stream_materialize(parsed, store, f"{root}/checkpoint", available_now=True).awaitTermination()
    return store.current_failures().groupBy("error").agg(F.count("*").alias("failures"))


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable deliveries come again one to seven times; the fifth failure makes a dead letter."""
    root = scratch_path(spark, "retries")
    parsed = changelog.parse_events(_delivered_log(spark, sf_dir).filter("redelivery = 0"))
    _, bad = quarantine.split_valid(parsed)
    times = F.sequence(F.lit(0), (F.col("event_no") % 7).cast("int"))
    again = bad.select("message_id", "arrival", "event", F.explode(times).alias("again"))
    again = again.select("message_id", (F.col("arrival") * 8 + F.col("again")).alias("arrival"), "event", "again")
    store = streams.DocumentStore(spark, f"{root}/store", FIELD_TYPES)
    landed = materialized(again, "retries")
    for few in ("again < 3", "again >= 3"):
        changelog.write_change_log(landed.filter(few), f"{root}/log")
        stream = changelog.stream_change_log(spark, f"{root}/log")
        streams.stream_materialize(stream, store, f"{root}/checkpoint", available_now=True).awaitTermination()
    dead = store.current_dead_letters("cdc_events")
    return dead.select("source_message_id", "error", "attempts", "failed_arrival")


def _by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour of commits: committed, readable in the log, seen by the monitor, set apart, pending."""
    hour = F.expr("commit_ts_us div 3600000000").alias("hour")
    judged = changelog.parse_events(_delivered_log(spark, sf_dir)).withColumn("reason", quarantine.invalid_reason())
    log = judged.groupBy(hour).agg(
        F.count_distinct(F.when(F.col("reason").isNull(), F.col("e.event_id"))).alias("log_delta"),
        F.count_if(F.col("reason").isNotNull()).alias("dead"),
    )
    seen = freshness.observed(spark, sf_dir).groupBy(hour).agg(
        F.count("visible_ts_us").alias("sample_delta"), F.count_if(F.col("visible_ts_us").isNull()).alias("pending")
    )
    written = inputs.commits(spark, sf_dir).groupBy(hour).agg(F.count("*").alias("writes"))
    return written.join(log, "hour").join(seen, "hour")


def conservation_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes from the source, the log from its readable deliveries, samples from the monitor."""
    deltas = _by_hour(spark, sf_dir).select("hour", "writes", "log_delta", "sample_delta")
    return metrics.conservation(deltas)


def recovery_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour as an outage run; more than one dead letter fails the run."""
    runs = _by_hour(spark, sf_dir).select(
        "hour", "writes",
        F.col("sample_delta").alias("sample_count_delta"), F.col("log_delta").alias("stream_len_delta"),
        F.col("dead").alias("dlq_len_delta"), F.col("pending").alias("pending_count_after"),
        F.lit(0).alias("active_violation_count_after"),
        (F.col("writes") * 64).alias("lag_bytes_before"), (F.col("pending") * 4_000_000).alias("lag_bytes_after"),
        F.when(F.col("dead") > 1, 1).otherwise(0).alias("exit_status"),
    )
    return gates.recovery_audit(runs).select("hour", "conserved", "lag_recovered", "recovered")


def stream_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _store_after_stream(spark, sf_dir).current_markers(["op", "result"])
    return current.groupBy("op", "result").agg(F.count("*").alias("markers"))


def _commit_and_marker_streams(spark: SparkSession, sf_dir: str, root: str) -> tuple[DataFrame, DataFrame]:
    rows = inputs.marker_times(freshness.events(spark, sf_dir))
    both = rows.select(
        "event_id", "lsn", F.timestamp_micros("commit_ts_us").alias("commit_time"),
        F.timestamp_micros("marker_ts_us").alias("marker_time"),
    )
    # A pair far in the future moves both watermarks past everything real.
    end = both.agg(F.max("commit_time") + F.expr("INTERVAL 30 DAYS")).first()[0]
    sentinel = spark.range(1).select(
        F.lit("sentinel").alias("event_id"), F.lit(0).cast("bigint").alias("lsn"), F.lit(end).alias("commit_time"),
        F.lit(end).alias("marker_time"),
    )
    for part in (both, sentinel):
        part.select("event_id", "lsn", "commit_time").write.mode("append").parquet(f"{root}/commits")
        part.filter(F.col("marker_time").isNotNull()).select("event_id", "lsn", "marker_time").write.mode(
            "append"
        ).parquet(f"{root}/markers")

    def source(name: str, time: str) -> DataFrame:
        schema = f"event_id string, lsn bigint, {time} timestamp"
        return spark.readStream.schema(schema).parquet(f"{root}/{name}")

    return source("commits", "commit_time"), source("markers", "marker_time")


def stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that no marker answered within the SLO, found by a stream-stream join."""
    root = scratch_path(spark, "breaches")
    commits, marked = _commit_and_marker_streams(spark, sf_dir, root)
    query = streams.stream_violations(commits, marked, f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    found = spark.read.schema("event_id string, lsn bigint, commit_time timestamp").parquet(f"{root}/out")
    return found.filter(F.col("event_id") != "sentinel").select(
        "event_id", "lsn", F.unix_micros("commit_time").alias("commit_ts_us")
    )


def _drained(stream: DataFrame, root: str) -> None:
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out")
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_resolved_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations that ended when their marker came after all."""
    root = scratch_path(spark, "resolved")
    commits, marked = _commit_and_marker_streams(spark, sf_dir, root)
    _drained(streams.late_markers(commits, marked), root)
    found = spark.read.schema("event_id string, lsn bigint, commit_time timestamp, resolved_time timestamp").parquet(f"{root}/out")
    took = F.unix_micros("resolved_time") - F.unix_micros("commit_time")
    return found.select("event_id", "lsn", took.alias("resolved_after_us"))


def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits outside the accepted range as of one day before the newest, reported while streaming."""
    root = scratch_path(spark, "rejected")
    rows = inputs.commits(spark, sf_dir).select("event_no", F.timestamp_micros("commit_ts_us").alias("commit_time"))
    landed = materialized(rows, "landed")
    now = landed.agg(F.max("commit_time") - F.expr("INTERVAL 24 HOURS")).first()[0]
    landed.write.parquet(f"{root}/log")
    stream = spark.readStream.schema(landed.schema).parquet(f"{root}/log")
    _drained(streams.guard_rejections(stream, now=F.lit(now)), root)
    found = spark.read.schema("event_no bigint, reason string").parquet(f"{root}/out")
    return found.select("event_no", "reason")


def upserted_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of the first half of the log, overwritten by those of the second."""
    log = materialized(docs.mk.markers(docs.classified(spark, sf_dir)), "marker-log")
    half = log.agg(F.expr("percentile_approx(arrival, 0.5)")).scalar()
    stored = docs.mk.marker_state(log.filter(F.col("arrival") <= half))
    return docs.mk.upsert_markers(stored, log.filter(F.col("arrival") > half))


def looked_up_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point read of one document's markers."""
    stored = docs.mk.marker_state(docs.mk.markers(docs.classified(spark, sf_dir)))
    return changelog.lookup(stored, "document_id", "7").select("event_id", "result")


def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redeliveries suppressed while streaming, within a horizon of sixty days of commit time."""
    root = scratch_path(spark, "dedupe")
    log = inputs.change_log(spark, sf_dir)
    log.select("event_id", "op", F.timestamp_micros("commit_ts_us").alias("commit_time")).write.parquet(f"{root}/log")
    stream = spark.readStream.schema("event_id string, op string, commit_time timestamp").parquet(f"{root}/log")
    once = streams.first_deliveries(stream, "commit_time", "60 days")
    query = (
        once.writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.schema("event_id string, op string").parquet(f"{root}/out")
    return found.select("event_id", "op")


QUERIES = {
    f.__name__: f
    for f in (
        txn_row_numbers, txn_row_numbers_chunks_of_chunks, relation_as_of, txn_assembly, txn_assembly_chunked,
        txn_assembly_signed, message_errors, message_errors_chunked, take_until, delivery_attempts,
        dead_letters, dead_letter_report, reclaimable, backlog, replayed_documents, invalid_events,
        parsed_documents, log_records, log_excerpt, masked_logs, leaked_secrets, reserved_key_audit,
        rebuild_documents, convergence_differences, convergence_report, validate_source, ordering_audit,
        trace_events, lsn_distance, run_history, stream_documents, stream_markers, stream_violations,
        stream_first_deliveries, stream_documents_many_files, stream_failures,
        stream_dead_letters, conservation_by_hour, recovery_by_hour, stream_resolved_violations, stream_rejected,
        upserted_markers, looked_up_markers,
    )
}

_MESSAGES = COMMITS + """,
msgs AS (
  SELECT 'indexer' AS slot, xid * 8 + 2 + seq AS msg_seq,
         CASE op WHEN 'c' THEN 'I' WHEN 'u' THEN 'U' ELSE 'D' END AS tag, xid, event_no FROM commits
  UNION ALL SELECT 'indexer', xid * 8, 'B', xid, NULL FROM commits WHERE seq = 0
  UNION ALL SELECT 'indexer', xid * 8 + 1, 'R', xid, NULL FROM commits WHERE seq = 0 AND xid % 50 = 0
  UNION ALL SELECT 'indexer', xid * 8 + 5, CASE WHEN xid % 2 = 0 THEN '' ELSE 'Z' END, xid, NULL
    FROM commits WHERE seq = 0 AND xid % 113 = 5
  UNION ALL SELECT 'indexer', xid * 8 + 6, 'T', xid, NULL FROM commits WHERE seq = 0 AND xid % 29 = 0
  UNION ALL SELECT 'indexer', xid * 8 + 7, 'C', xid, NULL FROM commits WHERE seq = 0 AND xid % 41 <> 40
)"""
_BAD_ROW = """CASE WHEN event_no % 211 = 0 THEN 'unknown relation id'
  WHEN op <> 'd' AND event_no % 307 = 0 THEN 'tuple and relation differ in columns'
  WHEN op <> 'd' AND event_no % 401 = 0 THEN 'unknown tuple data kind' END"""
_TRIED = COMMITS + """,
tried AS (
  SELECT event_no AS message_id, commit_ts_us + i * 1000000 AS attempt_ts_us,
         CASE WHEN event_no % 5 = 0 THEN i = 2 ELSE i > failing END AS ok,
         '{"no":' || event_no || '}' AS event,
         CASE WHEN event_no % 2 = 0 THEN 'decode: unreadable' ELSE 'invalid event' END AS error
  FROM (SELECT *, CASE op WHEN 'd' THEN event_no % 7 ELSE event_no % 3 END AS failing FROM commits),
       (SELECT unnest(range(1, 8)) AS i)
  WHERE i <= CASE WHEN event_no % 5 = 0 THEN 7 ELSE least(failing + 1, 5) END
),
attempts AS (
  SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY message_id, run
              ORDER BY attempt_ts_us) AS BIGINT) AS attempt
  FROM (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY message_id
          ORDER BY attempt_ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM tried)
),
dead AS (
  SELECT 'cdc_events' AS source_stream, message_id::VARCHAR AS source_message_id, event, error,
         attempt AS attempts, attempt_ts_us AS failed_ts_us
  FROM attempts WHERE NOT ok AND attempt = 5
),
acked AS (SELECT message_id FROM tried GROUP BY 1 HAVING arg_max(ok, attempt_ts_us))"""
_DAMAGED = """CASE WHEN event_no % 101 = 7 THEN 'decode_error' WHEN event_no % 103 = 9 THEN 'missing commit_lsn'
  WHEN event_no % 107 = 11 THEN 'missing pk.id' END"""
_HOURS = OBSERVED + f""",
hours AS (
  SELECT commit_ts_us // 3600000000 AS hour, count(*) AS writes,
         count(*) FILTER (({_DAMAGED}) IS NULL) AS log_delta, count(visible_ts_us) AS sample_delta,
         CAST(coalesce(sum(CASE WHEN event_no % 17 = 0 THEN 2 ELSE 1 END) FILTER (({_DAMAGED}) IS NOT NULL), 0) AS BIGINT) AS dead,
         count(*) FILTER (visible_ts_us IS NULL) AS pending
  FROM observed GROUP BY 1
)"""
_LINES = LOG + """,
bodies AS (
  SELECT *, '{"event":"' || CASE WHEN event_no % 4 = 0 THEN 'staleness_sample' WHEN event_no % 9 = 0
    THEN 'VIOLATION' ELSE 'indexer_event' END || '","document_id":"' || key || '","commit_lsn":"' || commit_lsn
    || '","auth":"' || CASE WHEN event_no % 13 = 0 THEN 'Bearer ops-token-1f9a77' ELSE 'none' END || '"}' AS body
  FROM log
),
lines AS (
  SELECT arrival AS line_no, event_no, key, commit_lsn,
    CASE WHEN event_no % 11 = 3 THEN 'svc-1 | worker started, pass=redis-pass-2024 no ' || event_no
         WHEN event_no % 11 = 5 THEN 'svc-1 | ' || substr(body, 1, 40)
         WHEN event_no % 11 = 7 THEN 'svc-2 | ' || body || ' trailing' ELSE 'svc-1 | ' || body END AS line
  FROM bodies
)"""
_MASK = "replace(replace(line, 'redis-pass-2024', '[REDACTED]'), 'ops-token-1f9a77', '[REDACTED]')"
_REBUILT = """
cut AS (SELECT max(o_orderkey) * 4 + 4294967296 AS lsn FROM orders),
changes AS (
  SELECT o_orderkey AS key, 'c' AS op, (SELECT lsn FROM cut) AS lsn, 0 AS seq, TRUE AS has_status,
         o_orderstatus AS status, TRUE AS has_price, o_totalprice AS price FROM orders
  UNION ALL
  SELECT l_orderkey, CASE WHEN gone THEN 'd' ELSE 'u' END, lsn, (l_partkey * 100000 + l_suppkey) * 100 + l_quantity::BIGINT, NOT gone,
         l_linestatus, NOT gone AND l_linestatus = 'F', l_extendedprice
  FROM (SELECT *, l_returnflag = 'R' AND l_linenumber >= 4 AS gone,
               4294967296 + l_orderkey * 8 + l_linenumber AS lsn FROM lineitem)
  WHERE lsn > (SELECT lsn FROM cut)
),
versions AS (SELECT *, CAST(lsn AS HUGEINT) * 100000000000000 + seq AS v FROM changes),
resets AS (SELECT *, max(v) FILTER (op IN ('c', 'd')) OVER (PARTITION BY key) AS reset FROM versions),
rebuilt AS (
  SELECT key, arg_max(status, v) FILTER (has_status AND v >= coalesce(reset, -1)) AS status,
         arg_max(price, v) FILTER (has_price AND v >= coalesce(reset, -1)) AS price,
         max(lsn) AS lsn, arg_max(op, v) = 'd' AS deleted
  FROM resets GROUP BY key
),
differences AS (
  SELECT coalesce(o_orderkey, key) AS key,
         CASE WHEN key IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'extra'
              WHEN o_orderstatus IS DISTINCT FROM status OR o_totalprice IS DISTINCT FROM price THEN 'different'
         END AS difference
  FROM orders FULL JOIN (SELECT * FROM rebuilt WHERE NOT deleted) ON o_orderkey = key
)"""
_STORED = docs._FIRST_OUTCOME
_GOOD_DOCS = with_(LOG, f"""
good AS (SELECT * FROM log WHERE {_DAMAGED} IS NULL)""", """
judged AS (
  SELECT *, CASE WHEN lsn <= max(lsn) OVER (PARTITION BY key ORDER BY arrival
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            THEN 'superseded' ELSE 'applied' END AS result FROM good)""", fold("judged", keep="result = 'applied'"))

_ASSEMBLED = f"commits WHERE xid % 41 <> 40 AND ({_BAD_ROW}) IS NULL"

ORACLE = {
    "txn_row_numbers": with_(_MESSAGES) + """
      SELECT slot, msg_seq, tag,
             CAST(count(*) FILTER (tag = 'B') OVER (ORDER BY msg_seq) AS BIGINT) AS txn,
             CAST(count(*) FILTER (tag IN ('I', 'U', 'D')) OVER (ORDER BY msg_seq) AS BIGINT) AS row_no
      FROM msgs""",
    "relation_as_of": with_(_MESSAGES) + """
      SELECT m.msg_seq, CASE WHEN m.event_no % 211 = 0 THEN 99 ELSE 16384 END::BIGINT AS relation_id,
             CASE WHEN m.event_no % 211 <> 0 THEN r.msg_seq END AS announced_seq,
             CASE WHEN m.event_no % 211 <> 0 THEN CASE WHEN r.xid >= 150 THEN 5 ELSE 4 END END::BIGINT AS columns
      FROM (SELECT * FROM msgs WHERE tag IN ('I', 'U', 'D')) m
      ASOF LEFT JOIN (SELECT * FROM msgs WHERE tag = 'R') r ON m.msg_seq >= r.msg_seq""",
    "txn_assembly": with_(COMMITS) + f"""
      SELECT event_id, op, key::VARCHAR AS pk_id, commit_lsn, commit_ts_us, xid, seq::BIGINT AS seq,
             op = 'd' OR has_value AS has_value, CASE WHEN has_value THEN value::VARCHAR END AS value,
             op = 'd' OR has_props AS has_props,
             CASE WHEN has_props AND event_no % 19 <> 0 THEN props END AS props,
             op = 'd' OR has_event_type AS has_event_type,
             CASE WHEN has_event_type AND event_no % 23 = 0 THEN lower(hex(event_type))
                  WHEN has_event_type THEN event_type END AS event_type,
             CASE WHEN op <> 'd' AND xid >= 150 THEN coalesce(value > 50, FALSE)::VARCHAR END AS big
      FROM commits WHERE xid % 41 <> 40 AND ({_BAD_ROW}) IS NULL""",
    "message_errors": with_(_MESSAGES) + f"""
      SELECT slot, msg_seq, tag, error FROM (
        SELECT slot, msg_seq, tag, CASE WHEN tag = '' THEN 'empty message' ELSE 'unsupported message type' END AS error
        FROM msgs WHERE tag IN ('', 'Z')
        UNION ALL
        SELECT 'indexer', xid * 8 + 2 + seq, CASE op WHEN 'c' THEN 'I' WHEN 'u' THEN 'U' ELSE 'D' END, {_BAD_ROW}
        FROM commits) WHERE error IS NOT NULL""",
    "take_until": with_(COMMITS) + """
      SELECT event_no, lsn, seq FROM commits
      WHERE lsn <= (SELECT max(lsn) FROM (
        SELECT lsn, sum(count(*)) OVER (ORDER BY lsn) - count(*) AS before FROM commits GROUP BY lsn)
        WHERE before < 5000)""",
    "delivery_attempts": with_(_TRIED) + " SELECT message_id, attempt_ts_us, ok, attempt FROM attempts",
    "dead_letters": with_(_TRIED) + " SELECT * FROM dead",
    "dead_letter_report": with_(_TRIED) + """
      SELECT CASE WHEN error LIKE 'decode%' THEN 'decode_error' ELSE 'processing' END AS reason,
             count(*) AS dead_letters, max(failed_ts_us) AS last_failed_ts_us FROM dead GROUP BY 1""",
    "reclaimable": with_(_TRIED) + """
      SELECT message_id, max(attempt_ts_us) AS delivered_ts_us FROM tried
      WHERE message_id NOT IN (SELECT message_id FROM acked) GROUP BY 1""",
    "backlog": with_(_TRIED) + """
      SELECT count(*) AS stream_len,
             count(*) FILTER (NOT a AND NOT d) AS pending_count,
             count(*) FILTER (NOT a AND NOT d AND r) AS retry_keys, count(*) FILTER (d) AS dlq_len
      FROM (SELECT event_no IN (SELECT message_id FROM acked) AS a,
                   event_no IN (SELECT source_message_id::BIGINT FROM dead) AS d,
                   event_no IN (SELECT message_id FROM tried WHERE NOT ok) AS r FROM commits)""",
    "replayed_documents": with_(LOG, _TRIED[len(COMMITS) + 1:], """
      split AS (SELECT *, event_no IN (SELECT source_message_id::BIGINT FROM dead) AS is_dead FROM log)""", """
      replayed AS (
        SELECT * REPLACE (CASE WHEN is_dead THEN arrival - (SELECT min(arrival) FROM split WHERE is_dead)
            + (SELECT max(arrival) FROM split WHERE NOT is_dead) + 1 ELSE arrival END AS arrival) FROM split)""", """
      judged AS (
        SELECT *, CASE WHEN lsn <= max(lsn) OVER (PARTITION BY key ORDER BY arrival
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  THEN 'superseded' ELSE 'applied' END AS result FROM replayed)""",
      fold("judged", keep="result = 'applied'")) + f" SELECT {DOC_COLUMNS} FROM docs",
    "invalid_events": with_(LOG) + f"""
      SELECT {_DAMAGED} AS reason, count(*) AS deliveries, max(arrival) AS last_arrival
      FROM log WHERE {_DAMAGED} IS NOT NULL GROUP BY 1""",
    "parsed_documents": _GOOD_DOCS + f" SELECT {DOC_COLUMNS} FROM docs",
    "log_records": with_(_LINES) + """
      SELECT line_no, key::VARCHAR AS document_id, commit_lsn FROM lines
      WHERE event_no % 11 NOT IN (3, 5, 7) AND event_no % 4 <> 0 AND event_no % 9 <> 0""",
    "log_excerpt": with_(_LINES) + """
      SELECT line_no, line FROM lines WHERE contains(line, 'VIOLATION') OR contains(line, 'worker started')
      ORDER BY line_no LIMIT 500""",
    "masked_logs": with_(_LINES) + f" SELECT line_no, {_MASK} AS line FROM lines",
    "leaked_secrets": with_(_LINES) + """
      SELECT 'raw' AS text, count(*) AS leaks FROM lines
      WHERE contains(line, 'redis-pass-2024') OR contains(line, 'ops-token-1f9a77') HAVING count(*) > 0""",
    "reserved_key_audit": with_(CLASSIFIED) + """
      SELECT key, CASE WHEN bad THEN '_Document__doc' ELSE '' END AS reserved_keys, NOT bad AS clean
      FROM (SELECT key, coalesce(max(lsn) FILTER (op = 'c' AND event_no % 50 = 1)
                                 >= coalesce(max(lsn) FILTER (op = 'd'), 0), FALSE) AS bad
            FROM judged WHERE result = 'applied' GROUP BY key)""",
    "rebuild_documents": with_(_REBUILT) + " SELECT key, status, price, lsn, deleted FROM rebuilt",
    "convergence_differences": with_(_REBUILT) + " SELECT * FROM differences WHERE difference IS NOT NULL",
    "convergence_report": with_(_REBUILT) + """
      SELECT *, missing + extra + different = 0 AND source_rows = live_documents AS converged FROM (
        SELECT count(*) FILTER (difference = 'missing') AS missing, count(*) FILTER (difference = 'extra') AS extra,
               count(*) FILTER (difference = 'different') AS different,
               (SELECT count(*) FROM orders) AS source_rows,
               (SELECT count(*) FROM rebuilt WHERE NOT deleted) AS live_documents FROM differences)""",
    "validate_source": """
      SELECT c_custkey, 'c_name is null' AS "constraint" FROM customer WHERE c_name IS NULL
      UNION ALL SELECT c_custkey, 'c_mktsegment is null' FROM customer WHERE c_mktsegment IS NULL
      UNION ALL SELECT c_custkey, 'c_acctbal is negative' FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT c_custkey, 'c_name is not unique' FROM customer
        WHERE c_name IN (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT c_custkey, 'c_acctbal is not unique' FROM customer
        WHERE c_acctbal IN (SELECT c_acctbal FROM customer GROUP BY 1 HAVING count(*) > 1)""",
    "ordering_audit": with_(_STORED, fold("judged", keep="result = 'applied'"), """
      newest AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC, seq DESC) = 1)""", """
      facts AS (
        SELECT key, count(*) AS events,
               count(*) FILTER (result IS NULL) = 0
               AND coalesce(max(c.lsn) FILTER (result = 'superseded') < max(c.lsn), TRUE) AS consistent
        FROM commits c LEFT JOIN (SELECT event_id, result FROM stored) USING (event_id) GROUP BY key)""", """
      verdicts AS (
        SELECT n.key, f.events, n.lsn AS newest_lsn, d.lsn AS document_lsn, d.lsn = n.lsn AS version_is_newest,
               (n.op = 'd') = d.deleted AND (n.op = 'd' OR (
                 (NOT n.has_value OR (d.has_value AND n.value IS NOT DISTINCT FROM d.value))
                 AND (NOT n.has_props OR (d.has_props AND n.props IS NOT DISTINCT FROM d.props))
                 AND (NOT n.has_event_type OR (d.has_event_type AND n.event_type IS NOT DISTINCT FROM d.event_type))
               )) AS payload_is_newest, f.consistent AS markers_consistent
        FROM newest n JOIN facts f USING (key) JOIN docs d USING (key))""") + """
      SELECT *, version_is_newest AND payload_is_newest AND markers_consistent AS passed FROM verdicts""",
    "trace_events": with_(OBSERVED, CLASSIFIED[len(COMMITS) + 1:], """
      outcome AS (SELECT event_id, arg_min(result, arrival) AS result FROM judged GROUP BY event_id)""") + """
      SELECT event_id, lsn, CASE WHEN marker_ts_us IS NOT NULL THEN result END AS result,
             (1000 * (5 + (event_no * 31) % 40)) / 1000.0::DOUBLE AS commit_to_publish_ms,
             (1000 * ((event_no * 17) % 60)) / 1000.0::DOUBLE AS queue_ms,
             (1000 * (20 + (event_no * 13) % 80)) / 1000.0::DOUBLE AS processing_ms,
             staleness_us / 1000.0::DOUBLE AS staleness_ms,
             coalesce(staleness_us <= 1000000 AND violation_ts_us IS NULL AND result = 'applied'
                      AND marker_ts_us IS NOT NULL, FALSE) AS passed
      FROM observed JOIN outcome USING (event_id)""",
    "lsn_distance": with_(COMMITS) + """
      SELECT key, printf('%X/%X', max(lsn) >> 32, max(lsn) & 4294967295) AS newest,
             printf('%X/%X', min(lsn) >> 32, min(lsn) & 4294967295) AS oldest, max(lsn) - min(lsn) AS bytes
      FROM commits GROUP BY key""",
    "run_history": with_(freshness._AT_NOW) + """
      SELECT 'run-' || op AS label,
             strftime(make_timestamp(any_value(now)), '%Y-%m-%dT%H:%M:%S')
               || CASE WHEN any_value(now) % 1000000 = 0 THEN ''
                       ELSE '.' || lpad((any_value(now) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS captured_at,
             count(*) FILTER (is_sample) AS samples,
             quantile_disc(staleness_us, 0.99) FILTER (is_sample) / 1000.0::DOUBLE AS p99_ms,
             count(*) FILTER (NOT is_sample) AS pending
      FROM at_now GROUP BY op""",
    "stream_documents": _GOOD_DOCS + f" SELECT {DOC_COLUMNS} FROM docs",
    "stream_documents_many_files": _GOOD_DOCS + f" SELECT {DOC_COLUMNS} FROM docs",
    "stream_dead_letters": with_(LOG) + f"""
      SELECT message_id AS source_message_id, reason AS error, CAST(5 AS BIGINT) AS attempts, arrival * 8 + 4 AS failed_arrival
      FROM (SELECT event_no || '-0' AS message_id, arrival, event_no, {_DAMAGED} AS reason FROM log WHERE redelivery = 0)
      WHERE reason IS NOT NULL AND event_no % 7 >= 4""",
    "conservation_by_hour": with_(_HOURS) + """
      SELECT hour, writes, log_delta, sample_delta, writes = log_delta AND writes = sample_delta AS conserved FROM hours""",
    "recovery_by_hour": with_(_HOURS) + """
      SELECT hour, writes = log_delta AND writes = sample_delta AS conserved,
             pending * 4000000 <= writes * 64 + 5000000 AS lag_recovered,
             writes = log_delta AND writes = sample_delta AND dead = 0 AND pending = 0
               AND pending * 4000000 <= writes * 64 + 5000000 AS recovered FROM hours""",
    "stream_resolved_violations": with_(OBSERVED) + """
      SELECT event_id, lsn, marker_ts_us - commit_ts_us AS resolved_after_us FROM observed
      WHERE marker_ts_us - commit_ts_us > 1000000""",
    "stream_rejected": with_(COMMITS, """
      aged AS (SELECT event_no, (SELECT max(commit_ts_us) - 86400000000 FROM commits) - commit_ts_us AS age FROM commits)""") + """
      SELECT event_no, CASE WHEN age < -60000000 THEN 'ahead' ELSE 'old' END AS reason FROM aged
      WHERE age < -60000000 OR age > 86400000000""",
    "upserted_markers": with_(CLASSIFIED) + """
      SELECT event_id, CAST(key AS VARCHAR) AS document_id, op, commit_lsn, commit_ts_us, result, arrival
      FROM judged QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival DESC) = 1""",
    "looked_up_markers": with_(CLASSIFIED) + """
      SELECT event_id, result FROM judged WHERE key = 7
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival DESC) = 1""",
    "stream_failures": with_(LOG) + f"""
      SELECT error, count(*) AS failures FROM (
        SELECT coalesce({_DAMAGED}, CASE WHEN arrival % 10 = 4 THEN 'unreadable pk.id'
                 WHEN arrival % 10 = 6 AND value IS NOT NULL AND op <> 'd' THEN 'unreadable value' END) AS error FROM log)
      WHERE error IS NOT NULL GROUP BY 1""",
    "stream_markers": with_(LOG, f"good AS (SELECT * FROM log WHERE {_DAMAGED} IS NULL)", """
      judged AS (
        SELECT *, CASE WHEN lsn <= max(lsn) OVER (PARTITION BY key ORDER BY arrival
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  THEN 'superseded' ELSE 'applied' END AS result FROM good)""") + """
      SELECT op, result, count(*) AS markers FROM (
        SELECT event_id, any_value(op) AS op, arg_max(result, arrival) AS result FROM judged GROUP BY event_id)
      GROUP BY op, result""",
    "stream_first_deliveries": with_(COMMITS) + " SELECT event_id, op FROM commits",
    "stream_violations": with_(OBSERVED) + """
      SELECT event_id, lsn, commit_ts_us FROM observed
      WHERE marker_ts_us IS NULL OR marker_ts_us - commit_ts_us > 1000000""",
}

ORACLE["txn_row_numbers_chunks_of_chunks"] = ORACLE["txn_row_numbers"]
ORACLE["message_errors_chunked"] = ORACLE["message_errors"]
ORACLE["txn_assembly_chunked"] = with_(COMMITS) + f"""
  SELECT event_id, op, commit_lsn, xid, seq::BIGINT AS seq FROM {_ASSEMBLED}"""
ORACLE["txn_assembly_signed"] = with_(COMMITS) + f"""
  SELECT sha256('catalog|public|accounts|' || commit_lsn || '|' || signed || '|' || seq) AS event_id,
         commit_lsn, signed AS xid, seq::BIGINT AS seq
  FROM (SELECT *, xid - 1000 AS signed FROM {_ASSEMBLED})"""

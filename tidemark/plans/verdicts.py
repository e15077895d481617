"""Queries whose verdicts come from independent sources, with data on which they pass and fail."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lsn import long_to_lsn
from tidemark.functions.values import typed_row
from tidemark.operators import assemble, audit, gates, resolve
from tidemark.plans import documents as docs
from tidemark.plans import freshness, inputs, pipeline
from tidemark.plans.base_sql import CLASSIFIED, COMMITS, OBSERVED, with_
from tidemark.plans.inputs import FIELDS
from tidemark.session import materialized
from tidemark.sources import logs


def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the services wrote: a line per indexed event and per sample; some plain, cut or lost."""
    obs = freshness.observed(spark, sf_dir)
    number = F.col("event_no")
    head = F.concat(F.lit('","document_id":"'), F.col("key"), F.lit('","commit_lsn":"'), long_to_lsn("lsn"), F.lit('",'))
    indexed = F.concat(
        F.lit('svc-1 | {"event":"indexer_event'), head, F.lit('"stream_queue_latency_ms":'), (number * 17) % 60,
        F.lit(',"batch_processing_ms":'), 20 + (number * 13) % 80, F.lit("}"),
    )
    indexed = F.when(number % 11 == 5, F.substring(indexed, 1, 60)).otherwise(indexed)
    sampled = F.concat(
        F.lit('svc-2 | {"event":"staleness_sample'), head, F.lit('"staleness_ms":'), F.expr("staleness_us div 1000"), F.lit("}")
    )
    sampled = F.when(F.col("visible_ts_us").isNotNull() & (number % 7 != 6), sampled)
    said = F.array(F.struct((number * 2).alias("line_no"), indexed.alias("line")), F.struct((number * 2 + 1).alias("line_no"), sampled.alias("line")))
    return obs.select(F.explode(said).alias("l")).select("l.*").filter("line is not null")


def _hops(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    # The lines themselves are not looked at again once they are parsed.
    said = materialized(logs.parse_log_lines(service_lines(spark, sf_dir)).select("line_no", "record"), "service-log")
    events = freshness.events(spark, sf_dir).select("event_id", "key", long_to_lsn("lsn").alias("commit_lsn"), *keep)
    applied, sampled = logs.log_records(said, "indexer_event"), logs.log_records(said, "staleness_sample")
    return audit.hop_latencies(events, applied, sampled, keep=keep)


def event_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue, processing and staleness of every event as its log lines tell them."""
    return _hops(spark, sf_dir)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.reserved_key_audit(spark, sf_dir).select("key", "clean")


def ordering_audit_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordering verdict with the documents' reserved fields in it."""
    current = resolve.materialize(inputs.change_log(spark, sf_dir), fields=FIELDS, size=inputs.size(spark, sf_dir))
    return audit.ordering_audit(
        freshness.events(spark, sf_dir), docs.stored_markers(spark, sf_dir), current, FIELDS, clean=_audited(spark, sf_dir)
    )


def trace_events_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of every event, judged with its document's reserved fields and the service log's hops."""
    events = freshness.events(spark, sf_dir).withColumn("published_ts_us", F.col("commit_ts_us") + 1000 * (5 + (F.col("event_no") * 31) % 40))
    # The position comes with the hops; no join with the events to fetch it.
    applied_log = _hops(spark, sf_dir, keep=["lsn"]).withColumns(
        {"queue_us": F.col("queue_ms") * 1000, "processing_us": F.col("processing_ms") * 1000}
    )
    traced = audit.trace_events(
        events, docs.stored_markers(spark, sf_dir, ["result"]), freshness.observed(spark, sf_dir), applied_log, clean=_audited(spark, sf_dir)
    )
    return traced.select("event_id", "result", "queue_ms", "staleness_ms", "document_clean", "passed")


def recovery_by_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour as an outage run that each consumer has to recover from on its own.

    The reader lags by what was set apart, the monitor by what it has not seen; either may be the
    one that stays behind.
    """
    hours = materialized(pipeline._by_hour(spark, sf_dir), "hours")

    def lag(consumer: str, after) -> DataFrame:
        return hours.select("hour", F.lit(consumer).alias("consumer"), (F.col("writes") * 64).alias("lag_before"), after.alias("lag_after"))

    lags = reduce(DataFrame.unionByName, [lag("reader", F.col("dead") * 6_000_000), lag("monitor", F.col("pending") * 4_000_000)])
    runs = hours.select(
        "hour", "writes", F.col("sample_delta").alias("sample_count_delta"), F.col("log_delta").alias("stream_len_delta"),
        F.col("dead").alias("dlq_len_delta"), F.col("pending").alias("pending_count_after"),
        F.lit(0).alias("active_violation_count_after"), F.lit(0).alias("exit_status"),
    )
    audited = gates.recovery_audit(runs, lags=lags, on=["hour"])
    return audited.select("hour", "conserved", "lag_recovered", "recovered")


TYPES = {"id": "bigint", "value": "double", "props": "string", "big": "boolean"}


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled rows in their own types; what was not sent stays apart from what is null."""
    events = assemble.assemble_transactions(pipeline.landed_messages(spark, sf_dir), inputs.DB, size=inputs.size(spark, sf_dir, 6))
    rows = events.select("event_id", typed_row(F.coalesce("after", "before"), TYPES).alias("r"))
    return rows.select(
        "event_id", F.col("r.id.v").alias("id"), F.col("r.value").isNotNull().alias("has_value"), F.col("r.value.v").alias("value"),
        F.col("r.props").isNotNull().alias("has_props"), F.col("r.big.v").alias("big"),
    )


def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that sent their old tuple; where its key is another one, the old key is deleted too."""
    sent = pipeline.landed_messages(spark, sf_dir)
    moved = F.col("msg_seq") % 3 == 0
    old = F.transform(
        "new_tuple",
        lambda c, i: F.when(
            (i == 0) & moved, F.struct(c["kind"].alias("kind"), (c["text"].try_cast("bigint") + 1000).cast("string").alias("text"), c["bin"].alias("bin"))
        ).otherwise(c),
    )
    sent = sent.withColumn("old_tuple", F.when((F.col("tag") == "U") & (F.col("msg_seq") % 2 == 0), old).otherwise(F.col("old_tuple")))
    events = assemble.assemble_transactions(sent, inputs.DB, emit_key_change_delete=True, size=inputs.size(spark, sf_dir, 6))
    return events.select(
        "event_id", "op", F.col("pk")["id"].alias("pk_id"), "commit_lsn", F.col("seq").cast("bigint").alias("seq"),
        F.col("before").isNotNull().alias("has_before"),
    )


QUERIES = {
    f.__name__: f
    for f in (event_hops, ordering_audit_clean, trace_events_clean, recovery_by_consumer, typed_rows, key_changes)
}

# The first readable line of each document and position.
_HOPS = OBSERVED + """,
indexer AS (
  SELECT key, lsn, arg_min(((event_no * 17) % 60)::DOUBLE, event_no) AS queue_ms,
         arg_min((20 + (event_no * 13) % 80)::DOUBLE, event_no) AS processing_ms
  FROM observed WHERE event_no % 11 <> 5 GROUP BY 1, 2
),
sampled AS (
  SELECT key, lsn, arg_min((staleness_us // 1000)::DOUBLE, event_no) AS staleness_ms
  FROM observed WHERE visible_ts_us IS NOT NULL AND event_no % 7 <> 6 GROUP BY 1, 2
),
hops AS (
  SELECT event_id, queue_ms, processing_ms, s.staleness_ms, queue_ms IS NOT NULL AND coalesce(s.staleness_ms <= 1000, FALSE) AS passed
  FROM observed LEFT JOIN indexer USING (key, lsn) LEFT JOIN sampled s USING (key, lsn)
)"""
_CLEAN = """
audited AS (
  SELECT key, NOT coalesce(max(lsn) FILTER (op = 'c' AND event_no % 50 = 1)
                           >= coalesce(max(lsn) FILTER (op = 'd'), 0), FALSE) AS document_clean
  FROM judged WHERE result = 'applied' GROUP BY key)"""

ORACLE = {
    "event_hops": with_(_HOPS) + " SELECT * FROM hops",
    "ordering_audit_clean": pipeline.ORACLE["ordering_audit"].rsplit("SELECT *,", 1)[0].rstrip() + "," + _CLEAN + """
      SELECT v.*, coalesce(document_clean, FALSE) AS document_clean,
             version_is_newest AND payload_is_newest AND markers_consistent AND coalesce(document_clean, FALSE) AS passed
      FROM verdicts v LEFT JOIN audited USING (key)""",
    "trace_events_clean": with_(_HOPS, CLASSIFIED[len(COMMITS) + 1:], _CLEAN, """
      outcome AS (SELECT event_id, arg_min(result, arrival) AS result FROM judged GROUP BY event_id)""") + """
      SELECT event_id, CASE WHEN marker_ts_us IS NOT NULL THEN result END AS result, queue_ms,
             o.staleness_us / 1000.0::DOUBLE AS staleness_ms, coalesce(document_clean, FALSE) AS document_clean,
             coalesce(o.staleness_us <= 1000000 AND o.violation_ts_us IS NULL AND result = 'applied'
                      AND marker_ts_us IS NOT NULL AND document_clean, FALSE) AS passed
      FROM observed o JOIN outcome USING (event_id) JOIN hops USING (event_id) LEFT JOIN audited USING (key)""",
    "recovery_by_consumer": with_(pipeline._HOURS) + """
      SELECT hour, writes = log_delta AND writes = sample_delta AS conserved, lag_recovered,
             writes = log_delta AND writes = sample_delta AND dead = 0 AND pending = 0 AND lag_recovered AS recovered
      FROM (SELECT *, dead * 6000000 <= writes * 64 + 5000000 AND pending * 4000000 <= writes * 64 + 5000000 AS lag_recovered FROM hours)""",
    "typed_rows": with_(COMMITS) + f"""
      SELECT event_id, key AS id, op = 'd' OR has_value AS has_value, CASE WHEN has_value THEN value END AS value,
             op = 'd' OR has_props AS has_props, CASE WHEN op <> 'd' AND xid >= 150 THEN coalesce(value > 50, FALSE) END AS big
      FROM {pipeline._ASSEMBLED}""",
    "key_changes": with_(COMMITS, f"made AS (SELECT *, xid * 8 + 2 + seq AS msg_seq FROM {pipeline._ASSEMBLED})") + """
      SELECT event_id, op, key::VARCHAR AS pk_id, commit_lsn, seq::BIGINT AS seq, op = 'd' AS has_before FROM made
      UNION ALL
      SELECT sha256('catalog|public|accounts|' || commit_lsn || '|' || xid || '|' || seq || '|old key'), 'd', (key + 1000)::VARCHAR,
             commit_lsn, seq::BIGINT, TRUE
      FROM made WHERE op = 'u' AND msg_seq % 2 = 0 AND msg_seq % 3 = 0""",
}

"""Queries over samples, violations, metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.latency import age_ms, commit_to_publish_ms, micros_to_iso, queue_latency_ms, to_ms
from tidemark.functions.lsn import long_to_lsn
from tidemark.operators import gates, markers, metrics, ranks, retention, visibility
from tidemark.operators.sizing import Sizing
from tidemark.plans import documents, inputs
from tidemark.plans.base_sql import COMMITS, LOG, MARKED, OBSERVED, with_

GRID = visibility.ProbeGrid(inputs.PROBE_PERIOD_US)
# The instant "now" of snapshot queries: just after the newest commit.
NOW_AFTER_US = 60_000_000
# Takes the forms for large inputs, whatever the size.
FORCED = Sizing(rows_per_chunk=2_000, rows_in_memory=0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.with_identity(inputs.commits(spark, sf_dir))


def observed(spark: SparkSession, sf_dir: str, *, guard: bool = False) -> DataFrame:
    """Observations of all commits against the regular probe grid."""
    rows = events(spark, sf_dir)
    return visibility.observations(
        rows, inputs.marker_table(rows), GRID, slo_us=inputs.SLO_US, guard=guard
    )


def now_of(rows: DataFrame) -> Column:
    return (rows.agg(F.max("commit_ts_us")) .scalar() + F.lit(NOW_AFTER_US)).cast("bigint")


def marker_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of every 31st event carry another commit's position and do not count."""
    rows = events(spark, sf_dir)
    off = F.when(F.col("event_no") % 31 == 0, F.lit(64)).otherwise(F.lit(0))
    stored = inputs.marker_times(rows).filter(F.col("marker_ts_us").isNotNull()).select(
        "event_id", (F.col("lsn") + off).alias("lsn"), "marker_ts_us"
    )
    seen = visibility.marker_status(rows, stored)
    return seen.groupBy("op", "marker_status").agg(F.count("*").alias("events"))


def staleness_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visibility.samples(observed(spark, sf_dir))
    return found.select("event_id", "visible_ts_us", to_ms(F.col("staleness_us")).alias("staleness_ms"))


def looks(spark: SparkSession, sf_dir: str, size: Sizing | None = None) -> visibility.ProbeTimes:
    """Reads happen when somebody looks: each ``view`` in the table is a probe instant."""
    views = inputs.table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return visibility.probe_times(
        views.select(inputs.wall_micros("ts").alias("probe_ts_us")), size=size or inputs.size(spark, sf_dir, 5)
    )


def first_probe_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.marker_times(events(spark, sf_dir)).select("event_id", "marker_ts_us")
    probes = looks(spark, sf_dir)
    return visibility.first_probe(rows, "marker_ts_us", probes, "visible_ts_us")


def first_probe_irregular_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by chunks, forced."""
    rows = inputs.marker_times(events(spark, sf_dir)).select("event_id", "marker_ts_us")
    return visibility.first_probe(rows, "marker_ts_us", looks(spark, sf_dir, FORCED), "visible_ts_us")


def guarded_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular probes with the commit-time guard, summed up per outcome."""
    rows = events(spark, sf_dir)
    probes = looks(spark, sf_dir)
    obs = visibility.observations(rows, inputs.marker_table(rows), probes, slo_us=inputs.SLO_US, identity="event_no")
    outcome = (
        F.when(F.col("visible_ts_us").isNotNull(), "visible")
        .when(F.col("rejected_ts_us").isNotNull(), "rejected")
        .otherwise("in_flight")
    )
    return obs.groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("violation_ts_us").isNotNull()).alias("violations"),
        F.sum("staleness_us").alias("staleness_us"),
        F.sum("detection_delay_us").alias("detection_delay_us"),
    )


def staleness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.staleness_summary(visibility.samples(observed(spark, sf_dir)), size=inputs.size(spark, sf_dir, 1))


def staleness_by_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.staleness_summary(
        visibility.samples(observed(spark, sf_dir)), ["op"], size=inputs.size(spark, sf_dir, 1)
    )


def staleness_by_op_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile form for groups of any size, forced."""
    found = visibility.samples(observed(spark, sf_dir)).select("op", "staleness_us")
    picked = ranks.ranks_by_running_count(
        found, ["op"], "staleness_us", metrics.STALENESS_RANKS, size=Sizing(rows_per_chunk=2_000)
    )
    return picked.select("op", *[to_ms(F.col(n)).alias(f"{n}_ms") for n in metrics.STALENESS_RANKS])


def staleness_summary_empty_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No sample is negative: one row without samples."""
    none = visibility.samples(observed(spark, sf_dir)).filter(F.col("staleness_us") < 0)
    return metrics.staleness_summary(none, size=FORCED)


def staleness_null_group_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions are a group without a name."""
    found = visibility.samples(observed(spark, sf_dir)).withColumn("kind", F.when(F.col("op") != "d", F.col("op")))
    return metrics.staleness_summary(found, ["kind"], size=FORCED)


def metrics_snapshot_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_snapshot(observed(spark, sf_dir), now_of(events(spark, sf_dir)), size=FORCED)


def staleness_last_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling window of the newest 10 000 samples."""
    return metrics.staleness_summary(
        visibility.samples(observed(spark, sf_dir)), last=metrics.SAMPLE_WINDOW
    )


def last_n_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visibility.samples(observed(spark, sf_dir))
    newest = retention.last_n(found, metrics.SAMPLE_WINDOW, ["visible_ts_us", "lsn", "seq"])
    return newest.select("event_id", "visible_ts_us", "staleness_us")


def last_n_samples_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rolling window that is smaller than the samples there are."""
    found = visibility.samples(observed(spark, sf_dir))
    newest = retention.last_n(found, 500, ["visible_ts_us", "lsn", "seq"])
    return newest.select("event_id", "visible_ts_us", "staleness_us")


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visibility.violations(observed(spark, sf_dir))
    return found.select("event_id", "key", "violation_ts_us", "detection_delay_us")


def detection_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visibility.violations(observed(spark, sf_dir))
    ranked = ranks.nearest_ranks(found, ["op"], "detection_delay_us", {"p99": 0.99}, size=inputs.size(spark, sf_dir, 1))
    return ranked.select("op", to_ms(F.col("p99")).alias("p99_detection_delay_ms"))


def active_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observed(spark, sf_dir)
    active = visibility.active_violations(obs, now_of(events(spark, sf_dir)))
    return active.select("event_id", "violation_ts_us", "active_us")


def in_flight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.in_flight_summary(observed(spark, sf_dir), now_of(events(spark, sf_dir)), ["op"])


def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.violation_summary(
        observed(spark, sf_dir), now_of(events(spark, sf_dir)), ["op"], size=inputs.size(spark, sf_dir, 1)
    )


def tracked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits spread over three tables of which two are tracked."""
    names = F.array(F.lit("accounts"), F.lit("orders"), F.lit("audit"))
    rows = inputs.commits(spark, sf_dir).select("event_no", "key", names[F.pmod("key", F.lit(3))].alias("table"))
    return visibility.tracked_events(rows, ["accounts", "orders"])


def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observed(spark, sf_dir)
    return metrics.metrics_snapshot(
        obs, now_of(events(spark, sf_dir)), ready={"replication": True, "probe": True},
        size=inputs.size(spark, sf_dir, 1),
    )


def metrics_snapshot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As an online monitor would show it: the age guard on, only the newest 10 000 samples."""
    obs = observed(spark, sf_dir, guard=True)
    return metrics.metrics_snapshot(
        obs, now_of(events(spark, sf_dir)), sample_window=metrics.SAMPLE_WINDOW,
        size=inputs.size(spark, sf_dir, 1),
    )


def metrics_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _with_day(observed(spark, sf_dir))
    return metrics.metrics_snapshot(obs, now_of(events(spark, sf_dir)), ["day", "op"], size=inputs.size(spark, sf_dir, 1))


def _with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.expr("commit_ts_us div 86400000000"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics history: one row per day, with readiness, backlog and lag columns."""
    obs = _with_day(observed(spark, sf_dir))
    daily = metrics.metrics_snapshot(obs, now_of(events(spark, sf_dir)), ["day"], size=inputs.size(spark, sf_dir, 1))
    return daily.withColumns(
        {
            "replication_ready": F.pmod("day", F.lit(7)) != 3,
            "probe_ready": F.pmod("day", F.lit(11)) != 5,
            "pending_count": F.col("in_flight_count"),
            "dlq_len": F.col("violation_count"),
            "lag_bytes": F.col("sample_count") * 15_000,
        }
    )


def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.health_status(_history(spark, sf_dir)).select("day", "ready", "healthy", "status")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir).withColumn("source", F.lit(inputs.TABLE))
    return gates.alerts(history, ["source"], "day")


def slo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _history(spark, sf_dir)
    kept = ["day", "sample_count", "p99_staleness_ms", "p99_detection_delay_ms", "violation_count"]
    gated = gates.slo_gate(daily.select(*kept), min_samples=10, staleness_bound_ms=1200.0)
    probed = gates.slo_gate(
        gated.withColumnsRenamed({"passed": "slo_passed", "reason": "slo_reason"}),
        min_samples=10, detection_bound_ms=100.0, violation_test=True,
    )
    return probed.withColumnsRenamed({"passed": "violation_passed", "reason": "violation_reason"})


def violation_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.violation_artifact(_history(spark, sf_dir)).select(
        "day", "violation_count", "active_violation_count", "violation_detected",
        "p99_detection_delay_ms", "detection_within_slo",
    )


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observed(spark, sf_dir)
    by_op = metrics.metrics_snapshot(obs, now_of(events(spark, sf_dir)), ["op"], size=inputs.size(spark, sf_dir, 1))
    return metrics.metrics_long(by_op, ["op"])


def ack_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    frontier = visibility.ack_frontier(observed(spark, sf_dir))
    return frontier.withColumn("frontier", long_to_lsn("frontier_lsn"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish, dequeue, marker and probe times of every sampled event."""
    found = visibility.samples(observed(spark, sf_dir))
    number = F.col("event_no")
    published = F.col("commit_ts_us") + 1000 * (5 + (number * 31) % 40)
    return found.withColumn("published_ts_us", published).withColumn(
        "dequeue_ts_us", F.col("published_ts_us") + 1000 * ((number * 17) % 60)
    )


def hop_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hops(spark, sf_dir).withColumns(
        {
            "publish_us": F.col("published_ts_us") - F.col("commit_ts_us"),
            "wake_us": F.col("dequeue_ts_us") - F.col("published_ts_us"),
            "index_us": F.col("marker_ts_us") - F.col("dequeue_ts_us"),
            "probe_us": F.col("visible_ts_us") - F.col("marker_ts_us"),
        }
    )
    stages = {"publish": "publish_us", "wake_up": "wake_us", "index": "index_us", "probe": "probe_us"}
    return metrics.hop_latency_summary(rows, stages, size=inputs.size(spark, sf_dir, 4))


def event_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops(spark, sf_dir).select(
        "event_no",
        age_ms(F.col("visible_ts_us"), F.col("commit_ts_us")).alias("age_ms"),
        commit_to_publish_ms(F.col("published_ts_us"), F.col("commit_ts_us")).alias("publish_ms"),
        queue_latency_ms(F.col("dequeue_ts_us"), F.col("published_ts_us")).alias("queue_ms"),
        micros_to_iso(F.col("commit_ts_us")).alias("committed_at"),
    )


def expired_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.marker_times(events(spark, sf_dir)).filter(F.col("marker_ts_us").isNotNull())
    latest = rows.agg(F.max("commit_ts_us")).scalar()
    return markers.expired_markers(rows, latest).select("event_id", "commit_ts_us")


def purge_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean-up run of at most 3 x 1000 markers, oldest first."""
    rows = inputs.marker_times(events(spark, sf_dir)).filter(F.col("marker_ts_us").isNotNull())
    latest = rows.agg(F.max("commit_ts_us")).scalar()
    return markers.purge_markers(rows, latest, max_rounds=3).select("event_id", "commit_ts_us")


def trim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5 000 entries of the log, the cut-off found by running counts."""
    log = inputs.change_log(spark, sf_dir)
    return retention.trim_log(log, 5_000).select("arrival", "event_no")


def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir).select("lsn", "arrival", "event_no")
    return retention.commit_order(log)


def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after the middle of the delivery positions."""
    log = inputs.change_log(spark, sf_dir).select("arrival", "event_no")
    return retention.read_range(log, log.agg(F.expr("(min(arrival) + max(arrival)) div 2")).scalar())


def events_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir).select("key", "arrival", "event_no", "op")
    return retention.events_for_key(log, "7")


def commit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of an inclusive time range: the second week of the data."""
    lo = 1_704_067_200_000_000 + 7 * 86_400_000_000
    rows = inputs.commits(spark, sf_dir).select("event_no", "commit_ts_us")
    return visibility.commit_range(rows, lo, lo + 7 * 86_400_000_000)


def time_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected commits as seen one day before the newest commit."""
    rows = inputs.commits(spark, sf_dir).select("event_no", "commit_ts_us")
    now = (rows.agg(F.max("commit_ts_us")).scalar() - F.lit(86_400_000_000)).cast("bigint")
    ok, bad = visibility.commit_time_guard(rows, now)
    columns = ["event_no", "commit_ts_us", "accepted"]
    return ok.withColumn("accepted", F.lit(True)).select(*columns).unionByName(
        bad.withColumn("accepted", F.lit(False)).select(*columns)
    )


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries grouped into batches of one million positions of arrival."""
    rows = documents.classified(spark, sf_dir).withColumns(
        {
            "batch_id": F.expr("arrival div 100000000"),
            "queue_us": 1000 * ((F.col("event_no") * 17) % 60),
            "processing_us": 1000 * (20 + (F.col("event_no") * 13) % 80),
        }
    )
    return metrics.batch_metrics(rows)


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = metrics.batch_totals(batch_metrics(spark, sf_dir))
    return totals.select(
        "batches_total", "processed_events_total", "document_tasks_total", "marker_tasks_total"
    )


def lag_by_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers that confirm at different rates, described in text positions."""
    rows = inputs.commits(spark, sf_dir)
    reader = F.when(F.col("op") == "d", "monitor").otherwise("indexer")
    slots = rows.select(
        reader.alias("consumer"),
        long_to_lsn("lsn").alias("head_lsn"),
        long_to_lsn(F.when(F.col("op") == "u", F.col("lsn") - 4096).otherwise(F.col("lsn"))).alias("confirmed_lsn"),
    )
    return metrics.lag_by_consumer(slots)


def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _with_day(observed(spark, sf_dir))
    return obs.groupBy("day").agg(
        F.count("*").alias("stream_len"),
        F.count("visible_ts_us").alias("sample_count"),
        F.count_if(F.col("visible_ts_us").isNull()).alias("pending_count"),
        F.count_if(F.col("violation_ts_us").isNotNull() & F.col("visible_ts_us").isNull()).alias(
            "active_violation_count"
        ),
        (F.max("lsn") - F.min("lsn")).alias("lag_bytes"),
    ).withColumn("dlq_len", F.col("pending_count"))


RUN_MEASURES = ["stream_len", "sample_count", "dlq_len", "pending_count", "active_violation_count", "lag_bytes"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day against the day before, as a before/after pair of one run."""
    daily = _daily_counts(spark, sf_dir)
    before = daily.withColumn("day", F.col("day") + 1)
    return gates.compare_runs(before, daily, ["day"], RUN_MEASURES)


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return runs.select("day", *[f"{m}_{s}" for m in ("stream_len", "lag_bytes") for s in ("before", "after", "delta")])


def recovery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumns(
        {"writes": F.col("stream_len_delta"), "exit_status": F.lit(0)}
    )
    audited = gates.recovery_audit(runs)
    return audited.select("day", "conserved", "lag_recovered", "recovered")


def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily_counts(spark, sf_dir)
    deltas = daily.select(
        "day", F.col("stream_len").alias("writes"), F.col("stream_len").alias("log_delta"),
        F.col("sample_count").alias("sample_delta"),
    )
    return metrics.conservation(deltas)


def backlog_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily_counts(spark, sf_dir).select("day", "stream_len").withColumn("source", F.lit(inputs.TABLE))
    return gates.backlog_growth(daily, ["source"], "day", "stream_len")


def capacity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs at 1, 2, 4 and 8 replicas; every key belongs to one run."""
    replicas = F.pow(F.lit(2), F.pmod("key", F.lit(4))).cast("int")
    obs = observed(spark, sf_dir).withColumn("label", F.concat(F.lit("capacity-"), replicas, F.lit("replicas")))
    now = now_of(events(spark, sf_dir))
    measured = metrics.metrics_snapshot(
        obs, now, ["label"], size=inputs.size(spark, sf_dir, 1),
        counts={"documents": ("key", F.count_distinct("key")), "source_rows": ("key", F.count(F.lit(1)))},
    )
    record = gates.run_record(
        measured, {"counts": F.struct("documents", "source_rows")}, F.col("label"), micros_to_iso(now)
    )
    return gates.capacity_matrix(record)


QUERIES = {
    f.__name__: f
    for f in (
        marker_statuses, staleness_samples, first_probe_irregular, guarded_observations, staleness_summary,
        staleness_by_op, staleness_by_op_running_counts, staleness_last_window, last_n_samples, violations,
        detection_delay, active_violations, in_flight_summary, violation_summary, tracked_events, metrics_snapshot, metrics_snapshot_window, metrics_by_day,
        health_status, alerts, slo_gate, violation_artifact, metrics_long, ack_frontier, hop_latency,
        event_latencies, expired_markers, purge_markers, trim_log, commit_order, read_range, events_of_key,
        commit_window, time_guard, batch_metrics, batch_totals, lag_by_consumer, compare_runs,
        recovery_audit, conservation, backlog_growth, capacity_matrix, first_probe_irregular_chunked,
        last_n_samples_small, staleness_summary_empty_forced, staleness_null_group_forced, metrics_snapshot_forced,
    )
}

_SUMMARY = """count(*) AS sample_count,
  quantile_disc(staleness_us, 0.5) / 1000.0::DOUBLE AS p50_staleness_ms,
  quantile_disc(staleness_us, 0.95) / 1000.0::DOUBLE AS p95_staleness_ms,
  quantile_disc(staleness_us, 0.99) / 1000.0::DOUBLE AS p99_staleness_ms,
  max(staleness_us) / 1000.0::DOUBLE AS max_staleness_ms"""

# As known just after the newest commit.
_AT_NOW = OBSERVED + """,
at_now AS (
  SELECT *, now - commit_ts_us AS age_us,
         coalesce(visible_ts_us <= now, FALSE) AS is_sample,
         coalesce(violation_ts_us <= now, FALSE) AS is_violation
  FROM observed, (SELECT max(commit_ts_us) + 60000000 AS now FROM commits)
)"""
_SNAPSHOT = """count(*) FILTER (is_sample) AS sample_count,
  quantile_disc(staleness_us, 0.5) FILTER (is_sample) / 1000.0::DOUBLE AS p50_staleness_ms,
  quantile_disc(staleness_us, 0.95) FILTER (is_sample) / 1000.0::DOUBLE AS p95_staleness_ms,
  quantile_disc(staleness_us, 0.99) FILTER (is_sample) / 1000.0::DOUBLE AS p99_staleness_ms,
  max(staleness_us) FILTER (is_sample) / 1000.0::DOUBLE AS max_staleness_ms,
  count(*) FILTER (NOT is_sample) AS in_flight_count,
  max(age_us) FILTER (NOT is_sample) / 1000.0::DOUBLE AS oldest_in_flight_age_ms,
  count(*) FILTER (is_violation) AS violation_count,
  count(*) FILTER (is_violation AND NOT is_sample) AS active_violation_count,
  quantile_disc(detection_delay_us, 0.99) FILTER (is_violation) / 1000.0::DOUBLE AS p99_detection_delay_ms,
  round(coalesce(max(now - violation_ts_us) FILTER (is_violation AND NOT is_sample) / 1000000.0::DOUBLE, 0), 3)
    AS violation_duration_seconds"""
_HISTORY = _AT_NOW + f""",
history AS (
  SELECT *, day % 7 <> 3 AS replication_ready, day % 11 <> 5 AS probe_ready,
         in_flight_count AS pending_count, violation_count AS dlq_len, sample_count * 15000 AS lag_bytes
  FROM (SELECT commit_ts_us // 86400000000 AS day, {_SNAPSHOT} FROM at_now GROUP BY 1)
)"""
_DAILY = OBSERVED + """,
daily AS (
  SELECT commit_ts_us // 86400000000 AS day, count(*) AS stream_len, count(visible_ts_us) AS sample_count,
         count(*) FILTER (visible_ts_us IS NULL) AS pending_count,
         count(*) FILTER (visible_ts_us IS NULL) AS dlq_len,
         count(*) FILTER (visible_ts_us IS NULL AND violation_ts_us IS NOT NULL) AS active_violation_count,
         max(lsn) - min(lsn) AS lag_bytes
  FROM observed GROUP BY 1
)"""
_RUNS = _DAILY + ",\nruns AS (SELECT coalesce(a.day, b.day + 1) AS day, " + ", ".join(
    f"b.{m} AS {m}_before, a.{m} AS {m}_after, a.{m} - b.{m} AS {m}_delta" for m in RUN_MEASURES
) + " FROM daily a FULL JOIN daily b ON a.day = b.day + 1)"
_METRIC_LIST = ", ".join(
    f"('{name}', {c}::DOUBLE, '{kind}')" for c, (name, kind) in metrics.EXPOSED_METRICS.items()
)
_HOPS = OBSERVED + """,
hops AS (
  SELECT *, commit_ts_us + 1000 * (5 + (event_no * 31) % 40) AS published_ts_us,
         commit_ts_us + 1000 * (5 + (event_no * 31) % 40) + 1000 * ((event_no * 17) % 60) AS dequeue_ts_us
  FROM observed WHERE visible_ts_us IS NOT NULL
)"""
_LOOKS = """looks AS (SELECT DISTINCT epoch_us(ts) AS probe_ts_us FROM events WHERE event_type = 'view')"""

ORACLE = {
    "marker_statuses": with_(MARKED) + """
      SELECT op, CASE WHEN marker_ts_us IS NULL THEN 'missing' WHEN event_no % 31 = 0 THEN 'wrong_marker'
                      ELSE 'visible' END AS marker_status, count(*) AS events
      FROM marked GROUP BY 1, 2""",
    "staleness_samples": with_(OBSERVED) + """
      SELECT event_id, visible_ts_us, staleness_us / 1000.0::DOUBLE AS staleness_ms
      FROM observed WHERE visible_ts_us IS NOT NULL""",
    "first_probe_irregular": with_(MARKED, _LOOKS) + """
      SELECT event_id, marker_ts_us, probe_ts_us AS visible_ts_us
      FROM marked ASOF LEFT JOIN looks ON marker_ts_us <= probe_ts_us""",
    "first_probe_irregular_chunked": with_(MARKED, _LOOKS) + """
      SELECT event_id, marker_ts_us, probe_ts_us AS visible_ts_us
      FROM marked ASOF LEFT JOIN looks ON marker_ts_us <= probe_ts_us""",
    "guarded_observations": with_(MARKED, _LOOKS, """
      timed AS (SELECT *, commit_ts_us + 1000001 AS late_from, commit_ts_us + 86400000001 AS old_from FROM marked)""",
      "p1 AS (SELECT t.*, probe_ts_us AS v FROM timed t ASOF LEFT JOIN looks ON greatest(marker_ts_us, commit_ts_us + CASE WHEN marker_ts_us IS NULL THEN NULL ELSE 0 END) <= probe_ts_us)",
      "p2 AS (SELECT p1.*, probe_ts_us AS late FROM p1 ASOF LEFT JOIN looks ON late_from <= probe_ts_us)",
      "p3 AS (SELECT p2.*, probe_ts_us AS old FROM p2 ASOF LEFT JOIN looks ON old_from <= probe_ts_us)", """
      judged AS (
        SELECT *, CASE WHEN v IS NULL OR v >= old THEN old END AS rejected,
               late IS NOT NULL AND (v IS NULL OR late < v) AND (old IS NULL OR late < old) AS violated
        FROM (SELECT * REPLACE (CASE WHEN marker_ts_us IS NULL THEN NULL ELSE v END AS v) FROM p3))""") + """
      SELECT CASE WHEN v IS NOT NULL AND rejected IS NULL THEN 'visible'
                  WHEN rejected IS NOT NULL THEN 'rejected' ELSE 'in_flight' END AS outcome,
             count(*) AS events, count(*) FILTER (violated) AS violations,
             CAST(sum(v - commit_ts_us) FILTER (rejected IS NULL) AS BIGINT) AS staleness_us,
             CAST(sum(late - commit_ts_us - 1000000) FILTER (violated) AS BIGINT) AS detection_delay_us
      FROM judged GROUP BY 1""",
    "staleness_summary": with_(OBSERVED) + f" SELECT {_SUMMARY} FROM observed WHERE visible_ts_us IS NOT NULL",
    "staleness_by_op": with_(OBSERVED)
    + f" SELECT op, {_SUMMARY} FROM observed WHERE visible_ts_us IS NOT NULL GROUP BY op",
    "staleness_summary_empty_forced": with_(OBSERVED) + f" SELECT {_SUMMARY} FROM observed WHERE staleness_us < 0",
    "staleness_null_group_forced": with_(OBSERVED) + f"""
      SELECT CASE WHEN op <> 'd' THEN op END AS kind, {_SUMMARY}
      FROM observed WHERE visible_ts_us IS NOT NULL GROUP BY 1""",
    "metrics_snapshot_forced": with_(_AT_NOW)
    + f" SELECT {_SNAPSHOT} FROM at_now",
    "staleness_by_op_running_counts": with_(OBSERVED) + """
      SELECT op, quantile_disc(staleness_us, 0.5) / 1000.0::DOUBLE AS p50_ms,
             quantile_disc(staleness_us, 0.95) / 1000.0::DOUBLE AS p95_ms,
             quantile_disc(staleness_us, 0.99) / 1000.0::DOUBLE AS p99_ms
      FROM observed WHERE visible_ts_us IS NOT NULL GROUP BY op""",
    "staleness_last_window": with_(OBSERVED) + f"""
      SELECT {_SUMMARY} FROM (SELECT * FROM observed WHERE visible_ts_us IS NOT NULL
        ORDER BY visible_ts_us DESC, lsn DESC, seq DESC LIMIT 10000)""",
    "last_n_samples": with_(OBSERVED) + """
      SELECT event_id, visible_ts_us, staleness_us FROM observed WHERE visible_ts_us IS NOT NULL
      ORDER BY visible_ts_us DESC, lsn DESC, seq DESC LIMIT 10000""",
    "last_n_samples_small": with_(OBSERVED) + """
      SELECT event_id, visible_ts_us, staleness_us FROM observed WHERE visible_ts_us IS NOT NULL
      ORDER BY visible_ts_us DESC, lsn DESC, seq DESC LIMIT 500""",
    "violations": with_(OBSERVED) + """
      SELECT event_id, key, violation_ts_us, detection_delay_us FROM observed WHERE violation_ts_us IS NOT NULL""",
    "detection_delay": with_(OBSERVED) + """
      SELECT op, quantile_disc(detection_delay_us, 0.99) / 1000.0::DOUBLE AS p99_detection_delay_ms
      FROM observed WHERE violation_ts_us IS NOT NULL GROUP BY op""",
    "active_violations": with_(_AT_NOW) + """
      SELECT event_id, violation_ts_us, now - violation_ts_us AS active_us FROM at_now
      WHERE is_violation AND NOT is_sample""",
    "in_flight_summary": with_(_AT_NOW) + """
      SELECT op, count(*) FILTER (NOT is_sample) AS in_flight_count,
             max(age_us) FILTER (NOT is_sample) / 1000.0::DOUBLE AS oldest_in_flight_age_ms FROM at_now GROUP BY op""",
    "violation_summary": with_(_AT_NOW, f"by_op AS (SELECT op, {_SNAPSHOT} FROM at_now GROUP BY op)") + """
      SELECT op, violation_count, active_violation_count, p99_detection_delay_ms, violation_duration_seconds
      FROM by_op""",
    "tracked_events": with_(COMMITS) + """
      SELECT event_no, key, ['accounts', 'orders', 'audit'][key % 3 + 1] AS "table" FROM commits WHERE key % 3 <> 2""",
    "metrics_snapshot": with_(_AT_NOW)
    + f" SELECT {_SNAPSHOT}, TRUE AS replication_ready, TRUE AS probe_ready FROM at_now",
    "metrics_snapshot_window": with_(_AT_NOW, """
      old AS (SELECT *, ((commit_ts_us + 86400000000) // 120000 + 1) * 120000 AS old_ts_us FROM at_now)""", """
      live AS (SELECT *, NOT is_sample AND old_ts_us > now AS is_open FROM old)""", """
      newest AS (SELECT * FROM live WHERE is_sample ORDER BY visible_ts_us DESC, lsn DESC, seq DESC LIMIT 10000)""", """
      caught AS (SELECT * FROM live WHERE is_violation
                 ORDER BY violation_ts_us DESC, lsn DESC, seq DESC LIMIT 10000)""", """
      s AS (SELECT count(*) AS sample_count,
              quantile_disc(staleness_us, 0.5) / 1000.0::DOUBLE AS p50_staleness_ms,
              quantile_disc(staleness_us, 0.95) / 1000.0::DOUBLE AS p95_staleness_ms,
              quantile_disc(staleness_us, 0.99) / 1000.0::DOUBLE AS p99_staleness_ms,
              max(staleness_us) / 1000.0::DOUBLE AS max_staleness_ms FROM newest)""", """
      d AS (SELECT quantile_disc(detection_delay_us, 0.99) / 1000.0::DOUBLE AS p99_detection_delay_ms FROM caught)""") + """
      SELECT any_value(s.sample_count) AS sample_count, any_value(s.p50_staleness_ms) AS p50_staleness_ms,
             any_value(s.p95_staleness_ms) AS p95_staleness_ms, any_value(s.p99_staleness_ms) AS p99_staleness_ms,
             any_value(s.max_staleness_ms) AS max_staleness_ms,
             count(*) FILTER (is_open) AS in_flight_count,
             max(age_us) FILTER (is_open) / 1000.0::DOUBLE AS oldest_in_flight_age_ms,
             count(*) FILTER (is_violation) AS violation_count,
             count(*) FILTER (is_violation AND is_open) AS active_violation_count,
             any_value(d.p99_detection_delay_ms) AS p99_detection_delay_ms,
             round(coalesce(max(now - violation_ts_us) FILTER (is_violation AND is_open) / 1000000.0::DOUBLE, 0), 3)
               AS violation_duration_seconds
      FROM live, s, d""",
    "metrics_by_day": with_(_AT_NOW)
    + f" SELECT commit_ts_us // 86400000000 AS day, op, {_SNAPSHOT} FROM at_now GROUP BY 1, 2",
    "health_status": with_(_HISTORY) + """
      SELECT day, replication_ready AND probe_ready AS ready,
             replication_ready AND probe_ready AND active_violation_count = 0 AS healthy,
             CASE WHEN NOT (replication_ready AND probe_ready) THEN 'unavailable'
                  WHEN active_violation_count > 0 THEN 'STALE' ELSE 'ok' END AS status
      FROM history""",
    "alerts": with_(_HISTORY) + """
      SELECT 'accounts' AS source, day, alert, value, lim AS "limit" FROM (
        SELECT day, unnest([
          {'alert': 'active_violations', 'value': active_violation_count::DOUBLE, 'lim': 0.0::DOUBLE},
          {'alert': 'p99_staleness', 'value': p99_staleness_ms, 'lim': 1000.0::DOUBLE},
          {'alert': 'detection_delay', 'value': p99_detection_delay_ms, 'lim': 500.0::DOUBLE},
          {'alert': 'replication_not_ready', 'value': (NOT replication_ready)::INTEGER::DOUBLE, 'lim': 0.0::DOUBLE},
          {'alert': 'probe_not_ready', 'value': (NOT probe_ready)::INTEGER::DOUBLE, 'lim': 0.0::DOUBLE},
          {'alert': 'pending_growth', 'value': (pending_count - lag(pending_count) OVER (ORDER BY day))::DOUBLE,
           'lim': 0.0::DOUBLE},
          {'alert': 'dead_letter_growth', 'value': (dlq_len - lag(dlq_len) OVER (ORDER BY day))::DOUBLE,
           'lim': 0.0::DOUBLE},
          {'alert': 'retained_log', 'value': lag_bytes::DOUBLE, 'lim': 5000000.0::DOUBLE}], recursive := true)
        FROM history) WHERE value > lim""",
    "slo_gate": with_(_HISTORY) + """
      SELECT day, sample_count, p99_staleness_ms, p99_detection_delay_ms, violation_count,
             slo_reason, slo_reason IS NULL AS slo_passed,
             violation_reason, violation_reason IS NULL AS violation_passed
      FROM (SELECT *, CASE WHEN sample_count < 10 THEN 'too few samples'
                           WHEN p99_staleness_ms IS NULL OR p99_staleness_ms > 1200 THEN 'p99 staleness over bound'
                      END AS slo_reason,
                   CASE WHEN sample_count < 10 THEN 'too few samples'
                        WHEN violation_count < 1 THEN 'no violation observed'
                        WHEN p99_detection_delay_ms IS NULL OR p99_detection_delay_ms > 100
                          THEN 'detection delay over bound' END AS violation_reason
            FROM history)""",
    "violation_artifact": with_(_HISTORY) + """
      SELECT day, violation_count, active_violation_count, violation_count > 0 AS violation_detected,
             p99_detection_delay_ms, p99_detection_delay_ms <= 500 AS detection_within_slo FROM history""",
    "metrics_long": with_(_AT_NOW, f"by_op AS (SELECT op, {_SNAPSHOT} FROM at_now GROUP BY op)") + """
      SELECT op, m.metric, coalesce(m.value, 'NaN'::DOUBLE) AS value, m.kind
      FROM by_op, LATERAL (SELECT * FROM (VALUES """ + _METRIC_LIST + """) v(metric, value, kind)) m""",
    "ack_frontier": with_(OBSERVED, "open AS (SELECT min(lsn) AS lsn FROM observed WHERE visible_ts_us IS NULL)") + """
      SELECT max(lsn) AS frontier_lsn, printf('%X/%X', max(lsn) >> 32, max(lsn) & 4294967295) AS frontier
      FROM observed WHERE lsn < (SELECT lsn FROM open) OR (SELECT lsn FROM open) IS NULL""",
    "hop_latency": with_(_HOPS, """
      long AS (
        SELECT 'publish' AS hop, published_ts_us - commit_ts_us AS us, 10.0::DOUBLE AS budget_ms FROM hops
        UNION ALL SELECT 'wake_up', dequeue_ts_us - published_ts_us, 15.0 FROM hops
        UNION ALL SELECT 'index', marker_ts_us - dequeue_ts_us, 400.0 FROM hops
        UNION ALL SELECT 'probe', visible_ts_us - marker_ts_us, 50.0 FROM hops)""") + """
      SELECT hop, quantile_disc(us, 0.5) / 1000.0::DOUBLE AS p50_ms,
             quantile_disc(us, 0.99) / 1000.0::DOUBLE AS p99_ms, any_value(budget_ms) AS budget_ms,
             quantile_disc(us, 0.99) / 1000.0::DOUBLE <= any_value(budget_ms) AS within_budget
      FROM long GROUP BY hop""",
    "event_latencies": with_(_HOPS) + """
      SELECT event_no, (visible_ts_us - commit_ts_us) / 1000.0::DOUBLE AS age_ms,
             (published_ts_us - commit_ts_us) / 1000.0::DOUBLE AS publish_ms,
             greatest(0, dequeue_ts_us - published_ts_us) / 1000.0::DOUBLE AS queue_ms,
             strftime(make_timestamp(commit_ts_us), '%Y-%m-%dT%H:%M:%S')
               || CASE WHEN commit_ts_us % 1000000 = 0 THEN ''
                       ELSE '.' || lpad((commit_ts_us % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS committed_at
      FROM hops""",
    "expired_markers": with_(MARKED) + """
      SELECT event_id, commit_ts_us FROM marked WHERE marker_ts_us IS NOT NULL
        AND commit_ts_us < (SELECT max(commit_ts_us) FROM marked WHERE marker_ts_us IS NOT NULL) - 604800000000""",
    "purge_markers": with_(MARKED, "m AS (SELECT * FROM marked WHERE marker_ts_us IS NOT NULL)", """
      doomed AS (SELECT event_id FROM m
        WHERE commit_ts_us < (SELECT max(commit_ts_us) FROM m) - 604800000000
        ORDER BY commit_ts_us, event_id LIMIT 3000)""") + """
      SELECT event_id, commit_ts_us FROM m WHERE event_id NOT IN (SELECT event_id FROM doomed)""",
    "trim_log": with_(LOG) + " SELECT arrival, event_no FROM log ORDER BY arrival DESC LIMIT 5000",
    "commit_order": with_(LOG) + " SELECT lsn, arrival, event_no FROM log ORDER BY lsn, arrival",
    "read_range": with_(LOG) + """
      SELECT arrival, event_no FROM log
      WHERE arrival > (SELECT (min(arrival) + max(arrival)) // 2 FROM log)""",
    "events_of_key": with_(LOG) + " SELECT key, arrival, event_no, op FROM log WHERE CAST(key AS VARCHAR) = '7'",
    "commit_window": with_(COMMITS) + """
      SELECT event_no, commit_ts_us FROM commits
      WHERE commit_ts_us BETWEEN 1704067200000000 + 7 * 86400000000 AND 1704067200000000 + 14 * 86400000000""",
    "time_guard": with_(COMMITS) + """
      SELECT event_no, commit_ts_us,
             (SELECT max(commit_ts_us) - 86400000000 FROM commits) - commit_ts_us BETWEEN -60000000 AND 86400000000
               AS accepted
      FROM commits""",
    "batch_metrics": with_(documents.CLASSIFIED) + """
      SELECT arrival // 100000000 AS batch_id, count(*) AS processed_events,
             count(*) FILTER (result = 'applied') AS document_writes, count(*) AS marker_writes,
             sum(1000 * ((event_no * 17) % 60)) / 1000.0::DOUBLE AS queue_ms_total,
             sum(1000 * (20 + (event_no * 13) % 80)) / 1000.0::DOUBLE AS processing_ms_total
      FROM judged GROUP BY 1""",
    "batch_totals": with_(documents.CLASSIFIED) + """
      SELECT count(*) AS batches_total, CAST(sum(n) AS BIGINT) AS processed_events_total,
             count(*) FILTER (w > 0) AS document_tasks_total, count(*) AS marker_tasks_total
      FROM (SELECT count(*) AS n, count(*) FILTER (result = 'applied') AS w FROM judged
            GROUP BY arrival // 100000000)""",
    "lag_by_consumer": with_(COMMITS) + """
      SELECT CASE op WHEN 'd' THEN 'monitor' ELSE 'indexer' END AS consumer,
             (SELECT max(lsn) FROM commits) - max(CASE op WHEN 'u' THEN lsn - 4096 ELSE lsn END) AS lag_bytes
      FROM commits GROUP BY 1""",
    "compare_runs": with_(_RUNS) + " SELECT day, " + ", ".join(
        f"{m}_{s}" for m in ("stream_len", "lag_bytes") for s in ("before", "after", "delta")
    ) + " FROM runs",
    "recovery_audit": with_(_RUNS) + """
      SELECT day, sample_count_delta = stream_len_delta AND stream_len_delta IS NOT NULL
                  OR CASE WHEN stream_len_delta IS NULL THEN NULL ELSE FALSE END AS conserved,
             lag_bytes_after <= coalesce(lag_bytes_before, 0) + 5000000 AS lag_recovered,
             coalesce(sample_count_delta = stream_len_delta AND dlq_len_delta = 0 AND pending_count_after = 0
               AND active_violation_count_after = 0
               AND lag_bytes_after <= coalesce(lag_bytes_before, 0) + 5000000, FALSE) AS recovered
      FROM runs""",
    "conservation": with_(_DAILY) + """
      SELECT day, stream_len AS writes, stream_len AS log_delta, sample_count AS sample_delta,
             stream_len = sample_count AS conserved FROM daily""",
    "backlog_growth": with_(_DAILY) + """
      SELECT 'accounts' AS source, day, stream_len, stream_len - lag(stream_len) OVER (ORDER BY day) AS step,
             stream_len - first(stream_len) OVER (ORDER BY day) AS since_start FROM daily""",
    "capacity_matrix": with_(_AT_NOW, f"""
      runs AS (SELECT CAST(pow(2, key % 4) AS INTEGER) AS replicas, {_SNAPSHOT},
                      count(DISTINCT key) AS documents, count(*) AS source_rows FROM at_now GROUP BY 1)""") + """
      SELECT 'capacity-' || replicas || 'replicas' AS label, replicas, p50_staleness_ms AS p50_ms,
             p99_staleness_ms AS p99_ms, max_staleness_ms AS max_ms, active_violation_count AS violations,
             sample_count AS samples, documents AS document_count, source_rows AS source_count FROM runs""",
}

"""Queries over state that is kept while streams run, and over histograms that add up."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lsn import long_to_lsn
from tidemark.operators import histograms, visibility
from tidemark.plans import freshness, inputs, pipeline
from tidemark.plans.base_sql import LOG, OBSERVED, with_
from tidemark.session import materialized, scratch_path
from tidemark.streaming import deliveries as delivery_streams
from tidemark.streaming import freshness as freshness_streams

# Facts land in slices of five days; the rolling window is smaller than the samples there are.
SLICE_US = 432_000_000_000
WINDOW = 2_000
# Attempts land in this many slices of their time.
ATTEMPT_SLICES = 4


def _streamed(spark: SparkSession, rows: DataFrame, slices: Iterable[Column], apply: Callable, root: str) -> None:
    """Land the rows slice by slice; a trigger takes all of what has landed since the last one."""
    for wanted in slices:
        rows.filter(wanted).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/log")
        writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()


def _watched(spark: SparkSession, sf_dir: str) -> freshness_streams.FreshnessStore:
    """The monitor's state after all commits and markers came in, slice by slice."""
    root = scratch_path(spark, "freshness")
    commits = freshness.events(spark, sf_dir)
    told = freshness_streams.facts(commits, inputs.marker_table(commits))
    told = materialized(told.withColumn("slice", F.floor(F.coalesce("commit_ts_us", "marker_ts_us") / SLICE_US)), "facts")
    numbers = sorted(r["slice"] for r in told.select("slice").distinct().collect())  # one per five days
    store = freshness_streams.FreshnessStore(
        spark, f"{root}/store", probes=freshness.GRID, slo_us=inputs.SLO_US, sample_window=WINDOW
    )
    _streamed(spark, told, [F.col("slice") == n for n in numbers], store.apply, root)
    return store


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling freshness metrics after every trigger, from the state alone."""
    shown = _watched(spark, sf_dir).history()
    return shown.withColumn("batch", F.col("batch").cast("bigint")).drop("frontier_lsn")


def stream_ack_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acknowledged position after every trigger."""
    shown = _watched(spark, sf_dir).history()
    return shown.select(F.col("batch").cast("bigint").alias("batch"), "frontier_lsn", long_to_lsn("frontier_lsn").alias("frontier"))


def metrics_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per operation and minute, from histograms of each operation added up."""
    found = visibility.samples(freshness.observed(spark, sf_dir))
    parts = [histograms.value_counts(found.filter(F.col("op") == op), ["op"], "visible_ts_us", "staleness_us") for op in "cud"]
    by_minute = materialized(histograms.merged(parts, ["op"]), "by-minute")
    return histograms.summary(by_minute, ["op", "bucket"], size=inputs.size(spark, sf_dir, 1)).withColumnRenamed("bucket", "minute")


def metrics_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 24 hours ending every six hours, added up from minutes; no sample is read again."""
    found = visibility.samples(freshness.observed(spark, sf_dir))
    by_minute = materialized(histograms.value_counts(found, [], "visible_ts_us", "staleness_us"), "by-minute")
    windows = histograms.sliding(by_minute, [], length=1440, step=360)
    return histograms.summary(windows, ["window"], size=freshness.FORCED)


def _delivered(spark: SparkSession, sf_dir: str) -> delivery_streams.DeliveryStore:
    root = scratch_path(spark, "deliveries")
    rows = materialized(inputs.deliveries(spark, sf_dir), "deliveries")
    lo, hi = rows.agg(F.min("attempt_ts_us"), F.max("attempt_ts_us")).first()
    edges = [lo + (hi + 1 - lo) * i // ATTEMPT_SLICES for i in range(ATTEMPT_SLICES + 1)]
    time = F.col("attempt_ts_us")
    store = delivery_streams.DeliveryStore(spark, f"{root}/store")
    _streamed(spark, rows, [(time >= a) & (time < b) for a, b in zip(edges, edges[1:])], store.apply, root)
    return store


def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of every attempt, counted across batches."""
    return _delivered(spark, sf_dir).current_attempts().select(
        F.col("message_id").cast("bigint").alias("message_id"), "attempt_ts_us", "ok", "attempt"
    )


def stream_attempt_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose failures reached the limit, also where they came in several batches."""
    return _delivered(spark, sf_dir).current_dead_letters("cdc_events")


def stream_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is pending and idle an hour after the newest delivery, from the delivery state."""
    store = _delivered(spark, sf_dir)
    latest = store.newest_attempt()
    found = store.reclaimable(latest + 3_600_000_000, count=None)
    return found.select(F.col("message_id").cast("bigint").alias("message_id"), "delivered_ts_us")


def stream_batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work per batch as counted while the batches ran."""
    return pipeline._store_after_stream(spark, sf_dir).batch_metrics()


def stream_expired_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers left in the store after one clean-up of at most 3000: days lose their folders, oldest first."""
    store = pipeline._store_after_stream(spark, sf_dir)
    store.expire_markers(store.newest_commit() - 604_800_000_000, max_markers=3_000)
    return store.current_markers(["event_id", "commit_ts_us"])


QUERIES = {
    f.__name__: f
    for f in (
        stream_metrics, stream_ack_frontier, metrics_by_minute, metrics_sliding, stream_attempts,
        stream_attempt_dead_letters, stream_reclaimable, stream_batch_metrics, stream_expired_markers,
    )
}

# What is known at each trigger: all commits of its slices, judged at the newest time told.
_TRIGGERS = OBSERVED + f""",
told AS (SELECT commit_ts_us AS t FROM marked UNION ALL SELECT marker_ts_us FROM marked WHERE marker_ts_us IS NOT NULL),
triggers AS (
  SELECT s, row_number() OVER (ORDER BY s) - 1 AS batch, max(m) OVER (ORDER BY s) AS now
  FROM (SELECT t // {SLICE_US} AS s, max(t) AS m FROM told GROUP BY 1)
),
known AS (
  SELECT batch, now, o.*, now - commit_ts_us AS age_us,
         coalesce(visible_ts_us <= now, FALSE) AS is_sample, coalesce(violation_ts_us <= now, FALSE) AS is_violation,
         NOT coalesce(visible_ts_us <= now, FALSE) AND ((commit_ts_us + 86400000000) // 120000 + 1) * 120000 > now AS is_open
  FROM triggers t JOIN observed o ON o.commit_ts_us // {SLICE_US} <= t.s
)"""
_RANKS = """count(*) AS sample_count,
  quantile_disc(staleness_us, 0.5) / 1000.0::DOUBLE AS p50_staleness_ms,
  quantile_disc(staleness_us, 0.95) / 1000.0::DOUBLE AS p95_staleness_ms,
  quantile_disc(staleness_us, 0.99) / 1000.0::DOUBLE AS p99_staleness_ms,
  max(staleness_us) / 1000.0::DOUBLE AS max_staleness_ms"""

ORACLE = {
    "stream_metrics": with_(_TRIGGERS, f"""
      s AS (
        SELECT batch, {_RANKS} FROM (
          SELECT * FROM known WHERE is_sample
          QUALIFY row_number() OVER (PARTITION BY batch ORDER BY visible_ts_us DESC, lsn DESC, seq DESC) <= {WINDOW})
        GROUP BY batch)""", f"""
      d AS (
        SELECT batch, quantile_disc(detection_delay_us, 0.99) / 1000.0::DOUBLE AS p99_detection_delay_ms FROM (
          SELECT * FROM known WHERE is_violation
          QUALIFY row_number() OVER (PARTITION BY batch ORDER BY violation_ts_us DESC, lsn DESC, seq DESC) <= {WINDOW})
        GROUP BY batch)""", """
      c AS (
        SELECT batch, any_value(now) AS now_us, count(*) FILTER (is_open) AS in_flight_count,
               max(age_us) FILTER (is_open) / 1000.0::DOUBLE AS oldest_in_flight_age_ms,
               count(*) FILTER (is_violation) AS violation_count,
               count(*) FILTER (is_violation AND is_open) AS active_violation_count,
               round(coalesce(max(now - violation_ts_us) FILTER (is_violation AND is_open) / 1000000.0::DOUBLE, 0), 3)
                 AS violation_duration_seconds
        FROM known GROUP BY batch)""") + """
      SELECT c.*, coalesce(sample_count, 0) AS sample_count, p50_staleness_ms, p95_staleness_ms, p99_staleness_ms,
             max_staleness_ms, p99_detection_delay_ms
      FROM c LEFT JOIN s USING (batch) LEFT JOIN d USING (batch)""",
    "stream_ack_frontier": with_(_TRIGGERS, """
      settled AS (
        SELECT batch, max(lsn) FILTER (oldest IS NULL OR lsn < oldest) AS upto
        FROM known JOIN (SELECT batch, min(lsn) FILTER (is_open) AS oldest FROM known GROUP BY 1) USING (batch) GROUP BY 1)""", """
      reached AS (SELECT batch, max(upto) OVER (ORDER BY batch) AS frontier_lsn FROM settled)""") + """
      SELECT batch, frontier_lsn, printf('%X/%X', frontier_lsn >> 32, frontier_lsn & 4294967295) AS frontier FROM reached""",
    "metrics_by_minute": with_(OBSERVED) + f"""
      SELECT op, visible_ts_us // 60000000 AS minute, {_RANKS} FROM observed WHERE visible_ts_us IS NOT NULL GROUP BY 1, 2""",
    "metrics_sliding": with_(OBSERVED, """
      placed AS (
        SELECT staleness_us, unnest(range((visible_ts_us // 60000000 + 359) // 360, (visible_ts_us // 60000000 + 359) // 360 + 4)) AS w
        FROM observed WHERE visible_ts_us IS NOT NULL)""") + f"""
      SELECT w AS "window", {_RANKS} FROM placed GROUP BY 1""",
    "stream_attempts": with_(pipeline._TRIED) + " SELECT message_id, attempt_ts_us, ok, attempt FROM attempts",
    "stream_attempt_dead_letters": with_(pipeline._TRIED) + " SELECT * FROM dead",
    "stream_reclaimable": pipeline.ORACLE["reclaimable"],
    "stream_batch_metrics": with_(LOG, """
      span AS (SELECT min(arrival) AS lo, max(arrival) + 1 - min(arrival) AS n FROM log)""", f"""
      good AS (SELECT * FROM log WHERE {pipeline._DAMAGED} IS NULL)""", """
      judged AS (
        SELECT *, CASE WHEN lsn <= max(lsn) OVER (PARTITION BY key ORDER BY arrival
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  THEN 'superseded' ELSE 'applied' END AS result FROM good)""") + """
      SELECT CASE WHEN arrival >= lo + n * 2 // 3 THEN 2 WHEN arrival >= lo + n // 3 THEN 1 ELSE 0 END::BIGINT AS batch_id,
             count(*) AS processed_events, count(*) FILTER (result = 'applied') AS document_writes, count(*) AS marker_writes
      FROM judged, span GROUP BY 1""",
    "stream_expired_markers": with_(LOG, f"""
      m AS (SELECT DISTINCT event_id, commit_ts_us FROM log WHERE {pipeline._DAMAGED} IS NULL)""", """
      doomed AS (SELECT event_id FROM m WHERE commit_ts_us < (SELECT max(commit_ts_us) FROM m) - 604800000000
                 ORDER BY commit_ts_us, event_id LIMIT 3000)""") + """
      SELECT event_id, commit_ts_us FROM m WHERE event_id NOT IN (SELECT event_id FROM doomed)""",
}

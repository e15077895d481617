"""Continuous materialisation and freshness streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators import metrics as metric_ops
from tidemark.operators.markers import marker_state, markers
from tidemark.operators.prefix import running
from tidemark.operators.quarantine import MAX_ATTEMPTS, dead_letters, invalid_reason
from tidemark.operators.resolve import incremental_apply
from tidemark.operators.sizing import Sizing
from tidemark.sources.changelog import flatten_events
from tidemark.sources.tables import BatchLedger, VersionedTable

MARKER_SCHEMA = (
    "event_id string, document_id string, op string, commit_lsn string, commit_ts_us bigint, "
    "result string, arrival bigint"
)
FAILURE_SCHEMA = "message_id string, arrival bigint, event string, error string"
BATCH_COUNTS = ["processed_events", "document_writes", "marker_writes"]
DAY_US = 86_400_000_000


class DocumentStore:
    """Documents, markers and failed deliveries below one path, versioned by batch id."""

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, str], *, key_type: str = "bigint") -> None:
        self.fields, self.key_type = dict(fields), key_type
        sparse = "".join(f"{f} struct<v:{t}>, " for f, t in fields.items())
        documents = StructType.fromDDL(f"key {key_type}, {sparse}_lsn bigint, _seq int, _deleted boolean")
        self.documents = VersionedTable(spark, f"{path}/documents", ["key"], documents)
        # By day of commit, so that expiry removes folders.
        self.markers = VersionedTable(
            spark, f"{path}/markers", ["event_id"], StructType.fromDDL(MARKER_SCHEMA), part=f"commit_ts_us div {DAY_US}"
        )
        self.failures = VersionedTable(
            spark, f"{path}/failures", ["message_id", "arrival"], StructType.fromDDL(FAILURE_SCHEMA)
        )
        self.ledger = BatchLedger(spark, f"{path}/ledger", BATCH_COUNTS)

    def apply(self, parsed: DataFrame, batch_id: int, *, compact_every: int = 50) -> None:
        """Documents, then markers, then the ledger entry: a batch without one is done again.

        The state before the batch is read as of ``batch_id - 1``, so a second run of the
        same batch decides exactly as the first did.
        """
        if self.ledger.last() >= batch_id:
            return
        judged = parsed.withColumn("reason", invalid_reason("e", self.fields, self.key_type))
        kept = ("reason", F.when(F.col("reason").isNotNull(), F.col("event")).alias("event"))
        # Parsed once: the cached rows are flat, and only failed ones still carry their text.
        rows = flatten_events(judged, self.fields, kept, key_type=self.key_type).persist()
        outcomes = None
        try:
            at_most = rows.count()
            size = Sizing(at_most=at_most)
            failed = rows.filter(F.col("reason").isNotNull())
            failed = failed.select("message_id", "arrival", "event", F.col("reason").alias("error"))
            self.failures.append(failed, batch_id, at_most=at_most)
            batch = rows.filter(F.col("reason").isNull()).drop("message_id", "xid", "published_ts_us", "reason", "event")
            touched = batch.select("key").distinct()
            stored = self.documents.as_of(batch_id - 1, only=touched)
            # Outcomes make documents and markers; classified once.
            changed, outcomes = incremental_apply(stored, batch, fields=list(self.fields), size=size, judge=DataFrame.persist)
            self.documents.append(changed, batch_id, at_most=at_most)
            # Counted while the markers are written, not by a pass of its own.
            work = Observation()
            applied = F.count_if(F.col("result") == "applied")
            told = outcomes.observe(
                work, F.count(F.lit(1)).alias("processed_events"), applied.alias("document_writes"),
                F.count(F.lit(1)).alias("marker_writes"),
            )
            self.markers.append(marker_state(markers(told)), batch_id, at_most=at_most)
            if compact_every and batch_id and batch_id % compact_every == 0:
                for table in (self.documents, self.markers, self.failures):
                    table.compact(batch_id)
            self.ledger.commit(batch_id, **work.get)
            if compact_every and batch_id and batch_id % compact_every == 0:
                # Only now is the batch never done again, so nothing before it is needed.
                for table in (self.documents, self.markers, self.failures):
                    table.vacuum(batch_id)
                self.ledger.vacuum()
        finally:
            if outcomes is not None:
                outcomes.unpersist()
            rows.unpersist()

    def current_documents(self) -> DataFrame:
        return self.documents.as_of(self.ledger.last())

    def current_markers(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The newest marker of each event; of ``columns`` alone where only those are wanted."""
        return self.markers.as_of(self.ledger.last(), columns=columns)

    def newest_commit(self) -> int | None:
        """The newest commit that a marker is held of, from the folders of its day alone."""
        last = self.ledger.last()
        days = self.markers.parts(last)
        return self.markers.part_as_of(days[-1][0], last).agg(F.max("commit_ts_us")).first()[0] if days else None

    def current_failures(self) -> DataFrame:
        return self.failures.as_of(self.ledger.last())

    def current_dead_letters(self, stream: str, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
        """Messages that failed ``max_attempts`` times, as of the delivery that reached it.

        A delivery that cannot be read fails whenever it is delivered, so its failures are its
        attempts.
        """
        attempts = running(
            self.current_failures(), ["message_id"], "arrival", {"attempt": ("sum", F.lit(1).cast("bigint"))}
        ).withColumns({"ok": F.lit(False), "attempt_ts_us": F.col("arrival")})
        return dead_letters(attempts, stream, max_attempts=max_attempts).withColumnRenamed("failed_ts_us", "failed_arrival")

    def batch_metrics(self) -> DataFrame:
        """Work per batch, as counted while it ran: (batch_id, processed_events, document_writes, marker_writes)."""
        return self.ledger.entries().withColumnRenamed("batch", "batch_id")

    def expire_markers(self, cutoff_us: int, *, max_markers: int | None = None) -> int:
        """Remove the markers of commits before ``cutoff_us``, oldest first; called between batches.

        Days that are wholly older lose their folders; only the day of the border is written again.
        ``max_markers`` bounds one run, and the next run goes on; returned is how many went.
        """
        last, gone = self.ledger.last(), 0
        for day, _ in self.markers.parts(last):
            left = None if max_markers is None else max_markers - gone
            if day * DAY_US >= cutoff_us or left == 0:
                break
            held = self.markers.part_as_of(day, last)
            doomed = held.filter(F.col("commit_ts_us") < cutoff_us)
            n = doomed.count()
            if (day + 1) * DAY_US <= cutoff_us and (left is None or n <= left):
                self.markers.drop_parts([day])
                gone += n
                continue
            if left is not None and n > left:
                doomed = doomed.orderBy("commit_ts_us", "event_id").limit(left)
                n = left
            if n:
                self.markers.rewrite_part(day, held.join(doomed.select("event_id"), "event_id", "left_anti"))
            gone += n
        return gone


def stream_materialize(
    parsed: DataFrame, store: DocumentStore, checkpoint: str, *, available_now: bool = False, every: str = "1 second"
) -> StreamingQuery:
    """At-least-once input, idempotent result. No watermark: late changes are superseded, not dropped."""
    writer = parsed.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def first_deliveries(stream: DataFrame, time: str, horizon: str = "24 hours") -> DataFrame:
    """Optional: drop redeliveries within a horizon. Off by default, as the last outcome then differs."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["event_id"])


def within_guard(stream: DataFrame, time: str = "commit_time") -> DataFrame:
    """Drop commits outside the accepted age range; the watermark bounds the state behind it."""
    now = F.current_timestamp()
    inside = (F.col(time) <= now + F.expr("INTERVAL 60 SECONDS")) & (
        F.col(time) >= now - F.expr("INTERVAL 24 HOURS")
    )
    return stream.filter(inside).withWatermark(time, "24 hours")


def breaches(
    commits: DataFrame, markers_: DataFrame, *, slo: str = "1 second", lateness: str = "24 hours"
) -> DataFrame:
    """Commits joined to a marker within the SLO, unmatched ones with a null marker time.

    ``commits`` has (event_id, lsn, commit_time), ``markers_`` (event_id, lsn, marker_time).
    The join's time bounds let Spark drop state once the watermark passes commit + SLO.
    """
    c = commits.withWatermark("commit_time", lateness).alias("c")
    m = markers_.withWatermark("marker_time", lateness).alias("m")
    on_time = F.expr(
        "c.event_id = m.event_id AND c.lsn = m.lsn AND m.marker_time >= c.commit_time "
        f"AND m.marker_time <= c.commit_time + INTERVAL {slo}"
    )
    joined = c.join(m, on_time, "left_outer")
    columns = [F.col(f"c.{n}") for n in commits.columns]
    return joined.select(*columns, F.col("m.marker_time").alias("marker_time"))


def stream_violations(
    commits: DataFrame, markers_: DataFrame, path: str, checkpoint: str, *, slo: str = "1 second",
    lateness: str = "24 hours", available_now: bool = True,
) -> StreamingQuery:
    """Append every commit that no marker answered within the SLO."""
    open_ = breaches(commits, markers_, slo=slo, lateness=lateness).filter(F.col("marker_time").isNull())
    writer = open_.drop("marker_time").writeStream.format("parquet").option("path", path)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def late_markers(
    commits: DataFrame, markers_: DataFrame, *, slo: str = "1 second", horizon: str = "1 hour", lateness: str = "24 hours"
) -> DataFrame:
    """Breaches that ended: commits whose marker came after the SLO but within ``horizon``.

    The end of a violation that ``stream_violations`` has reported; state is kept for
    ``horizon`` past a commit.
    """
    c = commits.withWatermark("commit_time", lateness).alias("c")
    m = markers_.withWatermark("marker_time", lateness).alias("m")
    late = F.expr(
        "c.event_id = m.event_id AND c.lsn = m.lsn "
        f"AND m.marker_time > c.commit_time + INTERVAL {slo} AND m.marker_time <= c.commit_time + INTERVAL {horizon}"
    )
    columns = [F.col(f"c.{n}") for n in commits.columns]
    return c.join(m, late).select(*columns, F.col("m.marker_time").alias("resolved_time"))


def guard_rejections(stream: DataFrame, time: str = "commit_time", now: Column | None = None) -> DataFrame:
    """What ``within_guard`` drops, with ``reason``: too far ahead, or too old."""
    now = F.current_timestamp() if now is None else now
    ahead = F.col(time) > now + F.expr("INTERVAL 60 SECONDS")
    old = F.col(time) < now - F.expr("INTERVAL 24 HOURS")
    reason = F.when(ahead, "ahead").when(old, "old")
    return stream.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def metrics_batch(
    observe: Callable[[DataFrame], DataFrame], path: str, by: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: freshness metrics of each trigger's events as new history rows."""

    def append(batch: DataFrame, batch_id: int) -> None:
        obs = observe(batch)
        now = F.unix_micros(F.current_timestamp())
        snapshot = metric_ops.metrics_snapshot(obs, now, by).withColumn("batch_id", F.lit(batch_id))
        snapshot.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return append

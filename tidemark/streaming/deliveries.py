"""Delivery state kept while a stream runs: attempts, last delivery, success.

One row per message that has been delivered: failures since its last success, when it was last
delivered, and whether that succeeded. A batch reads and writes only the buckets of its own
messages. A success clears the counter, and compaction forgets messages that succeeded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.quarantine import MAX_ATTEMPTS, attempt_runs, dead_letters, reclaimable
from tidemark.operators.sizing import Sizing
from tidemark.sources.tables import BatchLedger, VersionedTable

STATE_SCHEMA = "message_id string, attempts bigint, delivered_ts_us bigint, acked boolean"
ATTEMPT_SCHEMA = "message_id string, attempt_ts_us bigint, ok boolean, event string, error string, attempt bigint"


class DeliveryStore:
    """Delivery state and the attempts it was worked out from, versioned by batch id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.state = VersionedTable(spark, f"{path}/state", ["message_id"], StructType.fromDDL(STATE_SCHEMA))
        self.attempts = VersionedTable(
            spark, f"{path}/attempts", ["message_id", "attempt_ts_us"], StructType.fromDDL(ATTEMPT_SCHEMA)
        )
        self.ledger = BatchLedger(spark, f"{path}/ledger")

    def apply(self, deliveries: DataFrame, batch_id: int, *, compact_every: int = 50) -> None:
        """One batch of (message_id, attempt_ts_us, ok, event, error), not older than the batches before.

        The state before the batch is read as of ``batch_id - 1``, so a batch done twice counts once.
        """
        if self.ledger.last() >= batch_id:
            return
        rows = deliveries.withColumn("message_id", F.col("message_id").cast("string")).persist()
        try:
            at_most = rows.count()
            stored = self.state.as_of(batch_id - 1, only=rows.select("message_id").distinct())
            before = stored.select("message_id", F.col("attempts").alias("__before"))
            counted = attempt_runs(rows, size=Sizing(at_most=at_most)).join(before, "message_id", "left")
            # Failures before the batch count until the first success in it.
            carried = F.when(F.col("run") == 0, F.coalesce("__before", F.lit(0))).otherwise(0)
            counted = counted.withColumn("attempt", F.col("attempt") + carried).drop("run", "__before")
            self.attempts.append(counted, batch_id, at_most=at_most)
            now = F.max_by(F.struct("attempt", "ok"), "attempt_ts_us").alias("last")
            # Read back as written: the attempts are not counted a second time.
            latest = self.attempts.delta(batch_id).groupBy("message_id").agg(now, F.max("attempt_ts_us").alias("delivered_ts_us"))
            state = latest.select(
                "message_id", F.when(F.col("last.ok"), 0).otherwise(F.col("last.attempt")).cast("bigint").alias("attempts"),
                "delivered_ts_us", F.col("last.ok").alias("acked"),
            )
            self.state.append(state, batch_id, at_most=at_most)
            compact = compact_every and batch_id and batch_id % compact_every == 0
            if compact:
                self.state.compact(batch_id, keep=~F.col("acked"))
            self.ledger.commit(batch_id)
            if compact:
                self.state.vacuum(batch_id)
                self.ledger.vacuum()
        finally:
            rows.unpersist()

    def current_attempts(self) -> DataFrame:
        """Every delivery with the number of its attempt."""
        return self.attempts.as_of(self.ledger.last())

    def newest_attempt(self) -> int | None:
        """When the newest delivery was. Its instant is part of the key, so versions need not be told apart."""
        return self.attempts.changes(self.ledger.last()).agg(F.max("attempt_ts_us")).first()[0]

    def current_dead_letters(self, stream: str, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
        return dead_letters(self.current_attempts(), stream, max_attempts=max_attempts)

    def pending(self) -> DataFrame:
        """Messages whose last delivery failed, with their attempts."""
        return self.state.as_of(self.ledger.last()).filter(~F.col("acked"))

    def reclaimable(self, now_us: int, *, idle_ms: int = 30_000, count: int | None = 10) -> DataFrame:
        """Pending messages idle for at least ``idle_ms``, from the state alone; the oldest ``count`` of them."""
        waiting = self.pending().select("message_id", F.col("delivered_ts_us").alias("attempt_ts_us"))
        return reclaimable(waiting, waiting.limit(0), now_us, idle_ms=idle_ms, count=count)

"""Rolling freshness metrics over triggers, from state that is kept while the stream runs.

The stream brings facts: commits, and markers that became readable. State holds the events that
are not settled yet, the newest samples and detection delays, the number of violations so far and
the acknowledged position. Each trigger adds its facts, judges the unsettled events as of its own
instant, and appends one row to the history: what the batch snapshot would say at that instant,
without reading settled events again.

An event is forgotten when it is settled and everything before it is: at or below the frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.metrics import SAMPLE_WINDOW, snapshot_of
from tidemark.operators.retention import last_n
from tidemark.operators.sizing import Sizing
from tidemark.operators.visibility import MAX_AGE_US, ProbeGrid, measured, state_at
from tidemark.session import materialized
from tidemark.sources.tables import BatchLedger, VersionedTable

FACT_SCHEMA = "event_id string, lsn bigint, seq int, commit_ts_us bigint, marker_ts_us bigint"
# ``state``: early (a marker without its commit), open, settled (visible or rejected), done (forgotten).
EVENT_SCHEMA = (
    "event_id string, lsn bigint, seq int, commit_ts_us bigint, marker_lsn bigint, marker_ts_us bigint, "
    "state string, violated boolean"
)
NEWEST_SCHEMA = "event_id string, lsn bigint, seq int, at_us bigint, value_us bigint"
TOTALS = ["now_us", "violation_count", "frontier_lsn"]


def facts(commits: DataFrame, markers: DataFrame) -> DataFrame:
    """Commits (event_id, lsn, seq, commit_ts_us) and markers (event_id, lsn, marker_ts_us) as one stream."""
    none = F.lit(None)
    return commits.select("event_id", "lsn", "seq", "commit_ts_us", none.cast("bigint").alias("marker_ts_us")).unionByName(
        markers.select("event_id", "lsn", none.cast("int").alias("seq"), none.cast("bigint").alias("commit_ts_us"), "marker_ts_us")
    )


class FreshnessStore:
    """Observations across triggers, versioned by batch id below one path."""

    def __init__(
        self, spark: SparkSession, path: str, *, probes: ProbeGrid, slo_us: int = 1_000_000,
        sample_window: int = SAMPLE_WINDOW, guard: bool = True,
    ) -> None:
        self.spark, self.path = spark, path
        self.probes, self.slo_us, self.sample_window, self.guard = probes, slo_us, sample_window, guard
        self.events = VersionedTable(spark, f"{path}/events", ["event_id"], StructType.fromDDL(EVENT_SCHEMA))
        newest = StructType.fromDDL(NEWEST_SCHEMA)
        self.samples = VersionedTable(spark, f"{path}/samples", ["event_id"], newest)
        self.delays = VersionedTable(spark, f"{path}/delays", ["event_id"], newest)
        self.ledger = BatchLedger(spark, f"{path}/ledger", TOTALS)

    def _before(self, batch_id: int) -> dict:
        found = self.ledger.entries().filter(F.col("batch") == batch_id - 1).first()
        return found.asDict() if found else dict.fromkeys(TOTALS)

    def _merged(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Unsettled events with what the batch tells: the first commit, and the newest marker until settled.

        State rows of all versions and the batch's facts meet in one aggregation, so that each
        crosses the network once. ``told_us`` is the newest time that the batch told of the event.
        """
        held = self.events.changes(batch_id - 1)
        kept = held.select("event_id", "version", F.struct(*[c for c in held.columns if c not in ("event_id", "version")]).alias("held"))
        told = batch.select(
            "event_id", F.when(F.col("commit_ts_us").isNotNull(), F.struct("lsn", "seq", "commit_ts_us")).alias("commit"),
            F.when(F.col("marker_ts_us").isNotNull(), F.struct("marker_ts_us", F.col("lsn").alias("marker_lsn"))).alias("marker"),
            F.greatest("commit_ts_us", "marker_ts_us").alias("told_us"), F.lit(True).alias("told"),
        )
        both = kept.unionByName(told, allowMissingColumns=True).groupBy("event_id").agg(
            F.max_by("held", "version").alias("held"), F.min("commit").alias("commit"), F.max("marker").alias("marker"),
            F.max("told_us").alias("told_us"), F.coalesce(F.max("told"), F.lit(False)).alias("told"),
        )
        both = both.withColumn("held", F.when(F.col("held.state") != "done", F.col("held"))).filter("told OR held IS NOT NULL")
        held_commit = F.when(F.col("held.commit_ts_us").isNotNull(), F.struct("held.lsn", "held.seq", "held.commit_ts_us"))
        held_marker = F.when(F.col("held.marker_ts_us").isNotNull(), F.struct("held.marker_ts_us", "held.marker_lsn"))
        settled_by = F.when(F.col("held.state") == "settled", held_marker)
        marker = F.coalesce(settled_by, F.greatest(held_marker, "marker"))
        return both.withColumns({"commit": F.least(held_commit, "commit"), "marker": marker}).select(
            "event_id", "commit.*", F.col("marker.marker_lsn").alias("marker_lsn"), F.col("marker.marker_ts_us").alias("marker_ts_us"),
            F.col("held.state").alias("before"), F.coalesce("held.violated", F.lit(False)).alias("was_violated"), "told", "told_us",
        )

    def _judged(self, merged: DataFrame, now: Column) -> DataFrame:
        status = (
            F.when(F.col("marker_lsn").isNull(), "missing").when(F.col("marker_lsn") == F.col("lsn"), "visible").otherwise("wrong_marker")
        )
        known = merged.filter(F.col("commit_ts_us").isNotNull()).withColumn("marker_status", status)
        at = state_at(measured(known, self.probes, slo_us=self.slo_us, guard=self.guard), now)
        settled = F.col("is_sample") | F.col("is_rejected")
        at = at.withColumn("after", F.when(settled, "settled").otherwise("open"))
        early = merged.filter(F.col("commit_ts_us").isNull()).withColumn(
            "after", F.when(now - F.col("marker_ts_us") > MAX_AGE_US, "done").otherwise("early")
        )
        return at.unionByName(early, allowMissingColumns=True)

    def _newest(self, table: VersionedTable, found: DataFrame, time: str, value: str, batch_id: int) -> DataFrame:
        fresh = found.select("event_id", "lsn", "seq", F.col(time).alias("at_us"), F.col(value).alias("value_us"))
        kept = last_n(table.as_of(batch_id - 1).unionByName(fresh), self.sample_window, ["at_us", "lsn", "seq"])
        table.replace(kept, batch_id, at_most=self.sample_window)
        return table.as_of(batch_id)

    def apply(self, batch: DataFrame, batch_id: int, *, compact_every: int = 50) -> None:
        """Facts of one trigger. Its instant is the newest time told so far, so a batch done twice says the same."""
        if self.ledger.last() >= batch_id:
            return
        before = self._before(batch_id)
        merged = materialized(self._merged(batch, batch_id), "merged")
        known = merged.agg(F.max("told_us").alias("told_us"), F.count(F.lit(1)).alias("rows")).first()
        told = known["told_us"]
        times = [t for t in (before["now_us"], told) if t is not None]
        now_us = max(times) if times else 0
        now = F.lit(now_us).cast("bigint")
        # An event that is settled and not told again stays as it is; it is only forgotten some day.
        idle = (F.col("before").eqNullSafe("settled")) & ~F.col("told")
        at, resting = materialized(self._judged(merged.filter(~idle), now), "judged"), merged.filter(idle)  # read by every table below

        counted = at.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("is_violation") & ~F.col("was_violated")).alias("violations"),
            F.min(F.when(F.col("after") == "open", F.col("lsn"))).alias("oldest_open"),
        ).first()
        violation_count = (before["violation_count"] or 0) + counted["violations"]
        reached = F.col("after") == "settled"
        if counted["oldest_open"] is not None:
            reached = reached & (F.col("lsn") < counted["oldest_open"])
        settled = at.select("lsn", "after").unionByName(resting.select("lsn", F.lit("settled").alias("after")))
        upto = settled.agg(F.max(F.when(reached, F.col("lsn")))).first()[0]
        frontier = max((x for x in (before["frontier_lsn"], upto) if x is not None), default=None)

        passed = F.col("lsn") <= (-1 if frontier is None else frontier)
        done = (F.col("after") == "done") | ((F.col("after") == "settled") & passed)
        state = F.when(done, "done").otherwise(F.col("after"))
        violated = F.coalesce("is_violation", F.lit(False))
        changed = at.withColumns({"state": state, "violated": violated}).filter(
            F.col("told") | ~F.col("state").eqNullSafe(F.col("before")) | (F.col("violated") != F.col("was_violated"))
        )
        gone = resting.filter(passed).withColumns({"state": F.lit("done"), "violated": F.col("was_violated")})
        names = self.events.schema.names
        self.events.append(changed.select(*names).unionByName(gone.select(*names)), batch_id, at_most=known["rows"])
        first_seen = F.coalesce(F.col("before") != "settled", F.lit(True))
        samples = self._newest(self.samples, at.filter(F.col("is_sample") & first_seen), "visible_ts_us", "staleness_us", batch_id)
        new = at.filter(F.col("is_violation") & ~F.col("was_violated"))
        delays = self._newest(self.delays, new, "violation_ts_us", "detection_delay_us", batch_id)

        none = F.lit(None).cast("bigint")

        def parts(df: DataFrame, **given: Column) -> DataFrame:
            empty = {"__s": none, "__d": none, "__age": none, "__v": F.lit(0).cast("bigint"), "__active": none}
            return df.select(*[c.alias(n) for n, c in (empty | given).items()])

        rows = parts(
            at, __age=F.when(F.col("is_in_flight"), now - F.col("commit_ts_us")),
            __active=F.when(F.col("is_active"), now - F.col("violation_ts_us")),
        )
        rows = rows.unionByName(parts(samples, __s=F.col("value_us"))).unionByName(parts(delays, __d=F.col("value_us")))
        rows = rows.unionByName(parts(self.spark.range(1), __v=F.lit(violation_count).cast("bigint")))
        shown = snapshot_of(rows, size=Sizing(at_most=counted["rows"] + 2 * self.sample_window + 1))
        shown.withColumns({"now_us": now, "frontier_lsn": F.lit(frontier).cast("bigint")}).write.mode("overwrite").parquet(
            f"{self.path}/history/batch={batch_id}"
        )
        compact = compact_every and batch_id and batch_id % compact_every == 0
        if compact:
            self.events.compact(batch_id, keep=F.col("state") != "done")
        self.ledger.commit(batch_id, now_us=now_us, violation_count=violation_count, frontier_lsn=frontier)
        if compact:
            for table in (self.events, self.samples, self.delays):
                table.vacuum(batch_id)
            self.ledger.vacuum()

    def history(self) -> DataFrame:
        """One metrics row per complete trigger: batch, now_us, frontier_lsn and the snapshot's columns."""
        return self.spark.read.parquet(f"{self.path}/history").filter(F.col("batch") <= self.ledger.last())

    def current_open(self) -> DataFrame:
        return self.events.as_of(self.ledger.last()).filter(F.col("state") == "open")


def stream_freshness(
    stream: DataFrame, store: FreshnessStore, checkpoint: str, *, available_now: bool = False, every: str = "1 second"
) -> StreamingQuery:
    """Run the store over a stream of facts (``FACT_SCHEMA``): rolling metrics and the ack frontier per trigger."""
    writer = stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()

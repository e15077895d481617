"""Per-event outcome rows ("markers")."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lsn import long_to_lsn

MARKER_COLUMNS = ["event_id", "document_id", "op", "commit_lsn", "commit_ts_us", "result"]


def markers(classified: DataFrame, key: str = "key") -> DataFrame:
    """One marker per delivery; ``arrival`` stays alongside so that later ones can win."""
    return classified.select(
        "event_id",
        F.col(key).cast("string").alias("document_id"),
        "op",
        long_to_lsn("lsn").alias("commit_lsn"),
        "commit_ts_us",
        "result",
        "arrival",
    )


def marker_state(
    marker_log: DataFrame, *, first_outcome: bool = False, columns: Sequence[str] = (*MARKER_COLUMNS, "arrival")
) -> DataFrame:
    """One marker per event: the outcome of its last delivery, or of its first.

    Only ``columns`` cross the network besides the delivery's place.
    """
    rest = [c for c in columns if c != "event_id"]
    pick = F.min_by if first_outcome else F.max_by
    chosen = pick(F.struct(*rest), F.col("arrival")).alias("__m")
    return marker_log.groupBy("event_id").agg(chosen).select("event_id", "__m.*")


def upsert_markers(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored markers overwritten by later deliveries of the same event."""
    return marker_state(stored.unionByName(batch))


def outcome_counts(marker_log: DataFrame, by: str = "document_id") -> DataFrame:
    return marker_log.groupBy(by).agg(
        F.count_if(F.col("result") == "applied").alias("applied"),
        F.count_if(F.col("result") == "superseded").alias("superseded"),
        F.count("*").alias("total"),
    )


def outcome_report(events: DataFrame, markers_: DataFrame, by: str = "key") -> DataFrame:
    """Applied, superseded, total and missing per key, from events and their markers."""
    told = markers_.select("event_id", "result")
    return (
        events.select("event_id", by)
        .join(told, "event_id", "left")
        .groupBy(by)
        .agg(
            F.count_if(F.col("result") == "applied").alias("applied"),
            F.count_if(F.col("result") == "superseded").alias("superseded"),
            F.count("*").alias("total"),
            F.count_if(F.col("result").isNull()).alias("missing"),
        )
    )


def missing_markers(events: DataFrame, markers_: DataFrame) -> DataFrame:
    return events.join(markers_.select("event_id"), "event_id", "left_anti")


def markers_for(markers_: DataFrame, events: DataFrame) -> DataFrame:
    """Markers of the wanted events, pruned by the events' commit-time range first."""
    span = events.select(F.min("commit_ts_us").alias("lo"), F.max("commit_ts_us").alias("hi"))
    inside = (F.col("commit_ts_us") >= span.select("lo").scalar()) & (
        F.col("commit_ts_us") <= span.select("hi").scalar()
    )
    return markers_.filter(inside).join(events.select("event_id"), "event_id", "left_semi")


def expired_markers(markers_: DataFrame, now_us: Column | int, retention_s: int = 604_800) -> DataFrame:
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    return markers_.filter(F.col("commit_ts_us") < now - retention_s * 1_000_000)


def purge_markers(
    markers_: DataFrame,
    now_us: Column | int,
    retention_s: int = 604_800,
    *,
    max_rounds: int = 100,
    per_round: int = 1000,
) -> DataFrame:
    """Markers left after one clean-up run, which removes at most rounds x size, oldest first.

    The limit is the feature here: it bounds one run's work, and the next run goes on.
    """
    doomed = expired_markers(markers_, now_us, retention_s)
    batch = doomed.orderBy("commit_ts_us", "event_id").limit(max_rounds * per_round)
    return markers_.join(batch.select("event_id"), "event_id", "left_anti")

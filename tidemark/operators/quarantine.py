"""Deliveries that fail: validation, attempts, dead letters, reclaim and replay."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lsn import lsn_to_long
from tidemark.functions.presence import unreadable
from tidemark.operators.prefix import hot_keys, running
from tidemark.operators.sizing import DEFAULT, Sizing

MAX_ATTEMPTS = 5
DEAD_LETTER_COLUMNS = ["source_stream", "source_message_id", "event", "error", "attempts", "failed_ts_us"]
OPS = ("c", "u", "d")


def invalid_reason(event: str = "e", fields: Mapping[str, str] | None = None, key_type: str = "string") -> Column:
    """Why a parsed delivery cannot be applied; null when it can.

    ``event`` is the parsed envelope, null where the text was not one JSON object. A key or a
    sent field of ``fields`` that its type cannot hold is a reason: it must not become a null.
    """
    e = F.col(event)
    key = e["pk"]["id"]
    found = (
        F.when(e.isNull(), "decode_error")
        .when(key.isNull(), "missing pk.id")
        .when(e["commit_lsn"].isNull(), "missing commit_lsn")
        .when(lsn_to_long(e["commit_lsn"]).isNull(), "unreadable commit_lsn")
        .when(e["event_id"].isNull(), "missing event_id")
        .when(e["commit_ts_us"].isNull(), "missing commit_ts_us")
        .when(e["op"].isNull() | ~e["op"].isin(*OPS), "missing op")
        .when(key.try_cast(key_type).isNull(), "unreadable pk.id")
    )
    for name, data_type in (fields or {}).items():
        if data_type != "string":
            found = found.when(unreadable(e["after"], name, data_type), f"unreadable {name}")
    return found


def split_valid(
    parsed: DataFrame, fields: Mapping[str, str] | None = None, key_type: str = "string"
) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with ``reason``); one malformed delivery does not hold back the rest."""
    judged = parsed.withColumn("reason", invalid_reason("e", fields, key_type))
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def delivery_attempts(deliveries: DataFrame, *, size: Sizing = DEFAULT) -> DataFrame:
    """Add ``attempt``: failures of the message since its last success, this one included.

    ``deliveries`` has (message_id, attempt_ts_us, ok). A success clears the counter.
    """
    return attempt_runs(deliveries, size=size).drop("run")


def attempt_runs(deliveries: DataFrame, *, size: Sizing = DEFAULT) -> DataFrame:
    """``delivery_attempts`` with ``run``, the number of the message's successes before the delivery."""
    size = replace(size, at_most=size.rows(deliveries))
    if hot_keys(deliveries, ["message_id"], size) is None:
        # No message has more rows than a chunk, so none of its runs has: the plain window does for both.
        size = replace(size, at_most=0)
    else:
        size = size.bounded(deliveries, "attempt_ts_us")
    runs = running(
        deliveries, ["message_id"], "attempt_ts_us",
        {"run": ("sum", F.col("ok").cast("bigint"))}, inclusive=False, size=size,
    ).withColumn("run", F.coalesce("run", F.lit(0)))
    return running(
        runs, ["message_id", "run"], "attempt_ts_us",
        {"attempt": ("sum", (~F.col("ok")).cast("bigint"))}, size=size,
    )


def dead_letters(
    attempts: DataFrame, stream: str, *, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Messages whose failures reached the limit, as of the failure that reached it."""
    reached = attempts.filter(~F.col("ok") & (F.col("attempt") == max_attempts))
    return reached.select(
        F.lit(stream).alias("source_stream"),
        F.col("message_id").cast("string").alias("source_message_id"),
        "event",
        "error",
        F.col("attempt").alias("attempts"),
        F.col("attempt_ts_us").alias("failed_ts_us"),
    )


def dead_letter_report(dead: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("error") == "batch-level failure", "batch_error")
        .when(F.col("error").startswith("decode"), "decode_error")
        .otherwise("processing")
    )
    return dead.groupBy(reason.alias("reason")).agg(
        F.count("*").alias("dead_letters"), F.max("failed_ts_us").alias("last_failed_ts_us")
    )


def reclaimable(
    deliveries: DataFrame, acked: DataFrame, now_us: Column | int, *, idle_ms: int = 30_000, count: int | None = 10
) -> DataFrame:
    """Delivered, unacknowledged and idle for at least ``idle_ms``; the oldest ``count`` of them.

    The count bounds one reclaim round; ``None`` gives all.
    """
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    latest = deliveries.groupBy("message_id").agg(F.max("attempt_ts_us").alias("delivered_ts_us"))
    idle = latest.filter(now - F.col("delivered_ts_us") >= idle_ms * 1000)
    pending = idle.join(acked.select("message_id"), "message_id", "left_anti")
    # Ids of the form time-number are ordered by both numbers, not as text.
    parts = F.split(F.col("message_id").cast("string"), "-")
    oldest = [F.try_element_at(parts, F.lit(k)).try_cast("bigint") for k in (1, 2)]
    return pending if count is None else pending.orderBy(*oldest, "message_id").limit(count)


def replay(log: DataFrame, dead: DataFrame, order: str = "arrival") -> DataFrame:
    """The log with quarantined changes appended after everything delivered so far.

    ``dead`` has the log's columns; its relative order is kept. Replaying what was already
    applied changes no document, as such changes are superseded.
    """
    newest = log.agg(F.max(order)).scalar()
    oldest = dead.agg(F.min(order)).scalar()
    moved = dead.withColumn(order, F.col(order) - oldest + newest + 1)
    return log.unionByName(moved)

"""Aggregates over observations, logs and deliveries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.latency import to_ms
from tidemark.functions.lsn import lsn_to_long
from tidemark.operators.ranks import aggregate_with_ranks, nearest_ranks
from tidemark.operators.retention import last_n
from tidemark.operators.sizing import DEFAULT, Sizing
from tidemark.operators.visibility import state_at
from tidemark.session import materialized

SAMPLE_WINDOW = 10_000
STALENESS_RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def staleness_summary(
    samples: DataFrame, by: Sequence[str] = (), *, last: int | None = None, size: Sizing = DEFAULT
) -> DataFrame:
    """count, p50, p95, p99 and max of ``staleness_us`` in milliseconds.

    ``last`` keeps the newest samples by resolve time, the rolling window of an online monitor.
    """
    kept = samples.filter(F.col("staleness_us").isNotNull())
    if last is not None:
        kept = last_n(kept, last, ["visible_ts_us", "lsn", "seq"])
        size = replace(size, at_most=last)
    ranked = aggregate_with_ranks(
        kept.select(*by, "staleness_us"),
        by,
        [F.count("*").alias("sample_count"), F.max("staleness_us").alias("max")],
        {n: ("staleness_us", q) for n, q in STALENESS_RANKS.items()},
        size=size,
    )
    return ranked.select(
        *by,
        "sample_count",
        *[to_ms(F.col(n)).alias(f"{n}_staleness_ms") for n in (*STALENESS_RANKS, "max")],
    )


def in_flight_summary(obs: DataFrame, now_us: Column | int, by: Sequence[str] = ()) -> DataFrame:
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    at = state_at(obs, now_us)
    oldest = F.max(F.when(F.col("is_in_flight"), now - F.col("commit_ts_us")))
    return at.groupBy(*by).agg(
        F.count_if("is_in_flight").alias("in_flight_count"),
        to_ms(oldest).alias("oldest_in_flight_age_ms"),
    )


def violation_summary(
    obs: DataFrame, now_us: Column | int, by: Sequence[str] = (), *, size: Sizing = DEFAULT
) -> DataFrame:
    full = metrics_snapshot(obs, now_us, by, size=size)
    return full.select(
        *by,
        "violation_count",
        "active_violation_count",
        "p99_detection_delay_ms",
        "violation_duration_seconds",
    )


def metrics_snapshot(
    obs: DataFrame,
    now_us: Column | int,
    by: Sequence[str] = (),
    *,
    sample_window: int | None = None,
    ready: Mapping[str, bool] | None = None,
    counts: Mapping[str, tuple[str, Column]] | None = None,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """Freshness metrics as known at ``now_us``: one row, or one per group over the history.

    ``counts`` adds further aggregates of the same pass: name -> (column of ``obs``, aggregate of it).

    ``sample_window`` bounds the samples and the detection delays to the newest N, as an
    online monitor does; it applies to the ungrouped form.
    """
    if by and sample_window is not None:
        raise ValueError("sample_window applies to the ungrouped form")
    now = F.lit(now_us).cast("bigint") if isinstance(now_us, int) else now_us
    at = state_at(obs, now_us)
    counts = dict(counts or {})
    if counts and sample_window is not None:
        raise ValueError("counts apply to whole groups, not to a sample_window")
    rows = at.select(
        *by,
        *dict.fromkeys(c for c, _ in counts.values()),
        F.when(F.col("is_sample"), F.col("staleness_us")).alias("__s"),
        F.when(F.col("is_violation"), F.col("detection_delay_us")).alias("__d"),
        F.when(F.col("is_in_flight"), now - F.col("commit_ts_us")).alias("__age"),
        F.col("is_violation").cast("int").alias("__v"),
        F.when(F.col("is_active"), now - F.col("violation_ts_us")).alias("__active"),
        *([] if sample_window is None else ["visible_ts_us", "violation_ts_us", "lsn", "seq"]),
    )
    if sample_window is not None:
        # Written once in this narrow form; the two windows and the counts each read it.
        rows = materialized(rows, "observed")
        nothing = F.lit(None).cast("bigint")
        states = ["__age", "__v", "__active"]

        def newest(value: str, time: str) -> DataFrame:
            kept = last_n(rows.filter(F.col(value).isNotNull()), sample_window, [time, "lsn", "seq"])
            other = "__d" if value == "__s" else "__s"
            return kept.select(
                value, nothing.alias(other), nothing.alias("__age"), F.lit(0).alias("__v"), nothing.alias("__active")
            )

        plain = rows.select(nothing.alias("__s"), nothing.alias("__d"), *states)
        rows = plain.unionByName(newest("__s", "visible_ts_us")).unionByName(newest("__d", "violation_ts_us"))
    out = snapshot_of(rows, by, extra=[a.alias(n) for n, (_, a) in counts.items()], size=size)
    if ready is not None:
        out = out.withColumns({f"{k}_ready": F.lit(v) for k, v in ready.items()})
    return out


def snapshot_of(
    rows: DataFrame, by: Sequence[str] = (), *, extra: Sequence[Column] = (), size: Sizing = DEFAULT
) -> DataFrame:
    """The snapshot from its parts: samples ``__s``, delays ``__d``, ages in flight ``__age``,
    numbers of violations ``__v`` and active times ``__active``, each null where it does not apply."""
    counted = aggregate_with_ranks(
        rows,
        by,
        [
            F.count("__s").alias("sample_count"),
            F.max("__s").alias("__max"),
            F.count("__age").alias("in_flight_count"),
            F.max("__age").alias("__oldest"),
            F.coalesce(F.sum("__v"), F.lit(0)).alias("violation_count"),
            F.count("__active").alias("active_violation_count"),
            F.max("__active").alias("__longest"),
            *extra,
        ],
        {**{f"__{n}": ("__s", q) for n, q in STALENESS_RANKS.items()}, "__delay": ("__d", 0.99)},
        size=size,
    )
    known = {*by, "sample_count", "in_flight_count", "violation_count", "active_violation_count"}
    further = [c for c in counted.columns if c not in known and not c.startswith("__")]
    return counted.select(
        *by,
        *further,
        "sample_count",
        *[to_ms(F.col(f"__{n}")).alias(f"{n}_staleness_ms") for n in (*STALENESS_RANKS, "max")],
        "in_flight_count",
        to_ms(F.col("__oldest")).alias("oldest_in_flight_age_ms"),
        "violation_count",
        "active_violation_count",
        to_ms(F.col("__delay")).alias("p99_detection_delay_ms"),
        F.round(F.coalesce(F.col("__longest") / F.lit(1_000_000.0), F.lit(0.0)), 3).alias(
            "violation_duration_seconds"
        ),
    )


# Exposed metrics, their names and kinds.
EXPOSED_METRICS = {
    "sample_count": ("cdc_staleness_samples_total", "counter"),
    "p50_staleness_ms": ("cdc_staleness_p50_milliseconds", "gauge"),
    "p95_staleness_ms": ("cdc_staleness_p95_milliseconds", "gauge"),
    "p99_staleness_ms": ("cdc_staleness_p99_milliseconds", "gauge"),
    "max_staleness_ms": ("cdc_staleness_max_milliseconds", "gauge"),
    "in_flight_count": ("cdc_staleness_in_flight", "gauge"),
    "oldest_in_flight_age_ms": ("cdc_staleness_oldest_in_flight_milliseconds", "gauge"),
    "violation_count": ("cdc_staleness_violations_total", "counter"),
    "active_violation_count": ("cdc_staleness_active_violations", "gauge"),
    "p99_detection_delay_ms": ("cdc_staleness_detection_delay_p99_milliseconds", "gauge"),
    "violation_duration_seconds": ("cdc_staleness_violation_duration_seconds", "gauge"),
}


def metrics_long(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One (metric, kind, value) row per exposed metric; a missing value is NaN."""
    wide = metrics.select(
        *by,
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(name)
            for c, (name, _) in EXPOSED_METRICS.items()
        ],
    )
    names = [name for name, _ in EXPOSED_METRICS.values()]
    long = wide.unpivot(list(by), names, "metric", "value")
    counters = [name for name, kind in EXPOSED_METRICS.values() if kind == "counter"]
    kind = F.when(F.col("metric").isin(*counters), "counter").otherwise("gauge")
    return long.withColumn("kind", kind)


def throughput(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Committed events per second between the first and the last commit."""
    span = (F.max("commit_ts_us") - F.min("commit_ts_us")) / F.lit(1_000_000.0)
    counted = log.groupBy(*by).agg(F.count("*").alias("events"), span.alias("span_seconds"))
    return counted.withColumn(
        "events_per_second",
        F.when(F.col("span_seconds") > 0, F.col("events") / F.col("span_seconds")),
    )


def op_mix(log: DataFrame) -> DataFrame:
    """Events and share per operation. The total is taken over the three group rows."""
    counted = log.groupBy("op").agg(F.count("*").alias("events"))
    total = F.sum("events").over(Window.partitionBy(F.lit(0)))
    return counted.withColumn("share", F.col("events") / total.cast("double"))


def distinct_commits(log: DataFrame) -> DataFrame:
    """Rows against distinct positions and commit times, each deduplicated map-side."""
    return log.agg(
        F.count("*").alias("events"),
        F.count_distinct("lsn").alias("distinct_lsns"),
        F.count_distinct("commit_ts_us").alias("distinct_commit_times"),
    )


def commit_bounds(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return events.groupBy(*by).agg(
        F.min("commit_ts_us").alias("first_commit_ts_us"),
        F.max("commit_ts_us").alias("last_commit_ts_us"),
    )


def newest_and_oldest(events: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """The newest event by version and the oldest commit time per group."""
    version = F.struct("lsn", "seq")
    return events.groupBy(*by).agg(
        F.max_by("event_id", version).alias("newest_event_id"),
        F.max("lsn").alias("newest_lsn"),
        F.min("commit_ts_us").alias("oldest_commit_ts_us"),
    )


def backlog(log: DataFrame, acked: DataFrame, retries: DataFrame, dead: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stream length, pending, retry keys and dead letters in one pass over tagged ids.

    Each input has ``message_id``. Flags are folded per message first, so a message that
    was delivered many times is one row before the totals are taken.
    """
    def tagged(df: DataFrame, kind: str) -> DataFrame:
        flags = {k: F.lit(1 if k == kind else 0) for k in ("sent", "acked", "retry", "dead")}
        return df.select(*by, "message_id").withColumns(flags)

    rows = tagged(log, "sent")
    for df, kind in ((acked, "acked"), (retries, "retry"), (dead, "dead")):
        rows = rows.unionByName(tagged(df, kind))
    per_message = rows.groupBy(*by, "message_id").agg(
        *[F.max(k).alias(k) for k in ("sent", "acked", "retry", "dead")]
    )
    settled = (F.col("acked") == 1) | (F.col("dead") == 1)
    return per_message.groupBy(*by).agg(
        F.count_if(F.col("sent") == 1).alias("stream_len"),
        F.count_if((F.col("sent") == 1) & ~settled).alias("pending_count"),
        F.count_if((F.col("retry") == 1) & ~settled).alias("retry_keys"),
        F.count_if(F.col("dead") == 1).alias("dlq_len"),
    )


def batch_metrics(classified: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Work per batch: events, document writes, marker writes, waiting and processing time."""
    return classified.groupBy(batch).agg(
        F.count("*").alias("processed_events"),
        F.count_if(F.col("result") == "applied").alias("document_writes"),
        F.count("*").alias("marker_writes"),
        to_ms(F.sum("queue_us")).alias("queue_ms_total"),
        to_ms(F.sum("processing_us")).alias("processing_ms_total"),
    )


def batch_totals(per_batch: DataFrame) -> DataFrame:
    return per_batch.agg(
        F.count("*").alias("batches_total"),
        F.sum("processed_events").alias("processed_events_total"),
        F.count_if(F.col("document_writes") > 0).alias("document_tasks_total"),
        F.count("*").alias("marker_tasks_total"),
        F.sum("queue_ms_total").alias("queue_ms_total"),
        F.sum("processing_ms_total").alias("processing_ms_total"),
    )


def consistency(events: DataFrame, markers: DataFrame, by: str = "key") -> DataFrame:
    """Per key: nothing missing, outcomes add up, superseded ones older than the newest, positions equal."""
    told = markers.select("event_id", F.col("lsn").alias("marker_lsn"), "result")
    joined = events.select("event_id", by, "lsn").join(told, "event_id", "left")
    facts = joined.groupBy(by).agg(
        F.count("*").alias("events"),
        F.max("lsn").alias("newest_lsn"),
        F.count_if(F.col("result") == "applied").alias("applied"),
        F.count_if(F.col("result") == "superseded").alias("superseded"),
        F.count_if(F.col("result").isNull()).alias("missing"),
        F.max(F.when(F.col("result") == "superseded", F.col("lsn"))).alias("newest_superseded_lsn"),
        F.bool_and(F.col("marker_lsn") == F.col("lsn")).alias("lsns_equal"),
    )
    older = F.coalesce(F.col("newest_superseded_lsn") < F.col("newest_lsn"), F.lit(True))
    verdict = (
        (F.col("missing") == 0)
        & (F.col("applied") + F.col("superseded") == F.col("events"))
        & older
        & F.coalesce("lsns_equal", F.lit(False))
    )
    return (
        facts.withColumn("consistent", verdict)
        .select(by, "events", "applied", "superseded", "missing", "newest_lsn", "consistent")
    )


def conservation(deltas: DataFrame) -> DataFrame:
    """Writes, log growth and sample growth must agree."""
    same = (F.col("writes") == F.col("log_delta")) & (F.col("writes") == F.col("sample_delta"))
    return deltas.withColumn("conserved", same)


def lag_by_consumer(slots: DataFrame, consumer: str = "consumer") -> DataFrame:
    """Bytes behind the head per consumer, from confirmed positions in text form."""
    at = slots.groupBy(consumer).agg(
        F.max(lsn_to_long("head_lsn")).alias("seen"), F.max(lsn_to_long("confirmed_lsn")).alias("confirmed")
    )
    # One row per consumer is left here, so the head is found without reading the input twice.
    head = F.max("seen").over(Window.partitionBy(F.lit(0)))
    return at.select(consumer, (head - F.col("confirmed")).alias("lag_bytes"))


# Documented p99 budgets per hop, in milliseconds.
HOP_BUDGETS_MS = {
    "wal_and_decode": 50.0,
    "reader": 25.0,
    "publish": 10.0,
    "wake_up": 15.0,
    "batch": 100.0,
    "index": 400.0,
    "probe": 50.0,
}


def hop_latency_summary(
    events: DataFrame, hops: Mapping[str, str], *, size: Sizing = DEFAULT
) -> DataFrame:
    """p50/p99 per hop against its budget. ``hops`` maps a hop name to a latency column in µs."""
    long = events.select(*[F.col(c).alias(h) for h, c in hops.items()]).unpivot(
        [], list(hops), "hop", "latency_us"
    )
    ranked = nearest_ranks(long, ["hop"], "latency_us", {"p50": 0.5, "p99": 0.99}, size=size)
    budget = F.lit(None).cast("double")
    for hop, limit in HOP_BUDGETS_MS.items():
        budget = F.when(F.col("hop") == hop, F.lit(limit)).otherwise(budget)
    out = ranked.select(
        "hop", to_ms(F.col("p50")).alias("p50_ms"), to_ms(F.col("p99")).alias("p99_ms"), budget.alias("budget_ms")
    )
    return out.withColumn("within_budget", F.col("p99_ms") <= F.col("budget_ms"))


def health_status(metrics: DataFrame) -> DataFrame:
    """``unavailable`` when not ready, ``STALE`` with active violations, else ``ok``.

    ``ready`` and ``healthy`` are separate columns, so readiness does not hide behind health.
    """
    ready = F.col("replication_ready") & F.col("probe_ready")
    status = (
        F.when(~ready, "unavailable").when(F.col("active_violation_count") > 0, "STALE").otherwise("ok")
    )
    return metrics.withColumns({"ready": ready, "status": status, "healthy": status == "ok"})

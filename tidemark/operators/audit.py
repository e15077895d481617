"""Verdicts that bring the log, the markers, the documents and the samples together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.latency import to_ms
from tidemark.operators.metrics import consistency
from tidemark.operators.resolve import latest_per_key, live_documents

RESERVED_PREFIX = "_Document__"


def reserved_keys(fields: Column, prefix: str = RESERVED_PREFIX) -> Column:
    return F.filter(F.map_keys(fields), lambda k: k.startswith(prefix))


def reserved_key_audit(documents: DataFrame, fields: str = "fields") -> DataFrame:
    """Per document the keys that should never be stored; clean iff there are none."""
    found = documents.withColumn("reserved_keys", reserved_keys(F.col(fields)))
    return found.withColumn("clean", F.size("reserved_keys") == 0)


def _clean(df: DataFrame, clean: DataFrame | None, key: str) -> tuple[DataFrame, list[Column], Column]:
    """``df`` with the verdict of ``reserved_key_audit`` per key: the column to show, and the test."""
    if clean is None:
        return df, [], F.lit(True)
    judged = df.join(clean.select(key, F.col("clean").alias("document_clean")), key, "left")
    shown = F.coalesce("document_clean", F.lit(False))
    return judged, [shown.alias("document_clean")], shown


def hop_latencies(
    events: DataFrame, indexer_log: DataFrame, sample_log: DataFrame, slo_ms: float = 1000.0, *, keep: Sequence[str] = ()
) -> DataFrame:
    """Every event's hops as the services logged them, and whether they show it in time.

    ``events`` has (event_id, key, commit_lsn); the logs are parsed lines (``parse_log_lines``) with
    ``line_no``. A hop is found by the document and position in the record; of several lines the
    first counts, and a line that is missing or unreadable leaves the hop null and the event failed.
    ``keep`` names columns of ``events`` to hand on.
    """
    def first(log: DataFrame, fields: dict[str, str]) -> DataFrame:
        record = F.col("record")
        told = log.select(
            record["document_id"].alias("__document"), record["commit_lsn"].alias("commit_lsn"), "line_no",
            F.struct(*[record[f].try_cast("double").alias(out) for out, f in fields.items()]).alias("hop"),
        )
        # Folded map-side to one row per document and position before the join.
        found = told.groupBy("__document", "commit_lsn").agg(F.min_by("hop", "line_no").alias("hop"))
        return found.select("__document", "commit_lsn", "hop.*")

    indexed = first(indexer_log, {"queue_ms": "stream_queue_latency_ms", "processing_ms": "batch_processing_ms"})
    sampled = first(sample_log, {"staleness_ms": "staleness_ms"})
    on = ["__document", "commit_lsn"]
    way = events.withColumn("__document", F.col("key").cast("string")).join(indexed, on, "left").join(sampled, on, "left")
    passed = F.col("queue_ms").isNotNull() & F.coalesce(F.col("staleness_ms") <= slo_ms, F.lit(False))
    return way.select("event_id", *keep, "queue_ms", "processing_ms", "staleness_ms", passed.alias("passed"))


def trace_events(
    events: DataFrame, markers: DataFrame, obs: DataFrame, applied_log: DataFrame, slo_us: int = 1_000_000,
    *, clean: DataFrame | None = None, key: str = "key",
) -> DataFrame:
    """Every event's way through publish, queue, marker and sample, with a verdict.

    ``clean`` (``reserved_key_audit`` by ``key``) adds ``document_clean`` to the verdict: the event's
    document must hold no reserved field.

    ``applied_log`` has what the consumer logged per (event_id, lsn): queue and processing
    time. The verdict wants a sample within the SLO, no violation, and an applied marker.
    All sides are one row per event, so no key is hot.
    """
    told = markers.select("event_id", F.col("lsn").alias("marker_lsn"), "result")
    seen = obs.select("event_id", "staleness_us", "violation_ts_us")
    logged = applied_log.select("event_id", F.col("lsn").alias("log_lsn"), "queue_us", "processing_us")
    way = (
        events.join(told, "event_id", "left")
        .join(seen, "event_id", "left")
        .join(logged, "event_id", "left")
    )
    passed = (
        (F.col("staleness_us") <= slo_us)
        & F.col("violation_ts_us").isNull()
        & (F.col("result") == "applied")
        & (F.col("marker_lsn") == F.col("lsn"))
    )
    same_log = F.col("log_lsn") == F.col("lsn")
    way, shown, tidy = _clean(way, clean, key)
    return way.select(
        "event_id",
        "lsn",
        "result",
        to_ms(F.col("published_ts_us") - F.col("commit_ts_us")).alias("commit_to_publish_ms"),
        to_ms(F.when(same_log, F.col("queue_us"))).alias("queue_ms"),
        to_ms(F.when(same_log, F.col("processing_us"))).alias("processing_ms"),
        to_ms(F.col("staleness_us")).alias("staleness_ms"),
        *shown,
        F.coalesce(passed & tidy, F.lit(False)).alias("passed"),
    )


def ordering_audit(
    events: DataFrame,
    markers: DataFrame,
    documents: DataFrame,
    fields: Sequence[str],
    key: str = "key",
    *,
    clean: DataFrame | None = None,
) -> DataFrame:
    """Per key: the document carries the newest version and its payload, and outcomes add up.

    ``events`` holds each event once. Inputs are folded to one row per key before joining.
    ``clean`` (``reserved_key_audit`` by ``key``) adds ``document_clean`` to the verdict.
    """
    newest = latest_per_key(events.select(key, "event_id", "op", "lsn", "seq", *fields), [key])
    facts = consistency(events, markers, key)
    stored = documents.select(key, "_lsn", "_deleted", *[F.col(f).alias(f"__{f}") for f in fields])
    joined = newest.join(facts.drop("newest_lsn"), [key]).join(stored, [key], "left")
    same = F.lit(True)
    for f in fields:
        same = same & (F.col(f).isNull() | F.col(f).eqNullSafe(F.col(f"__{f}")))
    gone = F.col("op") == "d"
    payload = (gone == F.col("_deleted")) & (gone | same)
    joined, shown, tidy = _clean(joined, clean, key)
    return joined.select(
        key,
        "events",
        F.col("lsn").alias("newest_lsn"),
        F.col("_lsn").alias("document_lsn"),
        F.coalesce(F.col("_lsn") == F.col("lsn"), F.lit(False)).alias("version_is_newest"),
        F.coalesce(payload, F.lit(False)).alias("payload_is_newest"),
        F.col("consistent").alias("markers_consistent"),
        *shown,
        F.coalesce(
            (F.col("_lsn") == F.col("lsn")) & payload & F.col("consistent") & tidy, F.lit(False)
        ).alias("passed"),
    )


def _compared(source: DataFrame, documents: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    s = source.select(*keys, F.struct(*columns).alias("__s"))
    d = live_documents(documents).select(*keys, F.struct(*columns).alias("__d"))
    joined = s.join(d, list(keys), "full_outer")
    verdict = (
        F.when(F.col("__d").isNull(), "missing")
        .when(F.col("__s").isNull(), "extra")
        .when(~F.col("__s").eqNullSafe(F.col("__d")), "different")
    )
    return joined.withColumn("difference", verdict)


def convergence(source: DataFrame, documents: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys on which source rows and live documents disagree: missing, extra or different."""
    compared = _compared(source, documents, keys, columns).select(*keys, "difference")
    return compared.filter(F.col("difference").isNotNull())


def convergence_report(
    source: DataFrame, documents: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """One row: counts on both sides, differences by kind, and whether the rebuild converged.

    All of it comes from one pass over the compared rows.
    """
    kinds = ("missing", "extra", "different")
    counts = _compared(source, documents, keys, columns).agg(
        *[F.count_if(F.col("difference") == k).alias(k) for k in kinds],
        F.count("__s").alias("source_rows"),
        F.count("__d").alias("live_documents"),
    )
    agreed = (F.col("missing") + F.col("extra") + F.col("different") == 0) & (
        F.col("source_rows") == F.col("live_documents")
    )
    return counts.withColumn("converged", agreed)


def validate_source_rows(
    source: DataFrame,
    *,
    required: Sequence[str],
    non_negative: Sequence[str] = (),
    unique: Sequence[str] = (),
    key: str = "id",
) -> DataFrame:
    """Violations of the table's constraints: one row per (key, constraint).

    Uniqueness is checked on counts combined map-side; only keys of repeated values are
    joined back.
    """
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required]
    checks += [F.when(F.col(c) < 0, F.lit(f"{c} is negative")) for c in non_negative]
    row_checks = source.select(
        F.col(key), F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("constraint")
    )
    found = row_checks
    for c in unique:
        repeated = source.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
        repeated = repeated.filter(F.col("__n") > 1).select(c)
        hit = source.join(repeated, c, "left_semi")
        found = found.unionByName(hit.select(F.col(key), F.lit(f"{c} is not unique").alias("constraint")))
    return found

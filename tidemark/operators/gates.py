"""Pass/fail gates, alerts and run artifacts over metrics rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slo_gate(
    metrics: DataFrame,
    *,
    min_samples: int = 100,
    staleness_bound_ms: float = 1000.0,
    detection_bound_ms: float = 500.0,
    violation_test: bool = False,
) -> DataFrame:
    """Add ``passed`` and ``reason``. The first failing check names the reason.

    In the normal mode p99 staleness must be known and within bound; in ``violation_test``
    mode at least one violation must have been seen and its p99 detection delay be in bound.
    """
    p99, delay = F.col("p99_staleness_ms"), F.col("p99_detection_delay_ms")
    reason = F.when(F.col("sample_count") < min_samples, "too few samples")
    if violation_test:
        reason = reason.when(F.col("violation_count") < 1, "no violation observed").when(
            delay.isNull() | (delay > detection_bound_ms), "detection delay over bound"
        )
    else:
        reason = reason.when(p99.isNull() | (p99 > staleness_bound_ms), "p99 staleness over bound")
    return metrics.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def violation_artifact(
    metrics: DataFrame, *, injected_delay_ms: int = 1500, slo_ms: float = 1000.0, detection_slo_ms: float = 500.0
) -> DataFrame:
    """Outcome of a controlled violation run. Unknown detection delay gives a null verdict.

    Both the total and the active count are reported; detection is judged on the total, as
    a violation may have been resolved by the time the run is captured.
    """
    return metrics.withColumns(
        {
            "injected_delay_ms": F.lit(injected_delay_ms),
            "slo_ms": F.lit(slo_ms),
            "detection_slo_ms": F.lit(detection_slo_ms),
            "violation_detected": F.col("violation_count") > 0,
            "detection_within_slo": F.col("p99_detection_delay_ms") <= detection_slo_ms,
        }
    )


@dataclass(frozen=True)
class AlertRule:
    """``metric`` compared with a limit, or required to be true, or not to grow."""

    name: str
    metric: str
    kind: str  # over | false | growth
    limit: float = 0.0


# The documented alert conditions.
ALERT_RULES = (
    AlertRule("active_violations", "active_violation_count", "over", 0.0),
    AlertRule("p99_staleness", "p99_staleness_ms", "over", 1000.0),
    AlertRule("detection_delay", "p99_detection_delay_ms", "over", 500.0),
    AlertRule("replication_not_ready", "replication_ready", "false"),
    AlertRule("probe_not_ready", "probe_ready", "false"),
    AlertRule("pending_growth", "pending_count", "growth"),
    AlertRule("dead_letter_growth", "dlq_len", "growth"),
    AlertRule("retained_log", "lag_bytes", "over", 5_000_000.0),
)


def alerts(
    history: DataFrame,
    series: Sequence[str],
    time: str,
    rules: Sequence[AlertRule] = ALERT_RULES,
) -> DataFrame:
    """Raised alerts: one row per (series, time, rule) of a metrics history.

    Rules on metrics the history lacks are left out. Growth compares with the snapshot
    before in the same series. A history has one row per snapshot, not per event.
    """
    known = [r for r in rules if r.metric in history.columns]
    before = Window.partitionBy(*series).orderBy(time)
    grown = {
        f"__was_{r.metric}": F.lag(r.metric).over(before) for r in known if r.kind == "growth"
    }
    rows = history.withColumns(grown) if grown else history

    def value(rule: AlertRule) -> Column:
        if rule.kind == "false":
            return F.when(F.col(rule.metric), 0.0).otherwise(1.0)
        if rule.kind == "growth":
            return (F.col(rule.metric) - F.col(f"__was_{rule.metric}")).cast("double")
        return F.col(rule.metric).cast("double")

    checks = F.array(
        *[
            F.struct(F.lit(r.name).alias("alert"), value(r).alias("value"), F.lit(r.limit).alias("limit"))
            for r in known
        ]
    )
    raised = rows.select(*series, time, F.explode(checks).alias("c")).select(*series, time, "c.*")
    return raised.filter(F.col("value") > F.col("limit"))


def run_record(metrics: DataFrame, counts: Mapping[str, Column], label: Column, captured_at: Column) -> DataFrame:
    """One nested row per run: captured time, label, metrics struct and named count structs."""
    return metrics.select(
        captured_at.alias("captured_at"),
        label.alias("label"),
        F.struct(*metrics.columns).alias("staleness"),
        *[c.alias(n) for n, c in counts.items()],
    )


def append_run_history(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def capacity_matrix(runs: DataFrame) -> DataFrame:
    """Comparison rows of runs labelled ``…<N>replicas``; other labels have no replica count."""
    replicas = F.regexp_extract("label", r"([0-9]+)replicas", 1).try_cast("int")
    s = "staleness."
    return runs.select(
        "label",
        replicas.alias("replicas"),
        F.col(s + "p50_staleness_ms").alias("p50_ms"),
        F.col(s + "p99_staleness_ms").alias("p99_ms"),
        F.col(s + "max_staleness_ms").alias("max_ms"),
        F.col(s + "active_violation_count").alias("violations"),
        F.col(s + "sample_count").alias("samples"),
        F.col("counts.documents").alias("document_count"),
        F.col("counts.source_rows").alias("source_count"),
    ).filter(F.col("replicas").isNotNull()).orderBy("replicas")


def compare_runs(before: DataFrame, after: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Before, after and difference of each measure for every run key on either side."""
    b = before.select(*on, *[F.col(m).alias(f"{m}_before") for m in measures])
    a = after.select(*on, *[F.col(m).alias(f"{m}_after") for m in measures])
    joined = b.join(a, list(on), "full_outer")
    return joined.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures})


def lag_recovered(lags: DataFrame, on: Sequence[str], *, lag_slack_bytes: int = 5_000_000) -> DataFrame:
    """Per run whether every consumer is back within the slack of its own lag before.

    ``lags`` has a row per run and consumer with lag_before and lag_after. A consumer without a lag
    before had none; one without a lag after is not known to have recovered.
    """
    back = F.col("lag_after") <= F.coalesce("lag_before", F.lit(0)) + lag_slack_bytes
    return lags.groupBy(*on).agg(F.bool_and(F.coalesce(back, F.lit(False))).alias("lags_recovered"))


def recovery_audit(
    compared: DataFrame, *, lag_slack_bytes: int = 5_000_000, lags: DataFrame | None = None, on: Sequence[str] = ()
) -> DataFrame:
    """Verdict of an outage run from before/after rows of ``compare_runs``.

    With ``lags`` (see ``lag_recovered``, per run ``on``) the lag rule holds for each consumer.

    Needs ``writes``, ``exit_status``, and before/after of stream_len, sample_count,
    dlq_len, pending_count, active_violation_count and lag_bytes.
    """
    conserved = (F.col("sample_count_delta") == F.col("writes")) & (
        F.col("stream_len_delta") == F.col("writes")
    )
    if lags is None:
        lag_ok = F.col("lag_bytes_after") <= F.coalesce("lag_bytes_before", F.lit(0)) + lag_slack_bytes
    else:
        each = lag_recovered(lags, on, lag_slack_bytes=lag_slack_bytes)
        compared = compared.join(each, list(on), "left")
        lag_ok = F.coalesce("lags_recovered", F.lit(False))
    verdict = (
        conserved
        & (F.col("dlq_len_delta") == 0)
        & (F.col("pending_count_after") == 0)
        & (F.col("active_violation_count_after") == 0)
        & lag_ok
        & (F.col("exit_status") == 0)
    )
    return compared.withColumns(
        {
            "conserved": conserved,
            "lag_recovered": lag_ok,
            "recovered": F.coalesce(verdict, F.lit(False)),
        }
    ).drop("lags_recovered")


def backlog_growth(samples: DataFrame, series: Sequence[str], time: str, measure: str) -> DataFrame:
    """Step from the sample before, and since the first sample, along each monitored series."""
    along = Window.partitionBy(*series).orderBy(time)
    return samples.withColumns(
        {
            "step": F.col(measure) - F.lag(measure).over(along),
            "since_start": F.col(measure) - F.first(measure).over(along),
        }
    )

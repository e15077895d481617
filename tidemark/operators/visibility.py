"""Commit-to-visible measurement: markers, first probes, samples and violations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import running
from tidemark.operators.sizing import DEFAULT, Sizing

# Fixed values of the commit-time guard.
MAX_AHEAD_US = 60_000_000
MAX_AGE_US = 86_400_000_000


@dataclass(frozen=True)
class ProbeGrid:
    """Probes at every multiple of a period: the first one is arithmetic, not a join."""

    period_us: int
    origin_us: int = 0

    def first_at_or_after(self, at: Column) -> Column:
        return at + F.pmod(F.lit(self.origin_us) - at, F.lit(self.period_us))


def tracked_events(events: DataFrame, tables: list[str], key: str = "key", table: str = "table") -> DataFrame:
    return events.filter(F.col(key).isNotNull() & F.col(table).isNotNull() & F.col(table).isin(*tables))


def commit_time_guard(events: DataFrame, now_us: Column | int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by age at ``now_us``; both limits themselves are accepted."""
    age = (F.lit(now_us) if isinstance(now_us, int) else now_us) - F.col("commit_ts_us")
    bad = (age < -MAX_AHEAD_US) | (age > MAX_AGE_US)
    return events.filter(~bad), events.filter(bad).withColumn("age_us", age)


def commit_range(events: DataFrame, lo: int, hi: int) -> DataFrame:
    return events.filter(F.col("commit_ts_us").between(lo, hi))


def marker_status(commits: DataFrame, markers: DataFrame) -> DataFrame:
    """Commits with their marker: ``visible`` needs both the id and the position to match."""
    stored = markers.select("event_id", F.col("lsn").alias("marker_lsn"), "marker_ts_us")
    joined = commits.join(stored, "event_id", "left")
    status = (
        F.when(F.col("marker_lsn").isNull(), "missing")
        .when(F.col("marker_lsn") == F.col("lsn"), "visible")
        .otherwise("wrong_marker")
    )
    return joined.withColumn("marker_status", status)


@dataclass(frozen=True)
class ProbeTimes:
    """Irregular probes: their distinct instants, in the column ``__probe``."""

    instants: DataFrame
    size: Sizing


def probe_times(probes: DataFrame, *, size: Sizing = DEFAULT) -> ProbeTimes:
    """Prepare irregular probes (a frame with ``probe_ts_us``) for ``first_probe``.

    ``size`` speaks of the instants and probes that are lined up together.
    """
    instants = probes.select(F.col("probe_ts_us").cast("bigint").alias("__probe"))
    return ProbeTimes(instants.filter(F.col("__probe").isNotNull()).distinct(), size)


def first_probes(
    events: DataFrame, wanted: Mapping[str, str], probes: ProbeGrid | ProbeTimes, *, identity: str = "event_id"
) -> DataFrame:
    """Add for each entry (new column -> instant column) the first probe at or after it.

    Null without an instant or a later probe. Irregular probes are found in one linear pass for
    all instants: instants and probes are lined up in falling time, where the newest probe passed
    so far is a running minimum, by chunks if there are many. Only (``identity``, instant) pairs
    take part; the answers come back by one equality join on ``identity``, which is unique.
    """
    if isinstance(probes, ProbeGrid):
        return events.withColumns({out: probes.first_at_or_after(F.col(at)) for out, at in wanted.items()})
    none = F.lit(None).cast("bigint")
    # Columns go by number: a row of the line-up is an identity, a number and an instant.
    asked = F.array(
        *[F.struct(F.lit(k).alias("out"), F.col(at).cast("bigint").alias("at")) for k, at in enumerate(wanted.values())]
    )
    instants = events.select(F.col(identity).alias("__id"), F.explode(asked).alias("__ask"))
    # Falling time; a probe stands before the instants that it answers, its own among them.
    instants = instants.filter(F.col("__ask.at").isNotNull()).select(
        "__id", F.col("__ask.out").alias("__out"), none.alias("__probe"), (F.col("__ask.at") * -2).alias("__order")
    )
    marks = probes.instants.select(
        F.lit(None).cast(events.schema[identity].dataType).alias("__id"), F.lit(None).cast("int").alias("__out"),
        "__probe", (F.col("__probe") * -2 - 1).alias("__order"),
    )
    lined = running(
        instants.unionByName(marks), [], "__order", {"__first": ("min", F.col("__probe"))}, size=probes.size
    )
    answers = lined.filter(F.col("__out").isNotNull()).groupBy("__id").agg(
        *[F.max(F.when(F.col("__out") == k, F.col("__first"))).alias(out) for k, out in enumerate(wanted)]
    )
    joined = events.join(answers, F.col(identity) == F.col("__id"), "left")
    return joined.select(*events.columns, *wanted)


def first_probe(
    events: DataFrame, at: str, probes: ProbeGrid | ProbeTimes, out: str, *, identity: str = "event_id"
) -> DataFrame:
    """Add ``out``: the first probe at or after ``at``; null when there is none."""
    return first_probes(events, {out: at}, probes, identity=identity)


def observations(
    commits: DataFrame,
    markers: DataFrame,
    probes: ProbeGrid | ProbeTimes,
    *,
    slo_us: int = 1_000_000,
    guard: bool = True,
    identity: str = "event_id",
) -> DataFrame:
    """One row per commit: when it was first seen visible, and whether it broke the SLO.

    * ``visible_ts_us``: first probe at or after both the marker and the observation;
    * ``violation_ts_us``: first probe with age strictly over the SLO at which the event
      was not visible. An event that turns visible on that very probe is a late sample
      but no violation;
    * ``rejected_ts_us``: with ``guard``, the probe at which the event's age fell outside
      the accepted range while it was unresolved. Rejected events leave every count.

    ``identity`` names a unique column by which irregular probes answer; a narrow one, such as a
    number, saves most of what they shuffle.
    """
    return measured(marker_status(commits, markers), probes, slo_us=slo_us, guard=guard, identity=identity)


def measured(
    seen: DataFrame, probes: ProbeGrid | ProbeTimes, *, slo_us: int = 1_000_000, guard: bool = True,
    identity: str = "event_id",
) -> DataFrame:
    """``observations`` of commits that carry ``marker_status`` and ``marker_ts_us`` already."""
    observed = F.col("observed_ts_us") if "observed_ts_us" in seen.columns else F.col("commit_ts_us")
    seen = seen.withColumns(
        {
            "__ready": F.when(
                F.col("marker_status") == "visible", F.greatest("marker_ts_us", observed)
            ),
            "__late": F.greatest(F.col("commit_ts_us") + slo_us + 1, observed),
        }
    )
    wanted = {"visible_ts_us": "__ready", "__late_probe": "__late"}
    if guard:
        seen = seen.withColumns(
            {"__seen": observed, "__old": F.greatest(F.col("commit_ts_us") + MAX_AGE_US + 1, observed)}
        )
        wanted |= {"__seen_probe": "__seen", "__old_probe": "__old"}
    seen = first_probes(seen, wanted, probes, identity=identity)
    visible, late = F.col("visible_ts_us"), F.col("__late_probe")
    violated = late.isNotNull() & (visible.isNull() | (late < visible))
    if guard:
        ahead = F.col("__seen_probe") - F.col("commit_ts_us") < -MAX_AHEAD_US
        old = F.col("__old_probe")
        rejected = F.when(ahead, F.col("__seen_probe")).when(visible.isNull() | (visible >= old), old)
        violated = violated & ~F.coalesce(ahead, F.lit(False)) & (old.isNull() | (late < old))
    else:
        rejected = F.lit(None).cast("bigint")
    seen = seen.withColumns(
        {"rejected_ts_us": rejected, "violation_ts_us": F.when(violated, late)}
    )
    seen = seen.withColumn("visible_ts_us", F.when(F.col("rejected_ts_us").isNull(), visible))
    seen = seen.withColumns(
        {
            "staleness_us": F.col("visible_ts_us") - F.col("commit_ts_us"),
            "detection_delay_us": F.col("violation_ts_us") - F.col("commit_ts_us") - slo_us,
        }
    )
    helpers = [c for c in seen.columns if c.startswith("__")]
    return seen.drop(*helpers)


def samples(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("visible_ts_us").isNotNull())


def violations(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("violation_ts_us").isNotNull())


def _by_now(time: str, now_us: Column) -> Column:
    return F.coalesce(F.col(time) <= now_us, F.lit(False))


def state_at(obs: DataFrame, now_us: Column | int) -> DataFrame:
    """Add what was known at an instant: sampled, rejected, in flight, violated, active."""
    now = F.lit(now_us).cast("bigint") if isinstance(now_us, int) else now_us
    observed = "observed_ts_us" if "observed_ts_us" in obs.columns else "commit_ts_us"
    started, sampled = _by_now(observed, now), _by_now("visible_ts_us", now)
    dropped, violated = _by_now("rejected_ts_us", now), _by_now("violation_ts_us", now)
    return obs.withColumns(
        {
            "is_sample": sampled,
            "is_rejected": dropped,
            "is_in_flight": started & ~sampled & ~dropped,
            "is_violation": violated,
            "is_active": violated & ~sampled & ~dropped,
        }
    )


def active_violations(obs: DataFrame, now_us: Column | int) -> DataFrame:
    """Violated and unresolved at an instant, with the time since detection."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    active = state_at(obs, now_us).filter("is_active")
    return active.withColumn("active_us", now - F.col("violation_ts_us"))


def ack_frontier(obs: DataFrame) -> DataFrame:
    """The newest commit with it and all earlier commits resolved: two scalar aggregates, no sort."""
    open_ = F.col("visible_ts_us").isNull() & F.col("rejected_ts_us").isNull()
    oldest_open = obs.agg(F.min(F.when(open_, F.col("lsn"))).alias("lsn")).scalar()
    resolved = oldest_open.isNull() | (F.col("lsn") < oldest_open)
    return obs.agg(F.max(F.when(resolved, F.col("lsn"))).alias("frontier_lsn"))

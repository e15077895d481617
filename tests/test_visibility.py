from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from model import watch
from tidemark.operators import metrics, visibility
from tidemark.operators.sizing import Sizing

SECOND, HOUR = 1_000_000, 3_600_000_000
EVENTS = "event_id string, lsn bigint, seq int, commit_ts_us bigint, observed_ts_us bigint"
MARKERS = "event_id string, lsn bigint, marker_ts_us bigint"


def event(name, commit, marker=None, observed=None, lsn=16, marker_lsn=None):
    return {
        "event_id": name, "lsn": lsn, "commit_ts_us": commit, "observed_ts_us": commit if observed is None else observed,
        "marker_ts_us": marker, "marker_lsn": lsn if marker_lsn is None else marker_lsn,
    }


def frames(spark, events):
    e = spark.createDataFrame([(r["event_id"], r["lsn"], 0, r["commit_ts_us"], r["observed_ts_us"]) for r in events], EVENTS)
    m = spark.createDataFrame(
        [(r["event_id"], r["marker_lsn"], r["marker_ts_us"]) for r in events if r["marker_ts_us"] is not None], MARKERS
    )
    return e, m


def observe(spark, events, probes, guard=True, slo=SECOND):
    e, m = frames(spark, events)
    if isinstance(probes, list):
        times = spark.createDataFrame([(p,) for p in probes], "probe_ts_us bigint")
        probes = visibility.probe_times(times, size=Sizing(rows_per_chunk=9))
    return visibility.observations(e, m, probes, slo_us=slo, guard=guard)


def states(obs):
    return {
        r["event_id"]: {"visible": r["visible_ts_us"], "violation": r["violation_ts_us"], "rejected": r["rejected_ts_us"]}
        for r in obs.collect()
    }


@pytest.mark.parametrize("seed", range(3))
def test_irregular_probes_equal_the_probe_loop(spark, seed):
    rng = random.Random(seed)
    probes = sorted({rng.randrange(0, 40 * SECOND) for _ in range(40)} | {25 * HOUR, 26 * HOUR, 60 * HOUR})
    events = []
    for i in range(150):
        commit = rng.choice([rng.randrange(0, 40 * SECOND), rng.randrange(0, 30 * HOUR), 70 * SECOND + rng.randrange(40 * SECOND)])
        observed = max(0, commit + rng.randrange(-90 * SECOND, 3 * SECOND))
        marker = rng.choice([None, commit + rng.randrange(0, 3 * SECOND), commit + rng.randrange(0, 27 * HOUR)])
        events.append(event(f"e{i}", commit, marker, observed, lsn=i, marker_lsn=i + (1 if i % 13 == 0 else 0)))
    assert states(observe(spark, events, probes)) == watch(events, probes, SECOND)
    assert states(observe(spark, events, probes, guard=False)) == watch(events, probes, SECOND, guard=False)


def test_grid_equals_the_same_probes_listed(spark):
    rng = random.Random(7)
    events = [
        event(f"e{i}", c := rng.randrange(0, 9 * SECOND), rng.choice([None, c + rng.randrange(0, 3 * SECOND)]), lsn=i)
        for i in range(80)
    ]
    listed = [p for p in range(0, 20 * SECOND, 120_000)]
    grid = states(observe(spark, events, visibility.ProbeGrid(120_000)))
    model = watch(events, listed, SECOND)
    # The grid never ends, so unanswered events are eventually rejected; the listed one stops.
    for name, state in model.items():
        assert grid[name]["visible"] == state["visible"] and grid[name]["violation"] == state["violation"]


def test_first_seen_late_is_a_sample_but_no_violation(spark):
    obs = observe(spark, [event("e", 0, 900_000)], [500_000, 1_700_000])
    assert states(obs)["e"] == {"visible": 1_700_000, "violation": None, "rejected": None}
    assert obs.first()["staleness_us"] == 1_700_000


def test_age_equal_to_slo_is_no_violation(spark):
    got = states(observe(spark, [event("e", 0)], [SECOND, SECOND + 1]))
    assert got["e"]["violation"] == SECOND + 1
    assert states(observe(spark, [event("e", 0)], [SECOND]))["e"]["violation"] is None


def test_marker_must_match_id_and_position(spark):
    events = [event("a", 0, 5), event("b", 0, 5, marker_lsn=17), event("c", 0)]
    e, m = frames(spark, events)
    got = {r["event_id"]: r["marker_status"] for r in visibility.marker_status(e, m).collect()}
    assert got == {"a": "visible", "b": "wrong_marker", "c": "missing"}


def test_guard_limits_are_inclusive(spark):
    now = 100 * HOUR
    rows = [("ahead", now + 60 * SECOND), ("too_far", now + 60 * SECOND + 1), ("old", now - 24 * HOUR), ("expired", now - 24 * HOUR - 1)]
    df = spark.createDataFrame(rows, "event_id string, commit_ts_us bigint")
    ok, bad = visibility.commit_time_guard(df, now)
    assert {r[0] for r in ok.collect()} == {"ahead", "old"}
    assert {r[0] for r in bad.collect()} == {"too_far", "expired"}


def test_unresolved_event_leaves_after_a_day(spark):
    obs = observe(spark, [event("e", 0)], [2 * SECOND, 24 * HOUR, 24 * HOUR + 1])
    assert states(obs)["e"] == {"visible": None, "violation": 2 * SECOND, "rejected": 24 * HOUR + 1}
    before = metrics.metrics_snapshot(obs, 24 * HOUR).first()
    after = metrics.metrics_snapshot(obs, 24 * HOUR + 1).first()
    assert (before["in_flight_count"], before["active_violation_count"], before["violation_count"]) == (1, 1, 1)
    assert (after["in_flight_count"], after["active_violation_count"], after["violation_count"]) == (0, 0, 1)


def test_ack_frontier_is_a_strict_prefix(spark):
    events = [event("a", 0, 5, lsn=16), event("b", 0, None, lsn=32), event("c", 0, 5, lsn=48)]
    assert visibility.ack_frontier(observe(spark, events, [10])).first()["frontier_lsn"] == 16
    done = [event("a", 0, 5, lsn=16), event("c", 0, 5, lsn=48)]
    assert visibility.ack_frontier(observe(spark, done, [10])).first()["frontier_lsn"] == 48


def test_three_commits_give_three_samples_and_no_violation(spark):
    obs = observe(spark, [event(n, i * SECOND, i * SECOND + 5, lsn=i) for i, n in enumerate("abc")], visibility.ProbeGrid(120_000))
    snap = metrics.metrics_snapshot(obs, 10 * SECOND, ready={"replication": True, "probe": True}).first()
    assert (snap["sample_count"], snap["active_violation_count"], snap["replication_ready"]) == (3, 0, True)


def test_snapshot_of_nothing(spark):
    obs = observe(spark, [event("a", 0, 5)], [10]).filter(F.lit(False))
    snap = metrics.metrics_snapshot(obs, 10).first()
    assert (snap["sample_count"], snap["violation_count"], snap["violation_duration_seconds"]) == (0, 0, 0.0)
    assert snap["p99_staleness_ms"] is None and snap["oldest_in_flight_age_ms"] is None


def test_grouped_snapshot_same_in_both_forms_and_window(spark):
    rng = random.Random(2)
    events = [
        event(f"e{i}", c := rng.randrange(0, 9 * SECOND), rng.choice([None, c + rng.randrange(0, 3 * SECOND)]), lsn=i)
        for i in range(120)
    ]
    obs = observe(spark, events, visibility.ProbeGrid(120_000)).withColumn("g", F.pmod("lsn", F.lit(3)))
    plain = metrics.metrics_snapshot(obs, 12 * SECOND, ["g"]).orderBy("g").collect()
    large = metrics.metrics_snapshot(obs, 12 * SECOND, ["g"], size=Sizing(rows_in_memory=0, rows_per_chunk=11))
    assert plain == large.orderBy("g").collect()
    whole, windowed = (metrics.metrics_snapshot(obs, 12 * SECOND, sample_window=w).first() for w in (None, 1000))
    assert whole == windowed
    few = metrics.metrics_snapshot(obs, 12 * SECOND, sample_window=5).first()
    newest = sorted((r for r in obs.collect() if r["visible_ts_us"]), key=lambda r: (r["visible_ts_us"], r["lsn"]))[-5:]
    assert (few["sample_count"], few["max_staleness_ms"]) == (5, max(r["staleness_us"] for r in newest) / 1000)


def test_tracked_events(spark):
    df = spark.createDataFrame([(1, "t"), (None, "t"), (2, None), (3, "other")], "key bigint, table string")
    assert [r["key"] for r in visibility.tracked_events(df, ["t"]).collect()] == [1]

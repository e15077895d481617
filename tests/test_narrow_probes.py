"""Irregular probes answer by a narrow identity."""

from __future__ import annotations

from tidemark.operators import visibility
from tidemark.operators.sizing import Sizing


def test_probes_answer_by_number_as_by_id(spark):
    second = 1_000_000
    rows = [(f"{i:064x}", i, 10 + i, i * second) for i in range(40)]
    commits = spark.createDataFrame(rows, "event_id string, event_no bigint, lsn bigint, commit_ts_us bigint")
    marks = spark.createDataFrame([(r[0], r[2], r[3] + 300_000 * r[1]) for r in rows if r[1] % 7], "event_id string, lsn bigint, marker_ts_us bigint")
    instants = spark.createDataFrame([(k * 2 * second + 5,) for k in range(30)], "probe_ts_us bigint")
    for size in (Sizing(at_most=10), Sizing(rows_per_chunk=7, rows_in_memory=0)):
        probes = visibility.probe_times(instants, size=size)
        by_id = visibility.observations(commits, marks, probes)
        by_no = visibility.observations(commits, marks, probes, identity="event_no")
        assert by_no.columns == by_id.columns
        assert sorted(map(str, by_no.collect())) == sorted(map(str, by_id.collect()))

"""Queries over version resolution, documents, markers and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lsn import long_to_lsn, lsn_to_long
from tidemark.functions.presence import is_present, value_of
from tidemark.operators import markers as mk
from tidemark.operators import metrics, resolve
from tidemark.plans import inputs
from tidemark.plans.base_sql import CLASSIFIED, COMMITS, DOC_COLUMNS, LOG, fold, with_
from tidemark.plans.inputs import FIELDS


def flat(documents: DataFrame) -> DataFrame:
    columns = [F.col("key")]
    for f in FIELDS:
        columns += [is_present(F.col(f)).alias(f"has_{f}"), value_of(F.col(f)).alias(f)]
    return documents.select(
        *columns, long_to_lsn("_lsn").alias("commit_lsn"), F.col("_deleted").alias("deleted")
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.classify_events(inputs.change_log(spark, sf_dir), size=inputs.size(spark, sf_dir))


def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir)
    return flat(resolve.live_documents(resolve.materialize(log, fields=FIELDS, size=inputs.size(spark, sf_dir))))


def documents_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(resolve.materialize(inputs.change_log(spark, sf_dir), fields=FIELDS, size=inputs.size(spark, sf_dir)))


def documents_commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir)
    return flat(resolve.materialize(log, fields=FIELDS, order="commit"))


def documents_insert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir)
    return flat(resolve.materialize(log, fields=FIELDS, insert_mode="merge", size=inputs.size(spark, sf_dir)))


def documents_tie_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir)
    return flat(resolve.materialize(log, fields=FIELDS, tie="last", size=inputs.size(spark, sf_dir)))


def documents_map_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold for unknown schemas, over a map of sent fields."""
    log = inputs.change_log(spark, sf_dir)
    entries = F.filter(
        F.array(
            *[F.struct(F.lit(f).alias("n"), F.col(f).isNotNull().alias("sent"),
                       F.col(f"{f}.v").cast("string").alias("v")) for f in ("props", "event_type")]
        ),
        lambda e: e.getField("sent"),
    )
    after = F.map_from_entries(F.transform(entries, lambda e: F.struct(e.getField("n"), e.getField("v"))))
    judged = resolve.classify_events(log.withColumn("after", after), size=inputs.size(spark, sf_dir))
    docs = resolve.fold_documents_map(judged.filter(F.col("result") == resolve.APPLIED))
    return docs.select(
        "key",
        F.map_contains_key("fields", F.lit("props")).alias("has_props"),
        F.col("fields")["props"].alias("props"),
        F.map_contains_key("fields", F.lit("event_type")).alias("has_event_type"),
        F.col("fields")["event_type"].alias("event_type"),
        long_to_lsn("_lsn").alias("commit_lsn"),
        F.col("_deleted").alias("deleted"),
    )


def classified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("event_no", "key", "arrival", "op", "lsn", "result")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir).select("key", "event_no", "op", "lsn", "seq", "commit_ts_us")
    return resolve.latest_per_key(log)


def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir).select("event_id", "event_no", "key", "arrival")
    return resolve.dedupe_events(log)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.duplicate_keys(inputs.commits(spark, sf_dir), ["xid"])


def incremental_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents built slice by slice must equal those of the whole log.

    The first slice is applied to nothing, the second on top of the first's documents.
    """
    log = inputs.change_log(spark, sf_dir)
    middle = log.agg(F.floor((F.min("arrival") + F.max("arrival")) / 2).alias("m")).scalar()
    first, second = log.filter(F.col("arrival") <= middle), log.filter(F.col("arrival") > middle)
    size = inputs.size(spark, sf_dir)
    stored = resolve.materialize(first, fields=FIELDS, size=size)
    changed, _ = resolve.incremental_apply(stored, second, fields=FIELDS, size=size)
    return flat(resolve.merge_documents(stored, changed))


def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.with_identity(inputs.commits(spark, sf_dir)).withColumn("lsn_text", long_to_lsn("lsn"))
    return rows.select("event_no", "event_id", "lsn_text", lsn_to_long("lsn_text").alias("lsn"))


def projected_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.change_log(spark, sf_dir).withColumn("id", F.struct("arrival", "key"))
    out = resolve.apply_projection(log, "id", FIELDS)
    return out.select(
        F.col("id.arrival").alias("arrival"), F.col("id.key").alias("key"),
        F.col("value.v").alias("value"), F.col("props.v").alias("props"),
        F.col("_lsn").alias("commit_lsn"), F.col("_deleted").alias("deleted"),
    )


def marker_state_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.marker_state(mk.markers(classified(spark, sf_dir)))


def marker_state_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.marker_state(mk.markers(classified(spark, sf_dir)), first_outcome=True)


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.outcome_counts(mk.markers(classified(spark, sf_dir)))


def stored_markers(spark: SparkSession, sf_dir: str, columns: Sequence[str] = (*mk.MARKER_COLUMNS, "arrival")) -> DataFrame:
    """Commits whose marker was written, with the outcome of the first delivery; of it those ``columns``."""
    outcome = mk.marker_state(mk.markers(classified(spark, sf_dir)), first_outcome=True, columns=columns)
    written = inputs.marker_table(inputs.with_identity(inputs.commits(spark, sf_dir)))
    return written.join(outcome.drop("commit_lsn"), "event_id")


def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.with_identity(inputs.commits(spark, sf_dir))
    return mk.outcome_report(events, stored_markers(spark, sf_dir))


def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.with_identity(inputs.commits(spark, sf_dir))
    return mk.missing_markers(events, inputs.marker_table(events)).select("event_id", "event_no", "key")


def markers_for_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.with_identity(inputs.commits(spark, sf_dir))
    stored = inputs.marker_times(events).filter(F.col("marker_ts_us").isNotNull())
    found = mk.markers_for(stored, events.filter(F.col("op") == "c"))
    return found.select("event_id", "commit_ts_us", "marker_ts_us")


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.with_identity(inputs.commits(spark, sf_dir))
    return metrics.consistency(events, stored_markers(spark, sf_dir))


def op_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.op_mix(inputs.commits(spark, sf_dir))


def distinct_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_commits(inputs.change_log(spark, sf_dir))


def newest_and_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.newest_and_oldest(inputs.with_identity(inputs.commits(spark, sf_dir)))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.throughput(inputs.commits(spark, sf_dir), ["op"])


def commit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.commit_bounds(inputs.commits(spark, sf_dir), ["key"])


QUERIES = {
    f.__name__: f
    for f in (
        live_documents, documents_arrival_order, documents_commit_order, documents_insert_merge,
        documents_tie_last, documents_map_schema, classified_events, latest_per_key, dedupe_events,
        duplicate_keys, incremental_documents, event_identity, projected_changes, marker_state_last,
        marker_state_first, outcome_counts, outcome_report, missing_markers, markers_for_signups,
        consistency, op_mix, distinct_commits, newest_and_oldest, throughput, commit_bounds,
    )
}

_ARRIVAL_DOCS = with_(CLASSIFIED, fold("judged", keep="result = 'applied'"))
_TIE_LAST = LOG + """,
judged AS (
  SELECT *, CASE WHEN CAST(lsn AS HUGEINT) * 10 + seq <= max(CAST(lsn AS HUGEINT) * 10 + seq)
              OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            THEN 'superseded' ELSE 'applied' END AS result
  FROM log
)"""
_FIRST_OUTCOME = CLASSIFIED + """,
outcome AS (SELECT event_id, arg_min(result, arrival) AS result FROM judged GROUP BY event_id),
stored AS (
  SELECT c.event_id, c.lsn, o.result FROM commits c JOIN outcome o USING (event_id)
  WHERE NOT (c.event_no % 97 = 0 AND c.event_no >= 388)
)"""

ORACLE = {
    "live_documents": _ARRIVAL_DOCS + f" SELECT {DOC_COLUMNS} FROM docs WHERE NOT deleted",
    "documents_arrival_order": _ARRIVAL_DOCS + f" SELECT {DOC_COLUMNS} FROM docs",
    "documents_commit_order": with_(LOG, fold("log")) + f" SELECT {DOC_COLUMNS} FROM docs",
    "documents_insert_merge": with_(
        CLASSIFIED, fold("judged", keep="result = 'applied'", insert_resets=False)
    ) + f" SELECT {DOC_COLUMNS} FROM docs",
    "documents_tie_last": with_(_TIE_LAST, fold("judged", keep="result = 'applied'"))
    + f" SELECT {DOC_COLUMNS} FROM docs",
    "documents_map_schema": _ARRIVAL_DOCS + """
      SELECT key, has_props, props, has_event_type, event_type,
             printf('%X/%X', lsn >> 32, lsn & 4294967295) AS commit_lsn, deleted FROM docs""",
    "classified_events": with_(CLASSIFIED) + " SELECT event_no, key, arrival, op, lsn, result FROM judged",
    "latest_per_key": with_(COMMITS) + """
      SELECT key, event_no, op, lsn, seq, commit_ts_us FROM commits
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC, seq DESC) = 1""",
    "dedupe_events": with_(LOG) + """
      SELECT event_id, event_no, key, arrival FROM log
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1""",
    "duplicate_keys": with_(COMMITS) + """
      SELECT xid, key, count(*) AS changes FROM commits GROUP BY xid, key HAVING count(*) > 1""",
    "incremental_documents": _ARRIVAL_DOCS + f" SELECT {DOC_COLUMNS} FROM docs",
    "event_identity": with_(COMMITS) + " SELECT event_no, event_id, commit_lsn AS lsn_text, lsn FROM commits",
    "projected_changes": with_(LOG) + """
      SELECT arrival, key, CASE WHEN op <> 'd' THEN value END AS value,
             CASE WHEN op <> 'd' THEN props END AS props, commit_lsn, op = 'd' AS deleted FROM log""",
    "marker_state_last": with_(CLASSIFIED) + """
      SELECT event_id, CAST(key AS VARCHAR) AS document_id, op, commit_lsn, commit_ts_us, result, arrival
      FROM judged QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival DESC) = 1""",
    "marker_state_first": with_(CLASSIFIED) + """
      SELECT event_id, CAST(key AS VARCHAR) AS document_id, op, commit_lsn, commit_ts_us, result, arrival
      FROM judged QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1""",
    "outcome_counts": with_(CLASSIFIED) + """
      SELECT CAST(key AS VARCHAR) AS document_id, count(*) FILTER (result = 'applied') AS applied,
             count(*) FILTER (result = 'superseded') AS superseded, count(*) AS total
      FROM judged GROUP BY key""",
    "outcome_report": with_(_FIRST_OUTCOME) + """
      SELECT key, count(*) FILTER (result = 'applied') AS applied,
             count(*) FILTER (result = 'superseded') AS superseded, count(*) AS total,
             count(*) FILTER (result IS NULL) AS missing
      FROM commits LEFT JOIN (SELECT event_id, result FROM stored) USING (event_id) GROUP BY key""",
    "missing_markers": with_(COMMITS) + """
      SELECT event_id, event_no, key FROM commits WHERE event_no % 97 = 0 AND event_no >= 388""",
    "markers_for_signups": with_(COMMITS) + """
      SELECT event_id, commit_ts_us, commit_ts_us + 1000 * (120 + (event_no * 7919) % 950
             + CASE WHEN event_no % 50 = 0 THEN 1500 ELSE 0 END) AS marker_ts_us
      FROM commits WHERE op = 'c' AND NOT (event_no % 97 = 0 AND event_no >= 388)""",
    "consistency": with_(_FIRST_OUTCOME) + """
      SELECT key, count(*) AS events, count(*) FILTER (result = 'applied') AS applied,
             count(*) FILTER (result = 'superseded') AS superseded,
             count(*) FILTER (result IS NULL) AS missing, max(c.lsn) AS newest_lsn,
             count(*) FILTER (result IS NULL) = 0
             AND coalesce(max(c.lsn) FILTER (result = 'superseded') < max(c.lsn), TRUE) AS consistent
      FROM commits c LEFT JOIN (SELECT event_id, result FROM stored) USING (event_id) GROUP BY key""",
    "op_mix": with_(COMMITS) + """
      SELECT op, count(*) AS events, count(*) / (SELECT count(*) FROM commits)::DOUBLE AS share
      FROM commits GROUP BY op""",
    "distinct_commits": with_(LOG) + """
      SELECT count(*) AS events, count(DISTINCT lsn) AS distinct_lsns,
             count(DISTINCT commit_ts_us) AS distinct_commit_times FROM log""",
    "newest_and_oldest": with_(COMMITS) + """
      SELECT key, arg_max(event_id, lsn * 10 + seq) AS newest_event_id, max(lsn) AS newest_lsn,
             min(commit_ts_us) AS oldest_commit_ts_us FROM commits GROUP BY key""",
    "throughput": with_(COMMITS) + """
      SELECT op, count(*) AS events, (max(commit_ts_us) - min(commit_ts_us)) / 1000000.0::DOUBLE AS span_seconds,
             count(*) / ((max(commit_ts_us) - min(commit_ts_us)) / 1000000.0::DOUBLE) AS events_per_second
      FROM commits GROUP BY op""",
    "commit_bounds": with_(COMMITS) + """
      SELECT key, min(commit_ts_us) AS first_commit_ts_us, max(commit_ts_us) AS last_commit_ts_us
      FROM commits GROUP BY key""",
}

"""The SQL form of the derived inputs, shared by all oracle queries."""

from __future__ import annotations

COMMITS = """
commits AS (
  SELECT *, max(ts_us) OVER (PARTITION BY xid) AS commit_ts_us,
         printf('%X/%X', lsn >> 32, lsn & 4294967295) AS commit_lsn,
         sha256('catalog|public|accounts|' || printf('%X/%X', lsn >> 32, lsn & 4294967295)
                || '|' || xid || '|' || seq) AS event_id
  FROM (
    SELECT event_id AS event_no, user_id AS key,
           CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
           event_id // 3 AS xid, CAST(event_id % 3 AS INTEGER) AS seq,
           4294967296 + (event_id // 3 - 100) * 64 AS lsn,
           epoch_us(ts) AS ts_us,
           event_type IN ('signup', 'click', 'purchase', 'view') AS has_value,
           CASE WHEN event_type IN ('signup', 'click', 'purchase', 'view') THEN value END AS value,
           event_type IN ('signup', 'click') AS has_props,
           CASE WHEN event_type IN ('signup', 'click') THEN props END AS props,
           event_type IN ('signup', 'purchase') AS has_event_type,
           CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS event_type,
           event_type AS kind
    FROM events
  )
)"""

LOG = COMMITS + """,
log AS (
  SELECT c.*, r.redelivery,
         ((event_no + (event_no % 13) * 37 + r.redelivery * 500) * 1000003 + event_no) * 2
           + r.redelivery AS arrival
  FROM commits c JOIN (VALUES (0), (1)) r(redelivery)
    ON r.redelivery = 0 OR c.event_no % 17 = 0
)"""

CLASSIFIED = LOG + """,
judged AS (
  SELECT *, CASE WHEN lsn <= max(lsn) OVER (PARTITION BY key ORDER BY arrival
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            THEN 'superseded' ELSE 'applied' END AS result
  FROM log
)"""


def fold(source: str, name: str = "docs", *, insert_resets: bool = True, keep: str = "TRUE") -> str:
    """Documents from the changes in ``source`` (per key: newest sent value at or after the newest reset)."""
    resets = "op IN ('c', 'd')" if insert_resets else "op = 'd'"
    fields = ",\n".join(
        f"coalesce(max(v) FILTER (has_{f} AND v >= coalesce(reset, -1)) IS NOT NULL, FALSE) AS has_{f},\n"
        f"arg_max({f}, v) FILTER (has_{f} AND v >= coalesce(reset, -1)) AS {f}"
        for f in ("value", "props", "event_type")
    )
    return f"""
{name}_v AS (
  SELECT *, CAST(lsn AS HUGEINT) * 10 + seq AS v FROM {source} WHERE {keep}
),
{name} AS (
  SELECT key, {fields},
         max(lsn) AS lsn, arg_max(op, v) = 'd' AS deleted
  FROM (SELECT *, max(v) FILTER ({resets}) OVER (PARTITION BY key) AS reset FROM {name}_v)
  GROUP BY key
)"""


DOC_COLUMNS = """key, has_value, value, has_props, props, has_event_type, event_type,
  printf('%X/%X', lsn >> 32, lsn & 4294967295) AS commit_lsn, deleted"""

MARKED = COMMITS + """,
marked AS (
  SELECT *, CASE WHEN NOT (event_no % 97 = 0 AND event_no >= 388)
            THEN commit_ts_us + 1000 * (120 + (event_no * 7919) % 950
                 + CASE WHEN event_no % 50 = 0 THEN 1500 ELSE 0 END) END AS marker_ts_us
  FROM commits
)"""

# First probe on the 120 ms grid, and the violation rule over it.
OBSERVED = MARKED + """,
observed AS (
  SELECT *, visible_ts_us - commit_ts_us AS staleness_us,
         CASE WHEN visible_ts_us IS NULL OR late_ts_us < visible_ts_us THEN late_ts_us END
           AS violation_ts_us,
         CASE WHEN visible_ts_us IS NULL OR late_ts_us < visible_ts_us
              THEN late_ts_us - commit_ts_us - 1000000 END AS detection_delay_us
  FROM (
    SELECT *, ((marker_ts_us + 119999) // 120000) * 120000 AS visible_ts_us,
           ((commit_ts_us + 1000000) // 120000 + 1) * 120000 AS late_ts_us
    FROM marked
  )
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts)

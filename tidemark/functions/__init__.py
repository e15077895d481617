from tidemark.functions.identity import event_id
from tidemark.functions.latency import (
    age_ms,
    commit_to_publish_ms,
    micros_to_iso,
    queue_latency_ms,
    to_ms,
)
from tidemark.functions.lsn import long_to_lsn, lsn_diff, lsn_to_long, pg_micros_to_unix
from tidemark.functions.presence import absent, is_present, present, value_of
from tidemark.functions.values import decode_row, decode_value, key_map

__all__ = [
    "absent",
    "age_ms",
    "commit_to_publish_ms",
    "decode_row",
    "decode_value",
    "event_id",
    "is_present",
    "key_map",
    "long_to_lsn",
    "lsn_diff",
    "lsn_to_long",
    "micros_to_iso",
    "pg_micros_to_unix",
    "present",
    "queue_latency_ms",
    "to_ms",
    "value_of",
]

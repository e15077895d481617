"""Deterministic event identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(
    db: Column, schema: Column, table: Column, lsn_text: Column, xid: Column, seq: Column
) -> Column:
    """Lower-case SHA-256 of the change's place in the source log.

    A missing xid is spelled ``None`` so that it still takes part in the identity
    (``concat_ws`` alone would silently drop it).
    """
    parts = [db, schema, table, lsn_text, xid.cast("string"), seq.cast("string")]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]), 256)

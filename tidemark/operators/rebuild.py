"""Rebuilding documents from a source snapshot and the log after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.presence import present
from tidemark.operators.resolve import fold_documents


def snapshot_as_changes(source: DataFrame, keys: Sequence[str], fields: Sequence[str], at_lsn: Column) -> DataFrame:
    """Authoritative rows as inserts at the snapshot's position, every field present."""
    return source.select(
        *keys,
        F.lit("c").alias("op"),
        at_lsn.cast("bigint").alias("lsn"),
        F.lit(0).alias("seq"),
        *[present(F.col(f)).alias(f) for f in fields],
    )


def rebuild(
    source: DataFrame, log_tail: DataFrame, keys: Sequence[str], fields: Sequence[str], at_lsn: Column
) -> DataFrame:
    """Documents = source rows at ``at_lsn``, then the changes after it, by version."""
    columns = [*keys, "op", "lsn", "seq", *fields]
    base = snapshot_as_changes(source, keys, fields, at_lsn).select(*columns)
    later = log_tail.filter(F.col("lsn") > at_lsn).select(*columns)
    return fold_documents(base.unionByName(later), keys, fields)

"""Bounded windows, trimming and orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import value_at_rank
from tidemark.operators.sizing import DEFAULT, Sizing


def last_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The newest ``n`` rows: a top-n per partition, then a merge of those."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def trim_log(
    log: DataFrame,
    maxlen: int = 500_000,
    order: str = "arrival",
    *,
    keep_from: int | None = None,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """The newest ``maxlen`` entries, by a cut-off found with distributed running counts.

    ``keep_from`` (for example the oldest position not yet consumed) is never cut past.
    """
    surplus = log.count() - maxlen
    if surplus <= 0:
        return log
    cut = value_at_rank(log, order, surplus, size=size).scalar()
    kept = F.col(order) > cut
    return log.filter(kept if keep_from is None else kept | (F.col(order) >= keep_from))


def commit_order(events: DataFrame) -> DataFrame:
    """Range-partitioned total order by commit position, then delivery."""
    return events.orderBy("lsn", "arrival")


def read_range(log: DataFrame, after: int, order: str = "arrival") -> DataFrame:
    """Entries strictly after a position."""
    return log.filter(F.col(order) > after)


def events_for_key(log: DataFrame, key_value: object, key: str = "key") -> DataFrame:
    """Keys are compared as text."""
    return log.filter(F.col(key).cast("string") == str(key_value))

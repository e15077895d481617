"""Exact nearest-rank percentiles.

The value at rank ``ceil(q * n)`` of the sorted group, never an interpolation. The built-in
``percentile_disc`` follows the same rule but keeps a count per distinct value in one
buffer per group, so it is used only up to ``Sizing.rows_in_memory`` rows; beyond that the
ranks are found with running counts over equal-depth chunks of the value range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import KEY, running, with_chunk
from tidemark.operators.sizing import DEFAULT, Sizing
from tidemark.session import materialized


def nearest_rank(value: str, q: float) -> Column:
    """Aggregate expression over the column named ``value``; null on an empty group."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def nearest_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """One row per group with a column per entry of ``quantiles``."""
    by = list(by)
    known = df.filter(F.col(value).isNotNull()).select(*by, value)
    if size.fits_in_memory(known):
        return known.groupBy(*by).agg(*[nearest_rank(value, q).alias(n) for n, q in quantiles.items()])
    return ranks_by_running_count(known, by, value, quantiles, size=size)


def ranks_by_running_count(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """The distributed form: no task ever holds a group's values.

    The same rows and types as the in-memory form: a null group is a group, and without groups
    there is one row, of nulls if there are no values.
    """
    # Written once: boundaries, carries, totals and picks all read these counts.
    counts = materialized(df.groupBy(*by, value).agg(F.count("*").alias("__n")), "counts")
    return ranks_of_counts(counts, by, value, "__n", quantiles, size=replace(size, at_most=None))


def ranks_of_counts(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    n: str,
    quantiles: Mapping[str, float],
    *,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """Exact ranks from how often each value occurs: (``by``, ``value``) is unique, ``n`` its count."""
    by = list(by)
    types = counts.groupBy().agg(*[nearest_rank(value, q).alias(name) for name, q in quantiles.items()]).schema
    counts = counts.select(*by, value, F.col(n).cast("bigint").alias("__n"))
    upto = running(counts, by, value, {"__upto": ("sum", F.col("__n"))}, size=size)
    if by:
        totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total")).select(F.struct(*by).alias(KEY), "__total")
        placed = upto.withColumn(KEY, F.struct(*by)).join(totals, KEY)
    else:
        placed = upto.withColumn("__total", counts.agg(F.sum("__n")).scalar())
    picks = []
    for name, q in quantiles.items():
        rank = F.least(F.col("__total"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("__total"))))
        here = (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)
        picks.append(F.max(F.when(here, F.col(value))).cast(types[name].dataType).alias(name))
    return placed.groupBy(*by).agg(*picks)


def value_at_rank(df: DataFrame, value: str, rank: int, *, size: Sizing = DEFAULT) -> DataFrame:
    """The ``rank``-th smallest value (1-based) as a one-row frame; null beyond the end.

    Rows are counted per equal-depth range of values first; only the range that holds the rank
    is looked at more closely, about ``rows_per_chunk`` rows.
    """
    known = df.select(value).filter(F.col(value).isNotNull())
    bounds = list(size.bounded(known, value).bounds)
    if bounds:
        ranges = with_chunk(known, value, bounds).groupBy("__chunk").agg(F.count("*").alias("n"))
        below = 0
        for r in sorted(ranges.collect(), key=lambda r: r["__chunk"]):  # at most ``max_chunks`` rows
            if below + r["n"] >= rank:
                lo, hi = ([-math.inf, *bounds, math.inf])[r["__chunk"] : r["__chunk"] + 2]
                inside = known.filter(F.col(value) >= lo) if lo > -math.inf else known
                known = inside.filter(F.col(value) < hi) if hi < math.inf else inside
                rank -= below
                break
            below += r["n"]
        else:
            known, rank = known.limit(0), 1
    counts = known.groupBy(value).agg(F.count("*").alias("__n"))
    upto = running(counts, [], value, {"__upto": ("sum", F.col("__n"))}, size=Sizing())
    here = (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)
    return upto.agg(F.max(F.when(here, F.col(value))).alias(value))


def aggregate_with_ranks(
    df: DataFrame,
    by: Sequence[str],
    aggregates: Sequence[Column],
    ranks: Mapping[str, tuple[str, float]],
    *,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """Ordinary aggregates plus nearest-rank columns (name -> (value column, quantile))."""
    by = list(by)
    if size.fits_in_memory(df):
        ranked = [nearest_rank(v, q).alias(n) for n, (v, q) in ranks.items()]
        return df.groupBy(*by).agg(*aggregates, *ranked)
    # Written once: the aggregates and every ranked column read it.
    keyed = materialized(df, "ranked")
    out = keyed.groupBy(*by).agg(*aggregates)
    for column in dict.fromkeys(v for v, _ in ranks.values()):
        wanted = {n: q for n, (v, q) in ranks.items() if v == column}
        known = keyed.filter(F.col(column).isNotNull()).select(*by, column)
        found = ranks_by_running_count(known, by, column, wanted, size=size)
        if by:
            found = found.select(F.struct(*by).alias(KEY), *wanted)
            out = out.withColumn(KEY, F.struct(*by)).join(found, KEY, "left").drop(KEY)
        else:
            one = materialized(found, "ranks")
            out = out.withColumns({n: one.select(n).scalar() for n in wanted})
    return out

"""Exact histograms that add up: freshness over any window without reading samples again.

A histogram holds how often each value occurs per group and time bucket. It is one aggregation,
combined map-side, and histograms of parts of the data add up by ``merged``. A window is a sum of
buckets, and its nearest ranks come from running counts, so they equal those of the samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.latency import to_ms
from tidemark.operators.metrics import STALENESS_RANKS
from tidemark.operators.ranks import ranks_of_counts
from tidemark.operators.sizing import DEFAULT, Sizing

MINUTE_US = 60_000_000


def value_counts(
    rows: DataFrame, by: Sequence[str], time: str, value: str, *, grain_us: int = MINUTE_US
) -> DataFrame:
    """(``by``, bucket, value, n): how often each value occurs per bucket of ``time``.

    ``bucket`` is the number of the grain since the epoch. Rows without a time or value do not count.
    """
    known = rows.filter(F.col(time).isNotNull() & F.col(value).isNotNull())
    bucket = F.floor(F.col(time) / F.lit(grain_us)).cast("bigint")
    return known.groupBy(*by, bucket.alias("bucket"), F.col(value).alias("value")).agg(F.count("*").alias("n"))


def merged(histograms: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One histogram of several: of days, files or stream batches that share no row."""
    whole = histograms[0]
    for other in histograms[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy(*by, "bucket", "value").agg(F.sum("n").alias("n"))


def sliding(histogram: DataFrame, by: Sequence[str], *, length: int, step: int) -> DataFrame:
    """(``by``, window, value, n): windows of ``length`` buckets, one ending every ``step`` buckets.

    Window ``w`` holds the buckets ``w * step - length`` (exclusive) to ``w * step`` (inclusive). A
    bucket's counts go to the length / step windows that hold it; windows without rows do not appear.
    """
    if length % step:
        raise ValueError("length must be a multiple of step")
    first = F.ceil(F.col("bucket") / F.lit(step)).cast("bigint")
    windows = F.sequence(first, first + (length // step - 1))
    placed = histogram.select(*by, F.explode(windows).alias("window"), "value", "n")
    return placed.groupBy(*by, "window", "value").agg(F.sum("n").alias("n"))


def summary(
    histogram: DataFrame,
    by: Sequence[str],
    quantiles: Mapping[str, float] | None = None,
    *,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """count, nearest ranks and maximum in milliseconds per group, from (``by``, value, n).

    ``size`` speaks of the histogram's rows, which are at most the samples' number.
    """
    quantiles = dict(quantiles or STALENESS_RANKS)
    by = list(by)
    ranked = ranks_of_counts(histogram, by, "value", "n", quantiles, size=size)
    totals = histogram.groupBy(*by).agg(F.sum("n").alias("sample_count"), F.max("value").alias("__max"))
    key = F.struct(*by) if by else F.lit(0)
    joined = totals.withColumn("__key", key).join(ranked.select(key.alias("__key"), *quantiles), "__key")
    return joined.select(
        *by,
        "sample_count",
        *[to_ms(F.col(n)).alias(f"{n}_staleness_ms") for n in quantiles],
        to_ms(F.col("__max")).alias("max_staleness_ms"),
    )

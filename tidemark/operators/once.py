"""Costly expressions that several later columns and filters look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for an expression to be evaluated once per row.

    The optimizer merges neighbouring projections and pushes filters below them, and so
    copies an expression into each place that refers to it. A generator of exactly one row
    is not taken apart in this way.
    """
    return df.withColumn(name, F.explode(F.array(value)))

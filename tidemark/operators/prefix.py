"""Running aggregates over a log that may have very hot keys, or no key at all.

A window partitioned by key puts a whole key into one task. That is fine for every key of
at most a chunk of rows, so ``running`` first finds the keys beyond that (counted map-side;
there can be no more of them than rows / chunk). Without any, the plain window is used.
The others are cut along the order column at equal-depth boundaries, so that no group
exceeds about one chunk of rows however the keys are distributed:

1. totals per (hot key, chunk), combined map-side;
2. a running carry over those totals, at most ``max_chunks`` rows per hot key at a time;
3. the in-chunk running value, combined with the carry joined on (key, chunk).

Inputs of more than ``max_chunks`` chunks have chunks of chunks: every chunk is cut into parts
of ``rows_per_chunk`` rows, and the carry is worked out in two levels in the same way.

The join and the window share one hash partitioning, so the rows cross the network once,
as with the plain window. The carry has one row per hot key and chunk, a millionth of the
log's rows, which is why it can be the build side of a hash join in every partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizing import DEFAULT, Sizing
from tidemark.session import materialized

CHUNK = "__chunk"
SUPER, CUTS = "__super", "__cuts"
# The keys as one struct: equal also where parts are null, so null keys are keys like others.
KEY = "__key"
# Hot keys are broadcast only where their number is known to stay below this.
BROADCAST_KEYS = 100_000

_AGGREGATE: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum}


def _combine(op: str, carry: Column, here: Column) -> Column:
    if op == "max":
        return F.greatest(carry, here)
    if op == "min":
        return F.least(carry, here)
    return F.when(carry.isNull(), here).otherwise(carry + F.coalesce(here, F.lit(0)))


def hot_keys(df: DataFrame, keys: Sequence[str], size: Sizing) -> DataFrame | None:
    """Keys (as the struct KEY) with more rows than a chunk, written out; None when there are none."""
    if size.rows(df) <= size.rows_per_chunk:
        return None
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    found = materialized(counted.filter(F.col("__n") > size.rows_per_chunk).select(F.struct(*keys).alias(KEY)), "hot-keys")
    return None if found.isEmpty() else found


def with_chunk(df: DataFrame, order: str, bounds: Sequence[float]) -> DataFrame:
    """Add the chunk number: a pure, monotone function of ``order``, stable under retries."""
    if not bounds:
        return df.withColumn(CHUNK, F.lit(0))
    splits = [-math.inf, *bounds, math.inf]
    cut = Bucketizer(splits=splits, inputCol=order, outputCol=CHUNK, handleInvalid="keep")
    return cut.transform(df).withColumn(CHUNK, F.col(CHUNK).cast("int"))


def with_parts(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Cut every chunk into ``parts`` of about equal depth; chunk numbers stay in order.

    The boundaries are worked out per chunk, combined map-side, and written: ``max_chunks`` rows.
    """
    if parts == 1:
        return df
    accuracy = max(10_000, 10 * parts)
    cuts = ",".join(f"{i / parts}D" for i in range(1, parts))
    found = df.groupBy(CHUNK).agg(F.expr(f"array_sort(array_distinct(percentile_approx({order}, array({cuts}), {accuracy})))").alias(CUTS))
    found = F.broadcast(materialized(found, "chunk-parts"))  # one row per chunk
    below = F.size(F.filter(CUTS, lambda c: c < F.col(order)))
    return df.join(found, CHUNK, "left").withColumn(CHUNK, F.col(CHUNK).cast("bigint") * parts + below).drop(CUTS)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """Add running ``max``/``min``/``sum`` columns along ``order`` within ``keys``.

    ``outputs`` maps a new column to (aggregate, expression). ``inclusive`` decides whether
    the current row counts. ``order`` must be numeric and unique within the keys. ``keys``
    may be empty; a null key is a key of its own.
    """
    keys = list(keys)
    last = Window.currentRow if inclusive else -1
    size = replace(size, at_most=size.rows(df))

    def along(*group: str) -> dict[str, Column]:
        frame = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        return {n: _AGGREGATE[op](e).over(frame) for n, (op, e) in outputs.items()}

    hot = hot_keys(df, keys, size) if keys else None
    if keys and hot is None:
        return df.withColumns(along(*keys))

    bounds = size.bounded(df, order).bounds
    group = [KEY, CHUNK] if keys else [CHUNK]
    based = df.withColumn(KEY, F.struct(*keys)) if keys else df
    if not bounds:
        return with_chunk(based, order, bounds).withColumns(along(*group)).drop(CHUNK, KEY)
    parts = size.parts(df)
    tagged = cut = with_parts(with_chunk(based, order, bounds), order, parts)
    if hot is not None:
        few = size.at_most // size.rows_per_chunk <= BROADCAST_KEYS
        marked = hot.withColumn("__hot", F.lit(True))
        marked = F.broadcast(marked) if few else marked
        cut = cut.join(marked, KEY, "left_semi")
        # A key that is not hot stays in one piece.
        tagged = tagged.join(marked, KEY, "left")
        tagged = tagged.withColumn(CHUNK, F.when(F.col("__hot"), F.col(CHUNK)).otherwise(-1)).drop("__hot")

    totals = cut.groupBy(*group).agg(*[_AGGREGATE[op](e).alias(n) for n, (op, e) in outputs.items()])
    carry = _carry(totals, group, {n: op for n, (op, _) in outputs.items()}, parts)
    some = reduce(lambda a, b: a | b, [F.col(f"__carry_{n}").isNotNull() for n in outputs])
    carry = carry.filter(some)

    # Without keys a carry of up to ``max_chunks`` rows is broadcast; one over chunks of chunks is not.
    carry = F.broadcast(carry) if not keys and parts == 1 else carry.hint("shuffle_hash")
    joined = tagged.join(carry, group, "left").withColumns(along(*group))
    joined = joined.withColumns(
        {n: _combine(op, F.col(f"__carry_{n}"), F.col(n)) for n, (op, _) in outputs.items()}
    )
    return joined.select(*df.columns, *outputs)


def _carry(totals: DataFrame, group: list[str], ops: Mapping[str, str], parts: int) -> DataFrame:
    """What all earlier chunks of a key amount to, per chunk.

    No window holds more than ``max_chunks`` rows of a key: first the parts within a chunk, then
    the chunks.
    """
    keys = group[:-1]

    def before(df: DataFrame, by: list[str], order: str, prefix: str) -> DataFrame:
        frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[_AGGREGATE[op](F.col(n)).over(frame).alias(f"{prefix}{n}") for n, op in ops.items()])

    if parts == 1:
        return before(totals, keys, CHUNK, "__carry_").select(*group, *[f"__carry_{n}" for n in ops])
    placed = totals.withColumn(SUPER, F.expr(f"{CHUNK} div {parts}"))
    whole = placed.groupBy(*keys, SUPER).agg(*[_AGGREGATE[op](F.col(n)).alias(n) for n, op in ops.items()])
    outer = before(whole, keys, SUPER, "__outer_").select(*keys, SUPER, *[f"__outer_{n}" for n in ops])
    inner = before(placed, [*keys, SUPER], CHUNK, "__inner_")
    both = inner.join(outer, [*keys, SUPER], "left")
    return both.select(
        *group, *[_combine(op, F.col(f"__outer_{n}"), F.col(f"__inner_{n}")).alias(f"__carry_{n}") for n, op in ops.items()]
    )

"""Connected components of a link table by alternating stars, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialized


def _state(edges: DataFrame) -> tuple:
    # The only things the driver sees: a count and two checksums.
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)")),
            F.sum((F.xxhash64("v", "u") % 998_244_353).cast("decimal(38,0)")),
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    `links` has columns a, b in any order, with repeats; a link to itself keeps the id.
    Every round halves the depth at least, so the number of rounds is logarithmic; each is
    written to the shared folder.  Aggregates are combined map-side, so a hub with many links
    is one row per task before the shuffle; joins have one row per key on the other side.
    """
    loops = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialized(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialized(large.where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialized(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    rooted = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return loops.join(rooted, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

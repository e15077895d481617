"""Exact deduplication by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items sketch) over the digests names the few digests
that hold many rows.  Their exact counts and winners are verified, and these at most
1 / HEAVY_SHARE winners are broadcast: rows of large groups are judged where they are read.
The remaining digests, each with less than HEAVY_SHARE of the rows, shuffle in the ordinary way.
Only digests and ids are moved, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.names import free
from tidemark.session import materialized

#: A digest with at least this share of all rows is heavy: 1000 winners at most are broadcast.
HEAVY_SHARE = 1e-3
#: Counters of the summary; its error is 3.5 / TRACKED of all rows, below half of HEAVY_SHARE.
TRACKED = 8192
TOP = 2048
_SALTS = 64
#: Copies to be dropped up to which their ids and digests (some 100 bytes each) are broadcast, so that
#: no text is moved; more of them are joined in the ordinary way.
BROADCAST_COPIES = 1 << 20


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _heavy(rows: DataFrame, total: int) -> DataFrame:
    """Verified winners (digest, n, top) of the digests with at least HEAVY_SHARE of the rows."""
    mark = F.xxhash64("digest")
    found = (
        rows.groupBy((F.spark_partition_id() % _SALTS).alias("salt"))
        .agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {TRACKED})").alias("sketch"))
        .groupBy(F.lit(0).alias("all"))  # grouped: an empty table then gives no row
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {TOP})").alias("top"))
        .select(F.explode("top").alias("top"))
        .select(F.col("top.item").alias("mark"))
    )
    return (
        rows.join(F.broadcast(found), mark == F.col("mark"), "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top"))
        .where((F.col("n") > 1) & (F.col("n") >= total * HEAVY_SHARE))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of `docs`.

    Null text equals the empty text.  Of equal texts the row with the largest id stays; a null
    id counts as smaller than any other.  Of repeated rows (same id and text) one is `kept`.
    An empty table gives no rows; other columns are ignored.
    """
    rows = materialized(
        docs.select(
            F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")
        ),
        "digests",
    )
    heavy = materialized(_heavy(rows, rows.count()), "heavy-digests")
    small = Window.partitionBy("digest")
    light = rows.join(F.broadcast(heavy), "digest", "left_anti").select(
        "*", F.count("*").over(small).alias("n"), F.max(F.struct("doc_id", "row")).over(small).alias("top")
    )
    judged = rows.join(F.broadcast(heavy), "digest").unionByName(light)
    return judged.select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("top.row")).alias("kept"),
        "digest",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, in all their columns, without the copies that `exact_groups` drops.

    Null counts as the empty text.  Of equal texts the row with the largest id stays, a null id
    being smaller than any other; of rows that are alike in id and text one stays.  Texts of any
    length are compared by digest; an empty table stays empty; columns may have any names.
    """
    judged = materialized(
        exact_groups(docs, id_col, text_col).where("group_size > 1").select("doc_id", "keep_id", "digest"), "judged"
    )
    own = [free(docs, "key"), free(docs, "sha")]
    other = [free(docs, "other_key"), free(docs, "other_sha")]
    keyed = docs.withColumns({own[0]: F.col(id_col), own[1]: digest(text_col)})

    def at(keys: DataFrame) -> tuple[DataFrame, Column]:
        side = keys.select(F.col("doc_id").alias(other[0]), F.col("digest").alias(other[1]))
        side = F.broadcast(side) if keys.count() <= BROADCAST_COPIES else side
        return side, F.col(own[0]).eqNullSafe(F.col(other[0])) & (F.col(own[1]) == F.col(other[1]))

    copies, same = at(judged.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).distinct())
    left = keyed.join(copies, same, "left_anti")
    # Rows repeated as a whole key (id and text) are rare; only those are shuffled again.
    repeated = judged.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "digest").count()
    repeated = repeated.where("count > 1").drop("count")
    if repeated.isEmpty():
        return left.drop(*own)
    again, same = at(repeated)
    once = left.join(again, same, "left_semi").dropDuplicates(own)
    return left.join(again, same, "left_anti").unionByName(once).drop(*own)

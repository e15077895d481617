"""Near-duplicates: one-permutation hashing with optimal densification and star candidates.

1. Every text becomes a signature of bands * ROWS bins of one permutation.  An empty bin
   borrows from the first filled one in an order of its own (optimal densification).  Equal
   shingle sets are one node from here on.
2. Bands of ROWS bins are buckets, as many as the threshold needs: a pair at the threshold t
   misses all buckets with probability (1 - t^ROWS)^bands, at most MISS.  That is 25 bands at
   85 % and 37 at 80 %.
3. A bucket proposes a star: its most central member (largest total of bucket sizes) against
   the others, so there are fewer candidates than members.  Candidates are confirmed on full sets.
4. Links a star cannot see lie in buckets that still hold several components.  Their members
   alone are brought together once more, by their rarest shingles (prefix filter), and compared
   in blocks of bounded size inside tasks; what leaves a task is confirmed links only.  Meetings
   that overlap are held as one where they fit a block, so that a set is sent to few of them.  So
   no pair of a bucket is lost, and there is no cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text
from tidemark.llm.components import components
from tidemark.llm.idset import IdSet, row_key
from tidemark.llm.ship import ship
from tidemark.session import materialized

#: Chance that a pair at the threshold meets in no band, and bins of a band.
MISS = 5e-7
ROWS = 5
WIDTH = 5
#: What tells sets apart: 128 bits of hash and the size.
KEY = ["low", "high", "n_shingles"]
#: Members and shingles that one block of an unresolved bucket holds on average.
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1 << 18


def n_bands(percent: int) -> int:
    """The least number of bands by which a pair at the threshold is missed with MISS at most."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be in 1..100, not {percent}")
    return 1 if percent == 100 else math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


@cache
def _order(bins: int) -> np.ndarray:
    """Row i: the order in which bin i, when empty, looks at the others."""
    return np.argsort(text.constants(9, bins * bins).reshape(bins, bins), axis=1)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signature of a non-empty sorted set of 64-bit hashes."""
    at = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    filled = np.zeros(bins, bool)
    filled[at[first]] = True
    values = np.zeros(bins, np.uint64)
    values[at[first]] = shingles[first]
    order = _order(bins)
    return values[order[np.arange(bins), filled[order].argmax(axis=1)]] if not filled.all() else values


def _bands(signatures: np.ndarray) -> np.ndarray:
    bins = signatures.shape[1]
    parts = text.mix(signatures * text.constants(11, bins)).reshape(-1, bins // ROWS, ROWS).sum(axis=2, dtype=np.uint64)
    return text.mix(parts + text.constants(13, bins // ROWS)).view(np.int64)


def _sketch(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            rows = batch.num_rows
            size, low, high = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            signatures = np.zeros((rows, n * ROWS), np.uint64)
            for i, shingles in enumerate(text.shingle_sets(batch.column("text"), WIDTH)):
                size[i] = len(shingles)
                if len(shingles):
                    low[i], high[i] = _hashes(shingles)
                    signatures[i] = signature(shingles, n * ROWS)
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (rows + 1) * n, n, dtype=np.int32)), pa.array(_bands(signatures).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(size), pa.array(low), pa.array(high), bands],
                ["doc_id", "row", "n_shingles", "low", "high", "bands"],
            )

    return sketch


def _hashes(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a non-empty set."""
    low = text.mix(np.sum(shingles, keepdims=True, dtype=np.uint64)).view(np.int64)[0]
    return int(low), int(np.sum(text.mix(shingles), dtype=np.uint64).view(np.int64))


def _sets(find):
    """Shingle sets of the rows whose key `find` knows (all rows without it), and their hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            if find is not None:
                batch = batch.filter(pa.array(find(np.asarray(batch.column("row")))))
            found = list(text.shingle_sets(batch.column("text"), WIDTH))
            at = np.r_[0, np.cumsum([len(s) for s in found])].astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            both = np.array([_hashes(s) if len(s) else (0, 0) for s in found], np.int64).reshape(-1, 2)
            size = pa.array(np.diff(at).astype(np.int64))
            shingles = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), size, shingles], [*KEY, "shingles"])

    return sets


def _linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (left + right - shared)


def _block_links(percent: int):
    def links(pdf):
        """Confirmed links between different components among the members of one block pair."""
        import pandas as pd

        one, two = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        halves = [pdf[pdf["block"] == one], pdf[pdf["block"] == two]]
        empty = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        if not all(map(len, halves)):
            return empty
        ids = [h["id"].to_numpy() for h in halves]
        group = [h["component"].to_numpy() for h in halves]
        sizes = [np.array([len(s) for s in h["shingles"]], np.int64) for h in halves]
        flat = [np.concatenate(list(h["shingles"])).astype(np.int64) for h in halves]
        common = np.intersect1d(*[np.unique(f) for f in flat], assume_unique=True)
        shared = np.zeros((len(ids[0]), len(ids[1])), np.int64)
        owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
        step = max(1, (1 << 24) // (len(ids[0]) + len(ids[1])))
        for a in range(0, len(common), step):  # intersections of all pairs as products of 0/1 matrices
            piece = common[a : a + step]
            matrices = []
            for f, o, n in zip(flat, owner, sizes, strict=True):
                at = np.minimum(np.searchsorted(piece, f), len(piece) - 1)
                hit = piece[at] == f
                m = np.zeros((len(n), len(piece)), np.float32)
                m[o[hit], at[hit]] = 1
                matrices.append(m)
            shared += np.rint(matrices[0] @ matrices[1].T).astype(np.int64)
        yes = _linked(shared, sizes[0][:, None], sizes[1][None, :], percent) & (group[0][:, None] != group[1][None, :])
        x, y = np.nonzero(yes)
        return pd.DataFrame({"a": ids[0][x], "b": ids[1][y]}) if len(x) else empty

    return links


def _unresolved(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets that meet in a bucket which still holds several components.

    Two sets at the threshold share a shingle among the (1 - t) n + 1 rarest of each (prefix filter).
    So the members of such buckets are brought together by their rare shingles, and what only shares
    common passages below the threshold never meets.
    """
    labelled = members.join(labels, "id", "left").select("*", F.coalesce("component", "id").alias("c")).drop("component")
    mixed = labelled.groupBy("bucket").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high"))
    mixed = mixed.where("low <> high and m > 2").select("bucket")
    wanted = labelled.join(mixed, "bucket", "left_semi").select("id", "c").distinct()
    mine = materialized(sets.join(wanted, "id"), "unresolved")

    spread = mine.select("id", F.explode("shingles").alias("shingle"))
    shared = spread.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    rarest = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), F.col("shingle"))))  # one set's shingles
    ordered = spread.join(shared, "shingle", "left").groupBy("id").agg(rarest.alias("ordered"))
    size = F.size("ordered")
    prefix = F.slice("ordered", F.lit(1), (size - F.ceil(size * percent / 100) + 1).cast("int"))
    met = ordered.select("id", size.alias("size"), F.explode(prefix).alias("s")).where("s.n > 1")
    met = materialized(met.select(F.col("s.shingle").alias("shingle"), "id", "size").join(mine.select("id", "c"), "id"), "rare-shingles")
    groups = (
        met.groupBy("shingle")
        .agg(
            F.count("*").alias("m"),
            F.sum("size").alias("weight"),
            F.min("c").alias("low"),
            F.max("c").alias("high"),
            F.sum(F.xxhash64("id") % (1 << 40)).alias("f1"),
            F.sum(F.xxhash64("id", F.lit(1)) % (1 << 40)).alias("f2"),
            F.min("id").alias("anchor"),
        )
        .where("low <> high")
        .groupBy("m", "f1", "f2")  # the same members meet by many shingles: once is enough
        .agg(F.min("shingle").alias("shingle"), F.first("weight").alias("weight"), F.first("anchor").alias("anchor"))
        .select(
            "shingle",
            "anchor",
            F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        )
    )
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    placed = met.join(groups, "shingle").select("shingle", "id", F.col("c").alias("component"), "size", "anchor", block.alias("block"), "blocks")
    paired = _meetings(materialized(placed, "meetings"))
    return (
        paired.join(mine.select("id", "shingles"), "id")
        .groupBy("whole", "key", "i", "j")
        .applyInPandas(_block_links(percent), "a long, b long")
    )


def _meetings(placed: DataFrame) -> DataFrame:
    """Who is compared with whom: rows of one (whole, key, i, j) meet, each taking its set there.

    Meetings by different shingles overlap, and a set would be sent to each of them.  Those with the
    same smallest id are held as one wherever their members fit one block; the others stay apart,
    cut into pairs of blocks.  So no two that met are separated, and no set is sent more often.
    """
    guests = placed.groupBy("anchor", "id").agg(F.first("component").alias("component"), F.first("size").alias("size"))
    fits = guests.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    fits = fits.where((F.col("n") <= BLOCK_MEMBERS) & (F.col("shingles") <= BLOCK_SHINGLES)).select("anchor")
    zero = F.lit(0)
    one = guests.join(fits, "anchor", "left_semi").select(
        F.lit(True).alias("whole"), F.col("anchor").alias("key"), "id", "component", zero.alias("block"), zero.alias("i"), zero.alias("j")
    )
    many = placed.join(fits, "anchor", "left_anti").withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    many = many.select(
        F.lit(False).alias("whole"), F.col("shingle").alias("key"), "id", "component", "block",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    return one.unionByName(many)


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, row (its `row_key`), n_shingles, component_id."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    schema = "doc_id long, row long, n_shingles long, low long, high long, bands array<long>"
    sketch = materialized(texts.mapInArrow(_sketch(n_bands(percent)), schema), "sketch")
    able = sketch.where("n_shingles > 0 and doc_id is not null")
    # A node is a set.  It has a number of its own, as an id may stand on several texts.
    nodes = able.groupBy(*KEY).agg(F.min(F.struct("doc_id", "row", "bands")).alias("rep")).select(*KEY, "rep.*")
    nodes = materialized(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    placed = nodes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = materialized(placed.join(shared, "bucket").distinct(), "members")
    central = materialized(members.groupBy("id").agg(F.sum("m").alias("reach")), "central")
    wanted = nodes.join(central.select("id"), "id").select(*KEY, "id", "row")
    rows = IdSet(wanted.select("row"))
    mine = texts.select("row", "text")
    mine = mine if rows.find else rows.keep(mine, "row", True)  # probed inside the tasks: texts stay where they are
    found = mine.mapInArrow(_sets(rows.find), "low long, high long, n_shingles long, shingles array<long>")
    sets = materialized(found.dropDuplicates(KEY).join(wanted.drop("row"), KEY).select("id", "shingles"), "sets")
    hubs = (
        members.join(central, "id")
        .groupBy("bucket")
        .agg(F.max(F.struct("reach", (-F.col("id")).alias("minus"))).alias("hub"))
        .select("bucket", (-F.col("hub.minus")).alias("hub"))
    )
    star = members.join(hubs, "bucket").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    other = sets.select(F.col("id").alias("b"), F.col("shingles").alias("other"))
    both = F.size(F.array_intersect("shingles", "other"))
    links = (
        star.distinct()
        .join(sets.withColumnRenamed("id", "a"), "a")
        .join(other, "b")
        .where(100 * both >= percent * (F.size("shingles") + F.size("other") - both))
        .select("a", "b")
    )
    links = materialized(links, "links")
    labels = materialized(components(links), "labels")
    more = materialized(_unresolved(members, labels, sets, percent).distinct(), "links")
    if not more.isEmpty():
        labels = materialized(components(links.union(more)), "labels")

    # Components of nodes carry the smallest doc_id among them.
    linked = nodes.select(*KEY, "id", "doc_id").join(labels, "id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    classes = linked.join(least, "component").select(*KEY, "least")
    alone = nodes.select(*KEY, F.col("doc_id").alias("own"))
    classes = alone.join(classes, KEY, "left").select(*KEY, F.coalesce("least", "own").alias("component"))
    # Written, so that the last join shuffles anew and large groups of copies can be split there.
    classes = materialized(classes, "classes")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return sketch.join(classes, KEY, "left").select("doc_id", "row", "n_shingles", component.alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs`.

    Texts are linked when 100 * |A and B| >= percent * |A or B| over their sets of 5-word
    shingles; the component is the smallest id reachable.  A null text or one without words has
    the empty set and stands alone.  A row with a null id is never linked: its component is
    null and it is kept.  Ids must be integers; an id on several texts stands for each of them
    apart, and `kept` says that the row's own id names its component.  Texts of any length are
    taken whole; an empty table gives no rows; other columns are ignored.
    """
    judged = _judged(docs, id_col, text_col, percent).drop("row")
    return judged.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of `docs`, in all their columns, of which each near-duplicate class keeps its smallest id.

    Rows without words and rows with a null id stay.  All rows with the smallest id of their class
    stay, also where that id is repeated; an id on several texts is judged by each row's own text.
    An empty table stays empty; columns may have any names.
    """
    judged = _judged(docs, id_col, text_col, percent)
    return IdSet(judged.where("doc_id <> component_id").select("row")).keep(docs, row_key(id_col, text_col), False)

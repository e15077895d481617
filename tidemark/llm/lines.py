"""Line deduplication: documents probe arrays behind sharded minimal perfect hashes.

Distinct lines are counted once (combined per batch, then per task, then by one shuffle of
32-byte rows).  Those that repeat are dealt by hash into shards of bounded size; each shard is a
file with a perfect hash, 64-bit fingerprints, document counts and last holders.  Documents then
look their own lines up in the mapped shards: no line of a document is shuffled or joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.mphf import PerfectHash, pack, unpack
from tidemark.llm.ship import ship
from tidemark.llm.text import Lines
from tidemark.session import materialized

#: Keys of one shard, on average; about 30 bytes each.
SHARD_KEYS = 1 << 18
_NO_ID = -(1 << 63)


def _counts(min_points: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch.column("text"))
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(lines.points >= min_points)
            at = at[np.lexsort((lines.row[at], lines.high[at], lines.low[at]))]
            low, high, row = lines.low[at], lines.high[at], lines.row[at]
            if not len(at):
                continue
            fresh = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
            holder = fresh | np.r_[True, row[1:] != row[:-1]]
            first = np.flatnonzero(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(low[first].view(np.int64)),
                    pa.array(high[first].view(np.int64)),
                    pa.array(np.add.reduceat(holder.astype(np.int64), first)),
                    pa.array(np.maximum.reduceat(ids[row], first)),
                ],
                ["low", "high", "docs", "last"],
            )

    return counts


def _build(folder: str):
    def build(pdf):
        import pandas as pd

        low = pdf["low"].to_numpy().view(np.uint64)
        # 64 bits of one hash can clash in a large corpus; a clash goes to a second table.
        order = np.argsort(low, kind="stable")
        repeat = np.zeros(len(low), bool)
        repeat[order[1:]] = low[order[1:]] == low[order[:-1]]
        tables = []
        for part in (pdf[~repeat], pdf[repeat]):
            keys = part["low"].to_numpy().view(np.uint64)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("three lines share 64 bits of hash")
            hashed = PerfectHash.build(keys)
            at = np.argsort(hashed.index(keys))
            tables += [
                hashed.sizes,
                hashed.words,
                part["high"].to_numpy()[at],
                np.minimum(part["docs"].to_numpy()[at], (1 << 32) - 1).astype(np.uint32),
                part["last"].to_numpy()[at],
            ]
        shard = int(pdf["shard"].iloc[0])
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        with files.create(f"{folder}/{name}") as out:
            out.write(pack(tables))
        return pd.DataFrame({"shard": [shard], "name": [name], "keys": [len(low)]})

    return build


class Index:
    """Counts and last holders of repeated lines, over the files of all shards."""

    def __init__(self, folder: str, names: list[str | None]):
        self.folder, self.names = folder, names

    def probe(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (0: not a repeated line) and last holder of each key."""
        docs, last = np.zeros(len(low), np.int64), np.full(len(low), _NO_ID)
        if not self.names:
            return docs, last
        shard = low.view(np.int64) % len(self.names)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(len(self.names) + 1))
        for k, name in enumerate(self.names):
            at = order[bounds[k] : bounds[k + 1]]
            if name is None or not len(at):
                continue
            arrays = unpack(files.content(f"{self.folder}/{name}"))
            for sizes, words, prints, counts, holders in (arrays[:5], arrays[5:]):
                if not len(prints):
                    continue
                found = PerfectHash(sizes, words).index(low[at])
                true = (found >= 0) & (prints[found] == high[at].view(np.int64))
                docs[at[true]], last[at[true]] = counts[found[true]], holders[found[true]]
        return docs, last


def line_index(docs: DataFrame, min_points: int, min_docs: int) -> Index:
    """The index of all lines of (doc_id, text) that at least `min_docs` documents hold."""
    spark = docs.sparkSession
    repeated = materialized(
        docs.mapInArrow(_counts(min_points), "low long, high long, docs long, last long")
        .groupBy("low", "high")
        .agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
        .where(F.col("docs") >= min_docs),
        "lines",
    )
    n = repeated.count()
    shards = -(-n // SHARD_KEYS)
    if not shards:
        return Index("", [])
    folder = files.new_folder(spark, "line-index")
    built = materialized(
        repeated.withColumn("shard", F.pmod("low", F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(_build(folder), "shard int, name string, keys long"),
        "line-shards",
    )
    # One short row per shard of SHARD_KEYS lines.
    names: list[str | None] = [None] * shards
    for r in built.select("shard", "name").collect():
        names[r["shard"]] = r["name"]
    return Index(folder, names)


def _rewrite(index: Index, min_points: int):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch.column("text"))
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            able = np.flatnonzero(lines.points >= min_points)
            docs, last = index.probe(lines.low[able], lines.high[able])
            drop = np.zeros(len(lines.row), bool)
            drop[able] = (docs > 0) & (last != ids[lines.row[able]])
            dropped = np.add.reduceat(drop.astype(np.int64), lines.first) if len(lines.first) else np.zeros(0, np.int64)
            data = lines.data.tobytes()
            texts = []
            for row, (first, n) in enumerate(zip(lines.first.tolist(), lines.counts.tolist(), strict=True)):
                if dropped[row]:
                    kept = first + np.flatnonzero(~drop[first : first + n])
                    texts.append(b"\n".join(data[lines.start[k] : lines.end[k]] for k in kept))
                else:
                    texts.append(data[lines.offsets[row] : lines.offsets[row + 1]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lines.counts),
                    pa.array(dropped),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )

    return rewrite


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 20, min_docs: int = 3
) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: one row per row of `docs`.

    A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of at
    least `min_points` code points that at least `min_docs` rows hold lose their lines, except
    in the rows with the largest id that hold them.  A null or empty text is one empty line.  A
    null id counts as smaller than any other.  Rows with the same id are separate documents; if
    it is the largest, all of them keep the line.  Ids must be integers or read as such; texts of
    any length are split whole.  An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = line_index(own, min_points, min_docs)
    return own.mapInArrow(_rewrite(index, min_points), "doc_id long, n_lines long, n_dropped long, text string")

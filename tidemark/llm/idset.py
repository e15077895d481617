"""A set of ids as sorted files, probed where rows are read: a semi-join that moves no rows.

A set of more than PROBED files would have to be fetched again and again, so it is joined instead.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.names import free
from tidemark.llm.ship import ship
from tidemark.session import materialized

#: Ids of one file, on average: 8 MB, mapped into the workers that ask for them.
FILE_IDS = 1 << 20
#: Files up to which tasks probe the set (256 MB, what a worker keeps); a larger set is joined.
PROBED = 32


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row by id and text: rows with the same key are judged alike."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


@dataclass(frozen=True)
class Probe:
    """What tasks need of a set: its folder and the file of each shard."""

    folder: str
    shards: int
    names: dict[int, str]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Whether the set holds each id."""
        out = np.zeros(len(ids), bool)
        which = ids % self.shards
        for shard in np.unique(which).tolist():
            if shard in self.names:
                known = np.frombuffer(files.content(f"{self.folder}/{self.names[shard]}"), np.int64)
                at = np.flatnonzero(which == shard)
                found = np.minimum(np.searchsorted(known, ids[at]), len(known) - 1)
                out[at] = known[found] == ids[at]
        return out


class IdSet:
    def __init__(self, ids: DataFrame):
        """`ids`: one bigint column; repeats are allowed, nulls are in no set."""
        spark = ids.sparkSession
        ship(spark)
        self.ids = ids = materialized(ids.toDF("id").where("id is not null").distinct(), "id-set")
        shards = max(1, -(-ids.count() // FILE_IDS))
        #: For use inside tasks; none for a set that is joined.
        self.find = self._written(ids, shards) if shards <= PROBED else None

    @staticmethod
    def _written(ids: DataFrame, shards: int) -> Probe:
        folder = files.new_folder(ids.sparkSession, "ids")

        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            name = uuid.uuid4().hex
            with files.create(f"{folder}/{name}") as out:
                out.write(np.unique(pdf["id"].to_numpy(np.int64)).tobytes())
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "name": [name]})

        dealt = ids.withColumn("shard", F.pmod("id", F.lit(shards)).cast("int"))
        written = materialized(dealt.groupBy("shard").applyInPandas(write, "shard int, name string"), "id-files")
        return Probe(folder, shards, {r["shard"]: r["name"] for r in written.collect()})  # one short row per file

    def keep(self, df: DataFrame, key: Column | str, inside: bool) -> DataFrame:
        """The rows whose key is in the set, or those whose key is not; a null key is in no set."""
        key = F.col(key) if isinstance(key, str) else key
        if self.find is not None:
            return df.where(self.has(key) if inside else ~self.has(key))
        name = free(df, "key")
        known = self.ids.withColumnRenamed("id", name)
        return df.withColumn(name, key).join(known, name, "left_semi" if inside else "left_anti").drop(name)

    def has(self, column: Column | str) -> Column:
        """Whether a probed set holds the bigint column's value; false for null."""
        find = self.find

        @F.pandas_udf("boolean")
        def contains(ids: pd.Series) -> pd.Series:
            known = ids.notna().to_numpy()
            out = np.zeros(len(ids), bool)
            out[known] = find(ids[known].to_numpy(np.int64))
            return pd.Series(out)

        return contains(column)

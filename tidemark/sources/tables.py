"""Keyed tables kept as append-only Parquet versions, cut by the hash of the key.

Parquet has no upsert. Each batch appends the rows it changed under its own version folder
and readers take the newest version of every key, so a batch never rewrites the table. Below a
version lie folders per bucket of the key's hash. How often the hash is halved (``depth``) is
decided for each version by its rows, so buckets split as the table grows and hold about
``rows_per_bucket`` rows at any size; a batch reads only the buckets that may hold its keys.

A table may also be laid out by a part of the row that never changes for a key, such as the day
of a commit: whole parts are then dropped by removing folders (``drop_parts``).

From time to time ``compact`` writes one full base and ``vacuum`` removes what an earlier base
replaced. A re-run of a batch overwrites its own folder only, which makes writes idempotent per
batch id. A reader that made its plan before a ``vacuum`` may miss files that it removes; where
readers run beside the writer, ``vacuum`` can keep earlier bases for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tidemark.session import materialized

DEPTH, BUCKET, PART = "depth", "bucket", "part"
MAX_DEPTH = 20
# Beyond so many touched buckets a list of folders no longer pays; the join does the rest.
LISTED = 4096


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class VersionedTable:
    """``keys`` name the row; ``part`` (an expression over columns that never change for a key) its part."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, *,
        rows_per_bucket: int = 4_000_000, part: str | None = None,
    ) -> None:
        self.spark, self.path, self.keys, self.schema = spark, path, list(keys), schema
        self.rows_per_bucket, self.part = rows_per_bucket, part

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/kind={kind}/version={version}"

    def _hash(self) -> Column:
        # 20 bits: the bucket at a depth is as many of its highest bits.
        return F.pmod(F.xxhash64(*self.keys), F.lit(1 << MAX_DEPTH)).cast("int")

    def depth_for(self, rows: int) -> int:
        return min(MAX_DEPTH, max(0, -(-rows // self.rows_per_bucket) - 1).bit_length())

    def _versions(self) -> DataFrame | None:
        folders = [
            StructField("kind", StringType()), StructField("version", LongType()), StructField(PART, LongType()),
            StructField(DEPTH, IntegerType()), StructField(BUCKET, IntegerType()),
        ]
        full = StructType([*self.schema.fields, *folders])
        try:
            return self.spark.read.schema(full).parquet(self.path)
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _write(self, rows: DataFrame, kind: str, version: int, depth: int) -> None:
        # One file per bucket of a version, unless adaptive execution cuts a large one.
        part = F.lit(0).cast("bigint") if self.part is None else F.expr(self.part).cast("bigint")
        dealt = rows.select(*self.schema.names).withColumns(
            {PART: part, DEPTH: F.lit(depth), BUCKET: F.shiftright(self._hash(), MAX_DEPTH - depth)}
        )
        dealt = dealt.hint("rebalance", PART, BUCKET).sortWithinPartitions(PART, BUCKET, *self.keys)
        dealt.write.mode("overwrite").partitionBy(PART, DEPTH, BUCKET).parquet(self._folder(kind, version))

    def append(self, rows: DataFrame, version: int, *, at_most: int = 0) -> None:
        """Write the rows changed by one batch, sorted so that key lookups can skip row groups.

        ``at_most`` is a bound on the rows, by which the batch is cut into buckets.
        """
        self._write(rows, "delta", version, self.depth_for(at_most))

    def _base(self, rows: DataFrame) -> int | None:
        # Folder names only: this reads no column.
        return rows.filter(F.col("kind") == "base").agg(F.max("version")).first()[0]

    def _needed(self, version: int | None) -> DataFrame | None:
        """Rows of the newest base up to ``version`` and of all deltas after it."""
        rows = self._versions()
        if rows is None:
            return None
        if version is not None:
            rows = rows.filter(F.col("version") <= version)
        base = self._base(rows)
        if base is None:
            return rows.filter(F.col("kind") == "delta")
        newer = (F.col("kind") == "delta") & (F.col("version") > base)
        return rows.filter(((F.col("kind") == "base") & (F.col("version") == base)) | newer)

    def _touched(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Leave out the folders that hold none of the wanted keys."""
        depths = [r[0] for r in rows.select(DEPTH).distinct().collect()]  # at most MAX_DEPTH + 1, from folder names
        tests = []
        for depth in depths:
            if depth == 0:
                # One bucket holds every key: nothing to look up.
                tests.append((F.col(DEPTH) == 0) & (F.col(BUCKET) == 0))
                continue
            bucket = F.shiftright(self._hash(), MAX_DEPTH - depth)
            listed = [r[0] for r in wanted.select(bucket).distinct().limit(LISTED + 1).collect()]
            here = F.col(DEPTH) == depth
            tests.append(here if len(listed) > LISTED else here & F.col(BUCKET).isin(listed))
        return rows.filter(reduce(lambda a, b: a | b, tests)) if tests else rows

    def _empty(self, fields: Sequence[StructField]) -> DataFrame:
        # No createDataFrame: that starts Python workers to read nothing.
        return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)

    def as_of(
        self, version: int | None = None, *, only: DataFrame | None = None, columns: Sequence[str] | None = None
    ) -> DataFrame:
        """The newest row of each key among versions up to ``version``.

        ``only`` (a frame of keys) leaves the other buckets unread, and the rest of its own out
        of the aggregation. ``columns`` are those wanted; no other is read or shuffled but the keys.
        """
        wide = self.schema.names if columns is None else list(columns)
        rows = self._needed(version)
        if rows is None:
            return self._empty([self.schema[c] for c in wide])
        if only is not None:
            wanted = only.select(*self.keys)
            rows = self._touched(rows, wanted).join(wanted, self.keys, "left_semi")
        return self._newest(rows, wide)

    def changes(self, version: int) -> DataFrame:
        """Rows that the state as of ``version`` is made of, several of a key, with their ``version``."""
        rows = self._needed(version)
        fields = [*self.schema.fields, StructField("version", LongType())]
        return self._empty(fields) if rows is None else rows.select(*[f.name for f in fields])

    def delta(self, version: int) -> DataFrame:
        """The rows that ``append`` wrote for ``version``."""
        return self.spark.read.schema(self.schema).parquet(self._folder("delta", version)).select(*self.schema.names)

    def _newest(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        rest = [c for c in columns if c not in self.keys]
        if not rest:
            return rows.select(*self.keys).distinct().select(*columns)
        newest = F.max_by(F.struct(*rest), F.col("version")).alias("__row")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "__row.*").select(*columns)

    def compact(self, version: int, *, keep: Column | None = None) -> None:
        """Write the full state as of ``version`` as a base that later reads start from.

        ``keep`` leaves rows out for good, such as those that only say that a key is done.
        """
        needed = self._needed(version)
        if needed is None:
            return
        at_most = needed.count()  # from Parquet footers
        state = self.as_of(version)
        self._write(state if keep is None else state.filter(keep), "base", version, self.depth_for(at_most))

    def replace(self, rows: DataFrame, version: int, *, at_most: int | None = None) -> None:
        """Make ``rows`` (written elsewhere) the whole state as of ``version``."""
        self._write(rows, "base", version, self.depth_for(rows.count() if at_most is None else at_most))

    def parts(self, version: int) -> list[tuple[int, int]]:
        """(part, rows at most) of the state as of ``version``, in order, from folder names and footers."""
        rows = self._needed(version)
        found = [] if rows is None else rows.groupBy(PART).agg(F.count("*").alias("n")).collect()  # one row per part
        return sorted((r[PART], r["n"]) for r in found)

    def part_as_of(self, part: int, version: int) -> DataFrame:
        """The newest row of each key of one part; other parts' folders are not read."""
        rows = self._needed(version)
        names = self.schema.names
        return self._empty(self.schema.fields) if rows is None else self._newest(rows.filter(F.col(PART) == part), names)

    def _holders(self, part: int) -> list[tuple[str, int]]:
        rows = self._versions().filter(F.col(PART) == part)
        found = rows.select("kind", "version").distinct().collect()  # one row per version, from folder names
        return sorted(((r["kind"], r["version"]) for r in found), key=lambda h: (h[1], h[0] == "base"))

    def drop_parts(self, parts: Sequence[int]) -> None:
        """Remove whole parts, in all versions: folders only, no row is read or written."""
        for part in parts:
            for kind, version in self._holders(part):
                _remove(self.spark, f"{self._folder(kind, version)}/{PART}={part}")

    def rewrite_part(self, part: int, rows: DataFrame) -> None:
        """Make ``rows`` the whole state of one part; no other part is touched.

        They are written first to a folder aside and then moved below the newest version that
        holds the part, so a failure in between leaves rows twice at worst and none missing.
        """
        holders = self._holders(part)
        if not holders:
            return
        kept = materialized(rows, "part")
        depth = self.depth_for(kept.count())
        for kind, version in holders[:-1]:
            _remove(self.spark, f"{self._folder(kind, version)}/{PART}={part}")
        kind, version = holders[-1]
        dealt = kept.withColumns({DEPTH: F.lit(depth), BUCKET: F.shiftright(self._hash(), MAX_DEPTH - depth)})
        dealt = dealt.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        dealt.write.mode("overwrite").partitionBy(DEPTH, BUCKET).parquet(f"{self._folder(kind, version)}/{PART}={part}")

    def vacuum(self, version: int, *, bases: int = 1) -> None:
        """Remove versions that no read as of ``version`` or later needs; of bases the newest few stay."""
        rows = self._versions()
        if rows is None:
            return
        held = rows.select("kind", "version").distinct().collect()  # one row per version
        known = sorted(r["version"] for r in held if r["kind"] == "base" and r["version"] <= version)
        if len(known) < bases:
            return
        oldest = known[-bases]
        for r in held:
            if r["version"] < oldest or (r["version"] == oldest and r["kind"] == "delta"):
                _remove(self.spark, self._folder(r["kind"], r["version"]))


class BatchLedger:
    """Which batches are complete: written last, after all tables, with what was counted on the way."""

    def __init__(self, spark: SparkSession, path: str, counts: Sequence[str] = ()) -> None:
        self.spark, self.path, self.counts = spark, path, list(counts)

    def commit(self, batch_id: int, **counts: int) -> None:
        entry = [F.lit(batch_id).cast("bigint").alias("done")]
        entry += [F.lit(counts.get(c)).cast("bigint").alias(c) for c in self.counts]
        self.spark.range(1).select(*entry).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _entries(self) -> DataFrame | None:
        columns = "".join(f", `{c}` bigint" for c in self.counts)
        try:
            return self.spark.read.schema(f"done bigint{columns}, batch bigint").parquet(self.path)
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def entries(self) -> DataFrame:
        """(batch, counts): one row per complete batch."""
        columns = "batch bigint" + "".join(f", `{c}` bigint" for c in self.counts)
        found = self._entries()
        listed = self.spark.createDataFrame([], columns) if found is None else found.select("batch", *self.counts)
        try:
            folded = self.spark.read.schema(columns).parquet(f"{self.path}-folded").select("batch", *self.counts)
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return listed
            raise
        return listed.unionByName(folded).dropDuplicates(["batch"])

    def last(self) -> int:
        found = self._entries()
        newest = None if found is None else found.agg(F.max("done")).first()[0]
        return -1 if newest is None else newest

    def vacuum(self) -> None:
        """Keep the newest entry only, so that looking it up does not get slower; counts are folded into one file."""
        newest = self.last()
        found = self._entries()
        old = [] if found is None else [r["done"] for r in found.filter(F.col("done") < newest).select("done").collect()]
        if old and self.counts:
            rows = found.filter(F.col("done") < newest).select("batch", *self.counts)
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}-folded/upto={newest}")
        for done in old:
            _remove(self.spark, f"{self.path}/batch={done}")

"""Packing into windows by non-negative least squares over shallow length combinations.

Documents become ids with an end id.  Whole windows are cut off first and need no partner; what
is left of each document is shorter than a window.  A histogram of those lengths (at most
window - 1 numbers) is all the driver sees: combinations of two or three lengths that fill a
window exactly are enumerated, non-negative least squares finds how often each should be used,
and the rounded counts are dealt to the documents by their rank among those of equal length.
Residual pieces are packed greedily one after the other and cut where a window ends, so that
only the last window is padded.  Ranks and offsets are prefix sums in two levels; no group of
equal lengths is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.idset import IdSet
from tidemark.llm.pretokens import encoder, tokenizer_path
from tidemark.llm.ship import ship
from tidemark.llm.text import slices
from tidemark.session import materialized

ITERATIONS = 300


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), c = 0 for pairs: lengths that occur and sum to the window."""
    here = np.zeros(window + 1, bool)
    here[: len(present)] = present > 0
    a = np.arange(1, window // 2 + 1)
    a = a[here[a] & here[window - a]]
    out = [np.stack([a, window - a, np.zeros_like(a)], axis=1)]
    for a in np.flatnonzero(here[: window // 3 + 1]):
        b = np.arange(a, (window - a) // 2 + 1)
        b = b[here[b] & here[window - a - b]] if a else b[:0]
        out.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(out)


def solve(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """min |A x - histogram| over x >= 0, by accelerated projected gradients.

    Column p of A counts the lengths of combination p.  It starts from the pairs at their
    largest possible counts, so longer combinations are used for what pairs leave over.
    """
    want = histogram.astype(float).copy()
    want[0] = 0
    part = (rows > 0).astype(float)

    def times(x):
        return np.bincount(rows.ravel(), (x[:, None] * part).ravel(), len(want))

    def back(r):
        return (r[rows] * part).sum(axis=1)

    x = np.where(rows[:, 2] == 0, np.minimum(want[rows[:, 0]], want[rows[:, 1]]), 0.0)
    x[(rows[:, 0] == rows[:, 1]) & (rows[:, 2] == 0)] /= 2
    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(times(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / max(1.05 * np.linalg.norm(back(times(v))), 1.0)
    y, t = x.copy(), 1.0
    for _ in range(ITERATIONS):
        new = np.maximum(0.0, y - step * back(times(y) - want))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


@dataclass(frozen=True)
class Plan:
    """`length`, `first`, `end`: ranks of a length that go to `sequence` + rank at `offset`."""

    length: np.ndarray
    first: np.ndarray
    end: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    left: np.ndarray  # pieces of each length that no combination takes


def plan(histogram: np.ndarray, window: int) -> Plan:
    """Rounds the solution down to whole counts that the histogram can serve."""
    rows = combinations(window, histogram)
    counts = np.floor(solve(rows, histogram) + 0.5).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    left, taken = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    slots, sequence = [], 0
    for p in np.argsort(-counts, kind="stable"):
        if counts[p] <= 0:
            break
        parts = [int(x) for x in rows[p] if x]
        n = min(int(counts[p]), *(int(left[x]) // parts.count(x) for x in parts))
        if n <= 0:
            continue
        offset = 0
        for x in parts:
            slots.append((x, taken[x], taken[x] + n, sequence, offset))
            taken[x] += n
            left[x] -= n
            offset += x
        sequence += n
    columns = np.array(sorted(slots), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence, left)


def _id_bytes(raw: bytes, width: int) -> bytes:
    """Stored ids of `width` bytes as unsigned 32-bit numbers."""
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _encode(tokenizer: str, window: int, end_id: int, width: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer, "ids"), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            raws = [raw + end for raw in own.encode(batch.column("text").to_pylist())]
            step = 4 * window
            sums = [[zlib.crc32(raw[a : a + step]) for a in range(0, len(raw), step)] for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array([len(raw) // 4 for raw in raws], pa.int64()),
                    pa.array(sums, pa.list_(pa.int64())),
                    pa.array(raws if width == 4 else [np.frombuffer(r, "<u4").astype("<u2").tobytes() for r in raws], pa.binary()),
                ],
                ["row", "doc_id", "n", "sums", "ids"],
            )

    return encode


def _assign(plan: Plan):
    shift = 40

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (plan.length << shift) + plan.first
        for batch in batches:
            length, rank = batch.column("rest").to_numpy(), batch.column("rank").to_numpy()
            if len(starts):
                at = np.maximum(np.searchsorted(starts, (length << shift) + rank, "right") - 1, 0)
                hit = (plan.length[at] == length) & (plan.first[at] <= rank) & (rank < plan.end[at])
                sequence, offset = plan.sequence[at] + rank - plan.first[at], plan.offset[at]
            else:
                hit = np.zeros(len(length), bool)
                sequence = offset = np.zeros(len(length), np.int64)
            batch = batch.append_column("sequence", pa.array(sequence, mask=~hit))
            yield batch.append_column("offset", pa.array(offset, mask=~hit))

    return assign


def _cut_sums(width: int):
    def cut_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [
                zlib.crc32(_id_bytes(ids[width * a : width * (a + n)], width))
                for ids, a, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "start", "length")), strict=True)
            ]
            yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(sums, pa.int64()))

    return cut_sums


@dataclass(frozen=True)
class Packed:
    """`pieces`: row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokens` (row, doc_id, n, ids as little-endian unsigned numbers of `width` bytes) is what
    they cut.
    """

    pieces: DataFrame
    tokens: DataFrame
    window: int
    width: int

    def sequences(self) -> DataFrame:
        """sequence_id, ids (array), n, padded: the token sequences themselves, not padded.

        `padded` is the length that a loader pads to: the window, or n if it is a power of two.
        """

        width = self.width

        def join(pdf):
            import pandas as pd

            ids = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), f"<u{width}")
            return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids.astype(np.int64)]})

        # At most `window` pieces make a sequence; each brings only its own ids.
        piece = F.expr(f"substring(ids, int({width} * start + 1), int({width} * length))")
        whole = self.pieces.join(self.tokens.select("row", "ids"), "row")
        whole = whole.select("sequence_id", "offset", piece.alias("ids"))
        n = F.size("ids")
        return (
            whole.groupBy("sequence_id")
            .applyInPandas(join, "sequence_id long, ids array<long>")
            .select("*", n.alias("n"), F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(self.window).alias("padded"))
        )


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    window: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Packed:
    """Packs all rows of `docs`; every id lies in exactly one piece.

    A null text is empty and gives the end id alone.  Null and repeated ids are carried along,
    each row being a document; an empty table gives no pieces; other columns are ignored.
    """
    ship(docs.sparkSession)
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size() - 1, end_id)
    width = 2 if largest < 1 << 16 else 4
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = materialized(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).mapInArrow(_encode(tokenizer, window, end_id, width), f"row long, doc_id {kind}, n long, sums array<long>, ids binary"),
        "tokens",
    )
    narrow = tokens.select(
        "row",
        "doc_id",
        "n",
        "sums",
        F.shiftright("row", 33).alias("part"),  # the writing task, by the id's definition
        F.expr(f"n div {window}").alias("full"),
        (F.col("n") % window).alias("rest"),
    )
    # First level: per task and length, and per task; second: running sums over tasks.
    cells = narrow.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum("full").alias("f"))
    cells = materialized(cells, "cells")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy("part").agg(F.sum("f").alias("f"))
    parts = parts.select("part", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("full_base"))
    same = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("part", "rest", F.coalesce(F.sum("c").over(same), F.lit(0)).alias("rank_base")).join(parts, "part")

    histogram = np.zeros(window, np.int64)
    for r in cells.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["c"]
    histogram[0] = 0
    made = plan(histogram, window)
    residual = int((made.left * np.arange(window)).sum())
    residual_base = made.sequences
    full_base = residual_base + -(-residual // window)

    in_length = Window.partitionBy("part", "rest").orderBy("row")
    in_part = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = narrow.join(bases, ["part", "rest"]).select(
        "row",
        "doc_id",
        "n",
        "sums",
        "part",
        "full",
        "rest",
        (F.col("rank_base") + F.row_number().over(in_length) - 1).alias("rank"),
        (F.col("full_base") + F.coalesce(F.sum("full").over(in_part), F.lit(0)) + full_base).alias("full_sequence"),
    )
    schema = f"row long, doc_id {kind}, n long, sums array<long>, part long, full long, rest long, rank long, full_sequence long, sequence long, offset long"
    placed = materialized(ranked.mapInArrow(_assign(made), schema), "placed")

    columns = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    last = F.element_at("sums", -1)
    rest_start = F.col("full") * window
    full = placed.where("full > 0").select(
        "row", "doc_id", "n", "full_sequence", F.posexplode(F.slice("sums", F.lit(1), F.col("full").cast("int"))).alias("k", "ids_crc32")
    ).select(
        "row",
        "doc_id",
        (F.col("k").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        F.col("n").alias("doc_tokens"),
        (F.col("full_sequence") + F.col("k")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rests = placed.where("rest > 0")
    taken = rests.where("sequence is not null").select(
        "row", "doc_id", rest_start.alias("start"), F.col("rest").alias("length"), last.alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset",
    )

    alone = rests.where("sequence is null").select("row", "doc_id", "n", "part", "rest", rest_start.alias("start"), last.alias("sum"))
    alone = materialized(alone, "residual")
    ahead = alone.groupBy("part").agg(F.sum("rest").alias("f"))
    ahead = ahead.select("part", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("base"))
    lined = alone.join(ahead, "part").select(
        "*", (F.col("base") + F.coalesce(F.sum("rest").over(in_part), F.lit(0))).alias("at")
    )
    room = F.lit(window) - F.col("at") % window
    pieces = lined.select(
        "row", "doc_id", "n", "rest", "sum",
        F.explode(
            F.when(
                F.col("rest") > room,
                F.array(
                    F.struct(F.col("start"), room.alias("length"), F.col("at")),
                    F.struct((F.col("start") + room).alias("start"), (F.col("rest") - room).alias("length"), (F.col("at") + room).alias("at")),
                ),
            ).otherwise(F.array(F.struct(F.col("start"), F.col("rest").alias("length"), F.col("at"))))
        ).alias("piece"),
    ).select(
        "row", "doc_id", F.col("n").alias("doc_tokens"), "piece.start", "piece.length", "sum", (F.col("piece.length") == F.col("rest")).alias("whole"),
        (F.expr(f"piece.at div {window}") + residual_base).alias("sequence_id"), (F.col("piece.at") % window).alias("offset"),
    )
    pieces = materialized(pieces, "residual-pieces")
    whole = pieces.where("whole").withColumnRenamed("sum", "ids_crc32").select(*columns)
    cut_columns = [c for c in columns if c != "ids_crc32"]
    # One piece in `window` ids of the residual is cut; only those need their ids once more.
    cut = pieces.where("not whole").select(*cut_columns)
    cut = cut.join(IdSet(cut.select("row")).keep(tokens.select("row", "ids"), "row", True), "row")
    cut_schema = f"row long, doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    cut = cut.select(*cut_columns, "ids").mapInArrow(_cut_sums(width), cut_schema).select(*columns)
    return Packed(full.unionByName(taken).unionByName(whole).unionByName(cut), tokens, window, width)

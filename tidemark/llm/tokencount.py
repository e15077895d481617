"""Token counts by a map-side lookup in two tiers; no pre-token is ever shuffled.

First pass: every task summarises the pre-tokens of its rows in bounded counters
(Misra-Gries); the summaries, not the pre-tokens, are merged in two steps into the FREQUENT
most frequent pre-tokens with their numbers of tokens.  Second pass: that table, of bounded
size, is broadcast; what it lacks is encoded once per worker and kept in the worker's cache.
Results never depend on what the table holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.mphf import pack, unpack
from tidemark.llm.pretokens import encoder
from tidemark.llm.ship import ship
from tidemark.llm.text import slices

#: Pre-tokens in the broadcast table: below 4 MB, as longer ones than LONGEST stay out.
FREQUENT = 1 << 16
LONGEST = 32
#: Counters of one task's summary, and rows into which summaries are merged.
COUNTERS = 1 << 14
#: Characters of a text that a summary takes at once.
CHUNK = 1 << 20
_MERGED = 16


def _write(counts: Counter, n: int) -> bytes:
    top = [(k.encode(), v) for k, v in counts.most_common(n)]
    sizes = np.array([len(k) for k, _ in top], np.uint32)
    return pack([np.frombuffer(b"".join(k for k, _ in top), np.uint8), sizes, np.array([v for _, v in top], np.int64)])


def _read(blob: bytes) -> dict[str, int]:
    keys, sizes, values = unpack(blob)
    ends = np.cumsum(sizes).tolist()
    raw = keys.tobytes()
    return {raw[e - s : e].decode(): v for e, s, v in zip(ends, sizes.tolist(), values.tolist(), strict=True)}


def _prune(counts: Counter, n: int) -> Counter:
    """Misra-Gries: keeps n counters and takes the next one's count off each."""
    top = counts.most_common(n + 1)
    off = top[n][1] if len(top) > n else 0
    return Counter({k: v - off for k, v in top[:n] if v > off})


def _summarise(name: str):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = encoder(name, "lengths"), Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for part in own.pieces(text) or () if text and len(text) <= CHUNK else _in_parts(own, text):
                    counts[part] += 1
                if len(counts) > 16 * COUNTERS:
                    counts = _prune(counts, 4 * COUNTERS)
        counts = Counter({k: v for k, v in counts.items() if len(k) <= LONGEST})
        yield pa.RecordBatch.from_arrays([pa.array([_write(counts, COUNTERS)], pa.binary())], ["summary"])

    return summarise


def _in_parts(own, text: str | None) -> Iterator[str]:
    for at in range(0, len(text or ""), CHUNK):
        yield from own.pieces(text[at : at + CHUNK]) or ()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter()
    for batch in batches:
        for blob in batch.column("summary").to_pylist():
            counts.update(_read(blob))
            if len(counts) > 16 * FREQUENT:
                counts = _prune(counts, 4 * FREQUENT)
    yield pa.RecordBatch.from_arrays([pa.array([_write(counts, FREQUENT)], pa.binary())], ["summary"])


def frequent(texts: DataFrame, tokenizer: str) -> Counter:
    """The FREQUENT most frequent pre-tokens of the `text` column, with lower bounds of counts."""
    merged = texts.mapInArrow(_summarise(tokenizer), "summary binary").repartition(_MERGED).mapInArrow(_merge, "summary binary")
    counts = Counter()
    for row in merged.toLocalIterator():  # _MERGED rows of bounded size
        counts.update(_read(bytes(row["summary"])))
    return Counter(dict(counts.most_common(FREQUENT)))


def frequent_lengths(texts: DataFrame, tokenizer: str) -> bytes:
    """The compact table: the bytes of the frequent pre-tokens, their sizes, their token counts."""
    top = list(frequent(texts, tokenizer))
    lengths = list(encoder(tokenizer, "lengths").encode(top))
    return _write(Counter(dict(zip(top, lengths, strict=True))), len(top))


def _count(name: str, table):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, "lengths", table.value, _read)
        for batch in slices(batches):
            counts = pa.array(own.encode(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of `docs`.

    A null text counts as empty: 0 bytes, 0 tokens.  Null and repeated ids are carried along;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = spark.sparkContext.broadcast(frequent_lengths(docs.select(text.alias("text")), tokenizer))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = own.schema["doc_id"].dataType.simpleString()
    counted = own.mapInArrow(_count(tokenizer, table), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

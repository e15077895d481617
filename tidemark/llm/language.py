"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's RANKS most frequent n-grams of one to three characters,
over lower-cased letters with one mark between words.  A document's own list is compared to each
profile by out-of-place distance: the sum of rank differences, RANKS for an n-gram that the
profile lacks.  Profiles come from a bounded sample of SAMPLE documents per language; every
text is identified whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ship import ship
from tidemark.llm.text import slices
from tidemark.llm.toxicity import held_out
from tidemark.session import materialized

RANKS = 300
SAMPLE = 1500
SAMPLE_BYTES = 100_000
#: Groups of tasks among which the sample is chosen before the last choice.
GROUPS = 64
#: Characters whose n-grams are counted at once; longer texts are counted in parts.
PART = 1 << 20

_folds: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For every code point its lower-case letter, or 0 for what is no letter."""
    if not _folds:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folds.append(table)
    return _folds[0]


def _part_grams(line: np.ndarray, at: int, to: int) -> np.ndarray:
    """n-grams that end in line[at:to] as numbers, 21 bits a character; 0 is the mark."""
    one = line[at:to].astype(np.uint64)
    two = line[max(0, at - 1) : to].astype(np.uint64)
    two = (two[:-1] << np.uint64(21)) | two[1:]
    three = line[max(0, at - 2) : to].astype(np.uint64)
    three = (((three[:-2] << np.uint64(21)) | three[1:-1]) << np.uint64(21)) | three[2:]
    # A pair may look like a triple that begins with a mark: pairs carry a bit of their own.
    return np.concatenate([one[one > 0], two + np.uint64(1 << 63), three])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; empty if it has no letter."""
    folded = _fold()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    if not folded.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.r_[True, (folded[1:] > 0) | (folded[:-1] > 0)]
    line = np.r_[np.uint32(0), folded[keep], np.uint32(0)]
    line = line[np.r_[True, (line[1:] > 0) | (line[:-1] > 0)]]
    if len(line) <= PART:
        return np.unique(_part_grams(line, 0, len(line)), return_counts=True)
    counts: Counter = Counter()
    for at in range(0, len(line), PART):
        keys, n = np.unique(_part_grams(line, at, at + PART), return_counts=True)
        counts.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    keys = np.array(sorted(counts), np.uint64)
    return keys, np.array([counts[k] for k in keys.tolist()], np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The RANKS most frequent n-grams, ties in the order of their numbers."""
    if len(keys) > 4 * RANKS:
        least = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))[:RANKS]]


def _profile_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            keys, n = grams(text)
            counts.setdefault(lang, Counter()).update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        rows = [(lang, gram, n) for lang, c in counts.items() for gram, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            ["lang", "gram", "n"],
        )


def profiles(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, np.ndarray]:
    """Per language its n-grams by rank, from SAMPLE documents each that are not held out.

    The sample is chosen by a hash of id and text.  Rows without id, language or text, and texts of
    more than SAMPLE_BYTES, teach nothing.
    """
    able = docs.select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    able = able.where("k is not null and lang is not null").where(F.octet_length("text") <= SAMPLE_BYTES).where(~held_out("k"))
    able = able.select("lang", "text", F.xxhash64("k", "text").alias("key"))
    # Repeated rows count once.  The smallest hashes are chosen per task, then per group of tasks,
    # then per language, so that no task sorts all rows of one language.
    chosen = able.select("lang", "key", F.spark_partition_id().alias("task")).groupBy("lang", "key").agg(F.min("task").alias("task"))
    for part in ([F.col("task")], [F.col("task") % GROUPS], []):
        order = Window.partitionBy("lang", *part).orderBy("key")
        chosen = chosen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).drop("r")
    chosen = F.broadcast(materialized(chosen.drop("task"), "sample"))  # SAMPLE rows per language
    counted = (
        able.join(chosen, ["lang", "key"])
        .groupBy("lang", "key")
        .agg(F.first("text").alias("text"))
        .select("lang", "text")
        .mapInArrow(_profile_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    # Ties by the n-gram's unsigned number: signed order with the sign bit turned.
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram").bitwiseXOR(F.lit(-(1 << 63))))
    top = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= RANKS)
    out: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):  # RANKS rows per language
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in out.items()}


class Identifier:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.known, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 for the profile itself, 0 for nothing in common; "und": no letter."""
        own = ranked(*grams(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = np.where(self.known[at] == own, at, len(self.known))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, RANKS, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (RANKS * len(own))


def _identify(shared):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(shared.value)
        for batch in slices(batches):
            found = [own(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return identify


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of `docs`.

    The prediction depends on the text alone; `und` if it is null or has no letter, or if no
    language was learnt.  Ties between languages go to the first by name.  Rows with a null id
    are identified and count as not held out; an empty table gives no rows; other columns are
    ignored.
    """
    ship(docs.sparkSession)
    # RANKS numbers per language.
    shared = docs.sparkSession.sparkContext.broadcast(profiles(docs, id_col, text_col, lang_col))
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = named.mapInArrow(_identify(shared), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")

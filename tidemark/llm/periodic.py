"""Periodic runs of words, by recursive frequency splitting and a scan of lags.

A run of length >= EXPONENT * period holds each of its words at least EXPONENT times.  So a word
that occurs less often within a segment lies in no run there: it splits the segment.  Pieces are
counted again until none splits (a word of a run is never removed: all of the run lies in one
segment).  Surviving segments are scanned lag by lag: at lag q the words are cut in blocks of q,
and a run holds three equal blocks in a row.  Blocks are compared by hash, found stretches word by
word, and grown to both sides.  That is n / q blocks at lag q, and n log n for all lags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ship import ship
from tidemark.llm.text import constants, mix, slices

#: A run has at least SHORTEST words and EXPONENT periods.
SHORTEST, EXPONENT = 6, 4
#: Rounds of splitting; a segment that is not stable by then is scanned as it is, with the same result.
ROUNDS = 64
#: Bytes of a text that are cut into words at once.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def numbered(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the distinct words; white space is [\\x20\\x09-\\x0D]."""
    table: dict[bytes, int] = {}
    parts, at, carry = [], 0, b""
    while at < len(raw) or carry:
        size = max(PART, len(carry))
        chunk = carry + raw[at : at + size]
        at += size
        words, carry = chunk.split(), b""  # bytes.split() cuts at exactly this white space
        if at < len(raw) and words and not chunk[-1:].isspace():
            carry = words.pop()  # may go on
        parts.append(np.array([table.setdefault(w, len(table)) for w in words], np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(table)


def surviving(ids: np.ndarray, n_words: int) -> list[tuple[int, int]]:
    """Segments that splitting at rare words leaves; each word in them is frequent there."""
    if len(ids) < SHORTEST:
        return []
    kept = np.flatnonzero(np.bincount(ids, minlength=n_words)[ids] >= EXPONENT)
    open_ = _segments(kept, np.zeros(len(kept), np.int64))
    done: list[tuple[int, int]] = []
    if len(kept) == len(ids):
        return [(0, len(ids))]
    for _ in range(ROUNDS):
        if not len(open_):
            return sorted(done)
        starts, sizes = open_[:, 0], open_[:, 1] - open_[:, 0]
        owner = np.repeat(np.arange(len(open_)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        _, where, count = np.unique(owner * n_words + ids[at], return_inverse=True, return_counts=True)
        often = count[where] >= EXPONENT
        split = np.zeros(len(open_), bool)
        split[owner[~often]] = True
        done += [tuple(s) for s in open_[~split].tolist()]
        again = often & split[owner]
        open_ = _segments(at[again], owner[again])
    return sorted(done + [tuple(s) for s in open_.tolist()])


def _segments(at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Stretches of neighbouring positions of one owner that are long enough for a run."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(owner) != 0)])
    out = np.column_stack([at[first], at[np.r_[first[1:] - 1, len(at) - 1]] + 1])
    return out[out[:, 1] - out[:, 0] >= SHORTEST]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[first, last + 1) of the stretches of at least `least` true entries."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, smallest period) of one segment, by start and period."""
    n = len(x)
    hashes = mix(x.astype(np.uint64) + constants(41, 1)[0])
    sums = np.r_[np.uint64(0), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)]
    down = _powers(_INVERSE, n)
    # Of the runs found so far that hold a position, the one that reaches furthest.
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    found = []
    for q in range(1, n // EXPONENT + 1):
        at = np.arange(0, n - q + 1, q)
        block = (sums[at + q] - sums[at]) * down[at]
        same = block[1:] == block[:-1]
        if not (same[1:] & same[:-1]).any():
            continue
        for a, b in _stretches(same, 2):
            begin, end = a * q, (b + 1) * q
            # A multiple of a smaller period: the whole stretch lies in that run.
            if reach[begin] >= end and q % period[begin] == 0:
                continue
            if not (x[begin : end - q] == x[begin + q : end]).all():  # equal hashes of different words
                for a2, b2 in _stretches(x[begin : end - q] == x[begin + q : end], 2 * q):
                    found += _grown(x, begin + a2, begin + b2 + q, q, reach, period)
                continue
            found += _grown(x, begin, end, q, reach, period)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _grown(x: np.ndarray, begin: int, end: int, q: int, reach: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """The maximal run around a stretch of period q, if it is long enough and new."""
    n = len(x)
    while begin > 0:
        low = max(0, begin - q)
        other = np.flatnonzero(x[low:begin] != x[low + q : begin + q])
        if len(other):
            begin = low + int(other[-1]) + 1
            break
        begin = low
    while end < n:
        high = min(n, end + q)
        other = np.flatnonzero(x[end:high] != x[end - q : high - q])
        if len(other):
            end += int(other[0])
            break
        end = high
    if end - begin < max(SHORTEST, EXPONENT * q) or reach[begin] >= end and q % period[begin] == 0:
        return []
    further = reach[begin:end] < end
    period[begin:end][further] = q
    reach[begin:end][further] = end
    return [(begin, end - begin, q)]


def text_runs(ids: np.ndarray, n_words: int) -> list[tuple[int, int, int]]:
    """All runs of a text's numbered words, by start and period."""
    out = []
    for a, b in surviving(ids, n_words):
        out += [(a + start, length, q) for start, length, q in runs(ids[a:b])]
    return out


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: of each run the first period, and all that lies in no run."""
    keep = np.ones(n, bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return keep


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, found, left = [], [], []
        for text in batch.column("text"):
            ids, words = numbered(text.as_buffer().to_pybytes() if text.is_valid else b"")
            own = text_runs(ids, len(words))
            kept = ids[kept_words(len(ids), own)] if own else ids
            sizes.append(len(ids))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            left.append(b" ".join(map(words.__getitem__, kept.tolist())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed: one row per row of `docs`.

    A run is a stretch of words with smallest period q and at least max(SHORTEST, EXPONENT * q)
    words that no neighbour extends; runs are ordered by start, then period, and may overlap.
    `collapsed` has the words left when each run keeps its first period, joined by one blank.  A
    null or empty text has no words, no runs and an empty `collapsed`.  Null and repeated ids are
    carried along, repeated rows judged alike; texts of any length are taken whole; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return named.mapInArrow(_find, schema)

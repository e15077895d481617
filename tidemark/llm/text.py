"""Vectorised text kernels: the bytes of a whole Arrow batch, hashed with numpy.

All hashes are 64-bit and depend only on the bytes, so any task on any machine gives the same
number.  A word's polynomial is a difference of two prefix sums (modulo 2^64), scrambled
afterwards.  Buffers are worked through in segments, so that memory does not follow the length
of a batch; a segment always ends at a break (white space, line end or text end).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

# [\x20\x09-\x0D] is white space, A-Z is lower-cased; both are fixed by the operators' contract.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
BLANKS = b" \t\n\x0b\x0c\r"


#: Rows of an Arrow batch that are worked on at once.
ROWS = 256


_libc: list = []


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system; workers live on and are used again."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL(None).malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    _libc[0](0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of ROWS rows, without copying: what is derived from them stays small.

    What Arrow holds free goes back to the system after each batch, as workers are used again.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
        del batch
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64((seed * 0xD1B54A32D192ED03) % (1 << 64))) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SEGMENT:  # one word longer than a segment: not worth keeping
        return _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    if not _tables:
        _tables["up"], _tables["down"] = _powers(_BASE, SEGMENT + 1), _powers(_INVERSE, SEGMENT + 1)
    return _tables["up"], _tables["down"]


class Points:
    """Code points before any byte of a buffer, at the cost of one look at each byte."""

    STEP = 1 << 12

    def __init__(self, data: np.ndarray):
        self.first = (data & 0xC0) != 0x80
        at = np.arange(0, len(data), self.STEP)
        self.upto = np.r_[0, np.cumsum(np.add.reduceat(self.first, at, dtype=np.int64))] if len(data) else np.zeros(1, np.int64)

    def before(self, at: int) -> int:
        """How many code points begin before byte `at`."""
        block = at // self.STEP
        return int(self.upto[block]) + int(np.count_nonzero(self.first[block * self.STEP : at]))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span of one segment."""
    up, down = _power_table(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    polynomial = (sums[ends] - sums[starts]) * down[starts]
    return mix(polynomial + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int]]:
    """Segments of about SEGMENT bytes that end at a row's end or behind a byte of `stop`."""
    start, total = 0, int(offsets[-1])
    while start < total:
        end = min(start + SEGMENT, total)
        if end < total:
            row_end = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if row_end > start:
                end = row_end
            else:
                row_end = int(offsets[np.searchsorted(offsets, start, "right")])
                while end < row_end:
                    found = np.flatnonzero(stop[data[end : min(end + SEGMENT, row_end)]])
                    if len(found):
                        end += int(found[0]) + 1
                        break
                    end = min(end + SEGMENT, row_end)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch (lower-cased), and at which word each row begins."""
    hashes, positions = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, end in _cuts(data, offsets, SPACE):
        piece = LOWER[data[start:end]]
        inner = offsets[np.searchsorted(offsets, start, "right") : np.searchsorted(offsets, end, "left")] - start
        solid = ~SPACE[piece]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[inner] = solid[inner]
        finishes = solid.copy()
        finishes[:-1] &= ~solid[1:]
        finishes[inner - 1] = solid[inner - 1]
        at = np.flatnonzero(begins)
        hashes.append(span_hashes(piece, at, np.flatnonzero(finishes) + 1))
        positions.append(at + start)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(positions), offsets, "left")


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per row: its distinct word shingles as sorted 64-bit hashes.

    A text of fewer words is one shingle; one without words has the empty set.
    """
    data, offsets = batch_bytes(column)
    word, first = words(data, offsets)
    weight = constants(5, width)
    n = len(word)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        full += mix(word[j : n - width + 1 + j] + weight[j]) * weight[j] if len(full) else np.uint64(0)
    full = mix(full)
    for row in range(len(offsets) - 1):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            short = constants(100 + b - a, b - a)
            yield mix(np.sum(mix(word[a:b] + short) * short, keepdims=True, dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Lines:
    """The lines of a batch of texts, split at \\n, with the key of each.

    `row` is the row of each line, `start` and `end` its bytes; `points` counts the code points
    of the key (stripped, A-Z lower-cased), `low` and `high` are 128 bits of hash of the key.
    A null or empty text has one empty line.
    """

    def __init__(self, column: pa.Array):
        self.data, self.offsets = batch_bytes(column)
        n_rows = len(self.offsets) - 1
        breaks = np.flatnonzero(self.data == 10)
        per_row = np.searchsorted(breaks, self.offsets, "left")
        counts = np.diff(per_row) + 1
        self.row = np.repeat(np.arange(n_rows), counts)
        last = np.cumsum(counts) - 1
        self.first = last - counts + 1
        self.start = np.empty(len(self.row), np.int64)
        self.end = np.empty(len(self.row), np.int64)
        inner = np.ones(len(self.row), bool)
        inner[last] = False
        self.end[inner] = breaks
        self.end[last] = self.offsets[1:]
        inner = np.ones(len(self.row), bool)
        inner[self.first] = False
        self.start[inner] = breaks + 1
        self.start[self.first] = self.offsets[:-1]
        self.counts = counts
        self.points = np.zeros(len(self.row), np.int64)
        self.low = np.zeros(len(self.row), np.uint64)
        self.high = np.zeros(len(self.row), np.uint64)
        stop = np.zeros(256, bool)
        stop[10] = True
        for a, b in _cuts(self.data, self.offsets, stop):
            self._keys(a, b)

    def _keys(self, a: int, b: int) -> None:
        i, j = np.searchsorted(self.start, [a, b], "left")
        # Lines of empty rows begin where the next row does; they have no bytes and no key.
        piece = LOWER[self.data[a:b]]
        start, end = self.start[i:j] - a, self.end[i:j] - a
        solid = np.flatnonzero(~SPACE[piece])
        first = np.searchsorted(solid, start, "left")
        after = np.searchsorted(solid, end, "left")
        some = after > first
        if not some.any():
            return
        start = solid[first[some]]
        end = solid[after[some] - 1] + 1
        points = np.zeros(len(piece) + 1, np.int64)
        np.cumsum((piece & 0xC0) != 0x80, out=points[1:])
        at = np.arange(i, j)[some]
        self.points[at] = points[end] - points[start]
        self.low[at] = span_hashes(piece, start, end)
        # A second, independent polynomial: the bytes are substituted first.
        self.high[at] = span_hashes(SUBSTITUTE[piece], start, end)


SUBSTITUTE = np.argsort(constants(77, 256)).astype(np.uint8)

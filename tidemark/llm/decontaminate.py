"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are normalised first: lower-cased, every run of other characters than letters and digits
is one space.  An item of n characters occurs in a document if some stretch of it is at most
budget(n) edits away.  By the q-gram lemma such a stretch shares at least n - q + 1 - q * edits
of the item's q-grams, all on diagonals that differ by at most the number of edits.  So q-grams
are looked up in a sorted index of the items, hits are counted per item in overlapping bands of
diagonals, and only bands that reach the bound are aligned, within the band.  Items of fewer than
Q characters have no q-gram: they are looked up verbatim, from word border to word border.

The index of the items is shipped in blocks of BLOCK_CHARS characters on average, so its size
per task is bounded whatever the number of items.  Documents are never moved; of several blocks
only the findings are brought together.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text
from tidemark.llm.idset import IdSet, row_key
from tidemark.llm.ship import ship
from tidemark.session import materialized

Q = 10
#: Edits allowed, as a share of an item's characters.
EDIT_SHARE = 0.08
BLOCK_CHARS = 4_000_000
#: Bytes of documents whose q-gram hits are held at once.
PART = 1 << 20

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
# Six bits a byte: 0 is a space; bytes beyond ASCII share 27 numbers, which alignment tells apart.
_CODE = np.zeros(256, np.uint64)
_CODE[97:123] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[128:] = 37 + np.arange(128) % 27


def normalised(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and the position in `raw` of each."""
    data = np.frombuffer(raw, np.uint8)
    if not raw.isascii():
        data = np.frombuffer(_fold(raw), np.uint8)
    data = text.LOWER[data]
    keep = _KEEP[data]
    at = np.flatnonzero(keep | np.r_[False, keep[:-1]]) if len(data) else np.zeros(0, np.int64)
    out = np.where(keep[at], data[at], np.uint8(32))
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


_pairs: dict[str, str] = {}


def _fold(raw: bytes) -> bytes:
    """Lower case, and spaces for what is no letter, beyond ASCII; keeps the number of bytes."""
    found = raw.decode("utf-8", "replace")
    for c in set(found):
        if c not in _pairs:
            low = c.lower() if unicodedata.category(c)[0] in "LMN" else " " * len(c.encode())
            _pairs[c] = c if c.isascii() or len(low.encode()) != len(c.encode()) else low
    return found.translate({ord(c): _pairs[c] for c in set(found)}).encode()


def qgrams(data: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each byte but the last Q - 1, as a number of 60 bits."""
    one = _CODE[data]
    if len(one) < Q:
        return np.zeros(0, np.uint64)
    two = (one[:-1] << np.uint64(6)) | one[1:]
    four = (two[:-2] << np.uint64(12)) | two[2:]
    eight = (four[:-4] << np.uint64(24)) | four[4:]
    return (eight[:-2] << np.uint64(12)) | two[8:]


def budget(n: int) -> int:
    """Edits allowed for n characters: so few that the lemma's bound stays positive."""
    return max(0, min(int(n * EDIT_SHARE), (n - Q) // Q))


class Items:
    """The q-gram index of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        made = [(i, normalised((t or "").encode())[0]) for i, t in items]
        self.short: dict[int, dict[bytes, list[int]]] = {}  # by length
        for i, d in made:
            if 0 < len(d) < Q:
                self.short.setdefault(len(d), {}).setdefault(d.tobytes(), []).append(i)
        made = [(i, d) for i, d in made if len(d) >= Q]
        self.ids = np.array([i for i, _ in made], np.int64)
        self.data = [d for _, d in made]
        self.edits = np.array([budget(len(d)) for d in self.data], np.int64)
        sizes = np.array([len(d) for d in self.data], np.int64)
        self.least = sizes - Q + 1 - Q * self.edits
        self.longest = int(sizes.max(initial=0))
        codes = [qgrams(d) for d in self.data]
        flat = np.concatenate([*codes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order].astype(np.int32)
        self.pos = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)])[order].astype(np.int32)
        self.codes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        # Most q-grams of a document end at this bitmap, of which an eighth at most is set.
        self.bits = max(16, (8 * len(self.codes)).bit_length())
        self.near = np.zeros(1 << self.bits, bool)
        self.near[self._spot(self.codes)] = True

    def _spot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def verbatim(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, 0) of the short items, between word borders."""
        out: list[tuple[int, int, int, int]] = []
        if not self.short or not len(data):
            return out
        starts = np.flatnonzero((data != 32) & np.r_[True, data[:-1] == 32])
        for size, known in self.short.items():
            at = starts[starts + size <= len(data)]
            at = at[(at + size == len(data)) | (data[np.minimum(at + size, len(data) - 1)] == 32)]
            codes, wanted = np.zeros(len(at), np.uint64), []
            for k in range(size):
                codes = (codes << np.uint64(6)) | _CODE[data[at + k]]
            for item in known:
                code = 0
                for c in item:
                    code = code << 6 | int(_CODE[c])
                wanted.append(code)
            for start in at[np.isin(codes, np.array(wanted, np.uint64))].tolist():
                out += [(i, start, start + size, 0) for i in known.get(data[start : start + size].tobytes(), ())]
        return out

    def candidates(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low, high): bands of diagonals [low, high) that reach the lemma's bound."""
        found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        codes = qgrams(data)
        for a in range(0, len(codes), PART):
            piece = codes[a : a + PART]
            at = np.flatnonzero(self.near[self._spot(piece)])
            k = np.minimum(np.searchsorted(self.codes, piece[at]), len(self.codes) - 1)
            true = self.codes[k] == piece[at]
            at, k = at[true], k[true]
            if not len(at):
                continue
            n = self.count[k]
            entry = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            item = self.item[entry].astype(np.int64)
            # Diagonal of the hit; shifted by the longest item, so that it is never negative.
            diagonal = np.repeat(at, n) + a - self.pos[entry] + self.longest
            band = diagonal // (self.edits[item] + 1) + 1
            keys, hits = np.unique(np.concatenate([(item << 40) | band, (item << 40) | (band - 1)]), return_counts=True)
            found.append(keys)
            counts.append(hits)
        keys, at = np.unique(np.concatenate(found), return_inverse=True)
        hits = np.bincount(at, np.concatenate(counts), len(keys))
        item, band = keys >> 40, (keys & ((1 << 40) - 1)) - 1
        strong = hits >= self.least[item]
        step = self.edits[item] + 1
        low, high = band * step - self.longest, (band + 2) * step - self.longest
        return list(zip(item[strong].tolist(), low[strong].tolist(), high[strong].tolist(), strict=True))

    def matches(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of verified stretches of the normalised text.

        Per item the best stretch of each group of overlapping candidates.
        """
        out: list[tuple[int, int, int, int]] = []
        for item, low, high in self.candidates(data):
            found = align(self.data[item], data, low, high, int(self.edits[item]))
            if found is None:
                continue
            start, end, edits = found
            if out and out[-1][0] == item and out[-1][1] < end and start < out[-1][2]:
                if edits < out[-1][3]:
                    out[-1] = (item, start, end, edits)
            else:
                out.append((item, start, end, edits))
        return [(int(self.ids[item]), *rest) for item, *rest in out] + self.verbatim(data)


def align(item: np.ndarray, data: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """The best stretch of `data` on diagonals [low - edits, high + edits) within the budget."""
    first, last = low - edits, high + edits
    whole = data[max(0, first) : max(0, last + len(item))].tobytes()
    exact = whole.find(item.tobytes())
    if exact >= 0:
        return max(0, first) + exact, max(0, first) + exact + len(item), 0
    width = last - first
    far = edits + 1
    # Cell d of row i: the first i characters aligned, ending before data[first + d + i].
    ends = first + np.arange(width)
    cost = np.where((ends >= 0) & (ends <= len(data)), 0, far)
    begin = ends.copy()
    step = np.arange(width)
    for i in range(1, len(item) + 1):
        at = ends + i - 1  # the character taken by a match or a change
        inside = (at >= 0) & (at < len(data))
        differs = np.where(inside, data[np.clip(at, 0, max(0, len(data) - 1))] != item[i - 1], True) if len(data) else np.ones(width, bool)
        new = np.where(inside, cost + differs, far)
        start = begin.copy()
        up = np.r_[cost[1:], far] + 1  # a character of the item is missing
        better = up < new
        new = np.where(better, up, new)
        start = np.where(better, np.r_[begin[1:], 0], start)
        # Characters in excess: running minimum along the row.
        base = new - step
        least = np.minimum.accumulate(base)
        source = np.maximum.accumulate(np.where(base == least, step, 0))
        longer = least + step < new
        new = np.where(longer, least + step, new)
        start = np.where(longer, start[source], start)
        cost, begin = np.minimum(new, far), start
        if cost.min() > edits:
            return None
    best = int(cost.argmin())
    return int(begin[best]), int(ends[best] + len(item)), int(cost[best])


_built: dict[str, Items] = {}


def _index(shared) -> Items:
    """The worker's own index of a block, kept for the next tasks."""
    key, items = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = Items(items)
    return _built[key]


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[object, bool]]:
    """Broadcast blocks of items, and whether more follow."""
    known = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    known = known.where("id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else known
        items = sorted((r["id"], r["text"]) for r in mine.collect())  # BLOCK_CHARS on average
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items)), block + 1 < blocks


_LISTS = ["items", "starts", "ends", "edits"]
_KINDS = ", ".join(f"{c} array<bigint>" for c in _LISTS)


def _scan(shared, only_found: bool):
    """The key column `row` with the findings of one block; `only_found`: of rows that have any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in text.slices(batches):
            rows, lists = [], {c: [] for c in _LISTS}
            for row, value in enumerate(batch.column("text").to_pylist()):
                raw = (value or "").encode()
                data, at = normalised(raw)
                found = index.matches(data)
                if only_found and not found:
                    continue
                rows.append(row)
                bytes_ = np.frombuffer(raw, np.uint8)
                points = text.Points(bytes_) if found else None
                spans = []
                for _, start, end, _ in found:
                    a, b = int(at[start]), int(at[end - 1]) + 1
                    # A stretch that begins inside a character has all of it.
                    spans.append((points.before(a) - ((raw[a] & 0xC0) == 0x80), points.before(b)))
                lists["items"].append([f[0] for f in found])
                lists["starts"].append([s for s, _ in spans])
                lists["ends"].append([e for _, e in spans])
                lists["edits"].append([f[3] for f in found])
            columns = [batch.column("row").take(pa.array(rows, pa.int64()))]
            columns += [pa.array(lists[c], pa.list_(pa.int64())) for c in _LISTS]
            yield pa.RecordBatch.from_arrays(columns, ["row", *_LISTS])

    return scan


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, contaminated, items, starts, ends, edits: one row per row of `docs`.

    The lists name the benchmark items found, the stretch of each in characters of the text,
    and its edits.  An item counts when the whole of it occurs within its budget of edits; items
    of fewer than Q characters when normalised occur verbatim, as whole words.  Items with a null
    id or text, or without any letter or digit, are never found.  Null and empty texts contain
    nothing; null and repeated ids are carried along; repeated items are reported each; texts of
    any length are read whole; an empty table gives no rows and an empty benchmark finds nothing.
    Other columns are ignored.
    """
    ship(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    result = ["doc_id", (F.size("items") > 0).alias("contaminated"), *_LISTS]
    findings = None
    for shared, more in _blocks(benchmark, item_col, item_text_col):
        if findings is None and not more:  # one block: findings come with their rows
            kind = named.schema["doc_id"].dataType.simpleString()
            own = named.select(F.col("doc_id").alias("row"), "text").mapInArrow(_scan(shared, False), f"row {kind}, {_KINDS}")
            return own.withColumnRenamed("row", "doc_id").select(*result)
        found = named.select(F.col("key").alias("row"), "text").mapInArrow(_scan(shared, True), f"row long, {_KINDS}")
        # Rows alike in id and text have the same findings: one of them speaks for all.
        found = materialized(found.dropDuplicates(["row"]), "findings")
        findings = found if findings is None else findings.unionByName(found)
        shared.unpersist()
    whole = F.collect_list(F.struct(*_LISTS)).alias("parts")  # one entry per block that was found in the text
    merged = findings.groupBy("row").agg(whole).select("row", *[F.flatten(F.col(f"parts.{c}")).alias(c) for c in _LISTS])
    none = F.array().cast("array<bigint>")
    joined = named.select("doc_id", "key").join(merged, F.col("key") == F.col("row"), "left")
    return joined.select("doc_id", *[F.coalesce(c, none).alias(c) for c in _LISTS]).select(*result)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, in all their columns, in which no benchmark item occurs.

    Null and empty texts stay; rows with a null id are judged by their text like all others;
    repeated rows go or stay together; texts of any length are read whole; an empty table stays
    empty and an empty benchmark drops nothing; columns may have any names.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = IdSet(contaminations(keyed, benchmark).where("contaminated").select("doc_id"))
    return found.keep(docs, row_key(id_col, text_col), False)

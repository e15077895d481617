"""Byte-level BPE, to ids and back, from a file of ranks.

1. Pre-tokens without a pattern engine.  Every code point has a class (an array over all code
   points).  A small automaton reads classes; each class is a function from states to states, and
   such functions compose associatively.  Their closure under composition is a small finite set,
   so a composition is one table lookup, and the states before all characters of a text come from
   a blocked prefix scan in numpy.  State and class then say where pre-tokens begin.
2. Each distinct pre-token is merged once per worker (lowest rank first, leftmost first) and kept
   in a bounded cache.
3. `starts` keeps the byte at which every token begins, so that a range of tokens is a range of
   bytes; decoding copies all tokens of a batch to their places at once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretokens import tokenizer_path
from tidemark.llm.ship import ship
from tidemark.llm.text import slices

#: Characters that are scanned at once; longer texts are scanned in parts.
SEGMENT = 1 << 19
#: Pre-tokens one worker keeps, and the longest of them in characters.
KEPT, LONGEST = 200_000, 48
#: Pre-tokens of up to so many bytes are merged side by side, so many at once; longer ones by a heap.
SHORT, BESIDE = 64, 1 << 14
_NONE = 1 << 40

# What the cutting pattern calls white space, and the endings after an apostrophe.
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT = "stmd"  # after "r" and "v" an "e", after "l" an "l"

# Classes of characters.  END stands between texts.
LETTER, DIGIT, OTHER, BLANK, WHITE, QUOTE, S, RV, ELL, E, END = range(11)
# States: what was read last.  FRESH: the next character begins a pre-token; *2: white space of
# two or more characters; TICK: an apostrophe that began a pre-token; TICK_*: a letter after it.
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHER, BLANK1, BLANK2, WHITE1, WHITE2, TICK, TICK_RV, TICK_L = range(11)
#: A pre-token begins at this character, or at the one before it.
HERE, BEFORE = 1, 2


def _step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and where the character shows a beginning."""
    if kind == END:
        return FRESH, HERE | (BEFORE if state in (TICK_RV, TICK_L) else 0)
    if state == TICK and kind == S or state == TICK_RV and kind == E or state == TICK_L and kind == ELL:
        return FRESH, 0  # a contraction is complete
    if state == TICK and kind == RV:
        return TICK_RV, 0
    if state == TICK and kind == ELL:
        return TICK_L, 0
    if state in (TICK_RV, TICK_L):  # no contraction: the letter began a run
        after, marks = _step(IN_LETTERS, kind)
        return after, marks | BEFORE
    letter = kind in (LETTER, S, RV, ELL, E)
    run = IN_LETTERS if letter else IN_DIGITS if kind == DIGIT else IN_OTHER
    if kind in (BLANK, WHITE):
        if state in (BLANK1, BLANK2, WHITE1, WHITE2):
            return (BLANK2 if kind == BLANK else WHITE2), 0
        return (BLANK1 if kind == BLANK else WHITE1), HERE
    if state in (BLANK1, BLANK2):  # one blank belongs to the run behind it
        return run, BEFORE if state == BLANK2 else 0
    if kind == QUOTE and state not in (IN_OTHER, TICK):
        return TICK, HERE | (BEFORE if state == WHITE2 else 0)
    same = state == run or state == TICK and run == IN_OTHER
    return run, 0 if same else HERE | (BEFORE if state == WHITE2 else 0)


class Scanner:
    """Class table, automaton, and the closure of its transition functions."""

    def __init__(self):
        self.kinds = _class_table()
        states, kinds = range(11), range(11)
        self.marks = np.array([[_step(s, k)[1] for k in kinds] for s in states], np.uint8)
        generators = [tuple(_step(s, k)[0] for s in states) for k in kinds]
        number = {tuple(states): 0}
        functions = [tuple(states)]
        for f in functions:  # grows while it is walked: all compositions
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in number:
                    number[h] = len(functions)
                    functions.append(h)
        self.n = len(functions)
        self.apply = np.array(functions, np.uint8)
        rows = self.apply
        # compose[a, b]: first a, then b
        self.compose = np.array([[number[tuple(rows[b][rows[a]].tolist())] for b in range(self.n)] for a in range(self.n)], np.int32).ravel()
        self.element = np.array([number[g] for g in generators], np.int32)

    def states(self, kinds: np.ndarray) -> np.ndarray:
        """The state before each character: a prefix scan over functions, in blocks side by side."""
        n = len(kinds)
        width = max(1, int(n**0.5))
        blocks = -(-n // width)
        own = np.zeros(blocks * width, np.int32)
        own[:n] = self.element[kinds]
        own = np.ascontiguousarray(own.reshape(blocks, width).T)
        for j in range(1, width):
            np.take(self.compose, own[j - 1] * self.n + own[j], out=own[j])
        carry, at = [], 0
        for last in own[-1].tolist():
            carry.append(at)
            at = int(self.compose[at * self.n + last])
        begin = self.apply[carry, FRESH]
        out = np.empty((width, blocks), np.uint8)
        out[0] = begin
        out[1:] = self.apply[own[:-1], begin]
        return out.T.reshape(-1)[:n]

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a pre-token (or an END) begins at each character."""
        marks = self.marks[self.states(kinds), kinds]
        out = (marks & HERE) > 0
        out[:-1] |= (marks[1:] & BEFORE) > 0
        return out


def _class_table() -> np.ndarray:
    """The class of every code point.

    Letters and numbers are those on which two Unicode tables of different age agree.  On the
    others (assigned lately) the library whose ids are to be matched is asked.
    """
    import unicodedata

    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    groups = {"L": LETTER, "N": DIGIT}
    older = np.full(0x110000, OTHER, np.uint8)
    older[points] = [groups.get(unicodedata.category(c)[0], OTHER) for c in every]
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
        for found in regex.finditer(pattern, every):
            a, b = (x if x <= 0xD800 else x + 0x800 for x in found.span())
            table[a:b] = kind
    unsure = np.flatnonzero(table != older)
    table[unsure] = _asked(list(map(chr, unsure.tolist())))
    table[_WHITE] = WHITE
    table[ord(" ")] = BLANK
    table[ord("'")] = QUOTE
    for letters, kind in ((_SHORT, S), ("rv", RV), ("l", ELL), ("e", E)):
        table[[ord(c) for c in letters]] = kind
    return table


def _asked(chars: list[str]) -> list[int]:
    """Classes of characters beyond ASCII, seen by what the library lets grow together with them."""
    import public_tokenizers
    import tiktoken

    after = {"a": LETTER, "1": DIGIT}
    ranks = {bytes([k]): k for k in range(256)}
    pairs = [bytes([last]) + c.encode() for last in range(128, 192) for c in after]
    ranks |= {pair: 256 + k for k, pair in enumerate(pairs)}
    own = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = [OTHER] * len(chars)
    for c, kind in after.items():
        # One line for each character: the pair is a token of its own only inside one pre-token.
        ids = own.encode_ordinary("".join(f"{x}{c}\n" for x in chars))
        line = 0
        for k in ids:
            if k >= 256:
                out[line] = kind
            line += k == 10
    return out


class Vocabulary:
    def __init__(self, name: str):
        with open(tokenizer_path(name), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(self.ranks.values(), default=-1) + 1
        self.sizes = np.full(n, -1, np.int64)
        pieces = [b""] * n
        for piece, rank in self.ranks.items():
            pieces[rank], self.sizes[rank] = piece, len(piece)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.at = np.r_[0, np.cumsum(np.maximum(self.sizes, 0))]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None  # made when first needed

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length: always the adjacent pair of lowest rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours by first byte
        gone = bytearray(n + 1)
        best: dict[int, int] = {}  # the rank of the pair that begins here
        heap = []

        def offer(at: int) -> None:
            middle = after[at]
            rank = None if middle >= n else ranks.get(piece[at : after[middle]])
            if rank is None:
                best.pop(at, None)
            else:
                best[at] = rank
                heapq.heappush(heap, rank << 32 | at)

        for at in range(n - 1):
            offer(at)
        while heap:
            rank, at = divmod(heapq.heappop(heap), 1 << 32)
            if gone[at] or best.get(at) != rank:
                continue
            middle = after[at]
            gone[middle] = 1
            best.pop(middle, None)
            after[at] = after[middle]
            if after[at] < n:
                before[after[at]] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make a token, as sorted numbers, and the token of each."""
        found = []
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        keys = np.array(found, np.int64).reshape(-1, 2)
        keys = keys[np.argsort(keys[:, 0])]
        return keys[:, 0].copy(), keys[:, 1].copy()

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self.pairs
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], _NONE)

    def _merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens of at most SHORT bytes, side by side: each round merges one pair of each."""
        if self.pairs is None:
            self.pairs = self._pair_table()
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(token), _NONE)  # of the pair that begins here
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self._pair_ranks(token[inside], token[inside + 1])
        done_token, done_owner = [], []
        while len(token):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(token)])
            place = np.arange(len(token)) - np.repeat(first, sizes)
            best = np.minimum.reduceat(rank * (2 * SHORT) + place, first)  # the lowest, then the leftmost
            live = best < _NONE * 2 * SHORT
            stays = np.repeat(live, sizes)
            done_token.append(token[~stays])
            done_owner.append(owner[~stays])
            at = first[live] + best[live] % (2 * SHORT)
            token[at] = best[live] // (2 * SHORT)
            stays[at + 1] = False
            at = np.cumsum(stays)[at] - 1
            token, owner, rank = token[stays], owner[stays], rank[stays]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(token) - 1)
                pair = (left < right) & (owner[left] == owner[right])
                rank[left] = np.where(pair, self._pair_ranks(token[left], token[right]), _NONE)
        owners = np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        ids = np.concatenate(done_token)[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owners, minlength=len(pieces)))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Per pre-token its ids, as little-endian 32-bit numbers."""
        out: list[bytes | None] = [None] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) <= SHORT:
                short.append(k)
            else:
                out[k] = np.array(self.merge(piece), "<i4").tobytes()
        for at in range(0, len(short), BESIDE):
            some = short[at : at + BESIDE]
            for k, ids in zip(some, self._merge_short([pieces[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def spread(self, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, each written from its place in `firsts` on."""
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        source = np.repeat(self.at[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        if len(ids) and (firsts[0] != 0 or (np.diff(firsts) != sizes[:-1]).any()):
            raise ValueError("starts do not fit the tokens")
        return self.bytes[source]


class Codec:
    def __init__(self, name: str):
        self.vocabulary, self.scanner = vocabulary(name), Scanner()
        self.cache: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token, from the cache; those that it lacks are merged together."""
        parts = list(map(self.cache.get, pieces))
        missing = list(dict.fromkeys(p for p, found in zip(pieces, parts, strict=True) if found is None))
        if not missing:
            return parts
        new = dict(zip(missing, self.vocabulary.merge_all([p.encode() for p in missing]), strict=True))
        for piece, ids in new.items():
            if len(self.cache) >= KEPT:
                break
            if len(piece) <= LONGEST:
                self.cache[piece] = ids
        return [new[p] if found is None else found for p, found in zip(pieces, parts, strict=True)]

    def _cut(self, joined: str, ends: np.ndarray) -> tuple[list[str], np.ndarray, int]:
        """Pre-tokens of texts that each end with one character at `ends`; how many before each end.

        The third result is where the last pre-token begins.
        """
        kinds = self.scanner.kinds[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        kinds[ends] = END
        begin = np.flatnonzero(self.scanner.begins(kinds))
        end = np.r_[begin[1:], len(kinds)]
        inside = kinds[begin] != END
        counts = np.cumsum(inside)[np.searchsorted(begin, ends)] if len(ends) else np.zeros(0, np.int64)
        spans = zip(begin[inside].tolist(), end[inside].tolist(), strict=True)
        return [joined[a:b] for a, b in spans], counts, int(begin[-1]) if len(begin) else 0

    def _long(self, text: str) -> Iterator[str]:
        """Pre-tokens of one text in parts: a part's last one may go on and begins the next part."""
        at, size = 0, SEGMENT
        while at + size < len(text):
            pieces, _, last = self._cut(text[at : at + size], np.zeros(0, np.int64))
            if last:
                yield from pieces[:-1]
                at, size = at + last, SEGMENT
            else:
                size *= 2
        yield from self._cut(text[at:] + "\n", np.array([len(text) - at]))[0]

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all texts, and how many stand before the end of each text."""
        out: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        row = 0
        while row < len(texts):
            if len(texts[row]) > SEGMENT:
                out.extend(self._long(texts[row]))
                counts[row] = len(out)
                row += 1
                continue
            to, size = row, 0
            while to < len(texts) and len(texts[to]) <= SEGMENT and (to == row or size + len(texts[to]) <= SEGMENT):
                size += len(texts[to])
                to += 1
            group = texts[row:to]
            ends = np.cumsum([len(t) + 1 for t in group]) - 1
            found, n, _ = self._cut("\n".join([*group, ""]), ends)
            counts[row:to] = n + len(out)
            out += found
            row = to
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the borders of the texts among them (one more than texts)."""
        pieces, counts = self.pieces(texts)
        parts = self._ids(pieces)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.frombuffer(b"".join(parts), "<i4"), np.r_[0, np.r_[0, np.cumsum(sizes)][counts]]

    def starts(self, ids: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The byte of its text at which each token begins."""
        upto = np.r_[0, np.cumsum(self.vocabulary.sizes[ids])]
        return upto[:-1] - np.repeat(upto[borders[:-1]], np.diff(borders))


_vocabularies: dict[str, Vocabulary] = {}
_codecs: dict[str, Codec] = {}


def vocabulary(name: str) -> Vocabulary:
    """The worker's own copy of a file of ranks, one at a time."""
    if name not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[name] = Vocabulary(name)
    return _vocabularies[name]


def codec(name: str) -> Codec:
    """The worker's own codec of a file of ranks, one at a time."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(name)
    return _codecs[name]


def _lists(borders: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.astype(np.int32)))


def _with(batch: pa.RecordBatch, text: str, more: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != text]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more.values()], [*names, *more])


def _encode(name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name)
        for batch in slices(batches):
            ids, borders = own.encode([t or "" for t in batch.column("text").to_pylist()])
            more = {"ids": _lists(borders, ids), "starts": _lists(borders, own.starts(ids, borders))}
            yield _with(batch, "text", more)

    return encode


def _decode(name: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(name)
        for batch in slices(batches):
            ids, starts = batch.column("ids"), batch.column("starts")
            borders = np.r_[0, np.cumsum(np.diff(np.asarray(ids.offsets)))]
            flat, at = np.asarray(ids.flatten()), np.asarray(starts.flatten()).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(own.sizes) or (own.sizes[flat] < 0).any()):
                raise ValueError("an id is not in the vocabulary")
            sizes = own.sizes[flat]
            upto = np.r_[0, np.cumsum(sizes)]
            # Places count from the row's first byte; rows follow each other in one buffer.
            raw = own.spread(flat, at + np.repeat(upto[borders[:-1]], np.diff(borders)))
            data = pa.Array.from_buffers(
                pa.large_binary(), len(ids), [None, pa.py_buffer(upto[borders].astype(np.int64)), pa.py_buffer(raw)]
            )
            yield _with(batch, "ids", {"bytes": data.cast(pa.binary())})

    return decode


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts: one row per row of `docs`, with the whole text's ids.

    `starts` has the UTF-8 byte at which each token begins.  Strings that look like special tokens
    are ordinary text.  A null text counts as empty and has no ids; null and repeated ids are
    carried along; texts of any length are cut in parts of bounded size with the same result; an
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_encode(ranks), f"doc_id {kind}, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """`encoded` (as `encode` gives it) with `bytes`, the UTF-8 of each text.

    A null list counts as empty.  An id outside the vocabulary, or `starts` that do not fit, is an
    error.
    """
    ship(encoded.sparkSession)
    none = F.array().cast("array<int>")
    named = encoded.select("doc_id", *[F.coalesce(c, none).alias(c) for c in ("ids", "starts")], F.col("ids").alias("kept"))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    out = named.mapInArrow(_decode(ranks), f"doc_id {kind}, starts array<int>, kept array<int>, bytes binary")
    return out.select("doc_id", F.col("kept").alias("ids"), "starts", "bytes")


def ids_text(ids: str = "ids") -> Column:
    """The ids in decimal, joined by commas."""
    return F.concat_ws(",", F.col(ids).cast("array<string>"))

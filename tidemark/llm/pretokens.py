"""Token ids exactly as the tokenizers library gives them, from a cache of pre-tokens.

The tokenizers used here cut a text into pre-tokens by a pattern and encode each on its own.
Texts of plain letters, digits and punctuation are cut by Python's `re`, texts with any other
character (whose class the two pattern engines might see differently) by the library's own
normaliser and cutter.  Either way every distinct pre-token is encoded once per worker.  Only
tokenizers with other rules go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens one worker keeps: the first it meets, which the frequent ones are among.
KEPT = 200_000

# Fixed by the tokenizer files: the cutting patterns and the rules that identify them.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_CUT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_CUT = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Letters whose class, case and composition are the same everywhere; U+0130 changes its length.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡£«»¿-įı-ž–—‘’“”…€]")


def tokenizer_path(name: str) -> str:
    """A file's place: an existing path as it is, else a name of the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte; fixed by the byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class _Cache(dict):
    """Pre-token to what is kept of it; encodes what it lacks."""

    def __init__(self, known: dict, learn):
        super().__init__(known)
        self.learn = learn

    def __missing__(self, piece: str):
        value = self.learn(piece)
        if len(self) < KEPT:
            self[piece] = value
        return value


class Encoder:
    """`keep` is "lengths" (of pre-tokens) or "ids" (as little-endian unsigned 32-bit bytes)."""

    def __init__(self, name: str, keep: str, known: dict[str, int] | None = None):
        import numpy as np
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.specials = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        plain_specials = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"])
        cutter = rules["pre_tokenizer"] or {}
        self.lower = False
        self.cut = None
        if plain_specials and cutter == _BYTE_LEVEL and rules["normalizer"] is None:
            self.cut = _BYTE_CUT.findall
        elif (
            plain_specials
            and cutter.get("pretokenizers", [{}])[0].get("pattern") == {"Regex": _WORD_PATTERN}
            and [n["type"] for n in rules["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            self.cut, self.lower = _WORD_CUT.findall, True
        self.keep = keep
        self.as_kept = (lambda ids: len(ids)) if keep == "lengths" else (lambda ids: np.array(ids, "<u4").tobytes())
        self.letters = dict(enumerate(_byte_letters()))
        self.bytes = {ord(c): b for b, c in self.letters.items()}
        self.cache = _Cache(known or {}, self._learn)

    def _learn(self, piece: str):
        if piece in self.specials:
            return self.as_kept([self.specials[piece]])
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return self.as_kept([t.id for t in self.model.tokenize(spelled)])

    def _cut_by_library(self, part: str) -> list[str]:
        """Pre-tokens of a text of any script, whose letters for bytes are turned back into text."""
        if self.library.normalizer is not None:
            part = self.library.normalizer.normalize_str(part)
        spelled = self.library.pre_tokenizer.pre_tokenize_str(part)
        return [s.translate(self.bytes).encode("latin-1").decode() for s, _ in spelled]

    def _cut(self, part: str, plain: bool) -> list[str]:
        return self.cut(part.lower() if self.lower else part) if plain else self._cut_by_library(part)

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens of a text, special strings among them; None: not cut here."""
        if self.cut is None:
            return None
        plain = not _OTHER.search(text)
        parts = self.split.split(text) if self.split and "<|" in text else (text,)
        if len(parts) == 1:
            return self._cut(text, plain)
        out: list[str] = []
        for part in parts:
            if part in self.specials:
                out.append(part)
            elif part:
                out += self._cut(part, plain)
        return out

    def encode(self, texts: list[str | None]) -> Iterator:
        """Per text its number of tokens, or the bytes of its ids; null is the empty text."""
        look, join = self.cache.__getitem__, sum if self.keep == "lengths" else b"".join
        for text in texts:
            pieces = self.pieces(text or "")
            if pieces is None:
                yield self.as_kept(self.library.encode(text, add_special_tokens=False).ids)
            else:
                yield join(map(look, pieces))


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, keep: str, table: bytes | None = None, unpack=None) -> Encoder:
    """The worker's own encoder, made once per process, tokenizer and table of known lengths."""
    key = (name, keep, len(table or b""), zlib.crc32(table or b""))
    if key not in _encoders:
        if len(_encoders) >= 2:
            _encoders.clear()
        _encoders[key] = Encoder(name, keep, unpack(table) if table else None)
    return _encoders[key]

"""Secret scanning: candidates from every text, false positives removed by a random forest.

A candidate is a run of MIN_LENGTH or more characters of [A-Za-z0-9_+/-] that has a digit, or
what a rule finds whatever its characters: a value after a credential name, a provider's format, a
whole dotted token, a private key block.  Each span is judged once; spans may overlap, as a dotted
token and its parts do.  The forest sees its length and composition, how its characters follow each other (against
transitions of ordinary words), how much of it dictionary words cover, signs of a path in it and
in the document's path, and the words beside it.  It is trained on labelled findings; where none
are given, findings are labelled by rules that only know provider formats, assignments to
credential names, and what is harmless: numbers, UUIDs, versions, placeholders, paths, addresses,
checksums named as such, and identifiers made of dictionary words.  Dictionary and transitions come from the
most frequent words of all texts, in any script, by exact counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text
from tidemark.llm.ship import ship
from tidemark.session import materialized

MIN_LENGTH = 12
THRESHOLD = 0.5
#: Labelled findings of each class that train the forest, and its size.
SAMPLE = 2000
TREES, DEPTH = 30, 6
#: Words of the dictionary, and bytes of text on either side of a candidate.
DICTIONARY = 1 << 15
#: Characters of a dictionary word, and distinct words that a task adds up before it hands them on.
SHORTEST, LONGEST = 3, 32
COUNTED = 1 << 16
AROUND = 40
#: Neighbouring words that become features, by how well they tell the classes apart.
NEIGHBOURS = 16

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"_+/-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

# Fixed by providers and by custom: formats of keys, and names that secrets are assigned to.
_FORMATS = r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abps]-[A-Za-z0-9-]+|sk_live_[A-Za-z0-9]{24}"
_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|secret|private)[_-]?key|credentials?|auth)"
_PROVIDER = re.compile(_FORMATS)
_ASSIGNED = re.compile(rf"(?i){_NAMES}[\"'`]?\s{{0,8}}(?::=|=>|[:=])\s{{0,8}}[\"'`]?$")
# The same in bytes, to find candidates: a quoted value ends at its quote, another at white space or a quote.
_VALUE = re.compile(
    rb"(?i)" + _NAMES.encode() + rb"[\"'`]?\s{0,8}(?::=|=>|[:=])[^\S\n]{0,8}(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|[\"'`]?([^\s\"'`]+))"
)
_FORMAT = re.compile(rb"(?<![A-Za-z0-9_-])(?:" + _FORMATS.encode() + rb")(?![A-Za-z0-9_-])")
_DOTTED = re.compile(rb"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]++(?:\.[A-Za-z0-9_+/=-]++)+")
_KEY_BEGIN = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
_KEY_HEADER = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY( BLOCK)?-----")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[0-9][0-9/_+-]*")
# Harmless: a reference to a value kept elsewhere, releases, addresses, file paths, named checksums.
_PLACEHOLDER = re.compile(r"[$%]?[{<\[(].*[}>\])]|\$\w+|%\w+%|[*xX.]+|(?i:null|none|nil|true|false|undefined)|(?i:(your|my|change)[-_]?\w*)")
_VERSION = re.compile(r"[A-Za-z-]*[vV]?\d+([._-]\d+)+([-_+.]?(?:alpha|beta|rc|dev|post|final|snapshot)[._-]?\d*)?", re.IGNORECASE)
_IN_URL = re.compile(r"(?i)(?:https?|ftp)://\S*$")
_PATH = re.compile(r"(?:[A-Za-z]:)?/?(?:[a-z][a-z_.-]*\d{0,4}/|\d{4}/|\d{2}/){1,40}[a-z][a-z_.-]*\d{0,4}(?:\.[a-z]{1,5})?/?")
_CHECKSUM = re.compile(
    r"(?i)(?<![a-z])(?:sha-?\d*|md5|crc32|check-?sum|commit|revision|rev|digest|hash|etag|blob|tree|fingerprint|integrity)"
    r"(?:sum)?[\"'`]?(?:\s+(?:is|of))?\s{0,8}[:=(@#]?\s{0,8}[\"'`]?(?:sha\d+[-:])?$"
)
_SUM = re.compile(r"(?:sha\d+-)?(?:[0-9a-fA-F]{12,128}|[A-Za-z0-9+/]{43}=?|[A-Za-z0-9+/]{86}(?:==)?)")
_PARTS = re.compile(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+(?![^\W\dA-Z_])|\d+")
_WORDS = re.compile(r"[A-Za-z]+")
# Words that stand alone: the pieces of a candidate must not vouch for it.
_LETTERS = re.compile(r"(?<![\w+/-])[^\W\d_]+(?![\w+/-])")
_TESTLIKE = re.compile(r"(?i)test|example|sample|mock|dummy|doc")

NUMERIC = [
    "length", "digits", "uppers", "lowers", "symbols", "kinds_changed", "distinct", "entropy",
    "transition", "coverage", "slashes", "path_depth", "path_test", "hex_only", "quoted", "assigned",
]


def candidates(column: pa.Array) -> list[tuple[int, int, int]]:
    """(row, start, end) in bytes of the batch of all candidates."""
    data, offsets = text.batch_bytes(column)
    out = []
    stop = ~_RUN
    for a, b in text._cuts(data, offsets, stop):
        piece = data[a:b]
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        run = _RUN[piece]
        begins, finishes = run.copy(), run.copy()
        begins[1:] &= ~run[:-1]
        begins[inner] = run[inner]
        finishes[:-1] &= ~run[1:]
        finishes[inner - 1] = run[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        digits = np.r_[0, np.cumsum(_DIGIT[piece])]
        some = (end - start >= MIN_LENGTH) & (digits[end] > digits[start])
        row = np.searchsorted(offsets, start[some] + a, "right") - 1
        out += zip(row.tolist(), (start[some] + a).tolist(), (end[some] + a).tolist(), strict=True)
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts with their counts, added up as long as they are few."""

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in text.slices(batches):
        for t in batch.column("text").to_pylist():
            counts.update(w for w in _LETTERS.findall((t or "").lower()) if SHORTEST <= len(w) <= LONGEST)
            if len(counts) >= COUNTED:
                yield counted()
                counts.clear()
    yield counted()


def _of_rules(raw: bytes) -> Iterator[tuple[int, int]]:
    """Spans of one text that a rule names as candidates."""
    for m in _VALUE.finditer(raw):
        a, b = m.span(m.lastindex)
        if m.lastindex == 4:  # not quoted: a sentence's or a structure's own punctuation ends it
            b = a + len(raw[a:b].rstrip(b".,;:)]}>"))
        if b > a:
            yield a, b
    for m in _FORMAT.finditer(raw):
        yield m.span()
    for m in _DOTTED.finditer(raw):
        token = m[0]
        longest = max(map(len, token.split(b".")))
        if (longest >= MIN_LENGTH or len(token) >= 2 * MIN_LENGTH) and re.search(rb"\d", token) and re.search(rb"[A-Za-z]", token):
            yield m.span()
    for m in _KEY_BEGIN.finditer(raw):
        last = b"-----END " + m[1] + b"-----"
        following = raw.find(b"-----BEGIN ", m.end())
        end = raw.find(last, m.end(), following if following >= 0 else len(raw))
        yield m.start(), end + len(last) if end >= 0 else m.end()


def all_candidates(column: pa.Array) -> list[tuple[int, int, int]]:
    """(row, start, end) in bytes of the batch: the runs and what the rules find, each span once."""
    data, offsets = text.batch_bytes(column)
    found = set(candidates(column))
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        found.update((row, a + x, a + y) for x, y in _of_rules(data[a:b].tobytes()))
    return sorted(found)


class Language:
    """Dictionary and character transitions of ordinary words."""

    def __init__(self, words: Counter):
        self.words = frozenset(words)
        counts = np.ones((128, 128))
        for word, n in words.items():
            codes = [ord(c) for c in word if ord(c) < 128]
            for x, y in zip(codes, codes[1:], strict=False):
                counts[x, y] += n
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    @classmethod
    def learn(cls, texts: DataFrame) -> Language:
        """The DICTIONARY most frequent words of the `text` column, ties by word."""
        counts = texts.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = materialized(counts.withColumn("size", F.floor(F.log2("n")).cast("int")), "words")
        # Powers of two first: what is surely not among the top is not sorted.
        least, held = 0, 0
        for r in sorted(counts.groupBy("size").count().collect(), reverse=True):  # at most 64 rows
            least, held = r["size"], held + r["count"]
            if held >= DICTIONARY:
                break
        # Written before it is collected: tasks' own top lists meet in a shuffle, not in the driver.
        top = materialized(counts.where(F.col("size") >= least).orderBy(F.desc("n"), "word").limit(DICTIONARY).select("word", "n"), "top-words")
        return cls(Counter({r["word"]: r["n"] for r in top.collect()}))

    def transition(self, value: str) -> float:
        codes = [min(ord(c), 127) for c in value.lower()]
        return float(np.mean(self.log[codes[:-1], codes[1:]])) if len(codes) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of the characters that dictionary words cover, longest first from the left."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            for size in range(min(16, len(low) - at), 2, -1):
                if low[at : at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / len(low)


def describe(value: str, before: str, after: str, path: str | None, language: Language) -> list[float]:
    """The values of NUMERIC for a candidate."""
    n = len(value)
    counts = np.array(list(Counter(value).values())) / n
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    path = path or ""
    return [
        float(n),
        kind.count("d") / n,
        kind.count("u") / n,
        kind.count("l") / n,
        kind.count("s") / n,
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n,
        len(counts) / n,
        float(-(counts * np.log2(counts)).sum()),
        language.transition(value),
        language.coverage(value),
        float(value.count("/")),
        float(path.count("/")),
        float(bool(_TESTLIKE.search(path))),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)),
        float(bool(re.search(r"[:=]\s*[\"'`]?$", before))),
    ]


def made_of_words(value: str, language: Language) -> bool:
    """Dictionary words, at least half of the letters' parts and all longer ones, and short numbers between separators or cases."""
    parts = _PARTS.findall(value)
    letters = [p for p in parts if not p.isdigit()]
    words = [p for p in letters if p.lower() in language.words]
    rest = [p for p in letters if len(p) >= SHORTEST and p.lower() not in language.words]
    return bool(words) and not rest and 2 * len(words) >= len(letters) and all(len(p) <= 4 for p in parts if p.isdigit())


def rule_label(value: str, before: str, language: Language | None = None) -> int | None:
    """1: a secret by format or assignment; 0: harmless by what it is or follows; None: unknown."""
    if _PROVIDER.fullmatch(value) or _KEY_HEADER.match(value):
        return 1
    if _ASSIGNED.search(before):
        if _PLACEHOLDER.fullmatch(value):
            return 0
        # A bare word may as well be prose ("password: required"); the forest has to judge it.
        return None if value.isalpha() and before[-1:] not in "\"'`" else 1
    if _NUMBER.fullmatch(value) or _UUID.fullmatch(value) or _VERSION.fullmatch(value) or _PATH.fullmatch(value):
        return 0
    if _IN_URL.search(before) or (_CHECKSUM.search(before) and _SUM.fullmatch(value)):
        return 0
    if language is not None and made_of_words(value, language):
        return 0
    return None


def _find(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language: Language = shared.value
        for batch in text.slices(batches):
            data, offsets = text.batch_bytes(batch.column("text"))
            ids, paths = batch.column("doc_id").to_pylist(), batch.column("path").to_pylist()
            rows: list[dict] = []
            points = text.Points(data)
            for row, a, b in all_candidates(batch.column("text")):
                low, high = int(offsets[row]), int(offsets[row + 1])
                before = data[max(low, a - AROUND) : a].tobytes().decode("utf-8", "ignore")
                after = data[b : min(high, b + AROUND)].tobytes().decode("utf-8", "ignore")
                value = data[a:b].tobytes().decode()
                words = _WORDS.findall(before)[-1:], _WORDS.findall(after)[:1]
                start = points.before(a) - points.before(low)
                length = len(value)
                rows.append(
                    {
                        "doc_id": ids[row],
                        "start": start,
                        "end": start + length,
                        "value": value,
                        "before": words[0][0].lower() if words[0] else "",
                        "after": words[1][0].lower() if words[1] else "",
                        "features": describe(value, before, after, paths[row], language),
                        "rule": rule_label(value, before, language),
                    }
                )
            yield pa.RecordBatch.from_pylist(
                rows,
                pa.schema(
                    [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("before", pa.string()),
                     ("after", pa.string()), ("features", pa.list_(pa.float64())), ("rule", pa.int32())]
                ),
            )

    return find


_SCHEMA = "doc_id long, start long, end long, value string, before string, after string, features array<double>, rule int"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate of every text with its features, written once."""
    ship(docs.sparkSession)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(Language.learn(own.select("text")))  # DICTIONARY words
    return materialized(own.mapInArrow(_find(shared), _SCHEMA), "candidates")


def _vector(found: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    numeric = [F.col("features")[k].alias(n) for k, n in enumerate(NUMERIC)]
    beside = [(F.col(side) == word).cast("double").alias(f"{side}_{k}") for k, (side, word) in enumerate(words)]
    named = found.select("doc_id", "start", "end", "value", "rule", "label", *numeric, *beside)
    inputs = NUMERIC + [f"{side}_{k}" for k, (side, _) in enumerate(words)]
    return VectorAssembler(inputCols=inputs, outputCol="vector").transform(named)


def _neighbours(labelled: DataFrame) -> list[tuple[str, str]]:
    """The words beside findings whose shares differ most between the classes."""
    sides = [labelled.select(F.lit(s).alias("side"), F.col(s).alias("word"), "label") for s in ("before", "after")]
    gap = F.abs(F.avg(F.col("label") * 2.0 - 1.0)) * F.log1p(F.count("*").cast("double"))
    top = sides[0].unionByName(sides[1]).where("word <> ''").groupBy("side", "word").agg(gap.alias("gap"), F.count("*").alias("n"))
    return [(r["side"], r["word"]) for r in top.where("n >= 5").orderBy(F.desc("gap"), "side", "word").limit(NEIGHBOURS).collect()]


def secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
) -> DataFrame:
    """doc_id, start, end, score, secret, value: one row per candidate in `docs`.

    `start` and `end` count characters; `secret` is score >= THRESHOLD.  `findings` (doc_id,
    start, label 0 or 1) are labelled findings; without them the rules of `rule_label` label
    what they know.  The forest learns from at most SAMPLE findings of each class, chosen by a
    hash of their text.  Without findings of both classes the score is 0 or 1 by the rules, 0
    where they know nothing.  Null and empty texts have no candidate; a null id or path is
    carried along; repeated rows give repeated findings; ids must be integers or read as such;
    texts of any length are searched whole; an empty table gives no rows; other columns are ignored.
    """
    found = find_candidates(docs, id_col, text_col, path_col)
    if findings is None:
        found = found.withColumn("label", F.col("rule"))
    else:
        known = findings.select("doc_id", "start", F.col("label").cast("int").alias("label")).dropDuplicates(["doc_id", "start"])
        found = found.join(known, ["doc_id", "start"], "left")
    order = F.xxhash64("value", "before", "after")
    sample = [
        found.where(F.col("label") == y).dropDuplicates(["value", "before", "after"]).orderBy(order, "value", "before", "after").limit(SAMPLE)
        for y in (0, 1)
    ]
    labelled = materialized(sample[0].unionByName(sample[1]), "labelled")
    columns = ["doc_id", "start", "end", "score"]
    if labelled.select("label").distinct().count() < 2:
        scored = found.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.0))).select(*columns, "value")
        return scored.select(*columns, (F.col("score") >= THRESHOLD).alias("secret"), "value")
    words = _neighbours(labelled)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11)
    model = forest.fit(_vector(labelled, words))
    scored = model.transform(_vector(found, words))
    score = vector_to_array("probability")[1].alias("score")
    return scored.select("doc_id", "start", "end", "value", score).select(*columns, (F.col("score") >= THRESHOLD).alias("secret"), "value")

"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Tokens are runs of letters and digits; a chain is what stands between sentence ends.  Labels are
given for documents only, so training tokens are labelled first: in a document marked toxic, a
token is toxic if its word or a prefix of it is strongly associated with toxic documents of the
training sample.  The field (tags: clean, toxic) has features of the word, its prefixes and
suffix, and both neighbouring words.  Forward-backward marginals give spans with offsets, and
are aggregated into a document score by a logistic model.

Training takes a bounded sample of labelled documents (SAMPLE_TOXIC and SAMPLE_CLEAN, of at
most SAMPLE_BYTES bytes each and TRAINING_BYTES together); scoring reads every text whole.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text
from tidemark.llm.idset import IdSet, row_key
from tidemark.llm.ship import ship

SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
SAMPLE_BYTES = 100_000
#: Bytes of all sampled documents together, in the order of the hash that chooses them.
TRAINING_BYTES = 48_000_000
THRESHOLD = 0.7
#: Feature weights live in a table of this size, by hash.
TABLE = 1 << 18
EPOCHS = 6
#: A feature is a toxic sign with so many toxic documents and this log ratio of frequencies.
MIN_DOCS, MIN_RATIO = 4, 4.0
#: A token belongs to a span from this marginal on.
SPAN = 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # sentence ends: \n ! . ?
_PREFIXES = (4, 5, 6)
_SALT = text.constants(31, 8)
_KINDS = 2 + len(_PREFIXES)  # word, prefixes, suffix


@dataclass
class Tokens:
    """Tokens of a segment: bytes [start, end), row, chain; `word` numbers distinct words."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chain: np.ndarray
    word: np.ndarray
    features: np.ndarray  # per distinct word: _KINDS hashes


def segments(column: pa.Array) -> Iterator[Tokens]:
    """Cuts a batch of texts into tokens, some megabytes at a time; `start` counts in the batch."""
    data, offsets = text.batch_bytes(column)
    for a, b in text._cuts(data, offsets, _STOP):
        piece = text.LOWER[data[a:b]]
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        solid = _WORD[piece]
        begins, finishes = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[inner] = solid[inner]
        finishes[:-1] &= ~solid[1:]
        finishes[inner - 1] = solid[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        if not len(start):
            continue
        stops = _STOP[piece]
        stops[inner - 1] = True
        hashes = text.span_hashes(piece, start, end)
        _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        at, to = start[first], end[first]
        kinds = [hashes[first]]
        kinds += [text.span_hashes(piece, at, np.minimum(to, at + n)) + _SALT[n] for n in _PREFIXES]
        kinds.append(text.span_hashes(piece, np.maximum(at, to - 3), to) + _SALT[0])
        yield Tokens(
            np.searchsorted(offsets, start + a, "right") - 1,
            start + a,
            end + a,
            np.r_[0, np.cumsum(stops)][start],
            word,
            np.stack(kinds, axis=1),
        )


def _slots(features: np.ndarray) -> np.ndarray:
    """Table positions of per-word features, and of the word as a left and a right neighbour."""
    kinds = text.mix(features + _SALT[1])
    around = [text.mix(features[:, 0] + _SALT[k]) for k in (2, 3)]
    return (np.column_stack([kinds, *around]) % np.uint64(TABLE)).astype(np.int64)


def _emissions(weights: np.ndarray, bias: float, slots: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Log-potential of the tag toxic against clean, per token."""
    own = weights[slots[:, :_KINDS]].sum(axis=1) + bias
    out = own[tokens.word]
    inside = tokens.chain[1:] == tokens.chain[:-1]
    out[1:] += np.where(inside, weights[slots[tokens.word[:-1], _KINDS]], 0)
    out[:-1] += np.where(inside, weights[slots[tokens.word[1:], _KINDS + 1]], 0)
    return out


def _ladder(chain: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each step k, the positions of the k-th tokens of all chains that are that long."""
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    size = np.diff(np.r_[first, len(chain)])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    return first, [first[:n] + k for k, n in enumerate(alive)]


def forward_backward(emission: np.ndarray, chain: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of the tag toxic per token, and expected counts of the four transitions.

    With two tags a forward or backward message is one ratio (toxic over clean).
    """
    e = np.exp(np.clip(emission, -40, 40))
    (t00, t01), (t10, t11) = np.exp(transition)
    _, steps = _ladder(chain)
    alpha, beta = np.empty(len(e)), np.ones(len(e))
    alpha[steps[0]] = e[steps[0]]
    for before, now in zip(steps, steps[1:], strict=False):
        r = alpha[before[: len(now)]]
        alpha[now] = np.clip(e[now] * (t01 + r * t11) / (t00 + r * t10), 1e-30, 1e30)
    for now, after in zip(steps[-2::-1], steps[:0:-1], strict=True):
        r = e[after] * beta[after]
        beta[now[: len(after)]] = np.clip((t10 + t11 * r) / (t00 + t01 * r), 1e-30, 1e30)
    odds = np.clip(alpha * beta, 1e-30, 1e30)
    inside = np.flatnonzero(chain[1:] == chain[:-1])
    r, s = alpha[inside], (e * beta)[inside + 1]
    pair = np.stack([t00 * np.ones_like(r), t01 * s, t10 * r, t11 * r * s])
    return odds / (1 + odds), (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    blend: np.ndarray  # weights of the document features

    def marginals(self, tokens: Tokens) -> np.ndarray:
        emission = _emissions(self.weights, self.bias, _slots(tokens.features), tokens)
        return forward_backward(emission, tokens.chain, self.transition)[0]


def document_features(marginal: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per document: 1, log-odds of its strongest token, log of the expected toxic tokens, share."""
    strongest, total, size = np.zeros(n), np.zeros(n), np.zeros(n)
    np.maximum.at(strongest, row, marginal)
    np.add.at(total, row, np.where(marginal > 0.05, marginal, 0))
    np.add.at(size, row, 1)
    strongest = np.clip(strongest, 1e-4, 1 - 1e-4)
    return np.column_stack([np.ones(n), np.log(strongest / (1 - strongest)), np.log1p(total), total / np.maximum(size, 1)])


def _logistic(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(features.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        h = (features * (p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, features.T @ (y - p) - 0.1 * w)
    return w


def _token_labels(batches: list[Tokens], toxic: np.ndarray) -> list[np.ndarray]:
    """Toxic tokens of toxic documents, by association of word and prefixes with toxic documents."""
    kinds = _KINDS - 1

    def holders(t: Tokens, mark: np.ndarray, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Features (of `among`) and how many marked documents of the segment hold each."""
        pairs = np.unique(t.row[mark[t.row] == 1].astype(np.int64) * len(t.features) + t.word[mark[t.row] == 1])
        row, word = np.divmod(pairs, len(t.features))
        known, at = np.unique(t.features[:, :kinds], return_inverse=True)
        at = at.reshape(-1, kinds)[word]
        held = np.unique(at * (len(mark) + 1) + row[:, None]) // (len(mark) + 1)
        if among is not None:
            held = held[np.isin(known, among)[held]]
        number = np.bincount(held, minlength=len(known))
        return known[number > 0], number[number > 0]

    def total(mark: np.ndarray, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        # A document lies in one segment, save for very long ones.
        parts = [holders(t, mark, among) for t in batches]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys))

    keys, bad = total(toxic, None)
    keys, bad = keys[bad >= MIN_DOCS], bad[bad >= MIN_DOCS]
    clean_keys, clean = total(1 - toxic, keys)
    good = np.zeros(len(keys))
    good[np.searchsorted(keys, clean_keys)] = clean
    ratio = np.log((bad + 0.1) / (toxic.sum() + 1)) - np.log((good + 0.3) / ((1 - toxic).sum() + 1))
    signs = keys[ratio >= MIN_RATIO]
    return [np.isin(t.features[:, :kinds], signs).any(axis=1)[t.word] & (toxic[t.row] == 1) for t in batches]


def _slim(t: Tokens, base: int) -> Tokens:
    """What training needs of a segment, in half the bytes, with rows counted from `base`."""
    small = [(x + k).astype(np.int32) for x, k in ((t.row, base), (t.chain, 0), (t.word, 0))]
    none = np.zeros(0, np.int32)
    return Tokens(small[0], none, none, small[1], small[2], t.features)


def train(texts: list[str | None], toxic: list[int], seed: int = 7) -> Model:
    """Fits the field and the blend on a sample; without any toxic document nothing is toxic."""
    y = np.array(toxic, np.int64)
    rng = np.random.default_rng(seed)
    weights, bias, transition = np.zeros(TABLE), -3.0, np.zeros((2, 2))
    if not len(y) or y.min() == y.max():
        blend = np.array([-5.0 if not len(y) or not y[0] else 5.0, 0, 0, 0])
        return Model(weights, bias, transition, blend)
    order = rng.permutation(len(y))
    texts, y = [texts[k] for k in order], y[order]
    batches, base = [], 0
    while base < len(texts):
        end, size = base, 0
        while end < len(texts) and (end == base or size < text.SEGMENT):
            size += len(texts[end] or "")
            end += 1
        for t in segments(pa.array(texts[base:end], pa.string())):
            batches.append(_slim(t, base))
        base = end
    del texts
    labels = _token_labels(batches, y)
    square, bias_square, transition_square = np.full(TABLE, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    for _ in range(EPOCHS):
        for t, tag in zip(batches, labels, strict=True):
            slots = _slots(t.features)
            # Identities are dropped at random, so that prefixes learn to carry unseen words.
            keep = np.ones((len(slots), _KINDS), bool)
            keep[:, 0] = rng.random(len(slots)) < 0.5
            own = (weights[slots[:, :_KINDS]] * keep).sum(axis=1) + bias
            emission = own[t.word]
            inside = t.chain[1:] == t.chain[:-1]
            emission[1:] += np.where(inside, weights[slots[t.word[:-1], _KINDS]], 0)
            emission[:-1] += np.where(inside, weights[slots[t.word[1:], _KINDS + 1]], 0)
            marginal, expected = forward_backward(emission, t.chain, transition)
            gap = tag - marginal  # the log-likelihood's gradient by emissions
            by_word = np.bincount(t.word, gap, len(slots))
            right = np.bincount(t.word[:-1], np.where(inside, gap[1:], 0), len(slots))
            left = np.bincount(t.word[1:], np.where(inside, gap[:-1], 0), len(slots))
            parts = np.column_stack([by_word[:, None] * keep, right, left])
            gradient = np.bincount(slots.ravel(), parts.ravel(), TABLE) - 1e-4 * weights
            square += gradient**2
            weights += 0.2 * gradient / np.sqrt(square)
            bias_square += gap.sum() ** 2
            bias += 0.2 * gap.sum() / math.sqrt(bias_square)
            observed = np.zeros((2, 2))
            np.add.at(observed, (tag[:-1][inside].astype(int), tag[1:][inside].astype(int)), 1)
            step = observed - expected
            transition_square += step**2
            transition = transition + 0.05 * step / np.sqrt(transition_square)
    model = Model(weights, bias, transition, np.zeros(4))
    features = document_features(
        np.concatenate([model.marginals(t) for t in batches]), np.concatenate([t.row for t in batches]), len(y)
    )
    return Model(weights, bias, transition, _logistic(features, y))


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in text.slices(batches):
            column = batch.column("text")
            n = batch.num_rows
            rows, marginals = [np.zeros(0, np.int64)], [np.zeros(0)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            data, offsets = text.batch_bytes(column)
            points = text.Points(data)
            for t in segments(column):
                m = model.marginals(t)
                rows.append(t.row)
                marginals.append(m)
                hit = np.flatnonzero(m >= SPAN)
                if not len(hit):
                    continue
                new = np.r_[True, (np.diff(hit) > 1) | (np.diff(t.chain[hit]) > 0) | (np.diff(t.row[hit]) > 0)]
                for group in np.split(hit, np.flatnonzero(new)[1:]):
                    row = int(t.row[group[0]])
                    # Offsets in characters from the row's first byte.
                    base, start, end = (points.before(int(x)) for x in (offsets[row], t.start[group[0]], t.end[group[-1]]))
                    spans[row].append({"start": start - base, "end": end - base, "marginal": float(m[group].max())})
            features = document_features(np.concatenate(marginals), np.concatenate(rows), n)
            scores = 1 / (1 + np.exp(-np.clip(features @ model.blend, -30, 30)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"]
            )

    return score


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("k", "text", "y")), strict=True)
    rows.sort(key=lambda r: r[:2])
    texts, marks = [r[1] for r in rows], [r[2] for r in rows]
    del rows
    model = train(texts, marks)
    del texts
    text.give_back()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on at most SAMPLE_TOXIC and SAMPLE_CLEAN documents that are not held out.

    Which ones is decided by a hash of the id, so it does not depend on how rows are dealt.
    Rows with a null id or label teach nothing; an id with several labels counts as toxic if
    one of them says so.
    """
    marks = labels.select(F.col("doc_id").alias("k"), F.col(label_col).alias("y")).where("k is not null and y is not null")
    marks = marks.where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    chosen = [
        marks.where(f"y {sign} 0").orderBy(F.xxhash64("k"), "k").limit(n)
        for sign, n in (("<>", SAMPLE_TOXIC), ("=", SAMPLE_CLEAN))
    ]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by the two sample sizes
    sample = (
        docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(picked, "k")
        .select("k", "text", (F.col("y") != 0).cast("int").alias("y"))
    )
    # The sample is bounded in rows and bytes, so one task can train; the driver sees the model only.
    order = Window.orderBy(F.xxhash64("k"), "k", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = sample.withColumn("upto", F.sum(F.octet_length("text")).over(order)).where(F.col("upto") <= TRAINING_BYTES)
    trained = sample.drop("upto").mapInArrow(_train_task, "model binary").collect()
    return pickle.loads(bytes(trained[0]["model"])) if trained else train([], [])


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: one row per row of `docs`.

    `spans` are the offending stretches (character offsets and the largest marginal).  The score
    depends on the text alone.  A null or empty text has no token and gets the score of no
    sign.  Rows with a null id are scored and count as not held out.  Repeated rows are scored
    alike; an empty table gives no rows, empty labels give scores near 0.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))  # 2 MB
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, score double, spans array<struct<start: long, end: long, marginal: double>>"
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), schema)
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, in all their columns, that are not predicted toxic.

    Null and empty texts get the score of no sign; rows with a null id are judged by their text
    like all others; repeated rows go or stay together; texts of any length are scored whole; an
    empty table stays empty; columns may have any names.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    schema = "doc_id long, score double, spans array<struct<start: long, end: long, marginal: double>>"
    keyed = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    toxic = IdSet(keyed.mapInArrow(_score(shared), schema).where(F.col("score") >= THRESHOLD).select("doc_id"))
    return toxic.keep(docs, row_key(id_col, text_col), False)

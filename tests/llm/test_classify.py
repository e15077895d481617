"""Toxicity and language: held-out accuracy, brute-force checks of the parts, edge cases."""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import language, queries, toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, spans int, k string, y int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "k", 9) for i, t, lang in rows], SCHEMA)


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    emission, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    chain = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    got, expected = toxicity.forward_backward(emission, chain, transition)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for c in range(3):
        at = np.flatnonzero(chain == c)
        total, marginal, pair = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=len(at)):
            p = np.exp(sum(emission[k] for k, t in zip(at, tags) if t) + sum(transition[a, b] for a, b in zip(tags, tags[1:])))
            total += p
            marginal += p * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pair[a, b] += p
        want[at] = marginal / total
        pairs += pair / total
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_tokens_of_a_batch():
    texts = ["Ab cd. ef", None, "", "é-9\nÀ!", "x"]
    (t,) = toxicity.segments(pa.array(texts))
    raw = "".join(x or "" for x in texts).encode()
    assert [raw[a:b].decode() for a, b in zip(t.start, t.end)] == ["Ab", "cd", "ef", "é", "9", "À", "x"]
    assert t.row.tolist() == [0, 0, 0, 3, 3, 3, 4]
    assert [int(a == b) for a, b in zip(t.chain, t.chain[1:])] == [1, 0, 0, 1, 0, 0]


def test_toxicity_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, MEDIUM).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert got.keys() == docs.keys() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == is_held_out(i) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    words = set("idiot scum moron clown loser trash stupid".split())
    caught = [r for i, r in got.items() if len(words & set(docs[i].lower().split())) >= 3]
    assert len(caught) > 20 and np.mean([r.predicted for r in caught]) > 0.9
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    clean = [r for i, r in got.items() if r.held_out and labels.get(i) == 0]
    assert len(clean) > 80 and np.mean([r.predicted for r in clean]) < 0.03
    spans = [docs[r.doc_id][s.start : s.end].lower() for r in caught for s in r.spans]
    assert np.mean([any(w in s for w in words) or s in {"worthless", "pathetic", "disgusting"} for s in spans]) > 0.9


def test_toxicity_edges(spark):
    rows = [(i, "you utter idiot of a clown" if i % 2 else "what a fine day", "en") for i in range(60)]
    odd = [(100, None, None), (101, "", "en"), (102, "é 日本 \n", "x"), (103, "idiot " * 200_000, "en"), (None, "clown idiot", None), (5, rows[5][1], "en")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (100, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows + odd)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id in (103, None) or (r.doc_id or 0) < 60 and r.doc_id % 2} == {1}
    assert {r.predicted for r in got if r.doc_id in (100, 101, 102) or r.doc_id is not None and r.doc_id < 60 and not r.doc_id % 2} == {0}
    assert not next(r.held_out for r in got if r.doc_id is None)
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(1 for r in got if not r.predicted)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 and not r.spans for r in toxicity.toxicity(docs, none).collect())
    assert toxicity.toxicity(frame(spark, []), labels).collect() == []


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    line = "_" + "_".join(words) + "_"
    return Counter(line[k : k + n] for n in (1, 2, 3) for k in range(len(line) - n + 1) if line[k : k + n] != "_")


@pytest.mark.parametrize("part", [1 << 20, 5])
def test_grams_equal_a_plain_count(monkeypatch, part):
    text = "Dès l'été, ÇA  va -- 12 abc Straße. ab ab x"
    monkeypatch.setattr(language, "PART", part)
    keys, counts = language.grams(text)
    assert sorted(counts.tolist()) == sorted(plain_grams(text).values())
    for empty in (None, "", "12 -- !"):
        assert not len(language.grams(empty)[0])


def test_language_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, MEDIUM).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == is_held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    right = [got[i].lang_pred == d.lang for i, d in docs.items() if is_held_out(i)]
    assert len(right) > 250 and np.mean(right) > 0.93


def test_distance_equals_brute_force(spark):
    rows = [(i, f"the cat and the dog number {'abcdefg'[i % 7]}", "en") for i in range(30)]
    rows += [(i, f"der hund und die katze nummer {'abcdefg'[i % 7]}", "de") for i in range(30, 60)]
    found = language.profiles(frame(spark, rows))
    counts = {"en": Counter(), "de": Counter()}
    for i, t, lang in rows:
        if not is_held_out(i):
            counts[lang].update(plain_grams(t))
    assert {lang: len(p) for lang, p in found.items()} == {lang: min(300, len(c)) for lang, c in counts.items()}
    own = language.Identifier(found)
    text = "die katze und the cat"
    mine = language.ranked(*language.grams(text)).tolist()
    for lang, profile in found.items():
        rank = {g: k for k, g in enumerate(profile.tolist())}
        apart = sum(abs(rank[g] - k) if g in rank else 300 for k, g in enumerate(mine))
        if own(text)[0] == lang:
            assert own(text)[1] == pytest.approx(1 - apart / (300 * len(mine)))
            least = apart
    assert least <= apart


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(i, "der hund und die katze", "de") for i in range(20, 40)]
    odd = [(50, None, "en"), (51, "", None), (52, "12 !", "fr"), (53, "the dog", None), (None, "die katze", None), (54, "der hund " * 300_000, None), (3, "the cat", "en")]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(frame(spark, rows + odd)).collect()}
    assert {(50, "und"), (51, "und"), (52, "und"), (53, "en"), (None, "de"), (54, "de")} <= got and len(got) == 46
    assert language.identify(frame(spark, [])).collect() == []
    assert {r.lang_pred for r in language.identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}


def plain_grams(t):
    """n-grams of one to three characters by a plain walk, as the numbers that break ties."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in t or "")
    words = letters.split(" ")
    line = [0, *(x for w in words if w for x in [*map(ord, w), 0])]
    if len(line) == 1:
        return Counter()
    out = Counter(c for c in line if c)
    out.update((1 << 63) + (a << 21 | b) for a, b in zip(line, line[1:]))
    out.update((a << 21 | b) << 21 | c for a, b, c in zip(line, line[1:], line[2:]))
    return out


def plain_ranks(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language.RANKS]]


def test_language_query_equals_plain_python(spark):
    """Profiles, out-of-place distances and choices over the whole table, by loops."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    own = {r.doc_id: plain_grams(r.text) for r in rows}
    learnt: dict[str, Counter] = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            learnt.setdefault(r.lang, Counter()).update(own[r.doc_id])
    profiles = {k: {g: n for n, g in enumerate(plain_ranks(c))} for k, c in learnt.items()}
    for r in queries.QUERIES["op7_language_id"](spark, SMALL).collect():
        mine = plain_ranks(own[r.doc_id])
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        apart = {k: sum(abs(p[g] - n) if g in p else language.RANKS for n, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert r.lang_pred == best and abs(r.score - (1 - apart[best] / (language.RANKS * len(mine)))) < 1e-12


def test_language_sample_is_chosen_in_levels(spark, monkeypatch):
    """A hot language and repeated rows: the sample is bounded, the same however rows are dealt."""
    monkeypatch.setattr(language, "SAMPLE", 5)
    rows = [(i, f"word{i} text {i % 7}", "en" if i % 3 else "de") for i in range(300)] + [(1, "same again", "en")] * 200
    found = [language.profiles(frame(spark, rows).repartition(n)) for n in (1, 9)]
    assert found[0].keys() == found[1].keys() == {"en", "de"}
    assert all((found[0][k] == found[1][k]).all() for k in found[0])


def test_toxicity_scores_equal_token_by_token(spark):
    """The chain walked word by word in plain Python, with the weights that the query learns."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    ((t00, t01), (t10, t11)) = model.transition.tolist()
    for r in docs.collect():
        raw = (r.text or "").encode()
        words = [(m.start(), m.group().lower()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        table = toxicity._slots(np.concatenate([t.features[t.word] for t in toxicity.segments(pa.array([r.text]))])) if words else []
        chain = [len(re.findall(rb"[\n!.?]", raw[:at])) for at, _ in words]
        w = model.weights
        marginals = []
        for i, own in enumerate(table):
            e = model.bias + sum(w[k] for k in own[: toxicity._KINDS])
            if i and chain[i - 1] == chain[i]:
                e += w[table[i - 1][toxicity._KINDS]]
            if i + 1 < len(table) and chain[i + 1] == chain[i]:
                e += w[table[i + 1][toxicity._KINDS + 1]]
            marginals.append(e)
        emission, marginals = marginals, [0.0] * len(marginals)
        for first in [i for i in range(len(chain)) if not i or chain[i] != chain[i - 1]]:
            last = first
            while last + 1 < len(chain) and chain[last + 1] == chain[first]:
                last += 1
            forward = [(0.0, emission[first])]
            for i in range(first + 1, last + 1):
                a, b = forward[-1]
                forward.append((np.logaddexp(a + t00, b + t10), emission[i] + np.logaddexp(a + t01, b + t11)))
            back = (0.0, 0.0)
            for i in range(last, first - 1, -1):
                a, b = forward[i - first][0] + back[0], forward[i - first][1] + back[1]
                marginals[i] = 1 / (1 + math.exp(min(700.0, a - b)))
                c, d = back[0], emission[i] + back[1]
                back = (np.logaddexp(t00 + c, t01 + d), np.logaddexp(t10 + c, t11 + d))
        strongest = min(max([*marginals, 1e-4]), 1 - 1e-4)
        total = sum(m for m in marginals if m > 0.05)
        x = [1, math.log(strongest / (1 - strongest)), math.log1p(total), total / max(len(words), 1)]
        score = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.blend, strict=True))))))
        assert abs(got[r.doc_id] - score) < 1e-6


def test_training_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "TRAINING_BYTES", 0)
    assert not toxicity.fit(docs, labels).weights.any()


def test_offsets_of_long_texts(spark):
    """Spans late in a long text count characters, not bytes, and cost no walk from its start."""
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)

    def spans(t):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], ["doc_id", "text"])
        return next(toxicity._score(type("Shared", (), {"value": model}))(iter([batch]))).column("spans")[0].as_py()

    toxic = next(r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").collect() if spans(r.text))
    alone, shifted = spans(toxic), spans("é. " * 100_000 + toxic)
    assert [(s["start"] + 300_000, s["end"] + 300_000) for s in alone] == [(s["start"], s["end"]) for s in shifted]

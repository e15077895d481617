"""Planted false positives of many kinds, most of them beyond the rules, next to planted secrets."""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
from test_secrets import frame

from tidemark.llm import secrets

NOUNS = "handler config market season virus vaccination report station garden winter letter number bridge river summer paper".split()


def planted(rng):
    """(text, value, is a secret, is unseen by the rules): forms of secrets and of what is none."""

    def of(letters, n):
        return "".join(rng.choice(list(letters), n))

    def noun():
        return str(rng.choice(NOUNS))

    base64, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    out = []
    for _ in range(60):
        for v, seen in ((of(base64, 32), True), (of(hexes, 40), True), (of(base64, 32), False), (of(hexes, 40), False)):
            out.append((f'token = "{v}" ok' if seen else f'value = "{v}" ok', v, True, not seen))
        n = int(rng.integers(1, 99))
        for v, text in (
            (f"{noun()}-{n}-{noun()}", "the page {} was read"),
            (f"src/{noun()}/v2/{noun()}_test{n}", "open {} again"),
            (f"{noun()}{n}{noun().title()}{noun().title()}", "call {} there"),
            (of(hexes, 40), "commit {} fixes it"),
            (of(hexes, 64), "sha256: {} of the file"),
            (f"{noun()}/{noun()}-{n}-{noun()}", "https://example.com/{} is up"),
            (f"{noun()}_zqplug_{noun()}_{n}", "load {} first"),  # a word that is in no dictionary
            (f"{noun()}-krwtz-{n}-{noun()}", "the page {} was read"),
        ):
            if len(v) >= secrets.MIN_LENGTH:
                out.append((text.format(v), v, False, "zqplug" in v or "krwtz" in v))
    return out


def test_planted_false_positives(spark):
    cases = planted(np.random.default_rng(17))
    prose = " ".join(NOUNS)
    rows = [(i, f"{prose} • {t}", "notes.txt") for i, (t, *_) in enumerate(cases)]
    at = {i: (f"{prose} • {t}").index(v, len(prose)) for i, (t, v, *_) in enumerate(cases)}
    got = {(r.doc_id, r.start, r.value): r.secret for r in secrets.secrets(frame(spark, rows)).collect()}
    known = secrets.Language.learn(frame(spark, rows).select("text"))
    labels = [secrets.rule_label(v, f"{prose} • {t}"[: at[i]], known) for i, (t, v, *_) in enumerate(cases)]
    assert [y is None for y in labels] == [unseen for *_, unseen in cases]
    judged = [(got.get((i, at[i], v)), y, unseen) for i, (_, v, y, unseen) in enumerate(cases)]
    for only in (False, True):  # all, and those that no rule labels
        kept = [(bool(g), y) for g, y, unseen in judged if g is not None and (unseen or not only)]
        n = Counter(kept)
        precision, recall = n[True, True] / max(1, n[True, True] + n[True, False]), n[True, True] / max(1, n[True, True] + n[False, True])
        print(f"\nunseen={only} n={len(kept)} precision={precision:.3f} recall={recall:.3f} {dict(n)}")
        assert precision > 0.95 and recall > 0.95


def test_harmless_by_rule():
    known = secrets.Language(Counter(NOUNS + ["covid", "test", "main"]))
    label = secrets.rule_label
    for value, before in (
        ("covid-19-vaccination", "the "), ("src/main/v2/handler_test1", "in "), ("2.10.3-rc1", "release "), ("0123456789abcdef0123", "commit "),
        ("0123456789abcdef0123", "sha256: "), ("a1b2c3d4e5f6g7h8", "see https://example.com/x?id="), ("${DB_PASSWORD_1}", "password = "),
    ):
        assert label(value, before, known) == 0, value
    assert label("0123456789abcdef0123", "value ", known) is None
    assert label("0123456789abcdef0123", 'token = "', known) == 1
    assert label("p@ss!w0rd.2024", "passwd=", known) == 1

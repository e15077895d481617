"""The dictionary of op2 counts every text, whatever its characters and however it is dealt out."""

from __future__ import annotations

import re
from collections import Counter

from tidemark.llm import secrets


def test_words_of_all_texts_count(spark, monkeypatch):
    monkeypatch.setattr(secrets, "DICTIONARY", 50)
    texts = ["• bullet words here", "© bullet mark", "слово слово", "日本語 words", "emoji 😀 words here", None, "", "x" * 40, "Don't ab"]
    texts += [f"tie{chr(97 + i % 26)}{chr(97 + i // 26)} words" for i in range(60)]
    want = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if 3 <= len(w) <= 32)
    top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:50]
    assert want["bullet"] == 2 and want["слово"] == 2
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    one, many = (secrets.Language.learn(docs.repartition(n)) for n in (1, 13))
    assert one.words == many.words == {w for w, _ in top}
    assert (one.log == many.log).all()
    assert (one.log == secrets.Language(Counter(dict(top))).log).all()

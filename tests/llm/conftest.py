from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_words long, node long, length string, begin int, `a b` string, _digest string, __lang string, _rank long, _doc long, _spans string, _toxicity double, line string, content string, row long, spans long, pair long"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing and odd column names."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage = say(80)
    texts = [None, "", " \t\n", "one", "Licensed under CC BY-NC 4.0.", say(120), passage, f"{say(100)} {passage} {say(60)}", "x" * 300_000, say(40_000), "日本 語 ▁ é", "<|endoftext|> a", "a\x00b  c"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 3 else None, len(t) if t else None, 0.5, None, 7, i, None, 1, "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[5], None, None, None, None, None, None, None, None, None, None), (None, None, "en", "s1", 0, 1.0, True, 0, 0, "", 0, "")]
    return spark.createDataFrame([(*r, "d", "l", None, 5, "s", 0.1, "i", None, 1, 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "ru", "te") for b in ("n", "s", "r", "") for c in ("ta", "vi", "", "do", "el")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, start int, node string, size double, `a b` string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def frame(spark, texts, first=0):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i + first, t, "en", "s", len(t) if t is not None else None, "x", 1, "y", 0.5, "z") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 120)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "two words", "one", base, base, base.upper(), base + " more", base.replace("ka", "zu", 1), long, "a\x0bb\x0cc d e f", "naïve ¡Ünïcödé! 漢字 👍🏽 x y z", "### $$$ &&& ###" * 30, ("again and again " * 200).strip(), "x" * 5000, "e\x1cf  g h i", "﻿q w e r t y"]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None, "x", 1, "y", 0.5, "z") for i, t in enumerate(texts)]
    rows += [rows[6], rows[3], (None, base, None, None, 1, "x", 1, "y", 0.5, "z"), (None, "unique text of a row without id", None, None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

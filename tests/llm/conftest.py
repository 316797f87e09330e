import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark):
    """Make ``documents`` from (id, text) or (id, text, lang, source)."""

    def make(rows, extra=""):
        full = []
        for row in rows:
            doc_id, text, lang, source = [*row, "en", "a"][:4] if len(row) == 2 else row
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra.split():
            df = df.selectExpr("*", f"'kept' AS `{name}`")
        return df

    return make


@pytest.fixture
def prose():
    """Random words; the same seed gives the same text."""

    def make(n, seed, letters="abcdefgh"):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(n))

    return make

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, row int, part int, score double"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd blanks and characters."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), None, "", " ", "one", "one two  three", "a\n\n b \t c  ", "\x00nul\x00 in text",
        "it's we'll <|endoftext|> said", "é" * 300 + " 你好 " + "🙂" * 40, "x" * 1000, prose(rng, 30_000), " lead and trail ",
        *[prose(rng, rng.randint(3, 90)) for _ in range(14)]]
    rows = [(i * 7 + 1, t, "en", f"s{i % 4}", len(t or ""), "k", i, 3, 4, 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None), (8, "same id, other text", "en", "s1", 1, "k", 1, 1, 1, 1.0)]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """Those rows, with further columns of names that operators use themselves."""
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

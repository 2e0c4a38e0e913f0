import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, place int"


def word(rng, stems=("ba", "re", "ti", "on", "el", "um", "sa", "qu")):
    return "".join(rng.choice(stems) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def odd_rows():
    """Null and empty values, one long text, repeated rows, one id on two texts; names that clash with outputs."""
    rng = random.Random(5)
    long_text = prose(rng, 20_000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "a"), (4, "one", "en", None),
            (5, long_text, "en", "b"), (5, long_text, "en", "b"), (6, "two words", None, "b"), (6, "other text", "de", "b"),
            (None, "no id at all here", "en", None), (7, "<|endoftext|> ¡Ünïcodé \U0001f600  1234!", "fr", "é")]
    return [(*r, 0, 1.0, "x", 3) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

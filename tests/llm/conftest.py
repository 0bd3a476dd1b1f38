from __future__ import annotations

import pytest

from patternmill.session import ship

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions under bright stars and old trees whisper secrets to passing clouds every single autumn night".split()


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


def prose(n: int, seed: int = 0) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes string, media int, ids string, shard string, n_words string, size double, data string, `__row` int"


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    extra = ("x", 1, "i", "s", "w", 0.5, "d", 7)
    a, long = prose(300, 1), prose(30_000, 2)
    texts = [
        (1, a, "en", "s1"), (1, a, "en", "s1"), (2, a + " end", "en", "s1"), (3, a, None, None), (4, None, "en", "s2"), (5, "", "en", "s2"), (6, " \n\t ", None, "s2"), (7, "one two", "fr", "s2"),
        (8, long, "en", "s1"), (None, prose(120, 3), "en", "s1"), (9, "\x00é日本😀 <|endoftext|> <s>", "en", "s3"), (10, prose(120, 4), "en", "s3"), (11, prose(90, 5) + "\n" + prose(90, 5), "de", "s3"),
    ]
    return [(*t, len(t[1]) if t[1] else None, *extra) for t in texts]


@pytest.fixture(scope="session")
def edges(llm):
    return llm.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(llm):
    return llm.createDataFrame([], SCHEMA)

import pytest

#: Columns whose names clash with those that operators use inside.
CLASHING = ["th", "fp", "score", "n_words", "kept", "rate", "p", "n_entities", "once", "ids", "h1", "mx_n", "pg_id", "component_id"]


def prose(seed: int, words: int) -> str:
    import random

    r = random.Random(seed)
    vocabulary = ["river", "stone", "Café", "quiet", "under", "naïve", "lamp", "seven", "winter", "über", "market", "told", "straße", "open", "日本語", "green", "after", "many", "letters", "was"]
    return " ".join(r.choice(vocabulary) + str(r.randrange(50)) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) of the cases that every operator must stand: nulls, blanks, repeated rows and ids, ties, long texts."""
    long = prose(1, 30_000)
    return [
        (1, prose(2, 120)),
        (2, prose(2, 120)),
        (3, prose(2, 119) + " ends otherwise"),
        (3, prose(3, 80)),
        (4, ""),
        (5, " \t\n\x0b\x0c\r "),
        (6, None),
        (None, prose(4, 60)),
        (None, None),
        (7, "one"),
        (7, "one"),
        (8, long),
        (9, prose(5, 50) + " " + prose(2, 120) + " " + prose(6, 50)),
        (10, "a\x00b \u200b c"),
        (11, "𝔘𝔫𝔦 " * 40),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns, whose names clash with inner ones, and nulls in them."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *([None] * len(CLASHING) if i % 2 else ["x"] * len(CLASHING))) for i, r in enumerate(odd_rows)], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

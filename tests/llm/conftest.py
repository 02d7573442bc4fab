import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


#: Nulls in any column, empty and very long texts, odd characters, repeated rows.
ODD = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, "   \n\t ", "en", "s", 6),
    (4, prose(1, 120), "en", "s", 10),
    (4, prose(1, 120), "en", "s", 10),
    (None, prose(2, 40), "en", None, 1),
    (6, "ünïcode 日本語 🙂 İstanbul ſ", "de", "s", 3),
    (7, prose(3, 60_000), "en", "hot", 9),
    (8, "x" * 400_000, "en", "hot", 9),
    (9, prose(1, 120), "fr", "hot", 9),
    (10, "12345 !!! ...", "en", "s", 13),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with further columns whose names the operators use inside."""
    rows = [(*r, "z", 7, 3, "q") for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", fp string, score int, _key int, blob string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

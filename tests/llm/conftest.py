import pytest

SCHEMA = "start string, doc_id long, ids int, text string, key string, fingerprint int, spans string, n_chars long, band int"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """``n`` words that depend on ``seed``, no two runs alike."""
    return " ".join(f"{WORDS[(seed * 7 + k * k + k) % len(WORDS)]}{(seed * 31 + k) % 97}" for k in range(n))


def rows_of(texts):
    """Documents with these ids and texts, beside columns whose names operators use themselves."""
    return [("s", i, 1, t, "k", 2, "p", None if t is None else len(t), 3) for i, t in texts]


EDGE = [
    (5, None),
    (3, ""),
    (None, "no id at all"),
    (None, None),
    (7, " \t\n\x0b\x0c\r "),
    (9, prose(1, 400)),
    (9, prose(1, 400)),
    (2, prose(1, 400)),
    (4, "tie " * 300),
    (8, "Ünïcödé 日本語 😀   ends in spaces   "),
    (1, prose(2, 20_000)),
    (6, "<|endoftext|> a@b.co +1 (212) 555-0100 1.2.3.4"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(EDGE), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows_of(list(texts)), SCHEMA).repartition(3)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, doc long, row string, `key` string, n long, packed string, found string, taken long, x double, kept string"


def rows_of(texts):
    """Documents with clashing extra columns from (doc_id, text, lang, source)."""
    return [(i, t, lang, s, None if t is None else len(t), 1, 2, 3, "r", "k", 4, "p", "f", 5, 6.0, "y") for i, t, lang, s in texts]


def edge_texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(140)) for _ in range(6)]
    near = base[0].replace("w1", "v1", 1)
    huge = " ".join(rng.choice(vocab) for _ in range(60_000))
    out = [(0, base[0], "en", "a"), (1, base[0], "en", "b"), (2, near, "en", None), (3, None, None, "a"), (4, "", "de", "c"), (5, "  \n ", "fr", "c")]
    out += [(6, "one two", "en", "a"), (7, "one two", "en", "a"), (7, "one two", "en", "a"), (None, base[1], "en", "a"), (8, base[1], None, "b")]
    out += [(9, base[2] + " " + base[3], "de", "c"), (10, base[4] + " " + base[3], "de", "c"), (11, huge, "en", "a"), (12, "tail " + huge, "en", "a")]
    out += [(13, "a" * 500, "en", "z"), (14, "1234 !!", "en", "z"), (15, "ÀÉ ñandú straße " * 30, "es", "z")]
    return out


@pytest.fixture(scope="session")
def texts():
    return edge_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

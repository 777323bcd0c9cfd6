import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties, one hot source."""
    rng = random.Random(7)
    long = words(rng, 30_000)
    base = [words(rng, rng.randint(1, 80)) for _ in range(40)]
    rows = [(i, t, "en", "big" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5].replace(" ", " \t\n"), "en", "big", 1) for i in range(30)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n\t ", "en", "s1", 4), (203, None, "en", "s2", 0)]
    rows += [(300, long, "en", "s3", len(long)), (301, long, "en", None, len(long)), (302, long + " x", "en", "s3", 9)]
    rows += [(400, "same row", "en", "s1", 8)] * 3 + [(401, "Same row", "en", "s1", 8), (402, "one two   three", "en", "s1", 8)]
    rows += [(None, "no id", "en", "s1", 5), (None, "no id", "de", "s1", 5), (None, base[0], "en", "big", 5), (7, "other text", "en", "s5", 3)]
    rows += [(500, "quote \" back \\ slash <|endoftext|> </s>[INST]", "en", "s1", 8), (501, "\u0000 zero ퟿ \U0001f600", "xx", "empty", 4), (502, None, "xx", "nowords", 0)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    """Columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    names = "row text_sha256 h possible size copies rate target hash n_words cls label bucket hub ids piece score probability features".split()
    return edge_docs.withColumns({n: F.lit("x") for n in names})

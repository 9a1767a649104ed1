import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, key string"


def rows(texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = ids if ids is not None else range(len(texts))
    return [(i, t, "en", "s", None if t is None else len(t), 7, "k") for i, t in zip(ids, texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, blank, repeated and very long texts, a null id."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéßn") for _ in range(rng.randint(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "   ", "one two three", "one two three", line(5000), "\n\n", "Σ İx 日本語 don't's", "a" * 3000, "x" * 90 + " " * 2000 + "y"]
    texts += ["Shared LINE here \n" + line(20) + "\nshared line here\n" + line(8) for _ in range(14)]
    data = rows(texts) + rows(["one two three", line(9)], [3, None])
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

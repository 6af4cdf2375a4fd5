import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, score double"


def frame(spark, rows):
    """documents of (doc_id, text), with further columns, two of them named like results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", -1.0) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def prose():
    def make(n, seed=0):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts(prose):
    """Null, empty, blank, one word, other scripts, control characters, a very long text."""
    return [None, "", " \n\t ", "one", "Ünï\x00cödé \x1f 中文 😀 ｆｕｌｌ", "a\r\nb\x0bc\x0cd", prose(30_000, 5)]

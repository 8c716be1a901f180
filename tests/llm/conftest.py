"""Small frames with the awkward rows every operator must take."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null id, null/empty/blank/long texts, repeated rows, and columns whose names clash with internal ones."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(6000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta\nshared line number one\n\ttail", "en"),
        (2, "Shared Line Number One \nother words here now and then", "en"),
        (2, "Shared Line Number One \nother words here now and then", "en"),
        (3, None, None), (4, "", "fr"), (5, " \t\n ", "de"), (6, long, "en"), (7, long + " end", "es"), (None, "shared line number one", None),
        (8, "alpha beta gamma delta epsilon zeta eta theta iota", "en"),
    ]
    return spark.createDataFrame([(i, t, la, len(t or ""), "x", 1) for i, t, la in rows],
                                 "doc_id long, text string, lang string, n_chars long, _id string, runs int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

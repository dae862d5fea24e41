"""Small tables that hold the odd rows: nulls, empty and very long texts, ties, repeats, clashing columns."""

import pytest

LONG = " ".join(f"long{i % 977}" for i in range(30_000))
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en"),
    (2, "One two three four five six seven eight nine ten eleven twelve", None),
    (3, None, "en"),
    (4, "", "de"),
    (5, "   \n\t ", "de"),
    (6, "word", "fr"),
    (None, "a row without an id", "fr"),
    (7, LONG, "en"),
    (8, LONG + " end", "en"),
    (9, "émile  a b\n\n  x 😀", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names clash with those that the operators add."""
    rows = [(*x, "clash", 0) for x in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, registers string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

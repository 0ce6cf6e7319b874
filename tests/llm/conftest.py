import pytest

#: Nulls, empty and long texts, ties, repeated rows, odd white space.
ODD = [
    (5, None), (1, ""), (2, "one"), (2, "one"), (None, "no id"), (3, "a  b\n c  "), (4, "word " * 9000), (7, " \t\n"),
    (8, "don't é́ ΑΣ 日本語 12 345\x1c <|endoftext|> x"), (9, "same text here with a few words more"), (6, "same text here with a few words more"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of odd kinds, with columns whose names operators use themselves."""
    rows = [(i, t, "x", 0, 1.5, "w") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start long, score double, worker string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels():
    return pd.read_parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) rows that every operator must take: nulls, empties, blanks, repeats, a long text, odd characters."""
    long = "word and other words go on " * 4000
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, long), (None, "no id here"), (None, None),
        (6, "zürich \U0001f600 ▁ naïve x y \x00 ͸"), (7, "a" * 3000), (8, "\n\n\n"), (9, "!!! ??? ***"),
        (10, "password: aaaaaaaaaaaa \U0001f600 token=bbbbbbbbbbbbbbbb AKIA" + "B" * 16),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with further columns whose names clash with results."""
    rows = [(i, t, "x", 1.0, True) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, n_words double, kept boolean")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")

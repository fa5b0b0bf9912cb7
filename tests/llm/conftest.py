import pytest
from helpers import COLUMNS, SF, document


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank, very long, repeated and equal texts, names that clash."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        document(3, None), document(None, "alone without an id"), document(5, ""), document(6, " \n\t "), document(7, long), document(8, long),
        document(9, "same text here", None), document(9, "same text here", None), document(10, "same text here", "b"), document(None, None, None),
        document(11, "Tab\tand nbsp  two spaces line <|endoftext|> it's"), document(12, "\x1c odd \x85 separators \U0001f600"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

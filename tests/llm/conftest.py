import pytest

WORDS = [f"w{i}" for i in range(400)]


def text(*numbers):
    return " ".join(WORDS[n % 400] + str(n // 400 or "") for n in numbers)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long = text(*range(30_000))
    rows = [
        (1, text(*range(100)), "src", 5, "x"), (2, text(*range(100)), None, None, "x"), (3, text(*range(3, 103)), "src", 1, None), (3, text(*range(3, 103)), "src", 1, None),
        (4, "", "src", 0, "x"), (5, None, None, None, None), (None, text(*range(2, 102)), "s", 1, "x"), (None, None, None, None, None), (6, long, "s", 1, "x"),
        (7, long + " tail", "s", 1, "x"), (8, "Only three words", "s", 1, "x"), (9, "only three WORDS", "s", 1, "x"), (10, " \n\t ", "s", 1, "x"), (11, text(*range(200, 300)), "s", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, component string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_words long, component string")

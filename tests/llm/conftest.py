import pytest

L = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
#: Nulls, empty and long texts, ties, equal rows; helper-like names among the columns.
EDGE = [
    (1, L * 3, "a", 1, 1), (1, L * 3, "a", 1, 1), (2, None, None, None, None), (None, "x y", "a", 0, 0), (3, "", None, 0, 0), (3, "different words here", "b", 0, 0),
    (4, L * 3 + "new", "b", 0, 0), (None, None, None, 0, 0), (5, "one two", "b", 1, 1), (6, "One TWO", "b", 1, 1), (7, "x " * 20000, "c", 1, 1), (8, L * 3, "c", 2, 2),
]
SCHEMA = "doc_id long, text string, source string, `_lost` int, keep_id int"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    return spark.read.parquet(path)

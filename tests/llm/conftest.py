import pytest

ODD = "id bigint, text string, lang string, class_id string, uid string, parts string, s int"


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank texts, a long one, repeated rows, columns with names that operators use."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, long), (5, long), (6, "x" * 50_000), (7, "a\nb\n" * 40), (None, None)]
    return spark.createDataFrame([(i, t, "en", "k", "u", "p", 1) for i, t in rows], ODD)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")

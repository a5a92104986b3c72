import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog\nand runs\naway", 5, "x"), (2, "the quick brown fox jumps over the lazy dog\nand runs\naway", 5, None),
        (3, None, None, "y"), (4, "", 0, "y"), (None, "no id here at all", 1, "z"), (None, None, None, None), (5, "one", 3, "z"), (5, "one", 3, "z"),
        (6, " \t\n\r ", 5, "z"), (7, " ".join(f"w{i % 97}x{i}" for i in range(30000)), 9, "z"), (8, "Ünïcode wörds ☃ \u00a0 here", 2, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, h string")

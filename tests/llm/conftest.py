import pytest

LONG = "lorem " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, blank and very long texts, repeated rows, and columns with names used inside."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "a", "x", 1, "q"),
        (1, "one two three four five six seven eight nine ten eleven", "a", "x", 1, "q"),
        (2, "one two three four five six seven eight nine ten eleven", None, "x", 1, None),
        (None, "mail bob@example.com or +1 (555) 123-4567 from 10.0.0.1", None, None, None, "q"),
        (3, None, "b", None, None, None),
        (4, "", "b", "y", 0, "q"),
        (5, " \t\n ", "b", "y", 0, "q"),
        (6, LONG, "c", "y", 0, "q"),
        (7, "short", "a", "", 0, ""),
    ]
    schema = "doc_id bigint, text string, source string, lang string, size int, _key string"
    frame = spark.createDataFrame(rows, schema)
    for name in ("row", "key", "score", "label", "node", "copies", "spans", "place", "rank", "chunk", "n", "_parts"):
        frame = frame.withColumn(name, frame["lang"])
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

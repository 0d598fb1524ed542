import pytest

ODD_TEXTS = [
    None, "", " ", "\n", "\n\n \t\n", "one", "one two", "two two two two two", "Ünïcode ß 世界 \U0001f600 é́", "a b   c\x0bd",
    "Line that is rather long and comes back again and again.\n" * 3, "word " * 3000, "\x00\x01\x1c control",
]


@pytest.fixture
def odd_docs(spark):
    """Null and odd texts, a repeated row, a null id, and columns whose names operators might use themselves."""
    rows = [(i, t, "en", "s", None, "x", 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "a text without an id", None, None, 3, None, None), (3, "another text under a known id", "de", "s", 1, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n_dropped int")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

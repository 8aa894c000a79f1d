import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Null, empty and blank texts, a very long one, ties, repeated rows, a null and a repeated doc_id."""
    long = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
    texts = [None, "", " \n\t ", long, "one two three four five six", "one two three four five six", "Ü ä\n\nß.", "ids lost", "first text", "second text"]
    return make_docs(texts, [0, 1, 2, 3, 4, 5, 6, None, 7, 7]).unionByName(make_docs(["again", "again"], [8, 8]))


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])

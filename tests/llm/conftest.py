import pytest

from lodeworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", partitions=4, memory="4g")


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases: null and empty texts, repeated rows, a null source, an extra column with an operator's name."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "a"), (2, base.replace("word30", "x"), "en", "b"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t", "de", None),
        (6, "Ünï cödé password = abcdef123 🙂 x", "de", "b"), (7, "one two", "fr", "c"), (8, ("long text here " * 4000).strip(), "fr", "c"), (None, "no id but text", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_tokens int, bucket int")

"""Fixtures of these tests, imported by name: a second conftest would hide the first one."""

import pytest

DOCS = "doc_id long, text string, lang string, score double, line string, node string"


@pytest.fixture
def docs_of(spark):
    """A table of documents with columns whose names the operators use themselves."""

    def made(rows):
        return spark.createDataFrame([(i, t, "en", 0.5, "x", None) for i, t in rows], DOCS)

    return made


@pytest.fixture
def odd():
    """Null, empty and blank texts, a null id, repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f g"), (4, "one"), (4, "one"), (None, None)]

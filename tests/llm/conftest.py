import re

import pytest

CLASHES = "row_id long, hash long, key string, copy int, doc string, words string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents frame of (doc_id, text, lang, source) rows, with extra columns whose names operators use inside."""
    def make(data):
        schema = "doc_id long, text string, lang string, source string, " + CLASHES
        return spark.createDataFrame([(*row, 1, 2, "k", 3, "d", "w") for row in data], schema)
    return make


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

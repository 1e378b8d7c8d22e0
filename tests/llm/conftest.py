import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """docs(texts or (id, text) or whole rows) as a documents table."""

    def make(rows, schema=COLUMNS):
        out = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            out.append(r if len(r) > 2 else (r[0], r[1], "en", "s", None if r[1] is None else len(r[1])))
        return spark.createDataFrame(out, schema)

    return make

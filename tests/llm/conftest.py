import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from texts, (id, text) pairs or (id, text, lang, source)."""

    def make(items, parts=3):
        rows = []
        for i, item in enumerate(items):
            row = item if isinstance(item, tuple) else (i, item)
            row = tuple(row) + ("en", "s0")[len(row) - 2 :] if len(row) < 4 else tuple(row)
            rows.append((*row, None if row[1] is None else len(row[1])))
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make

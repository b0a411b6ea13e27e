import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, with columns whose names clash
    with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        docs = spark.createDataFrame(full, DOCS)
        return docs.selectExpr("*", "'x' AS kept", "1 AS n_words", "doc_id AS node", "'k' AS key", "2 AS label",
                               "array(1) AS bands", "'b' AS blob_id", "'l' AS line", "0 AS row", "'u' AS u")
    return make


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]

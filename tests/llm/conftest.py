"""Documents as rows; the operators' results as dictionaries by doc_id."""

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(*rows, schema=SCHEMA):
        """(doc_id, text) or (doc_id, text, source) each."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest tables, as (doc_id, text, source)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}

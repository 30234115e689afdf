import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    return dict(zip(*(pq.read_table(f"{SMALL}/documents.parquet", columns=[c])[c].to_pylist() for c in ("doc_id", "text"))))


@pytest.fixture
def make_docs(spark):
    """docs(doc_id, text, lang, source, n_chars, size, key): the columns of documents and two whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, lang, source, len(t or ""), -1, "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size long, key string")

    return make

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, id long, class_id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and repeated rows, a very long text, ties, and extra columns with clashing names."""
    texts = [None, "", "   ", "one", "The cat sat on the mat. " * 3, "The cat sat on the mat. " * 3, "word " * 30_000, "Ünï çödé 日本語 🎉 <|endoftext|> x", "a\u0000b\tc  d\n\n e", "!!! ... 123"]
    rows = [(k, t, None if k % 3 else "en", "s", 1, "x", 0.5, 9, None) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4]], SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

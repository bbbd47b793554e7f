import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string, "
           "bucket string, score double, spans string, kept string, LENGTH string")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, copies, repeated rows and clashing names."""
    clash = ("x", None, "y", "z", None, "s", "k", "l")
    rows = [
        (1, "The cat sat on the mat and looked at the other cat for a while.", "en", "a", 62, *clash),
        (2, None, "en", "a", None, *clash),
        (3, "", None, None, 0, *clash),
        (4, "  \t\n ", "en", "a", 5, *clash),
        (5, "12345 !!! ???", None, "b", 13, *clash),
        (6, "The cat sat on the mat and looked at the other cat for a while.", "en", "b", 62, *clash),
        (6, "The cat sat on the mat and looked at the other cat for a while.", "en", "b", 62, *clash),
        (None, "Nobody knows which number this text has, not even its author.", "en", "c", None, *clash),
        (8, "wort " * 60_000, "de", "c", 300_000, *clash),
        (9, "a" * 200_000, None, "c", 200_000, *clash),
        (10, "é漢字🙂 mixed ＡＢ text with spaces", "en", None, 30, *clash),
        (11, "one two three", "en", "a", 13, *clash),
        (12, "ONE two   three", "en", "a", 15, *clash),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """The same table without rows."""
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}

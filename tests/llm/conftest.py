import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, None if i is None else "en", None if t is None else "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, TEXTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and white texts, a very long one, ties and repeated rows."""
    long = "word " * 300_000
    return [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "x" * 200_000), (None, "a b c d e f g"), (7, "é ü 漢字 ß"), (8, "a b c d e f g"), (None, None)]


@pytest.fixture(scope="session")
def clashing(docs_of, odd_rows):
    """The odd rows with more columns: names that operators use within, and one that differs from theirs by case alone."""
    from pyspark.sql import functions as F

    names = ["score", "row", "base", "part", "curve", "near", "hits", "terms", "text_hash", "th", "s", "c0", "c1", "n_email", "n_ip", "n_card", "n_phone", "__first", "__th", "__id", "held_out", "predicted", "root", "key"]
    more = docs_of(odd_rows).select("*", *(F.lit(i if i % 2 else None).alias(n) for i, n in enumerate(names)), F.lit("x").alias("other"))
    return more.toDF(*more.columns[:-1], "TEXT")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

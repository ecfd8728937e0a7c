import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, u string, score string, Shard string, fp string, __w string, src string, h string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    extra = ("kept", "size", "u", "score", "shard", "fp", "w", "src", "h")
    tie = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"word{k % 977}x{k}" for k in range(60_000))
    texts = [(1, tie, "en", "a"), (2, tie, "en", "a"), (2, tie, "en", "a"), (3, "", "en", None), (4, None, None, "a"), (None, tie, "de", "b"), (None, None, None, None), (5, long, "en", "b"), (6, " \t\n ", "en", "c"), (7, "x" * 200_000, "fr", "c"), (8, "É ß \U0001f600 k", "fr", "c"), (-9, "## $$ | <b> &&", "en", "a")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *extra) for i, t, lang, s in texts], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}

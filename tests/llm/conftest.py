import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000
#: Null and empty texts, blanks only, one word, ties, repeated rows, a very long text, other scripts.
TEXTS = [None, "", "   \n\t ", "word", "same text here for two rows of it", "same text here for two rows of it", LONG, "naïve café 中文 \U0001f600 text\nline", "x" * 30_000, "\n\n\n", "1 2 3 4 5 6 7 8 9 10 11 12 13"]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows of edge cases, with further columns whose names clash with outputs."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("score", F.lit("mine")).withColumn("id", F.lit(-1)).withColumn("n_tokens", F.lit(None).cast("int")).withColumn("block", F.lit(9)).withColumn("n", F.lit("x"))


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")

import pytest

ODD = [
    (None, None, None),
    (1, None, "x"),
    (2, "", "x"),
    (3, "one two", "x"),
    (4, "one two", "x"),
    (4, "one two", "x"),
    (5, "word " * 30000, "y"),
    (6, "z" * 50000, "y"),
    (7, "!!! ??? ...", None),
    (8, "日本語のテキスト 🎉 \x1f\x85 text", "y"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and clashing extra columns."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, n string")
    for c in ("key", "bucket", "cell", "h", "g", "rank", "tag", "quality", "secrets", "pieces", "band"):
        df = df.withColumn(c, df.n)
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

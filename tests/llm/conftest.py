import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns whose names clash."""
    long = " ".join(f"word{i % 900} tail{i % 7}." for i in range(6000))
    prose = lambda k: " ".join(f"w{(i * k) % 997}x" for i in range(120))
    rows = [
        (1, prose(3), "en", "a"), (1, prose(3), "en", "a"), (2, prose(3) + " more", "en", "a"), (3, prose(5), "de", None),
        (4, None, "en", "b"), (5, "", None, "b"), (6, "   \n\t ", "fr", "c"), (7, long, "en", "c"), (8, "one two", "en", "b"),
        (9, "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" is said", "en", "a"), (None, prose(7), "en", "b"), (11, prose(11) + " Été naïve — 日本 don't", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"size": F.lit("own"), "target": F.lit(1), "x_": F.lit(0), "fp": F.lit("f"), "label": F.lit(None).cast("string")})


@pytest.fixture
def no_docs(docs):
    return docs.filter("false")

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("size", T.IntegerType())])


def words(a: int, b: int, step: int = 1) -> str:
    return " ".join(f"w{i * step}" for i in range(a, b))


BASE = words(0, 120)
TEXTS = [
    BASE,
    BASE,
    BASE.replace("w60 ", "changed "),
    BASE.replace("w10 ", "other "),
    BASE[:300] + " " + words(500, 560),
    None,
    "",
    "   \n\t ",
    "one two three",
    "One TWO three",
    "one two three four five",
    words(1000, 1040) + " " + words(1000, 1040),
    words(2000, 2013) + " tail",
    "é ü 字 words of é ü 字 words of é ü 字 words of",
    "line\nline\n\nline # $ %",
    words(3000, 3400) + "\n" + BASE[:200],
    "short copied passage that is exactly fifty bytes!!" + "x" * 10,
    "y" * 10 + "short copied passage that is exactly fifty bytes!!",
    words(0, 3, 7) + " a\xa0b c d e",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empties, ties, repeated rows, and extra columns that clash with results."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, "clash", i) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, BASE, None, None, 1, None, None), (None, "one two three", None, "s1", 1, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

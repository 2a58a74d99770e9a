import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, id string, hash int, mix_size int, term string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"w{n % 977}" for n in range(30_000))
    same = " ".join(f"same{n}" for n in range(120))
    rows = [
        (None, None, None, None),
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "de", "b"),
        (5, "one", "en", "b"),
        (6, "One\x0btwo\x1cthree four é É <|im_end|> \\ <| 日本 🙂", "xx", "é"),
        (7, long, "en", "a"),
        (8, same, "en", "c"),
        (9, same, "en", "c"),
        (9, same, "en", "c"),
        (9, same + " more", "fr", None),
        (None, same, "en", "a"),
        (10, "x" * 5000, "en", "a"),
        (11, "ab " * 700, "es", "z"),
        (12, same.replace("same7 ", "other "), "en", "c"),
    ]
    full = [(*r, None, "clash", "clash", 7, 8, "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint")).repartition(3).cache()


@pytest.fixture(scope="session")
def some(spark):
    """The whole documents of the smallest tables."""
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

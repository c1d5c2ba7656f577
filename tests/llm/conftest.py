import os

import pytest

SF = "/root/testdata/sf0.001"


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("shared tables not present")
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", None, 3),
    (5, "Hello, World! it's 42 — naïve ÉTÉ <|endoftext|> x", "fr", "b", 40),
    (5, "Hello, World! it's 42 — naïve ÉTÉ <|endoftext|> x", "fr", "b", 40),
    (None, "a text whose id is null and has some more words in it", "en", "b", 50),
    (6, "a b  c\n\n d  \n e\tf 日本語 ４５ é x", "de", "c", 20),
    (7, "word " * 3000, "en", "c", 15000),
    (8, "\n".join(["the same line again"] * 8), "en", "c", 150),
    (9, "x" * 4000, "de", "c", 4000),
]

#: A documents table with nulls, empty and long texts, repeated rows and columns of clashing names.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(ODD, ODD_SCHEMA)
    clash = ("row", "key", "score", "accepted", "fp", "ids", "spans", "shard", "kept", "region")
    return plain.withColumns({c: F.lit(f"own {c}") for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

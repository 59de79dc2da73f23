"""Small documents with everything that may go wrong in them."""

import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "   \n\t ", "fr", "b", 6),
    (6, "été 中文 🎉 " * 40 + "x" * 3000, "fr", "b", 9),
    (7, "one", "en", "c", 3),
    (8, "A passage of some length that two documents have in common, word for word, and that is longer than a window by far. Then something else: alpha.", "en", "c", 1),
    (9, "Other start. A passage of some length that two documents have in common, word for word, and that is longer than a window by far. End.", "en", "c", 1),
    (10, "word " * 5000, "de", "a", 25000),
    (11, "The quick brown fox jumps over the lazy dog! " * 8, "en", "a", 1),
    (11, "The quick brown fox jumps over the lazy dog! " * 8, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for what they add or hold.
CLASHES = ["shard", "slot", "position", "copy", "fingerprint", "spans__", "bucket__", "noise__", "law", "first__"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def with_clashes(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

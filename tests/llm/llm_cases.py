"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mergelens.sources.staging import Staging

LONG = " ".join(f"word{i % 977} tale{i % 31}" for i in range(60_000))


@pytest.fixture()
def stage(spark):
    return Staging(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents whose extra columns have the names the operators use inside."""
    base = "The cat sat on the mat. It was warm there, so it stayed until night fell.\nThen it left the house at once."
    rows = [
        (1, base, "en", "b"), (2, base, "en", "b"), (3, base + " Twice.", "en", "a"), (3, base + " Twice.", "en", "a"),
        (4, None, "en", "a"), (5, "", None, None), (6, "   \n\t ", "fr", None), (7, "12 34 !?", "fr", "c"),
        (8, "mot", "fr", "c"), (9, "Mot", "fr", "c"), (None, "ein Satz ohne Nummer", "de", "b"),
        (10, LONG, "en", "a"), (11, "<s>[INST] \\ </s> é ü 語　 x", "de", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ["id", "n", "key", "fp", "size", "score", "lang_pred", "_row", "copy", "taken", "copies", "start", "at"]
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(c) for c in extra}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

import random

import pytest

pytest.importorskip("patrolkit.llm")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts; ids count from 0."""

    def make(texts, first=0, lang="en"):
        rows = [(first + i, t, lang, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    long_text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "idiot", "x = 'abcdefgh'"]) for _ in range(30_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", 0), (None, "no id at all", None, None, None), (3, long_text, "de", "b", len(long_text)),
        (4, "twice", "en", "a", 5), (4, "twice", "en", "a", 5), (5, "ümläut 日本 \x00 \u2028 tab\there", None, "c", 20), (6, "   \n\t ", "fr", None, 6), (None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    clash = ["score", "passages", "fp", "lang_pred", "n_words", "n_hit", "spans", "n_tokens", "row", "shard", "slot", "clean_text", "batch", "size", "component_id", "part", "kept_id"]
    return table.select("*", *[F.lit("own").alias(c) for c in clash])


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
